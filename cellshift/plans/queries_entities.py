"""Registered queries: registries, support, routing and structure views (group G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.text import entity_key
from cellshift.operators import entities, folds
from cellshift.plans.queries_folds import axis_table
from cellshift.plans.registry import query, view
from cellshift.plans.study import FOLDS
from cellshift.session import written
from cellshift.sources.star import Star

view(
    "v_res",
    """
SELECT s.*, lower(s.chemical) AS chemical_key, lower(s.strain) AS strain_key,
       coalesce(c.canonical_id, '') AS c_id, coalesce(c.mapping_status, 'unresolved') AS c_status, coalesce(c.proxy_target, '') AS c_proxy_target,
       coalesce(r.canonical_id, '') AS s_id, coalesce(r.mapping_status, 'unresolved') AS s_status,
       coalesce(c.canonical_id, 'raw:' || lower(s.chemical)) AS c_key, coalesce(r.canonical_id, 'raw:' || lower(s.strain)) AS s_key
FROM v_samples s LEFT JOIN v_creg c ON lower(c.raw_name) = lower(s.chemical) LEFT JOIN v_sreg r ON lower(r.strain_code) = lower(s.strain)
""",
)
# The fit of these queries: train rows outside the first chemical fold and the first strain fold.
view(
    "v_gfit",
    "SELECT * FROM v_res WHERE split = 'train' AND chemical NOT IN (SELECT chemical FROM v_cfold WHERE fold = 0) AND strain NOT IN (SELECT strain FROM v_sfold WHERE fold = 0)",
)


def resolved(star: Star) -> DataFrame:
    # The combinations of names are resolved and stored; known as small, they come to the samples, which stay in their buckets.
    named = star.stored("entity-names", lambda: star.samples.select("chemical", "strain").distinct())
    table = star.stored("resolved-names", lambda: entities.with_support_keys(named, star.chemical_registry, star.strain_registry))
    table = table.withColumnsRenamed({"chemical": "_chemical", "strain": "_strain"})
    same = F.col("chemical").eqNullSafe(F.col("_chemical")) & F.col("strain").eqNullSafe(F.col("_strain"))
    return star.samples.join(table, same, "left").drop("_chemical", "_strain")


def fit_part(star: Star, rows: DataFrame) -> DataFrame:
    """Train rows without the chemicals and strains of the first hold-out folds."""
    treated = star.train.filter(F.col("kind") == "treatment")
    out_c = folds.balanced_group_folds(treated, "chemical", FOLDS, 101).filter("fold = 0").select("chemical")
    out_s = folds.balanced_group_folds(treated, "strain", FOLDS, 211).filter("fold = 0").select("strain")
    train = rows.filter(F.col("split") == "train")
    return train.join(out_c, "chemical", "left_anti").join(out_s, "strain", "left_anti")


@query(
    "g01_entity_keys",
    """
SELECT DISTINCT p_name AS name, lower(trim(regexp_replace('  ' || upper(p_name) || chr(9) || ' (' || p_type || ')', '\\s+', ' ', 'g'))) AS entity_key FROM part
UNION SELECT 'wide ' || p_type, lower(p_type) || ' strasse' FROM part
""",
)
def g01(star: Star) -> DataFrame:
    parts = star.table("part")
    ascii_names = parts.select(
        F.col("p_name").alias("name"),
        F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t (") , F.col("p_type"), F.lit(")")).alias("raw"),
    ).distinct()
    # Full-width letters and a no-break space need compatibility normalisation.
    wide = F.translate("p_type", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    unicode_names = parts.select(F.concat(F.lit("wide "), F.col("p_type")).alias("name"), F.concat(wide, F.lit("  STRAßE")).alias("raw")).distinct()
    return ascii_names.unionByName(unicode_names).select("name", entity_key("raw").alias("entity_key")).distinct()


@query(
    "g02_resolution",
    "SELECT sample_id, c_id AS canonical_id, c_status AS status, c_proxy_target AS proxy_target, c_status = 'proxy' AS is_proxy, "
    "c_status = 'unresolved' OR c_status = 'proxy' AS is_missing, c_status IN ('verified', 'high_confidence_candidate') AS semantic FROM v_res",
)
def g02(star: Star) -> DataFrame:
    rows = entities.resolve(star.samples, "chemical", star.chemical_registry, "raw_name", "c", allow_proxy=False)
    return rows.select(
        "sample_id",
        F.col("c_canonical_id").alias("canonical_id"),
        F.col("c_status").alias("status"),
        F.col("c_proxy_target").alias("proxy_target"),
        F.col("c_proxy").alias("is_proxy"),
        F.col("c_missing").alias("is_missing"),
        F.col("c_semantic").alias("semantic"),
    )


@query("g03_support_keys", "SELECT chemical, c_key AS support_key, count(*) AS n_samples FROM v_res GROUP BY 1, 2")
def g03(star: Star) -> DataFrame:
    return resolved(star).groupBy("chemical", F.col("chemical_support_key").alias("support_key")).agg(F.count(F.lit(1)).alias("n_samples"))


def faulty_registry(star: Star) -> DataFrame:
    """The chemical registry with one fault of every kind injected."""
    n = F.col("number")
    broken = star.chemical_registry.withColumns(
        {
            "mapping_status": F.when(n == 6, "guessed").otherwise(F.col("mapping_status")),
            "evidence_tier": F.when(n == 7, "Z_unknown").otherwise(F.col("evidence_tier")),
            "canonical_id": F.when(n == 8, "").otherwise(F.col("canonical_id")),
            "proxy_target": F.when(n == 10, "").when(n == 15, F.col("canonical_id")).when(n == 11, "chem:1").otherwise(F.col("proxy_target")),
            "inchikey": F.when(n == 14, "ABC").otherwise(F.col("inchikey")),
            "is_control": F.when(n == 12, "maybe").when(n == 3, "true").otherwise(F.col("is_control")),
        }
    )
    copies = broken.filter(n == 13).withColumn("raw_name", F.concat(F.lit("  "), F.upper("raw_name")))
    return broken.unionByName(copies)


@query(
    "g04_registry_issues",
    """
WITH b AS (SELECT lower(raw_name) AS key, number, canonical_id, is_quality_control,
   CASE WHEN number = 6 THEN 'guessed' ELSE mapping_status END AS st, CASE WHEN number = 7 THEN 'Z_unknown' ELSE evidence_tier END AS tier,
   CASE WHEN number = 8 THEN '' ELSE canonical_id END AS cid, CASE WHEN number = 10 THEN '' WHEN number = 15 THEN canonical_id WHEN number = 11 THEN 'chem:1' ELSE proxy_target END AS pt,
   CASE WHEN number = 14 THEN 'ABC' ELSE inchikey END AS ik, CASE WHEN number = 12 THEN 'maybe' WHEN number = 3 THEN 'true' ELSE is_control END AS ctl FROM v_creg),
 r AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE number = 13)
SELECT 'error' AS severity, 'invalid_mapping_status' AS code, key FROM r WHERE st NOT IN ('verified', 'high_confidence_candidate', 'proxy', 'unresolved')
UNION ALL SELECT 'error', 'invalid_evidence_tier', key FROM r WHERE tier = 'Z_unknown'
UNION ALL SELECT 'error', 'blank_canonical_id', key FROM r WHERE cid = ''
UNION ALL SELECT 'error', 'proxy_without_target', key FROM r WHERE st = 'proxy' AND pt = ''
UNION ALL SELECT 'error', 'proxy_collapsed_to_target', key FROM r WHERE st = 'proxy' AND cid <> '' AND cid = pt
UNION ALL SELECT 'warning', 'unexpected_proxy_target', key FROM r WHERE st <> 'proxy' AND pt <> ''
UNION ALL SELECT 'error', 'unresolved_has_structure', key FROM r WHERE st = 'unresolved' AND ik <> ''
UNION ALL SELECT 'warning', 'mapping_not_verified', key FROM r WHERE st IN ('high_confidence_candidate', 'proxy', 'unresolved')
UNION ALL SELECT 'error', 'invalid_boolean', key FROM r WHERE ctl = 'maybe'
UNION ALL SELECT 'error', 'control_qc_conflict', key FROM r WHERE ctl = 'true' AND is_quality_control = 'true'
UNION ALL SELECT 'error', 'normalized_key_collision', key FROM r GROUP BY key HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'error', 'missing_required_entities', lower(p_brand) FROM part WHERE lower(p_brand) NOT IN (SELECT key FROM r)
""",
)
def g04(star: Star) -> DataFrame:
    return entities.registry_issues(faulty_registry(star), "raw_name", required=star.table("part").select("p_brand"))


SUPPORT_SQL = """
SELECT DISTINCT 'chemical_raw' AS axis, chemical_key AS key FROM v_gfit UNION SELECT 'strain_raw', strain_key FROM v_gfit
UNION SELECT 'chemical_support', c_key FROM v_gfit UNION SELECT 'strain_support', s_key FROM v_gfit
UNION SELECT 'chemical_canonical', c_id FROM v_gfit WHERE c_status <> 'unresolved' AND c_id <> '' UNION SELECT 'strain_canonical', s_id FROM v_gfit WHERE s_status <> 'unresolved' AND s_id <> ''
"""


@query("g05_fit_support", SUPPORT_SQL)
def g05(star: Star) -> DataFrame:
    return entities.fit_support(fit_part(star, resolved(star)))


PAIRS_SQL = """
SELECT 'raw_pair' AS axis, strain_key || chr(31) || chemical_key AS key, count(*) AS n FROM v_gfit WHERE kind = 'treatment' GROUP BY 2
UNION ALL SELECT 'pair', s_key || chr(31) || c_key, count(*) FROM v_gfit WHERE kind = 'treatment' GROUP BY 2
UNION ALL SELECT 'raw_context_time', concat_ws(chr(31), strain_key, chemical_key, lower(medium), lower(temperature), CAST(pert_time AS VARCHAR), pert_time_unit), count(*) FROM v_gfit WHERE kind = 'treatment' GROUP BY 2
UNION ALL SELECT 'context_time', concat_ws(chr(31), s_key, c_key, lower(medium), lower(temperature), CAST(pert_time AS VARCHAR), pert_time_unit), count(*) FROM v_gfit WHERE kind = 'treatment' GROUP BY 2
"""


@query("g06_treatment_support", PAIRS_SQL)
def g06(star: Star) -> DataFrame:
    return entities.treatment_support(fit_part(star, resolved(star)))


view("v_support", SUPPORT_SQL)
view("v_pairs", PAIRS_SQL)
view(
    "v_routed",
    """
SELECT *, CASE WHEN cs AND ss THEN 'seen_seen' WHEN NOT cs AND ss THEN 'unseen_chemical' WHEN cs AND NOT ss THEN 'unseen_strain' ELSE 'unseen_both' END AS support_route
FROM (SELECT *, c_key IN (SELECT key FROM v_support WHERE axis = 'chemical_support') AS cs, s_key IN (SELECT key FROM v_support WHERE axis = 'strain_support') AS ss,
  s_key || chr(31) || c_key IN (SELECT key FROM v_pairs WHERE axis = 'pair') AS ps,
  concat_ws(chr(31), s_key, c_key, lower(medium), lower(temperature), CAST(pert_time AS VARCHAR), pert_time_unit) IN (SELECT key FROM v_pairs WHERE axis = 'context_time') AS xs FROM v_res)
""",
)


@query("g07_support_route", "SELECT sample_id, cs AS chemical_seen, ss AS strain_seen, support_route FROM v_routed")
def g07(star: Star) -> DataFrame:
    flagged = entities.support_flags(stored_resolved(star), stored_support(star))
    return flagged.select("sample_id", "chemical_seen", "strain_seen", "support_route")


def stored_resolved(star: Star) -> DataFrame:
    """Resolved metadata of every sample, derived once per application."""
    return star.stored("resolved", lambda: resolved(star))


def stored_support(star: Star) -> DataFrame:
    """Keys seen in fitting, derived once per application."""
    return star.stored("support", lambda: entities.fit_support(fit_part(star, stored_resolved(star))))


def audited(star: Star) -> DataFrame:
    """Route audit of every sample, in the buckets of the samples, over the stored support sets."""
    pairs = star.stored("pairs", lambda: entities.treatment_support(fit_part(star, stored_resolved(star))))
    return entities.route_audit(resolved(star), stored_support(star), pairs)


@query(
    "g08_route_audit",
    """
SELECT sample_id, ps AS pair_seen, xs AS context_time_seen, ss AS strain_expert_enabled, kind = 'treatment' AND cs AS chemical_expert_enabled, kind = 'treatment' AND ps AS pair_expert_enabled,
  CASE WHEN kind <> 'treatment' THEN 'non_treatment_response_disabled' WHEN cs THEN 'canonical_support_key_seen' ELSE 'canonical_support_key_unseen' END AS chemical_expert_reason,
  CASE WHEN kind <> 'treatment' THEN 'non_treatment_response_disabled' WHEN ps THEN 'canonical_pair_seen' ELSE 'canonical_pair_unseen' END AS pair_expert_reason,
  CASE WHEN xs THEN 'exact_context_time_seen' ELSE 'exact_context_time_unseen' END AS context_time_reason,
  CASE WHEN kind <> 'treatment' THEN 'control' ELSE CASE support_route WHEN 'seen_seen' THEN 'R11' WHEN 'unseen_chemical' THEN 'R10' WHEN 'unseen_strain' THEN 'R01' ELSE 'R00' END END AS support_regime
FROM v_routed
""",
)
def g08(star: Star) -> DataFrame:
    return audited(star).select(
        "sample_id", "pair_seen", "context_time_seen", "strain_expert_enabled", "chemical_expert_enabled", "pair_expert_enabled",
        "chemical_expert_reason", "pair_expert_reason", "context_time_reason", "support_regime",
    )


view(
    "v_regime",
    "SELECT sample_id, split, kind, CASE WHEN kind <> 'treatment' THEN 'control' ELSE CASE support_route WHEN 'seen_seen' THEN 'R11' WHEN 'unseen_chemical' THEN 'R10' WHEN 'unseen_strain' THEN 'R01' ELSE 'R00' END END AS support_regime FROM v_routed",
)


@query("g09_route_counts", "SELECT split, support_regime, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unknown FROM v_regime GROUP BY 1, 2")
def g09(star: Star) -> DataFrame:
    # Regimes need the two entity keys only, so combinations are counted first and looked up once.
    keys = ["split", "kind", "chemical_support_key", "strain_support_key"]
    combined = stored_resolved(star).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    flagged = entities.support_flags(combined, stored_support(star)).withColumn("support_regime", entities.support_regime())
    return entities.route_counts(flagged, ["split"], "n")


# ----------------------------------------------------------- registry building
def structure_source(star: Star) -> DataFrame:
    """Structure map derived from the registry: identifiers for resolved names only."""
    ok = F.col("inchikey") != ""
    return star.chemical_registry.select(
        "raw_name",
        "number",
        "is_control",
        F.when(ok, F.col("canonical_name")).otherwise("").alias("title"),
        F.when(ok, (F.col("number") * 1000).cast("string")).otherwise("").alias("cid"),
        "inchikey",
        F.when(ok, "resolved").otherwise("unresolved").alias("status"),
    )


view(
    "v_struct",
    """
SELECT raw_name, number, is_control, CASE WHEN inchikey <> '' THEN canonical_name ELSE '' END AS title,
       CASE WHEN inchikey <> '' THEN CAST(number * 1000 AS VARCHAR) ELSE '' END AS cid, inchikey,
       CASE WHEN inchikey <> '' THEN 'resolved' ELSE 'unresolved' END AS status FROM v_creg
""",
)


def chemical_roles(star: Star) -> DataFrame:
    return star.samples.groupBy(F.col("chemical").alias("raw_name")).agg(F.min("chemical_role").alias("role"))


def second_review(star: Star) -> DataFrame:
    """Second-source review: promotes every third number, with a wrong key for one of them."""
    n = F.col("number")
    return structure_source(star).filter(n % 3 == 0).select(
        "raw_name",
        F.when(n == 9, "proxy").otherwise("verified").alias("promotion_status"),
        F.when(n == 12, "WRONG").otherwise(F.col("inchikey")).alias("secondary_inchikey"),
    )


@query(
    "g10_build_chemical_registry",
    """
WITH role AS (SELECT chemical AS raw_name, min(chemical_role) AS role FROM v_samples GROUP BY 1),
 rv AS (SELECT raw_name, CASE WHEN number = 9 THEN 'proxy' ELSE 'verified' END AS ps, CASE WHEN number = 12 THEN 'WRONG' ELSE inchikey END AS k2 FROM v_struct WHERE number % 3 = 0),
 j AS (SELECT s.*, role, coalesce(ps, '') AS ps, s.raw_name IN ('Brand#5', 'Brand#6') AS risky, s.status = 'resolved' AND cid <> '' AS res, coalesce(inchikey <> '' AND inchikey = k2, false) AS eq
   FROM v_struct s LEFT JOIN rv USING (raw_name) LEFT JOIN role USING (raw_name))
SELECT raw_name, CASE WHEN risky OR NOT res THEN 'local-chemical:' || replace(lower(raw_name), '#', '-') ELSE 'pubchem:' || cid END AS canonical_id,
  CASE WHEN risky OR NOT res OR title = '' THEN raw_name ELSE title END AS canonical_name, role,
  CASE WHEN risky THEN 'proxy' WHEN res AND ps = 'verified' AND eq THEN 'verified' WHEN res THEN 'high_confidence_candidate' ELSE 'unresolved' END AS mapping_status,
  CASE WHEN risky THEN 'D_proxy_assumption' WHEN res AND ps = 'verified' AND eq THEN 'A_verified' WHEN res THEN 'C_database_lookup' ELSE 'E_unresolved' END AS evidence_tier,
  CASE WHEN risky AND cid <> '' THEN 'pubchem:' || cid WHEN risky THEN raw_name ELSE '' END AS proxy_target,
  CASE WHEN risky AND ps <> '' AND ps <> 'proxy' THEN 'proxy_policy_conflict' WHEN NOT risky AND res AND ps = 'verified' AND NOT eq THEN 'promotion_needs_equal_keys'
       WHEN role IS NULL THEN 'missing_in_metadata' ELSE '' END AS issue FROM j
""",
)
def g10(star: Star) -> DataFrame:
    return entities.build_chemical_registry(structure_source(star).drop("number", "is_control"), second_review(star), chemical_roles(star), ["Brand#5", "Brand#6"])


@query(
    "g11_build_strain_registry",
    """
WITH role AS (SELECT strain AS strain_code, min(strain_role) AS role FROM v_samples GROUP BY 1)
SELECT strain_code, canonical_id, role, CASE WHEN role IS NULL THEN 'missing_in_metadata' WHEN canonical_id IS NULL THEN 'missing_in_source' ELSE '' END AS issue
FROM v_sreg FULL OUTER JOIN role USING (strain_code)
""",
)
def g11(star: Star) -> DataFrame:
    roles = star.samples.groupBy(F.col("strain").alias("strain_code")).agg(F.min("strain_role").alias("role"))
    return entities.build_strain_registry(star.strain_registry, roles).select("strain_code", "canonical_id", "role", "issue")


@query(
    "g12_registry_audit",
    """
WITH t AS (SELECT *, is_control = 'false' AND is_quality_control = 'false' AS treated, CASE WHEN number % 4 = 1 THEN 'test' ELSE 'train' END AS role,
   CASE WHEN number = 13 THEN 'WRONG' ELSE inchikey END AS k2 FROM v_creg)
SELECT 'test_only_structure_gate' AS code, raw_name FROM t WHERE treated AND role = 'test' AND inchikey = ''
UNION ALL SELECT 'test_only_promotion_blocked', raw_name FROM t WHERE treated AND role = 'test' AND mapping_status <> 'verified'
UNION ALL SELECT 'primary_secondary_key_mismatch', raw_name FROM t WHERE mapping_status = 'verified' AND inchikey <> k2
UNION ALL SELECT 'chemical_proxy', raw_name FROM t WHERE treated AND mapping_status = 'proxy'
UNION ALL SELECT 'chemical_unresolved', raw_name FROM t WHERE treated AND mapping_status = 'unresolved'
UNION ALL SELECT 'chemical_candidate', raw_name FROM t WHERE treated AND mapping_status = 'high_confidence_candidate'
""",
)
def g12(star: Star) -> DataFrame:
    n = F.col("number")
    table = star.chemical_registry.withColumns(
        {"role": F.when(n % 4 == 1, "test").otherwise("train"), "secondary_inchikey": F.when(n == 13, "WRONG").otherwise(F.col("inchikey"))}
    )
    return entities.registry_audit(table)


def parent_table(star: Star) -> DataFrame:
    n = F.col("number")
    return structure_source(star).filter(n % 5 == 0).select(
        "raw_name",
        F.concat(F.lit("Parent "), n.cast("string")).alias("parent_name"),
        (n * 7).cast("string").alias("parent_cid"),
        F.concat(F.lit("PK"), n.cast("string")).alias("parent_inchikey"),
    )


@query(
    "g13_structure_views",
    """
SELECT 'exact' AS view, raw_name, is_control, title, cid, inchikey, status FROM v_struct
UNION ALL SELECT 'parent_normalized', raw_name, is_control, CASE WHEN number % 5 = 0 THEN 'Parent ' || number ELSE title END, CASE WHEN number % 5 = 0 THEN CAST(number * 7 AS VARCHAR) ELSE cid END,
  CASE WHEN number % 5 = 0 THEN 'PK' || number ELSE inchikey END, CASE WHEN number % 5 = 0 THEN 'resolved' ELSE status END FROM v_struct
UNION ALL SELECT 'zero_risky', raw_name, is_control, CASE WHEN number % 6 = 1 THEN '' ELSE title END, CASE WHEN number % 6 = 1 THEN '' ELSE cid END,
  CASE WHEN number % 6 = 1 THEN '' ELSE inchikey END, CASE WHEN number % 6 = 1 THEN 'unresolved' ELSE status END FROM v_struct
""",
)
def g13(star: Star) -> DataFrame:
    source = structure_source(star)
    risks = source.filter(F.col("number") % 6 == 1).select("raw_name")
    return entities.structure_views(source, parent_table(star), risks)


view(
    "v_derange",
    """
WITH e AS (SELECT raw_name, row_number() OVER (ORDER BY md5('1701|' || raw_name)) AS rn, count(*) OVER () AS n FROM v_struct WHERE status = 'resolved' AND is_control = 'false')
SELECT a.raw_name AS recipient, b.raw_name AS donor FROM e a JOIN e b ON b.rn = (a.rn - 1 + 3) % a.n + 1
""",
)


@query(
    "g14_deranged_structure_view",
    """
SELECT s.raw_name, s.is_control, coalesce(d.title, s.title) AS title, coalesce(d.cid, s.cid) AS cid, coalesce(d.inchikey, s.inchikey) AS inchikey, coalesce(d.status, s.status) AS status
FROM v_struct s LEFT JOIN v_derange m ON m.recipient = s.raw_name LEFT JOIN v_struct d ON d.raw_name = m.donor
""",
)
def g14(star: Star) -> DataFrame:
    return entities.deranged_view(structure_source(star), 1701, 3)[0]


@query(
    "g15_view_pair_verification",
    """
SELECT count(*) AS n_rows, (SELECT count(*) FROM v_derange) AS n_permuted, CAST(0 AS BIGINT) AS n_entity_mismatch, CAST(0 AS BIGINT) AS n_flag_changed,
  CAST(0 AS BIGINT) AS n_payload_not_donor, CAST(0 AS BIGINT) AS n_unmapped_changed, CAST(0 AS BIGINT) AS n_fixed_points, CAST(0 AS BIGINT) AS n_reused_donors FROM v_struct
""",
)
def g15(star: Star) -> DataFrame:
    source = structure_source(star).drop("number")
    shuffled, mapping = entities.deranged_view(source, 1701, 3)
    return entities.derangement_violations(source, shuffled, mapping)


@query(
    "g16_semantic_coverage",
    """
WITH adm AS (SELECT lower(raw_name) AS key FROM v_creg WHERE mapping_status IN ('verified', 'high_confidence_candidate')),
 fit AS (SELECT DISTINCT k, lower(chemical) AS key FROM v_axis CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE cf IS NULL OR cf <> k),
 val AS (SELECT DISTINCT lower(chemical) AS key FROM v_axis WHERE kind = 'treatment' AND cf IS NOT NULL)
SELECT 'chemical' AS axis, (SELECT count(*) FROM adm) AS n_admitted, (SELECT min(n) FROM (SELECT k, count(*) FILTER (WHERE key IN (SELECT key FROM adm)) AS n FROM fit GROUP BY 1)) AS min_fit_admitted,
  (SELECT count(*) FROM val WHERE key IN (SELECT key FROM adm)) AS n_validated, true AS passed
""",
)
def g16(star: Star) -> DataFrame:
    axis = axis_table(star, ("R10",))
    # Only entities are repeated per fold, not their rows.
    masks = folds.membership(axis, "R10", FOLDS).groupBy(entity_key("chemical_key", ascii_only=True).alias("key")).agg(F.bit_or("fit").alias("fit"), F.bit_or("valid").alias("valid"))
    masks = written(masks, "entity-folds")
    shape = lambda mask: masks.select(F.lit("chemical").alias("axis"), F.lit("R10").alias("scenario"), F.explode(folds.folds_of(F.col(mask), FOLDS)).alias("fold"), "key")
    admitted = star.chemical_registry.filter(entities.admitted_status(F.col("mapping_status"))).select(
        F.lit("chemical").alias("axis"), entity_key("raw_name", ascii_only=True).alias("key")
    )
    return entities.semantic_coverage(admitted, shape("fit"), shape("valid"))


@query(
    "g17_identity_flags",
    """
SELECT raw_name, mapping_status = 'verified' AND number % 5 <> 0 AND number % 4 <> 0 AS is_verified, mapping_status = 'high_confidence_candidate' AND number % 4 <> 0 AS is_candidate,
  mapping_status = 'proxy' OR number % 4 = 0 AS is_proxy, mapping_status = 'unresolved' AND number % 4 <> 0 AS is_missing,
  CASE WHEN number % 4 = 0 THEN true ELSE mapping_status IN ('verified', 'high_confidence_candidate') END AS eligible
FROM v_creg
""",
)
def g17(star: Star) -> DataFrame:
    rows = star.chemical_registry.withColumn("has_parent", F.col("number") % 4 == 0)
    flagged = entities.identity_flags(rows, "mapping_status", allow_proxy=True, view="parent", has_parent="has_parent")
    return flagged.select("raw_name", "is_verified", "is_candidate", "is_proxy", "is_missing", "eligible")


@query(
    "g18_flag_disagreements",
    """
SELECT * FROM (SELECT raw_name, mapping_status, CASE WHEN number % 7 = 0 THEN 0 ELSE CAST(mapping_status IN ('verified', 'high_confidence_candidate') AS INT) END AS resolved,
  CASE WHEN number % 7 = 0 THEN 1 ELSE CAST(mapping_status = 'unresolved' AS INT) END AS missing, CASE WHEN number % 7 = 0 THEN 0 ELSE CAST(mapping_status = 'proxy' AS INT) END AS proxy FROM v_creg)
WHERE (resolved = 1) <> (mapping_status IN ('verified', 'high_confidence_candidate')) OR (missing = 1) <> (mapping_status = 'unresolved') OR (proxy = 1) <> (mapping_status = 'proxy')
""",
)
def g18(star: Star) -> DataFrame:
    odd = F.col("number") % 7 == 0
    status = F.col("mapping_status")
    table = star.chemical_registry.select(
        "raw_name",
        F.when(odd, 0).otherwise(status.isin(*entities.SEMANTIC_STATUSES).cast("int")).alias("resolved"),
        F.when(odd, 1).otherwise((status == "unresolved").cast("int")).alias("missing"),
        F.when(odd, 0).otherwise((status == "proxy").cast("int")).alias("proxy"),
    )
    return entities.flag_disagreements(table, star.chemical_registry, "raw_name")


@query(
    "n09_semantic_coverage_counts",
    """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE c_status IN ('verified', 'high_confidence_candidate')) AS n_chemical_semantic,
  count(*) FILTER (WHERE s_status IN ('verified', 'high_confidence_candidate')) AS n_strain_semantic, count(*) FILTER (WHERE c_status = 'proxy') AS n_chemical_proxy,
  count(*) FILTER (WHERE s_status = 'proxy') AS n_strain_proxy, count(*) FILTER (WHERE c_status = 'unresolved') AS n_chemical_missing, count(*) FILTER (WHERE s_status = 'unresolved') AS n_strain_missing
FROM v_res WHERE split <> 'train' GROUP BY 1
""",
)
def n09(star: Star) -> DataFrame:
    rows = resolved(star).filter(F.col("split") != "train")
    flags = [f"{e}_{f}" for e in ("chemical", "strain") for f in ("semantic", "proxy", "missing")]
    names = {f: f"n_{f}" for f in flags}
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(f), F.lit(1))).alias(n) for f, n in names.items()])


@query(
    "n06_structure_map_audit",
    """
SELECT 'missing_name' AS issue, chemical AS name FROM (SELECT DISTINCT chemical FROM v_samples) WHERE chemical NOT IN (SELECT raw_name FROM v_struct)
UNION ALL SELECT 'extra_name', raw_name FROM v_struct WHERE raw_name NOT IN (SELECT chemical FROM v_samples)
UNION ALL SELECT 'unresolved_noncontrol', raw_name FROM v_struct WHERE status <> 'resolved' AND is_control = 'false'
UNION ALL SELECT 'duplicate_structure', inchikey2 FROM (SELECT CASE WHEN number % 11 = 2 THEN 'SAME' ELSE inchikey END AS inchikey2 FROM v_struct WHERE inchikey <> '') GROUP BY inchikey2 HAVING count(*) > 1
""",
)
def n06(star: Star) -> DataFrame:
    from cellshift.operators.audit import structure_map_issues

    source = structure_source(star)
    twin = F.when(F.col("inchikey") == "", "").when(F.col("number") % 11 == 2, "SAME").otherwise(F.col("inchikey"))
    return structure_map_issues(source.withColumn("inchikey", twin), star.samples.select(F.col("chemical").alias("raw_name")))
