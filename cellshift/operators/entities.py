"""Entity registries: resolution, support, routing, validation and structure views."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions.text import composite_key, entity_key, slug, text_flag
from cellshift.operators.ranking import shifted_donor

# Registry vocabularies.
MAPPING_STATUSES = ("verified", "high_confidence_candidate", "proxy", "unresolved")
EVIDENCE_TIERS = ("A_verified", "B_primary_candidate", "C_database_lookup", "D_proxy_assumption", "E_unresolved")
SEMANTIC_STATUSES = ("verified", "high_confidence_candidate")
REGISTRY_COLUMNS = (
    "canonical_id",
    "canonical_name",
    "mapping_status",
    "evidence_tier",
    "proxy_target",
    "is_control",
    "is_quality_control",
)
STRUCTURE_COLUMNS = ("pubchem_cid", "inchikey", "isomeric_smiles", "canonical_smiles")
ENTITY_KEYS = {"chemical": "raw_name", "strain": "strain_code"}

# Support routes and the regime each one means.
ROUTES = {"seen_seen": "R11", "unseen_chemical": "R10", "unseen_strain": "R01", "unseen_both": "R00"}


# ------------------------------------------------------------------- resolution
def keyed_registry(registry: DataFrame, key_column: str) -> DataFrame:
    """Registry rows under their normalised key (blank keys dropped)."""
    return registry.withColumn("entity_key", entity_key(key_column)).filter(F.col("entity_key") != "")


def resolve(rows: DataFrame, column: str, registry: DataFrame, key_column: str, prefix: str, allow_proxy: bool = True) -> DataFrame:
    """Attach the registry record of a name; names without one are unresolved.

    Distinct names are normalised and looked up; the rows then meet that short table by name.

    Adds ``<prefix>_key``, ``_canonical_id``, ``_status``, ``_tier``,
    ``_proxy_target``, ``_proxy``, ``_missing``, ``_semantic`` and ``_support_key``.
    """
    wanted = ["canonical_id", "mapping_status", "proxy_target"]
    tier = ["evidence_tier"] if "evidence_tier" in registry.columns else []
    flags = [name for name in ("is_control", "is_quality_control") if name in registry.columns]
    record = keyed_registry(registry, key_column).select(
        F.col("entity_key").alias(f"{prefix}_key"), *[F.col(n).alias(f"_r_{n}") for n in wanted + tier + flags]
    )
    names = rows.select(F.col(column).alias("_name")).distinct()
    found = names.withColumn(f"{prefix}_key", entity_key("_name")).join(record, f"{prefix}_key", "left")
    text = lambda name, default="": F.coalesce(F.trim(F.col(f"_r_{name}").cast("string")), F.lit(default))
    status = text("mapping_status", "unresolved")
    proxy = status == "proxy"
    missing = (status == "unresolved") | (F.lit(not allow_proxy) & proxy)
    columns = {
        f"{prefix}_canonical_id": text("canonical_id"),
        f"{prefix}_status": status,
        f"{prefix}_tier": text("evidence_tier", "E_unresolved") if tier else F.lit("E_unresolved"),
        f"{prefix}_proxy_target": text("proxy_target"),
        f"{prefix}_proxy": proxy,
        f"{prefix}_missing": missing,
        f"{prefix}_semantic": ~missing & status.isin(*SEMANTIC_STATUSES),
        f"{prefix}_support_key": support_key(text("canonical_id"), F.col(f"{prefix}_key")),
    }
    for name in flags:
        columns[f"{prefix}_{name}"] = F.coalesce(text_flag(F.col(f"_r_{name}")), F.lit(False))
    table = found.withColumns(columns).drop(*[f"_r_{n}" for n in wanted + tier + flags])
    return rows.join(table, F.col(column).eqNullSafe(F.col("_name")), "left").drop("_name")


def support_key(canonical_id: Column, key: Column) -> Column:
    """Reviewed identity if there is one, else the raw key; proxies keep their own id."""
    return F.coalesce(F.when(canonical_id != "", canonical_id), F.concat(F.lit("raw:"), key))


def with_support_keys(rows: DataFrame, chemical_registry: DataFrame, strain_registry: DataFrame) -> DataFrame:
    """Resolve both entities of every row."""
    both = resolve(rows, "chemical", chemical_registry, "raw_name", "chemical")
    return resolve(both, "strain", strain_registry, "strain_code", "strain")


# ---------------------------------------------------------------------- support
def fit_support(fit: DataFrame) -> DataFrame:
    """Distinct (axis, key) seen in fitting, on raw keys, support keys and canonical ids.

    One pass: the rows are unpivoted and deduplicated map-side.
    """
    entries = []
    for entity in ("chemical", "strain"):
        entries += [
            F.struct(F.lit(f"{entity}_raw").alias("axis"), F.col(f"{entity}_key").alias("key")),
            F.struct(F.lit(f"{entity}_support").alias("axis"), F.col(f"{entity}_support_key").alias("key")),
            F.struct(
                F.lit(f"{entity}_canonical").alias("axis"),
                F.when(~F.col(f"{entity}_missing"), F.col(f"{entity}_canonical_id")).alias("key"),
            ),
        ]
    rows = fit.select(F.explode(F.array(*entries)).alias("e")).select("e.axis", "e.key")
    return rows.filter(F.coalesce(F.col("key"), F.lit("")) != "").distinct()


def context_time_fields(strain: str, chemical: str) -> list[Column | str]:
    return [
        F.col(strain),
        F.col(chemical),
        *[entity_key(name, ascii_only=False) for name in ("medium", "temperature")],
        F.col("pert_time").cast("string"),
        F.col("pert_time_unit"),
    ]


def treatment_support(fit: DataFrame) -> DataFrame:
    """Treatment pair and context-time support with row counts: (axis, key, n)."""
    treated = fit.filter(F.col("kind") == "treatment")
    entries = [
        F.struct(F.lit("raw_pair").alias("axis"), composite_key(["strain_key", "chemical_key"]).alias("key")),
        F.struct(F.lit("pair").alias("axis"), composite_key(["strain_support_key", "chemical_support_key"]).alias("key")),
        F.struct(F.lit("raw_context_time").alias("axis"), composite_key(context_time_fields("strain_key", "chemical_key")).alias("key")),
        F.struct(
            F.lit("context_time").alias("axis"),
            composite_key(context_time_fields("strain_support_key", "chemical_support_key")).alias("key"),
        ),
    ]
    rows = treated.select(F.explode(F.array(*entries)).alias("e")).select("e.axis", "e.key")
    return rows.groupBy("axis", "key").agg(F.count(F.lit(1)).alias("n"))


def _flag(rows: DataFrame, seen: DataFrame, axis: str, key: Column, out: str) -> DataFrame:
    known = seen.filter(F.col("axis") == axis).select(F.col("key").alias("_k"), F.lit(True).alias("_hit"))
    return rows.withColumn("_k", key).join(known, "_k", "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def support_flags(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Seen flags and the four-way route of every resolved row."""
    flagged = _flag(rows, support, "chemical_support", F.col("chemical_support_key"), "chemical_seen")
    flagged = _flag(flagged, support, "strain_support", F.col("strain_support_key"), "strain_seen")
    c, s = F.col("chemical_seen"), F.col("strain_seen")
    route = F.when(c & s, "seen_seen").when(~c & s, "unseen_chemical").when(c & ~s, "unseen_strain").otherwise("unseen_both")
    return flagged.withColumn("support_route", route)


def support_regime() -> Column:
    """Regime of a row with ``kind`` and ``support_route``: control for non-treatments."""
    regime = F.lit(None).cast("string")
    for route, name in ROUTES.items():
        regime = F.when(F.col("support_route") == route, name).otherwise(regime)
    return F.when(F.col("kind") != "treatment", "control").otherwise(regime)


def route_audit(rows: DataFrame, support: DataFrame, pairs: DataFrame) -> DataFrame:
    """Expert gates, reasons and the regime (control for non-treatments) of every row."""
    flagged = support_flags(rows, support)
    flagged = _flag(flagged, pairs, "pair", composite_key(["strain_support_key", "chemical_support_key"]), "pair_seen")
    flagged = _flag(
        flagged, pairs, "context_time", composite_key(context_time_fields("strain_support_key", "chemical_support_key")), "context_time_seen"
    )
    treated = F.col("kind") == "treatment"
    reason = lambda seen, yes, no: F.when(~treated, "non_treatment_response_disabled").when(F.col(seen), yes).otherwise(no)
    key_yes, key_no = "canonical_support_key_seen", "canonical_support_key_unseen"
    return flagged.withColumns(
        {
            "strain_expert_enabled": F.col("strain_seen"),
            "chemical_expert_enabled": treated & F.col("chemical_seen"),
            "pair_expert_enabled": treated & F.col("pair_seen"),
            "strain_expert_reason": F.when(F.col("strain_seen"), key_yes).otherwise(key_no),
            "chemical_expert_reason": reason("chemical_seen", key_yes, key_no),
            "pair_expert_reason": reason("pair_seen", "canonical_pair_seen", "canonical_pair_unseen"),
            "context_time_reason": F.when(F.col("context_time_seen"), "exact_context_time_seen").otherwise("exact_context_time_unseen"),
            "support_regime": support_regime(),
        }
    )


def route_counts(audit: DataFrame, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Rows per regime with the number of rows that carry no known regime (must be zero); ``rows`` names a count column of grouped input."""
    known = F.coalesce(F.col("support_regime").isin("control", *ROUTES.values()), F.lit(False))
    n = F.col(rows) if rows else F.lit(1).cast("bigint")
    return audit.groupBy(*by, "support_regime").agg(F.sum(n).alias("n_rows"), F.sum(F.when(known, F.lit(0).cast("bigint")).otherwise(n)).alias("n_unknown"))


# ------------------------------------------------------------------- validation
def registry_issues(registry: DataFrame, key_column: str, required: DataFrame | None = None, require_verified: bool = False) -> DataFrame:
    """Issue table (severity, code, key) of a registry; errors block, warnings do not.

    Row rules are evaluated in one scan as an array of issues per row; only the
    collision and required-entity rules need their own aggregation.
    """
    absent = [name for name in (key_column, *REGISTRY_COLUMNS) if name not in registry.columns]
    if absent:
        spark = registry.sparkSession
        return spark.range(1).select(
            F.lit("error").alias("severity"), F.lit("missing_columns").alias("code"), F.lit("|".join(sorted(absent))).alias("key")
        )
    trimmed = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    status, target, identity = trimmed("mapping_status"), trimmed("proxy_target"), trimmed("canonical_id")
    structures = [name for name in STRUCTURE_COLUMNS if name in registry.columns]
    has_structure = reduce(lambda a, b: a | b, [trimmed(name) != "" for name in structures], F.lit(False))
    control, quality = text_flag("is_control"), text_flag("is_quality_control")
    unverified = status.isin("high_confidence_candidate", "proxy", "unresolved")
    rules: list[tuple[str, str, Column]] = [
        ("error", "blank_key", F.col("_key") == ""),
        ("error", "invalid_mapping_status", ~status.isin(*MAPPING_STATUSES)),
        ("error", "invalid_evidence_tier", ~trimmed("evidence_tier").isin(*EVIDENCE_TIERS)),
        ("error", "blank_canonical_id", identity == ""),
        ("error", "proxy_without_target", (status == "proxy") & (target == "")),
        ("error", "proxy_collapsed_to_target", (status == "proxy") & (identity != "") & (identity == target)),
        ("warning", "unexpected_proxy_target", (status != "proxy") & (target != "")),
        ("error", "invalid_boolean", control.isNull() | quality.isNull()),
        ("error", "control_qc_conflict", F.coalesce(control & quality, F.lit(False))),
    ]
    if key_column == ENTITY_KEYS["chemical"]:
        rules.append(("error", "unresolved_has_structure", (status == "unresolved") & has_structure))
    if require_verified:
        rules.append(("error", "not_verified", status != "verified"))
    else:
        rules.append(("warning", "mapping_not_verified", unverified))
    keyed = registry.withColumn("_key", entity_key(key_column))
    found = F.array_compact(
        F.array(*[F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, hit in rules])
    )
    issues = keyed.select(F.col("_key").alias("key"), F.explode(found).alias("i")).select("i.severity", "i.code", "key")
    collisions = (
        keyed.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("key") != ""))
        .select(F.lit("error").alias("severity"), F.lit("normalized_key_collision").alias("code"), "key")
    )
    issues = issues.unionByName(collisions)
    if required is not None:
        names = required.select(entity_key(required.columns[0]).alias("key")).filter(F.col("key") != "").distinct()
        missing = names.join(keyed.select(F.col("_key").alias("key")), "key", "left_anti")
        issues = issues.unionByName(
            missing.select(F.lit("error").alias("severity"), F.lit("missing_required_entities").alias("code"), "key")
        )
    return issues


# ----------------------------------------------------------- registry building
def build_chemical_registry(
    source: DataFrame, review: DataFrame, roles: DataFrame, risky: Iterable[str], namespace: str = "local"
) -> DataFrame:
    """Join structure map, second-source review and roles; assign status and evidence tier.

    ``source(raw_name, title, cid, inchikey, status)``, ``review(raw_name,
    promotion_status, secondary_inchikey)``, ``roles(raw_name, role)``.  A
    ``verified`` promotion needs equal keys; a mismatch stays visible in the
    ``issue`` column instead of being promoted.
    """
    joined = source.join(review, "raw_name", "left").join(roles, "raw_name", "left")
    cid, promotion = F.coalesce(F.col("cid"), F.lit("")), F.coalesce(F.col("promotion_status"), F.lit(""))
    is_risky = F.col("raw_name").isin(*risky)
    resolved = (F.col("status") == "resolved") & (cid != "")
    keys_equal = (F.coalesce(F.col("inchikey"), F.lit("")) != "") & (F.col("inchikey") == F.col("secondary_inchikey"))
    verified = resolved & (promotion == "verified") & F.coalesce(keys_equal, F.lit(False))
    status = (
        F.when(is_risky, "proxy").when(verified, "verified").when(resolved, "high_confidence_candidate").otherwise("unresolved")
    )
    local = F.concat(F.lit(f"{namespace}-chemical:"), slug("raw_name", "-"))
    pubchem = F.concat(F.lit("pubchem:"), cid)
    return joined.select(
        "raw_name",
        F.when(is_risky | ~resolved, local).otherwise(pubchem).alias("canonical_id"),
        F.when(is_risky | ~resolved | (F.coalesce("title", F.lit("")) == ""), F.col("raw_name")).otherwise(F.col("title")).alias("canonical_name"),
        F.col("role"),
        status.alias("mapping_status"),
        F.when(is_risky, "D_proxy_assumption").when(verified, "A_verified").when(resolved, "C_database_lookup").otherwise("E_unresolved").alias("evidence_tier"),
        F.when(is_risky & (cid != ""), pubchem).when(is_risky, F.col("raw_name")).otherwise("").alias("proxy_target"),
        F.when(is_risky & (promotion != "") & (promotion != "proxy"), "proxy_policy_conflict")
        .when(~is_risky & resolved & (promotion == "verified") & ~F.coalesce(keys_equal, F.lit(False)), "promotion_needs_equal_keys")
        .when(F.col("role").isNull(), "missing_in_metadata")
        .otherwise("")
        .alias("issue"),
    )


def build_strain_registry(source: DataFrame, roles: DataFrame) -> DataFrame:
    """Full outer join of strain source and metadata roles; gaps on either side are named."""
    return source.join(roles, "strain_code", "full_outer").withColumn(
        "issue",
        F.when(F.col("role").isNull(), "missing_in_metadata").when(F.col("canonical_id").isNull(), "missing_in_source").otherwise(""),
    )


def registry_audit(registry: DataFrame) -> DataFrame:
    """Rule hits of a chemical registry with role and evidence: (code, raw_name)."""
    treated = ~F.coalesce(text_flag("is_control"), F.lit(False)) & ~F.coalesce(text_flag("is_quality_control"), F.lit(False))
    test_only = treated & (F.col("role") == "test")
    status = F.col("mapping_status")
    rules = [
        ("test_only_structure_gate", test_only & (F.coalesce(F.col("inchikey"), F.lit("")) == "")),
        ("test_only_promotion_blocked", test_only & (status != "verified")),
        ("evidence_tier_not_A_verified", (status == "verified") & (F.col("evidence_tier") != "A_verified")),
        ("primary_secondary_key_mismatch", (status == "verified") & ~F.col("inchikey").eqNullSafe(F.col("secondary_inchikey"))),
        ("chemical_proxy", treated & (status == "proxy")),
        ("chemical_unresolved", treated & (status == "unresolved")),
        ("chemical_candidate", treated & (status == "high_confidence_candidate")),
    ]
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return registry.select(F.explode(hits).alias("code"), "raw_name")


# --------------------------------------------------------------- structure views
PAYLOAD = ("title", "cid", "inchikey", "status")


def structure_views(exact: DataFrame, parents: DataFrame, risks: DataFrame) -> DataFrame:
    """Exact, parent-normalised and zero-risky views stacked with a ``view`` column.

    ``parents(raw_name, parent_name, parent_cid, parent_inchikey)`` overrides the
    payload, ``risks(raw_name)`` blanks it.
    """
    base = exact.select("raw_name", "is_control", *PAYLOAD)
    override = parents.select("raw_name", "parent_name", "parent_cid", "parent_inchikey", F.lit(True).alias("_p"))
    marked = base.join(override, "raw_name", "left").join(risks.select("raw_name", F.lit(True).alias("_z")).distinct(), "raw_name", "left")
    p, z = F.coalesce("_p", F.lit(False)), F.coalesce("_z", F.lit(False))
    plain = F.struct(F.lit("exact").alias("view"), *[F.col(name).alias(name) for name in PAYLOAD])
    parent = F.struct(
        F.lit("parent_normalized").alias("view"),
        F.when(p, F.col("parent_name")).otherwise(F.col("title")).alias("title"),
        F.when(p, F.col("parent_cid")).otherwise(F.col("cid")).alias("cid"),
        F.when(p, F.col("parent_inchikey")).otherwise(F.col("inchikey")).alias("inchikey"),
        F.when(p, "resolved").otherwise(F.col("status")).alias("status"),
    )
    zero = F.struct(
        F.lit("zero_risky").alias("view"),
        *[F.when(z, "").otherwise(F.col(name)).alias(name) for name in ("title", "cid", "inchikey")],
        F.when(z, "unresolved").otherwise(F.col("status")).alias("status"),
    )
    stacked = marked.select("raw_name", "is_control", F.explode(F.array(plain, parent, zero)).alias("v"))
    return stacked.select("v.view", "raw_name", "is_control", *[F.col(f"v.{name}").alias(name) for name in PAYLOAD])


def deranged_view(exact: DataFrame, seed: object = 1701, shift: int = 1) -> tuple[DataFrame, DataFrame]:
    """Negative control: payloads move among resolved treatments; returns (view, recipient-donor map)."""
    eligible = exact.filter(
        (F.col("status") == "resolved") & ~F.coalesce(text_flag("is_control"), F.lit(False)) & (F.coalesce("inchikey", F.lit("")) != "")
    )
    mapping = shifted_donor(eligible, "raw_name", seed, shift)
    donors = exact.select(F.col("raw_name").alias("donor"), *[F.col(name).alias(f"_d_{name}") for name in PAYLOAD])
    moved = mapping.join(donors, "donor").withColumnRenamed("recipient", "raw_name")
    joined = exact.join(moved, "raw_name", "left")
    view = joined.select(
        "raw_name",
        "is_control",
        *[F.when(F.col("donor").isNotNull(), F.col(f"_d_{name}")).otherwise(F.col(name)).alias(name) for name in PAYLOAD],
    )
    return view, mapping


def derangement_violations(real: DataFrame, shuffled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rule counts for a real/shuffled pair: identity, bijection, no fixed point, payload equals donor."""
    payload = F.struct(*[F.coalesce(F.col(name), F.lit("")) for name in PAYLOAD])
    r = real.select("raw_name", F.col("is_control").alias("_rc"), payload.alias("_rp"))
    s = shuffled.select("raw_name", F.col("is_control").alias("_sc"), payload.alias("_sp"))
    both = r.join(s, "raw_name", "full_outer").join(mapping.withColumnRenamed("recipient", "raw_name"), "raw_name", "left")
    donors = r.select(F.col("raw_name").alias("donor"), F.col("_rp").alias("_dp"))
    checked = both.join(donors, "donor", "left")
    count = lambda rule, name: F.count(F.when(rule, F.lit(1))).alias(name)
    rows = checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("donor").alias("n_permuted"),
        count(F.col("_rp").isNull() | F.col("_sp").isNull(), "n_entity_mismatch"),
        count(~F.col("_rc").eqNullSafe(F.col("_sc")), "n_flag_changed"),
        count(F.col("donor").isNotNull() & (F.col("_sp") != F.col("_dp")), "n_payload_not_donor"),
        count(F.col("donor").isNull() & (F.col("_sp") != F.col("_rp")), "n_unmapped_changed"),
        count(F.col("donor") == F.col("raw_name"), "n_fixed_points"),
        (F.count("donor") - F.countDistinct("donor")).alias("n_reused_donors"),
    )
    return rows


# ----------------------------------------------------------- semantic admission
def admitted_status(status: Column, policy: str = "candidate", allow_proxy: bool = False) -> Column:
    """Whether a mapping status may feed semantic features under a policy."""
    allowed = ["verified"] if policy == "verified_only" else list(SEMANTIC_STATUSES)
    return status.isin(*(allowed + (["proxy"] if allow_proxy else [])))


def identity_flags(rows: DataFrame, status: str, policy: str = "candidate", allow_proxy: bool = False, view: str = "exact", has_parent: str | None = None, has_risk: str | None = None) -> DataFrame:
    """Verified/candidate/proxy/missing flags and the eligibility gate of each row."""
    state = F.col(status)
    parent = F.coalesce(F.col(has_parent), F.lit(False)) if has_parent else F.lit(False)
    risk = F.coalesce(F.col(has_risk), F.lit(False)) if has_risk else F.lit(False)
    shown_as_parent = F.lit(view == "parent") & parent
    is_proxy = (state == "proxy") | shown_as_parent
    exact_ok = admitted_status(state, policy, False) & ~shown_as_parent
    proxy_ok = F.lit(allow_proxy) & (shown_as_parent if view == "parent" else (state == "proxy") & F.lit(has_parent is None))
    gate = F.lit(view != "zero") & ~(F.lit(view == "zero_risky") & risk) & (exact_ok | proxy_ok)
    return rows.withColumns(
        {
            "is_verified": (state == "verified") & ~is_proxy,
            "is_candidate": (state == "high_confidence_candidate") & ~is_proxy,
            "is_proxy": is_proxy,
            "is_missing": ~is_proxy & ~state.isin("verified", "high_confidence_candidate"),
            "eligible": gate,
        }
    )


def semantic_coverage(
    admitted: DataFrame, fit_keys: DataFrame, valid_keys: DataFrame, by: Sequence[str] = ("axis",), fold: Sequence[str] = ("scenario", "fold"), minimum: int = 2
) -> DataFrame:
    """Per axis: admitted entities, smallest fit count over folds, validated entities and the pass rule.

    Inputs: ``admitted(axis, key)``, ``fit_keys``/``valid_keys(axis, scenario, fold, key)``.
    """
    keys = [*by, "key"]
    total = admitted.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_admitted"))
    fit = fit_keys.select(*by, *fold, "key").distinct()
    marked = fit.join(admitted.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    per_fold = marked.groupBy(*by, *fold).agg(F.count("_hit").alias("_n"))
    smallest = per_fold.groupBy(*by).agg(F.min("_n").alias("min_fit_admitted"))
    valid = valid_keys.select(*keys).distinct().join(admitted.select(*keys).distinct(), keys, "left_semi")
    seen = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("n_validated"))
    joined = total.join(smallest, list(by), "left").join(seen, list(by), "left")
    columns = {name: F.coalesce(name, F.lit(0)) for name in ("min_fit_admitted", "n_validated")}
    return joined.withColumns(columns).withColumn(
        "passed", (F.col("n_admitted") >= minimum) & (F.col("min_fit_admitted") >= minimum) & (F.col("n_validated") >= minimum)
    )


def flag_disagreements(features: DataFrame, registry: DataFrame, key_column: str) -> DataFrame:
    """Feature-table status flags that contradict the registry (resolved, missing, proxy)."""
    record = keyed_registry(registry, key_column).select("entity_key", "mapping_status")
    rows = features.withColumn("entity_key", entity_key(key_column)).join(record, "entity_key", "left")
    status = F.coalesce(F.col("mapping_status"), F.lit("unresolved"))
    resolved, proxy = status.isin(*SEMANTIC_STATUSES), status == "proxy"
    want = {"resolved": resolved, "missing": ~(resolved | proxy), "proxy": proxy}
    differs = reduce(lambda a, b: a | b, [F.abs(F.col(n).cast("double") - w.cast("double")) > 0.5 for n, w in want.items()])
    return rows.filter(differs).select(key_column, status.alias("mapping_status"), *want)
