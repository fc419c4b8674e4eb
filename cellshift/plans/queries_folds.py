"""Registered queries: leave-one-out, shrinkage, winners and hold-out folds (groups E, F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.operators import entities, folds, priors
from cellshift.operators.grids import grid_with_values
from cellshift.operators.ranking import best_per_group
from cellshift.plans.queries_metrics import rounded, split_scores
from cellshift.plans.registry import query, view
from cellshift.plans.sqltext import digest_sum
from cellshift.plans.study import FOLDS, SCENARIO_SEEDS, Study
from cellshift.session import written
from cellshift.sources.star import Star

# ------------------------------------------------------------ leave-one-out etc.
view(
    "v_loo",
    """
WITH g AS (SELECT t.sample_id, t.strain, p.protein, y.y FROM v_train t CROSS JOIN (SELECT DISTINCT protein FROM v_y) p
           LEFT JOIN v_y y ON y.sample_id = t.sample_id AND y.protein = p.protein),
 w AS (SELECT *, sum(y) OVER (PARTITION BY protein) AS gs, count(y) OVER (PARTITION BY protein) AS gn,
       sum(y) OVER (PARTITION BY strain, protein) AS ss, count(y) OVER (PARTITION BY strain, protein) AS sn FROM g),
 e AS (SELECT *, CASE WHEN gn - CASE WHEN y IS NULL THEN 0 ELSE 1 END > 0 THEN (gs - coalesce(y, 0)) / (gn - CASE WHEN y IS NULL THEN 0 ELSE 1 END)
       ELSE coalesce(gs / gn, 0) END AS global_loo FROM w)
SELECT sample_id, strain, protein, y, global_loo,
       CASE WHEN sn - CASE WHEN y IS NULL THEN 0 ELSE 1 END > 0 THEN (ss - coalesce(y, 0)) / (sn - CASE WHEN y IS NULL THEN 0 ELSE 1 END) ELSE global_loo END AS strain_loo
FROM e
""",
)


def _loo(star: Star) -> DataFrame:
    grid = grid_with_values(star.train.select("sample_id", "strain"), star.log2)
    return priors.leave_one_out_means(grid, "y", "strain", "strain_loo", "global_loo")


@query("e01_leave_one_out_global", "SELECT sample_id, protein, r6(global_loo) AS global_loo FROM v_loo")
def e01(star: Star) -> DataFrame:
    return _loo(star).select("sample_id", "protein", r6("global_loo").alias("global_loo"))


@query("e02_leave_one_out_strain", "SELECT sample_id, protein, r6(strain_loo) AS strain_loo FROM v_loo")
def e02(star: Star) -> DataFrame:
    return _loo(star).select("sample_id", "protein", r6("strain_loo").alias("strain_loo"))


@query(
    "e03_leave_one_out_chemical_delta",
    """
WITH k AS (SELECT sample_id, chemical FROM v_train WHERE kind = 'treatment' AND match_key IN (SELECT match_key FROM v_train WHERE kind = 'control')),
 g AS (SELECT k.sample_id, k.chemical, p.protein, d.t FROM k CROSS JOIN (SELECT DISTINCT protein FROM v_y) p
       LEFT JOIN v_tdelta d ON d.sample_id = k.sample_id AND d.protein = p.protein),
 w AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS o, sum(t) OVER (PARTITION BY protein) AS gs, count(t) OVER (PARTITION BY protein) AS gn,
       sum(t) OVER (PARTITION BY chemical, protein) AS cs, count(t) OVER (PARTITION BY chemical, protein) AS cn FROM g),
 e AS (SELECT *, CASE WHEN gn - o > 0 THEN (gs - coalesce(t, 0)) / (gn - o) ELSE coalesce(gs / gn, 0) END AS gl FROM w)
SELECT sample_id, protein, r6(CASE WHEN cn - o > 0 THEN (cs - coalesce(t, 0)) / (cn - o) ELSE gl END) AS chemical_loo FROM e
""",
)
def e03(star: Star) -> DataFrame:
    from cellshift.operators.controls import match_flags

    study = Study(star)
    train_treated = star.train.filter(F.col("kind") == "treatment")
    usable = match_flags(train_treated, star.train).filter("has_exact_match").select("sample_id", "chemical")
    # Proteins come from the measured matrix, not only from cells with a delta.
    from cellshift.operators.grids import dense_grid

    grid = dense_grid(usable, star.log2.select("protein")).join(
        study.train_deltas.select("sample_id", "protein", "truth_delta"), ["sample_id", "protein"], "left"
    )
    out = priors.leave_one_out_means(grid, "truth_delta", "chemical", "chemical_loo")
    return out.select("sample_id", "protein", r6("chemical_loo").alias("chemical_loo"))


_PRIOR = """
WITH g AS (SELECT protein, sum(t) AS gs, count(t) AS gn FROM v_tdelta GROUP BY 1),
 c AS (SELECT chemical, protein, sum(t) AS cs, count(t) AS cn FROM v_tdelta GROUP BY 1, 2),
 s AS (SELECT strain, protein, sum(t) AS ss, count(t) AS sn FROM v_tdelta GROUP BY 1, 2)
"""


@query(
    "e04_shrinkage_prior",
    _PRIOR
    + """
SELECT d.sample_id, d.protein, r6(coalesce(cn / (cn + 5.0) * (cs / cn - gs / gn), 0) + coalesce(sn / (sn + 5.0) * (ss / sn - gs / gn), 0)) AS prior
FROM v_delta d LEFT JOIN g ON g.protein = d.protein LEFT JOIN c ON c.chemical = d.chemical AND c.protein = d.protein
LEFT JOIN s ON s.strain = d.strain AND s.protein = d.protein WHERE d.split <> 'train'
""",
)
def e04(star: Star) -> DataFrame:
    study = Study(star)
    requests = study.deltas.filter(F.col("split") != "train").select("sample_id", "protein", "chemical", "strain")
    out = priors.shrinkage_prior(requests, study.train_deltas, ["chemical", "strain"], 5.0)
    return out.select("sample_id", "protein", r6("prior").alias("prior"))


@query(
    "e04_shrinkage_prior_leave_one_out",
    _PRIOR
    + """
SELECT sample_id, protein, r6(CASE WHEN cn - 1 > 0 THEN (cn - 1) / (cn - 1 + 5.0) * ((cs - t) / (cn - 1) - coalesce((gs - t) / nullif(gn - 1, 0), 0)) ELSE 0 END) AS prior
FROM v_tdelta d JOIN g USING (protein) JOIN c USING (chemical, protein)
""",
)
def e04_loo(star: Star) -> DataFrame:
    deltas = Study(star).train_deltas
    requests = deltas.select("sample_id", "protein", "chemical", F.col("truth_delta").alias("own"))
    out = priors.shrinkage_prior(requests, deltas, ["chemical"], 5.0, own="own")
    return out.select("sample_id", "protein", r6("prior").alias("prior"))


@query(
    "e05_context_extent",
    "SELECT strain, chemical, medium, temperature, max(pert_time) AS max_time, count(DISTINCT pert_time) AS n_times FROM v_samples WHERE kind = 'treatment' GROUP BY 1, 2, 3, 4",
)
def e05(star: Star) -> DataFrame:
    return priors.context_extent(star.treatments, ["strain", "chemical", "medium", "temperature"], "pert_time")


@query(
    "e06_latest_in_context",
    "SELECT sample_id, pert_time = max(pert_time) OVER (PARTITION BY strain, chemical, medium, temperature) AS is_latest FROM v_samples WHERE kind = 'treatment'",
)
def e06(star: Star) -> DataFrame:
    flagged = priors.latest_flag(star.treatments, ["strain", "chemical", "medium", "temperature"], "pert_time")
    return flagged.select("sample_id", "is_latest")


@query(
    "e07_guarded_winner",
    """
SELECT split, model, fc_pcc, high_effect_f1 FROM v_split_scores WHERE high_effect_f1 > 0.05
QUALIFY row_number() OVER (PARTITION BY split ORDER BY fc_pcc DESC, model) = 1
""",
)
def e07(star: Star) -> DataFrame:
    # Only what the winner shows: the distinct samples of the report would be kept with all its sums.
    table = split_scores(Study(star)).select("split", "model", "fc_pcc", "high_effect_f1").filter(F.col("high_effect_f1") > 0.05)
    return best_per_group(table.withColumn("order_key", F.substring("model", 2, 9).cast("int")), ["split"], [("fc_pcc", True), ("order_key", False)]).select(
        "split", "model", "fc_pcc", "high_effect_f1"
    )


@query(
    "e08_delta_to_baseline_row",
    """
SELECT x.model, x.split, r6(x.fc_pcc - b.fc_pcc) AS fc_pcc_delta, r6(x.high_effect_pcc - b.high_effect_pcc) AS high_effect_pcc_delta
FROM v_split_scores x JOIN v_split_scores b ON b.split = x.split AND b.model = 'm0'
""",
)
def e08(star: Star) -> DataFrame:
    table = split_scores(Study(star)).select("model", "split", "fc_pcc", "high_effect_pcc")
    out = priors.against_baseline(table, ["split"], F.col("model") == "m0", ["fc_pcc", "high_effect_pcc"])
    return rounded(out.select("model", "split", "fc_pcc_delta", "high_effect_pcc_delta"), ["model", "split"])


@query(
    "e09_first_row_per_group",
    "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1",
)
def e09(star: Star) -> DataFrame:
    return best_per_group(star.table("part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], [("p_partkey", False)])


# ------------------------------------------------------------------------ folds
view(
    "v_keys",
    """
SELECT *, strain || chr(31) || chemical AS pair_key,
       concat_ws(chr(31), strain, chemical, medium, temperature, pert_time_unit) AS context_key,
       concat_ws(chr(31), strain, chemical, medium, temperature, CAST(pert_time AS VARCHAR), pert_time_unit) AS time_key
FROM v_train
""",
)


def _snake(key: str, source: str, seed: int) -> str:
    return f"""
SELECT {key}, n, CASE WHEN ((rn - 1) // 4) % 2 = 0 THEN (rn - 1) % 4 ELSE 3 - (rn - 1) % 4 END AS fold
FROM (SELECT {key}, n, row_number() OVER (ORDER BY n DESC, md5('{seed}|' || {key}), {key}) AS rn
      FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY 1))"""


view("v_tfold", _snake("time_key", "(SELECT * FROM v_keys WHERE kind = 'treatment')", 307))
view(
    "v_rtfold",
    """
SELECT context_key, time_key, n, (rn - 1 + CAST('0x' || substr(md5('353|' || context_key), 1, 8) AS BIGINT)) % 4 AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY context_key ORDER BY n DESC, md5('353|' || time_key)) AS rn, count(*) OVER (PARTITION BY context_key) AS g
      FROM (SELECT context_key, time_key, count(*) AS n FROM v_keys WHERE kind = 'treatment' GROUP BY 1, 2)) WHERE g >= 2
""",
)
view(
    "v_extent",
    "SELECT context_key, max(pert_time) AS max_time FROM v_keys WHERE kind = 'treatment' GROUP BY 1 HAVING count(DISTINCT pert_time) >= 2",
)
view("v_ffold", _snake("context_key", "(SELECT * FROM v_keys WHERE kind = 'treatment' AND context_key IN (SELECT context_key FROM v_extent))", 401))
view("v_pfold", _snake("plate", "v_keys", 503))
view(
    "v_axis",
    """
SELECT k.*, c.fold AS cf, s.fold AS sf, t.fold AS tf, r.fold AS rf, f.fold AS ff, e.max_time, p.fold AS pf
FROM v_keys k LEFT JOIN v_cfold c ON c.chemical = k.chemical LEFT JOIN v_sfold s ON s.strain = k.strain
LEFT JOIN v_tfold t ON t.time_key = k.time_key LEFT JOIN v_rtfold r ON r.time_key = k.time_key
LEFT JOIN v_ffold f ON f.context_key = k.context_key LEFT JOIN v_extent e ON e.context_key = k.context_key LEFT JOIN v_pfold p ON p.plate = k.plate
""",
)

# Per scenario: number of folds, held-out test of a row in fold k, candidate test, kept out of fit.
_SQL_RULES = {
    "S1": (4, "cf = k"),
    "R10": (4, "cf = k"),
    "S2": (4, "sf = k"),
    "R01": (4, "sf = k"),
    "S3": (16, "sf = k // 4 AND cf = k % 4"),
    "R00": (16, "sf = k // 4 AND cf = k % 4"),
    "R11": (16, "sf = k // 4 AND cf = k % 4"),
    "time": (4, "tf = k"),
    "RT": (4, "rf = k"),
    "time_forward": (4, "ff = k"),
    "plate": (4, "pf = k"),
}
_SQL_EXCLUDED = {
    "S3": "coalesce(sf = k // 4, false) OR coalesce(cf = k % 4, false)",
    "R00": "coalesce(sf = k // 4, false) OR coalesce(cf = k % 4, false)",
    "time_forward": "coalesce(ff = k AND kind = 'treatment' AND pert_time = max_time, false)",
}
_SQL_ELIGIBLE = {
    "S1": "strain_seen",
    "R10": "strain_seen",
    "S2": "chemical_seen",
    "R01": "chemical_seen",
    "S3": "true",
    "R00": "true",
    "R11": "strain_seen AND chemical_seen",
    "time": "context_seen AND time_seen",
    "RT": "context_seen AND time_seen AND pair_seen",
    "time_forward": "pert_time = max_time",
    "plate": "true",
}


def _assignment_sql(scenario: str) -> str:
    """Fit sets spelled out row by row, then membership tests against them."""
    n, held = _SQL_RULES[scenario]
    out = _SQL_EXCLUDED.get(scenario, f"coalesce({held}, false)")
    treated = "true" if scenario == "plate" else "kind = 'treatment'"
    seen = lambda key: f"EXISTS (SELECT 1 FROM fit_{key} f WHERE f.k = c.k AND f.{key} = c.{key})"
    keys = ["strain", "chemical", "pair_key", "time_key", "context_key", "pert_time"]
    sets = ",\n ".join(f"fit_{key} AS (SELECT DISTINCT k, {key} FROM fit)" for key in keys)
    reason = "not_context_max_time" if scenario == "time_forward" else "would_mix_additional_OOD_axis"
    return f"""
WITH fit AS (SELECT a.*, k FROM v_axis a CROSS JOIN (SELECT unnest(range({n})) AS k) WHERE NOT ({out})),
 {sets},
 cand AS (SELECT a.*, k FROM v_axis a CROSS JOIN (SELECT unnest(range({n})) AS k) WHERE {treated} AND {held}),
 flags AS (SELECT *, {seen('strain')} AS strain_seen, {seen('chemical')} AS chemical_seen, {seen('pair_key')} AS pair_seen,
   {seen('time_key')} AS time_group_seen, {seen('context_key')} AS context_seen, {seen('pert_time')} AS time_seen FROM cand c)
SELECT '{scenario}' AS scenario, k AS fold, sample_id, strain_seen, chemical_seen, pair_seen, time_group_seen, {_SQL_ELIGIBLE[scenario]} AS eligible,
       CASE WHEN {_SQL_ELIGIBLE[scenario]} THEN '' ELSE '{reason}' END AS exclusion_reason
FROM flags
"""


AXES = {
    "S1": ("chemical",),
    "R10": ("chemical",),
    "S2": ("strain",),
    "R01": ("strain",),
    "S3": ("chemical", "strain"),
    "R00": ("chemical", "strain"),
    "R11": ("chemical", "strain"),
    "time": ("time",),
    "RT": ("nested_time",),
    "time_forward": ("forward",),
    "plate": ("plate",),
}
ASSIGNMENT_COLUMNS = ["scenario", "fold", "sample_id", "strain_seen", "chemical_seen", "pair_seen", "time_group_seen", "eligible", "exclusion_reason"]


def axis_table(star: Star, scenarios: tuple[str, ...]) -> DataFrame:
    """Train rows with the fold columns a set of scenarios needs, written once.

    Every support flag aggregates this metadata-sized table again, so it is
    stored instead of re-deriving the fold maps for each of them.
    """
    axes = sorted({axis for scenario in scenarios for axis in AXES[scenario]})
    keep = ["sample_id", "strain", "chemical", "medium", "temperature", "pert_time", "pert_time_unit", "plate", "kind"]
    return written(folds.with_axis_folds(star.train.select(*keep), FOLDS, SCENARIO_SEEDS, axes=axes), "axis")


def _register_scenario(number: int, scenario: str) -> None:
    @query(f"f{number:02d}_holdout_{scenario.lower()}", _assignment_sql(scenario))
    def run(star: Star) -> DataFrame:
        axis = axis_table(star, (scenario,))
        return folds.assignment_table(axis, scenario, FOLDS).select(*ASSIGNMENT_COLUMNS)


for _number, _scenario in ((6, "S1"), (6, "R10"), (7, "S2"), (7, "R01"), (8, "S3"), (8, "R00"), (9, "R11"), (10, "time"), (10, "RT"), (11, "time_forward"), (12, "plate")):
    _register_scenario(_number, _scenario)


@query("f01_balanced_folds_snake", _snake("time_key", "(SELECT * FROM v_keys WHERE kind = 'treatment')", 307))
def f01(star: Star) -> DataFrame:
    keyed = folds.with_fold_keys(star.train.filter(F.col("kind") == "treatment"))
    return folds.balanced_group_folds(keyed, "time_key", FOLDS, 307)


@query("f01_balanced_folds_greedy")
def f01_greedy(star: Star) -> DataFrame:
    keyed = folds.with_fold_keys(star.train.filter(F.col("kind") == "treatment"))
    return folds.greedy_group_folds(keyed, "time_key", FOLDS, 307)


@query("f02_nested_group_folds", "SELECT context_key, time_key, n, fold FROM v_rtfold")
def f02(star: Star) -> DataFrame:
    keyed = folds.with_fold_keys(star.train.filter(F.col("kind") == "treatment"))
    return folds.nested_group_folds(keyed, "context_key", "time_key", FOLDS, 353)


@query(
    "f03_round_robin_folds",
    "SELECT match_key, (row_number() OVER (ORDER BY md5('17|' || match_key)) - 1) % 4 AS fold FROM (SELECT DISTINCT match_key FROM v_samples)",
)
def f03(star: Star) -> DataFrame:
    return folds.round_robin_folds(star.samples, "match_key", FOLDS, 17)


@query("f04_composite_keys", "SELECT sample_id, pair_key, context_key, time_key FROM v_keys")
def f04(star: Star) -> DataFrame:
    return folds.with_fold_keys(star.train).select("sample_id", "pair_key", "context_key", "time_key")


@query(
    "f05_canonical_grouping_identity",
    """
SELECT s.sample_id, coalesce(r.canonical_id, 'raw:' || lower(s.strain)) AS strain_key, coalesce(c.canonical_id, 'raw:' || lower(s.chemical)) AS chemical_key
FROM v_train s LEFT JOIN v_sreg r ON lower(r.strain_code) = lower(s.strain) LEFT JOIN v_creg c ON lower(c.raw_name) = lower(s.chemical)
""",
)
def f05(star: Star) -> DataFrame:
    keyed = entities.with_support_keys(star.train, star.chemical_registry, star.strain_registry)
    return keyed.select("sample_id", F.col("strain_support_key").alias("strain_key"), F.col("chemical_support_key").alias("chemical_key"))


ALL_SCENARIOS = folds.SCENARIOS


@query(
    "f13_assignment_audit",
    " UNION ALL ".join(
        f"SELECT scenario, fold, count(*) AS n_candidates, count(*) FILTER (WHERE eligible) AS n_eligible, count(*) FILTER (WHERE pair_seen) AS n_pair_seen, "
        f"count(*) FILTER (WHERE exclusion_reason = 'would_mix_additional_OOD_axis') AS n_mixed FROM ({_assignment_sql(s)}) GROUP BY 1, 2"
        for s in ("R10", "R01", "R11", "RT")
    ),
)
def f13(star: Star) -> DataFrame:
    wanted = ("R10", "R01", "R11", "RT")
    axis = axis_table(star, wanted)
    parts = [folds.assignment_table(axis, scenario, FOLDS).select(*ASSIGNMENT_COLUMNS) for scenario in wanted]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("scenario", "fold").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count(F.when(F.col("eligible"), F.lit(1))).alias("n_eligible"),
        F.count(F.when(F.col("pair_seen"), F.lit(1))).alias("n_pair_seen"),
        F.count(F.when(F.col("exclusion_reason") == folds.REASON_MIXED_AXIS, F.lit(1))).alias("n_mixed"),
    )


@query(
    "f14_fold_isolation",
    " UNION ALL ".join(f"SELECT '{s}' AS scenario, CAST(0 AS BIGINT) AS n_violations" for s in ALL_SCENARIOS),
)
def f14(star: Star) -> DataFrame:
    axis = axis_table(star, ALL_SCENARIOS)
    parts = []
    for scenario in ALL_SCENARIOS:
        bad = folds.isolation_violations(folds.membership(axis, scenario, FOLDS), scenario, FOLDS)
        parts.append(bad.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(scenario).alias("scenario"), "n_violations"))
    return reduce(DataFrame.unionByName, parts)


# One fault per rule: fit sets that hold nothing out break every rule of absence, empty ones every rule of presence.
_KEY_SQL = {"strain_key": "strain", "chemical_key": "chemical", "pair_key": "pair_key", "time_key": "time_key", "plate": "plate"}


def _fault_sql(scenario: str) -> str:
    counts = [("all", "sample_in_both", "sample_id")]
    counts += [("all", f"{key}_leaks", _KEY_SQL[key]) for key in folds.ABSENT[scenario]]
    counts += [("none", f"{key}_not_represented", _KEY_SQL[key]) for key in folds.PRESENT.get(scenario, ())]
    if scenario == "time_forward":
        counts += [(fit, "fit_not_earlier", "context_key") for fit in ("all", "none")]
    return " UNION ALL ".join(
        f"SELECT '{scenario}' AS scenario, '{fit}' AS fitted, '{rule}' AS rule, count(DISTINCT (fold, {key})) AS n_keys FROM ({_assignment_sql(scenario)}) q JOIN v_keys USING (sample_id) WHERE eligible HAVING count(*) > 0"
        for fit, rule, key in counts
    )


@query("f14_isolation_faults_found", " UNION ALL ".join(map(_fault_sql, ALL_SCENARIOS)))
def f14_faults(star: Star) -> DataFrame:
    """Violations of every rule where the fit sets of all folds hold all rows, or none."""
    axis = axis_table(star, ALL_SCENARIOS)
    parts = []
    for scenario in ALL_SCENARIOS:
        rows = folds.membership(axis, scenario, FOLDS)
        for name, mask in (("all", folds.every_fold(scenario, FOLDS)), ("none", 0)):
            bad = folds.isolation_violations(rows.withColumn("fit", F.lit(mask).cast("bigint")), scenario, FOLDS)
            parts.append(bad.groupBy("scenario", F.lit(name).alias("fitted"), "rule").agg(F.count(F.lit(1)).alias("n_keys")))
    return reduce(DataFrame.unionByName, parts)


@query(
    "f15_fold_fingerprints",
    f"""
SELECT k AS fold, count(*) AS n_rows, {digest_sum("sha256(CAST(sample_id AS VARCHAR))")} AS ids_sha256
FROM v_axis CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE cf IS NULL OR cf <> k GROUP BY 1
""",
)
def f15(star: Star) -> DataFrame:
    return folds.fold_fingerprints(folds.with_fit_mask(axis_table(star, ("S1",)), "S1", FOLDS), "fit", FOLDS)


@query(
    "f16_inner_folds",
    """
WITH sizes AS (SELECT outer_fold, chemical, n FROM (SELECT chemical, cf, count(*) AS n FROM v_axis WHERE kind = 'treatment' GROUP BY 1, 2)
   CROSS JOIN (SELECT unnest(range(4)) AS outer_fold) WHERE cf <> outer_fold),
 inner_fold AS (SELECT outer_fold, chemical, n, CASE WHEN ((rn - 1) // 2) % 2 = 0 THEN (rn - 1) % 2 ELSE 1 - (rn - 1) % 2 END AS fold
   FROM (SELECT outer_fold, chemical, n, row_number() OVER (PARTITION BY outer_fold ORDER BY n DESC, md5('inner|' || chemical)) AS rn FROM sizes))
SELECT outer_fold, fold AS inner_fold, CAST(sum(n) AS BIGINT) AS n_candidates, count(*) AS n_chemicals, CAST(0 AS BIGINT) AS n_outside
FROM inner_fold GROUP BY 1, 2
""",
)
def f16(star: Star) -> DataFrame:
    treated = folds.with_fit_mask(axis_table(star, ("S1",)), "S1", FOLDS).filter(F.col("kind") == "treatment")
    inner = folds.inner_group_folds(treated, "chemical", FOLDS, 2, "inner")
    held = treated.select("chemical", "chemical_fold").distinct()
    outside = F.when(F.col("chemical_fold") == F.col("outer_fold"), F.col("n")).otherwise(0)
    return inner.join(held, "chemical").groupBy("outer_fold", "inner_fold").agg(
        F.sum("n").alias("n_candidates"), F.count(F.lit(1)).alias("n_chemicals"), F.sum(outside).cast("bigint").alias("n_outside")
    )


@query(
    "f17_scoring_control_pool",
    """
WITH pool AS (SELECT k AS fold, sample_id FROM v_axis CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE pf <> k
  UNION SELECT k, sample_id FROM v_axis CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE kind = 'control')
SELECT fold, count(*) AS n_pool FROM pool GROUP BY 1
""",
)
def f17(star: Star) -> DataFrame:
    rows = folds.with_fit_mask(axis_table(star, ("plate",)), "plate", FOLDS)
    pool = folds.scoring_pool(rows, "plate", FOLDS)
    return folds.per_fold(pool, "pool", FOLDS, {"n_pool": lambda inside: F.count(F.when(inside, F.lit(1)))})


@query(
    "f18_whole_group_subsample",
    """
SELECT match_key, count(*) AS n FROM v_samples WHERE match_key IN
 (SELECT match_key FROM (SELECT DISTINCT match_key FROM v_samples) ORDER BY md5('5|' || match_key) LIMIT 200) GROUP BY 1
""",
)
def f18(star: Star) -> DataFrame:
    return folds.subsample_groups(star.samples, "match_key", 200, 5).groupBy("match_key").agg(F.count(F.lit(1)).alias("n"))
