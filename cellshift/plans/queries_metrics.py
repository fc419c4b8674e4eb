"""Registered queries: matched controls, metrics and summaries (groups C, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions import sqlnames
from cellshift.functions.moments import MOMENTS, moment_aggs, pearson_agg, pearson_from_moments, r2_agg
from cellshift.functions.numbers import r6, ratio
from cellshift.operators import checks, controls, metrics, prepare, quantiles
from cellshift.plans.registry import query, view
from cellshift.plans.sqltext import pcc, r2, response
from cellshift.plans.study import Study
from cellshift.session import written
from cellshift.sources.star import Star
from cellshift.streaming.metric_processor import resumed_scores
from cellshift.streaming.running_metrics import running_scores

ROUNDED = metrics.RESPONSE_METRICS


def rounded(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Round every double column that is not listed."""
    return frame.select(*[F.col(n) if n in keep or t != "double" else r6(n).alias(n) for n, t in frame.dtypes])


# ------------------------------------------------------------- matched controls
@query(
    "c01_exact_control",
    """
SELECT s.sample_id, c.protein, r6(c.c) AS control FROM v_samples s JOIN v_tctrl c USING (match_key)
WHERE s.kind = 'treatment' AND s.split <> 'train'
""",
)
def c01(star: Star) -> DataFrame:
    targets = star.treatments.filter(F.col("split") != "train")
    found = controls.exact_control(star.samples, star.log2, targets, pool=star.train)
    return found.select("sample_id", "protein", r6("control").alias("control"))


@query(
    "c01_exact_match_flag",
    """
SELECT split, count(*) AS n_treatments, count(*) FILTER (WHERE match_key IN (SELECT match_key FROM v_samples WHERE kind = 'control')) AS n_matched
FROM v_samples WHERE kind = 'treatment' GROUP BY 1
""",
)
def c01_flag(star: Star) -> DataFrame:
    flagged = controls.match_flags(star.treatments, star.samples)
    return flagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_treatments"), F.count(F.when(F.col("has_exact_match"), F.lit(1))).alias("n_matched")
    )


@query(
    "c02_treatment_control_delta",
    "SELECT sample_id, protein, r6(t) AS truth_delta, r6(m0 - c) AS pred_delta FROM v_score",
)
def c02(star: Star) -> DataFrame:
    study = Study(star)
    preds = study.absolute.select("sample_id", "protein", F.col("m0").alias("value"))
    pairs = controls.prediction_deltas(study.deltas, preds)
    return pairs.select("sample_id", "protein", r6("truth_delta").alias("truth_delta"), r6("pred_delta").alias("pred_delta"))


@query("c03_context_reference", "SELECT match_key, protein, r6(ctx) AS context_ref FROM v_ctx")
def c03(star: Star) -> DataFrame:
    return Study(star).context_reference.select("match_key", "protein", r6("context_ref").alias("context_ref"))


@query("c04_drug_reference", "SELECT chemical, protein, r6(drug) AS drug_ref FROM v_drug")
def c04(star: Star) -> DataFrame:
    return Study(star).drug_reference.select("chemical", "protein", r6("drug_ref").alias("drug_ref"))


@query(
    "c05_reference_lookup",
    "SELECT split, count(*) AS n_cells, count(ctx) AS n_context, count(drug) AS n_drug, r6(avg(ctx)) AS mean_context, r6(avg(drug)) AS mean_drug FROM v_score GROUP BY 1",
)
def c05(star: Star) -> DataFrame:
    study = Study(star)
    rows = controls.with_reference(study.deltas, study.context_reference, ["match_key"])
    rows = controls.with_reference(rows, study.drug_reference, ["chemical"])
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("context_ref").alias("n_context"),
        F.count("drug_ref").alias("n_drug"),
        r6(F.avg("context_ref")).alias("mean_context"),
        r6(F.avg("drug_ref")).alias("mean_drug"),
    )


@query("c06_leave_fold_out_reference", "SELECT sample_id, protein, fold, r6(ctx) AS context_ref FROM v_oof")
def c06(star: Star) -> DataFrame:
    study = Study(star)
    deltas = study.train_deltas.join(study.chemical_folds, "chemical")
    reference = controls.leave_fold_out_mean(deltas, ["match_key"], "truth_delta")
    rows = deltas.join(reference, ["match_key", "protein", "fold"], "left")
    return rows.select("sample_id", "protein", "fold", r6("context_ref").alias("context_ref"))


@query(
    "c08_matched_control_cache",
    "SELECT sample_id, match_key, chemical, fold, protein, r6(y) AS truth, r6(c) AS control, r6(t) AS truth_delta FROM v_oof",
)
def c08(star: Star) -> DataFrame:
    study = Study(star)
    rows = study.train_deltas.join(study.chemical_folds, "chemical")
    return rows.select(
        "sample_id", "match_key", "chemical", "fold", "protein", r6("y").alias("truth"), r6("control").alias("control"), r6("truth_delta").alias("truth_delta")
    )


@query(
    "c09_signature_compound_join",
    """
SELECT inchikey, count(*) AS n_signatures, r6(avg(l_extendedprice)) AS mean_value
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN v_creg ON raw_name = p_brand WHERE inchikey <> '' GROUP BY 1
""",
)
def c09(star: Star) -> DataFrame:
    signatures = star.table("lineitem").join(star.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("raw_name"), "l_extendedprice"
    )
    compounds = star.chemical_registry.select("raw_name", "inchikey")
    joined = controls.joined_dimension(signatures, compounds, "raw_name", ["inchikey"])
    return joined.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_signatures"), r6(F.avg("l_extendedprice")).alias("mean_value"))


@query(
    "c10_exclude_shared_compounds",
    """
WITH e AS (SELECT l_orderkey, canonical_id AS parent FROM lineitem JOIN part ON p_partkey = l_partkey JOIN v_creg ON raw_name = p_brand),
 t AS (SELECT DISTINCT canonical_id AS parent FROM v_samples JOIN v_creg ON raw_name = chemical WHERE strain = 'ASIA' AND pert_time = 2000 AND medium = 'BUILDING')
SELECT 'before' AS stage, count(*) AS n_rows, count(DISTINCT parent) AS n_parents FROM e
UNION ALL SELECT 'after', count(*), count(DISTINCT parent) FROM e WHERE parent NOT IN (SELECT parent FROM t)
""",
)
def c10(star: Star) -> DataFrame:
    registry = star.chemical_registry.select(F.col("raw_name").alias("p_brand"), F.col("canonical_id").alias("parent"))
    external = star.table("lineitem").join(star.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(registry, "p_brand")
    wanted = star.samples.filter((F.col("strain") == "ASIA") & (F.col("pert_time") == 2000) & (F.col("medium") == "BUILDING"))
    target = wanted.join(registry, wanted["chemical"] == registry["p_brand"]).select("parent")
    kept = controls.exclude_shared(external, target, "parent")
    parts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("parent").alias("n_parents")).select(F.lit(stage).alias("stage"), "*")
        for stage, frame in (("before", external), ("after", kept))
    ]
    return parts[0].unionByName(parts[1])


def _fold_scores(study: Study, model: str) -> DataFrame:
    scored = study.oof.withColumn("pred_delta", F.col(model) - F.col("control"))
    return metrics.response_report(scored, ["fold"])


@query(
    "c11_paired_fold_metrics",
    f"""
WITH a AS (SELECT fold, {response('m0 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY 1),
 b AS (SELECT fold, {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY 1)
SELECT fold, a.fc_pcc AS control_fc_pcc, b.fc_pcc AS candidate_fc_pcc, r6(b.fc_pcc - a.fc_pcc) AS fc_pcc_delta,
       r6(b.high_effect_f1 - a.high_effect_f1) AS high_effect_f1_delta FROM a JOIN b USING (fold)
""",
)
def c11(star: Star) -> DataFrame:
    study = Study(star)
    control, candidate = rounded(_fold_scores(study, "m0"), ["fold"]), rounded(_fold_scores(study, "m1"), ["fold"])
    paired = control.alias("a").join(candidate.alias("b"), "fold")
    return paired.select(
        "fold",
        F.col("a.fc_pcc").alias("control_fc_pcc"),
        F.col("b.fc_pcc").alias("candidate_fc_pcc"),
        r6(F.col("b.fc_pcc") - F.col("a.fc_pcc")).alias("fc_pcc_delta"),
        r6(F.col("b.high_effect_f1") - F.col("a.high_effect_f1")).alias("high_effect_f1_delta"),
    )


@query(
    "c12_leaderboard_with_control",
    f"""
WITH b AS (SELECT fold, model, {response('p', 't', drug='NULL::DOUBLE')} FROM (
  SELECT fold, 'base' AS model, m0 - c AS p, t, ctx FROM v_oof UNION ALL SELECT fold, 'strain', m1 - c, t, ctx FROM v_oof) GROUP BY 1, 2)
SELECT x.model, x.fold, x.fc_pcc, r6(x.fc_pcc - k.fc_pcc) AS fc_pcc_vs_control FROM b x LEFT JOIN b k ON k.fold = x.fold AND k.model = 'base'
""",
)
def c12(star: Star) -> DataFrame:
    study = Study(star)
    board = rounded(_fold_scores(study, "m0"), []).withColumn("model", F.lit("base")).unionByName(
        rounded(_fold_scores(study, "m1"), []).withColumn("model", F.lit("strain"))
    )
    base = board.filter(F.col("model") == "base").select("fold", F.col("fc_pcc").alias("_base"))
    return board.join(base, "fold", "left").select("model", "fold", "fc_pcc", r6(F.col("fc_pcc") - F.col("_base")).alias("fc_pcc_vs_control"))


# --------------------------------------------------------------------- moments
@query(
    "d01_pair_moments",
    "SELECT split, protein, count(*) AS n, r6(sum(m1 - 15)) AS sx, r6(sum(y - 15)) AS sy, r6(sum((m1 - 15) * (m1 - 15))) AS sxx, "
    "r6(sum((y - 15) * (y - 15))) AS syy, r6(sum((m1 - 15) * (y - 15))) AS sxy FROM v_abs GROUP BY 1, 2",
)
def d01(star: Star) -> DataFrame:
    rows = Study(star).absolute
    sums = rows.groupBy("split", "protein").agg(*moment_aggs(F.col("m1") - 15, F.col("y") - 15))
    return rounded(sums, [])


@query(
    "d02_pearson_from_merged_moments",
    f"SELECT split, count(*) AS n, r6({pcc('m1', 'y')}) AS pcc FROM v_abs GROUP BY 1",
)
def d02(star: Star) -> DataFrame:
    rows = Study(star).absolute
    fine = rows.groupBy("split", "protein").agg(*moment_aggs(F.col("m1") - 15, F.col("y") - 15))
    merged = fine.groupBy("split").agg(*[F.sum(name).alias(name) for name in MOMENTS])
    return merged.select("split", "n", r6(pearson_from_moments(std_floor=1e-8)).alias("pcc"))


@query(
    "d03_masked_rmse",
    "SELECT split, count(*) AS n_values, r6(sqrt(avg((m1 - y) * (m1 - y)))) AS rmse FROM v_abs GROUP BY 1",
)
def d03(star: Star) -> DataFrame:
    return Study(star).absolute.groupBy("split").agg(F.count("y").alias("n_values"), r6(metrics.rmse("m1")).alias("rmse"))


@query("d04_global_r2", f"SELECT split, r6({r2('m1', 'y', rows=1, floor='0')}) AS global_r2 FROM v_abs GROUP BY 1")
def d04(star: Star) -> DataFrame:
    return Study(star).absolute.groupBy("split").agg(r6(r2_agg("m1", "y", min_rows=1, sst_floor=0.0)).alias("global_r2"))


@query(
    "d05_protein_r2_median",
    f"""
SELECT split, r6(median(r)) AS protein_r2_median, count(r) AS n_evaluable_proteins
FROM (SELECT split, protein, {r2('m1', 'y', floor='0')} AS r FROM v_abs GROUP BY 1, 2) GROUP BY 1
""",
)
def d05(star: Star) -> DataFrame:
    scores = metrics.axis_scores(Study(star).absolute, ["split"], "protein", "m1")
    return scores.groupBy("split").agg(r6(F.percentile("r2", 0.5)).alias("protein_r2_median"), F.count("r2").alias("n_evaluable_proteins"))


@query(
    "d06_sample_scores_and_medians",
    f"""
SELECT split, r6(median(p)) AS sample_pcc_median, r6(median(r)) AS sample_r2_median
FROM (SELECT split, sample_id, {pcc('m1', 'y')} AS p, {r2('m1', 'y')} AS r FROM v_abs GROUP BY 1, 2) GROUP BY 1
""",
)
def d06(star: Star) -> DataFrame:
    scores = metrics.axis_scores(Study(star).absolute, ["split"], "sample_id", "m1")
    medians = metrics.axis_medians(scores, ["split"], "sample", bounded_axis=False)
    return rounded(medians, ["split"])


@query(
    "d06_mergeable_sample_medians",
    f"""
SELECT split, count(p) AS n_scores, r6(median(p)) AS sample_pcc_median, TRUE AS running_median_agrees
FROM (SELECT split, sample_id, {pcc('m1', 'y')} AS p FROM v_abs GROUP BY 1, 2) GROUP BY 1
""",
)
def d06_mergeable(star: Star) -> DataFrame:
    """Exact medians, and whether the one merged from four parts' states keeps its stated rank error."""
    scores = metrics.axis_scores(Study(star).absolute, ["split"], "sample_id", "m1").select("split", "sample_id", "pcc")
    scores = written(scores.filter(F.col("pcc").isNotNull()), "sample-scores")
    parts = scores.groupBy("split", F.pmod(F.xxhash64("sample_id"), F.lit(4)).alias("part")).agg(quantiles.quantile_state("pcc").alias("state"))
    running = quantiles.merged_state(parts, ["split"]).select("split", quantiles.state_quantile("state").alias("estimate"))
    errors = quantiles.rank_errors(scores, ["split"], "pcc", running, "estimate")
    exact = quantiles.exact_quantile(scores, ["split"], "pcc", 0.5, "median")
    return errors.join(exact, "split").select("split", F.col("n").alias("n_scores"), r6("median").alias("sample_pcc_median"), (F.col("error") <= quantiles.RANK_ERROR).alias("running_median_agrees"))


@query(
    "d07_protein_pcc_median",
    f"SELECT split, r6(median(p)) AS protein_pcc_median FROM (SELECT split, protein, {pcc('m1', 'y')} AS p FROM v_abs GROUP BY 1, 2) GROUP BY 1",
)
def d07(star: Star) -> DataFrame:
    scores = metrics.axis_scores(Study(star).absolute, ["split"], "protein", "m1")
    return scores.groupBy("split").agg(r6(F.percentile("pcc", 0.5)).alias("protein_pcc_median"))


def _absolute_sql(model: str, source: str = "v_abs", by: str = "split") -> str:
    return f"""
SELECT {by}, absolute_n_samples, absolute_n_observed_values, absolute_sample_pcc_median, absolute_sample_r2_median,
       absolute_protein_pcc_median, absolute_protein_r2_median
FROM (SELECT {by}, count(DISTINCT sample_id) AS absolute_n_samples, count(*) AS absolute_n_observed_values FROM {source} GROUP BY {by})
LEFT JOIN (SELECT {by}, r6(median(p)) AS absolute_sample_pcc_median, r6(median(r)) AS absolute_sample_r2_median
      FROM (SELECT {by}, sample_id, {pcc(model, 'y')} AS p, {r2(model, 'y')} AS r FROM {source} GROUP BY {by}, sample_id) GROUP BY {by}) USING ({by})
LEFT JOIN (SELECT {by}, r6(median(p)) AS absolute_protein_pcc_median, r6(median(r)) AS absolute_protein_r2_median
      FROM (SELECT {by}, protein, {pcc(model, 'y')} AS p, {r2(model, 'y', floor='0')} AS r FROM {source} GROUP BY {by}, protein) GROUP BY {by}) USING ({by})
"""


@query("d08_absolute_fidelity", _absolute_sql("m2"))
def d08(star: Star) -> DataFrame:
    rows = Study(star).absolute.withColumn("m", F.col("m2"))
    return rounded(metrics.absolute_fidelity(rows, ["split"]), ["split"])


@query(
    "d09_fold_change_pcc",
    f"SELECT split, count(*) AS n_cells, r6({pcc('m0 - c', 't')}) AS fc_pcc FROM v_score GROUP BY 1",
)
def d09(star: Star) -> DataFrame:
    scored = Study(star).scored_model("m0")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_cells"), r6(pearson_agg("pred_delta", "truth_delta")).alias("fc_pcc"))


@query(
    "d10_context_residual_pcc",
    f"SELECT split, count(ctx) AS n_cells, r6({pcc('m1 - c - ctx', 't - ctx')}) AS context_residual_pcc FROM v_score GROUP BY 1",
)
def d10(star: Star) -> DataFrame:
    scored = Study(star).scored_model("m1")
    ctx = F.col("context_ref")
    return scored.groupBy("split").agg(
        F.count(ctx).alias("n_cells"), r6(pearson_agg(F.col("pred_delta") - ctx, F.col("truth_delta") - ctx)).alias("context_residual_pcc")
    )


@query(
    "d11_drug_residual_pcc",
    f"SELECT split, count(drug) AS n_cells, r6({pcc('m1 - c - drug', 't - drug')}) AS drug_residual_pcc FROM v_score GROUP BY 1",
)
def d11(star: Star) -> DataFrame:
    scored = Study(star).scored_model("m1")
    drug = F.col("drug_ref")
    return scored.groupBy("split").agg(
        F.count(drug).alias("n_cells"), r6(pearson_agg(F.col("pred_delta") - drug, F.col("truth_delta") - drug)).alias("drug_residual_pcc")
    )


HIGH = ["high_effect_direction_accuracy", "high_effect_precision", "high_effect_recall", "high_effect_f1"]


@query("d12_high_effect_scores", f"SELECT split, {', '.join(HIGH)} FROM (SELECT split, {response('m2 - c', 't')} FROM v_score GROUP BY 1)")
def d12(star: Star) -> DataFrame:
    report = metrics.response_report(Study(star).scored_model("m2"), ["split"])
    return rounded(report.select("split", *HIGH), ["split"])


@query(
    "d12_high_effect_f1_zero_convention",
    f"SELECT split, protein, high_effect_f1 FROM (SELECT split, protein, {response('m0 - c', 't', zero=True)} FROM v_score GROUP BY 1, 2)",
)
def d12_zero(star: Star) -> DataFrame:
    report = metrics.response_report(Study(star).scored_model("m0"), ["split", "protein"], zero_when_no_hit=True)
    return rounded(report.select("split", "protein", "high_effect_f1"), ["split", "protein"])


@query(
    "d13_high_effect_pcc",
    f"SELECT split, count(*) FILTER (WHERE abs(t) > 1) AS n_cells, r6({pcc('m2 - c', 't', 'abs(t) > 1')}) AS high_effect_pcc FROM v_score GROUP BY 1",
)
def d13(star: Star) -> DataFrame:
    scored = Study(star).scored_model("m2")
    high = F.abs("truth_delta") > 1
    return scored.groupBy("split").agg(
        F.count(F.when(high, F.lit(1))).alias("n_cells"), r6(pearson_agg("pred_delta", "truth_delta", high)).alias("high_effect_pcc")
    )


@query(
    "d14_response_report_with_empty_groups",
    f"""
SELECT g.plate, coalesce(response_n_samples, 0) AS response_n_samples, coalesce(response_n_observed_values, 0) AS response_n_observed_values,
       fc_pcc, context_residual_pcc, drug_residual_pcc, high_effect_pcc, high_effect_direction_accuracy, high_effect_precision, high_effect_recall, high_effect_f1
FROM (SELECT DISTINCT plate FROM v_samples) g LEFT JOIN
 (SELECT s.plate, count(DISTINCT sample_id) AS response_n_samples, count(*) AS response_n_observed_values, {response('m2 - c', 't')}
  FROM v_score JOIN v_samples s USING (sample_id) WHERE v_score.split = 'val_both' GROUP BY 1) r ON r.plate = g.plate
""",
)
def d14(star: Star) -> DataFrame:
    scored = prepare.with_samples(Study(star).scored_model("m2").filter(F.col("split") == "val_both"), star.samples.select("sample_id", "plate"))
    report = metrics.response_report(scored, ["plate"], groups=star.samples.select("plate"))
    return rounded(report, ["plate"])


RESPONSE_SQL = f"SELECT split, count(DISTINCT sample_id) AS response_n_samples, count(*) AS response_n_observed_values, {response('m0 - c', 't')} FROM v_score GROUP BY 1"


@query("d15_response_report_by_split", RESPONSE_SQL)
def d15(star: Star) -> DataFrame:
    return rounded(metrics.response_report(Study(star).scored_model("m0"), ["split"]), ["split"])


@query("d15_response_report_in_sql", RESPONSE_SQL)
def d15_sql(star: Star) -> DataFrame:
    """The same report as SQL text over the session's own score functions."""
    sqlnames.register(star.spark)
    Study(star).scored_model("m0").createOrReplaceTempView("scored_responses")
    return rounded(star.spark.sql(sqlnames.response_report_sql("scored_responses", "split")), ["split"])


@query(
    "d16_combined_fold_evaluation",
    f"""
WITH a AS ({_absolute_sql('m1', 'v_oof', 'fold')}),
 r AS (SELECT fold, count(DISTINCT sample_id) AS response_n_samples, count(*) AS response_n_observed_values, {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY 1)
SELECT * FROM a JOIN r USING (fold)
""",
)
def d16(star: Star) -> DataFrame:
    rows = Study(star).oof.withColumn("pred_delta", F.col("m1") - F.col("control")).withColumn("m", F.col("m1"))
    # Three aggregations read these cells; they are joined together only once.
    rows = written(rows, "oof-cells")
    both = metrics.absolute_fidelity(rows, ["fold"]).join(metrics.response_report(rows, ["fold"]), "fold")
    return rounded(both, ["fold"])


@query(
    "d17_delta_and_absolute_views",
    f"""
SELECT kind, count(*) AS n_cells, r6({pcc('p', 't')}) AS fc_pcc, r6(sqrt(avg((m - y) * (m - y)))) AS rmse
FROM (SELECT 'absolute' AS kind, m1 - c AS p, t, m1 AS m, y FROM v_oof UNION ALL SELECT 'delta', m1 - m0, t, NULL, y FROM v_oof) GROUP BY 1
""",
)
def d17(star: Star) -> DataFrame:
    # Both views come from the row of the cell itself; no prediction is shuffled back to it.
    as_delta, no_value = F.col("m1") - F.col("control"), F.lit(None).cast("double")
    options = F.array(
        F.struct(F.lit("absolute").alias("kind"), as_delta.alias("pred_delta"), F.col("m1").alias("m")),
        F.struct(F.lit("delta").alias("kind"), (F.col("m1") - F.col("m0")).alias("pred_delta"), no_value.alias("m")),
    )
    views = Study(star).oof.select("y", "truth_delta", F.explode(options).alias("v")).select("y", "truth_delta", "v.*")
    return views.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(pearson_agg("pred_delta", "truth_delta")).alias("fc_pcc"), r6(metrics.rmse()).alias("rmse")
    )


@query(
    "d18_fold_and_cluster_tables",
    f"""
SELECT * FROM (SELECT 'fold' AS level, CAST(fold AS VARCHAR) AS unit, array_to_string(list_sort(list(DISTINCT chemical)), '|') AS chemicals,
  count(DISTINCT sample_id) AS n_samples, {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY fold)
UNION ALL SELECT 'cluster', chemical, chemical, count(DISTINCT sample_id), {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY chemical
""",
)
def d18(star: Star) -> DataFrame:
    rows = Study(star).oof.withColumn("pred_delta", F.col("m1") - F.col("control"))
    # One pass to (fold, cluster, sample) statistics; both tables merge from there.
    stats = metrics.response_moments(rows, ["fold", "chemical", "sample_id"])
    levels = stats.withColumn(
        "_at",
        F.explode(
            F.array(
                F.struct(F.lit("fold").alias("level"), F.col("fold").cast("string").alias("unit")),
                F.struct(F.lit("cluster").alias("level"), F.col("chemical").alias("unit")),
            )
        ),
    ).select("*", "_at.level", "_at.unit")
    merged = metrics.merged_moments(levels, ["level", "unit"])
    names = levels.groupBy("level", "unit").agg(
        F.array_join(F.sort_array(F.collect_set("chemical")), "|").alias("chemicals"), F.count(F.lit(1)).alias("n_samples")
    )
    scored = metrics.scores_from_moments(merged, ["level", "unit"])
    return rounded(names.join(scored, ["level", "unit"]), ["level", "unit", "chemicals"])


@query(
    "d19_entity_fast_metrics",
    f"SELECT fold, chemical, fc_pcc, context_residual_pcc, high_effect_f1 FROM (SELECT fold, chemical, {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY 1, 2)",
)
def d19(star: Star) -> DataFrame:
    rows = Study(star).oof.withColumn("pred_delta", F.col("m1") - F.col("control"))
    stats = metrics.response_moments(rows, ["fold", "chemical"])
    scores = metrics.scores_from_moments(stats, ["fold", "chemical"])
    return rounded(scores.select("fold", "chemical", "fc_pcc", "context_residual_pcc", "high_effect_f1"), ["fold", "chemical"])


view("v_fold_scores", f"SELECT fold, {response('m1 - c', 't', drug='NULL::DOUBLE')} FROM v_oof GROUP BY 1")

SUMMARY = ["fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1"]


@query(
    "d20_fold_summary",
    "SELECT 'm1' AS model, count(*) AS n_scored_folds, "
    + ", ".join(f"r6(avg({m})) AS {m}_mean, r6(stddev_pop({m})) AS {m}_std" for m in SUMMARY)
    + " FROM v_fold_scores",
)
def d20(star: Star) -> DataFrame:
    table = rounded(_fold_scores(Study(star), "m1"), []).withColumn("model", F.lit("m1"))
    return rounded(metrics.fold_summary(table, ["model"], SUMMARY), ["model"])


view("v_split_scores", f"SELECT model, split, {response('p', 't')} FROM (SELECT 'm0' AS model, split, m0 - c AS p, t, ctx, drug FROM v_score "
     "UNION ALL SELECT 'm2', split, m2 - c, t, ctx, drug FROM v_score) GROUP BY 1, 2")


def split_scores(study: Study, models: tuple[str, ...] = ("m0", "m2")) -> DataFrame:
    """Response scores per model and split in one pass over the scored cells."""
    options = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("control")).alias("pred_delta")) for m in models])
    rows = study.scored.withColumn("_m", F.explode(options)).select("*", "_m.model", "_m.pred_delta").drop("_m")
    return rounded(metrics.response_report(rows, ["model", "split"]), ["model", "split"])


REGIMES = ("val_both", "val_chem_only", "val_strain_only")


@query(
    "d21_regime_macro_average",
    f"""
SELECT model, r6(avg(fc_pcc)) AS fc_pcc_macro, r6(avg(high_effect_f1)) AS high_effect_f1_macro,
       array_to_string(list_sort(list(DISTINCT split)), '|') AS regimes, count(DISTINCT split) = 3 AS complete
FROM v_split_scores WHERE split IN {REGIMES} GROUP BY 1
""",
)
def d21(star: Star) -> DataFrame:
    table = split_scores(Study(star))
    return rounded(metrics.macro_over(table, ["model"], "split", REGIMES, ["fc_pcc", "high_effect_f1"]), ["model"])


@query(
    "d22_selection_profile",
    """
SELECT model, r6(CASE WHEN count(fc_pcc) FILTER (WHERE split <> 'train') = 4 THEN avg(fc_pcc) FILTER (WHERE split <> 'train') END) AS macro_fc,
       r6(CASE WHEN count(context_residual_pcc) FILTER (WHERE split IN ('val_chem_only', 'val_time')) = 2 THEN avg(context_residual_pcc) FILTER (WHERE split IN ('val_chem_only', 'val_time')) END) AS context_residual_macro,
       r6(CASE WHEN count(drug_residual_pcc) FILTER (WHERE split IN ('val_strain_only', 'val_time')) = 2 THEN avg(drug_residual_pcc) FILTER (WHERE split IN ('val_strain_only', 'val_time')) END) AS drug_residual_macro,
       r6(CASE WHEN count(high_effect_f1) FILTER (WHERE split IN ('no_such_split')) = 1 THEN avg(high_effect_f1) FILTER (WHERE split IN ('no_such_split')) END) AS plate_f1,
       CAST(4 - count(fc_pcc) FILTER (WHERE split <> 'train') + 2 - count(context_residual_pcc) FILTER (WHERE split IN ('val_chem_only', 'val_time'))
       + 2 - count(drug_residual_pcc) FILTER (WHERE split IN ('val_strain_only', 'val_time')) + 1 AS BIGINT) AS n_undefined
FROM v_split_scores GROUP BY 1
""",
)
def d22(star: Star) -> DataFrame:
    profile = metrics.selection_profile(
        split_scores(Study(star)),
        ["model"],
        "split",
        {
            "macro_fc": ("fc_pcc", ("val_chem_only", "val_strain_only", "val_both", "val_time")),
            "context_residual_macro": ("context_residual_pcc", ("val_chem_only", "val_time")),
            "drug_residual_macro": ("drug_residual_pcc", ("val_strain_only", "val_time")),
            "plate_f1": ("high_effect_f1", ("no_such_split",)),
        },
    )
    return rounded(profile, ["model"])


def _mean_defined(*names: str) -> str:
    total = " + ".join(f"coalesce({n}, 0)" for n in names)
    count = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in names)
    return f"(({total}) / nullif({count}, 0))"


FOUR = [f"absolute_{axis}_{kind}_median" for axis in ("sample", "protein") for kind in ("pcc", "r2")]
SCORER_SPLITS = {"chemical": "val_chem_only", "strain": "val_strain_only", "both": "val_both", "time": "val_time"}

view("v_scorer_abs", "SELECT *, 'all' AS everything, m2 AS m FROM v_abs WHERE split <> 'train'")
view("v_scorer_overall", f"SELECT * FROM ({_absolute_sql('m2', 'v_scorer_abs', 'everything')}) JOIN (SELECT 'all' AS everything, {response('m2 - c', 't')} FROM v_score WHERE split <> 'train') USING (everything)")
view("v_scorer_split", f"SELECT * FROM ({_absolute_sql('m2', 'v_scorer_abs', 'split')}) JOIN (SELECT split, {response('m2 - c', 't')} FROM v_score WHERE split <> 'train' GROUP BY 1) USING (split)")

MODULES_SQL = f"""
SELECT {_mean_defined(*FOUR)} AS absolute_fidelity, fc_pcc AS matched_control_fc,
  (SELECT context_residual_pcc FROM v_scorer_split WHERE split = 'val_chem_only') AS context_residual,
  (SELECT drug_residual_pcc FROM v_scorer_split WHERE split = 'val_strain_only') AS drug_residual,
  (SELECT avg(v) FROM (SELECT {_mean_defined(_mean_defined(*FOUR), 'fc_pcc')} AS v FROM v_scorer_split WHERE split IN ('val_both', 'val_time'))) AS double_unknown_time,
  {_mean_defined('high_effect_direction_accuracy', 'high_effect_pcc', 'high_effect_f1')} AS high_effect
FROM v_scorer_overall
"""


@query(
    "d23_module_score",
    f"""
SELECT r6(absolute_fidelity) AS absolute_fidelity, r6(matched_control_fc) AS matched_control_fc, r6(context_residual) AS context_residual,
  r6(drug_residual) AS drug_residual, r6(double_unknown_time) AS double_unknown_time, r6(high_effect) AS high_effect,
  round(100 * (0.20 * absolute_fidelity + 0.25 * matched_control_fc + 0.20 * context_residual + 0.20 * drug_residual
       + 0.10 * double_unknown_time + 0.05 * high_effect), 3) AS score
FROM ({MODULES_SQL})
""",
)
def d23(star: Star) -> DataFrame:
    from cellshift.plans.scorer import score_frames

    study = Study(star)
    held = study.absolute.filter(F.col("split") != "train").withColumn("m", F.col("m2"))
    scored = study.scored_model("m2").filter(F.col("split") != "train")
    overall, by_split = score_frames(
        written(held.select("sample_id", "protein", "split", "y", "m"), "absolute"), written(scored, "scored")
    )
    result = metrics.module_score(rounded(overall, []), rounded(by_split, ["split"]), SCORER_SPLITS)
    return result.select(*[r6(name).alias(name) for name in metrics.MODULE_WEIGHTS], F.round("score", 3).alias("score"))


@query(
    "d24_scorer_end_to_end",
    f"""
SELECT 'overall' AS scope, * EXCLUDE (everything) FROM v_scorer_overall
UNION ALL BY NAME SELECT split AS scope, * EXCLUDE (split) FROM v_scorer_split
""",
)
def d24(star: Star) -> DataFrame:
    from cellshift.plans.scorer import score_study

    study = Study(star)
    held = star.samples.filter(F.col("split") != "train")
    held_ids = held.select("sample_id")
    truth = prepare.with_samples(star.cells, held_ids, "left_semi")
    preds = prepare.with_samples(study.absolute, held_ids, "left_semi").select("sample_id", "protein", F.col("m2").alias("value"))
    overall, by_split = score_study(
        held, truth, preds, study.context_reference, study.drug_reference, truth_scale="auto",
        control_samples=star.samples, control_cells=star.log2,
    )
    both = overall.withColumn("scope", F.lit("overall")).unionByName(by_split.withColumnRenamed("split", "scope"))
    both = both.drop("response_n_samples", "response_n_observed_values")
    return rounded(both, ["scope"])


@query(
    "d24_incomplete_predictions",
    "SELECT split, protein, CASE protein WHEN 'L6' THEN 'missing' WHEN 'L5' THEN 'non_finite' ELSE 'absent' END AS reason, count(*) AS n_cells "
    "FROM v_abs WHERE split <> 'train' AND protein IN ('L5', 'L6', 'L7') GROUP BY 1, 2, 3",
)
def d24_incomplete(star: Star) -> DataFrame:
    """Faults put in: a prediction set without L7, with undefined L6 and infinite L5."""
    from cellshift.plans.scorer import incomplete_predictions

    held = star.samples.filter(F.col("split") != "train")
    value = F.when(F.col("protein") == "L6", F.lit(None)).when(F.col("protein") == "L5", F.lit(float("inf"))).otherwise(F.lit(1.0))
    preds = star.cells.filter(F.col("protein") != "L7").select("sample_id", "protein", value.cast("double").alias("value"))
    gaps = prepare.with_samples(incomplete_predictions(held, star.cells, preds), held.select("sample_id", "split"))
    return gaps.groupBy("split", "protein", "reason").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "d25_signature_row_pcc",
    f"SELECT split, r6(avg(p)) AS mean_row_pcc, count(p) AS n_rows FROM (SELECT split, sample_id, {pcc('m2', 'y')} AS p FROM v_abs GROUP BY 1, 2) GROUP BY 1",
)
def d25(star: Star) -> DataFrame:
    scores = metrics.axis_scores(Study(star).absolute, ["split"], "sample_id", "m2")
    return scores.groupBy("split").agg(r6(F.avg("pcc")).alias("mean_row_pcc"), F.count("pcc").alias("n_rows"))


@query(
    "d26_level_counts",
    "SELECT split, CASE WHEN chemical = 'Brand#7' THEN NULL ELSE chemical_role END AS level, count(*) AS n FROM v_samples GROUP BY 1, 2",
)
def d26(star: Star) -> DataFrame:
    level = F.when(F.col("chemical") != "Brand#7", F.col("chemical_role")).alias("level")
    return star.samples.groupBy("split", level).agg(F.count(F.lit(1)).alias("n"))


@query(
    "d27_loss_reports",
    f"""
SELECT split, count(*) AS n_values, r6(avg(e * e)) AS mse, r6(avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END)) AS huber,
       r6(0.5 * avg(e * e) + 0.5 * avg(abs(e))) AS mse_mae, r6(1 - {pcc('m1', 'y')}) AS one_minus_pcc
FROM (SELECT *, m1 - y AS e FROM v_abs) GROUP BY 1
""",
)
def d27(star: Star) -> DataFrame:
    return rounded(metrics.loss_report(Study(star).absolute, ["split"], "m1"), ["split"])


_RUNNING_SQL = f"""
SELECT event_type, count(*) AS n, r6({pcc('k', 'value')}) AS pcc,
       count(*) FILTER (WHERE abs(value) > 10) AS n_high_true, count(*) FILTER (WHERE abs(k) > 10) AS n_high_pred,
       count(*) FILTER (WHERE abs(value) > 10 AND abs(k) > 10 AND sign(k) = sign(value)) AS n_high_hit
FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1
"""


@query("d28_running_metric_state", _RUNNING_SQL)
def d28(star: Star) -> DataFrame:
    state = running_scores(star.spark, f"{star.folder}/events.parquet", threshold=10.0)
    return rounded(state, ["event_type"])


@query("d28_resumed_metric_state", _RUNNING_SQL)
def d28_resumed(star: Star) -> DataFrame:
    """The same scores from a keyed stateful processor that was fed in four batches, stopped half way and resumed."""
    k = F.get_json_object("props", "$.k").cast("double")
    pairs = star.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), k.alias("prediction"), F.col("value").alias("truth"))
    return rounded(resumed_scores(pairs, 10.0).withColumnRenamed("key", "event_type"), ["event_type"])


@query(
    "d05_regression_report",
    f"""
WITH p AS (SELECT split, protein, {r2('m2', 'y', floor='0')} AS r FROM v_abs GROUP BY 1, 2)
SELECT split, count(DISTINCT sample_id) AS n_samples, count(*) AS n_observed_values, r6(sqrt(avg((m2 - y) * (m2 - y)))) AS log2_rmse,
       r6({r2('m2', 'y', rows=1, floor='0')}) AS global_r2, (SELECT r6(median(r)) FROM p WHERE p.split = a.split) AS protein_r2_median,
       (SELECT count(r) FROM p WHERE p.split = a.split) AS n_evaluable_proteins
FROM v_abs a GROUP BY 1
""",
)
def d05_report(star: Star) -> DataFrame:
    return rounded(metrics.regression_report(Study(star).absolute, ["split"], "m2"), ["split"])
