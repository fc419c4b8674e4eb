"""Registered queries: statistical inference and decision tables (groups K, L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.operators import inference, metrics, predict, selection, shuffled
from cellshift.operators.fingerprints import multiset_digest
from cellshift.operators.grids import literal_rows
from cellshift.plans.queries_metrics import rounded
from cellshift.plans.queries_models import GRID_METRICS, PARTS, WEIGHT_SQL, WEIGHTS, _values, blend_grid, delta_components, family_grid, fusion_cells
from cellshift.plans.registry import VIEWS, query, view
from cellshift.plans.sqltext import digest_sum, pcc, r2, response
from cellshift.plans.study import FOLDS, Study
from cellshift.session import shuffles_dropped, written
from cellshift.sources.star import Star

# Draws of the unit and cluster bootstraps, and of the promotion gate's entity bootstrap.
DRAWS = 10_000
GATE_DRAWS = 20_000


def boot_sql(units: str, by: list[str], seed: object, draws: int = DRAWS) -> str:
    """SQL of the unit bootstrap: units(by, unit, v) -> observed and drawn statistics."""
    keys = ", ".join(by)
    comma = f"{keys}, " if by else ""
    part = f"PARTITION BY {keys} " if by else ""
    join = " AND ".join(["b.rk = p.pick", *[f"b.{k} = p.{k}" for k in by]])
    group = f"GROUP BY {keys}" if by else ""
    using = f"USING ({keys})" if by else "ON true"
    return f"""
(WITH u AS (SELECT {comma}unit, v, row_number() OVER ({part}ORDER BY md5('{seed}-units|' || unit)) AS rk, count(*) OVER ({part}) AS n FROM ({units}) WHERE v IS NOT NULL),
 p AS (SELECT {comma}draw, CAST('0x' || substr(md5('{seed}|' || CAST(draw AS VARCHAR) || '|' || CAST(rk AS VARCHAR)), 1, 8) AS BIGINT) % n + 1 AS pick FROM u CROSS JOIN (SELECT unnest(range({draws})) AS draw)),
 m AS (SELECT {', '.join([*(f'p.{k}' for k in by), 'p.draw'])}, avg(b.v) AS mv FROM p JOIN u b ON {join} GROUP BY ALL)
 SELECT * FROM (SELECT {comma}count(*) AS n_units, avg(v) AS mean_delta, stddev_samp(v) AS std_delta FROM u {group})
 JOIN (SELECT {comma}quantile_cont(mv, 0.025) AS ci_low, quantile_cont(mv, 0.975) AS ci_high, avg(CASE WHEN round(mv, 12) > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive FROM m {group}) {using})
"""


# --------------------------------------------------- per-entity deltas of two candidates
view(
    "v_entity_scores",
    f"SELECT * FROM (SELECT model, split AS scenario, chemical, {response('p', 't')} FROM (SELECT 'm0' AS model, split, chemical, m0 - c AS p, t, ctx, drug FROM v_score "
    "UNION ALL SELECT 'm1', split, chemical, m1 - c, t, ctx, drug FROM v_score UNION ALL SELECT 'm2', split, chemical, m2 - c, t, ctx, drug FROM v_score) GROUP BY 1, 2, 3)",
)
view(
    "v_entity_delta",
    "SELECT x.model AS candidate, x.scenario, x.chemical, x.metric, x.score - b.score AS delta FROM "
    f"(SELECT * FROM (SELECT model, scenario, chemical, {', '.join(GRID_METRICS)} FROM v_entity_scores) UNPIVOT (score FOR metric IN ({', '.join(GRID_METRICS)}))) x JOIN "
    f"(SELECT * FROM (SELECT model, scenario, chemical, {', '.join(GRID_METRICS)} FROM v_entity_scores) UNPIVOT (score FOR metric IN ({', '.join(GRID_METRICS)}))) b "
    "ON b.model = 'm0' AND x.model <> 'm0' AND b.scenario = x.scenario AND b.chemical = x.chemical AND b.metric = x.metric",
)


def entity_deltas(study: Study) -> DataFrame:
    """(candidate, scenario, chemical, metric, delta) of m1 and m2 against m0."""
    options = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("control")).alias("pred_delta")) for m in ("m0", "m1", "m2")])
    rows = study.scored.withColumn("_m", F.explode(options)).select("*", "_m.*").withColumnRenamed("split", "scenario")
    keys = ["model", "scenario", "chemical"]
    scores = rounded(metrics.response_report(rows, keys), keys)
    long = scores.unpivot(keys, GRID_METRICS, "metric", "score").filter(F.col("score").isNotNull())
    base = long.filter(F.col("model") == "m0").select("scenario", "chemical", "metric", F.col("score").alias("_base"))
    paired = long.filter(F.col("model") != "m0").join(base, ["scenario", "chemical", "metric"])
    return paired.select(F.col("model").alias("candidate"), "scenario", "chemical", "metric", (F.col("score") - F.col("_base")).alias("delta"))


view("v_boot", boot_sql("SELECT candidate, scenario, metric, chemical AS unit, delta AS v FROM v_entity_delta", ["candidate", "scenario", "metric"], 8401))
BOOT = ["n_units", "mean_delta", "std_delta", "ci_low", "ci_high", "probability_positive"]


def bootstrap_table(study: Study) -> DataFrame:
    return inference.bootstrap_means(entity_deltas(study), ["candidate", "scenario", "metric"], "chemical", "delta", DRAWS, 8401)


@query(
    "k01_paired_mean_bootstrap",
    "SELECT candidate, scenario, metric, n_units, r6(mean_delta) AS mean_delta, r6(std_delta) AS std_delta, r6(ci_low) AS ci_low, r6(ci_high) AS ci_high, r6(probability_positive) AS probability_positive FROM v_boot",
)
def k01(star: Star) -> DataFrame:
    return rounded(bootstrap_table(Study(star)), ["candidate", "scenario", "metric"])


view(
    "v_cstat",
    """
SELECT model, chemical, fold, count(*) AS n_fc, sum(p) AS sx_fc, sum(t) AS sy_fc, sum(p * p) AS sxx_fc, sum(t * t) AS syy_fc, sum(p * t) AS sxy_fc,
  count(ctx) AS n_ctx, sum(p - ctx) AS sx_ctx, sum(t - ctx) AS sy_ctx, sum((p - ctx) * (p - ctx)) AS sxx_ctx, sum((t - ctx) * (t - ctx)) AS syy_ctx, sum((p - ctx) * (t - ctx)) AS sxy_ctx,
  count(h) AS n_high, sum(p * h) AS sx_high, sum(t * h) AS sy_high, sum(p * p * h) AS sxx_high, sum(t * t * h) AS syy_high, sum(p * t * h) AS sxy_high,
  count(h) AS n_high_true, count(*) FILTER (WHERE abs(p) > 1) AS n_high_pred, count(h) FILTER (WHERE abs(p) > 1 AND sign(p) = sign(t)) AS n_high_hit
FROM (SELECT *, CASE WHEN abs(t) > 1 THEN 1 END AS h FROM (SELECT 'm0' AS model, chemical, fold, m0 - c AS p, t, ctx FROM v_oof UNION ALL SELECT 'm1', chemical, fold, m1 - c, t, ctx FROM v_oof))
GROUP BY 1, 2, 3
""",
)


def cluster_stats(study: Study) -> DataFrame:
    options = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("control")).alias("pred_delta")) for m in ("m0", "m1")])
    rows = study.oof.withColumn("_m", F.explode(options)).select("*", "_m.*")
    return inference.cluster_statistics(rows, ["model", "chemical", "fold"])


@query(
    "k02_cluster_statistics",
    "SELECT model, chemical, fold, n_fc, r6(sx_fc) AS sx_fc, r6(sxy_fc) AS sxy_fc, n_ctx, r6(coalesce(sxy_ctx, 0)) AS sxy_ctx, n_high, r6(coalesce(syy_high, 0)) AS syy_high, n_high_true, n_high_pred, n_high_hit FROM v_cstat",
)
def k02(star: Star) -> DataFrame:
    stats = cluster_stats(Study(star))
    keep = ["model", "chemical", "fold", "n_fc", "sx_fc", "sxy_fc", "n_ctx", "sxy_ctx", "n_high", "syy_high", "n_high_true", "n_high_pred", "n_high_hit"]
    return rounded(stats.select(*keep), ["model", "chemical"])


def _moment_pcc(suffix: str) -> str:
    s = lambda name: f"sum(w * coalesce({name}_{suffix}, 0))"
    n = f"sum(w * n_{suffix})"
    vx, vy = f"({s('sxx')} - {s('sx')} * {s('sx')} / nullif({n}, 0))", f"({s('syy')} - {s('sy')} * {s('sy')} / nullif({n}, 0))"
    return f"CASE WHEN {n} >= 2 AND {vx} > 1e-9 AND {vy} > 1e-9 THEN ({s('sxy')} - {s('sx')} * {s('sy')} / {n}) / sqrt({vx} * {vy}) END"


def cluster_boot_sql(stats: str, draws: int = DRAWS) -> str:
    return f"""
WITH st AS (SELECT * FROM {stats}),
 cl AS (SELECT chemical, row_number() OVER (ORDER BY md5('4200-units|' || chemical)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT chemical || '' AS chemical FROM st)),
 pk AS (SELECT draw, CAST('0x' || substr(md5('4200|' || CAST(draw AS VARCHAR) || '|' || CAST(rk AS VARCHAR)), 1, 8) AS BIGINT) % n + 1 AS pick FROM cl CROSS JOIN (SELECT unnest(range({draws})) AS draw)),
 wt AS (SELECT draw, chemical, CAST(count(*) AS DOUBLE) AS w FROM pk JOIN cl ON cl.rk = pk.pick GROUP BY 1, 2 UNION ALL SELECT -1, chemical, 1 FROM cl),
 fm AS (SELECT draw, model, fold, {_moment_pcc('fc')} AS fc_pcc, {_moment_pcc('ctx')} AS context_residual_pcc, {_moment_pcc('high')} AS high_effect_pcc,
   CASE WHEN sum(w * n_high_hit) > 0 THEN 2 * sum(w * n_high_hit) / (sum(w * n_high_true) + sum(w * n_high_pred)) END AS high_effect_f1 FROM wt JOIN st USING (chemical) GROUP BY 1, 2, 3),
 mc AS (SELECT draw, model, avg(fc_pcc) AS fc_pcc, avg(context_residual_pcc) AS context_residual_pcc, avg(high_effect_pcc) AS high_effect_pcc, avg(high_effect_f1) AS high_effect_f1 FROM fm GROUP BY 1, 2),
 lg AS (SELECT * FROM mc UNPIVOT (score FOR metric IN (fc_pcc, context_residual_pcc, high_effect_pcc, high_effect_f1))),
 dl AS (SELECT a.draw, a.metric, a.score - b.score AS d FROM lg a JOIN lg b ON a.draw = b.draw AND a.metric = b.metric AND a.model = 'm1' AND b.model = 'm0')
SELECT metric, r6(max(d) FILTER (WHERE draw = -1)) AS mean_delta, r6(quantile_cont(CASE WHEN draw >= 0 THEN d END, 0.025)) AS ci_low, r6(quantile_cont(CASE WHEN draw >= 0 THEN d END, 0.975)) AS ci_high,
  r6(avg(CASE WHEN round(d, 12) > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE draw >= 0)) AS p_delta_gt_zero, (SELECT count(*) FROM cl) AS n_clusters FROM dl GROUP BY 1
"""


@query("k03_paired_cluster_bootstrap", cluster_boot_sql("v_cstat"))
def k03(star: Star) -> DataFrame:
    stats = written(cluster_stats(Study(star)), "cluster-stats")
    return rounded(inference.cluster_bootstrap(stats, "chemical", "m1", "m0", draws=DRAWS), ["metric"])


@query("k04_subset_fold_confirmation", cluster_boot_sql("(SELECT * FROM v_cstat WHERE fold NOT IN (0, 2))"))
def k04(star: Star) -> DataFrame:
    stats = written(cluster_stats(Study(star)), "cluster-stats")
    # Confirmation drops the folds used for design; clusters without data leave with them.
    confirm = stats.filter(~F.col("fold").isin(0, 2))
    return rounded(inference.cluster_bootstrap(confirm, "chemical", "m1", "m0", draws=DRAWS), ["metric"])


SEEDS = (42, 52, 62)
SEED_ALPHA = {42: 1.0, 52: 8.0, 62: 64.0}
AXES = {"chemical": ["chemical"], "strain": ["strain"], "strain+chemical": ["strain", "chemical"]}


def seeded_cells(star: Star) -> DataFrame:
    """Scored cells of three seeds: strain-shrunk members against the protein mean."""
    study = Study(star)
    scored = study.predicted(study.scored.drop("m0", "m1", "m2"), {f"s{seed}": alpha for seed, alpha in SEED_ALPHA.items()})
    options = F.array(*[F.struct(F.lit(seed).alias("model_seed"), (F.col(f"s{seed}") - F.col("control")).alias("candidate_delta")) for seed in SEEDS])
    rows = scored.withColumn("_s", F.explode(options)).select("*", "_s.*")
    return rows.withColumn("control_delta", F.col("m0") - F.col("control")).withColumnRenamed("split", "scenario")


view(
    "v_seeded",
    """
SELECT split AS scenario, strain, chemical, t, ctx, drug, m0 - c AS p0, seed AS model_seed, CASE seed WHEN 42 THEN ma - c WHEN 52 THEN m1 - c ELSE mb - c END AS p1
FROM v_score CROSS JOIN (SELECT unnest([42, 52, 62]) AS seed)
""",
)
_AXIS_SQL = {"chemical": "chemical", "strain": "strain", "strain+chemical": "strain || chr(31) || chemical"}
view(
    "v_units",
    "SELECT model_seed, scenario, cluster_axis, heldout_entity, a.metric, b.score AS control_value, a.score AS candidate_value, a.score - b.score AS delta FROM "
    + " JOIN ".join(
        f"(SELECT model_seed, scenario, cluster_axis, heldout_entity, metric, score FROM ("
        + " UNION ALL ".join(
            f"SELECT model_seed, scenario, '{axis}' AS cluster_axis, {key} AS heldout_entity, {response(p, 't')} FROM v_seeded GROUP BY model_seed, scenario, {key}" for axis, key in _AXIS_SQL.items()
        )
        + f") UNPIVOT INCLUDE NULLS (score FOR metric IN ({', '.join(GRID_METRICS)}))) {alias}"
        for p, alias in (("p1", "a"), ("p0", "b"))
    )
    + " USING (model_seed, scenario, cluster_axis, heldout_entity, metric)".replace("USING", "USING"),
)


@query(
    "k05_heldout_entity_units",
    "SELECT CAST(model_seed AS BIGINT) AS model_seed, scenario, cluster_axis, heldout_entity, metric, control_value, candidate_value, r6(delta) AS delta FROM v_units",
)
def k05(star: Star) -> DataFrame:
    units = inference.entity_units(seeded_cells(star), AXES, ["model_seed", "scenario"], GRID_METRICS)
    out = rounded(units, ["scenario", "cluster_axis", "heldout_entity", "metric"])
    return out.withColumn("model_seed", F.col("model_seed").cast("bigint")).withColumn("delta", r6(F.col("candidate_value") - F.col("control_value")))


view(
    "v_seed_mean",
    "SELECT scenario, cluster_axis, metric, heldout_entity, max(delta) FILTER (WHERE model_seed = 42) AS s42, max(delta) FILTER (WHERE model_seed = 52) AS s52, max(delta) FILTER (WHERE model_seed = 62) AS s62 "
    "FROM v_units GROUP BY 1, 2, 3, 4 HAVING count(delta) = 3",
)
view(
    "v_promo",
    "SELECT b.*, s42_mean, s52_mean, s62_mean, s42_mean > 0 AND s52_mean > 0 AND s62_mean > 0 AS all_seeds_positive, least(s42_mean, s52_mean, s62_mean) AS min_seed_mean FROM "
    + boot_sql("SELECT scenario, cluster_axis, metric, heldout_entity AS unit, (s42 + s52 + s62) / 3 AS v FROM v_seed_mean", ["scenario", "cluster_axis", "metric"], 20260813, GATE_DRAWS)
    + " b JOIN (SELECT scenario, cluster_axis, metric, avg(s42) AS s42_mean, avg(s52) AS s52_mean, avg(s62) AS s62_mean FROM v_seed_mean GROUP BY 1, 2, 3) s USING (scenario, cluster_axis, metric)",
)


def promotion_stats(star: Star) -> DataFrame:
    """Bootstrapped entity statistics per (scenario, axis, metric), drawn once per application."""
    return star.stored("promotion-stats", lambda: _drawn_promotion_stats(star))


def _drawn_promotion_stats(star: Star) -> DataFrame:
    return _drawn_stats(seeded_cells(star), "entity-units")


def _drawn_stats(cells: DataFrame, label: str) -> DataFrame:
    units = inference.entity_units(cells, AXES, ["model_seed", "scenario"], GRID_METRICS)
    units = units.withColumn("delta", F.round("candidate_value", 6) - F.round("control_value", 6))
    units = written(units, label)
    return inference.seed_averaged_bootstrap(units, ["scenario", "cluster_axis", "metric"], SEEDS, GATE_DRAWS)


@query(
    "k06_seed_averaged_entity_bootstrap",
    "SELECT scenario, cluster_axis, metric, n_units, r6(mean_delta) AS mean_delta, r6(ci_low) AS ci_low, r6(ci_high) AS ci_high, r6(s42_mean) AS seed_42_mean, r6(min_seed_mean) AS min_seed_mean, all_seeds_positive FROM v_promo",
)
def k06(star: Star) -> DataFrame:
    stats = promotion_stats(star).select("scenario", "cluster_axis", "metric", "n_units", "mean_delta", "ci_low", "ci_high", "seed_42_mean", "min_seed_mean", "all_seeds_positive")
    return rounded(stats, ["scenario", "cluster_axis", "metric"])


@query(
    "k07_paired_entity_comparison",
    "SELECT scenario, chemical, max(delta) FILTER (WHERE candidate = 'm1') AS m1_delta, r6(max(delta) FILTER (WHERE candidate = 'm2')) AS m2_delta FROM (SELECT candidate, scenario, chemical, metric, r6(delta) AS delta FROM v_entity_delta) WHERE metric = 'fc_pcc' GROUP BY 1, 2",
)
def k07(star: Star) -> DataFrame:
    table = entity_deltas(Study(star)).filter(F.col("metric") == "fc_pcc")
    pick = lambda model: r6(F.max(F.when(F.col("candidate") == model, F.col("delta")))).alias(f"{model}_delta")
    return table.groupBy("scenario", "chemical").agg(pick("m1"), pick("m2"))


@query(
    "k08_paired_fold_deltas",
    f"""
WITH s AS (SELECT fold, model, {response('p', 't', drug='NULL::DOUBLE')} FROM (SELECT fold, 'm0' AS model, m0 - c AS p, t, ctx FROM v_oof UNION ALL SELECT fold, 'm1', m1 - c, t, ctx FROM v_oof) GROUP BY 1, 2),
 l AS (SELECT * FROM (SELECT fold, model, fc_pcc, context_residual_pcc, high_effect_pcc, high_effect_f1 FROM s) UNPIVOT (score FOR metric IN (fc_pcc, context_residual_pcc, high_effect_pcc, high_effect_f1))),
 d AS (SELECT a.fold, a.metric, a.score - b.score AS d FROM l a JOIN l b ON a.fold = b.fold AND a.metric = b.metric AND a.model = 'm1' AND b.model = 'm0')
SELECT metric, count(*) AS n_paired_folds, r6(avg(d)) AS mean_delta, r6(stddev_samp(d)) AS std_delta, r6(min(d)) AS min_delta FROM d GROUP BY 1
""",
)
def k08(star: Star) -> DataFrame:
    stats = metrics.merged_moments(cluster_stats(Study(star)), ["model", "fold"])
    names = ["fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1"]
    scores = rounded(metrics.scores_from_moments(stats, ["model", "fold"]).select("model", "fold", *names), ["model"])
    long = scores.unpivot(["model", "fold"], names, "metric", "score")
    wide = long.groupBy("fold", "metric").agg(
        (F.max(F.when(F.col("model") == "m1", F.col("score"))) - F.max(F.when(F.col("model") == "m0", F.col("score")))).alias("d")
    )
    return rounded(
        wide.groupBy("metric").agg(
            F.count("d").alias("n_paired_folds"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("std_delta"), F.min("d").alias("min_delta")
        ),
        ["metric"],
    )


# ---------------------------------------------------------------------- associations
TARGETS = ("strain", "data_source", "medium", "temperature", "chemical")
view(
    "v_cont",
    "SELECT target, plate AS u, v, count(*) AS n FROM (SELECT plate, strain, data_source, medium, temperature, chemical FROM v_samples) UNPIVOT (v FOR target IN (strain, data_source, medium, temperature, chemical)) GROUP BY 1, 2, 3",
)
view(
    "v_assoc",
    """
SELECT target, count(DISTINCT v) AS target_levels, sqrt((sum(n * n * 1.0 / (nu * nv)) - 1) / (least(max(cu), max(cv)) - 1)) AS cramers_v,
  sum(n * 1.0 / total * ln(n * total * 1.0 / (nu * nv))) / ((max(hu) + max(hv)) / 2) AS nmi, max(pu) AS purity_u_to_v, max(pv) AS purity_v_to_u
FROM v_cont JOIN (SELECT target, u, sum(n) AS nu FROM v_cont GROUP BY 1, 2) USING (target, u) JOIN (SELECT target, v, sum(n) AS nv FROM v_cont GROUP BY 1, 2) USING (target, v)
JOIN (SELECT target, sum(n) AS total, count(DISTINCT u) AS cu, count(DISTINCT v) AS cv FROM v_cont GROUP BY 1) USING (target)
JOIN (SELECT target, -sum(nu / tot * ln(nu / tot)) AS hu, sum(mx) / max(tot) AS pu FROM (SELECT target, u, CAST(sum(n) AS DOUBLE) AS nu, max(n) AS mx FROM v_cont GROUP BY 1, 2) JOIN (SELECT target, CAST(sum(n) AS DOUBLE) AS tot FROM v_cont GROUP BY 1) USING (target) GROUP BY 1) USING (target)
JOIN (SELECT target, -sum(nv / tot * ln(nv / tot)) AS hv, sum(mx) / max(tot) AS pv FROM (SELECT target, v, CAST(sum(n) AS DOUBLE) AS nv, max(n) AS mx FROM v_cont GROUP BY 1, 2) JOIN (SELECT target, CAST(sum(n) AS DOUBLE) AS tot FROM v_cont GROUP BY 1) USING (target) GROUP BY 1) USING (target)
GROUP BY 1
""",
)


def plate_counts(star: Star) -> DataFrame:
    return inference.contingency(star.samples, "plate", TARGETS)


@query("k09_cramers_v", "SELECT target, target_levels, r6(cramers_v) AS cramers_v FROM v_assoc")
def k09(star: Star) -> DataFrame:
    table = inference.associations(plate_counts(star))
    return table.select("target", "target_levels", r6("cramers_v").alias("cramers_v"))


@query("k10_weighted_purity", "SELECT target, r6(purity_u_to_v) AS purity_u_to_v, r6(purity_v_to_u) AS purity_v_to_u FROM v_assoc")
def k10(star: Star) -> DataFrame:
    table = inference.associations(plate_counts(star))
    return table.select("target", r6("purity_u_to_v").alias("purity_u_to_v"), r6("purity_v_to_u").alias("purity_v_to_u"))


@query("k11_normalised_mutual_information", "SELECT target, r6(nmi) AS nmi FROM v_assoc")
def k11(star: Star) -> DataFrame:
    return inference.associations(plate_counts(star)).select("target", r6("normalized_mutual_information").alias("nmi"))


PERMUTATIONS = 200


view(
    "v_null",
    f"""
SELECT target, max(o.nmi) AS observed, avg(m.nmi) AS null_mean, quantile_cont(m.nmi, 0.95) AS null_p95, (1.0 + count(*) FILTER (WHERE m.nmi >= o.nmi)) / (1 + count(*)) AS p_ge_observed
FROM (WITH k AS (SELECT sample_id, plate, {", ".join(TARGETS)}, draw, CAST(draw AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR) AS kk FROM v_samples CROSS JOIN (SELECT unnest(range({PERMUTATIONS})) AS draw)),
 a AS (SELECT draw, {", ".join(TARGETS)}, row_number() OVER (PARTITION BY draw ORDER BY md5('991-to|' || kk)) AS rn FROM k),
 b AS (SELECT draw, plate, row_number() OVER (PARTITION BY draw ORDER BY md5('991-from|' || kk)) AS rn FROM k),
 c AS (SELECT target, draw, u, v, CAST(count(*) AS DOUBLE) AS n FROM (SELECT draw, plate AS u, {", ".join(TARGETS)} FROM a JOIN b USING (draw, rn)) UNPIVOT (v FOR target IN ({", ".join(TARGETS)})) GROUP BY 1, 2, 3, 4),
 t AS (SELECT CAST(count(*) AS DOUBLE) AS tot FROM v_samples),
 nu AS (SELECT plate AS u, CAST(count(*) AS DOUBLE) AS nu FROM v_samples GROUP BY 1), nv AS (SELECT target, v, CAST(sum(n) AS DOUBLE) AS nv FROM v_cont GROUP BY 1, 2),
 hu AS (SELECT -sum(nu / tot * ln(nu / tot)) AS h FROM nu, t), hv AS (SELECT target, -sum(nv / tot * ln(nv / tot)) AS h FROM nv, t GROUP BY 1)
 SELECT target, draw, sum(n / tot * ln(n * tot / (nu * nv))) / ((max(hu.h) + max(hv.h)) / 2) AS nmi FROM c JOIN nu USING (u) JOIN nv USING (target, v) JOIN hv USING (target), t, hu GROUP BY 1, 2) m
JOIN (SELECT target, nmi FROM v_assoc) o USING (target) GROUP BY 1
""",
)
_NULL = "r6(observed) AS observed, r6(null_mean) AS null_mean, r6(null_p95) AS null_p95, r6(p_ge_observed) AS p_ge_observed"


def permutation_null(star: Star, counts: DataFrame) -> DataFrame:
    """Null of the mutual information of every target with the plate, from shuffled plate labels."""
    drawn = shuffled.permuted_counts(star.samples.select("sample_id", "plate", *TARGETS), "sample_id", "plate", TARGETS, PERMUTATIONS, 991)
    null = written(inference.associations(drawn, ["draw", "target"]), "rank-null")
    return inference.null_summary(inference.associations(counts), null)


@query("k12_permutation_null_by_ranks", f"SELECT target, {_NULL} FROM v_null")
def k12(star: Star) -> DataFrame:
    # The samples may be made here; their shuffles go before the draws begin.
    with shuffles_dropped(star.spark):
        return rounded(permutation_null(star, written(plate_counts(star), "contingency")), ["target"])


def split_null(counts: DataFrame) -> DataFrame:
    """Null of the mutual information of every target with the plate, by hypergeometric splits of the margins."""
    drawn = written(inference.split_contingency(counts, PERMUTATIONS), "split-contingency")
    return inference.null_summary(inference.associations(counts), inference.associations(drawn, ["draw", "target"]))


@query("k12_permutation_null_by_splits")
def k12_splits(star: Star) -> DataFrame:
    return rounded(split_null(written(plate_counts(star), "contingency")), ["target"])


@query(
    "k12_split_margins",
    f"""
WITH m AS (SELECT target, 'source' AS side, u AS level, sum(n) AS n FROM v_cont GROUP BY ALL UNION ALL SELECT target, 'target', v, sum(n) FROM v_cont GROUP BY ALL)
SELECT target, side, level, n::BIGINT AS n, {PERMUTATIONS}::BIGINT AS draws FROM m
""",
)
def k12_margins(star: Star) -> DataFrame:
    """Draws in which each level of either side has each count; every draw keeps both margins."""
    drawn = written(inference.split_contingency(written(plate_counts(star), "contingency"), PERMUTATIONS), "split-contingency")
    sides = [drawn.groupBy("draw", "target", F.lit(name).alias("side"), F.col(level).alias("level")).agg(F.sum("n").alias("n")) for name, level in (("source", "u"), ("target", "v"))]
    return sides[0].unionByName(sides[1]).groupBy("target", "side", "level", "n").agg(F.count(F.lit(1)).alias("draws"))


# The mean over all shuffles in closed form: each cell's hypergeometric law, summed up.
view(
    "v_expected",
    """
WITH t AS (SELECT target, sum(n) AS tot FROM v_cont GROUP BY 1), a AS (SELECT target, u, sum(n) AS a FROM v_cont GROUP BY 1, 2), b AS (SELECT target, v, sum(n) AS b FROM v_cont GROUP BY 1, 2),
 k AS (SELECT target, a::BIGINT AS a, b::BIGINT AS b, tot::BIGINT AS tot, unnest(range(greatest(1, a + b - tot)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM a JOIN b USING (target) JOIN t USING (target)),
 mi AS (SELECT target, sum(exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(tot - a + 1) + lgamma(tot - b + 1) - lgamma(tot + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(tot - a - b + k + 1)) * k / tot * ln(k::DOUBLE * tot / (a::DOUBLE * b))) AS mi FROM k GROUP BY 1),
 hu AS (SELECT target, -sum(a / tot * ln(a / tot)) AS h FROM a JOIN t USING (target) GROUP BY 1), hv AS (SELECT target, -sum(b / tot * ln(b / tot)) AS h FROM b JOIN t USING (target) GROUP BY 1)
SELECT target, mi / ((hu.h + hv.h) / 2) AS expected FROM mi JOIN hu USING (target) JOIN hv USING (target)
""",
)


@query("k12_expected_null", "SELECT target, r6(expected) AS expected, TRUE AS mean_of_draws_agrees, p_ge_observed < 0.05 AS significant FROM v_expected JOIN v_null USING (target)")
def k12_expected(star: Star) -> DataFrame:
    """Exact mean of the null, whether the mean of the drawn one lies within five standard errors of it, and significance."""
    counts = written(plate_counts(star), "contingency")
    drawn = inference.associations(written(inference.split_contingency(counts, PERMUTATIONS), "split-contingency"), ["draw", "target"])
    drawn = written(drawn, "split-null")
    value = "normalized_mutual_information"
    means = drawn.groupBy("target").agg(F.avg(value).alias("mean"), (F.stddev(value) / F.sqrt(F.count(value))).alias("error"))
    exact = inference.expected_association(counts).join(means, "target").join(inference.null_summary(inference.associations(counts), drawn), "target")
    near = F.abs(F.col("mean") - F.col("expected_nmi")) <= 5 * F.col("error") + 1e-9
    return exact.select("target", r6("expected_nmi").alias("expected"), near.alias("mean_of_draws_agrees"), (F.col("p_ge_observed") < 0.05).alias("significant"))


@query(
    "n08_plate_association_table",
    f"SELECT target, target_levels, r6(nmi) AS nmi, r6(cramers_v) AS cramers_v, r6(purity_u_to_v) AS purity_u_to_v, r6(purity_v_to_u) AS purity_v_to_u, {_NULL} FROM v_assoc JOIN v_null USING (target)",
)
def n08(star: Star) -> DataFrame:
    """Association of every target with the plate, beside its null from shuffled plate labels."""
    with shuffles_dropped(star.spark):
        counts = written(plate_counts(star), "contingency")
        table = inference.associations(counts).withColumnRenamed("normalized_mutual_information", "nmi")
        return rounded(table.join(permutation_null(star, counts), "target"), ["target"])


@query("n08_plate_sizes", "SELECT plate, count(*) AS n_samples, count(DISTINCT data_source) AS n_sources FROM v_samples GROUP BY 1")
def n08_sizes(star: Star) -> DataFrame:
    return star.samples.groupBy("plate").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("data_source").alias("n_sources"))


# ------------------------------------------------------------------------- selection
view(
    "v_blend_abs",
    f"SELECT split, weight, r6(median(p)) AS absolute_sample_pcc_median, r6(median(r)) AS absolute_sample_r2_median FROM (SELECT split, weight, sample_id, {pcc('m', 'y')} AS p, {r2('m', 'y')} AS r FROM "
    f"(SELECT split, weight, sample_id, y, (1 - weight) * m0 + weight * m2 AS m FROM v_score CROSS JOIN {WEIGHT_SQL}) GROUP BY 1, 2, 3) GROUP BY 1, 2",
)


def full_blend_grid(study: Study) -> DataFrame:
    """Blend grid with the sample-axis medians next to the response scores."""
    cells = literal_rows(study.scored.select("split", "sample_id", "y", "m0", "m2"), [{"weight": w} for w in WEIGHTS], {"weight": "double"})
    cells = cells.withColumn("m", predict.blend(F.col("m0"), F.col("m2"), F.col("weight")))
    scores = written(metrics.axis_scores(cells, ["split", "weight"], "sample_id"), "sample-scores")
    medians = rounded(metrics.axis_medians(scores, ["split", "weight"], "absolute_sample", False), ["split", "weight"])
    return blend_grid(study).join(medians, ["split", "weight"]).withColumnRenamed("split", "scenario")


@query(
    "l01_constrained_blend_selection",
    """
WITH g AS (SELECT * FROM v_grid JOIN v_blend_abs USING (split, weight)),
 d AS (SELECT x.split AS scenario, x.weight, CASE WHEN x.split = 'val_strain_only' THEN 0.25 * (x.fc_pcc - b.fc_pcc) + 0.20 * (x.drug_residual_pcc - b.drug_residual_pcc)
   ELSE 0.05 * (x.fc_pcc - b.fc_pcc) + 0.025 * (x.absolute_sample_pcc_median - b.absolute_sample_pcc_median) + 0.025 * (x.absolute_sample_r2_median - b.absolute_sample_r2_median) END AS gain,
   coalesce(x.high_effect_pcc - b.high_effect_pcc >= -0.002 AND x.high_effect_f1 - b.high_effect_f1 >= -0.002 AND x.absolute_sample_r2_median - b.absolute_sample_r2_median >= -0.0005, false) AS guardrail_pass
   FROM g x JOIN g b ON b.split = x.split AND b.weight = 0),
 w AS (SELECT scenario, weight FROM d WHERE guardrail_pass QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY gain DESC, weight) = 1)
SELECT d.scenario, d.weight, r6(gain) AS gain, guardrail_pass, w.weight IS NOT NULL AS selected FROM d LEFT JOIN w ON w.scenario = d.scenario AND w.weight = d.weight
""",
)
def l01(star: Star) -> DataFrame:
    grid = written(full_blend_grid(Study(star)), "blend-grid")
    out = selection.select_blends(grid, ["val_strain_only"])
    return out.select("scenario", "weight", r6("gain").alias("gain"), "guardrail_pass", "selected")


view(
    "v_scale_grid",
    f"SELECT split AS scenario, strain_scale, chemical_scale, {response('p', 't')} FROM (SELECT *, m0 - c + strain_scale * (m1 - m0) + chemical_scale * (m2 - m1) AS p FROM v_score "
    f"CROSS JOIN (SELECT weight AS strain_scale FROM {WEIGHT_SQL}) CROSS JOIN (SELECT weight AS chemical_scale FROM {WEIGHT_SQL})) GROUP BY 1, 2, 3",
)


def scale_scores(study: Study) -> DataFrame:
    """All 25 strain x chemical scales of every split from one scan."""
    options = [
        {"strain_scale": s, "chemical_scale": c, "base": 1.0, "by_strain": s, "by_chemical": c} for s in predict.ALLOWED_SCALES for c in predict.ALLOWED_SCALES
    ]
    scores = predict.linear_candidate_scores(delta_components(study.scored), ["split"], PARTS, options, {"strain_scale": "double", "chemical_scale": "double"})
    return rounded(scores.withColumnRenamed("split", "scenario"), ["scenario", "strain_scale", "chemical_scale"])


_GUARDS = " AND ".join(
    [f"coalesce(x.{m} - b.{m} >= -1e-12, false)" for m in selection.RESIDUAL_METRICS] + [f"coalesce(x.{m} - b.{m} >= -0.005 - 1e-12, false)" for m in selection.HIGH_METRICS]
)


@query(
    "l02_nested_scale_selection",
    f"""
WITH d AS (SELECT x.scenario, x.strain_scale, x.chemical_scale, x.fc_pcc, {_GUARDS} AND x.fc_pcc IS NOT NULL AS guardrail_pass, r6(x.fc_pcc - b.fc_pcc) AS fc_pcc_delta_vs_zero
  FROM v_scale_grid x JOIN v_scale_grid b ON b.scenario = x.scenario AND b.strain_scale = 0 AND b.chemical_scale = 0),
 w AS (SELECT scenario, strain_scale, chemical_scale FROM d WHERE guardrail_pass QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY fc_pcc DESC, strain_scale, chemical_scale) = 1)
SELECT d.scenario, d.strain_scale, d.chemical_scale, d.fc_pcc_delta_vs_zero, d.guardrail_pass, w.scenario IS NOT NULL AS selected
FROM d LEFT JOIN w ON w.scenario = d.scenario AND w.strain_scale = d.strain_scale AND w.chemical_scale = d.chemical_scale
""",
)
def l02(star: Star) -> DataFrame:
    grid = written(scale_scores(Study(star)), "scale-grid")
    scales = ("strain_scale", "chemical_scale")
    out = selection.select_scales(grid, ["scenario"], scales=scales)
    return out.select("scenario", *scales, r6("fc_pcc_delta_vs_zero").alias("fc_pcc_delta_vs_zero"), "guardrail_pass", "selected")


SELECTORS = {"fc": (False, None), "guarded": (True, None), "high_specialist_fc": (False, "high_specialist"), "high_specialist_guarded": (True, "high_specialist")}
view(
    "v_nested",
    f"""
WITH inner_mean AS (SELECT o.k AS outer_fold, candidate, family, avg(fc_pcc) AS fc_pcc, avg(context_residual_pcc) AS context_residual_pcc, avg(high_effect_pcc) AS high_effect_pcc, avg(high_effect_f1) AS high_effect_f1
   FROM v_family_grid CROSS JOIN (SELECT unnest(range(4)) AS k) o WHERE fold <> o.k GROUP BY 1, 2, 3),
 base AS (SELECT outer_fold, high_effect_pcc AS bp, high_effect_f1 AS bf FROM inner_mean WHERE candidate = 'blend_w0'),
 s AS (SELECT selector, guarded, m.*, high_effect_pcc >= bp - 0.005 AND high_effect_f1 >= bf - 0.005 AS allowed FROM inner_mean m JOIN base USING (outer_fold)
   CROSS JOIN (VALUES ('fc', false, NULL), ('guarded', true, NULL), ('high_specialist_fc', false, 'high_specialist'), ('high_specialist_guarded', true, 'high_specialist')) AS q(selector, guarded, fam) WHERE fam IS NULL OR fam = family),
 p AS (SELECT *, max(CAST(allowed AS INT)) OVER (PARTITION BY selector, outer_fold) = 1 AS some_ok FROM s)
SELECT selector, outer_fold, candidate AS selected_candidate, fc_pcc, context_residual_pcc, high_effect_pcc FROM p WHERE NOT guarded OR NOT some_ok OR allowed
QUALIFY row_number() OVER (PARTITION BY selector, outer_fold ORDER BY fc_pcc DESC, context_residual_pcc DESC, high_effect_pcc DESC, candidate) = 1
""",
)


@query(
    "l03_leave_one_fold_out_selection",
    "SELECT selector, outer_fold, selected_candidate, r6(fc_pcc) AS inner_fc_pcc, r6(context_residual_pcc) AS inner_context_residual_pcc, r6(high_effect_pcc) AS inner_high_effect_pcc FROM v_nested",
)
def l03(star: Star) -> DataFrame:
    grid = written(family_grid(Study(star)), "family-grid")
    out = selection.nested_selection(grid, SELECTORS, FOLDS)
    keep = ["selector", "outer_fold", "selected_candidate", "inner_fc_pcc", "inner_context_residual_pcc", "inner_high_effect_pcc"]
    return rounded(out.select(*keep), ["selector", "outer_fold", "selected_candidate"])


@query(
    "l03_stitched_winners",
    f"SELECT selector, fold, count(*) AS n_cells, r6({pcc('p', 't')}) AS fc_pcc FROM v_family JOIN v_nested ON outer_fold = fold AND selected_candidate = candidate GROUP BY 1, 2",
)
def l03_stitched(star: Star) -> DataFrame:
    from cellshift.functions.moments import pearson_agg

    study = Study(star)
    winners = selection.nested_selection(written(family_grid(study), "family-grid"), SELECTORS, FOLDS)
    # Stored, so that the planner knows these few rows as the small side; by estimates the cells of all candidates looked smaller and were broadcast.
    chosen = written(winners.select("selector", F.col("outer_fold").alias("fold"), F.col("selected_candidate").alias("candidate")), "winners")
    rows = fusion_cells(study).join(chosen, ["fold", "candidate"])
    return rows.groupBy("selector", "fold").agg(F.count(F.lit(1)).alias("n_cells"), r6(pearson_agg("pred_delta", "truth_delta")).alias("fc_pcc"))


@query(
    "l04_discovery_nomination",
    """
WITH b AS (SELECT candidate, scenario, metric, r6(mean_delta) AS mean_delta, r6(ci_low) AS ci_low FROM v_boot),
 h AS (SELECT candidate, scenario, mean_delta AS hd FROM b WHERE metric = 'high_effect_pcc')
SELECT candidate, scenario, mean_delta, hd AS high_effect_delta, n AS nominate_for_confirmation, false AS promote, CASE WHEN n THEN 'candidate_for_confirmation' ELSE 'screen_only' END AS decision
FROM (SELECT b.*, hd, (mean_delta >= 0.005 OR (mean_delta >= 0.002 AND ci_low > 0)) AND coalesce(hd >= -0.005, true) AS n FROM b LEFT JOIN h USING (candidate, scenario) WHERE metric = 'fc_pcc')
""",
)
def l04(star: Star) -> DataFrame:
    table = rounded(bootstrap_table(Study(star)), ["candidate", "scenario", "metric"]).withColumn("model_seed", F.lit(42))
    out = selection.discovery_nominations(table)
    return out.select("candidate", "scenario", "mean_delta", "high_effect_delta", "nominate_for_confirmation", "promote", "decision")


REGIME_RESIDUALS = {"val_chem_only": "context_residual_pcc", "val_strain_only": "drug_residual_pcc"}
view(
    "v_regime_checks",
    """
WITH b AS (SELECT candidate, scenario, metric, r6(mean_delta) AS d, r6(ci_low) AS lo FROM v_boot WHERE scenario IN ('val_chem_only', 'val_strain_only')),
 w AS (SELECT candidate, scenario, max(d) FILTER (WHERE metric = 'fc_pcc') AS fc, max(lo) FILTER (WHERE metric = 'fc_pcc') AS fl,
   max(d) FILTER (WHERE (scenario = 'val_chem_only' AND metric = 'context_residual_pcc') OR (scenario = 'val_strain_only' AND metric = 'drug_residual_pcc')) AS rs,
   max(d) FILTER (WHERE metric = 'high_effect_pcc') AS hp, max(d) FILTER (WHERE metric = 'high_effect_f1') AS hf FROM b GROUP BY 1, 2)
SELECT candidate, scenario, coalesce(fc >= 0.005, false) OR (coalesce(fc >= 0.002, false) AND coalesce(fl > 0, false)) AS fc_nomination, coalesce(rs >= 0, false) AS residual_nonnegative,
  coalesce(hp >= -0.005, false) AS high_effect_pcc_guardrail, coalesce(hf >= -0.005, false) AS high_effect_f1_guardrail FROM w
""",
)


@query(
    "l05_regime_nomination_checks",
    "SELECT *, fc_nomination AND residual_nonnegative AND high_effect_pcc_guardrail AND high_effect_f1_guardrail AS passed FROM v_regime_checks",
)
def l05(star: Star) -> DataFrame:
    table = rounded(bootstrap_table(Study(star)), ["candidate", "scenario", "metric"])
    return selection.regime_nominations(table, REGIME_RESIDUALS)[0]


@query(
    "l05_regime_nomination_verdict",
    """
SELECT candidate, count(*) AS n_regimes, bool_and(p) AND count(*) = 2 AS nominate_for_confirmation, CASE WHEN bool_and(p) AND count(*) = 2 THEN 'confirm' ELSE 'screen_only' END AS decision
FROM (SELECT candidate, fc_nomination AND residual_nonnegative AND high_effect_pcc_guardrail AND high_effect_f1_guardrail AS p FROM v_regime_checks) GROUP BY 1
""",
)
def l05_verdict(star: Star) -> DataFrame:
    table = rounded(bootstrap_table(Study(star)), ["candidate", "scenario", "metric"])
    return selection.regime_nominations(table, REGIME_RESIDUALS)[1]


# Axis screens: which regimes decide on the scale of which expert part.
SCREEN_AXES = {"strain": ("val_chem_only",), "chemical": ("val_strain_only",), "pair": ("train", "val_time")}
view(
    "v_screen",
    f"SELECT axis, weight AS scale, split AS scenario, {response('p', 't')} FROM (SELECT *, m0 - c + weight * CASE axis WHEN 'strain' THEN m1 - m0 WHEN 'chemical' THEN m2 - m1 ELSE m2 - m0 END AS p "
    f"FROM v_score CROSS JOIN {WEIGHT_SQL} CROSS JOIN (SELECT unnest(['strain', 'chemical', 'pair']) AS axis)) GROUP BY 1, 2, 3",
)
view(
    "v_screen_rows",
    "SELECT * FROM v_screen WHERE (axis = 'strain' AND scenario = 'val_chem_only') OR (axis = 'chemical' AND scenario = 'val_strain_only') OR (axis = 'pair' AND scenario IN ('train', 'val_time'))",
)


def screen_scores(study: Study) -> DataFrame:
    """Expert-scale screen: one scaled part at a time, every regime, one scan."""
    shares = {"strain": {"by_strain": 1.0}, "chemical": {"by_chemical": 1.0}, "pair": {"by_strain": 1.0, "by_chemical": 1.0}}
    options = [
        {"axis": axis, "scale": w, "base": 1.0, **{part: share * w for part, share in parts.items()}} for axis, parts in shares.items() for w in WEIGHTS
    ]
    scores = predict.linear_candidate_scores(delta_components(study.scored), ["split"], PARTS, options, {"axis": "string", "scale": "double"})
    return rounded(scores.withColumnRenamed("split", "scenario"), ["axis", "scale", "scenario"])


@query(
    "l06_scale_grid_completeness",
    """
WITH a AS (SELECT axis, scale, count(DISTINCT scenario) AS n, bool_and(fc_pcc IS NOT NULL AND high_effect_pcc IS NOT NULL AND high_effect_f1 IS NOT NULL
  AND CASE axis WHEN 'strain' THEN context_residual_pcc IS NOT NULL WHEN 'chemical' THEN drug_residual_pcc IS NOT NULL ELSE context_residual_pcc IS NOT NULL AND drug_residual_pcc IS NOT NULL END) AS fin FROM v_screen_rows GROUP BY 1, 2)
SELECT axis, count(*) AS n_rows, list_sort(list(scale)) = [0.0, 0.25, 0.5, 0.75, 1.0] AS scales_match, bool_and(fin AND n = CASE axis WHEN 'pair' THEN 2 ELSE 1 END) AS all_usable,
  count(*) = 5 AND list_sort(list(scale)) = [0.0, 0.25, 0.5, 0.75, 1.0] AND bool_and(fin AND n = CASE axis WHEN 'pair' THEN 2 ELSE 1 END) AS valid FROM a GROUP BY 1
""",
)
def l06(star: Star) -> DataFrame:
    screen = selection.screen_table(screen_scores(Study(star)), SCREEN_AXES)
    return selection.grid_completeness(screen, WEIGHTS)


@query(
    "l07_expert_scale_selection",
    """
WITH bad AS (SELECT DISTINCT axis FROM v_screen_rows WHERE fc_pcc IS NULL OR high_effect_pcc IS NULL OR high_effect_f1 IS NULL OR (axis <> 'chemical' AND context_residual_pcc IS NULL) OR (axis <> 'strain' AND drug_residual_pcc IS NULL)),
 d AS (SELECT x.axis, x.scale, x.scenario, x.fc_pcc, x.fc_pcc - b.fc_pcc AS df, CASE x.axis WHEN 'strain' THEN x.context_residual_pcc - b.context_residual_pcc WHEN 'chemical' THEN x.drug_residual_pcc - b.drug_residual_pcc
   ELSE least(x.context_residual_pcc - b.context_residual_pcc, x.drug_residual_pcc - b.drug_residual_pcc) END AS dr, x.high_effect_pcc - b.high_effect_pcc AS dp, x.high_effect_f1 - b.high_effect_f1 AS dh
  FROM v_screen_rows x JOIN v_screen_rows b ON b.axis = x.axis AND b.scenario = x.scenario AND b.scale = 0 WHERE x.axis NOT IN (SELECT axis FROM bad)),
 a AS (SELECT axis, scale, avg(fc_pcc) AS fc, avg(df) AS fd, min(dr) AS rd, min(dp) AS hp, min(dh) AS hf FROM d GROUP BY 1, 2),
 g AS (SELECT *, CASE WHEN axis = 'pair' THEN least(hp, hf) ELSE hp END AS hd, coalesce(rd >= -1e-12, false) AND coalesce(hp >= -0.005, false) AND coalesce(hf >= -0.005, false) AS ok FROM a),
 w AS (SELECT axis, scale FROM g WHERE ok QUALIFY row_number() OVER (PARTITION BY axis ORDER BY fc DESC, rd DESC, hd DESC, scale) = 1)
SELECT g.axis, g.scale, r6(fc) AS fc_macro, r6(fd) AS fc_delta_vs_zero, r6(rd) AS residual_delta_vs_zero, ok AS guardrail_pass, w.axis IS NOT NULL AS selected FROM g LEFT JOIN w ON w.axis = g.axis AND w.scale = g.scale
""",
)
def l07(star: Star) -> DataFrame:
    scores = written(screen_scores(Study(star)), "screen")
    out = selection.select_screen(scores, SCREEN_AXES, WEIGHTS)
    keep = ["axis", "scale", "fc_macro", "fc_delta_vs_zero", "residual_delta_vs_zero", "guardrail_pass", "selected"]
    return rounded(out.select(*keep), ["axis", "scale"])


# Calibration screen: experiments stand for blend weights; (id, weight, rank, dropout).
EXPERIMENTS = [("no_plate", 0.0, 0, 0.0), ("rank4", 0.25, 4, 0.0), ("rank4_dropout", 0.5, 4, 0.5), ("rank8", 0.75, 8, 0.0), ("plate_shuffle", 1.0, 4, 0.0)]
PROFILE = {
    "macro_fc": ("fc_pcc", ("val_chem_only", "val_strain_only", "val_both", "val_time", "train")),
    "context_residual_macro": ("context_residual_pcc", ("val_chem_only", "val_time", "train")),
    "drug_residual_macro": ("drug_residual_pcc", ("val_strain_only", "val_time", "train")),
    "high_effect_pcc_macro": ("high_effect_pcc", ("val_chem_only", "val_strain_only", "val_both", "val_time", "train")),
    "high_effect_f1_macro": ("high_effect_f1", ("val_chem_only", "val_strain_only", "val_time", "train")),
    "plate_fc": ("fc_pcc", ("train",)),
}


def _profile_sql() -> str:
    parts = []
    for name, (metric, regimes) in PROFILE.items():
        inside = "split IN (" + ", ".join(f"'{r}'" for r in regimes) + ")"
        parts.append(f"CASE WHEN count({metric}) FILTER (WHERE {inside}) = {len(regimes)} THEN avg({metric}) FILTER (WHERE {inside}) END AS {name}")
    return ", ".join(parts)


_MACROS = [name for name in PROFILE if name != "macro_fc"]


@query(
    "l08_calibration_choice",
    f"""
WITH e AS (SELECT * FROM (VALUES {_values([(i, w, float(r), d) for i, w, r, d in EXPERIMENTS])}) AS e(experiment_id, weight, rk, dr)),
 p AS (SELECT experiment_id, rk, dr, {_profile_sql()} FROM e JOIN v_grid USING (weight) GROUP BY 1, 2, 3),
 g AS (SELECT x.*, {' AND '.join(f'coalesce(x.{m} - b.{m} >= -0.005, false)' for m in _MACROS)} AS ok FROM p x JOIN p b ON b.experiment_id = 'no_plate'),
 w AS (SELECT experiment_id FROM g WHERE ok AND experiment_id NOT IN ('no_plate', 'plate_shuffle') QUALIFY row_number() OVER (ORDER BY macro_fc DESC, rk, dr DESC, experiment_id) = 1),
 f AS (SELECT coalesce((SELECT experiment_id FROM w JOIN p USING (experiment_id) WHERE macro_fc > (SELECT max(macro_fc) FROM p WHERE experiment_id IN ('no_plate', 'plate_shuffle'))), 'no_plate') AS chosen)
SELECT experiment_id, r6(macro_fc) AS macro_fc, r6(drug_residual_macro) AS drug_residual_macro, ok AS guardrails_pass, experiment_id = 'no_plate' OR (experiment_id <> 'plate_shuffle' AND ok) AS selection_eligible, experiment_id = (SELECT chosen FROM f) AS selected FROM g
""",
)
def l08(star: Star) -> DataFrame:
    grid = literal_rows(
        blend_grid(Study(star)),
        [{"experiment_id": i, "_w": w, "calibration_rank": r, "calibration_dropout": d} for i, w, r, d in EXPERIMENTS],
        {"experiment_id": "string", "_w": "double", "calibration_rank": "int", "calibration_dropout": "double"},
    ).filter(F.col("_w") == F.col("weight"))
    keys = ["experiment_id", "calibration_rank", "calibration_dropout"]
    profiles = written(metrics.selection_profile(grid, keys, "split", PROFILE), "profiles")
    out = selection.select_calibration(profiles, "no_plate", "plate_shuffle")
    return out.select("experiment_id", r6("macro_fc").alias("macro_fc"), r6("drug_residual_macro").alias("drug_residual_macro"), "guardrails_pass", "selection_eligible", "selected")


# ------------------------------------------------------------------------- promotion
def _passed_sql(threshold: str) -> str:
    return f"""CASE WHEN metric = 'fc_pcc' THEN n_units >= 2 AND coalesce(mean_delta >= {threshold}, false) AND coalesce(ci_low > 0, false) AND all_seeds_positive
  WHEN metric IN ('context_residual_pcc', 'drug_residual_pcc') THEN n_units >= 2 AND coalesce(mean_delta > 0, false) AND coalesce(ci_low > 0, false) AND all_seeds_positive
  ELSE n_units >= 2 AND coalesce(mean_delta >= -0.005, false) AND coalesce(min_seed_mean >= -0.005, false) END"""


@query("l09_promotion_checks", f"SELECT scenario, cluster_axis, metric, n_units, {_passed_sql('0.01')} AS passed FROM v_promo")
def l09(star: Star) -> DataFrame:
    return selection.promotion_checks(promotion_stats(star)).select("scenario", "cluster_axis", "metric", "n_units", "passed")


# Axes and residuals that each scenario must show; plates are asked of the time split and never scored, so it is blocked.
GATE_AXES = {"val_chem_only": ["chemical"], "val_strain_only": ["strain"], "val_both": ["chemical", "strain", "strain+chemical"], "val_time": ["strain+chemical", "plate"]}
GATE_RESIDUALS = {"val_chem_only": ["context_residual_pcc"], "val_strain_only": ["drug_residual_pcc"], "val_both": ["context_residual_pcc", "drug_residual_pcc"], "val_time": ["context_residual_pcc"]}
_GATE_SQL = ", ".join(
    f"('{scenario}', '{axis}', '{metric}')" for scenario in GATE_AXES for axis in GATE_AXES[scenario] for metric in ("fc_pcc", *GATE_RESIDUALS[scenario], *selection.HIGH_METRICS)
)


@query(
    "l09_promotion_verdict",
    f"""
SELECT scenario, count(*) AS n_checks, count(*) FILTER (WHERE passed) AS n_passed, bool_and(passed) AND bool_or(metric IN ('context_residual_pcc', 'drug_residual_pcc')) AS promoted,
  coalesce(array_to_string(list_sort(list(scenario || '/' || cluster_axis || '/' || metric) FILTER (WHERE NOT passed)), '; '), '') AS reasons
FROM (SELECT e.*, coalesce(p.passed, false) AS passed FROM (VALUES {_GATE_SQL}) e(scenario, cluster_axis, metric)
      LEFT JOIN (SELECT *, {_passed_sql('0.01')} AS passed FROM v_promo) p USING (scenario, cluster_axis, metric)) GROUP BY 1
""",
)
def l09_verdict(star: Star) -> DataFrame:
    checks = selection.promotion_checks(promotion_stats(star)).withColumn("_by", F.col("scenario"))
    expected = selection.expected_checks(star.spark, GATE_AXES, GATE_RESIDUALS).withColumn("_by", F.col("scenario"))
    # The verdict groups by scenario; the scenario also labels the reasons.
    return selection.promotion_verdict(checks, ["_by"], expected).withColumnRenamed("_by", "scenario")


@query(
    "l10_strain_verdict_at_two_thresholds",
    f"""
WITH c AS (SELECT scenario, 'primary' AS comparison, bool_and({_passed_sql('0.01')}) AND bool_or(metric LIKE '%residual%') AS promoted FROM v_promo WHERE cluster_axis = 'strain' GROUP BY 1
 UNION ALL SELECT scenario, 'negative_control', bool_and({_passed_sql('0.0')}) AND bool_or(metric LIKE '%residual%') FROM v_promo WHERE cluster_axis = 'strain' GROUP BY 1)
SELECT scenario, count(*) AS n_comparisons, bool_and(promoted) AS promoted FROM c GROUP BY 1
""",
)
def l10(star: Star) -> DataFrame:
    stats = written(promotion_stats(star).filter(F.col("cluster_axis") == "strain"), "promotion")
    spread = literal_rows(
        stats,
        [{"comparison": "primary", "_t": selection.PRIMARY_FC_MIN_DELTA}, {"comparison": "negative_control", "_t": selection.NEGATIVE_CONTROL_FC_MIN_DELTA}],
        {"comparison": "string", "_t": "double"},
    )
    checks = selection.promotion_checks(spread, F.col("_t")).withColumn("_by", F.col("scenario"))
    verdicts = selection.promotion_verdict(checks, ["_by", "comparison"]).withColumnRenamed("_by", "scenario")
    return selection.combined_verdict(verdicts, ["scenario"])


# Negative control: the candidate with strain labels rotated by name, so every strain takes another one's effect.
def negative_control_cells(star: Star) -> DataFrame:
    """Scored cells of the three seeds against the same members with rotated strains."""
    study = Study(star)
    alphas = {f"s{seed}": alpha for seed, alpha in SEED_ALPHA.items()}
    own = study.predicted(study.scored.drop("m0", "m1", "m2"), alphas)
    strains = star.samples.select("strain").distinct()
    order = Window.orderBy("strain")
    first = strains.agg(F.min("strain")).scalar()
    donors = strains.select("strain", F.coalesce(F.lead("strain").over(order), first).alias("_donor"))
    moved = own.drop("m0", "m1", "m2").withColumnsRenamed({name: f"_{name}" for name in alphas})
    moved = moved.join(donors, "strain").withColumnsRenamed({"strain": "_own", "_donor": "strain"})
    both = study.predicted(moved, alphas).drop("strain").withColumnRenamed("_own", "strain")
    options = F.array(
        *[
            F.struct(F.lit(seed).alias("model_seed"), (F.col(f"_s{seed}") - F.col("control")).alias("candidate_delta"), (F.col(f"s{seed}") - F.col("control")).alias("control_delta"))
            for seed in SEEDS
        ]
    )
    return both.withColumn("_s", F.explode(options)).select("*", "_s.*").withColumnRenamed("split", "scenario")


view(
    "v_donor",
    "SELECT strain, coalesce(lead(strain) OVER (ORDER BY strain), min(strain) OVER ()) AS donor FROM (SELECT DISTINCT strain FROM v_samples)",
)
view(
    "v_neg_seeded",
    """
SELECT split AS scenario, s.strain, chemical, t, ctx, drug, seed AS model_seed, m0 + coalesce(sn / (sn + alpha) * (sm - m0), 0) - c AS p0, CASE seed WHEN 42 THEN ma - c WHEN 52 THEN m1 - c ELSE mb - c END AS p1
FROM v_score s JOIN v_donor USING (strain) LEFT JOIN v_sm x ON x.strain = donor AND x.protein = s.protein CROSS JOIN (VALUES (42, 1.0), (52, 8.0), (62, 64.0)) AS e(seed, alpha)
""",
)
view("v_neg_units", VIEWS["v_units"].replace("v_seeded", "v_neg_seeded"))
view("v_neg_seed_mean", VIEWS["v_seed_mean"].replace("v_units", "v_neg_units"))
view("v_neg_promo", VIEWS["v_promo"].replace("v_seed_mean", "v_neg_seed_mean"))


def negative_control_stats(star: Star) -> DataFrame:
    """Bootstrapped entity statistics of the candidate against the negative control."""
    return star.stored("negative-control-stats", lambda: _drawn_stats(negative_control_cells(star), "negative-control-units"))


@query(
    "l10_multi_comparison_verdict",
    f"""
WITH s AS (SELECT 'primary' AS comparison, scenario, cluster_axis, metric, {_passed_sql('0.01')} AS passed FROM v_promo
  UNION ALL SELECT 'negative_control', scenario, cluster_axis, metric, {_passed_sql('0.0')} FROM v_neg_promo),
 c AS (SELECT comparison, scenario, bool_and(coalesce(passed, false)) AND bool_or(metric LIKE '%residual%') AS promoted, count(*) FILTER (WHERE passed) AS n_passed, count(*) AS n_checks
  FROM (VALUES {_GATE_SQL}) e(scenario, cluster_axis, metric) CROSS JOIN (SELECT unnest(['primary', 'negative_control']) AS comparison) LEFT JOIN s USING (comparison, scenario, cluster_axis, metric) GROUP BY 1, 2)
SELECT scenario, count(*) AS n_comparisons, sum(n_checks)::BIGINT AS n_checks, sum(n_passed)::BIGINT AS n_passed, bool_and(promoted) AS promoted FROM c GROUP BY 1
""",
)
def l10_gated(star: Star) -> DataFrame:
    primary = selection.promotion_checks(promotion_stats(star), selection.PRIMARY_FC_MIN_DELTA)
    negative = selection.promotion_checks(negative_control_stats(star), selection.NEGATIVE_CONTROL_FC_MIN_DELTA)
    return gated_comparisons({"primary": primary, "negative_control": negative})


def gated_comparisons(checks: dict[str, DataFrame]) -> DataFrame:
    """Every comparison must show and pass each scenario's required rows."""
    verdicts = []
    for name, found in checks.items():
        expected = selection.expected_checks(found.sparkSession, GATE_AXES, GATE_RESIDUALS).withColumn("_by", F.col("scenario"))
        verdict = selection.promotion_verdict(found.withColumn("_by", F.col("scenario")), ["_by"], expected)
        verdicts.append(verdict.select(F.col("_by").alias("scenario"), F.lit(name).alias("comparison"), "n_checks", "n_passed", "promoted"))
    rows = reduce(DataFrame.unionByName, verdicts)
    sums = rows.groupBy("scenario").agg(F.sum("n_checks").alias("n_checks"), F.sum("n_passed").alias("n_passed"))
    return selection.combined_verdict(rows, ["scenario"]).join(sums, "scenario")


@query(
    "l11_receipt_audit",
    f"""
WITH f AS (SELECT fold, {digest_sum("sha256(CAST(sample_id AS VARCHAR) || '/' || protein)")} AS h FROM v_oof GROUP BY 1),
 r AS (SELECT producer, seed, fold, h, CASE WHEN producer = 'joint' AND fold = 2 THEN 'drift' ELSE h END AS copied, CASE WHEN producer = 'expert-frozen' AND fold = 1 THEN 'moved' WHEN producer = 'joint' THEN 'tuned' ELSE h END AS final
   FROM f CROSS JOIN (SELECT unnest(['base', 'expert-frozen', 'joint']) AS producer) CROSS JOIN (SELECT unnest([42, 52]) AS seed))
SELECT producer, CAST(seed AS BIGINT) AS model_seed, fold, copied = h AS copy_matches_parent, producer <> 'expert-frozen' OR final = h AS frozen_final_matches_parent,
  copied = h AND (producer <> 'expert-frozen' OR final = h) AS receipt_valid FROM r
""",
)
def l11(star: Star) -> DataFrame:
    cells = Study(star).oof
    digests = cells.groupBy("fold").agg(multiset_digest(F.sha2(F.concat_ws("/", F.col("sample_id").cast("string"), "protein"), 256)).alias("h"))
    options = [{"producer": p, "model_seed": s} for p in ("base", "expert-frozen", "joint") for s in (42, 52)]
    rows = literal_rows(digests, options, {"producer": "string", "model_seed": "bigint"})
    producer, fold, h = F.col("producer"), F.col("fold"), F.col("h")
    receipts = rows.withColumns(
        {
            "scenario": F.lit("R10"),
            "source_sha": F.lit("source"),
            "parent_sha": h,
            "copied_sha": F.when((producer == "joint") & (fold == 2), "drift").otherwise(h),
            "post_sha": h,
            "final_sha": F.when((producer == "expert-frozen") & (fold == 1), "moved").when(producer == "joint", "tuned").otherwise(h),
            "declared_unchanged": F.lit(True),
            "is_frozen": producer == "expert-frozen",
        }
    )
    out = selection.receipt_audit(receipts, "base")
    return out.select("producer", "model_seed", "fold", "copy_matches_parent", "frozen_final_matches_parent", "receipt_valid")


@query(
    "p01_best_row_per_scenario",
    "SELECT split AS scenario, weight, fc_pcc FROM v_grid QUALIFY row_number() OVER (PARTITION BY split ORDER BY fc_pcc DESC, weight) = 1",
)
def p01_best(star: Star) -> DataFrame:
    from cellshift.operators.ranking import best_per_group

    best = best_per_group(blend_grid(Study(star)), ["split"], [("fc_pcc", True), ("weight", False)])
    return best.select(F.col("split").alias("scenario"), "weight", "fc_pcc")


