"""Mask-aware metrics as grouped aggregates over one scored cell table.

A *scored* table holds one row per cell with ``truth_delta``, ``pred_delta``,
``context_ref`` and ``drug_ref`` (null where undefined); an *absolute* table
holds ``y`` (truth) and ``m`` (prediction).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions.moments import (
    STD_FLOOR,
    high_effect_scores,
    merge_aggs,
    pearson_agg,
    pearson_from_moments,
    r2_agg,
)
from cellshift.functions.numbers import ratio
from cellshift.operators.quantiles import exact_quantile
from cellshift.session import written

RESPONSE_METRICS = (
    "fc_pcc",
    "context_residual_pcc",
    "drug_residual_pcc",
    "high_effect_direction_accuracy",
    "high_effect_pcc",
    "high_effect_precision",
    "high_effect_recall",
    "high_effect_f1",
)

ABSOLUTE_METRICS = (
    "absolute_sample_pcc_median",
    "absolute_sample_r2_median",
    "absolute_protein_pcc_median",
    "absolute_protein_r2_median",
)


# ---------------------------------------------------------------- absolute fit
def rmse(prediction: str = "m", truth: str = "y") -> Column:
    """Root mean squared error over observed cells."""
    error = F.col(prediction) - F.col(truth)
    return F.sqrt(F.avg(error * error))


def mae(prediction: str = "m", truth: str = "y") -> Column:
    return F.avg(F.abs(F.col(prediction) - F.col(truth)))


def loss_report(cells: DataFrame, by: Sequence[str], prediction: str = "m", truth: str = "y", delta: float = 1.0) -> DataFrame:
    """Elementwise losses on a prediction table: MSE, Huber, half MSE + half MAE, 1 - PCC."""
    error = F.col(prediction) - F.col(truth)
    size = F.abs(error)
    huber = F.when(size <= delta, F.lit(0.5) * error * error).otherwise(F.lit(delta) * (size - F.lit(0.5 * delta)))
    return cells.groupBy(*by).agg(
        F.count(error).alias("n_values"),
        F.avg(error * error).alias("mse"),
        F.avg(huber).alias("huber"),
        (F.lit(0.5) * F.avg(error * error) + F.lit(0.5) * F.avg(size)).alias("mse_mae"),
        (F.lit(1.0) - pearson_agg(prediction, truth)).alias("one_minus_pcc"),
    )


def axis_scores(cells: DataFrame, by: Sequence[str], axis: str, prediction: str = "m", truth: str = "y") -> DataFrame:
    """PCC and R2 of every sample (or protein) inside each group.

    The protein-axis R2 needs a strictly positive spread, the sample-axis R2 one
    above the numerical floor.
    """
    floor = 0.0 if axis == "protein" else 1e-8
    return cells.groupBy(*by, axis).agg(
        F.count(F.when(F.col(prediction).isNotNull() & F.col(truth).isNotNull(), F.lit(1))).alias("n_values"),
        pearson_agg(prediction, truth).alias("pcc"),
        r2_agg(prediction, truth, sst_floor=floor).alias("r2"),
    )


def axis_medians(scores: DataFrame, by: Sequence[str], prefix: str, bounded_axis: bool) -> DataFrame:
    """Median PCC and R2 over the axis.

    Proteins are the columns of the matrix, so their exact percentile fits one
    buffer; samples are unbounded and use the two-pass exact quantile, both
    scores in the same two passes.
    """
    by = list(by)
    names = {"pcc": f"{prefix}_pcc_median", "r2": f"{prefix}_r2_median"}
    if bounded_axis:
        return scores.groupBy(*by).agg(*[F.percentile(kind, 0.5).alias(name) for kind, name in names.items()])
    long = scores.unpivot(by, ["pcc", "r2"], "_kind", "_score")
    medians = exact_quantile(long, [*by, "_kind"], "_score", 0.5, "_median")
    return medians.groupBy(*by).agg(*[F.max(F.when(F.col("_kind") == kind, F.col("_median"))).alias(name) for kind, name in names.items()])


def absolute_fidelity(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and the four medians of one absolute table, per group.

    The per-sample scores are a thousandth of the cells; they are written once
    because the counts and both quantile passes read them.
    """
    by = list(by)
    per_sample = written(axis_scores(cells, by, "sample_id"), "sample-scores")
    sample = axis_medians(per_sample, by, "absolute_sample", bounded_axis=False)
    protein = axis_medians(axis_scores(cells, by, "protein"), by, "absolute_protein", bounded_axis=True)
    counts = per_sample.groupBy(*by).agg(
        F.count(F.lit(1)).alias("absolute_n_samples"), F.sum("n_values").alias("absolute_n_observed_values")
    )
    return counts.join(sample, by, "left").join(protein, by, "left")


def regression_report(cells: DataFrame, by: Sequence[str], prediction: str = "m", truth: str = "y") -> DataFrame:
    """Pooled RMSE and R2 with the protein median, per group."""
    by = list(by)
    pooled = cells.groupBy(*by).agg(
        F.countDistinct("sample_id").alias("n_samples"),
        F.count(truth).alias("n_observed_values"),
        rmse(prediction, truth).alias("log2_rmse"),
        r2_agg(prediction, truth, min_rows=1, sst_floor=0.0).alias("global_r2"),
    )
    protein = axis_scores(cells, by, "protein", prediction, truth).groupBy(*by).agg(
        F.percentile("r2", 0.5).alias("protein_r2_median"), F.count("r2").alias("n_evaluable_proteins")
    )
    return pooled.join(protein, by, "left")


# ---------------------------------------------------------------- fold changes
MASKS = ("fc", "ctx", "drug", "high")


def masked_pairs(scored: DataFrame, keep: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """One narrow row per cell: the (x, y) pair of every score, null where it does not count.

    Masks and differences are evaluated once here, so that the aggregates below
    work on plain columns and stay small generated code.
    """
    p, t, ctx, drug = [F.col(c) for c in ("pred_delta", "truth_delta", "context_ref", "drug_ref")]
    both = p.isNotNull() & t.isNotNull()
    high_true, high_pred = both & (F.abs(t) > threshold), both & (F.abs(p) > threshold)
    same = F.signum(p) == F.signum(t)
    return scored.select(
        *keep,
        F.when(both, p).alias("x_fc"),
        F.when(both, t).alias("y_fc"),
        F.when(both, p - ctx).alias("x_ctx"),
        F.when(both, t - ctx).alias("y_ctx"),
        F.when(both, p - drug).alias("x_drug"),
        F.when(both, t - drug).alias("y_drug"),
        F.when(high_true, p).alias("x_high"),
        F.when(high_true, t).alias("y_high"),
        F.when(high_pred, 1).alias("_hp"),
        F.when(high_true & high_pred & same, 1).alias("_hit"),
        F.when(high_true & same, 1).alias("_sign"),
    )


def _high_counts() -> list[Column]:
    return [
        F.count("x_high").alias("n_high_true"),
        F.count("_hp").alias("n_high_pred"),
        F.count("_hit").alias("n_high_hit"),
        F.count("_sign").alias("n_high_sign"),
    ]


def _pair_pearson(suffix: str) -> Column:
    """Correlation of a masked pair whose two columns are null together."""
    x, y = f"x_{suffix}", f"y_{suffix}"
    vx, vy, floor = F.var_pop(x), F.var_pop(y), F.lit(STD_FLOOR * STD_FLOOR)
    return F.when((F.count(x) >= 2) & (vx > floor) & (vy > floor), ratio(F.covar_pop(x, y), F.sqrt(vx * vy)))


def response_report(scored: DataFrame, by: Sequence[str], groups: DataFrame | None = None, zero_when_no_hit: bool = False) -> DataFrame:
    """Response metrics per group; ``groups`` adds null rows for groups without a match."""
    by = list(by)
    sums = masked_pairs(scored, [*by, "sample_id"]).groupBy(*by).agg(
        F.countDistinct("sample_id").alias("response_n_samples"),
        F.count("x_fc").alias("response_n_observed_values"),
        _pair_pearson("fc").alias("fc_pcc"),
        _pair_pearson("ctx").alias("context_residual_pcc"),
        _pair_pearson("drug").alias("drug_residual_pcc"),
        _pair_pearson("high").alias("high_effect_pcc"),
        *_high_counts(),
    )
    report = sums.select(
        *by,
        "response_n_samples",
        "response_n_observed_values",
        "fc_pcc",
        "context_residual_pcc",
        "drug_residual_pcc",
        "high_effect_pcc",
        *high_effect_scores(zero_when_no_hit=zero_when_no_hit),
    )
    if groups is None:
        return report
    full = groups.select(*by).distinct().join(report, by, "left")
    return full.withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("response_n_samples", "response_n_observed_values")}
    )


def response_moments(scored: DataFrame, by: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """Additive statistics of a group: three moment sets and the high-effect counts.

    These few columns are all that scoring, resampling and streaming need later.
    """
    aggs: list[Column] = []
    for suffix in MASKS:
        x, y = F.col(f"x_{suffix}"), F.col(f"y_{suffix}")
        total = lambda value, name, tail=suffix: F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{name}_{tail}")
        aggs += [F.count(x).alias(f"n_{suffix}"), total(x, "sx"), total(y, "sy"), total(x * x, "sxx"), total(y * y, "syy"), total(x * y, "sxy")]
    return masked_pairs(scored, by, threshold).groupBy(*by).agg(*aggs, *_high_counts())


HIGH_COUNTS = ("n_high_true", "n_high_pred", "n_high_hit", "n_high_sign")


def merged_moments(stats: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Merge stored statistics to coarser groups, optionally weighted."""
    factor = F.lit(1.0) if weight is None else weight
    aggs = [agg for suffix in MASKS for agg in merge_aggs(weight, f"_{suffix}")]
    aggs += [F.sum(F.col(name) * factor).alias(name) for name in HIGH_COUNTS]
    return stats.groupBy(*by).agg(*aggs)


def scores_from_moments(stats: DataFrame, keep: Sequence[str], zero_when_no_hit: bool = False) -> DataFrame:
    """Read the response metrics off stored statistics."""
    return stats.select(
        *keep,
        pearson_from_moments("_fc").alias("fc_pcc"),
        pearson_from_moments("_ctx").alias("context_residual_pcc"),
        pearson_from_moments("_drug").alias("drug_residual_pcc"),
        pearson_from_moments("_high").alias("high_effect_pcc"),
        *high_effect_scores(zero_when_no_hit=zero_when_no_hit),
    )


# ------------------------------------------------------------------- summaries
def long_metrics(frame: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric columns to (ids, metric, value) rows."""
    return frame.unpivot(list(ids), list(metrics), "metric", "score")


def fold_summary(fold_metrics: DataFrame, by: Sequence[str], metrics: Sequence[str], sample_std: bool = False) -> DataFrame:
    """Fold count, mean and spread of every metric; undefined folds are skipped."""
    spread = F.stddev_samp if sample_std else F.stddev_pop
    aggs = []
    for name in metrics:
        aggs += [F.avg(name).alias(f"{name}_mean"), spread(name).alias(f"{name}_std")]
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scored_folds"), *aggs)


def macro_over(summary: DataFrame, by: Sequence[str], regime: str, wanted: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Macro average over named regimes with a completeness flag."""
    rows = summary.filter(F.col(regime).isin(*wanted))
    return rows.groupBy(*by).agg(
        *[F.avg(name).alias(f"{name}_macro") for name in metrics],
        F.array_join(F.sort_array(F.collect_set(regime)), "|").alias("regimes"),
        (F.countDistinct(regime) == F.lit(len(wanted))).alias("complete"),
    )


def selection_profile(
    summary: DataFrame, by: Sequence[str], regime: str, parts: Mapping[str, tuple[str, Sequence[str]]]
) -> DataFrame:
    """Named macro scores, each over its own list of regimes; undefined parts give null and a count.

    ``parts`` maps an output name to ``(metric, regimes)``.
    """
    aggs, missing = [], []
    for name, (metric, regimes) in parts.items():
        inside = F.col(regime).isin(*regimes)
        defined = F.count(F.when(inside, F.col(metric)))
        aggs.append(F.when(defined == len(regimes), F.avg(F.when(inside, F.col(metric)))).alias(name))
        missing.append(F.lit(len(regimes)) - defined)
    total_missing = missing[0]
    for item in missing[1:]:
        total_missing = total_missing + item
    return summary.groupBy(*by).agg(*aggs, total_missing.alias("n_undefined"))


# Published module weights.
MODULE_WEIGHTS = {
    "absolute_fidelity": 0.20,
    "matched_control_fc": 0.25,
    "context_residual": 0.20,
    "drug_residual": 0.20,
    "double_unknown_time": 0.10,
    "high_effect": 0.05,
}


def mean_defined(*values: Column) -> Column:
    """Mean of the non-null arguments, null when there are none."""
    total, count = F.lit(0.0), F.lit(0)
    for value in values:
        total = total + F.coalesce(value, F.lit(0.0))
        count = count + F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(count > 0, total / count)


def module_score(overall: DataFrame, by_split: DataFrame, splits: Mapping[str, str]) -> DataFrame:
    """Weighted module score on 0..100; null as soon as one module is undefined.

    ``overall`` is one row; ``by_split`` has a ``split`` column.  ``splits`` names
    the chemical, strain, both and time splits.
    """
    absolute = mean_defined(*[F.col(name) for name in ABSOLUTE_METRICS])
    extrapolation = mean_defined(absolute, F.col("fc_pcc"))
    pick = lambda label, value: F.max(F.when(F.col("split") == splits[label], value))
    pivot = by_split.agg(
        pick("chemical", F.col("context_residual_pcc")).alias("context_residual"),
        pick("strain", F.col("drug_residual_pcc")).alias("drug_residual"),
        pick("both", extrapolation).alias("_both"),
        pick("time", extrapolation).alias("_time"),
    )
    row = overall.select(
        absolute.alias("absolute_fidelity"),
        F.col("fc_pcc").alias("matched_control_fc"),
        mean_defined(
            F.col("high_effect_direction_accuracy"), F.col("high_effect_pcc"), F.col("high_effect_f1")
        ).alias("high_effect"),
        F.lit(1).alias("_one"),
    ).join(pivot.withColumn("_one", F.lit(1)), "_one")
    row = row.withColumn("double_unknown_time", mean_defined(F.col("_both"), F.col("_time")))
    total = F.lit(0.0)
    for name, weight in MODULE_WEIGHTS.items():
        total = total + F.col(name) * F.lit(weight)
    return row.select(*MODULE_WEIGHTS, (total * 100.0).alias("score"))
