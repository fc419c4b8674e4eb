"""Group means, leave-one-row-out means and shrinkage priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import ratio
from cellshift.operators.prepare import with_samples


def protein_means(y: DataFrame, fit_ids: DataFrame, value: str = "y", out: str = "protein_mean") -> DataFrame:
    """Mean of the fit rows per protein."""
    return (
        with_samples(y, fit_ids.select("sample_id"), "left_semi")
        .groupBy("protein")
        .agg(F.avg(value).alias(out), F.count(value).alias("n_fit_values"))
    )


def group_totals(rows: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Sum and count per (keys, protein)."""
    return rows.groupBy(*keys, "protein").agg(F.sum(value).alias(f"{prefix}_sum"), F.count(value).alias(f"{prefix}_n"))


def prior_with_fallback(grid: DataFrame, prior: DataFrame, keys: Sequence[str], fallback: DataFrame, prior_value: str, fallback_value: str, out: str) -> DataFrame:
    """Group prior looked up for every requested cell, the protein-wide value where the group has none."""
    return (
        grid.join(prior.select(*keys, "protein", prior_value), [*keys, "protein"], "left")
        .join(fallback.select("protein", fallback_value), "protein", "left")
        .withColumn(out, F.coalesce(prior_value, fallback_value, F.lit(0.0)))
        .drop(prior_value, fallback_value)
    )


def left_out_mean(total: Column, count: Column, own: Column, fallback: Column) -> Column:
    """Mean without the row's own value; the fallback where nothing else is left.

    ``own`` is null for an unobserved cell, which then subtracts nothing.
    """
    rest = count - F.when(own.isNotNull(), 1).otherwise(0)
    return F.when(rest > 0, ratio(total - F.coalesce(own, F.lit(0.0)), rest)).otherwise(fallback)


def leave_one_out_means(grid: DataFrame, value: str, group: str, out: str, global_out: str | None = None) -> DataFrame:
    """Leave-one-row-out group mean with the leave-one-out protein mean as fallback.

    ``grid`` holds every requested (row, protein), observed or not.  Totals come
    from partially aggregated sums joined back, so no window ever holds a whole
    protein or a whole strain.
    """
    whole = group_totals(grid, [], value, "_all")
    part = group_totals(grid, [group], value, "_grp")
    fallback = F.coalesce(ratio(F.col("_all_sum"), F.col("_all_n")), F.lit(0.0))
    wide = grid.join(whole, "protein").join(part, [group, "protein"])
    everywhere = left_out_mean(F.col("_all_sum"), F.col("_all_n"), F.col(value), fallback)
    wide = wide.withColumn("_everywhere", everywhere).withColumn(
        out, left_out_mean(F.col("_grp_sum"), F.col("_grp_n"), F.col(value), F.col("_everywhere"))
    )
    if global_out:
        wide = wide.withColumn(global_out, F.col("_everywhere"))
    return wide.drop("_all_sum", "_all_n", "_grp_sum", "_grp_n", "_everywhere")


def shrunk_effect(n: Column, group_mean: Column, global_mean: Column, alpha: float) -> Column:
    """``n / (n + alpha) * (group mean - global mean)``; an absent group adds nothing."""
    size = F.coalesce(n.cast("double"), F.lit(0.0))
    return F.coalesce(size / (size + F.lit(float(alpha))) * (group_mean - global_mean), F.lit(0.0))


def shrinkage_prior(
    requests: DataFrame, fit_deltas: DataFrame, groups: Sequence[str], alpha: float, out: str = "prior", own: str | None = None
) -> DataFrame:
    """Sum of shrunken group effects for every requested cell.

    ``requests`` has ``protein``, the group columns and, for leave-one-out, the
    column named by ``own`` with the cell's own fit value (null if none).
    """
    result = requests.join(group_totals(fit_deltas, [], "truth_delta", "_all"), "protein", "left")
    own_value = F.col(own) if own else F.lit(None).cast("double")
    own_n = F.when(own_value.isNotNull(), 1).otherwise(0)
    own_sum = F.coalesce(own_value, F.lit(0.0))
    global_mean = F.coalesce(ratio(F.col("_all_sum") - own_sum, F.col("_all_n") - own_n), F.lit(0.0))
    effect = F.lit(0.0)
    for group in groups:
        prefix = f"_{group}"
        result = result.join(group_totals(fit_deltas, [group], "truth_delta", prefix), [group, "protein"], "left")
        n = F.col(f"{prefix}_n") - own_n
        mean = F.when(n > 0, ratio(F.col(f"{prefix}_sum") - own_sum, n)).otherwise(F.lit(0.0))
        effect = effect + F.when(F.col(f"{prefix}_n").isNull(), F.lit(0.0)).otherwise(shrunk_effect(n, mean, global_mean, alpha))
    drop = ["_all_sum", "_all_n"] + [f"_{g}_{part}" for g in groups for part in ("sum", "n")]
    return result.withColumn(out, effect).drop(*drop)


def context_extent(rows: DataFrame, context: Sequence[str], time: str) -> DataFrame:
    """Latest time and number of distinct times per context."""
    return rows.groupBy(*context).agg(F.max(time).alias("max_time"), F.countDistinct(time).alias("n_times"))


def latest_flag(rows: DataFrame, context: Sequence[str], time: str, out: str = "is_latest") -> DataFrame:
    """Mark rows taken at the latest time of their context (aggregate and join, not a window)."""
    latest = rows.groupBy(*context).agg(F.max(time).alias("_max_time"))
    return rows.join(latest, list(context)).withColumn(out, F.col(time) == F.col("_max_time")).drop("_max_time")


def against_baseline(grid: DataFrame, by: Sequence[str], is_baseline: Column, metrics: Sequence[str], suffix: str = "_delta") -> DataFrame:
    """Metric differences to the baseline row of the same group."""
    base = grid.filter(is_baseline).select(*by, *[F.col(name).alias(f"_base_{name}") for name in metrics])
    joined = grid.join(base, list(by)) if by else grid.withColumn("_one", F.lit(1)).join(base.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.select(
        *grid.columns, *[(F.col(name) - F.col(f"_base_{name}")).alias(f"{name}{suffix}") for name in metrics]
    )
