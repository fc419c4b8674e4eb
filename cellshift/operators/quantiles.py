"""Exact quantiles that never gather a whole group, and mergeable quantile states for running ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    q: float = 0.5,
    out: str = "quantile",
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated exact quantile per group.

    Pass one sketches each group (bounded memory) and gets a bracket that is
    sure to hold the wanted ranks.  Pass two counts the rows below the bracket
    and keeps only distinct values inside it with their counts - about
    ``10 / accuracy`` of the rows - so the final ordered walk is small.
    """
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    slack = 5.0 / accuracy
    low_q, high_q = max(0.0, q - slack), min(1.0, q + slack)
    sketch_aggs = [
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [low_q, high_q], accuracy).alias("_b"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    ]
    sketch = (data.groupBy(*by) if by else data.groupBy(F.lit(1).alias("_all"))).agg(*sketch_aggs)
    # A group no larger than the sketch is bounded anyway and kept whole; larger
    # groups use the bracket, widened where it touches the ends of the ranks.
    whole = F.col("_n") <= accuracy
    sketch = sketch.select(
        *(by or ["_all"]),
        "_n",
        F.when(whole | (F.lit(low_q) <= 0.0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(whole | (F.lit(high_q) >= 1.0), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    keys = list(by) or ["_all"]
    joined = (data if by else data.withColumn("_all", F.lit(1))).join(sketch, keys)
    counted = (
        joined.filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_in", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*keys, "_n", "_in")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    walk = Window.partitionBy(*keys).orderBy(F.col("_in").asc_nulls_first())
    reach = counted.withColumn("_cum", F.sum("_c").over(walk))
    place = (F.col("_n") - 1) * F.lit(q)
    floor_rank, ceil_rank = F.floor(place) + 1, F.ceil(place) + 1
    picked = reach.groupBy(*keys).agg(
        F.min(F.when(F.col("_in").isNotNull() & (F.col("_cum") >= floor_rank), F.col("_in"))).alias("_a"),
        F.min(F.when(F.col("_in").isNotNull() & (F.col("_cum") >= ceil_rank), F.col("_in"))).alias("_z"),
        F.first(place - F.floor(place)).alias("_frac"),
    )
    return picked.select(*by, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_frac")).alias(out))


# Size of a quantile state and the rank error that it keeps with a wide margin (about 0.006 at 99 %).
SKETCH_K, RANK_ERROR = 800, 0.02


def quantile_state(value: Column | str) -> Column:
    """Aggregate: a sketch of a few kilobytes that merges like the additive moments beside it."""
    return F.kll_sketch_agg_double(value, F.lit(SKETCH_K))


def merged_state(states: DataFrame, by: Sequence[str], state: str = "state") -> DataFrame:
    """States of parts (folds, batches, files) merged per group: (by, state)."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double(state, F.lit(SKETCH_K)).alias(state))


def state_quantile(state: Column | str, q: float = 0.5) -> Column:
    """A value whose rank differs from ``q`` by at most ``RANK_ERROR`` of the rows."""
    return F.kll_sketch_get_quantile_double(state, F.lit(q))


def rank_errors(df: DataFrame, by: Sequence[str], value: str, estimates: DataFrame, estimate: str, q: float = 0.5) -> DataFrame:
    """(by, n, error): distance of ``q`` from the ranks that an estimate has among the exact values."""
    seen = df.filter(F.col(value).isNotNull()).join(estimates, list(by))
    below, up_to = (F.avg(F.when(test, 1.0).otherwise(0.0)) for test in (F.col(value) < F.col(estimate), F.col(value) <= F.col(estimate)))
    error = F.greatest(F.col("_below") - F.lit(q), F.lit(q) - F.col("_up_to"), F.lit(0.0))
    return seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), below.alias("_below"), up_to.alias("_up_to")).select(*by, "n", error.alias("error"))
