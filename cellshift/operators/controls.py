"""Exact matched controls, treatment-control deltas and frozen references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import ratio
from cellshift.operators.prepare import with_samples


def control_means(samples: DataFrame, y: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Per (match_key, protein) mean of the control rows of a pool."""
    controls = samples.filter(F.col("kind") == "control")
    if pool is not None:
        controls = with_samples(controls, pool.select("sample_id"), "left_semi")
    return (
        with_samples(y, controls.select("sample_id", "match_key"))
        .groupBy("match_key", "protein")
        .agg(F.avg("y").alias("control"), F.count(F.lit(1)).alias("n_control_values"))
    )


def matched_keys(samples: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Match keys for which the pool has at least one control row."""
    controls = samples.filter(F.col("kind") == "control")
    if pool is not None:
        controls = with_samples(controls, pool.select("sample_id"), "left_semi")
    return controls.select("match_key").distinct()


def match_flags(targets: DataFrame, samples: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Add ``has_exact_match``: a key-level flag, independent of the measured proteins."""
    keys = matched_keys(samples, pool).withColumn("_hit", F.lit(True))
    return targets.join(keys, "match_key", "left").withColumn(
        "has_exact_match", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def exact_control(samples: DataFrame, y: DataFrame, targets: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Matched-control value of every protein for every target row that has a control."""
    means = control_means(samples, y, pool)
    return targets.select("sample_id", "match_key").join(means, "match_key").select("sample_id", "protein", "control")


def truth_deltas(targets: DataFrame, y: DataFrame, means: DataFrame) -> DataFrame:
    """Observed treatment value minus its matched control, cell by cell."""
    treatments = targets.filter(F.col("kind") == "treatment")
    return (
        with_samples(y, treatments)
        .join(means.select("match_key", "protein", "control"), ["match_key", "protein"])
        .withColumn("truth_delta", F.col("y") - F.col("control"))
    )


def prediction_deltas(deltas: DataFrame, predictions: DataFrame, value: str = "value", out: str = "pred_delta") -> DataFrame:
    """Attach predicted deltas where treatment, control and prediction all exist."""
    return deltas.join(predictions.select("sample_id", "protein", F.col(value).alias("_p")), ["sample_id", "protein"]).withColumn(
        out, F.col("_p") - F.col("control")
    ).drop("_p")


def mean_reference(deltas: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Mean fit delta per reference key and protein."""
    return deltas.groupBy(*keys, "protein").agg(F.avg("truth_delta").alias(out))


def with_reference(deltas: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look a reference up; an absent key leaves null."""
    return deltas.join(reference, [*keys, "protein"], "left")


def leave_fold_out_mean(
    rows: DataFrame, keys: Sequence[str], value: str, fold: str = "fold", out: str = "context_ref", count_out: str | None = None
) -> DataFrame:
    """Mean per (keys, protein) from the other folds only, for every fold that has rows there.

    Totals minus the fold's own share: one aggregate over cells, then tables of
    reference size only.  Rows without a fold (controls) are never held out.
    """
    share = rows.groupBy(*keys, "protein", fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = share.groupBy(*keys, "protein").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    rest = share.join(total, [*keys, "protein"]).withColumn("_rest", F.col("_tn") - F.col("_n"))
    extra = [F.col("_rest").alias(count_out)] if count_out else []
    return rest.select(*keys, "protein", fold, ratio(F.col("_ts") - F.col("_s"), F.col("_rest")).alias(out), *extra)


def control_observed_truth(y: DataFrame, targets: DataFrame, means: DataFrame) -> DataFrame:
    """Truth restricted to cells whose matched control is observed; empty rows vanish."""
    return with_samples(y, targets.select("sample_id", "match_key")).join(
        means.select("match_key", "protein"), ["match_key", "protein"], "left_semi"
    ).select("sample_id", "protein", "y")


def joined_dimension(facts: DataFrame, dimension: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Many-to-one left join that keeps rows whose required attributes are present.

    The cardinality rule (one dimension row per key) is checked by
    :func:`cellshift.operators.checks.key_violations`; here repeated keys raise
    inside the plan, so no silent fan-out can happen.
    """
    unique = dimension.groupBy(key).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.min(name).alias(name) for name in dimension.columns if name != key]
    )
    guarded = unique.withColumn(
        required[0],
        F.when(F.col("_copies") > 1, F.raise_error(F.lit("dimension key is not unique")).cast("string")).otherwise(
            F.col(required[0]).cast("string")
        ),
    ).drop("_copies")
    joined = facts.join(guarded, key, "left")
    for name in required:
        joined = joined.filter(F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    return joined


def exclude_shared(external: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Drop external rows whose key also occurs in the target set."""
    return external.join(target.select(key).distinct(), key, "left_anti")
