"""From raw cells to the filtered log2 table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import missing_nan, non_finite, ratio, strict_log2
from cellshift.operators.quantiles import exact_quantile


def long_cells(wide: DataFrame, key: str = "sample_id") -> DataFrame:
    """Unpivot a wide matrix to observed cells; text values must be numeric."""
    proteins = [name for name in wide.columns if name != key]
    stacked = wide.unpivot(key, proteins, "protein", "value")
    return stacked.withColumn("value", missing_nan("value")).filter(F.col("value").isNotNull())


def with_samples(cells: DataFrame, samples: DataFrame, how: str = "inner") -> DataFrame:
    """Cells joined with the rows of their samples, by merging.

    Samples are as many as the input has, but their columns of few values make small files, so
    by file size the planner would broadcast them to every task.  Prepared tables lie in the
    same buckets; merging them moves no row.
    """
    return cells.join(samples.hint("merge"), "sample_id", how)


def missing_rates(cells: DataFrame, fit_ids: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """Share of fit samples without a value, per protein (proteins never seen get rate 1)."""
    observed = (
        with_samples(cells.filter(F.col("value").isNotNull()), fit_ids.select("sample_id"), "left_semi")
        .groupBy("protein")
        .agg(F.count(F.lit(1)).alias("n_observed"))
    )
    names = (cells if proteins is None else proteins).select("protein").distinct()
    n_fit = fit_ids.agg(F.count(F.lit(1))).scalar()
    return (
        names.join(observed, "protein", "left")
        .withColumn("n_fit", F.lit(n_fit))
        .withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
        .withColumn("missing_rate", F.lit(1.0) - ratio(F.col("n_observed"), F.col("n_fit")))
    )


def kept_proteins(rates: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Proteins whose fit missing rate lies strictly below the threshold."""
    return rates.filter(F.col("missing_rate") < threshold).select("protein")


def log2_cells(cells: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """log2 of observed values, restricted to kept proteins.

    Null and NaN mean not observed.  A value that is not positive and finite stops the
    query; :func:`lenient_log2` makes it missing instead.
    """
    rows = cells.filter(missing_nan("value").isNotNull())
    if kept is not None:
        rows = rows.join(kept, "protein", "left_semi")
    return rows.select("sample_id", "protein", strict_log2("value").alias("y"))


def rejected_values(cells: DataFrame) -> DataFrame:
    """Observed cells that have no logarithm: (sample_id, protein, value, reason)."""
    value = missing_nan("value")
    reason = F.when(non_finite(value), "non_finite").when(value <= 0, "non_positive")
    return cells.select("sample_id", "protein", "value", reason.alias("reason")).filter(F.col("reason").isNotNull())


def lenient_log2(cells: DataFrame) -> DataFrame:
    """Keep every cell; values at or below zero become missing instead of an error."""
    return cells.select(
        "sample_id", "protein", F.when(F.col("value") > 0, F.log2("value")).alias("y"), F.coalesce(F.col("value") > 0, F.lit(False)).alias("observed")
    )


def feature_contract(rates: DataFrame, samples: DataFrame, cells: DataFrame, threshold: float = 0.80) -> DataFrame:
    """One row: protein counts, threshold, fit rows and observed fraction of kept cells."""
    counts = rates.agg(
        F.count(F.lit(1)).alias("n_raw_proteins"),
        F.count(F.when(F.col("missing_rate") < threshold, F.lit(1))).alias("n_kept_proteins"),
        F.max("n_fit").alias("train_sample_count"),
    )
    observed = cells.join(kept_proteins(rates, threshold), "protein", "left_semi").agg(F.count(F.lit(1)))
    return (
        counts.withColumn("missing_rate_threshold", F.lit(threshold))
        .withColumn("n_samples", samples.agg(F.count(F.lit(1))).scalar())
        .withColumn("n_observed", observed.scalar())
        .withColumn(
            "observed_fraction",
            ratio(F.col("n_observed"), F.col("n_samples") * F.col("n_kept_proteins")),
        )
    )


def detect_scale(cells: DataFrame, threshold: float = 100.0) -> DataFrame:
    """One row: exact median of the observed values and the scale it implies."""
    median = exact_quantile(cells, [], "value", 0.5, out="median_value")
    return median.withColumn("scale", F.when(F.col("median_value") > threshold, "raw").otherwise("log2"))


def to_log2_by_scale(cells: DataFrame, scale: str = "auto", threshold: float = 100.0) -> DataFrame:
    """Bring cells to log2: raw values are transformed strictly, log2 values kept."""
    if scale == "raw":
        return log2_cells(cells)
    if scale == "log2":
        return cells.select("sample_id", "protein", F.col("value").alias("y"))
    found = detect_scale(cells, threshold).select("scale").scalar()
    return cells.select(
        "sample_id",
        "protein",
        F.when(found == "raw", strict_log2("value")).otherwise(missing_nan("value")).alias("y"),
    )
