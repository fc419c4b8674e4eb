"""Contract checks as violation queries: every rule yields rows, an empty result passes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import non_finite, ratio
from cellshift.schema import METADATA_COLUMNS


class ContractError(ValueError):
    """Raised by :func:`require_empty` when a violation query returns rows."""


def require_empty(violations: DataFrame, message: str, examples: int = 5) -> None:
    """Fail with at most ``examples`` offending rows; never brings more to the driver."""
    rows = violations.limit(examples).collect()
    if rows:
        raise ContractError(f"{message}: {[row.asDict() for row in rows]}")


def missing_columns(df: DataFrame, required: Iterable[str] = tuple(METADATA_COLUMNS.values())) -> list[str]:
    """Required columns a frame lacks (schema only, no job)."""
    present = set(df.columns)
    return [name for name in required if name not in present]


def require_columns(df: DataFrame, required: Iterable[str] = tuple(METADATA_COLUMNS.values())) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ContractError(f"Missing required columns: {missing}")
    return df


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Null and repeated keys with their row counts."""
    counts = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        counts.withColumn("issue", F.when(F.col("key").isNull(), "null_key").when(F.col("n_rows") > 1, "duplicate_key"))
        .filter(F.col("issue").isNotNull())
        .select("issue", "key", "n_rows")
    )


def first_offenders(violations: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """Top-n report of a violation query (a distributed take-ordered, not a full sort)."""
    return violations.orderBy(*order).limit(n)


def key_set_difference(left: DataFrame, right: DataFrame, key: str, labels: tuple[str, str] = ("missing", "extra")) -> DataFrame:
    """Keys present on one side only, in one aggregation instead of two anti joins."""
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.filter(F.col("l") != F.col("r")).select(
        F.when(F.col("l") == 1, labels[0]).otherwise(labels[1]).alias("side"), key
    )


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that occur on both sides."""
    return left.select(key).join(right.select(key), key, "left_semi").distinct()


def value_domain(cells: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Counts of observed, non-finite and non-positive values."""
    bad = non_finite(value)
    return cells.groupBy(*by).agg(
        F.count(value).alias("n_observed"),
        F.count(F.when(bad, F.lit(1))).alias("n_non_finite"),
        F.count(F.when(~bad & (F.col(value) <= 0), F.lit(1))).alias("n_non_positive"),
    )


def ordered_set_report(
    expected: DataFrame, submitted: DataFrame, key: str, position: str
) -> DataFrame:
    """Compare an ordinal list: missing, extra and out-of-order entries."""
    joined = expected.select(key, F.col(position).alias("_want")).join(
        submitted.select(key, F.col(position).alias("_have")), key, "full_outer"
    )
    return joined.agg(
        F.count("_want").alias("n_expected"),
        F.count("_have").alias("n_submitted"),
        F.count(F.when(F.col("_have").isNull(), F.lit(1))).alias("n_missing"),
        F.count(F.when(F.col("_want").isNull(), F.lit(1))).alias("n_extra"),
        F.count(F.when(F.col("_want") != F.col("_have"), F.lit(1))).alias("n_out_of_order"),
    )


def submission_report(
    grid_ids: DataFrame, proteins: DataFrame, predictions: DataFrame, value: str = "value"
) -> DataFrame:
    """One-row verdict for a prediction set against the ids and proteins it must cover.

    ``grid_ids(sample_id)`` and ``proteins(protein)`` are the contract.  Because
    both key sets are required to match and cells to be unique, the cell count
    settles completeness without building the dense grid.
    """
    per_sample = predictions.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count(F.when(F.col(value).isNull() | non_finite(value), F.lit(1))).alias("n_bad"),
    )
    n_proteins = proteins.agg(F.countDistinct("protein")).scalar()
    known = proteins.select("protein").distinct().withColumn("_known", F.lit(True))
    extra_proteins = predictions.select("protein").distinct().join(known, "protein", "left_anti").agg(F.count(F.lit(1)))
    joined = grid_ids.select("sample_id", F.lit(True).alias("_want")).join(per_sample, "sample_id", "full_outer")
    report = joined.agg(
        F.count("_want").alias("n_rows"),
        F.count(F.when(F.col("n_cells").isNull(), F.lit(1))).alias("n_missing_ids"),
        F.count(F.when(F.col("_want").isNull(), F.lit(1))).alias("n_extra_ids"),
        F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_non_finite"),
        F.count(F.when(F.col("n_cells") != F.lit(n_proteins), F.lit(1))).alias("n_incomplete_rows"),
    ).withColumn("n_extra_proteins", extra_proteins.scalar())
    faults = reduce(
        lambda a, b: a + b,
        [F.col(c) for c in ("n_missing_ids", "n_extra_ids", "n_non_finite", "n_incomplete_rows", "n_extra_proteins")],
    )
    return report.withColumn("accepted", faults == 0)


def role_conflicts(samples: DataFrame, entity: str, role: str) -> DataFrame:
    """Entities that carry more than one role."""
    return (
        samples.groupBy(entity)
        .agg(
            F.countDistinct(role).alias("n_roles"),
            F.array_join(F.sort_array(F.collect_set(role)), "|").alias("roles"),
        )
        .filter(F.col("n_roles") != 1)
    )


def namespaced_records(samples: DataFrame, key: Column) -> DataFrame:
    """Distinct (data_source, pert_id, chemical_key) records."""
    return samples.select("data_source", "pert_id", key.alias("chemical_key")).dropDuplicates()


def namespaced_conflicts(samples: DataFrame, key: Column) -> DataFrame:
    """(data_source, pert_id) pairs that name several chemicals or are blank."""
    records = namespaced_records(samples, key)
    return (
        records.groupBy("data_source", "pert_id")
        .agg(F.count(F.lit(1)).alias("n_chemicals"))
        .filter((F.col("n_chemicals") > 1) | (F.coalesce(F.trim("pert_id"), F.lit("")) == ""))
    )


def identity_drift(fit_records: DataFrame, current_records: DataFrame) -> DataFrame:
    """Known (data_source, pert_id) pairs whose chemical key changed since fitting."""
    pair = ["data_source", "pert_id"]
    return (
        fit_records.withColumnRenamed("chemical_key", "fit_key")
        .join(current_records.withColumnRenamed("chemical_key", "current_key"), pair)
        .filter(F.col("fit_key") != F.col("current_key"))
        .select(*pair, "fit_key", "current_key")
    )


def aligned_pair_report(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("sample_id", "protein")) -> DataFrame:
    """Key-set agreement of two prediction sets: shared, left-only, right-only and repeated keys."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    count = lambda condition, name: F.count(F.when(condition, F.lit(1))).alias(name)
    return seen.agg(
        count((F.col("l") > 0) & (F.col("r") > 0), "n_shared"),
        count(F.col("r") == 0, "n_left_only"),
        count(F.col("l") == 0, "n_right_only"),
        count((F.col("l") > 1) | (F.col("r") > 1), "n_repeated"),
    )


def input_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and key counts of several tables that share ``sample_id``."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_samples")).select(
            F.lit(name).alias("table_name"), "n_rows", "n_samples"
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def observed_share(observed: Column, total: Column) -> Column:
    """Fraction of observed cells."""
    return ratio(observed, total)
