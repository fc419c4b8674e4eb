"""Writers: delimited files, metric tables, predictions and frozen references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, compression: str = "none") -> None:
    writer = df.write.mode("error").option("sep", sep).option("header", header).option("compression", compression)
    writer.option("emptyValue", "").csv(path)


def write_predictions(predictions: DataFrame, path: str, partition_by: Sequence[str] = ("scenario", "fold")) -> None:
    """Predictions as one dataset; a fold has as many files as its size asks for.

    Rows are gathered by fold, and adaptive execution splits large folds and merges small
    ones to the advisory partition size.
    """
    predictions.hint("rebalance", *partition_by).write.mode("error").partitionBy(*partition_by).parquet(path)


def write_metric_table(table: DataFrame, path: str) -> dict[str, str]:
    """The same small table as CSV, JSON and parquet."""
    paths = {kind: f"{path}/{kind}" for kind in ("csv", "json", "parquet")}
    write_csv(table, paths["csv"])
    table.write.mode("error").json(paths["json"])
    table.write.mode("error").parquet(paths["parquet"])
    return paths


def write_run_summaries(table: DataFrame, path: str, run: str) -> None:
    """One CSV folder per run, the run id in the path."""
    table.withColumnRenamed(run, "run").write.mode("error").option("header", True).partitionBy("run").csv(path)


def write_references(context: DataFrame, drug: DataFrame, path: str) -> None:
    """Freeze the two reference tables."""
    context.write.mode("error").parquet(f"{path}/ref_context")
    drug.write.mode("error").parquet(f"{path}/ref_drug")
