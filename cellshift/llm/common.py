"""Column factories and small helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of characters other than these six white-space characters.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table of a dataset folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand texts to Python workers in smaller batches, unless the session sets its own size.

    A worker holds one batch and a few arrays of its size at a time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def text_of(column: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    return F.array_remove(F.split(text, WHITE_RUN), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a bound variable.

    An alias would be inlined into the lambda functions that use it and then be
    evaluated once per array element.
    """
    return F.transform(F.array(value), body)[0]


def partitions_for(rows: int, rows_each: int, spark: SparkSession) -> int:
    """Partition count for a measured row count, at least one per core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_each))
