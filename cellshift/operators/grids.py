"""Dense sample x protein requests and other bounded expansions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protein_list(proteins: DataFrame) -> Column:
    """The matrix columns as one sorted array (a scalar subquery).

    The protein list is the schema of the wide matrix - thousands of names -
    and does not grow with the samples.
    """
    return proteins.agg(F.sort_array(F.collect_set("protein"))).scalar()


def dense_grid(rows: DataFrame, proteins: DataFrame) -> DataFrame:
    """Every requested row with every protein; a map-side explode, no shuffle."""
    return rows.withColumn("protein", F.explode(protein_list(proteins)))


def grid_with_values(rows: DataFrame, y: DataFrame, value: str = "y") -> DataFrame:
    """Dense grid with the observed values (null where unobserved)."""
    return dense_grid(rows, y.select("protein")).join(y.select("sample_id", "protein", value), ["sample_id", "protein"], "left")


def literal_rows(df: DataFrame, options: Sequence[dict[str, object]], columns: dict[str, str]) -> DataFrame:
    """Repeat rows once per literal option (a parameter grid written in the plan)."""
    structs = [
        F.struct(*[F.lit(option.get(name)).cast(kind).alias(name) for name, kind in columns.items()]) for option in options
    ]
    return df.withColumn("_option", F.explode(F.array(*structs))).select("*", "_option.*").drop("_option")
