"""Readers for the file shapes the analytics start from."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.operators.checks import ContractError
from cellshift.operators.prepare import long_cells
from cellshift.schema import METADATA_COLUMNS


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file (reads the first line only)."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


# Bytes of a file that are read at a time until its first line is whole.
HEADER_CHUNK = 65_536


def first_line(path: str) -> tuple[str, int]:
    """First line of a (gzipped or plain) file and the bytes taken from it, by whatever store the path names."""
    local = path.startswith(("file:", "/"))
    system, inner = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    data = b""
    with system.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None, buffer_size=None) as source:
        while b"\n" not in data and (chunk := source.read(HEADER_CHUNK)):
            data += chunk
    return data.partition(b"\n")[0].decode("utf-8-sig").rstrip("\r"), len(data)


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [first_line(path) for path in batch["path"]]
        yield pd.DataFrame({"path": batch["path"], "header": [line for line, _ in found], "taken": [n for _, n in found]})


def file_headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, header, taken) of every file that is not empty: tasks open the listed files and read one chunk, not the rows.

    The listing comes from Spark, contents are not asked for.
    """
    files = spark.read.format("binaryFile").options(**options).load(path).filter("length > 0").select("path")
    dealt = files.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(_headers, "path string, header string, taken bigint")


def header_groups(spark: SparkSession, path: str, sep: str = ",", **options: object) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for every header line that the files of a path begin with.

    What reaches the driver are the distinct headers with their file names, as many as
    the driver's own file listing has.
    """
    first = file_headers(spark, path, **options)
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("header").collect()
    # Quoted names are split the way the rows will be.
    return [(next(csv.reader([row["header"]], delimiter=sep)), row["files"]) for row in found]


def _by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of groups by column name; a column that a group lacks is null there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_samples_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Sample metadata with the required-column contract; keys stay text, the time is a number.

    Files may order their columns differently; each is read by its own header.
    """
    return _by_name([_samples_csv(spark, header, files, sep) for header, files in header_groups(spark, path, sep)])


def _samples_csv(spark: SparkSession, header: list[str], files: list[str], sep: str) -> DataFrame:
    missing = [name for name in METADATA_COLUMNS if name not in header]
    if missing:
        raise ContractError(f"Sample table lacks {missing}")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).csv(files)
    extra = [name for name in header if name not in METADATA_COLUMNS]
    named = [
        F.col(f"`{theirs}`").cast("double").alias(ours) if ours == "pert_time" else F.col(f"`{theirs}`").alias(ours)
        for theirs, ours in METADATA_COLUMNS.items()
    ]
    return rows.select(*named, *[F.col(f"`{name}`") for name in extra])


def read_samples_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata from parquet under the same contract."""
    rows = spark.read.parquet(path)
    missing = [name for name in METADATA_COLUMNS if name not in rows.columns]
    if missing:
        raise ContractError(f"Sample table lacks {missing}")
    return rows.withColumnsRenamed(METADATA_COLUMNS)


def read_wide_matrix_csv(spark: SparkSession, path: str, key: str = "sample_ID", proteins: Sequence[str] | None = None) -> DataFrame:
    """Wide abundance matrix to long cells; only the wanted protein columns are parsed.

    Files may order their columns differently; each is read by its own header.
    """
    parts = [_wide_matrix_csv(spark, header, files, key, proteins) for header, files in header_groups(spark, path)]
    return _by_name(parts)


def _wide_matrix_csv(spark: SparkSession, header: list[str], files: list[str], key: str, proteins: Sequence[str] | None) -> DataFrame:
    if key not in header:
        raise ContractError(f"No key column {key} in the matrix")
    names = [name for name in header if name != key]
    if not names:
        raise ContractError("The matrix holds nothing but its key column")
    wanted = list(proteins) if proteins is not None else names
    absent = [name for name in wanted if name not in names]
    if absent:
        raise ContractError(f"Protein matrix lacks columns: {absent}")
    schema = T.StructType([T.StructField(name, T.StringType() if name == key else T.DoubleType()) for name in header])
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(files)
    return long_cells(rows.select(F.col(f"`{key}`").alias("sample_id"), *[F.col(f"`{name}`") for name in wanted]))


def read_registry_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed registry as text; empty fields are empty text, never null."""
    parts = []
    for header, files in header_groups(spark, path, "\t"):
        schema = T.StructType([T.StructField(name.strip(), T.StringType()) for name in header])
        parts.append(spark.read.schema(schema).option("header", True).option("sep", "\t").csv(files))
    return _by_name(parts).na.fill("")


def registry_type(columns: Sequence[str]) -> str:
    """Chemical or strain registry, told by its key column."""
    if "raw_name" in columns and "strain_code" not in columns:
        return "chemical"
    if "strain_code" in columns and "raw_name" not in columns:
        return "strain"
    raise ContractError("Cannot infer the registry type from its columns")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated (optionally gzipped) scored name pairs with a fixed header."""
    header = header_of(spark, path, " ")
    # The expected header.
    if header[:3] != ["protein1", "protein2", "combined_score"]:
        raise ContractError(f"Unexpected edge list header: {header}")
    fields = [T.StructField(n, T.LongType() if n == "combined_score" else T.StringType()) for n in header]
    rows = spark.read.schema(T.StructType(fields)).option("header", True).option("sep", " ").csv(path)
    return rows.select("protein1", "protein2", "combined_score")


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab file with at least six columns; rows without a systematic name are dropped."""
    rows = spark.read.option("sep", "\t").option("header", False).csv(path)
    if len(rows.columns) < 6:
        raise ContractError("Feature table needs at least six columns")
    names = ["feature_id", "feature_type", "qualifier", "systematic", "standard", "aliases"]
    picked = rows.select(*[F.coalesce(F.col(old), F.lit("")).alias(new) for old, new in zip(rows.columns, names, strict=False)])
    return picked.filter(F.col("systematic") != "")


def explode_aliases(features: DataFrame) -> DataFrame:
    """One row per alias (null alias for features without any)."""
    parts = F.filter(F.transform(F.split("aliases", r"\|"), lambda text: F.trim(text)), lambda text: text != "")
    return features.withColumn("alias", F.explode_outer(parts))


def read_fold_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction set stored as one dataset partitioned by fold."""
    return spark.read.parquet(path)


def repeated_cells(predictions: DataFrame) -> DataFrame:
    """Cells that occur more than once in an assembled prediction set."""
    return predictions.groupBy("sample_id", "protein").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def incomplete_folds(predictions: DataFrame, folds: int) -> DataFrame:
    """Expected fold numbers without any prediction."""
    spark = predictions.sparkSession
    wanted = spark.range(folds).select(F.col("id").alias("fold"))
    return wanted.join(predictions.select(F.col("fold").cast("bigint").alias("fold")).distinct(), "fold", "left_anti")


def read_leaderboard(spark: SparkSession, root: str) -> DataFrame:
    """Run summaries below a directory tree, each read by its own header; the run id comes from the path."""
    groups = header_groups(spark, root, recursiveFileLookup=True, pathGlobFilter="*.csv")
    parts = []
    for header, files in groups:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        rows = spark.read.schema(schema).option("header", True).csv(files)
        parts.append(rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/", 1)))
    return _by_name(parts)


def load_references(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Frozen context and drug reference tables."""
    return spark.read.parquet(f"{root}/ref_context"), spark.read.parquet(f"{root}/ref_drug")
