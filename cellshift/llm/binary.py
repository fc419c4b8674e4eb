"""Token-id files: flat unsigned integers with 64-bit document offsets.

A store is a folder of parts in ascending document order.  Part ``k`` has ``ids``
(unsigned 16- or 32-bit integers, little-endian), ``offsets`` (signed 64-bit, one more
than documents) and ``docs`` (signed 64-bit document ids).  Offsets count from the part's
own first id; the part's base in the whole store is a prefix sum over the parts' sizes
and stands in the manifest, one row per part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches, partitions_for, text_of
from cellshift.llm.tokens import word_ids
from cellshift.session import scratch_path

DOCS_PER_PART = 10_000
# Stands for a null document id in the ``docs`` files.
NO_ID = -(1 << 63)
PART_FIELDS = "part int, path string, n_docs bigint, n_ids bigint, width int"


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int, width: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocabulary = word_ids(tokenizer, width)
        kind = vocabulary.kind
        end = np.array([end_id], kind).tobytes()
        part = TaskContext.get().partitionId()
        # A name per attempt: a retried task never touches another attempt's files.
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        system, path = _system(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        total, docs, ends = 0, [], [0]
        with system.open_output_stream(path + ".ids") as out:
            for frame in frames:
                for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                    ids = vocabulary.of(text) + end
                    out.write(ids)
                    total += len(ids) // width
                    docs.append(NO_ID if pd.isna(doc) else int(doc))
                    ends.append(total)
        for suffix, values in ((".offsets", ends), (".docs", docs)):
            with system.open_output_stream(path + suffix) as out:
                out.write(np.asarray(values, "<i8").tobytes())
        yield pd.DataFrame({"part": [part], "path": [name], "n_docs": [len(docs)], "n_ids": [total], "width": [width]})

    return write


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, width: int = 2, docs_per_part: int = DOCS_PER_PART) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order into a store; returns its manifest.

    ``width`` is the bytes per id; 2 serves vocabularies up to 65,536.  The manifest
    (part, path, n_docs, n_ids, width, base) is stored as Parquet beside the parts.
    Null texts are empty, null ids come first, equal ids are ordered by text hash.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = partitions_for(docs.count(), docs_per_part, spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = sorted(ordered.mapInPandas(_writer(folder, tokenizer, end_id, width), PART_FIELDS).collect())
    # One row per part: the prefix sum of part sizes gives each part its base.
    bases = np.cumsum([0] + [row.n_ids for row in found])
    listed = [(*row, int(base)) for row, base in zip(found, bases, strict=False)]
    manifest = spark.createDataFrame(spark.sparkContext.parallelize(listed, max(1, len(listed))), PART_FIELDS + ", base bigint")
    manifest.write.parquet(f"{folder}/manifest")
    return manifest


def _mapped(system, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a local or shared folder."""
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), kind)


def _reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            system, path = _system(row.path)
            docs, offsets = _mapped(system, path + ".docs", "<i8"), _mapped(system, path + ".offsets", "<i8")
            ids = _mapped(system, path + ".ids", f"<u{row.width}")
            for first in range(0, len(docs), 1000):
                last = min(first + 1000, len(docs))
                texts = [ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(first, last)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if d == NO_ID else int(d) for d in docs[first:last]], "Int64"),
                        "start": offsets[first:last] + row.base,
                        "n_tokens": np.diff(offsets[first : last + 1]),
                        "ids": texts,
                        "ids_crc32": [zlib.crc32(t) for t in texts],
                    }
                )


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document of a store.

    ``start`` counts the ids of all earlier documents; ``ids`` are 32-bit little-endian.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    rows = manifest.repartition(max(1, manifest.count()), "part")
    return rows.mapInPandas(_reader, "doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write a store in the shared scratch folder and read it back."""
    folder = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, folder, tokenizer, end_id)
    return read_store(docs.sparkSession, folder)
