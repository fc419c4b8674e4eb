"""Packing of token pieces into fixed-length sequences by the sum-of-squares rule.

Documents are cut only where they exceed the sequence length.  A piece goes where the
sum over all residual gaps of the squared number of open sequences with that gap becomes
smallest, which keeps gaps spread out and hence usable; a sequence is opened only when the
piece fits nowhere.  Pieces are placed longest first.
The state is one counter per gap, so shards of pieces are packed independently and each
leaves only its last few sequences open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.llm.common import bounded_batches, text_of
from cellshift.llm.tokens import word_ids
from cellshift.session import written

CAPACITY = 2048
SHARD_PIECES = 50_000


def _cutter(path: str, end_id: int, capacity: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = word_ids(path, 4)
        end = int(end_id).to_bytes(4, "little")
        for frame in frames:
            rows: list[tuple] = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = vocabulary.of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, part))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit integers, the document's end id included.
    A null text is empty and yields one piece that holds the end id only.
    """
    bounded_batches(docs.sparkSession)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in fields]])
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(_cutter(tokenizer, end_id, capacity), schema)


def place_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, pieces being placed longest first."""
    open_by_gap = np.zeros(capacity + 1, np.int64)
    waiting: dict[int, list[int]] = {}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = np.flatnonzero(open_by_gap[size:]) + size
        after = gaps - size
        # Change of the sum of squares: one sequence fewer at the gap, one more at what is left of it.
        change = np.where(after > 0, 2 * open_by_gap[after] + 2 - 2 * open_by_gap[gaps], 1 - 2 * open_by_gap[gaps])
        if len(gaps):
            gap = int(gaps[int(np.argmin(change))])
            bin_ = waiting[gap].pop()
            open_by_gap[gap] -= 1
        else:
            gap, bin_, made = capacity, made, made + 1
        sequence[i], offset[i] = bin_, capacity - gap
        if gap > size:
            waiting.setdefault(gap - size, []).append(bin_)
            open_by_gap[gap - size] += 1
    return sequence, offset


def _packer(capacity: int):
    def pack_shard(unit: pd.DataFrame) -> pd.DataFrame:
        # Ties are broken by document and piece, so a retried task packs alike.
        unit = unit.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sequence, offset = place_pieces(unit["length"].to_numpy(np.int64), capacity)
        shard = int(unit["shard"].iloc[0])
        return unit.drop(columns="shard").assign(sequence_id=(np.int64(shard) << np.int64(32)) + sequence, offset=offset)

    return pack_shard


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to stored pieces (doc_id, piece, length, ...).

    Every row is placed; repeated rows are packed as further pieces.  Offsets in a
    sequence are gapless from 0.  ``pieces`` should be a stored table, as it is counted first.
    """
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packer(capacity), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Placed pieces of all documents, with the CRC-32 of their ids: a plan for writing sequences.

    ``sequences`` turns pieces with ids and this plan into the token sequences.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(pieces, "pieces"), capacity, shard_pieces)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from placed pieces that still carry their ids.

    At most ``capacity`` ids meet per sequence, so groups are bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return grouped.select("sequence_id", "length", whole.alias("ids"))
