"""I-Match fingerprints: hashes of a text's mid-frequency terms under random sub-lexicons.

The lexicon holds the terms whose document share lies in a band; terms of any length are
counted, long ones under a digest.  A share of at least ``LOW_SHARE`` is met by at most
(mean distinct terms per document) / LOW_SHARE terms, so the lexicon stays the same size
as the corpus grows.  Its size is checked before it is broadcast, and a band that holds
more terms than agreed is refused: the band alone decides, never the size of the corpus.  Each sub-lexicon keeps a pseudo-random fraction of it.  A text's distinct
terms are sorted and hashed once per sub-lexicon; the likeness of two fingerprints is the
share of equal hashes among those that are not empty on both sides.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.llm.common import bounded_batches, text_of
from cellshift.session import written

# Document shares between which a term is in the lexicon (high and low bound of its IDF).
LOW_SHARE, HIGH_SHARE = 0.001, 0.2
# Terms a broadcast lexicon may hold (about 60 bytes each in a worker).
MOST_TERMS = 1_000_000
# Longer terms are named by a digest.
LONG_TERM = 48
# Fractions of the lexicon kept by the sub-lexicons.
FRACTIONS = (1.0,) + (1 / 16,) * 7 + (1 / 64,) * 16 + (1 / 256,) * 24
DOCS_PER_BLOCK, MOST_BLOCKS = 1_000, 20_000
FLUSH_TERMS = 200_000
NO_ID = -(1 << 63)
TERM = re.compile(r"[^\W_]+")
EMPTY = "-"


def terms_of(text: str) -> set[str]:
    """Distinct lower-case terms: runs of letters and digits, long ones by a digest that no term equals."""
    return {t if len(t) <= LONG_TERM else "#" + hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in TERM.findall(text.lower())}


def _document_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial document counts per term; flushed before the table grows large."""
    counts: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(terms_of(text))
            if len(counts) > FLUSH_TERMS:
                yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})
                counts = Counter()
    yield pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": "object", "n": "int64"})


def lexicon_of(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE, most: int = MOST_TERMS) -> list[str]:
    """Sorted terms of the band, from the document counts of all rows of (text).

    A band of more than ``most`` terms is refused with an error.
    """
    bounded_batches(docs.sparkSession)
    total = docs.count()
    counts = docs.select(text_of().alias("text")).mapInPandas(_document_counts, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    least = max(2, math.ceil(total * low))
    band = written(counts.filter((F.col("n") >= least) & (F.col("n") <= max(2, int(total * high)))).select("term"), "lexicon")
    size = band.count()
    if size > most:
        raise ValueError(f"The band holds {size} terms, more than the {most} that may be broadcast; narrow it or raise the bound")
    return sorted(band.toArrow()["term"].to_pylist())


class Fingerprinter:
    """Fingerprints under one lexicon; lookup tables are built once per worker."""

    def __init__(self, lexicon: list[str], fractions: tuple[float, ...] = FRACTIONS) -> None:
        self.lexicon, self.fractions = lexicon, fractions

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "fractions": self.fractions}

    @cached_property
    def place(self) -> dict[str, int]:
        return {term: i for i, term in enumerate(self.lexicon)}

    @cached_property
    def codes(self) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in self.lexicon], np.uint64)

    @cached_property
    def members(self) -> np.ndarray:
        """Whether each sub-lexicon (column) holds each term (row)."""
        columns = []
        for k, fraction in enumerate(self.fractions):
            x = (self.codes ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            columns.append((x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < fraction)
        return np.stack(columns, axis=1) if len(self.codes) else np.zeros((0, len(self.fractions)), bool)

    def of(self, text: str) -> str:
        """One hash per sub-lexicon; a text without lexicon terms is named by all its terms."""
        terms = terms_of(text)
        get = self.place.get
        found = sorted(i for i in map(get, terms) if i is not None)
        if not found:
            return "=" + hashlib.blake2b("\n".join(sorted(terms)).encode(), digest_size=8).hexdigest()
        at = np.array(found)
        codes, members = self.codes[at], self.members[at]
        filled = members.any(axis=0)
        return ".".join(
            hashlib.blake2b(codes[members[:, k]].tobytes(), digest_size=4).hexdigest() if filled[k] else EMPTY for k in range(len(self.fractions))
        )


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among sub-lexicons that are not empty in both fingerprints."""
    if a == b:
        return 1.0
    if a.startswith("=") or b.startswith("="):
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def fingerprints(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(doc_id, fingerprint) of every row of (doc_id, text); null texts are empty."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Fingerprinter(lexicon))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fingerprint": [shared.value.of(t) for t in frame["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(each, f"doc_id {kind}, fingerprint string")


def in_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, ahead, key, doc_id, text): each block of neighbouring ids plus the row that follows it.

    Block bounds are quantiles of the ids.  The first row of a block is repeated behind
    the block before it (``ahead`` 1), the very first behind the last, so a block can be
    walked in order without a global sort or a one-task window.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("key"), text_of().alias("text"))
    ids = rows.select(F.col("key").cast("double").alias("at"), "key")
    total = ids.count()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(total / DOCS_PER_BLOCK)))
    cuts = ids.agg(F.percentile_approx("at", [i / blocks for i in range(1, blocks)] or [0.5], 10 * blocks + 1000)).first()[0] if total else None
    splits = [-math.inf, *sorted(set(cuts or [0.0])), math.inf]
    bucket = Bucketizer(splits=splits, inputCol="at", outputCol="in_block")
    # One row per block.
    firsts = sorted((int(r["in_block"]), r["key"]) for r in bucket.transform(ids).groupBy("in_block").agg(F.min("key").alias("key")).collect())
    ahead = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    follow = spark.createDataFrame(ahead, "key bigint, before int") if ahead else spark.createDataFrame([], "key bigint, before int")
    placed = bucket.transform(rows.withColumn("at", F.col("key").cast("double"))).join(F.broadcast(follow), "key", "left")
    own = F.struct(F.col("in_block").cast("int").alias("block"), F.lit(0).alias("ahead"))
    copy = F.struct(F.col("before").alias("block"), F.lit(1).alias("ahead"))
    both = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    return placed.select(both.alias("b"), "key", "doc_id", "text").select("b.block", "b.ahead", "key", "doc_id", "text")


def _walk(shared):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        printer = shared.value
        held = None  # block, doc_id, text, fingerprint of the row whose successor comes next
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = not row.ahead
                if held is None and not own:
                    continue
                print_of = printer.of(row.text)
                if held is not None and held[0] == row.block:
                    _, doc, text, mark = held
                    half = len(text) // 2
                    edited = text[: len(text) - half] + row.text[:half]
                    edited_mark = printer.of(edited)
                    out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, print_of)))
                held = (row.block, row.doc_id, row.text, print_of) if own else None
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    return walk


def compare_with_edits(docs: DataFrame, lexicon: list[str] | None = None) -> DataFrame:
    """Fingerprint of every row, of its text with the last half replaced, and their likeness.

    The last floor(n / 2) characters are replaced by the first as many of the row that
    follows in ascending doc_id (after the last: the first).  Null texts are empty; an
    empty text is like itself only.  Null ids come first.  Rows that share a doc_id follow
    each other in text-hash order.  Extra columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    printer = Fingerprinter(lexicon if lexicon is not None else lexicon_of(docs))
    shared = docs.sparkSession.sparkContext.broadcast(printer)
    ordered = in_blocks(docs).repartition("block").sortWithinPartitions("block", "ahead", "key", F.xxhash64("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            *[T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")],
        ]
    )
    return ordered.select("block", "ahead", "doc_id", "text").mapInPandas(_walk(shared), schema)
