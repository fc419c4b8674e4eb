"""Importance resampling toward a target corpus by hashed n-gram buckets.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter or digit;
``bytes.split`` then yields the words (bytes of other characters count as letters).  The
CRC of a word, continued over the next one and the one after, names the bucket of every
run of one to three words, so no n-gram is ever built.  Tasks reduce buckets to counters;
what leaves them is one number per bucket and task.  A text's weight is the sum of its
buckets' log-ratio gains, and a Gumbel variable drawn from its id turns the highest
scores into a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches, partitions_for, text_of
from cellshift.session import written

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
ROWS_PER_RANGE = 500_000

# Lower-case letters, digits and bytes above ASCII stay, A-Z become lower case, the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC of every run of one to three of them joined by a blank."""
    words = text.translate(TABLE).split()
    ones = [*map(crc32, words)]
    later = [*map(b" ".__add__, words[1:])]
    twos = [*map(crc32, later, ones)]
    threes = [*map(crc32, later[1:], twos)]
    return len(words), np.frombuffer(array("I", ones + twos + threes), np.uint32)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """UTF-8 bytes of each text of a batch."""
    column = batch.column(batch.schema.get_field_index("text"))
    return (value.as_buffer().to_pybytes() for value in column)


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts.update((features(text)[1] % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of (text); null texts have none.

    Every task reduces its rows to one counter first, so a shuffle carries at most
    ``buckets`` rows of each task and the driver receives ``buckets`` numbers.
    """
    bounded_batches(texts.sparkSession)
    partial = texts.select(text_of().alias("text")).mapInArrow(_counter(buckets), "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number log ratio of each bucket's smoothed share in the target to that in the source."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64
    )


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel variable of an id in thousandths, from the id's digest; a missing id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(shared, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            found = [(words, len(crcs), int(gains[crcs % len(gains)].sum())) for words, crcs in map(features, _texts(batch))]
            columns = np.array(found, np.int64).reshape(-1, 3)
            noise = np.fromiter(map(gumbel, ids.to_pylist(), repeat(seed)), np.int64, batch.num_rows)
            arrays = [ids, *map(pa.array, (columns[:, 0], columns[:, 1], columns[:, 2], columns[:, 2] + noise))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight", "score"])

    return score


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of (doc_id, text), all long.

    ``docs`` is the source whose bucket counts are compared with those of ``target``
    (text); other columns of either are not looked at.  Repeated rows count and are
    weighed one by one.  A null or empty text has weight 0; an empty target or source has
    bucket counts of 0, which the smoothing turns into defined gains.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scorer(shared, seed), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank``: 1, 2, 3 … for the drawn share of the rows with enough words, else null.

    Of N such rows, floor(percent * N / 100) with the highest scores are drawn, ties to the
    smaller doc_id (a null id last).  Rows are dealt to ranges of the score, each range is
    ordered on its own, and the sizes of the ranges before it give its first rank.
    """
    spark = weighed.sparkSession
    stored = written(weighed, "weighed")
    eligible = stored.filter(F.col("n_words") >= least_words)
    n = eligible.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = eligible.repartitionByRange(partitions_for(n, ROWS_PER_RANGE, spark), *order)
    dealt = written(ranges.withColumn("range", F.spark_partition_id()), "score-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    # Ranges that start behind the last drawn place hold no drawn row and need no order.
    most = percent * n // 100
    placed = dealt.join(bases, "range")
    place = F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = placed.filter(F.col("base") < most).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    names, none = weighed.columns, F.lit(None).cast("bigint").alias("rank")
    rest = [placed.filter(F.col("base") >= most), stored.filter(F.col("n_words") < least_words)]
    out = ranked.select(*names, F.col("rank").cast("bigint").alias("rank"))
    for part in rest:
        out = out.unionByName(part.select(*names, none))
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row of (doc_id, text) with its weight, score and rank in the drawn sample."""
    return draw(weigh(docs, target, seed=seed), least_words, percent)
