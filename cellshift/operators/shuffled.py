"""Contingency counts of shuffled labels by hash ranks, a few draws at a time.

A draw orders all rows twice by md5 and joins the two orders by rank.  No row of the
data travels once per draw: a task hashes its rows for the draws at hand and sends,
packed in arrays, only the digests' leading bits with the number of the row's levels.
Orders are sorted in slices of the digests, their lengths give every slice its rank, and
both orders are then counted in chunks of ranks.  What one batch of draws has shuffled
and written is deleted before the next one starts, so the disk holds one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.functions.digests import Texts
from cellshift.operators.ranking import hash_rank
from cellshift.session import released, scratch_path, shuffles_dropped, written

# Rows hashed at once; rows sorted, and ranks counted, in one task.
BLOCK_ROWS, SLICE_ROWS, CHUNK_ROWS = 1 << 18, 1 << 21, 1 << 24
# Draws of a batch: eight, or as many as have this many rows together.  A row and draw takes about 20 bytes of disk.
BATCH_DRAWS, BATCH_ROWS = 8, 12_000_000
# Equal leading bits that a draw may be expected to have; beyond that, whole digests are sent at once.
EXPECTED_TIES = 0.5
# Cells up to which a chunk is counted in an array of all cells, and counts sent to Spark at once.
DENSE_CELLS, SENT_ROWS = 1 << 22, 1 << 16

_SIDES = ("to", "from")
_PACKED = "part int, draw bigint, side int, slice int, packed binary"
_ORDERS = "draw bigint, side int, slice int, n bigint, ties bigint, codes binary"
_CUT = "part int, draw bigint, chunk bigint, side int, at bigint, codes binary"
_COUNTS = "draw bigint, _source bigint, _class bigint, _n bigint"


def _code_bits(size: int) -> int:
    return max(1, (size - 1).bit_length())


def _slice_bits(total: int) -> int:
    return max(0, -(-total // SLICE_ROWS) - 1).bit_length()


def _code_type(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _packing(seed: object, draws: Sequence[int], bits: tuple[int, int], slice_bits: int, parts: int, whole: bool) -> Callable:
    """Rows as packed numbers per draw, side and slice: digest bits below the slice's own, the code in the last bits.

    Whole digests are sent as three numbers a row: both halves of the digest, and the code.
    """
    groups = len(draws) * 2 << slice_bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            texts = Texts(block["_tail"].combine_chunks() if block["_tail"].num_chunks != 1 else block["_tail"].chunk(0))
            codes = [block[name].to_numpy().astype(np.uint64)[texts.rows] for name in ("_class", "_source")]
            for i, draw in enumerate(draws):
                out: dict[str, list] = {name: [] for name in ("part", "draw", "side", "slice", "packed")}
                for side, name in enumerate(_SIDES):
                    high, low = texts.md5(f"{seed}-{name}|{draw}".encode(), whole)
                    rest = high << np.uint64(slice_bits)
                    rows = np.stack([rest, low, codes[side]], axis=1) if whole else (rest >> np.uint64(bits[side]) << np.uint64(bits[side])) | codes[side]
                    ends = [len(rows)]
                    if slice_bits:
                        # Numbers of up to 16 bits are ordered by counting.
                        slices = (high >> np.uint64(64 - slice_bits)).astype(np.uint16 if slice_bits <= 16 else np.uint32)
                        rows, ends = rows[np.argsort(slices, kind="stable")], np.cumsum(np.bincount(slices, minlength=1 << slice_bits)).tolist()
                    for k, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                        if end > start:
                            group = (2 * i + side << slice_bits) + k
                            for column, value in zip(out.values(), (group * parts // groups, draw, side, k, rows[start:end].tobytes()), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["draw"], pa.int64()), pa.array(out["side"], pa.int32()), pa.array(out["slice"], pa.int32()), pa.array(out["packed"], pa.binary())], names=list(out))

    return pack


def _gathered(batches: Iterator[pa.RecordBatch], keys: Sequence[str], values: Sequence[str]) -> Iterator[tuple[tuple, list]]:
    """The values of each key; a task has a few keys, whose sizes bound it."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for key, value in zip(zip(*[batch[k].to_pylist() for k in keys], strict=True), zip(*[batch[v].to_pylist() for v in values], strict=True), strict=True):
            held.setdefault(key, []).append(value)
    while held:
        key = next(iter(held))
        yield key, held.pop(key)


def _sorting(bits: tuple[int, int], whole: bool) -> Callable:
    """Codes in the order of the digests, and how often rows of different codes had equal leading bits."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (draw, side, k), values in _gathered(batches, ("draw", "side", "slice"), ("packed",)):
            rows = np.concatenate([np.frombuffer(value, "<u8") for (value,) in values])
            if whole:
                high, low, codes = rows.reshape(-1, 3).T
                # Rows of one digest have one key; they follow each other by their codes.
                codes, ties = codes[np.lexsort((codes, low, high))], 0
            else:
                rows.sort()
                shift = np.uint64(bits[side])
                leading = rows >> shift
                equal = np.flatnonzero(leading[1:] == leading[:-1])
                ties = int(np.count_nonzero(rows[equal] != rows[equal + 1]))
                codes = rows & ((np.uint64(1) << shift) - np.uint64(1))
            codes = codes.astype(_code_type(bits[side]))
            columns = ([draw], pa.int64()), ([side], pa.int32()), ([k], pa.int32()), ([len(codes)], pa.int64()), ([ties], pa.int64()), ([codes.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(*column) for column in columns], names=["draw", "side", "slice", "n", "ties", "codes"])

    return sort


def _cutting(starts: dict[tuple[int, int, int], int], draws: Sequence[int], chunks: int, bits: tuple[int, int], parts: int) -> Callable:
    """Slices cut where a chunk of ranks ends; draws that have no start are left out."""
    widths = [np.dtype(_code_type(b)).itemsize for b in bits]
    number = {draw: i for i, draw in enumerate(draws)}
    most = CHUNK_ROWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draw, side, k, n, codes in zip(*[batch[name].to_pylist() for name in ("draw", "side", "slice", "n", "codes")], strict=True):
                if (draw, side, k) not in starts:
                    continue
                start, width = starts[draw, side, k], widths[side]
                for chunk in range(start // most, (start + n - 1) // most + 1):
                    low, high = max(start, chunk * most), min(start + n, (chunk + 1) * most)
                    part = (number[draw] * chunks + chunk) * parts // (len(draws) * chunks)
                    columns = ([part], pa.int32()), ([draw], pa.int64()), ([chunk], pa.int64()), ([side], pa.int32()), ([low - chunk * most], pa.int64()), ([codes[(low - start) * width : (high - start) * width]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(*column) for column in columns], names=["part", "draw", "chunk", "side", "at", "codes"])

    return cut


def _counting(bits: tuple[int, int], classes: int, sources: int) -> Callable:
    """Cells of both orders side by side, chunk by chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (draw, _), values in _gathered(batches, ("draw", "chunk"), ("side", "at", "codes")):
            orders = [np.concatenate([np.frombuffer(codes, _code_type(bits[side])) for own, _, codes in sorted(values, key=lambda v: v[1]) if own == side]) for side in (0, 1)]
            if len(orders[0]) != len(orders[1]):
                raise ValueError(f"Draw {draw} has {len(orders[0])} and {len(orders[1])} rows in one chunk of ranks")
            if classes * sources <= DENSE_CELLS:
                cells = np.zeros(classes * sources, np.int64)
                for at in range(0, len(orders[0]), BLOCK_ROWS):
                    to, give = (order[at : at + BLOCK_ROWS].astype(np.int64) for order in orders)
                    cells += np.bincount(give * classes + to, minlength=len(cells))
                found = np.flatnonzero(cells)
                counts = cells[found]
            else:
                found, counts = np.unique(orders[1].astype(np.int64) * classes + orders[0], return_counts=True)
            for at in range(0, len(found), SENT_ROWS):
                own = found[at : at + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(own), draw), own // classes, own % classes, counts[at : at + SENT_ROWS])], names=["draw", "_source", "_class", "_n"])

    return count


def _numbered(levels: DataFrame, label: str) -> DataFrame:
    """Distinct rows with numbers 0, 1, ... in the column ``label``."""
    marked = written(levels.withColumn("_mark", F.monotonically_increasing_id()), label)
    ranked = hash_rank(marked.withColumn("_mark", F.col("_mark").cast("string")), "_mark", label, out=label)
    return written(ranked.withColumn(label, F.col(label).cast("bigint") - 1).drop("_mark"), label)


def _tied(spark: SparkSession, coded: DataFrame, draws: Sequence[int], seed: object, total: int, sizes: tuple[int, int], whole: bool, finish: Callable[[DataFrame], None]) -> list[int]:
    """Count a batch of draws; those in which leading bits could not order all rows are left out and returned."""
    bits, slice_bits = tuple(map(_code_bits, sizes)), _slice_bits(total)
    least, rows = spark.sparkContext.defaultParallelism, 2 * total * len(draws)
    parts = min(len(draws) * 2 << slice_bits, max(least, -(-rows // SLICE_ROWS)))
    packed = coded.mapInArrow(_packing(seed, draws, bits, slice_bits, parts, whole), _PACKED)
    orders = written(packed.repartitionById(parts, F.col("part")).drop("part").mapInArrow(_sorting(bits, whole), _ORDERS), "rank-orders")
    # One short row per draw, side and slice.
    found = orders.select("draw", "side", "slice", "n", "ties").orderBy("draw", "side", "slice").collect()
    ranked = {(draw, side): 0 for draw in draws for side in (0, 1)}
    starts = {}
    for row in found:
        starts[row["draw"], row["side"], row["slice"]] = ranked[row["draw"], row["side"]]
        ranked[row["draw"], row["side"]] += row["n"]
    if set(ranked.values()) != {total}:
        raise ValueError(f"Orders of {total} rows have {sorted(set(ranked.values()))}")
    ties = sorted({row["draw"] for row in found if row["ties"]})
    kept = {key: start for key, start in starts.items() if key[0] not in ties}
    if kept:
        chunks = -(-total // CHUNK_ROWS)
        parts = min(len(draws) * chunks, max(least, -(-rows // CHUNK_ROWS)))
        cut = orders.mapInArrow(_cutting(kept, draws, chunks, bits, parts), _CUT).repartitionById(parts, F.col("part"))
        finish(cut.drop("part").mapInArrow(_counting(bits, *sizes), _COUNTS))
    released(spark, "rank-orders")
    return ties


def permuted_counts(rows: DataFrame, key: str, source: str, targets: Sequence[str], draws: int, seed: object) -> DataFrame:
    """(draw, target, u, v, n): what :func:`~cellshift.operators.inference.permuted_contingency` counts, without its shuffle of draws x rows.

    Hashing still costs draws x rows.  Leading bits of the digests order the rows of
    nearly every draw; a draw in which two rows share them is made again with whole
    digests.  Counts are written once to the scratch folder.
    """
    spark = rows.sparkSession
    text: Callable[[str], Column] = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("<NA>"))
    tail = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")).cast("binary")
    with shuffles_dropped(spark):
        named = written(rows.select(tail.alias("_tail"), text(source).alias("_u"), *[text(name).alias(name) for name in targets]), "named-rows")
        total = named.count()
        classes = _numbered(named.groupBy(*targets).agg(F.count(F.lit(1)).alias("_n")).drop("_n"), "_class")
        sources = _numbered(named.groupBy("_u").agg(F.count(F.lit(1)).alias("_n")).drop("_n"), "_source")
        sizes = (classes.count(), sources.count())
        blocks = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK_ROWS))
        coded = written(named.join(classes, list(targets)).join(sources, "_u").select("_tail", "_class", "_source").repartition(blocks, "_tail"), "coded-rows")
        released(spark, "named-rows")
        path = scratch_path(spark, "permuted-contingency")
        options = F.array(*[F.struct(F.lit(name).alias("target"), F.col(name).alias("v")) for name in targets])

        def finish(counts: DataFrame) -> None:
            """Counts of a batch by the levels of every target, beside those of the batches before."""
            levels = counts.join(classes, "_class").join(sources, "_source").select("draw", F.col("_u").alias("u"), F.explode(options).alias("t"), "_n")
            levels.groupBy("draw", F.col("t.target").alias("target"), "u", F.col("t.v").alias("v")).agg(F.sum("_n").alias("n")).write.mode("append").parquet(path)

        spark.createDataFrame([], "draw bigint, target string, u string, v string, n bigint").write.parquet(path)
        size = max(BATCH_DRAWS, BATCH_ROWS // max(1, total))
        leading = 64 - _code_bits(max(sizes)) + _slice_bits(total)
        whole = total * total / 2.0 ** (leading + 1) > EXPECTED_TIES
        todo, again = list(range(draws)) if total else [], []
        while todo or again:
            batch, whole = (todo[:size], whole) if todo else (again[:size], True)
            tied = _tied(spark, coded, batch, seed, total, sizes, whole, finish)
            todo, again = (todo[size:], again + tied) if todo else ([], again[size:])
        released(spark, "coded-rows")
    return spark.read.parquet(path)
