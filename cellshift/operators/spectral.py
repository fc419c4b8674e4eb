"""Leading eigenvectors of large symmetric matrices held as long tables.

A block of ``width`` vectors is one row per key with an array of numbers.  A round applies
the matrix by joins and sums, then forms three small products of the old and the new
block; only those width x width numbers reach the driver, which solves the projected
problem and sends back the coefficients of the next block.  Neither the matrix nor a
vector is ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.session import released, written

OVERSAMPLE = 8
TOLERANCE = 1e-6
ROUNDS = 300


def summed_block(value: Column, block: str, width: int) -> Column:
    """Sum over a group of a number times a block row, element by element."""
    return F.array(*[F.sum(value * F.get(F.col(block), F.lit(k))) for k in range(width)])


def normal_product(entries: DataFrame, row: str, column: str, value: str) -> Callable[[DataFrame, int], DataFrame]:
    """The map v -> A'(A v) of a long matrix, between tables (key, v)."""

    def apply(block: DataFrame, width: int) -> DataFrame:
        scores = entries.join(block.select(F.col("key").alias(column), "v"), column).groupBy(row).agg(summed_block(F.col(value), "v", width).alias("s"))
        return entries.join(scores, row).groupBy(F.col(column).alias("key")).agg(summed_block(F.col(value), "s", width).alias("z"))

    return apply


def symmetric_product(entries: DataFrame, row: str, column: str, value: str, shift: float = 0.0) -> Callable[[DataFrame, int], DataFrame]:
    """The map v -> (G + shift) v of a long symmetric matrix, between tables (key, v)."""

    def apply(block: DataFrame, width: int) -> DataFrame:
        product = entries.join(block.select(F.col("key").alias(column), "v"), column).groupBy(F.col(row).alias("key")).agg(summed_block(F.col(value), "v", width).alias("z"))
        if not shift:
            return product
        moved = F.transform("v", lambda x, i: x * F.lit(shift) + F.coalesce(F.get(F.col("z"), i), F.lit(0.0)))
        return block.join(product, "key", "left").select("key", moved.alias("z"))

    return apply


def _products(width: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, width))
        for batch in batches:
            v, z = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().reshape(-1, width) for c in ("v", "z"))
            total += np.stack([v.T @ v, v.T @ z, z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["place", "x"])

    return sums


def small_products(pair: DataFrame, width: int) -> np.ndarray:
    """V'V, V'Z and Z'Z of a table (v, z): partial sums per task, added up by place."""
    sums = pair.select("v", "z").mapInArrow(_products(width), "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    out = np.zeros(3 * width * width)
    for row in sums.collect():
        out[row.place] = row.x
    return out.reshape(3, width, width)


def combined(block: str, coefficients: np.ndarray) -> Column:
    """Block row times a small matrix."""
    parts = [F.get(F.col(block), F.lit(j)) for j in range(coefficients.shape[0])]
    return F.array(*[sum((part * F.lit(float(c)) for part, c in zip(parts, column, strict=True)), F.lit(0.0)) for column in coefficients.T])


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """Coefficients that make a block with this Gram matrix orthonormal; directions without length become zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    fine = values > max(values.max(), 0.0) * 1e-14
    return vectors * np.where(fine, 1 / np.sqrt(np.where(fine, values, 1.0)), 0.0)


def leading(apply: Callable[[DataFrame, int], DataFrame], keys: DataFrame, rank: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS, by_size: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, v) with the ``rank`` leading eigenvectors in ``v``, their values and residual norms.

    ``keys`` has one distinct non-null ``key`` per dimension.  The largest values lead, or
    with ``by_size`` the largest by absolute value.  The block holds ``OVERSAMPLE`` vectors
    more than asked for, started from key digests.  Rounds end when every leading pair's
    residual is below ``tolerance`` times the largest value; a matrix that needs more than
    ``rounds`` is refused.  Ranks beyond the number of keys come out as zero vectors.
    """
    keys = written(keys.select("key"), "spectral-keys")
    width = max(1, min(rank + OVERSAMPLE, keys.count()))
    kept = min(rank, width)
    start = F.array(*[F.xxhash64("key", F.lit(k)).cast("double") / float(1 << 63) for k in range(width)])
    block = written(keys.select("key", start.alias("v")), "spectral-block")
    zero = F.array(*[F.lit(0.0)] * width)
    for _ in range(rounds):
        product = apply(block, width)
        pair = written(block.join(product, "key", "left").select("key", "v", F.coalesce("z", zero).alias("z")), "spectral-pair")
        vv, vz, zz = small_products(pair, width)
        whiten = _inverse_root(vv)
        inner = whiten.T @ vz @ whiten
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-(abs(values) if by_size else values), kind="stable")
        values, ritz = values[order], whiten @ turn[:, order]
        squares = np.einsum("ik,ij,jk->k", ritz, zz, ritz) - 2 * values * np.einsum("ik,ij,jk->k", ritz, vz, ritz) + values**2 * np.einsum("ik,ij,jk->k", ritz, vv, ritz)
        residuals = np.sqrt(np.maximum(squares, 0.0))
        largest = float(abs(values).max())
        if largest == 0.0 or width == 1 or (residuals[:kept] <= tolerance * largest).all():
            pad = np.zeros((width, rank))
            real = abs(values[:kept]) > largest * 1e-12
            pad[:, :kept] = np.where(real, ritz[:, :kept], 0.0)
            full = lambda x: np.concatenate([np.where(real, x[:kept], 0.0), np.zeros(rank - kept)])
            found = written(pair.select("key", combined("v", pad).alias("v")), "spectral-vectors")
            released(keys.sparkSession, "spectral-keys", "spectral-block", "spectral-pair")
            return found, full(values), full(residuals)
        block = written(pair.select("key", combined("z", _inverse_root(zz)).alias("v")), "spectral-block")
    raise ValueError(f"No convergence in {rounds} rounds, residuals {residuals[:kept].tolist()}; the leading values lie too close together")


def anchored(vectors: DataFrame, rank: int) -> DataFrame:
    """(key, component, x) with each component's sign set by its largest entry, ties to the smallest key."""
    long = vectors.select("key", F.posexplode("v").alias("component", "x"))
    sign = long.groupBy("component").agg(F.min_by("x", F.struct(-F.abs("x"), F.col("key"))).alias("anchor"))
    return long.join(sign, "component").select("key", F.col("component").cast("bigint").alias("component"), F.when(F.col("anchor") < 0, -F.col("x")).otherwise(F.col("x")).alias("x"))


def value_table(component: Column, values: np.ndarray) -> Column:
    """Look up a component's number in a short list."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), component.cast("int"))
