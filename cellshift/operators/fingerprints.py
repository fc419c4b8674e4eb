"""Row-order-independent table fingerprints with constant-size state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each sha256 digest is cut into four 60-bit words that are summed as exact decimals.
WORDS, WORD_DIGITS = 4, 15


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of the row's canonical text: column=value pairs in name order, null distinct from empty."""
    parts = []
    for name in sorted(columns):
        value = F.col(name).cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("null"))))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def multiset_digest(digest: Column | str) -> Column:
    """Aggregate: fingerprint of a multiset of row digests.

    Sums of the digest words do not depend on order and merge on the map side,
    so neither a sort nor a list of rows is needed, whatever the group size.
    """
    digest = F.col(digest) if isinstance(digest, str) else digest
    words = []
    for position in range(WORDS):
        word = F.conv(F.substring(digest, 1 + position * WORD_DIGITS, WORD_DIGITS), 16, 10).cast("decimal(20,0)")
        words.append(F.sum(word).cast("string"))
    return F.sha2(F.concat_ws("-", F.count(digest).cast("string"), *words), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_rows, fingerprint): equal for equal row multisets, whatever the order."""
    names = [name for name in (columns or df.columns) if name not in by]
    return (
        df.select(*by, row_digest(names).alias("_d"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), multiset_digest("_d").alias("fingerprint"))
    )
