"""Distributed ranks, winners and shuffles without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions.numbers import text_hash


def hash_rank(
    df: DataFrame,
    key: str,
    seed: object,
    by: Sequence[str] = (),
    largest_first: str | None = None,
    out: str = "rank",
    bucket_digits: int = 3,
) -> DataFrame:
    """1-based rank of unique keys in md5(seed|key) order, inside optional groups.

    A plain global window would sort every row in one task.  Here the digest
    prefix splits each group into ``16**bucket_digits`` even buckets; only the
    bucket counts are accumulated, and each bucket is ordered on its own.  With
    ``largest_first`` the rank goes by that column descending before the digest.
    """
    lead = [largest_first] if largest_first else []
    digest = text_hash(F.lit(str(seed)), F.col(key))
    # Sixteen bytes sort as their 32 digits do.
    tagged = df.withColumn("_bucket", F.substring(digest, 1, bucket_digits)).withColumn("_digest", F.unhex(digest))
    slot = [*by, *lead, "_bucket"]
    running = (
        Window.partitionBy(*by)
        .orderBy(*[F.desc(name) for name in lead], F.asc("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*slot)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*slot).orderBy("_digest", key)
    # Merged, since estimates may take either side for small; the window needs the same shuffle of the rows anyway.
    return (
        tagged.hint("merge").join(offsets, slot)
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_digest", "_bucket", "_before")
    )


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Keep one winner per group by a lexicographic order of ``(column, descending)``.

    Runs as a partially aggregated minimum of a struct, so a hot group is
    reduced on the map side.  Numeric columns may be descending; missing values
    lose.
    """
    fields: list[Column] = []
    for position, (name, descending) in enumerate(order):
        value = F.col(name)
        fields.append(value.isNull().alias(f"_null{position}"))
        fields.append((-value if descending else value).alias(f"_key{position}"))
    payload = F.struct(*[F.col(name) for name in df.columns])
    ordered = F.struct(*fields)
    winner = F.min_by(payload, ordered).alias("_winner")
    result = df.groupBy(*by).agg(winner) if by else df.agg(winner)
    return result.select("_winner.*")


def snake_fold(rank: Column, folds: int) -> Column:
    """Deal ranked groups to folds back and forth so big and small groups even out."""
    position = rank - F.lit(1)
    lap = F.floor(position / F.lit(folds))
    step = F.pmod(position, F.lit(folds))
    return F.when(F.pmod(lap, F.lit(2)) == 0, step).otherwise(F.lit(folds - 1) - step).cast("bigint")


def shifted_donor(df: DataFrame, key: str, seed: object, shift: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Pair every key with the key ``shift`` places on in hash order (a derangement).

    Returns ``by + [recipient, donor]``.  ``shift`` must not be a multiple of the
    group size, else a key would meet itself.
    """
    ranked = hash_rank(df.select(*by, key), key, seed, by=by, out="_place")
    totals = ranked.groupBy(*by).agg(F.max("_place").alias("_n")) if by else ranked.agg(F.max("_place").alias("_n"))
    if by:
        sized = ranked.join(totals, list(by))
    else:
        sized = ranked.withColumn("_n", totals.scalar())
    recipients = sized.withColumn("_want", F.pmod(F.col("_place") - 1 + F.lit(shift), F.col("_n")) + 1)
    donors = ranked.select(*by, F.col(key).alias("donor"), F.col("_place").alias("_want"))
    return recipients.join(donors, [*by, "_want"]).select(*by, F.col(key).alias("recipient"), "donor")
