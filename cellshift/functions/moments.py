"""Mergeable pair moments and the scores derived from them.

Two forms are offered.  *Additive* moments (plain sums) can be stored, merged,
weighted and resampled.  *Central* forms use Spark's streaming variance and
covariance aggregates, which stay exact for constant inputs and are used when a
score is read directly from cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellshift.functions.numbers import ratio

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")

# Standard deviations up to this size count as zero in the official scores.
STD_FLOOR = 1e-8


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _where(value: Column, condition: Column | None) -> Column:
    return value if condition is None else F.when(condition, value)


def moment_aggs(x: Column | str, y: Column | str, where: Column | None = None, suffix: str = "") -> list[Column]:
    """Six additive sums over the rows where both values exist (and ``where`` holds)."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    both = both if where is None else both & where
    total = lambda value, name: F.coalesce(F.sum(F.when(both, value)), F.lit(0.0)).alias(name + suffix)
    return [
        F.count(F.when(both, F.lit(1))).alias("n" + suffix),
        total(x, "sx"),
        total(y, "sy"),
        total(x * x, "sxx"),
        total(y * y, "syy"),
        total(x * y, "sxy"),
    ]


def merge_aggs(weight: Column | None = None, suffix: str = "") -> list[Column]:
    """Sum stored moments, optionally weighted (bootstrap multiplicities)."""
    weight = F.lit(1.0) if weight is None else weight
    return [F.sum(F.col(name + suffix) * weight).alias(name + suffix) for name in MOMENTS]


def pearson_from_moments(suffix: str = "", std_floor: float = 0.0) -> Column:
    """Correlation from additive moments; null below two rows or without variance."""
    n, sx, sy, sxx, syy, sxy = [F.col(name + suffix) for name in MOMENTS]
    vx = sxx - ratio(sx * sx, n)
    vy = syy - ratio(sy * sy, n)
    # Sums of squares carry rounding noise; variance below it is no variance.
    noise = F.lit(1e-13)
    floor = n * F.lit(std_floor * std_floor)
    defined = (n >= 2) & (vx > F.greatest(floor, sxx * noise)) & (vy > F.greatest(floor, syy * noise))
    return F.when(defined, ratio(sxy - ratio(sx * sy, n), F.sqrt(vx * vy)))


def pearson_agg(x: Column | str, y: Column | str, where: Column | None = None, std_floor: float = STD_FLOOR) -> Column:
    """Correlation over a group, null when undefined."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    both = both if where is None else both & where
    px, py = F.when(both, x), F.when(both, y)
    vx, vy = F.var_pop(px), F.var_pop(py)
    floor = F.lit(std_floor * std_floor)
    return F.when((F.count(px) >= 2) & (vx > floor) & (vy > floor), ratio(F.covar_pop(px, py), F.sqrt(vx * vy)))


def r2_agg(prediction: Column | str, truth: Column | str, min_rows: int = 2, sst_floor: float = 1e-8) -> Column:
    """Coefficient of determination over a group, null when undefined."""
    p, t = _col(prediction), _col(truth)
    both = p.isNotNull() & t.isNotNull()
    pt = F.when(both, t)
    sst = F.var_pop(pt) * F.count(pt)
    sse = F.sum(F.when(both, (p - t) * (p - t)))
    return F.when((F.count(pt) >= min_rows) & (sst > F.lit(sst_floor)), F.lit(1.0) - ratio(sse, sst))


def high_effect_counts(
    prediction: Column | str, truth: Column | str, threshold: float = 1.0, suffix: str = ""
) -> list[Column]:
    """Counts behind the high-effect scores: true, predicted, agreeing, true with right sign."""
    p, t = _col(prediction), _col(truth)
    both = p.isNotNull() & t.isNotNull()
    high_true = both & (F.abs(t) > threshold)
    high_pred = both & (F.abs(p) > threshold)
    same = F.signum(p) == F.signum(t)
    count = lambda condition, name: F.count(F.when(condition, F.lit(1))).alias(name + suffix)
    return [
        count(high_true, "n_high_true"),
        count(high_pred, "n_high_pred"),
        count(high_true & high_pred & same, "n_high_hit"),
        count(high_true & same, "n_high_sign"),
    ]


def high_effect_scores(suffix: str = "", zero_when_no_hit: bool = False) -> list[Column]:
    """Direction accuracy, precision, recall and F1 from the counts.

    F1 is undefined without a hit; ``zero_when_no_hit`` selects the other
    published convention (zero as long as any cell is high on either side).
    """
    ht, hp, hit, sign = [F.col(name + suffix) for name in ("n_high_true", "n_high_pred", "n_high_hit", "n_high_sign")]
    f1 = ratio(F.lit(2.0) * hit, hp + ht)
    if not zero_when_no_hit:
        f1 = F.when(hit > 0, f1)
    return [
        ratio(sign, ht).alias("high_effect_direction_accuracy" + suffix),
        ratio(hit, hp).alias("high_effect_precision" + suffix),
        ratio(hit, ht).alias("high_effect_recall" + suffix),
        f1.alias("high_effect_f1" + suffix),
    ]
