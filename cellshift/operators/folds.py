"""Hold-out folds as compact tables: candidates, excluded rows and support by subtraction.

Fold membership is a number per row whose bit k tells about fold k: bits of the folds
that fit on the row, and of the folds that score it.  Bits of an entity's rows are OR-ed
in one partial aggregation, so leaks and missing representation are AND operations on one
number per entity, and no row is copied per fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions.numbers import hash_int, text_hash
from cellshift.functions.text import composite_key
from cellshift.operators.fingerprints import multiset_digest
from cellshift.operators.ranking import hash_rank, snake_fold

# Hold-out scenarios.
SCENARIOS = ("S1", "S2", "S3", "R00", "R10", "R01", "R11", "time", "RT", "time_forward", "plate")
GRID_SCENARIOS = ("S3", "R00", "R11")

# Exclusion reasons of ineligible candidates.
REASON_NOT_LATEST = "not_context_max_time"
REASON_MIXED_AXIS = "would_mix_additional_OOD_axis"

CONTEXT_FIELDS = ("medium", "temperature")


# ----------------------------------------------------------- group-to-fold maps
def balanced_group_folds(rows: DataFrame, group: str, folds: int, seed: object) -> DataFrame:
    """Whole groups to folds, largest groups first, dealt in snake order: (group, n, fold)."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(sizes, group, seed, largest_first="n")
    return ranked.select(group, "n", snake_fold(F.col("rank"), folds).alias("fold"))


def deal_equal_groups(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` equal groups each fold gets when the least loaded fold always takes the next.

    The picks are the ``groups`` smallest values among ``load + j * size``, so a
    search for the last level replaces the walk over single groups.
    """
    below = lambda level: [max(0, -((load - level) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (groups + 1)
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
    counts = below(low)
    left = groups - sum(counts)
    for fold, load in enumerate(loads):
        if left and load + counts[fold] * size == low:
            counts[fold] += 1
            left -= 1
    return counts


def greedy_group_folds(rows: DataFrame, group: str, folds: int, seed: object) -> DataFrame:
    """Exact greedy balance: each group, largest first, goes to the least loaded fold.

    Groups of one size are interchangeable, so the sequential part only sees the
    histogram of group sizes - at most about ``sqrt(2 * rows)`` distinct sizes -
    and says how many groups of each size every fold takes.  The groups then
    find their fold by their place among groups of the same size.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(sizes, group, seed, by=["n"], out="_place")
    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches)).sort_values("n", ascending=False)
        loads, out = [0] * folds, []
        for size, groups in zip(table["n"].tolist(), table["groups"].tolist(), strict=True):
            place = 0
            for fold, count in enumerate(deal_equal_groups(loads, size, groups)):
                if count:
                    out.append((size, fold, place + 1, place + count))
                place += count
                loads[fold] += size * count
        yield pd.DataFrame(out, columns=["n", "fold", "_from", "_to"])

    plan = histogram.repartition(1).mapInPandas(deal, "n bigint, fold bigint, _from bigint, _to bigint")
    return ranked.join(plan, "n").filter(F.col("_place").between(F.col("_from"), F.col("_to"))).select(group, "n", "fold")


def nested_group_folds(rows: DataFrame, context: str, group: str, folds: int, seed: object) -> DataFrame:
    """Spread the groups of each context over the folds; single-group contexts are left out.

    The window runs over one row per (context, group), never over samples.
    """
    sizes = rows.groupBy(context, group).agg(F.count(F.lit(1)).alias("n"))
    digest = text_hash(F.lit(str(seed)), F.col(group))
    order = Window.partitionBy(context).orderBy(F.desc("n"), digest)
    start = hash_int(F.lit(str(seed)), F.col(context)) % F.lit(folds)
    return (
        sizes.withColumn("_place", F.row_number().over(order) - 1)
        .withColumn("_groups", F.count(F.lit(1)).over(Window.partitionBy(context)))
        .filter(F.col("_groups") >= 2)
        .select(context, group, "n", ((F.col("_place") + start) % F.lit(folds)).cast("bigint").alias("fold"))
    )


def round_robin_folds(groups: DataFrame, group: str, folds: int, seed: object) -> DataFrame:
    """Shuffled distinct groups dealt one after another."""
    ranked = hash_rank(groups.select(group).distinct(), group, seed)
    return ranked.select(group, ((F.col("rank") - 1) % F.lit(folds)).cast("bigint").alias("fold"))


def subsample_groups(rows: DataFrame, group: str, n_groups: int, seed: object) -> DataFrame:
    """Keep all rows of the first ``n_groups`` groups in hash order (a sampling operator)."""
    ranked = hash_rank(rows.select(group).distinct(), group, seed)
    return rows.join(ranked.filter(F.col("rank") <= n_groups).select(group), group, "left_semi")


# --------------------------------------------------------------- identity keys
def with_fold_keys(samples: DataFrame, strain_key: str = "strain", chemical_key: str = "chemical") -> DataFrame:
    """Add the pair, context (without time) and exact condition-time keys."""
    context = [strain_key, chemical_key, *CONTEXT_FIELDS]
    return samples.withColumns(
        {
            "pair_key": composite_key([strain_key, chemical_key]),
            "context_key": composite_key([*context, "pert_time_unit"]),
            "time_key": composite_key([*context, "pert_time", "pert_time_unit"]),
        }
    )


def with_axis_folds(
    train: DataFrame,
    folds: int,
    seeds: dict[str, object],
    strain_key: str = "strain",
    chemical_key: str = "chemical",
    axes: Sequence[str] = ("chemical", "strain", "time", "nested_time", "forward", "plate"),
) -> DataFrame:
    """Add one nullable fold column per hold-out axis (controls stay null on entity axes)."""
    keyed = with_fold_keys(train, strain_key, chemical_key)
    treated = keyed.filter(F.col("kind") == "treatment")
    result = keyed
    if "chemical" in axes:
        m = balanced_group_folds(treated, chemical_key, folds, seeds["chemical"])
        result = result.join(m.select(chemical_key, F.col("fold").alias("chemical_fold")), chemical_key, "left")
    if "strain" in axes:
        m = balanced_group_folds(treated, strain_key, folds, seeds["strain"])
        result = result.join(m.select(strain_key, F.col("fold").alias("strain_fold")), strain_key, "left")
    if "time" in axes:
        m = balanced_group_folds(treated, "time_key", folds, seeds["time"])
        result = result.join(m.select("time_key", F.col("fold").alias("time_fold")), "time_key", "left")
    if "nested_time" in axes:
        m = nested_group_folds(treated, "context_key", "time_key", folds, seeds["nested_time"])
        result = result.join(m.select("time_key", F.col("fold").alias("nested_time_fold")), "time_key", "left")
    if "forward" in axes:
        extent = treated.groupBy("context_key").agg(
            F.max("pert_time").alias("max_time"), F.countDistinct("pert_time").alias("_times")
        ).filter(F.col("_times") >= 2)
        several = treated.join(extent.select("context_key"), "context_key", "left_semi")
        m = balanced_group_folds(several, "context_key", folds, seeds["forward"])
        result = result.join(
            m.select("context_key", F.col("fold").alias("forward_fold")).join(extent.select("context_key", "max_time"), "context_key"),
            "context_key",
            "left",
        )
    if "plate" in axes:
        m = balanced_group_folds(keyed, "plate", folds, seeds["plate"])
        result = result.join(m.select("plate", F.col("fold").alias("plate_fold")), "plate", "left")
    return result


# ------------------------------------------------- candidates and fold masks
def fold_count(scenario: str, folds: int) -> int:
    return folds * folds if scenario in GRID_SCENARIOS else folds


# Folds that fit the bits of a long.
MOST_FOLDS = 62


def fold_bit(fold: Column) -> Column:
    """Number with the bit of a fold; null without one."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), fold.cast("int"))


def has_fold(mask: Column, fold: Column) -> Column:
    return mask.bitwiseAND(fold_bit(fold)) != 0


def every_fold(scenario: str, folds: int) -> int:
    """Bits of all folds of a scenario."""
    count = fold_count(scenario, folds)
    if count > MOST_FOLDS:
        raise ValueError(f"{scenario} has {count} folds, more than the {MOST_FOLDS} that fit a mask")
    return (1 << count) - 1


def excluded_mask(scenario: str, folds: int) -> Column:
    """Bits of the folds that keep a train row out of their fit set."""
    c, s, none = F.col("chemical_fold"), F.col("strain_fold"), F.lit(0).cast("bigint")
    if scenario in ("S3", "R00"):
        # A row leaves every grid fold of its strain part or its chemical part.
        shifted = lambda bits, by: F.coalesce(F.call_function("shiftleft", F.lit(bits).cast("bigint"), by.cast("int")), none)
        return shifted((1 << folds) - 1, s * folds).bitwiseOR(shifted(sum(1 << a * folds for a in range(folds)), c))
    if scenario == "time_forward":
        latest = (F.col("kind") == "treatment") & (F.col("pert_time") == F.col("max_time"))
        return F.coalesce(F.when(latest, fold_bit(F.col("forward_fold"))), none)
    held = {"S1": c, "R10": c, "S2": s, "R01": s, "R11": s * folds + c, "time": F.col("time_fold"), "RT": F.col("nested_time_fold"), "plate": F.col("plate_fold")}
    if scenario not in held:
        raise ValueError(f"Unknown scenario {scenario!r}")
    return F.coalesce(fold_bit(held[scenario]), none)


def with_fit_mask(axis: DataFrame, scenario: str, folds: int) -> DataFrame:
    """Add ``fit``: bits of the folds whose fit set holds the row."""
    return axis.withColumn("fit", F.lit(every_fold(scenario, folds)).cast("bigint").bitwiseAND(F.bitwise_not(excluded_mask(scenario, folds))))


def held_fold(axis: DataFrame, scenario: str, folds: int) -> Column:
    """Fold that could score a row: that of held-out treatments (of all held-out rows for plates), else null."""
    c, s = F.col("chemical_fold"), F.col("strain_fold")
    fold = {
        "S1": c,
        "R10": c,
        "S2": s,
        "R01": s,
        "S3": s * F.lit(folds) + c,
        "R00": s * F.lit(folds) + c,
        "R11": s * F.lit(folds) + c,
        "time": F.col("time_fold") if "time_fold" in axis.columns else None,
        "RT": F.col("nested_time_fold") if "nested_time_fold" in axis.columns else None,
        "time_forward": F.col("forward_fold") if "forward_fold" in axis.columns else None,
        "plate": F.col("plate_fold") if "plate_fold" in axis.columns else None,
    }[scenario]
    return fold if scenario == "plate" else F.when(F.col("kind") == "treatment", fold)


def candidate_rows(axis: DataFrame, scenario: str, folds: int) -> DataFrame:
    """Rows a fold could score: the held-out treatments (all held-out rows for plates)."""
    return axis.withColumn("fold", held_fold(axis, scenario, folds)).filter(F.col("fold").isNotNull())


# Which keys must stay represented in the fit set for a candidate to be scored.
REQUIRED_SUPPORT = {
    "S1": ("strain",),
    "R10": ("strain",),
    "S2": ("chemical",),
    "R01": ("chemical",),
    "S3": (),
    "R00": (),
    "R11": ("strain", "chemical"),
    "time": ("context", "time_value"),
    "RT": ("context", "time_value", "pair"),
    "time_forward": (),
    "plate": (),
}


def _with_support(candidates: DataFrame, fitted: DataFrame, column: str, flag: str) -> DataFrame:
    """Flag candidates whose key keeps at least one row in the fold's fit set."""
    kept = fitted.groupBy(column).agg(F.bit_or("fit").alias("_fit"))
    return candidates.join(kept, column, "left").withColumn(flag, F.coalesce(has_fold(F.col("_fit"), F.col("fold")), F.lit(False))).drop("_fit")


def assignment_table(
    axis: DataFrame, scenario: str, folds: int, strain_key: str = "strain", chemical_key: str = "chemical"
) -> DataFrame:
    """One row per candidate: fold, seen flags per axis, eligibility and exclusion reason."""
    fitted = with_fit_mask(axis, scenario, folds)
    rows = candidate_rows(axis, scenario, folds)
    for column, flag in ((strain_key, "strain_seen"), (chemical_key, "chemical_seen"), ("pair_key", "pair_seen"), ("time_key", "time_group_seen")):
        rows = _with_support(rows, fitted, column, flag)
    rules = {"strain": F.col("strain_seen"), "chemical": F.col("chemical_seen"), "pair": F.col("pair_seen")}
    if scenario in ("time", "RT"):
        rows = _with_support(rows, fitted, "context_key", "_context_seen")
        rows = _with_support(rows, fitted, "pert_time", "_time_seen")
        rules |= {"context": F.col("_context_seen"), "time_value": F.col("_time_seen")}
    eligible = reduce(lambda a, b: a & b, [rules[name] for name in REQUIRED_SUPPORT[scenario]], F.lit(True))
    if scenario == "time_forward":
        eligible = F.col("pert_time") == F.col("max_time")
    reason = REASON_NOT_LATEST if scenario == "time_forward" else REASON_MIXED_AXIS
    return rows.withColumn("eligible", eligible).select(
        F.lit(scenario).alias("scenario"),
        "fold",
        "sample_id",
        F.col(strain_key).alias("strain_key"),
        F.col(chemical_key).alias("chemical_key"),
        "pair_key",
        "context_key",
        "time_key",
        "pert_time",
        "plate",
        "strain_seen",
        "chemical_seen",
        "pair_seen",
        "time_group_seen",
        "eligible",
        F.when(F.col("eligible"), "").otherwise(reason).alias("exclusion_reason"),
    )


def membership(axis: DataFrame, scenario: str, folds: int) -> DataFrame:
    """Train rows with ``fit`` and ``valid``: bits of the folds that fit on the row, and that score it.

    A candidate is scored where the keys it needs keep a row in the fit set.
    """
    rows = with_fit_mask(axis, scenario, folds)
    key_of = {"strain": "strain", "chemical": "chemical", "pair": "pair_key", "context": "context_key", "time_value": "pert_time"}
    # The fold is a column of the row itself: no table of all samples is joined, or broadcast, to find it.
    valid = F.coalesce(fold_bit(held_fold(axis, scenario, folds)), F.lit(0).cast("bigint"))
    if scenario == "time_forward":
        valid = F.when(F.col("pert_time") == F.col("max_time"), valid).otherwise(F.lit(0).cast("bigint"))
    out = rows.withColumn("valid", valid)
    for name in REQUIRED_SUPPORT[scenario]:
        kept = rows.groupBy(key_of[name]).agg(F.bit_or("fit").alias("_kept"))
        out = out.join(kept, key_of[name], "left").withColumn("valid", F.col("valid").bitwiseAND(F.coalesce("_kept", F.lit(0).cast("bigint")))).drop("_kept")
    return out.withColumnsRenamed({"strain": "strain_key", "chemical": "chemical_key"})


def folds_of(mask: Column, count: int) -> Column:
    """List of the folds whose bits are set."""
    return F.filter(F.array(*[F.lit(k).cast("bigint") for k in range(count)]), lambda k: has_fold(mask, k))


def per_fold(rows: DataFrame, mask: str, count: int, measures: dict[str, Column]) -> DataFrame:
    """(fold, measures): aggregates over the rows of each fold, from one pass; folds without rows are left out.

    A measure is an aggregate of a column ``inside``, which is true for the rows of the fold.
    """
    each = [F.struct(F.lit(k).cast("bigint").alias("fold"), F.count(F.when(has_fold(F.col(mask), F.lit(k)), F.lit(1))).alias("_rows"), *[build(has_fold(F.col(mask), F.lit(k))).alias(name) for name, build in measures.items()]) for k in range(count)]
    return rows.agg(F.array(*each).alias("f")).select(F.explode("f").alias("f")).select("f.*").filter("_rows > 0").drop("_rows")


# ------------------------------------------------------------------- isolation
# Per scenario, keys that must be absent from / present in the fit set.
ABSENT = {
    "S1": ("chemical_key",),
    "S2": ("strain_key",),
    "S3": ("strain_key", "chemical_key"),
    "R00": ("strain_key", "chemical_key"),
    "R10": ("chemical_key",),
    "R01": ("strain_key",),
    "R11": ("pair_key",),
    "time": ("time_key",),
    "RT": ("time_key",),
    "time_forward": (),
    "plate": ("plate",),
}
PRESENT = {
    "R10": ("strain_key",),
    "R01": ("chemical_key",),
    "R11": ("strain_key", "chemical_key"),
    "RT": ("strain_key", "chemical_key", "pair_key"),
}


def isolation_violations(rows: DataFrame, scenario: str, folds: int) -> DataFrame:
    """Violating keys of one scenario: (scenario, fold, rule, key); empty when isolated.

    ``rows`` are those of :func:`membership`, one per sample.  All keys are met in one
    aggregation: a key that must be absent leaks in the folds of valid AND fit, a key that
    must be represented is missing in those of valid AND NOT fit.
    """
    count = fold_count(scenario, folds)
    kinds = [(key, f"{key}_leaks", True) for key in ABSENT[scenario]] + [(key, f"{key}_not_represented", False) for key in PRESENT.get(scenario, ())]
    keyed = [F.struct(F.lit(rule).alias("rule"), F.lit(leak).alias("leak"), F.col(key).cast("string").alias("key")) for key, rule, leak in [("sample_id", "sample_in_both", True), *kinds]]
    masks = rows.select(F.explode(F.array(*keyed)).alias("k"), "fit", "valid").groupBy("k.rule", "k.leak", "k.key").agg(F.bit_or("fit").alias("fit"), F.bit_or("valid").alias("valid"))
    bad = F.col("valid").bitwiseAND(F.when(F.col("leak"), F.col("fit")).otherwise(F.bitwise_not(F.col("fit"))))
    parts = [masks.filter(bad != 0).select(F.explode(folds_of(bad, count)).alias("fold"), "rule", "key")]
    if scenario == "time_forward":
        times = [
            F.struct(
                F.lit(k).cast("bigint").alias("fold"),
                F.min(F.when(has_fold(F.col("valid"), F.lit(k)), F.col("pert_time"))).alias("first"),
                F.max(F.when(has_fold(F.col("fit"), F.lit(k)), F.col("pert_time"))).alias("last"),
            )
            for k in range(count)
        ]
        late = rows.groupBy(F.col("context_key").alias("key")).agg(F.array(*times).alias("t")).select("key", F.explode("t").alias("t")).select("key", "t.*")
        late = late.filter(F.col("first").isNotNull() & (F.col("last").isNull() | (F.col("last") >= F.col("first"))))
        parts.append(late.select("fold", F.lit("fit_not_earlier").alias("rule"), "key"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(scenario).alias("scenario"), "fold", "rule", "key")


def fold_fingerprints(rows: DataFrame, mask: str, count: int, key: str = "sample_id") -> DataFrame:
    """(fold, n_rows, ids_sha256): row count and order-free id fingerprint of the rows with each fold's bit, from one pass."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    return per_fold(rows, mask, count, {"n_rows": lambda inside: F.count(F.when(inside, F.lit(1))), "ids_sha256": lambda inside: multiset_digest(F.when(inside, digest))})


def inner_group_folds(rows: DataFrame, group: str, folds: int, inner: int, seed: object) -> DataFrame:
    """(outer_fold, group, n, inner_fold): snake order of the groups inside every outer fit set of (group, fit).

    Groups are counted per mask first, so only groups are repeated per outer fold.
    """
    counted = rows.groupBy(group, "fit").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.select(F.explode(folds_of(F.col("fit"), folds)).alias("outer_fold"), group, "n").groupBy("outer_fold", group).agg(F.sum("n").alias("n"))
    ranked = hash_rank(sizes, group, seed, by=["outer_fold"], largest_first="n")
    return ranked.select("outer_fold", group, "n", snake_fold(F.col("rank"), inner).alias("inner_fold"))


def scoring_pool(rows: DataFrame, scenario: str, folds: int) -> DataFrame:
    """Rows with ``pool``: bits of the folds whose control pool holds the row, its fit rows and every train control."""
    whole = F.lit(every_fold(scenario, folds)).cast("bigint")
    return rows.withColumn("pool", F.when(F.col("kind") == "control", whole).otherwise(F.col("fit")))
