"""Paired and clustered bootstrap, association measures and permutation nulls.

Draws come from md5 of (seed, draw, slot), so every run and every engine picks
the same units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions.numbers import hash_int, ratio
from cellshift.operators.metrics import merged_moments, response_moments, scores_from_moments
from cellshift.operators.ranking import hash_rank
from cellshift.session import written


# --------------------------------------------------------------------- resampling
def draw_picks(ranked: DataFrame, by: Sequence[str], draws: int, seed: object, rank: str = "_rank", size: str = "_n") -> DataFrame:
    """(by, draw, pick): every unit is one slot and picks a unit of its group in each draw."""
    slots = ranked.select(*by, rank, size).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")))
    pick = hash_int(F.lit(str(seed)), F.col("draw"), F.col(rank)) % F.col(size) + 1
    return slots.select(*by, "draw", pick.alias("pick"))


def _ranked_units(units: DataFrame, by: Sequence[str], unit: str, seed: object) -> DataFrame:
    ranked = hash_rank(units, unit, f"{seed}-units", by=by, out="_rank")
    if by:
        return ranked.join(units.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by))
    return ranked.withColumn("_n", F.lit(units.agg(F.count(F.lit(1))).scalar()))


# Units of a group up to which their values travel as one array, and slices of the draws.
ROW_UNITS, DRAW_SLICES = 2_000, 32


def _means_in_rows(ranked: DataFrame, by: Sequence[str], draws: int, seed: object) -> DataFrame:
    """(by, draw, _m) without a row per unit and draw: a group's values are looked up in one array.

    The picks are those of :func:`draw_picks`.
    """
    packed = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda x: x["_v"]).alias("_values"))
    sliced = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(DRAW_SLICES - 1)))).repartition(*by, "_slice")
    each = F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")
    spread = sliced.withColumn("draw", F.explode(F.filter(each, lambda d: F.pmod(d, F.lit(DRAW_SLICES)) == F.col("_slice"))))
    size = F.size("_values")
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0.0),
        lambda acc, rank: acc + F.element_at("_values", (hash_int(F.lit(str(seed)), F.col("draw"), rank) % size + 1).cast("int")),
    )
    return spread.select(*by, "draw", (total / size).alias("_m"))


def bootstrap_means(units: DataFrame, by: Sequence[str], unit: str, value: str, draws: int = 10_000, seed: object = 0) -> DataFrame:
    """Mean, 95 % interval and P(mean > 0) of per-unit deltas; undefined deltas are left out.

    Resampling happens on units (entities, folds, clusters), never on cells.
    """
    by = list(by)
    usable = units.select(*by, F.col(unit).cast("string").alias("_unit"), F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    # One row per unit, but usually the end of a long plan over cells: stored once, read by every branch below.
    usable = written(usable, "bootstrap-units")
    ranked = _ranked_units(usable, by, "_unit", seed)
    if (ranked.agg(F.max("_n")).first()[0] or 0) <= ROW_UNITS:
        means = _means_in_rows(ranked, by, draws, seed)
    else:
        picks = draw_picks(ranked, by, draws, seed)
        chosen = picks.join(ranked.select(*by, F.col("_rank").alias("pick"), "_v"), [*by, "pick"])
        means = chosen.groupBy(*by, "draw").agg(F.avg("_v").alias("_m"))
    spread = means.groupBy(*by).agg(
        F.percentile("_m", 0.025).alias("ci_low"),
        F.percentile("_m", 0.975).alias("ci_high"),
        F.avg(F.when(F.round("_m", 12) > 0, 1.0).otherwise(0.0)).alias("probability_positive"),
    )
    observed = usable.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("_v").alias("mean_delta"), F.stddev_samp("_v").alias("std_delta")
    )
    if not by:
        return observed.withColumn("_one", F.lit(1)).join(spread.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return observed.join(spread, by)


def cluster_statistics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Additive response statistics per (model, cluster, fold): a few kilobytes per model."""
    return response_moments(scored, by)


def cluster_weights(clusters: DataFrame, cluster: str, draws: int, seed: object) -> DataFrame:
    """(draw, cluster, weight): how often each draw takes a cluster; draw -1 takes each once."""
    ranked = _ranked_units(clusters.select(cluster).distinct(), [], cluster, seed)
    picks = draw_picks(ranked, [], draws, seed).groupBy("draw", "pick").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    sampled = picks.join(ranked.select(cluster, F.col("_rank").alias("pick")), "pick").select("draw", cluster, "weight")
    observed = ranked.select(F.lit(-1).cast("bigint").alias("draw"), cluster, F.lit(1.0).alias("weight"))
    return sampled.unionByName(observed)


CLUSTER_METRICS = ("fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1")


def cluster_bootstrap(
    stats: DataFrame, cluster: str, candidate: str, control: str, metrics: Sequence[str] = CLUSTER_METRICS, draws: int = 10_000, seed: object = 4200
) -> DataFrame:
    """Paired cluster bootstrap on stored statistics: (metric, observed delta, interval, P > 0).

    Both models share the cluster multiplicities of a draw.  Metrics are rebuilt
    inside each fold, averaged over folds, and only then subtracted.
    """
    pair = stats.filter(F.col("model").isin(candidate, control))
    weights = cluster_weights(pair, cluster, draws, seed)
    weighted = weights.join(pair, cluster)
    merged = merged_moments(weighted, ["draw", "model", "fold"], weight=F.col("weight"))
    scores = scores_from_moments(merged, ["draw", "model", "fold"])
    macro = scores.groupBy("draw").agg(
        *[
            F.avg(F.when(F.col("model") == model, F.col(name))).alias(f"{side}_{name}")
            for name in metrics
            for side, model in (("x", candidate), ("c", control))
        ]
    )
    long = macro.select(
        "draw", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(f"x_{n}") - F.col(f"c_{n}")).alias("delta")) for n in metrics])).alias("e")
    ).select("draw", "e.metric", "e.delta")
    # A draw in which both models agree differs from zero by summation order only.
    sampled = F.when(F.col("draw") >= 0, F.round("delta", 12))
    n_clusters = pair.agg(F.countDistinct(cluster)).scalar()
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("draw") == -1, F.col("delta"))).alias("mean_delta"),
        F.percentile(sampled, 0.025).alias("ci_low"),
        F.percentile(sampled, 0.975).alias("ci_high"),
        F.avg(F.when(sampled > 0, 1.0).when(sampled.isNotNull(), 0.0)).alias("p_delta_gt_zero"),
    ).withColumn("n_clusters", n_clusters)


# ------------------------------------------------------------- entity metric units
def entity_units(scored: DataFrame, axes: dict[str, Sequence[str]], by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Candidate and control metric of every held-out entity: one row per axis, entity and metric.

    ``scored`` carries both ``candidate_delta`` and ``control_delta`` with one
    shared truth, so the pairing contract holds by construction.
    """
    options = F.array(
        *[F.struct(F.lit(name).alias("cluster_axis"), F.concat_ws("\x1f", *[F.col(c) for c in columns]).alias("heldout_entity")) for name, columns in axes.items()]
    )
    roles = F.array(
        *[F.struct(F.lit(role).alias("_role"), F.col(f"{role}_delta").alias("pred_delta")) for role in ("candidate", "control")]
    )
    # Reduce to the finest entity grain first; the axes then repeat statistics, not cells.
    fine = sorted({column for columns in axes.values() for column in columns})
    both = scored.withColumn("_r", F.explode(roles)).select("*", "_r.*")
    stats = response_moments(both, [*by, "_role", *fine])
    keys = [*by, "_role", "cluster_axis", "heldout_entity"]
    spread = stats.withColumn("_a", F.explode(options)).select("*", "_a.*")
    scores = scores_from_moments(merged_moments(spread, keys), keys)
    ids = [*by, "cluster_axis", "heldout_entity"]
    wide = scores.groupBy(*ids).agg(
        *[F.max(F.when(F.col("_role") == role, F.col(name))).alias(f"{role}_{name}") for name in metrics for role in ("candidate", "control")]
    )
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), F.col(f"control_{n}").alias("control_value"), F.col(f"candidate_{n}").alias("candidate_value"))
            for n in metrics
        ]
    )
    long = wide.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.*")
    return long.withColumn("delta", F.col("candidate_value") - F.col("control_value"))


def seed_averaged_bootstrap(units: DataFrame, by: Sequence[str], seeds: Sequence[int], draws: int = 20_000, seed: object = 20260813) -> DataFrame:
    """Average complete seeds per entity, then bootstrap entities; adds per-seed means."""
    by = list(by)
    per = units.filter(F.col("model_seed").isin(*seeds)).groupBy(*by, "heldout_entity").agg(
        *[F.avg(F.when(F.col("model_seed") == s, F.col("delta"))).alias(f"_s{s}") for s in seeds]
    )
    complete = per
    for s in seeds:
        complete = complete.filter(F.col(f"_s{s}").isNotNull())
    mean = sum((F.col(f"_s{s}") for s in seeds), F.lit(0.0)) / F.lit(len(seeds))
    table = bootstrap_means(complete.withColumn("_mean", mean), by, "heldout_entity", "_mean", draws, seed)
    by_seed = complete.groupBy(*by).agg(*[F.avg(f"_s{s}").alias(f"seed_{s}_mean") for s in seeds])
    joined = table.join(by_seed, by)
    positive = F.lit(True)
    least = F.least(*[F.col(f"seed_{s}_mean") for s in seeds])
    for s in seeds:
        positive = positive & (F.col(f"seed_{s}_mean") > 0)
    return joined.withColumns({"all_seeds_positive": positive, "min_seed_mean": least})


# -------------------------------------------------------------------- association
def contingency(rows: DataFrame, source: str, targets: Sequence[str]) -> DataFrame:
    """Counts n(target name, source level, target level) for several targets in one pass."""
    options = F.array(*[F.struct(F.lit(name).alias("target"), F.coalesce(F.col(name).cast("string"), F.lit("<NA>")).alias("v")) for name in targets])
    return (
        rows.select(F.coalesce(F.col(source).cast("string"), F.lit("<NA>")).alias("u"), F.explode(options).alias("t"))
        .groupBy(F.col("t.target").alias("target"), "u", F.col("t.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _entropy(count: Column, total: Column) -> Column:
    share = count / total
    return -share * F.ln(share)


def associations(counts: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Cramer's V, weighted purity both ways and normalised mutual information per target.

    Works on contingency counts only: levels, not rows.
    """
    by = list(by)
    rows = counts.groupBy(*by, "u").agg(F.sum("n").alias("nu"), F.max("n").alias("top_u"))
    columns = counts.groupBy(*by, "v").agg(F.sum("n").alias("nv"), F.max("n").alias("top_v"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    r = rows.join(total, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_u"),
        F.sum(_entropy(F.col("nu"), F.col("total"))).alias("h_u"),
        ratio(F.sum("top_u"), F.max("total")).alias("purity_u_to_v"),
    )
    c = columns.join(total, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_v"),
        F.sum(_entropy(F.col("nv"), F.col("total"))).alias("h_v"),
        ratio(F.sum("top_v"), F.max("total")).alias("purity_v_to_u"),
    )
    cells = counts.join(rows.select(*by, "u", "nu"), [*by, "u"]).join(columns.select(*by, "v", "nv"), [*by, "v"]).join(total, by)
    n, nu, nv, all_n = (F.col(x).cast("double") for x in ("n", "nu", "nv", "total"))
    joint = cells.groupBy(*by).agg(
        (F.sum(n * n / (nu * nv)) - 1.0).alias("phi2"), F.sum(n / all_n * F.ln(n * all_n / (nu * nv))).alias("mi")
    )
    table = joint.join(r, by).join(c, by)
    least = F.least(F.col("n_u"), F.col("n_v")) - 1
    mean_entropy = (F.col("h_u") + F.col("h_v")) / 2.0
    return table.select(
        *by,
        F.col("n_v").alias("target_levels"),
        F.when(least > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / least)).otherwise(0.0).alias("cramers_v"),
        F.when(mean_entropy > 0, F.col("mi") / mean_entropy).otherwise(1.0).alias("normalized_mutual_information"),
        "purity_u_to_v",
        "purity_v_to_u",
    )


# Digits of the digest that split a draw for ranking: 256 counts a draw, however many rows there are.
DRAW_BUCKET_DIGITS = 2


def permuted_contingency(rows: DataFrame, key: str, source: str, targets: Sequence[str], draws: int, seed: object) -> DataFrame:
    """Contingency counts after shuffling the source labels, per draw (two hash orders joined by rank).

    Shuffles draws x rows: for small tables and for checking
    :func:`~cellshift.operators.shuffled.permuted_counts`, which counts the same a few
    draws at a time; :func:`split_contingency` draws the null from the margins alone.  A repeated row carries one
    number for its target levels, and the table of bucket counts, which may be
    broadcast, has at most 256 rows a draw.
    """
    levels = [F.coalesce(F.col(name).cast("string"), F.lit("<NA>")).alias(name) for name in targets]
    named = rows.select(F.col(key).cast("string").alias("_key"), F.coalesce(F.col(source).cast("string"), F.lit("<NA>")).alias("_u"), *levels)
    classes = written(named.groupBy(*targets).agg(F.count(F.lit(1)).alias("_n")).select(*targets, F.monotonically_increasing_id().alias("_class")), "target-classes")
    sources = written(named.groupBy("_u").agg(F.count(F.lit(1)).alias("_n")).select("_u", F.monotonically_increasing_id().alias("_source")), "source-classes")
    coded = written(named.join(classes, list(targets)).join(sources, "_u").select("_key", "_class", "_source"), "coded-rows")
    spread = coded.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")))
    keyed = spread.withColumn("_k", F.concat_ws("|", F.col("draw").cast("string"), F.col("_key")))
    take = hash_rank(keyed.select("draw", "_k", "_class"), "_k", f"{seed}-to", by=["draw"], out="_place", bucket_digits=DRAW_BUCKET_DIGITS).drop("_k")
    give = hash_rank(keyed.select("draw", "_k", "_source"), "_k", f"{seed}-from", by=["draw"], out="_place", bucket_digits=DRAW_BUCKET_DIGITS).drop("_k")
    # By estimates, which do not count the draws, either side looks small enough to broadcast.
    mixed = take.hint("merge").join(give, ["draw", "_place"]).groupBy("draw", "_source", "_class").agg(F.count(F.lit(1)).alias("_n"))
    options = F.array(*[F.struct(F.lit(name).alias("target"), F.col(name).alias("v")) for name in targets])
    return (
        mixed.join(classes, "_class")
        .join(sources, "_source")
        .select("draw", F.col("_u").alias("u"), F.explode(options).alias("t"), "_n")
        .groupBy("draw", F.col("t.target").alias("target"), "u", F.col("t.v").alias("v"))
        .agg(F.sum("_n").alias("n"))
    )


def null_summary(observed: DataFrame, null: DataFrame, value: str = "normalized_mutual_information") -> DataFrame:
    """Mean, 95th percentile and ``(1 + #>=observed) / (1 + draws)`` of a permutation null per target."""
    joined = null.select("target", F.col(value).alias("_null")).join(observed.select("target", F.col(value).alias("_seen")), "target")
    return joined.groupBy("target").agg(
        F.max("_seen").alias("observed"),
        F.avg("_null").alias("null_mean"),
        F.percentile("_null", 0.95).alias("null_p95"),
        ((F.lit(1.0) + F.count(F.when(F.col("_null") >= F.col("_seen"), F.lit(1)))) / (F.lit(1.0) + F.count("_null"))).alias("p_ge_observed"),
    )


def source_tree(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Binary tree over the source levels of every target: (target, u, leaf), node sizes, depth.

    Leaves are numbered in level order, the node of depth d above a leaf is its number
    without the last (depth - d) bits; sizes are (target, depth, node, size).
    """
    levels = written(counts.groupBy("target", "u").agg(F.sum("n").alias("size")), "source-levels")
    order = Window.partitionBy("target").orderBy("u")
    leaves = levels.withColumn("leaf", (F.row_number().over(order) - 1).cast("bigint"))
    most = leaves.agg(F.max("leaf")).first()[0] or 0
    depth = int(most).bit_length()
    above = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    sizes = leaves.withColumn("depth", above).withColumn("node", F.expr(f"shiftright(leaf, {depth} - depth)"))
    return leaves.select("target", "u", "leaf"), sizes.groupBy("target", "depth", "node").agg(F.sum("size").alias("size")), depth


def _split(seed: int, depth: int):
    """Deal the counts of each (draw, target, node) to its two children, the left one taking its size at random."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = frame[["draw", "target", "node"]]
            starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            rest = frame.iloc[starts[-1] :] if len(starts) else frame
            if len(starts) > 1:
                yield dealt(frame.iloc[: starts[-1]], starts[:-1])
        if rest is not None and len(rest):
            yield dealt(rest, np.zeros(1, int))

    def dealt(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n, left = frame["n"].to_numpy(np.int64), np.zeros(len(frame), np.int64)
        heads = frame.iloc[starts]
        for a, b, draw, target, node, size in zip(starts, [*starts[1:], len(frame)], heads["draw"], heads["target"], heads["node"], heads["left_size"], strict=True):
            rng = np.random.default_rng([seed, depth, int(draw), int(node), *target.encode()])
            left[a:b] = rng.multivariate_hypergeometric(n[a:b], int(size), method="marginals")
        both = [frame[["draw", "target", "v"]].assign(node=2 * frame["node"] + side, n=part) for side, part in ((0, left), (1, n - left))]
        out = pd.concat(both, ignore_index=True)
        return out[out["n"] > 0][["draw", "target", "node", "v", "n"]]

    return deal


def split_contingency(counts: DataFrame, draws: int, seed: int = 991) -> DataFrame:
    """Contingency counts (draw, target, u, v, n) after shuffling the source labels, from the margins alone.

    Shuffling leaves both margins fixed.  The target's levels start at the root of a
    binary tree of source levels; each round a node's left child takes as many of the
    node's rows as it is large, drawn without replacement, level by level of the target
    (a hypergeometric split), and the right child keeps the rest.  A draw costs its
    non-empty cells times the depth of the tree; no row of the data is repeated and no
    table of all level pairs is made.  Splits are seeded by their place, so a repeated task
    repeats them.  The sampler takes targets of up to a billion rows.
    """
    leaves, sizes, depth = source_tree(counts)
    sizes = written(sizes, "tree-sizes")
    columns = counts.groupBy("target", "v").agg(F.sum("n").cast("bigint").alias("n"))
    state = columns.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>"))).withColumn("node", F.lit(0).cast("bigint"))
    state = state.select("draw", "target", "node", "v", "n")
    for level in range(depth):
        left = sizes.filter(F.col("depth") == level + 1).select("target", F.shiftright("node", 1).alias("node"), (F.col("node") % 2).alias("side"), "size")
        left = left.groupBy("target", "node").agg(F.sum(F.when(F.col("side") == 0, F.col("size")).otherwise(0)).cast("bigint").alias("left_size"))
        placed = state.join(left, ["target", "node"])
        ordered = placed.repartition("draw", "target", "node").sortWithinPartitions("draw", "target", "node", "v")
        state = written(ordered.select("draw", "target", "node", "v", "n", "left_size").mapInPandas(_split(seed, level), "draw bigint, target string, node bigint, v string, n bigint"), "splits")
    return state.join(leaves.withColumnRenamed("leaf", "node"), ["target", "node"]).select("draw", "target", "u", "v", "n")


def _expected_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected n/N ln(n N / (a b)) of one shuffled cell with margins a, b: the hypergeometric law summed up."""
    for batch in batches:
        out = []
        for a, b, total in zip(batch["nu"].astype(int), batch["nv"].astype(int), batch["total"].astype(int), strict=True):
            low = max(0, a + b - total)
            k = np.arange(max(1, low), min(a, b) + 1)
            # Probabilities by their ratios, from the most likely count on.
            ratio = (a - k[:-1]) * (b - k[:-1]) / ((k[:-1] + 1.0) * (total - a - b + k[:-1] + 1.0))
            first = math.lgamma(a + 1) + math.lgamma(b + 1) + math.lgamma(total - a + 1) + math.lgamma(total - b + 1) - math.lgamma(total + 1)
            first -= sum(math.lgamma(x + 1) for x in (k[0], a - k[0], b - k[0], total - a - b + k[0]))
            chance = np.exp(first + np.concatenate([[0.0], np.cumsum(np.log(ratio))]))
            out.append(float((chance * k / total * np.log(k * total / (a * b))).sum()))
        yield pd.DataFrame({"target": batch["target"], "mi": np.array(out) * batch["times"].to_numpy()})


def expected_association(counts: DataFrame) -> DataFrame:
    """(target, expected_nmi): exact mean of the normalised mutual information over all shuffles of the source labels.

    Pairs of equal margins count once, with their number.
    """
    rows, columns = (counts.groupBy("target", level).agg(F.sum("n").alias("m")).groupBy("target", "m").agg(F.count(F.lit(1)).alias("k")) for level in ("u", "v"))
    total = counts.groupBy("target").agg(F.sum("n").alias("total"))
    pairs = rows.select("target", F.col("m").alias("nu"), F.col("k").alias("ku")).join(columns.select("target", F.col("m").alias("nv"), F.col("k").alias("kv")), "target").join(total, "target")
    weighed = pairs.select("target", "nu", "nv", "total", (F.col("ku") * F.col("kv")).alias("times"))
    cells = weighed.repartition("target", "nu", "nv").mapInPandas(_expected_cell, "target string, mi double")
    entropy = lambda side: F.sum(F.col(side + "_k") * _entropy(F.col(side), F.col("total")))
    h = rows.select("target", F.col("m").alias("x"), F.col("k").alias("x_k")).join(total, "target").groupBy("target").agg(entropy("x").alias("hu"))
    g = columns.select("target", F.col("m").alias("x"), F.col("k").alias("x_k")).join(total, "target").groupBy("target").agg(entropy("x").alias("hv"))
    mean = (F.col("hu") + F.col("hv")) / 2.0
    return cells.groupBy("target").agg(F.sum("mi").alias("mi")).join(h, "target").join(g, "target").select("target", F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("expected_nmi"))

