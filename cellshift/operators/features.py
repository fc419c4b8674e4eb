"""Train-only feature engineering in long form: fit on fit rows, apply to any rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions.text import key_part, slug
from cellshift.operators import spectral
from cellshift.operators.prepare import with_samples
from cellshift.operators.quantiles import exact_quantile
from cellshift.operators.ranking import best_per_group, hash_rank, shifted_donor
from cellshift.session import written


# ------------------------------------------------------------------ categories
def crossed(fields: Sequence[str]) -> Column:
    """Crossed category text."""
    return F.concat_ws("__", *[key_part(name) for name in fields])


def long_fields(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, level) rows for named category expressions."""
    entries = [F.struct(F.lit(name).alias("field"), key_part(value).alias("level")) for name, value in fields.items()]
    return rows.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.field", "e.level")


def vocabulary(levels: DataFrame) -> DataFrame:
    """Sorted fit levels per field with a 1-based index (0 is reserved for unknown).

    Works on distinct levels; the window spans the levels of one field, not rows.
    """
    order = Window.partitionBy("field").orderBy("level")
    return levels.select("field", "level").distinct().withColumn("level_index", F.row_number().over(order).cast("bigint"))


def one_hot(levels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Non-zero one-hot entries; an unknown level simply has none."""
    return levels.join(vocab, ["field", "level"]).withColumn("value", F.lit(1.0))


def category_index(levels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Index per row and field with 0 for unknown, and the seen flag."""
    indexed = levels.join(vocab, ["field", "level"], "left")
    return indexed.withColumn("level_index", F.coalesce("level_index", F.lit(0).cast("bigint"))).withColumn("seen", F.col("level_index") > 0)


def hash_features(value: Column | str, width: int) -> Column:
    """``width`` numbers in [0, 1] from the bytes of md5(value|counter)."""
    text = key_part(value)
    parts = []
    for position in range(width):
        counter, byte = divmod(position, 16)
        digest = F.md5(F.concat(text, F.lit(f"|{counter}")))
        parts.append(F.conv(F.substring(digest, 1 + 2 * byte, 2), 16, 10).cast("double") / F.lit(255.0))
    return F.array(*parts)


def property_slugs(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Entity property one-hot in long form, columns named by slug."""
    return rows.select(key, F.concat(F.lit(f"{column}_"), slug(column)).alias("feature"), F.lit(1.0).alias("value")).distinct()


# ------------------------------------------------------------------------ time
def time_scale(fit: DataFrame, time: str = "pert_time", least: float | None = None) -> Column:
    """Largest fit time as a scalar; a non-positive one is an error."""
    top = fit.agg(F.max(F.col(time).cast("double"))).scalar()
    if least is not None:
        return F.greatest(top, F.lit(float(least)))
    return F.when(top > 0, top).otherwise(F.raise_error(F.lit("No fit row has a time above zero")).cast("double"))


def cyclic_time(time: Column, top: Column) -> list[Column]:
    angle = F.lit(2.0 * math.pi) * time.cast("double") / top
    return [F.sin(angle).alias("time_sin"), F.cos(angle).alias("time_cos")]


def time_block(time: Column, top: Column) -> list[Column]:
    """Scaled time, log ratio, sine and cosine."""
    value = time.cast("double")
    return [
        (value / top).alias("time_scaled"),
        (F.log1p(value) / F.log1p(top)).alias("time_log"),
        *cyclic_time(time, top),
    ]


def time_rbf(rows: DataFrame, fit: DataFrame, key: str, time: str = "pert_time", least_width: float = 0.05, single_width: float = 0.25) -> DataFrame:
    """Radial basis over the distinct fit times: (key, centre, value).

    Times are the few sampling points of the design; centres travel as one
    scalar array and the width is the median gap between them.
    """
    top = time_scale(fit, time, least=1.0)
    centres = fit.select((F.col(time).cast("double") / top).alias("c")).distinct()
    packed = centres.agg(F.sort_array(F.collect_set("c")).alias("cs"))
    gaps = F.sort_array(F.transform(F.slice("cs", 2, F.greatest(F.size("cs") - 1, F.lit(1))), lambda v, i: v - F.get(F.col("cs"), i)))
    n = F.size(gaps)
    half = F.floor((n - 1) / 2).cast("int")
    other = F.ceil((n - 1) / 2).cast("int")
    median = (F.get(gaps, half) + F.get(gaps, other)) / 2.0
    width = F.when(F.size("cs") > 1, F.greatest(median, F.lit(least_width))).otherwise(F.lit(single_width))
    basis = packed.select(F.transform("cs", lambda c: F.struct(c.alias("centre"), width.alias("width"))).alias("b"))
    wide = rows.select(key, (F.col(time).cast("double") / top).alias("_t"), F.explode(basis.scalar()).alias("b"))
    z = (F.col("_t") - F.col("b.centre")) / F.col("b.width")
    return wide.select(key, F.col("b.centre").alias("centre"), F.exp(F.lit(-0.5) * z * z).alias("value"))


# --------------------------------------------------------------------- scaling
def target_scale(y: DataFrame, fit_ids: DataFrame, proteins: DataFrame, floor: float = 0.1, value: str = "y", unit_below: bool = False) -> DataFrame:
    """Per protein location and scale over fit rows; unseen proteins get 0 and the floor.

    ``unit_below`` is the other convention: scale 1 for fewer than two values or
    a spread under the floor.
    """
    stats = (
        with_samples(y, fit_ids.select("sample_id"), "left_semi")
        .groupBy("protein")
        .agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count(value).alias("_n"))
    )
    joined = proteins.select("protein").distinct().join(stats, "protein", "left")
    if unit_below:
        scale = F.when((F.coalesce("_n", F.lit(0)) < 2) | (F.col("_std") < floor), F.lit(1.0)).otherwise(F.col("_std"))
    else:
        scale = F.greatest(F.coalesce("_std", F.lit(floor)), F.lit(floor))
    return joined.select("protein", F.coalesce("_mean", F.lit(0.0)).alias("target_mean"), scale.alias("target_scale"))


def standardise(cells: DataFrame, scale: DataFrame, value: str, out: str, centre: bool = True) -> DataFrame:
    """Standardise cells; responses are only divided, absolute values also centred."""
    base = F.col("target_mean") if centre else F.lit(0.0)
    return cells.join(scale, "protein").withColumn(out, (F.col(value) - base) / F.col("target_scale")).drop("target_mean", "target_scale")


def destandardise(cells: DataFrame, scale: DataFrame, value: str, out: str, centre: bool = True) -> DataFrame:
    base = F.col("target_mean") if centre else F.lit(0.0)
    return cells.join(scale, "protein").withColumn(out, F.col(value) * F.col("target_scale") + base).drop("target_mean", "target_scale")


def feature_scale(features: DataFrame, floor: float = 1.0) -> DataFrame:
    """Mean and floored population spread per feature over the given (admitted) rows."""
    return features.groupBy("feature").agg(
        F.avg("value").alias("feature_mean"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("feature_scale")
    )


def unique_entity_scale(features: DataFrame, entity: str, floor: float = 1.0) -> DataFrame:
    """Scaler in which every entity counts once, however often it was assayed."""
    return feature_scale(features.dropDuplicates([entity, "feature"]), floor)


def apply_scale(features: DataFrame, scale: DataFrame, clip: float | None = None, gate: str | None = None) -> DataFrame:
    """Scale features; clip if asked; ineligible rows become exactly zero."""
    scaled = (F.col("value") - F.col("feature_mean")) / F.col("feature_scale")
    if clip is not None:
        scaled = F.greatest(F.least(scaled, F.lit(float(clip))), F.lit(-float(clip)))
    if gate is not None:
        scaled = F.when(F.coalesce(F.col(gate), F.lit(False)), scaled).otherwise(F.lit(0.0))
    return features.join(scale, "feature").withColumn("value", scaled).drop("feature_mean", "feature_scale")


def group_residual(cells: DataFrame, fit: DataFrame, group: str, value: str = "y", out: str = "residual") -> DataFrame:
    """Subtract the fit mean of the row's group, the overall fit mean for unknown groups."""
    part = fit.groupBy(group, "protein").agg(F.avg(value).alias("_group"))
    whole = fit.groupBy("protein").agg(F.avg(value).alias("_whole"))
    joined = cells.join(part, [group, "protein"], "left").join(whole, "protein", "left")
    known = fit.select(group).distinct().withColumn("_known", F.lit(True))
    joined = joined.join(known, group, "left")
    base = F.when(F.coalesce("_known", F.lit(False)), F.col("_group")).otherwise(F.col("_whole"))
    return joined.withColumn(out, F.col(value) - base).drop("_group", "_whole", "_known")


def numeric_context(rows: DataFrame, fit: DataFrame, columns: dict[str, bool], floor: float = 1e-6) -> DataFrame:
    """Coerce, fill with 0, optionally log1p, then standardise on fit rows.

    ``columns`` maps a column to whether it is a dose (log1p of the non-negative part).
    """

    def prepared(name: str, dose: bool) -> Column:
        number = F.coalesce(F.expr(f"try_cast({name} AS double)"), F.lit(0.0))
        return F.log1p(F.greatest(number, F.lit(0.0))) if dose else number

    aggs = []
    for name, dose in columns.items():
        aggs += [F.avg(prepared(name, dose)).alias(f"{name}_m"), F.stddev_pop(prepared(name, dose)).alias(f"{name}_s")]
    stats = fit.agg(F.struct(*aggs)).scalar()
    result = rows
    for name, dose in columns.items():
        z = (prepared(name, dose) - stats[f"{name}_m"]) / F.greatest(stats[f"{name}_s"], F.lit(floor))
        result = result.withColumn(f"{name}_z", z)
    return result


# ---------------------------------------------------------------------- kernels
def blocked(left: DataFrame, right: DataFrame, right_key: str, blocks: int = 16) -> DataFrame:
    """Every left row with every right row through an equi join on a block number.

    The dense row x centre result is what the operator returns; the block column
    lets Spark broadcast a small centre table or split a large one, instead of
    falling back to a nested-loop product.
    """
    spread = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    placed = right.withColumn("_block", F.pmod(F.xxhash64(right_key), F.lit(blocks)))
    return spread.join(placed, "_block").drop("_block")


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)


def centre_distances(rows: DataFrame, key: str, vector: str, centres: DataFrame, centre_key: str, centre_vector: str, blocks: int = 16) -> DataFrame:
    """(key, centre, d2) for every row and centre."""
    left = rows.select(key, F.col(vector).alias("_v"))
    right = centres.select(F.col(centre_key).alias("centre"), F.col(centre_vector).alias("_c"))
    pairs = blocked(left, right, "centre", blocks)
    return pairs.select(key, "centre", squared_distance("_v", "_c").alias("d2"))


MOST_PIVOTS = 64


def pivot_index(centres: DataFrame, key: str, vector: str) -> tuple[DataFrame, Column]:
    """Centres under their nearest pivot (cluster, centre, _c, dc), and the pivots with cluster radii as one scalar.

    Pivots are centres themselves, the first by key digest: the square root of their
    number, ``MOST_PIVOTS`` at most, so the scalar is small whatever the centres are.
    """
    points = written(centres.select(F.col(key).alias("centre"), F.col(vector).alias("_c")), "centres")
    count = max(1, min(MOST_PIVOTS, math.isqrt(points.count())))
    chosen = written(points.orderBy(F.xxhash64("centre"), "centre").limit(count), "pivots")
    bare = chosen.agg(F.sort_array(F.collect_list(F.struct(F.col("centre").alias("pivot"), F.col("_c").alias("at"))))).scalar()
    near = F.array_min(F.transform("_pivots", lambda p: F.struct(F.sqrt(squared_distance(F.col("_c"), p["at"])).alias("dc"), p["pivot"].alias("cluster"))))
    index = written(points.withColumn("_pivots", bare).withColumn("_n", near).select(F.col("_n.cluster").alias("cluster"), "centre", "_c", F.col("_n.dc").alias("dc")), "centre-index")
    radii = index.groupBy("cluster").agg(F.max("dc").alias("radius"))
    pivots = chosen.join(radii, chosen["centre"] == radii["cluster"]).agg(F.sort_array(F.collect_list(F.struct(F.col("cluster"), F.col("_c").alias("at"), "radius")))).scalar()
    return index, pivots


def centres_within(rows: DataFrame, key: str, vector: str, index: DataFrame, pivots: Column, reach: Column | None = None) -> DataFrame:
    """(key, centre, d2) of the centres no farther than ``reach``, by default than the nearest pivot.

    A cluster is opened where the triangle inequality allows a member within reach; a
    member's vector is looked at where its own distance to the pivot allows it.  Every
    centre within reach is found, so the nearest one is.
    """
    seen = F.transform("_pivots", lambda p: F.struct(p["cluster"].alias("cluster"), F.sqrt(squared_distance(F.col("_v"), p["at"])).alias("dp"), p["radius"].alias("radius")))
    placed = rows.select(key, F.col(vector).alias("_v")).withColumn("_pivots", pivots).withColumn("_seen", seen).drop("_pivots")
    placed = placed.withColumn("_reach", reach if reach is not None else F.array_min(F.transform("_seen", lambda s: s["dp"])))
    slack = F.col("_reach") * (1 + 1e-9) + 1e-9
    opened = placed.withColumn("_s", F.explode(F.filter("_seen", lambda s: s["dp"] - s["radius"] <= slack))).select(key, "_v", "_reach", "_s.cluster", "_s.dp")
    met = opened.join(index, (opened["cluster"] == index["cluster"]) & (F.abs(F.col("dp") - F.col("dc")) <= slack))
    return met.select(key, "centre", squared_distance("_v", "_c").alias("d2"), "_reach").filter(F.sqrt("d2") <= slack).drop("_reach")


def truncated_kernel(rows: DataFrame, key: str, vector: str, index: DataFrame, pivots: Column, bandwidth: DataFrame, least: float) -> DataFrame:
    """Kernel entries of at least ``least``; smaller ones are not made."""
    width = F.greatest(bandwidth.select("bandwidth").scalar(), F.lit(1e-6))
    found = centres_within(rows, key, vector, index, pivots, width * math.sqrt(-2 * math.log(least)))
    return rbf_kernel(found, bandwidth).filter(F.col("value") >= least)


def kernel_bandwidth(centres: DataFrame, key: str, vector: str) -> DataFrame:
    """Median non-zero distance between different centres (1 if there is none): one row."""
    table = centre_distances(centres, key, vector, centres, key, vector)
    above = table.filter((F.col(key) < F.col("centre")) & (F.col("d2") > 1e-16)).withColumn("d", F.sqrt("d2"))
    return exact_quantile(above, [], "d", 0.5, "bandwidth").select(F.coalesce("bandwidth", F.lit(1.0)).alias("bandwidth"))


def rbf_kernel(distances: DataFrame, bandwidth: DataFrame) -> DataFrame:
    """Kernel value of every (row, centre)."""
    width = F.greatest(bandwidth.select("bandwidth").scalar(), F.lit(1e-6))
    return distances.withColumn("value", F.exp(-F.col("d2") / (F.lit(2.0) * width * width)))


def nearest_centre(distances: DataFrame, key: str) -> DataFrame:
    """The closest centre of every row (smallest centre on ties): a partial aggregate, not a sort."""
    return best_per_group(distances, [key], [("d2", False), ("centre", False)])


# ------------------------------------------------------------------ node signals
NEGATIVE_ACTIONS = ("inhibition", "degradation", "antagonism")  # fixed values


def node_signal(conditions: DataFrame, chemical_targets: DataFrame, strain_targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Signed sum, largest magnitude and presence per (condition, protein).

    ``conditions(condition_id, chemical, strain)`` are distinct conditions, so
    the target tables are expanded once per condition and not once per sample.
    """
    sign = F.when(F.lower("action").isin(*NEGATIVE_ACTIONS), -1.0).otherwise(1.0)
    chem = (
        conditions.join(chemical_targets, "chemical")
        .join(mapping, "systematic_name")
        .select("condition_id", "protein", (sign * F.col("weight")).alias("v"))
    )
    strain = (
        conditions.join(strain_targets, "strain")
        .join(mapping, "systematic_name")
        .select("condition_id", "protein", F.col("mutation_value").alias("v"))
    )
    return chem.unionByName(strain).groupBy("condition_id", "protein").agg(
        F.sum("v").alias("signal_sum"), F.max(F.abs("v")).alias("signal_max_abs"), F.lit(1.0).alias("signal_present")
    )


# ------------------------------------------------------------- negative controls
def deranged_groups(features: DataFrame, group: str, seed: object, shift: int = 1) -> DataFrame:
    """Give every group the feature rows of another group (whole-group derangement)."""
    mapping = shifted_donor(features.select(group).distinct(), group, seed, shift)
    donors = features.withColumnRenamed(group, "donor")
    return mapping.join(donors, "donor").withColumnRenamed("recipient", group)


def permuted_column(rows: DataFrame, key: str, column: str, seed: object, out: str = "permuted") -> DataFrame:
    """Permute one column among the given rows: two hash orders of the keys joined by rank."""
    take = hash_rank(rows.select(key), key, f"{seed}-to", out="_place")
    give = hash_rank(rows.select(key, F.col(column).alias(out)), key, f"{seed}-from", out="_place").drop(key)
    return take.join(give, "_place").drop("_place")


# ------------------------------------------------------------------- low rank
def centred_cells(deltas: DataFrame, value: str = "truth_delta") -> DataFrame:
    """(sample_id, protein, d): responses minus the observed mean of their protein; missing cells stay absent, that is zero."""
    centre = deltas.groupBy("protein").agg(F.avg(value).alias("_c"))
    return deltas.join(centre, "protein").select("sample_id", "protein", (F.col(value) - F.col("_c")).alias("d"))


def response_basis(deltas: DataFrame, rank: int, value: str = "truth_delta") -> DataFrame:
    """Low-rank basis of the centred, zero-filled responses: (component, protein, energy, residual, loading).

    The components are the leading eigenvectors of the centred cells' normal matrix,
    found by joins and sums over the cells (see ``spectral``).  ``energy`` is a component's
    share of the sum of squares, ``residual`` the error of its eigenvector equation as a
    share of the largest eigenvalue.  Signs are fixed at the largest loading.  Ranks beyond
    the data's own have energy and loadings zero.
    """
    cells = written(centred_cells(deltas, value), "centred-cells")
    total = cells.agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    if not total:
        raise ValueError("A response basis needs cells that differ from their protein's mean")
    found, values, residuals = spectral.leading(spectral.normal_product(cells, "sample_id", "protein", "d"), cells.select(F.col("protein").alias("key")).distinct(), rank)
    at = F.col("component")
    return spectral.anchored(found, rank).select(
        at,
        F.col("key").alias("protein"),
        (spectral.value_table(at, values) / total).alias("energy"),
        (spectral.value_table(at, residuals) / float(values[0])).alias("residual"),
        F.col("x").alias("loading"),
    )


# ------------------------------------------------------------------------- MDS
def distance_violations(distances: DataFrame) -> DataFrame:
    """Asymmetric, missing, non-finite or non-zero-diagonal entries of a long distance table (i, j, d)."""
    flipped = distances.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("d").alias("_t"))
    both = distances.join(flipped, ["i", "j"], "left")
    bad = F.when(F.col("d").isNull() | F.isnan("d"), "not_finite").when(
        (F.col("i") == F.col("j")) & (F.abs("d") > 1e-8), "diagonal_not_zero"
    ).when(F.col("_t").isNull() | (F.abs(F.col("d") - F.col("_t")) > 1e-7), "not_symmetric")
    return both.withColumn("issue", bad).filter(F.col("issue").isNotNull()).select("issue", "i", "j")


def double_centred(distances: DataFrame) -> DataFrame:
    """Gram entries ``-(d2 - row mean - column mean + grand mean) / 2`` from three aggregates."""
    sq = distances.withColumn("_q", F.col("d") * F.col("d"))
    rows = sq.groupBy("i").agg(F.avg("_q").alias("_ri"))
    columns = sq.groupBy("j").agg(F.avg("_q").alias("_cj"))
    grand = sq.agg(F.avg("_q")).scalar()
    return sq.join(rows, "i").join(columns, "j").select(
        "i", "j", (F.lit(-0.5) * (F.col("_q") - F.col("_ri") - F.col("_cj") + grand)).alias("gram")
    )


def classical_mds(distances: DataFrame, dimensions: int) -> DataFrame:
    """Coordinates (entity, dimension, coordinate, eigenvalue) from a distance table, signs anchored.

    The eigenvectors of the Gram matrix that lead by size are found by joins and sums (see
    ``spectral``).  If all are positive, these are wanted.  Otherwise the matrix is shifted
    by the most negative one, so the positive ones lead however many negative ones there
    are.  Dimensions without a positive eigenvalue have coordinate 0 and no eigenvalue.
    """
    gram = written(double_centred(distances), "gram")
    keys = gram.select(F.col("i").alias("key")).distinct()
    shift = 0.0
    found, values, _ = spectral.leading(spectral.symmetric_product(gram, "i", "j", "gram"), keys, dimensions, by_size=True)
    if values.min() < -1e-9 * abs(values).max():
        shift = float(-values.min())
        found, values, _ = spectral.leading(spectral.symmetric_product(gram, "i", "j", "gram", shift), keys, dimensions)
        values = values - shift
    positive = values > max(float(values.max()) * 1e-12, 1e-12, shift * 1e-9)
    at = F.col("component")
    eigenvalue = spectral.value_table(at, np.where(positive, values, np.nan))
    held = ~F.isnan(eigenvalue)
    return spectral.anchored(found, dimensions).select(
        F.col("key").alias("entity"),
        at.alias("dimension"),
        F.when(held, F.col("x") * F.sqrt(eigenvalue)).otherwise(0.0).alias("coordinate"),
        F.when(held, eigenvalue).alias("eigenvalue"),
    )

