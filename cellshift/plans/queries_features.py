"""Registered queries: feature engineering (group H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.operators import entities, features, prepare, priors
from cellshift.operators.grids import dense_grid
from cellshift.plans.registry import query, view
from cellshift.plans.study import Study
from cellshift.session import written
from cellshift.sources.star import Star

FIELDS = ("strain", "chemical", "medium", "temperature", "pert_time")


def _levels(star: Star) -> tuple[DataFrame, DataFrame]:
    """Long category levels of every sample and the train vocabulary."""
    exprs = {name: F.col(name) for name in FIELDS}
    levels = features.long_fields(star.samples, "sample_id", exprs)
    return levels, features.vocabulary(features.long_fields(star.train, "sample_id", exprs))


view(
    "v_levels",
    "SELECT sample_id, split, field, level FROM (SELECT sample_id, split, strain, chemical, medium, temperature, CAST(pert_time AS VARCHAR) AS pert_time FROM v_samples) "
    "UNPIVOT (level FOR field IN (strain, chemical, medium, temperature, pert_time))",
)
view(
    "v_vocab",
    "SELECT field, level, row_number() OVER (PARTITION BY field ORDER BY level) AS level_index FROM (SELECT DISTINCT field, level FROM v_levels WHERE split = 'train')",
)


@query("h01_one_hot", "SELECT sample_id, field, level_index FROM v_levels JOIN v_vocab USING (field, level)")
def h01(star: Star) -> DataFrame:
    levels, vocab = _levels(star)
    return features.one_hot(levels, vocab).select("sample_id", "field", "level_index")


@query(
    "h02_crossed_categories",
    """
WITH x AS (SELECT sample_id, split, strain || '__' || medium AS strain_medium, chemical || '__' || temperature AS chemical_temperature FROM v_samples),
 u AS (SELECT * FROM x UNPIVOT (level FOR field IN (strain_medium, chemical_temperature))),
 v AS (SELECT DISTINCT field, level FROM u WHERE split = 'train')
SELECT field, level, count(*) AS n_rows FROM u SEMI JOIN v USING (field, level) GROUP BY 1, 2
""",
)
def h02(star: Star) -> DataFrame:
    exprs = {"strain_medium": features.crossed(["strain", "medium"]), "chemical_temperature": features.crossed(["chemical", "temperature"])}
    vocab = features.vocabulary(features.long_fields(star.train, "sample_id", exprs))
    hot = features.one_hot(features.long_fields(star.samples, "sample_id", exprs), vocab)
    return hot.groupBy("field", "level").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "h03_category_index",
    "SELECT sample_id, field, coalesce(level_index, 0) AS level_index, level_index IS NOT NULL AS seen FROM v_levels LEFT JOIN v_vocab USING (field, level)",
)
def h03(star: Star) -> DataFrame:
    return features.category_index(*_levels(star)).select("sample_id", "field", "level_index", "seen")


@query(
    "h04_md5_hash_features",
    """
SELECT p_name AS name, i AS position, r6(CAST('0x' || substr(md5(p_name || '|' || CAST(i // 16 AS VARCHAR)), 1 + 2 * (i % 16), 2) AS BIGINT) / 255.0) AS value
FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (SELECT unnest(range(20)) AS i)
""",
)
def h04(star: Star) -> DataFrame:
    names = star.table("part").select(F.col("p_name").alias("name")).distinct()
    long = names.select("name", F.posexplode(features.hash_features("name", 20)).alias("position", "value"))
    return long.select("name", F.col("position").cast("bigint").alias("position"), r6("value").alias("value"))


@query(
    "h05_cyclic_time",
    "SELECT DISTINCT pert_time, r6(sin(2 * pi() * pert_time / (SELECT max(pert_time) FROM v_train))) AS time_sin, r6(cos(2 * pi() * pert_time / (SELECT max(pert_time) FROM v_train))) AS time_cos FROM v_samples",
)
def h05(star: Star) -> DataFrame:
    top = features.time_scale(star.train)
    block = star.samples.select("pert_time", *features.cyclic_time(F.col("pert_time"), top))
    return block.select("pert_time", r6("time_sin").alias("time_sin"), r6("time_cos").alias("time_cos")).distinct()


@query(
    "h06_time_block",
    """
WITH m AS (SELECT CAST(max(pert_time) AS DOUBLE) AS t FROM v_train)
SELECT sample_id, r6(pert_time / t) AS time_scaled, r6(ln(1 + pert_time) / ln(1 + t)) AS time_log, r6(sin(2 * pi() * pert_time / t)) AS time_sin, r6(cos(2 * pi() * pert_time / t)) AS time_cos FROM v_samples, m
""",
)
def h06(star: Star) -> DataFrame:
    top = features.time_scale(star.train)
    block = star.samples.select("sample_id", *features.time_block(F.col("pert_time"), top))
    return block.select("sample_id", *[r6(n).alias(n) for n in ("time_scaled", "time_log", "time_sin", "time_cos")])


@query(
    "h07_time_rbf",
    """
WITH m AS (SELECT greatest(CAST(max(pert_time - 1990) AS DOUBLE), 1) AS t FROM v_train),
 c AS (SELECT DISTINCT (pert_time - 1990) / t AS centre FROM v_train, m),
 g AS (SELECT centre - lag(centre) OVER (ORDER BY centre) AS gap FROM c),
 w AS (SELECT greatest(median(gap), 0.05) AS width FROM g)
SELECT sample_id, r6(centre) AS centre, r6(exp(-0.5 * pow(((pert_time - 1990) / t - centre) / width, 2))) AS value FROM v_samples, m, c, w
""",
)
def h07(star: Star) -> DataFrame:
    since = lambda frame: frame.select("sample_id", (F.col("pert_time") - 1990).alias("pert_time"))
    out = features.time_rbf(since(star.samples), since(star.train), "sample_id")
    return out.select("sample_id", r6("centre").alias("centre"), r6("value").alias("value"))


@query(
    "h08_strain_absolute_prior",
    """
SELECT s.sample_id, p.protein, r6(coalesce(sm, pm, 0)) AS prior FROM v_samples s CROSS JOIN (SELECT DISTINCT protein FROM v_y) p
LEFT JOIN v_pm ON v_pm.protein = p.protein LEFT JOIN v_sm m ON m.strain = s.strain AND m.protein = p.protein WHERE s.split <> 'train'
""",
)
def h08(star: Star) -> DataFrame:
    study = Study(star)
    rows = star.samples.filter(F.col("split") != "train").select("sample_id", "strain")
    fit = prepare.with_samples(star.log2, star.train.select("sample_id", "strain"))
    prior = fit.groupBy("strain", "protein").agg(F.avg("y").alias("group_prior"))
    grid = dense_grid(rows, star.log2.select("protein"))
    out = priors.prior_with_fallback(grid, prior, ["strain"], study.protein_means, "group_prior", "protein_mean", "prior")
    return out.select("sample_id", "protein", r6("prior").alias("prior"))


@query(
    "h09_chemical_delta_prior",
    """
SELECT s.sample_id, p.protein, r6(coalesce(drug, gd, 0)) AS prior FROM v_samples s CROSS JOIN (SELECT DISTINCT protein FROM v_y) p
LEFT JOIN (SELECT protein, avg(t) AS gd FROM v_tdelta GROUP BY 1) g ON g.protein = p.protein LEFT JOIN v_drug d ON d.chemical = s.chemical AND d.protein = p.protein WHERE s.split <> 'train'
""",
)
def h09(star: Star) -> DataFrame:
    study = Study(star)
    rows = star.samples.filter(F.col("split") != "train").select("sample_id", "chemical")
    overall = study.train_deltas.groupBy("protein").agg(F.avg("truth_delta").alias("global_delta"))
    grid = dense_grid(rows, star.log2.select("protein"))
    out = priors.prior_with_fallback(grid, study.drug_reference, ["chemical"], overall, "drug_ref", "global_delta", "prior")
    return out.select("sample_id", "protein", r6("prior").alias("prior"))


# The *_unseen_default forms leave L7 out of the fit: it stands for a protein that the fit has not seen.
SCALE_ALL_SQL = "SELECT protein, avg(y) AS m, greatest(stddev_pop(y), 0.5) AS s, count(y) AS n, stddev_pop(y) AS raw FROM v_y JOIN v_train USING (sample_id) GROUP BY 1"
SCALE_SQL = "SELECT protein, avg(y) AS m, greatest(stddev_pop(y), 0.5) AS s, count(y) AS n, stddev_pop(y) AS raw FROM v_y JOIN v_train USING (sample_id) WHERE protein <> 'L7' GROUP BY 1"


def _scale(star: Star, unit_below: bool = False, unseen: str | None = "L7") -> DataFrame:
    observed = star.log2.filter(F.col("protein") != unseen) if unseen else star.log2
    floor = 1.1 if unit_below else 0.5
    return features.target_scale(observed, star.train, star.log2.select("protein"), floor, unit_below=unit_below)


def _target_scales(star: Star, unseen: str | None) -> DataFrame:
    unit = _scale(star, True, unseen).select("protein", r6("target_scale").alias("unit_scale"))
    plain = _scale(star, False, unseen).select("protein", r6("target_mean").alias("target_mean"), r6("target_scale").alias("target_scale"))
    return plain.join(unit, "protein")


def _standardised_cells(star: Star, unseen: str | None) -> DataFrame:
    scale = _scale(star, False, unseen)
    cells = features.standardise(star.log2, scale, "y", "z")
    cells = features.standardise(cells, scale, "y", "response_z", centre=False)
    cells = features.destandardise(cells, scale, "z", "restored")
    return cells.select("sample_id", "protein", *[r6(n).alias(n) for n in ("z", "response_z", "restored")])


def _standardised_fold_changes(star: Star, unseen: str | None) -> DataFrame:
    out = features.standardise(Study(star).train_deltas, _scale(star, False, unseen), "truth_delta", "target", centre=False)
    return out.select("sample_id", "protein", r6("target").alias("target"))


@query(
    "h10_unseen_default",
    f"""
SELECT p.protein, r6(coalesce(m, 0)) AS target_mean, r6(coalesce(s, 0.5)) AS target_scale, r6(CASE WHEN coalesce(n, 0) < 2 OR raw < 1.1 THEN 1 ELSE raw END) AS unit_scale
FROM (SELECT DISTINCT protein FROM v_y) p LEFT JOIN ({SCALE_SQL}) x USING (protein)
""",
)
def h10(star: Star) -> DataFrame:
    return _target_scales(star, "L7")


@query(
    "h11_unseen_default",
    f"""
WITH y AS MATERIALIZED (SELECT * FROM v_y), x AS MATERIALIZED ({SCALE_SQL})
SELECT y.sample_id, y.protein, r6((y.y - coalesce(x.m, 0)) / coalesce(x.s, 0.5)) AS z, r6(y.y / coalesce(x.s, 0.5)) AS response_z, r6(y.y) AS restored
FROM y LEFT JOIN x ON x.protein = y.protein
""",
)
def h11(star: Star) -> DataFrame:
    return _standardised_cells(star, "L7")


@query(
    "h12_unseen_default",
    f"SELECT sample_id, protein, r6(t / coalesce(s, 0.5)) AS target FROM v_tdelta LEFT JOIN ({SCALE_SQL}) x USING (protein)",
)
def h12(star: Star) -> DataFrame:
    return _standardised_fold_changes(star, "L7")


@query(
    "h10_target_scale",
    f"""
SELECT p.protein, r6(coalesce(m, 0)) AS target_mean, r6(coalesce(s, 0.5)) AS target_scale, r6(CASE WHEN coalesce(n, 0) < 2 OR raw < 1.1 THEN 1 ELSE raw END) AS unit_scale
FROM (SELECT DISTINCT protein FROM v_y) p LEFT JOIN ({SCALE_ALL_SQL}) x USING (protein)
""",
)
def h10_all(star: Star) -> DataFrame:
    return _target_scales(star, None)


@query(
    "h11_standardised_cells",
    f"""
WITH y AS MATERIALIZED (SELECT * FROM v_y), x AS MATERIALIZED ({SCALE_ALL_SQL})
SELECT y.sample_id, y.protein, r6((y.y - coalesce(x.m, 0)) / coalesce(x.s, 0.5)) AS z, r6(y.y / coalesce(x.s, 0.5)) AS response_z, r6(y.y) AS restored
FROM y LEFT JOIN x ON x.protein = y.protein
""",
)
def h11_all(star: Star) -> DataFrame:
    return _standardised_cells(star, None)


@query(
    "h12_standardised_fold_changes",
    f"SELECT sample_id, protein, r6(t / coalesce(s, 0.5)) AS target FROM v_tdelta LEFT JOIN ({SCALE_ALL_SQL}) x USING (protein)",
)
def h12_all(star: Star) -> DataFrame:
    return _standardised_fold_changes(star, None)


# --------------------------------------------------------- entity feature blocks
def chemical_features(star: Star) -> DataFrame:
    """Long features of each chemical derived from its parts."""
    table = star.table("part").groupBy(F.col("p_brand").alias("chemical")).agg(
        F.avg(F.col("p_size").cast("double")).alias("size"), F.avg(F.col("p_retailprice") / 100).alias("price"), F.count(F.lit(1)).cast("double").alias("parts")
    )
    return table.unpivot("chemical", ["size", "price", "parts"], "feature", "value")


view(
    "v_cfeat",
    "SELECT chemical, feature, value FROM (SELECT p_brand AS chemical, avg(p_size) AS size, avg(p_retailprice / 100) AS price, CAST(count(*) AS DOUBLE) AS parts FROM part GROUP BY 1) "
    "UNPIVOT (value FOR feature IN (size, price, parts))",
)
view("v_admit", "SELECT raw_name AS chemical, mapping_status IN ('verified', 'high_confidence_candidate') AS eligible FROM v_creg")


def admitted(star: Star) -> DataFrame:
    return star.chemical_registry.select(
        F.col("raw_name").alias("chemical"), entities.admitted_status(F.col("mapping_status")).alias("eligible")
    )


@query(
    "h13_row_weighted_scaler",
    """
SELECT feature, r6(avg(value)) AS feature_mean, r6(greatest(stddev_pop(value), 1)) AS feature_scale
FROM v_train JOIN v_admit USING (chemical) JOIN v_cfeat USING (chemical) WHERE eligible GROUP BY 1
""",
)
def h13(star: Star) -> DataFrame:
    rows = star.train.select("sample_id", "chemical").join(admitted(star).filter("eligible"), "chemical").join(chemical_features(star), "chemical")
    scale = features.feature_scale(rows)
    return scale.select("feature", r6("feature_mean").alias("feature_mean"), r6("feature_scale").alias("feature_scale"))


UNIQUE_SQL = "SELECT feature, avg(value) AS fm, greatest(stddev_pop(value), 1) AS fs FROM v_cfeat JOIN v_admit USING (chemical) WHERE eligible AND chemical IN (SELECT chemical FROM v_train) GROUP BY 1"


def _unique_scale(star: Star) -> DataFrame:
    rows = star.train.select("chemical").join(admitted(star).filter("eligible"), "chemical").join(chemical_features(star), "chemical")
    return features.unique_entity_scale(rows.select("chemical", "feature", "value"), "chemical")


@query(
    "h14_unique_entity_scaler",
    f"SELECT chemical, feature, r6(greatest(least((value - fm) / fs, 1.5), -1.5)) AS value FROM v_cfeat JOIN ({UNIQUE_SQL}) x USING (feature)",
)
def h14(star: Star) -> DataFrame:
    out = features.apply_scale(chemical_features(star), _unique_scale(star), clip=1.5)
    return out.select("chemical", "feature", r6("value").alias("value"))


@query(
    "h15_gated_feature_block",
    f"""
SELECT sample_id, feature, r6(value) AS value FROM (
 SELECT sample_id, feature, CASE WHEN coalesce(eligible, false) THEN greatest(least((value - fm) / fs, 5), -5) ELSE 0 END AS value
 FROM v_samples JOIN v_cfeat USING (chemical) JOIN ({UNIQUE_SQL}) x USING (feature) LEFT JOIN v_admit USING (chemical)
 UNION ALL SELECT sample_id, 'flag_missing', CASE WHEN coalesce(mapping_status, 'unresolved') = 'unresolved' THEN 1 ELSE 0 END FROM v_samples LEFT JOIN v_creg ON raw_name = chemical)
""",
)
def h15(star: Star) -> DataFrame:
    table = chemical_features(star).join(admitted(star), "chemical", "left")
    # Blocks are made once per entity and only then fanned out to samples.
    block = features.apply_scale(table, _unique_scale(star), clip=5.0, gate="eligible").select("chemical", "feature", "value")
    names = chemical_features(star).select("chemical").distinct()
    flags = entities.resolve(names, "chemical", star.chemical_registry, "raw_name", "e").select(
        "chemical", F.lit("flag_missing").alias("feature"), F.col("e_missing").cast("double").alias("value")
    )
    out = star.samples.select("sample_id", "chemical").join(block.unionByName(flags), "chemical")
    return out.select("sample_id", "feature", r6("value").alias("value"))


# ----------------------------------------------------------------- kernel blocks
def embedding_rows(star: Star) -> DataFrame:
    return star.table("embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def label_centres(star: Star) -> DataFrame:
    """Mean vector per label: the fit entities of the kernel queries (averaged per dimension, not per list)."""
    long = star.vectors.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    packed = long.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return packed.select("label", F.transform("p", lambda e: e["x"]).alias("c"))


view(
    "v_vec",
    "SELECT vec_id, CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
)
view("v_cen", "SELECT label AS centre, dim, avg(x) AS c FROM v_vec GROUP BY 1, 2")
view("v_dist", "SELECT vec_id, centre, sum((x - c) * (x - c)) AS d2 FROM v_vec JOIN v_cen USING (dim) GROUP BY 1, 2")
view("v_cdist", "SELECT a.centre AS i, b.centre AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM v_cen a JOIN v_cen b USING (dim) GROUP BY 1, 2")


@query(
    "h16_rbf_kernel_features",
    "SELECT vec_id, centre, r6(exp(-d2 / (2 * pow((SELECT median(d) FROM v_cdist WHERE i < j AND d > 1e-8), 2)))) AS value FROM v_dist",
)
def h16(star: Star) -> DataFrame:
    centres = written(label_centres(star), "centres")
    distances = features.centre_distances(embedding_rows(star), "vec_id", "v", centres, "label", "c")
    out = features.rbf_kernel(distances, features.kernel_bandwidth(centres, "label", "c"))
    return out.select("vec_id", "centre", r6("value").alias("value"))


@query("h17_nearest_centre", "SELECT vec_id, centre, r6(d2) AS d2 FROM v_dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, centre) = 1")
def h17(star: Star) -> DataFrame:
    found = features.centres_within(embedding_rows(star), "vec_id", "v", *features.pivot_index(label_centres(star), "label", "c"))
    return features.nearest_centre(found, "vec_id").select("vec_id", "centre", r6("d2").alias("d2"))


LEAST_KERNEL = 0.00001


@query(
    "h16_truncated_kernel_features",
    f"SELECT vec_id, centre, r6(1000000 * k) AS value_ppm FROM (SELECT vec_id, centre, exp(-d2 / (2 * pow((SELECT median(d) FROM v_cdist WHERE i < j AND d > 1e-8), 2))) AS k FROM v_dist) WHERE k >= {LEAST_KERNEL:.5f}",
)
def h16_truncated(star: Star) -> DataFrame:
    """Kernel features that are large enough to matter; the others are never made."""
    centres = written(label_centres(star), "centres")
    index = features.pivot_index(centres, "label", "c")
    out = features.truncated_kernel(embedding_rows(star), "vec_id", "v", *index, features.kernel_bandwidth(centres, "label", "c"), LEAST_KERNEL)
    return out.select("vec_id", "centre", r6(F.col("value") * 1000000).alias("value_ppm"))


@query(
    "h18_group_residual",
    """
WITH f AS (SELECT strain, protein, avg(y) AS gm FROM v_y JOIN v_train USING (sample_id) GROUP BY 1, 2)
SELECT sample_id, y.protein, r6(y - CASE WHEN s.strain IN (SELECT strain FROM f) THEN gm ELSE pm END) AS residual
FROM v_y y JOIN v_samples s USING (sample_id) LEFT JOIN f ON f.strain = s.strain AND f.protein = y.protein LEFT JOIN v_pm p ON p.protein = y.protein
""",
)
def h18(star: Star) -> DataFrame:
    cells = prepare.with_samples(star.log2, star.samples.select("sample_id", "strain", "split"))
    out = features.group_residual(cells, cells.filter(F.col("split") == "train"), "strain")
    return out.select("sample_id", "protein", r6("residual").alias("residual"))


@query(
    "h19_numeric_context",
    """
WITH e AS (SELECT event_id, event_type, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS DOUBLE), 0) AS a,
   ln(1 + greatest(value - 3, 0)) AS b FROM events),
 f AS (SELECT avg(a) AS am, greatest(stddev_pop(a), 1e-6) AS s1, avg(b) AS bm, greatest(stddev_pop(b), 1e-6) AS s2 FROM e WHERE event_type <> 'view')
SELECT event_id, r6((a - am) / s1) AS pert_time_z, r6((b - bm) / s2) AS pert_dose_z FROM e, f
""",
)
def h19(star: Star) -> DataFrame:
    rows = star.table("events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k")).alias("pert_time"),
        (F.col("value") - 3).alias("pert_dose"),
    )
    out = features.numeric_context(rows, rows.filter(F.col("event_type") != "view"), {"pert_time": False, "pert_dose": True})
    return out.select("event_id", r6("pert_time_z").alias("pert_time_z"), r6("pert_dose_z").alias("pert_dose_z"))


@query(
    "h20_node_signal",
    """
WITH cond AS (SELECT DISTINCT strain, chemical FROM v_samples),
 ct AS (SELECT p_brand AS chemical, p_name AS node, CASE WHEN p_type IN ('SMALL', 'PROMO') THEN -1 ELSE 1 END * p_size / 50.0 AS v FROM part),
 st AS (SELECT r_name AS strain, 'red widget' AS node, s_acctbal / 10000.0 AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
 x AS (SELECT strain, chemical, node, v FROM cond JOIN ct USING (chemical) UNION ALL SELECT strain, chemical, node, v FROM cond JOIN st USING (strain))
SELECT strain || '/' || chemical AS condition_id, node AS protein, r6(sum(v)) AS signal_sum, r6(max(abs(v))) AS signal_max_abs FROM x WHERE node <> 'blue bolt' GROUP BY 1, 2
""",
)
def h20(star: Star) -> DataFrame:
    conditions = star.samples.select("strain", "chemical").distinct().withColumn("condition_id", F.concat_ws("/", "strain", "chemical"))
    targets = star.table("part").select(
        F.col("p_brand").alias("chemical"),
        F.col("p_name").alias("systematic_name"),
        F.when(F.col("p_type") == "SMALL", "Inhibition").when(F.col("p_type") == "PROMO", "degradation").otherwise("activation").alias("action"),
        (F.col("p_size") / 50.0).alias("weight"),
    )
    strains = (
        star.table("supplier")
        .join(star.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(star.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("strain"), F.lit("red widget").alias("systematic_name"), (F.col("s_acctbal") / 10000.0).alias("mutation_value"))
    )
    mapping = star.table("part").select(F.col("p_name").alias("systematic_name"), F.col("p_name").alias("protein")).distinct().filter(F.col("protein") != "blue bolt")
    out = features.node_signal(conditions, targets, strains, mapping)
    return out.select("condition_id", "protein", r6("signal_sum").alias("signal_sum"), r6("signal_max_abs").alias("signal_max_abs"))


@query(
    "h21_whole_group_derangement",
    """
WITH g AS (SELECT chemical, row_number() OVER (ORDER BY md5('991|' || chemical)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT chemical FROM v_cfeat)),
 m AS (SELECT a.chemical, b.chemical AS donor FROM g a JOIN g b ON b.rn = a.rn % a.n + 1)
SELECT m.chemical, m.donor, f.feature, r6(f.value) AS value FROM m JOIN v_cfeat f ON f.chemical = m.donor
""",
)
def h21(star: Star) -> DataFrame:
    out = features.deranged_groups(chemical_features(star), "chemical", 991)
    return out.select("chemical", "donor", "feature", r6("value").alias("value"))


@query(
    "h22_fit_row_label_permutation",
    """
WITH a AS (SELECT sample_id, row_number() OVER (ORDER BY md5('7-to|' || CAST(sample_id AS VARCHAR))) AS rn FROM v_train),
 b AS (SELECT plate, row_number() OVER (ORDER BY md5('7-from|' || CAST(sample_id AS VARCHAR))) AS rn FROM v_train)
SELECT s.sample_id, coalesce(p.plate, s.plate) AS plate FROM v_samples s LEFT JOIN (SELECT sample_id, plate FROM a JOIN b USING (rn)) p USING (sample_id)
""",
)
def h22(star: Star) -> DataFrame:
    permuted = features.permuted_column(star.train, "sample_id", "plate", 7)
    return star.samples.select("sample_id", "plate").join(permuted, "sample_id", "left").select("sample_id", F.coalesce("permuted", "plate").alias("plate"))


@query("h23_low_rank_response_basis")
def h23(star: Star) -> DataFrame:
    basis = features.response_basis(Study(star).train_deltas, 3)
    return basis.select("component", "protein", r6("energy").alias("energy"), r6("loading").alias("loading"))


# Deltas of train treatments, centred by protein; what a basis is fitted on.
CENTRED_SQL = """
SELECT sample_id, protein, t - avg(t) OVER (PARTITION BY protein) AS d FROM v_tdelta
"""


@query(
    "h23_basis_restores_the_covariance",
    f"""
WITH c AS ({CENTRED_SQL}), total AS (SELECT sum(d * d) AS t FROM c), p AS (SELECT DISTINCT protein FROM c)
SELECT a.protein AS protein, b.protein AS other, r6(coalesce((SELECT sum(x.d * y.d) FROM c x JOIN c y USING (sample_id) WHERE x.protein = a.protein AND y.protein = b.protein), 0) / t) AS share
FROM p a, p b, total
""",
)
def h23_covariance(star: Star) -> DataFrame:
    """All components together give back every pair's share of the centred sums of products."""
    basis = written(features.response_basis(Study(star).train_deltas, 7), "basis")
    left = basis.select("component", "energy", "protein", F.col("loading").alias("x"))
    right = basis.select("component", F.col("protein").alias("other"), F.col("loading").alias("y"))
    pairs = left.join(right, "component").groupBy("protein", "other")
    return pairs.agg(r6(F.sum(F.col("energy") * F.col("x") * F.col("y"))).alias("share"))


@query(
    "h23_basis_invariants",
    f"""
WITH c AS ({CENTRED_SQL}), k AS (SELECT unnest([0, 1, 2]) AS component)
SELECT 'orthonormal' AS invariant, a.component::BIGINT AS component, b.component::BIGINT AS other, (CASE WHEN a.component = b.component THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM k a, k b
UNION ALL SELECT 'energy_not_above_previous', component, NULL, 1.0 FROM k
UNION ALL SELECT 'residual_below_millionth', component, NULL, 1.0 FROM k
UNION ALL SELECT 'cells', NULL, NULL, count(*)::DOUBLE FROM c
""",
)
def h23_invariants(star: Star) -> DataFrame:
    """Orthonormal loadings, falling energy and small eigenvector residuals of the rank 3 basis."""
    deltas = Study(star).train_deltas
    basis = written(features.response_basis(deltas, 3), "basis")
    other = basis.select(F.col("component").alias("other"), "protein", F.col("loading").alias("y"))
    none = F.lit(None).cast("bigint")
    dots = basis.join(other, "protein").groupBy("component", "other").agg(r6(F.sum(F.col("loading") * F.col("y"))).alias("value"))
    each = basis.groupBy("component").agg(F.first("energy").alias("energy"), F.first("residual").alias("residual"))
    before = each.select((F.col("component") + 1).alias("component"), F.col("energy").alias("previous"))
    energy = each.join(before, "component", "left").select("component", (F.coalesce("previous", F.lit(1.0)) >= F.col("energy")).cast("double").alias("value"))
    residual = each.select("component", (F.col("residual") <= 1e-6).cast("double").alias("value"))
    cells = features.centred_cells(deltas).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts = [
        dots.select(F.lit("orthonormal").alias("invariant"), "component", "other", (F.col("value") + 0.0).alias("value")),
        energy.select(F.lit("energy_not_above_previous").alias("invariant"), "component", none.alias("other"), "value"),
        residual.select(F.lit("residual_below_millionth").alias("invariant"), "component", none.alias("other"), "value"),
        cells.select(F.lit("cells").alias("invariant"), none.alias("component"), none.alias("other"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def centre_table(star: Star) -> DataFrame:
    """Distances between label centres as a long table (i, j, d)."""
    centres = written(label_centres(star), "centres")
    table = features.centre_distances(centres, "label", "c", centres, "label", "c")
    return table.select(F.col("label").alias("i"), F.col("centre").alias("j"), F.sqrt("d2").alias("d"))


@query(
    "h24_double_centring",
    """
WITH q AS (SELECT i, j, d * d AS q FROM v_cdist)
SELECT i, j, r6(-0.5 * (q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER ())) AS gram FROM q
""",
)
def h24(star: Star) -> DataFrame:
    return features.double_centred(centre_table(star)).select("i", "j", r6("gram").alias("gram"))


@query("h24_classical_mds")
def h24_mds(star: Star) -> DataFrame:
    out = features.classical_mds(written(centre_table(star), "distances"), 3)
    return out.select("entity", "dimension", r6("coordinate").alias("coordinate"), r6("eigenvalue").alias("eigenvalue"))


@query(
    "h24_coordinates_restore_distances",
    "WITH n AS (SELECT count(DISTINCT i) AS n FROM v_cdist) SELECT i, j, r6(d * d) AS d2 FROM v_cdist, n WHERE n > 0",
)
def h24_distances(star: Star) -> DataFrame:
    """Distances between points come back from the coordinates of all dimensions, one fewer than entities."""
    distances = written(centre_table(star), "distances")
    placed = written(features.classical_mds(distances, distances.select("i").distinct().count() - 1), "coordinates")
    other = placed.select(F.col("entity").alias("j"), "dimension", F.col("coordinate").alias("y"))
    pairs = placed.select(F.col("entity").alias("i"), "dimension", F.col("coordinate").alias("x")).join(other, "dimension")
    return pairs.groupBy("i", "j").agg(r6(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("d2"))


@query(
    "h24_distance_contract",
    "SELECT 'not_symmetric' AS issue, i, j FROM v_cdist WHERE (i = 0 AND j = 1) OR (i = 1 AND j = 0) UNION ALL SELECT 'diagonal_not_zero', i, j FROM v_cdist WHERE i = 2 AND j = 2",
)
def h24_contract(star: Star) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    broken = centre_table(star).withColumn("d", F.when((i == 0) & (j == 1), F.col("d") + 1).when((i == 2) & (j == 2), 0.5).otherwise(F.col("d")))
    return features.distance_violations(broken)


@query(
    "h25_property_slugs",
    "SELECT DISTINCT p_partkey, 'p_name_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS feature, CAST(1 AS DOUBLE) AS value FROM part",
)
def h25(star: Star) -> DataFrame:
    return features.property_slugs(star.table("part"), "p_partkey", "p_name")
