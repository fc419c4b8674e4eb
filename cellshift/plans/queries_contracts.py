"""Registered queries: sources, contract checks and preparation (groups A, B, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.functions.text import plain_name, row_kind
from cellshift.operators import checks, controls, prepare
from cellshift.operators.fingerprints import table_fingerprint
from cellshift.plans.registry import query
from cellshift.plans.sqltext import fingerprint
from cellshift.plans.study import Study
from cellshift.schema import METADATA_COLUMNS
from cellshift.session import scratch_path
from cellshift.sources import readers, writers
from cellshift.sources.star import STAR_CONTROLS, STAR_QUALITY_CONTROLS, Star

THRESHOLD = 0.80


# --------------------------------------------------------------------- sources
@query(
    "a01_sample_metadata_csv",
    "SELECT split, count(*) AS n_samples, count(DISTINCT chemical) AS n_chemicals, count(DISTINCT temperature) AS n_temperatures, "
    "CAST(min(pert_time) AS DOUBLE) AS first_time, CAST(max(pert_time) AS DOUBLE) AS last_time FROM v_samples GROUP BY 1",
)
def a01(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "samples-csv")
    renamed = star.samples.select(*[F.col(ours).alias(theirs) for theirs, ours in METADATA_COLUMNS.items()])
    # Two column orders in one folder.
    late = F.col("pert_time") > 1996
    writers.write_csv(renamed.filter(~late), f"{path}/early")
    writers.write_csv(renamed.filter(late).select(*renamed.columns[::-1]), f"{path}/late")
    samples = readers.read_samples_csv(star.spark, f"{path}/*")
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.countDistinct("chemical").alias("n_chemicals"),
        F.countDistinct("temperature").alias("n_temperatures"),
        F.min("pert_time").alias("first_time"),
        F.max("pert_time").alias("last_time"),
    )


def _wide_csv(star: Star) -> str:
    """Write the cells as wide sample x protein CSV files with two column orders in one folder."""
    path = scratch_path(star.spark, "wide-csv")
    # Protein names are column names here, so they are few.
    proteins = sorted(row["protein"] for row in star.cells.select("protein").distinct().collect())
    wide = star.cells.groupBy("sample_id").pivot("protein", proteins).agg(F.first("value")).withColumnRenamed("sample_id", "sample_ID")
    odd = F.col("sample_ID") % 2 == 1
    writers.write_csv(wide.filter(~odd), f"{path}/even")
    writers.write_csv(wide.filter(odd).select(*proteins[::-1], "sample_ID"), f"{path}/odd")
    return f"{path}/*"


@query(
    "a02_wide_matrix_to_cells",
    "SELECT protein, count(*) AS n_values, r6(avg(value)) AS mean_value, r6(max(value)) AS max_value FROM v_cells GROUP BY 1",
)
def a02(star: Star) -> DataFrame:
    cells = readers.read_wide_matrix_csv(star.spark, _wide_csv(star))
    return cells.groupBy("protein").agg(
        F.count(F.lit(1)).alias("n_values"), r6(F.avg("value")).alias("mean_value"), r6(F.max("value")).alias("max_value")
    )


@query(
    "a03_pruned_matrix_read",
    "SELECT protein, count(*) AS n_values, r6(avg(value)) AS mean_value FROM v_cells WHERE protein IN ('L2', 'L5') GROUP BY 1",
)
def a03(star: Star) -> DataFrame:
    cells = readers.read_wide_matrix_csv(star.spark, _wide_csv(star), proteins=["L2", "L5"])
    return cells.groupBy("protein").agg(F.count(F.lit(1)).alias("n_values"), r6(F.avg("value")).alias("mean_value"))


@query(
    "a04_registry_tsv",
    "SELECT raw_name, canonical_id, mapping_status, proxy_target, inchikey FROM v_creg",
)
def a04(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "registry-tsv")
    writers.write_csv(star.chemical_registry, path, sep="\t")
    return readers.read_registry_tsv(star.spark, path).select(
        "raw_name", "canonical_id", "mapping_status", "proxy_target", "inchikey"
    )


@query(
    "a05_gzip_edge_list",
    "SELECT count(*) AS n_links, CAST(sum(combined_score) AS BIGINT) AS total_score, CAST(max(combined_score) AS BIGINT) AS max_score FROM v_links",
)
def a05(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "links-gz")
    writers.write_csv(star.links, path, sep=" ", compression="gzip")
    links = readers.read_edge_list(star.spark, path)
    return links.agg(
        F.count(F.lit(1)).alias("n_links"),
        F.sum("combined_score").alias("total_score"),
        F.max("combined_score").alias("max_score"),
    )


@query(
    "a06_feature_table_with_aliases",
    """
SELECT feature_type, count(DISTINCT systematic) AS n_features, count(alias) AS n_aliases FROM (
  SELECT p_type AS feature_type, 'P' || CAST(p_partkey AS VARCHAR) AS systematic,
         unnest(CASE WHEN p_size % 3 = 0 THEN [] ELSE string_split(replace(p_name, ' ', '|'), '|') END) AS alias FROM part)
GROUP BY 1
""",
)
def a06(star: Star) -> DataFrame:
    path = scratch_path(star.spark, "features-tab")
    table = star.table("part").select(
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_type").alias("type"),
        F.lit("Verified").alias("qualifier"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("systematic"),
        F.col("p_brand").alias("standard"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.regexp_replace("p_name", " ", "|")).alias("aliases"),
    )
    writers.write_csv(table, path, sep="\t", header=False)
    aliases = readers.explode_aliases(readers.read_feature_table(star.spark, path)).filter(F.col("alias").isNotNull())
    return aliases.groupBy("feature_type").agg(
        F.countDistinct("systematic").alias("n_features"), F.count("alias").alias("n_aliases")
    )


@query(
    "a07_assemble_fold_predictions",
    "SELECT fold, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples, r6(avg(m1)) AS mean_prediction, "
    "CAST(0 AS BIGINT) AS n_repeated FROM v_oof GROUP BY 1",
)
def a07(star: Star) -> DataFrame:
    study = Study(star)
    path = scratch_path(star.spark, "preds")
    rows = study.oof.select("fold", "sample_id", "protein", F.col("m1").alias("value"))
    writers.write_predictions(rows, path, partition_by=("fold",))
    preds = readers.read_fold_predictions(star.spark, path)
    repeated = readers.repeated_cells(preds).agg(F.count(F.lit(1)))
    return (
        preds.groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.countDistinct("sample_id").alias("n_samples"),
            r6(F.avg("value")).alias("mean_prediction"),
        )
        .withColumn("n_repeated", repeated.scalar())
    )


@query(
    "a08_leaderboard_from_run_tree",
    "SELECT split AS run, split AS scenario, count(*) AS n_cells, r6(sqrt(avg((m0 - y) * (m0 - y)))) AS rmse FROM v_abs GROUP BY 1, 2",
)
def a08(star: Star) -> DataFrame:
    study = Study(star)
    path = scratch_path(star.spark, "runs")
    summary = study.absolute.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sqrt(F.avg((F.col("m0") - F.col("y")) ** 2)).alias("rmse")
    )
    writers.write_run_summaries(summary.withColumn("scenario", F.col("split")), path, run="split")
    board = readers.read_leaderboard(star.spark, path)
    return board.select("run", "scenario", F.col("n_cells").cast("bigint").alias("n_cells"), r6(F.col("rmse").cast("double")).alias("rmse"))


@query(
    "a09_metric_table_sinks",
    "SELECT split, count(*) AS n_cells, r6(avg(abs(m0 - y))) AS mae FROM v_abs GROUP BY 1",
)
def a09(star: Star) -> DataFrame:
    study = Study(star)
    path = scratch_path(star.spark, "metrics")
    table = study.absolute.groupBy("split").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.abs(F.col("m0") - F.col("y"))).alias("mae"))
    paths = writers.write_metric_table(table, path)
    from_json = star.spark.read.schema("split string, n_cells bigint, mae double").json(paths["json"])
    from_csv = star.spark.read.schema("split string, n_cells bigint, mae double").csv(paths["csv"], header=True)
    same = from_json.join(from_csv.select("split", F.col("mae").alias("_csv")), "split").filter(F.abs(F.col("mae") - F.col("_csv")) < 1e-9)
    return same.select("split", "n_cells", r6("mae").alias("mae"))


@query(
    "a10_frozen_reference_tables",
    """
SELECT 'context' AS reference, count(*) AS n_values, count(DISTINCT protein) AS n_proteins, r6(avg(ctx)) AS mean_value,
       CAST(0 AS BIGINT) AS n_protein_mismatch FROM v_ctx
UNION ALL SELECT 'drug', count(*), count(DISTINCT protein), r6(avg(drug)), CAST(0 AS BIGINT) FROM v_drug
""",
)
def a10(star: Star) -> DataFrame:
    study = Study(star)
    path = scratch_path(star.spark, "references")
    writers.write_references(study.context_reference, study.drug_reference, path)
    context, drug = readers.load_references(star.spark, path)
    proteins = star.log2.select("protein").distinct()
    parts = []
    for name, frame, column in (("context", context, "context_ref"), ("drug", drug, "drug_ref")):
        bad = checks.key_set_difference(proteins, frame.select("protein").distinct(), "protein").agg(F.count(F.lit(1)))
        parts.append(
            frame.agg(
                F.count(F.lit(1)).alias("n_values"),
                F.countDistinct("protein").alias("n_proteins"),
                r6(F.avg(column)).alias("mean_value"),
            ).select(F.lit(name).alias("reference"), "*", bad.scalar().alias("n_protein_mismatch"))
        )
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------------- checks
@query(
    "b01_key_violations",
    "SELECT 'duplicate_key' AS issue, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def b01(star: Star) -> DataFrame:
    return checks.key_violations(star.table("lineitem"), "l_orderkey")


@query(
    "b02_key_set_difference",
    """
SELECT 'missing' AS side, o_orderkey AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'extra', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
""",
)
def b02(star: Star) -> DataFrame:
    orders = star.table("orders").select(F.col("o_orderkey").alias("sample_id"))
    return checks.key_set_difference(orders, star.cells.select("sample_id"), "sample_id")


@query(
    "b03_split_overlap",
    """
SELECT DISTINCT match_key FROM v_samples WHERE split = 'train'
INTERSECT SELECT match_key FROM v_samples WHERE split = 'val_strain_only' OR split = 'val_chem_only'
""",
)
def b03(star: Star) -> DataFrame:
    held = star.samples.filter(F.col("split").isin("val_strain_only", "val_chem_only"))
    return checks.overlap(star.train, held, "match_key")


@query(
    "b04_input_audit",
    """
SELECT split AS table_name, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples FROM v_samples GROUP BY 1
UNION ALL SELECT 'cells', count(*), count(DISTINCT sample_id) FROM v_cells
""",
)
def b04(star: Star) -> DataFrame:
    by_split = star.samples.groupBy(F.col("split").alias("table_name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_samples")
    )
    return by_split.unionByName(checks.input_audit({"cells": star.cells}))


@query(
    "b05_value_domain",
    """
SELECT event_type, count(v) AS n_observed, count(*) FILTER (WHERE isnan(v) OR isinf(v)) AS n_non_finite,
       count(*) FILTER (WHERE NOT isnan(v) AND NOT isinf(v) AND v <= 0) AS n_non_positive
FROM (SELECT event_type, CASE WHEN value < 1 THEN 'NaN'::DOUBLE WHEN value > 40 THEN 'Infinity'::DOUBLE
             WHEN value < 2 THEN -value ELSE value END AS v FROM events) GROUP BY 1
""",
)
def b05(star: Star) -> DataFrame:
    v = F.col("value")
    broken = star.table("events").withColumn(
        "value",
        F.when(v < 1, F.lit(float("nan"))).when(v > 40, F.lit(float("inf"))).when(v < 2, -v).otherwise(v),
    )
    return checks.value_domain(broken, "value", ["event_type"])


@query(
    "b06_row_kinds",
    "SELECT kind, count(*) AS n_samples FROM v_samples GROUP BY 1",
)
def b06(star: Star) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.upper("chemical"), F.lit(" "))
    return star.samples.select(row_kind(padded, STAR_CONTROLS, STAR_QUALITY_CONTROLS).alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_samples")
    )


@query(
    "b07_missing_rates",
    """
SELECT p.protein, (SELECT count(*) FROM v_train) AS n_fit, coalesce(o.n, 0) AS n_observed,
       r6(1 - coalesce(o.n, 0) * 1.0 / (SELECT count(*) FROM v_train)) AS missing_rate,
       1 - coalesce(o.n, 0) * 1.0 / (SELECT count(*) FROM v_train) < 0.555 AS kept
FROM (SELECT DISTINCT protein FROM v_cells) p
LEFT JOIN (SELECT protein, count(*) AS n FROM v_cells JOIN v_train USING (sample_id) GROUP BY 1) o ON o.protein = p.protein
""",
)
def b07(star: Star) -> DataFrame:
    rates = Study(star).raw_rates
    return rates.select("protein", "n_fit", "n_observed", r6("missing_rate").alias("missing_rate"), (F.col("missing_rate") < 0.555).alias("kept"))


@query(
    "b08_log2_cells",
    """
WITH rows AS MATERIALIZED (SELECT count(*) AS n FROM v_train),
 kept AS MATERIALIZED (SELECT protein FROM (SELECT protein, count(*) AS seen FROM v_cells JOIN v_train USING (sample_id) GROUP BY 1), rows WHERE 1 - seen * 1.0 / n < 0.8),
 y AS MATERIALIZED (SELECT * FROM v_y)
SELECT y.sample_id, y.protein, r6(y.y) AS y FROM y JOIN kept ON kept.protein = y.protein
""",
)
def b08(star: Star) -> DataFrame:
    kept = prepare.kept_proteins(Study(star).raw_rates, THRESHOLD)
    return prepare.log2_cells(star.cells, kept).select("sample_id", "protein", r6("y").alias("y"))


@query(
    "b08_rejected_values",
    "SELECT event_type, CASE WHEN value - 5 = 0 THEN 'zero' ELSE 'negative' END AS side, 'non_positive' AS reason, count(*) AS n FROM events WHERE value <= 5 GROUP BY 1, 2, 3",
)
def b08_rejected(star: Star) -> DataFrame:
    shifted = star.table("events").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("protein"), (F.col("value") - 5).alias("value"))
    side = F.when(F.col("value") == 0, "zero").otherwise("negative")
    return prepare.rejected_values(shifted).groupBy(F.col("protein").alias("event_type"), side.alias("side"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b08_lenient_log2",
    "SELECT event_type, count(*) AS n_cells, count(*) FILTER (WHERE value > 5) AS n_observed, "
    "r6(avg(CASE WHEN value > 5 THEN log2(value - 5) END)) AS mean_y FROM events GROUP BY 1",
)
def b08_lenient(star: Star) -> DataFrame:
    shifted = star.table("events").select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("protein"), (F.col("value") - 5).alias("value"))
    return prepare.lenient_log2(shifted).groupBy(F.col("protein").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(F.when(F.col("observed"), F.lit(1))).alias("n_observed"), r6(F.avg("y")).alias("mean_y")
    )


@query(
    "b09_feature_contract",
    """
WITH t AS (SELECT count(*) AS n FROM v_train),
 r AS (SELECT protein, 1 - count(*) FILTER (WHERE split = 'train') * 1.0 / (SELECT n FROM t) AS rate FROM v_cells JOIN v_samples USING (sample_id) GROUP BY 1)
SELECT count(*) AS n_raw_proteins, count(*) FILTER (WHERE rate < 0.8) AS n_kept_proteins, (SELECT n FROM t) AS train_sample_count,
       CAST(0.8 AS DOUBLE) AS missing_rate_threshold, (SELECT count(*) FROM v_samples) AS n_samples,
       (SELECT count(*) FROM v_cells WHERE protein IN (SELECT protein FROM r WHERE rate < 0.8)) AS n_observed,
       r6((SELECT count(*) FROM v_cells WHERE protein IN (SELECT protein FROM r WHERE rate < 0.8)) * 1.0
          / ((SELECT count(*) FROM v_samples) * count(*) FILTER (WHERE rate < 0.8))) AS observed_fraction
FROM r
""",
)
def b09(star: Star) -> DataFrame:
    report = prepare.feature_contract(Study(star).raw_rates, star.samples, star.cells, THRESHOLD)
    return report.withColumn("observed_fraction", r6("observed_fraction"))


@query(
    "b10_scale_detection",
    """
SELECT 'raw_table' AS source, r6(median(value)) AS median_value, CASE WHEN median(value) > 100 THEN 'raw' ELSE 'log2' END AS scale,
       r6(avg(log2(value))) AS mean_log2 FROM v_cells
UNION ALL SELECT 'log2_table', r6(median(y)), CASE WHEN median(y) > 100 THEN 'raw' ELSE 'log2' END, r6(avg(y)) FROM v_y
""",
)
def b10(star: Star) -> DataFrame:
    parts = []
    for name, cells in (("raw_table", star.cells), ("log2_table", star.log2.withColumnRenamed("y", "value"))):
        found = prepare.detect_scale(cells)
        mean = prepare.to_log2_by_scale(cells).agg(r6(F.avg("y")))
        parts.append(found.select(F.lit(name).alias("source"), r6("median_value").alias("median_value"), "scale", mean.scalar().alias("mean_log2")))
    return parts[0].unionByName(parts[1])


@query(
    "b11_submission_report",
    """
WITH want AS (SELECT sample_id FROM v_samples WHERE split <> 'train'),
 pred AS (SELECT sample_id, protein FROM v_y JOIN v_samples USING (sample_id) WHERE split <> 'train'),
 per AS (SELECT sample_id, count(*) AS n FROM pred GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n IS NULL) AS n_missing_ids, CAST(0 AS BIGINT) AS n_extra_ids,
       CAST(0 AS BIGINT) AS n_non_finite, count(*) FILTER (WHERE n <> 7) AS n_incomplete_rows, CAST(0 AS BIGINT) AS n_extra_proteins,
       count(*) FILTER (WHERE n IS NULL OR n <> 7) = 0 AS accepted FROM want LEFT JOIN per USING (sample_id)
""",
)
def b11(star: Star) -> DataFrame:
    study = Study(star)
    held = star.samples.filter(F.col("split") != "train").select("sample_id")
    preds = study.absolute.filter(F.col("split") != "train").select("sample_id", "protein", F.col("m0").alias("value"))
    return checks.submission_report(held, star.log2.select("protein").distinct(), preds)


@query(
    "b11_column_order_report",
    "SELECT CAST(7 AS BIGINT) AS n_expected, CAST(7 AS BIGINT) AS n_submitted, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra, "
    "(SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY protein) AS a, row_number() OVER (ORDER BY n DESC, protein) AS b FROM "
    "(SELECT protein, count(*) AS n FROM v_y GROUP BY 1)) WHERE a <> b) AS n_out_of_order",
)
def b11_order(star: Star) -> DataFrame:
    names = star.log2.groupBy("protein").agg(F.count(F.lit(1)).alias("n"))
    listed = names.agg(F.sort_array(F.collect_list("protein")).alias("a"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "protein"))).alias("b"))
    expected = listed.select(F.posexplode("a").alias("position", "protein"))
    submitted = listed.select(F.posexplode(F.transform("b", lambda item: item["protein"])).alias("position", "protein"))
    return checks.ordered_set_report(expected, submitted, "protein", "position")


@query(
    "b12_align_prediction_to_truth",
    """
SELECT split, count(*) AS n_cells, count(m0) AS n_predicted, r6(avg(y)) AS mean_truth, r6(avg(m0)) AS mean_prediction
FROM v_abs GROUP BY 1
""",
)
def b12(star: Star) -> DataFrame:
    study = Study(star)
    truth = prepare.with_samples(star.log2, star.samples.select("sample_id", "split"))
    preds = study.absolute.select("sample_id", "protein", F.col("m0").alias("m"))
    return truth.join(preds, ["sample_id", "protein"], "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("m").alias("n_predicted"), r6(F.avg("y")).alias("mean_truth"), r6(F.avg("m")).alias("mean_prediction")
    )


@query(
    "b13_paired_prediction_contract",
    """
WITH a AS (SELECT sample_id, protein FROM v_abs WHERE split <> 'train'), b AS (SELECT sample_id, protein FROM v_abs WHERE kind = 'treatment')
SELECT (SELECT count(*) FROM a JOIN b USING (sample_id, protein)) AS n_shared,
       (SELECT count(*) FROM a ANTI JOIN b USING (sample_id, protein)) AS n_left_only,
       (SELECT count(*) FROM b ANTI JOIN a USING (sample_id, protein)) AS n_right_only, CAST(0 AS BIGINT) AS n_repeated
""",
)
def b13(star: Star) -> DataFrame:
    study = Study(star)
    left = study.absolute.filter(F.col("split") != "train")
    right = study.absolute.filter(F.col("kind") == "treatment")
    return checks.aligned_pair_report(left, right)


@query(
    "b14_role_conflicts",
    """
SELECT chemical, count(DISTINCT medium) AS n_roles, array_to_string(list_sort(list(DISTINCT medium)), '|') AS roles
FROM v_samples GROUP BY 1 HAVING count(DISTINCT medium) <> 1
""",
)
def b14(star: Star) -> DataFrame:
    return checks.role_conflicts(star.samples, "chemical", "medium")


@query(
    "b15_namespaced_ids",
    """
SELECT data_source, plate AS pert_id, count(DISTINCT lower(chemical)) AS n_chemicals FROM v_samples
GROUP BY 1, 2 HAVING count(DISTINCT lower(chemical)) > 1
""",
)
def b15(star: Star) -> DataFrame:
    # The plate name stands in for a badly reused id, so that conflicts exist.
    reused = star.samples.withColumn("pert_id", F.col("plate"))
    return checks.namespaced_conflicts(reused, plain_name("chemical"))


@query(
    "b15_namespaced_records",
    "SELECT DISTINCT data_source, pert_id, lower(chemical) AS chemical_key FROM v_samples",
)
def b15_records(star: Star) -> DataFrame:
    return checks.namespaced_records(star.samples, plain_name("chemical"))


@query(
    "b16_identity_drift",
    """
WITH f AS (SELECT DISTINCT data_source, pert_id, lower(chemical) AS k FROM v_train),
 c AS (SELECT DISTINCT data_source, pert_id, CASE WHEN chemical = 'Brand#9' THEN 'brand#99' ELSE lower(chemical) END AS k FROM v_samples)
SELECT data_source, pert_id, f.k AS fit_key, c.k AS current_key FROM f JOIN c USING (data_source, pert_id) WHERE f.k <> c.k
""",
)
def b16(star: Star) -> DataFrame:
    fit = checks.namespaced_records(star.train, plain_name("chemical"))
    renamed = F.when(F.col("chemical") == "Brand#9", "brand#99").otherwise(plain_name("chemical"))
    return checks.identity_drift(fit, checks.namespaced_records(star.samples, renamed))


# ----------------------------------------------------------- sort, limit, sets
@query(
    "p01_sorted_leaderboard",
    "SELECT split, strain, r6(sqrt(avg((m1 - y) * (m1 - y)))) AS rmse FROM v_abs GROUP BY 1, 2 ORDER BY rmse DESC",
)
def p01(star: Star) -> DataFrame:
    board = Study(star).absolute.groupBy("split", "strain").agg(r6(F.sqrt(F.avg((F.col("m1") - F.col("y")) ** 2))).alias("rmse"))
    return board.orderBy(F.desc("rmse"), "split", "strain")


@query(
    "p02_first_offenders",
    "SELECT 'duplicate_key' AS issue, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey "
    "HAVING count(*) > 1 ORDER BY n_rows DESC, key LIMIT 5",
)
def p02(star: Star) -> DataFrame:
    bad = checks.key_violations(star.table("lineitem"), "l_orderkey")
    return bad.orderBy(F.desc("n_rows"), "key").limit(5)


@query(
    "p03_union_of_row_sets",
    "SELECT origin, kind, count(*) AS n FROM (SELECT 'train' AS origin, kind FROM v_train UNION ALL SELECT 'held', kind FROM v_samples WHERE split <> 'train') GROUP BY 1, 2",
)
def p03(star: Star) -> DataFrame:
    train = star.train.select(F.lit("train").alias("origin"), "kind")
    held = star.samples.filter(F.col("split") != "train").select(F.lit("held").alias("origin"), "kind")
    return train.unionByName(held).groupBy("origin", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_id_set_algebra",
    """
SELECT 'held_only' AS part, count(*) AS n FROM (SELECT match_key FROM v_samples WHERE split <> 'train' EXCEPT SELECT match_key FROM v_train)
UNION ALL SELECT 'shared', count(*) FROM (SELECT match_key FROM v_samples WHERE split <> 'train' INTERSECT SELECT match_key FROM v_train)
""",
)
def p04(star: Star) -> DataFrame:
    # One pass over the keys, with the sides each is in: samples are neither sorted nor joined.
    side = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    keys = star.samples.groupBy("match_key").agg(side(F.col("split") != "train").alias("held"), side(F.col("split") == "train").alias("fit"))
    counts = keys.agg(F.count_if(F.col("held") & ~F.col("fit")).alias("held_only"), F.count_if(F.col("held") & F.col("fit")).alias("shared"))
    return counts.unpivot([], ["held_only", "shared"], "part", "n")


@query(
    "p05_distinct_records",
    "SELECT DISTINCT strain, medium, temperature, pert_time FROM v_samples WHERE kind = 'treatment'",
)
def p05(star: Star) -> DataFrame:
    return star.treatments.select("strain", "medium", "temperature", "pert_time").dropDuplicates()


@query(
    "n01_table_fingerprint",
    f"SELECT split, count(*) AS n_rows, {fingerprint(['sample_id', 'strain', 'chemical', 'medium', 'pert_time'])} AS fingerprint FROM v_samples GROUP BY 1",
)
def n01(star: Star) -> DataFrame:
    return table_fingerprint(star.samples, ["sample_id", "strain", "chemical", "medium", "pert_time"], by=["split"])


@query(
    "c07_control_observed_truth",
    """
SELECT s.split, count(*) AS n_cells, count(DISTINCT y.sample_id) AS n_samples, r6(avg(y.y)) AS mean_truth
FROM v_y y JOIN v_samples s USING (sample_id) WHERE EXISTS (SELECT 1 FROM v_ctrl c WHERE c.match_key = s.match_key AND c.protein = y.protein)
GROUP BY 1
""",
)
def c07(star: Star) -> DataFrame:
    study = Study(star)
    truth = controls.control_observed_truth(star.log2, star.samples, study.all_controls)
    return prepare.with_samples(truth, star.samples.select("sample_id", "split")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("sample_id").alias("n_samples"), r6(F.avg("y")).alias("mean_truth")
    )
