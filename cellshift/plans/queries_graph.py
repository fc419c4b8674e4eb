"""Registered queries: interaction graph and data audits (groups M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.operators import audit, features, graph
from cellshift.operators.ranking import shifted_donor
from cellshift.plans.queries_features import chemical_features
from cellshift.plans.queries_metrics import rounded
from cellshift.plans.registry import query, view
from cellshift.plans.study import Study
from cellshift.session import written
from cellshift.sources import readers
from cellshift.sources.star import Star

MIN_SCORE = 400


# ------------------------------------------------------------------------- graph
def node_table(star: Star) -> DataFrame:
    """Parts and suppliers as nodes: P<k> -> 2k, S<k> -> 2k + 1."""
    parts = star.table("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") * 2).alias("node"))
    suppliers = star.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") * 2 + 1).alias("node"))
    return parts.unionByName(suppliers)


def edge_table(star: Star) -> DataFrame:
    return graph.build_edges(star.links, node_table(star), MIN_SCORE)


view("v_nodes", "SELECT 'P' || p_partkey AS name, p_partkey * 2 AS node FROM part UNION ALL SELECT 'S' || s_suppkey, s_suppkey * 2 + 1 FROM supplier")
view(
    "v_edges",
    """
SELECT least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, max(combined_score) / 1000.0 AS weight FROM v_links
JOIN v_nodes a ON a.name = substr(protein1, 4) JOIN v_nodes b ON b.name = substr(protein2, 4) WHERE combined_score >= 400 GROUP BY 1, 2
""",
)
view("v_dir", "SELECT src AS a, dst AS b, weight FROM v_edges UNION ALL SELECT dst, src, weight FROM v_edges")
view("v_deg", "SELECT a AS node, count(*) AS degree FROM v_dir GROUP BY 1")


def feature_table(star: Star) -> DataFrame:
    """Identifier records from parts: systematic name, a standard name shared by copies, aliases."""
    key = F.col("p_partkey")
    return star.table("part").select(
        F.concat(F.lit("F"), key.cast("string")).alias("feature_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("systematic"),
        F.concat(F.lit("STD"), F.floor(key / 2).cast("string")).alias("standard"),
        F.concat(F.lit("al"), (key % 700).cast("string"), F.lit("|nick"), key.cast("string")).alias("aliases"),
    )


def raw_names(star: Star) -> DataFrame:
    """Names to map: systematic, standard (ambiguous), alias, alias shared by several, unknown."""
    key = F.col("p_partkey")
    text = (
        F.when(key % 5 == 0, F.concat(F.lit("p"), key.cast("string")))
        .when(key % 5 == 1, F.concat(F.lit("std"), F.floor(key / 2).cast("string")))
        .when(key % 5 == 2, F.concat(F.lit("NICK"), key.cast("string")))
        .when(key % 5 == 3, F.concat(F.lit("AL"), (key % 700).cast("string")))
        .otherwise(F.concat(F.lit("unknown"), key.cast("string")))
    )
    return star.table("part").select(text.alias("raw_name")).distinct()


view(
    "v_map",
    """
WITH f AS (SELECT 'F' || p_partkey AS id, 'P' || p_partkey AS sys, 'STD' || (p_partkey // 2) AS std, p_partkey AS k FROM part),
 n AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN 'std' || (p_partkey // 2) WHEN 2 THEN 'NICK' || p_partkey WHEN 3 THEN 'AL' || (p_partkey % 700) ELSE 'unknown' || p_partkey END AS raw_name FROM part),
 l AS (SELECT 0 AS r, lower(sys) AS key, id, sys FROM f UNION SELECT 1, lower(std), id, sys FROM f UNION SELECT 2, 'al' || (k % 700), id, sys FROM f UNION SELECT 2, 'nick' || k, id, sys FROM f),
 c AS (SELECT key, r, count(*) AS n, min(id) AS id, min(sys) AS sys FROM l GROUP BY 1, 2),
 b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY r) = 1)
SELECT raw_name, CASE WHEN r IS NULL THEN 'unresolved' ELSE CASE WHEN n > 1 THEN 'ambiguous_' ELSE '' END || ['systematic', 'standard', 'alias'][r + 1] END AS mapping_method,
  CASE WHEN n = 1 THEN sys ELSE '' END AS systematic_name, CASE WHEN n = 1 THEN id ELSE '' END AS feature_id
FROM n LEFT JOIN b ON b.key = lower(raw_name)
""",
)


def mapping_table(star: Star) -> DataFrame:
    table = feature_table(star)
    aliases = readers.explode_aliases(table).select("feature_id", "systematic", "alias")
    return graph.map_identifiers(raw_names(star), table, aliases)


@query("m01_identifier_mapping", "SELECT raw_name, mapping_method, systematic_name, feature_id FROM v_map")
def m01(star: Star) -> DataFrame:
    return mapping_table(star).select("raw_name", "mapping_method", "systematic_name", "feature_id")


@query("m02_edge_build", "SELECT src, dst, r6(weight) AS weight FROM v_edges")
def m02(star: Star) -> DataFrame:
    return edge_table(star).select("src", "dst", r6("weight").alias("weight"))


DEGREE_SQL = """
SELECT (SELECT count(*) FROM v_nodes) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, count(*) AS covered_nodes, r6(count(*) * 1.0 / (SELECT count(*) FROM v_nodes)) AS coverage,
  (SELECT count(*) FROM v_nodes) - count(*) AS isolated_nodes, r6(median(degree)) AS median_nonzero_degree, max(degree) AS max_degree FROM v_deg
"""


@query("m03_degree_statistics", DEGREE_SQL)
def m03(star: Star) -> DataFrame:
    return rounded(graph.degree_statistics(edge_table(star), node_table(star).agg(F.count(F.lit(1)))), [])


@query(
    "m04_connected_components",
    """
WITH RECURSIVE cc(node, label) AS (
  SELECT node, node FROM v_deg UNION SELECT e.b, cc.label FROM cc JOIN v_dir e ON e.a = cc.node WHERE cc.label < e.b)
SELECT max(n) AS largest_component, count(*) AS n_components FROM (SELECT label, count(*) AS n FROM (SELECT node, min(label) AS label FROM cc GROUP BY 1) GROUP BY 1)
""",
)
def m04(star: Star) -> DataFrame:
    return graph.largest_component(graph.connected_components(edge_table(star)))


view(
    "v_adj",
    """
WITH e AS (SELECT a, b, weight FROM v_dir UNION ALL SELECT node, node, 1.0 FROM v_nodes), d AS (SELECT a, sum(weight) AS d FROM e GROUP BY 1)
SELECT e.a AS r, e.b AS c, weight / sqrt(x.d * y.d) AS value FROM e JOIN d x ON x.a = e.a JOIN d y ON y.a = e.b
""",
)


@query("m05_normalised_adjacency", 'SELECT r AS "row", c AS col, r6(value) AS value FROM v_adj')
def m05(star: Star) -> DataFrame:
    edges = written(edge_table(star), "edges")
    out = graph.normalised_adjacency(edges, node_table(star))
    return out.select("row", "col", r6("value").alias("value"))


def node_signal(star: Star) -> DataFrame:
    """A value per order year and part node: the mean discount of its line items."""
    items = star.table("lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("period"), (F.col("l_partkey") * 2).alias("node")).agg(F.avg("l_discount").alias("value"))
    return items


view("v_sig", "SELECT CAST(year(l_shipdate) AS BIGINT) AS period, l_partkey * 2 AS node, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2")


@query("m06_propagation_hop", "SELECT period, r AS node, r6(sum(s.value * a.value)) AS value FROM v_sig s JOIN v_adj a ON a.c = s.node GROUP BY 1, 2")
def m06(star: Star) -> DataFrame:
    adjacency = graph.normalised_adjacency(written(edge_table(star), "edges"), node_table(star))
    out = graph.propagate(node_signal(star), adjacency, "period")
    return out.select("period", "node", r6("value").alias("value"))


@query(
    "m07_edge_smoothness",
    """
WITH s AS (SELECT period, r AS node, sum(s.value * a.value) AS x FROM v_sig s JOIN v_adj a ON a.c = s.node GROUP BY 1, 2)
SELECT a.period, count(*) AS n_edges, r6(avg(weight * (a.x - b.x) * (a.x - b.x))) AS smoothness FROM v_edges e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst AND b.period = a.period GROUP BY 1
""",
)
def m07(star: Star) -> DataFrame:
    edges = written(edge_table(star), "edges")
    signal = graph.propagate(node_signal(star), graph.normalised_adjacency(edges, node_table(star)), "period")
    return rounded(graph.edge_smoothness(written(signal, "signal"), edges, "period"), [])


@query(
    "m08_degree_preserving_rewire",
    "SELECT (SELECT count(*) FROM v_edges) AS n_edges, CAST(0 AS BIGINT) AS n_not_canonical, CAST(0 AS BIGINT) AS n_degree_changed, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS edge_count_change",
)
def m08(star: Star) -> DataFrame:
    edges = written(edge_table(star), "edges")
    return graph.rewiring_violations(edges, graph.rewire(edges, 7, swaps_per_edge=1))


def rewired_twin(star: Star) -> DataFrame:
    """The rewired graph with the original weights in random order, made once per application."""

    def build() -> DataFrame:
        edges = written(edge_table(star), "edges")
        return graph.permuted_weights(graph.rewire(edges, 7, swaps_per_edge=1), edges, 5)

    return star.stored("rewired-twin", build)


@query("m09_weight_permutation", "SELECT r6(weight) AS weight, count(*) AS n_edges, CAST(count(*) AS BIGINT) AS n_distinct_edges FROM v_edges GROUP BY 1")
def m09(star: Star) -> DataFrame:
    """Weights on the rewired edges: the same multiset as on the original ones, one per edge."""
    twin = rewired_twin(star)
    return twin.groupBy(r6("weight").alias("weight")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src", "dst").alias("n_distinct_edges"))


@query(
    "m09_permuted_ranks",
    """
WITH a AS (SELECT src, dst, row_number() OVER (ORDER BY md5('5-to|' || src || '-' || dst)) AS p FROM v_edges), b AS (SELECT weight, row_number() OVER (ORDER BY md5('5-from|' || src || '-' || dst)) AS p FROM v_edges)
SELECT src, dst, r6(weight) AS weight FROM a JOIN b USING (p)
""",
)
def m09_ranks(star: Star) -> DataFrame:
    """The permutation itself, on edges that SQL can name."""
    edges = written(edge_table(star), "edges")
    return graph.permuted_weights(edges.select("src", "dst"), edges, 5).select("src", "dst", r6("weight").alias("weight"))


_GRAPH_STATS = ["n_nodes", "n_edges", "covered_nodes", "max_degree"]
_GRAPH_SQL = f"SELECT {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _GRAPH_STATS)} FROM ({DEGREE_SQL})"


@query(
    "m10_graph_report",
    "SELECT 'mapping' AS section, mapping_method AS name, CAST(count(*) AS DOUBLE) AS value FROM v_map GROUP BY 2 "
    + " ".join(f"UNION ALL SELECT '{section}', name, value FROM ({_GRAPH_SQL}) UNPIVOT (value FOR name IN ({', '.join(_GRAPH_STATS)}))" for section in ("graph", "rewired")),
)
def m10(star: Star) -> DataFrame:
    """Mapping methods and the statistics of both graphs; rewiring keeps every degree."""
    report = graph.method_counts(mapping_table(star)).select(F.lit("mapping").alias("section"), F.col("mapping_method").alias("name"), F.col("n").cast("double").alias("value"))
    nodes = node_table(star).agg(F.count(F.lit(1)))
    for section, edges in (("graph", edge_table(star)), ("rewired", rewired_twin(star))):
        stats = graph.degree_statistics(edges, nodes)
        long = stats.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in _GRAPH_STATS])).alias("e"))
        report = report.unionByName(long.select(F.lit(section).alias("section"), "e.name", "e.value"))
    return report


# ------------------------------------------------------------------------ audits
@query(
    "n02_split_summary",
    """
SELECT s.split, count(*) AS n_rows, count(*) FILTER (WHERE kind = 'treatment') AS n_treatments, count(*) FILTER (WHERE kind = 'control') AS n_controls, count(*) FILTER (WHERE kind = 'quality_control') AS n_quality_controls,
  count(DISTINCT strain) AS n_strains, count(DISTINCT chemical) AS n_chemicals, array_to_string(list_sort(list(DISTINCT pert_time)), '|') AS times,
  r6(sum(n) / (count(*) * 7.0)) AS observed_fraction FROM v_samples s JOIN (SELECT sample_id, count(*) AS n FROM v_y GROUP BY 1) USING (sample_id) GROUP BY 1
""",
)
def n02(star: Star) -> DataFrame:
    return rounded(audit.split_summary(star.samples, star.log2), ["split", "times"])


FIELDS = ("strain", "chemical", "medium", "temperature", "pert_time", "data_source", "plate")


@query(
    "n03_level_audit",
    "SELECT split, field, count(*) AS n_levels, count(*) FILTER (WHERE seen) AS n_seen_in_train, coalesce(array_to_string(list_sort(list(level) FILTER (WHERE NOT seen)), '|'), '') AS unseen FROM ("
    "SELECT DISTINCT split, field, level, (field, level) IN (SELECT (field, level) FROM v_lev WHERE split = 'train') AS seen FROM v_lev) GROUP BY 1, 2",
)
def n03(star: Star) -> DataFrame:
    return audit.level_audit(star.samples, FIELDS)


view(
    "v_lev",
    "SELECT split, field, level FROM (SELECT split, strain, chemical, medium, temperature, CAST(pert_time AS VARCHAR) AS pert_time, data_source, plate FROM v_samples) UNPIVOT (level FOR field IN (strain, chemical, medium, temperature, pert_time, data_source, plate))",
)


@query(
    "n04_control_coverage",
    """
WITH c AS (SELECT 'train_only' AS pool, match_key, protein FROM v_tctrl UNION ALL SELECT 'all_rows', match_key, protein FROM v_ctrl),
 k AS (SELECT DISTINCT 'train_only' AS pool, match_key FROM v_train WHERE kind = 'control' UNION ALL SELECT DISTINCT 'all_rows', match_key FROM v_samples WHERE kind = 'control'),
 t AS (SELECT split, pool, count(*) AS n_treatments, count(k.match_key) AS n_matched FROM v_samples s CROSS JOIN (SELECT unnest(['train_only', 'all_rows']) AS pool) LEFT JOIN k USING (pool, match_key) WHERE kind = 'treatment' GROUP BY 1, 2),
 d AS (SELECT s.split, c.pool, count(*) AS n FROM v_y y JOIN v_samples s USING (sample_id) JOIN c ON c.match_key = s.match_key AND c.protein = y.protein WHERE s.kind = 'treatment' GROUP BY 1, 2)
SELECT split, pool, n_treatments, n_matched, coalesce(n, 0) AS n_delta_cells, r6(n_matched * 1.0 / n_treatments) AS matched_fraction FROM t LEFT JOIN d USING (split, pool)
""",
)
def n04(star: Star) -> DataFrame:
    table = audit.control_coverage(star.samples, star.log2, {"train_only": star.train, "all_rows": None})
    return rounded(table, ["split", "pool"])


@query(
    "n05_context_overlap",
    """
SELECT split, count(*) AS n_rows, r6(avg(CASE WHEN (strain, medium, temperature, pert_time) IN (SELECT (strain, medium, temperature, pert_time) FROM v_train) THEN 1.0 ELSE 0.0 END)) AS biology_seen_fraction,
  r6(avg(CASE WHEN (data_source, instrument, plate) IN (SELECT (data_source, instrument, plate) FROM v_train) THEN 1.0 ELSE 0.0 END)) AS observation_seen_fraction FROM v_samples GROUP BY 1
""",
)
def n05(star: Star) -> DataFrame:
    tuples = {"biology": ["strain", "medium", "temperature", "pert_time"], "observation": ["data_source", "instrument", "plate"]}
    return rounded(audit.context_overlap(star.samples, tuples), ["split"])


@query(
    "n07_protein_retention_audit",
    """
WITH r AS (SELECT protein, 1 - count(*) FILTER (WHERE split = 'train') * 1.0 / (SELECT count(*) FROM v_train) AS rate FROM v_cells JOIN v_samples USING (sample_id) GROUP BY 1)
SELECT rate < 0.555 AS kept, count(*) AS n_proteins, r6(min(rate)) AS rate_min, r6(median(rate)) AS rate_median, r6(max(rate)) AS rate_max FROM r GROUP BY 1
""",
)
def n07(star: Star) -> DataFrame:
    return rounded(audit.retention_audit(Study(star).raw_rates, 0.555), ["kept"])


@query(
    "n10_feature_artifact_checks",
    "SELECT count(*) AS n_values, CAST(0 AS BIGINT) AS n_non_finite, CAST(0 AS BIGINT) AS n_key_mismatch, CAST(3 AS BIGINT) AS n_not_donor_value, CAST(0 AS BIGINT) AS n_fixed_points FROM v_cfeat",
)
def n10(star: Star) -> DataFrame:
    real = chemical_features(star)
    mapping = shifted_donor(real.select("chemical").distinct(), "chemical", 991)
    shuffled = features.deranged_groups(real, "chemical", 991).select("chemical", "feature", "value")
    # Three values of one entity are spoiled to show that the check finds them.
    spoiled = shuffled.withColumn("value", F.when(F.col("chemical") == "Brand#9", F.col("value") + 1).otherwise(F.col("value")))
    return audit.artifact_checks(real, spoiled, mapping, "chemical")


@query(
    "n11_replay_comparison",
    "SELECT count(*) AS n_compared, CAST(0 AS BIGINT) AS n_unpaired, r6(0.00001) AS max_abs_diff, r6(avg(CASE WHEN sample_id % 100 = 7 THEN 0.00001 ELSE 0.000001 END)) AS mean_abs_diff, count(*) FILTER (WHERE sample_id % 100 = 7) AS n_above_tolerance FROM v_abs",
)
def n11(star: Star) -> DataFrame:
    rows = Study(star).absolute.select("sample_id", "protein", F.col("m2").alias("value"))
    # A replay that drifts by a known amount, more for some samples.
    replay = rows.withColumn("value", F.col("value") + F.when(F.col("sample_id") % 100 == 7, 1e-5).otherwise(1e-6))
    return rounded(audit.replay_comparison(rows, replay), [])
