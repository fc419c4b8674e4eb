"""End-to-end scorer, fold isolation and registered queries on the smallest dataset."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows_of
from cellshift.operators import controls, prepare
from cellshift.plans.scorer import score_files
from tests.conftest import SF

META = (
    "sample_id string, data_source string, strain string, medium string, temperature string, pert_time double, pert_time_unit string, "
    "pert_id string, chemical string, instrument string, plate string, well string, split string, strain_role string, chemical_role string"
)


def _meta(name, chemical, split, key="a"):
    return (name, "D1", "S1", "M1", "30", 15.0, "min", f"#{name}", chemical, "I1", f"P{key}", "A1", split, "train", "train")


def test_perfect_prediction_scores_one_hundred(spark):
    control = [10.0, 11.0, 12.0]
    proteins = ["P1", "P2", "P3"]
    train = [_meta("c0", "Water", "train"), _meta("t1", "DrugA", "train"), _meta("t2", "DrugB", "train")]
    deltas = {"t1": (1.0, -1.0, 0.5), "t2": (-0.5, 1.0, -1.0)}
    train_cells = [("c0", p, 2.0**v) for p, v in zip(proteins, control)]
    train_cells += [(s, p, 2.0 ** (c + d)) for s, ds in deltas.items() for p, c, d in zip(proteins, control, ds)]
    splits = {"test_chem_only": (2, -2, 3), "test_strain_only": (3, -2, 2), "test_both": (2, -3, 4), "test_time": (4, -2, 3)}
    test, truth = [], []
    for split, ds in splits.items():
        test += [_meta(f"w_{split}", "Water", split), _meta(f"d_{split}", "DrugA", split)]
        truth += [(f"w_{split}", p, 2.0**c) for p, c in zip(proteins, control)]
        truth += [(f"d_{split}", p, 2.0 ** (c + d)) for p, c, d in zip(proteins, control, ds)]
    frame = lambda rows: spark.createDataFrame(rows, "sample_id string, protein string, value double")
    truth_frame = frame(truth)
    preds = truth_frame.withColumn("value", F.log2("value"))
    overall, by_split, score = score_files(truth_frame, preds, spark.createDataFrame(test, META), spark.createDataFrame(train, META), frame(train_cells))
    row = overall.first()
    assert round(row["fc_pcc"], 9) == 1.0 and round(row["absolute_sample_r2_median"], 9) == 1.0
    assert by_split.count() == 4 and round(score.first()["score"], 6) == 100.0


# Standalone statement of the anchor: written from the tables with the engine's own corr(), sharing no view.
ANCHOR = """
WITH f AS (SELECT l_orderkey k, min(l_partkey) p FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey k, o_custkey % 2 d, r_name st, p_brand ch, c_mktsegment m, o_orderstatus te, year(o_orderdate) y FROM orders JOIN f ON f.k = o_orderkey
  JOIN part ON p_partkey = p JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT *, CASE WHEN ch IN ('Brand#1', 'Brand#2') THEN 'c' WHEN ch = 'Brand#3' THEN 'q' ELSE 't' END kind FROM s),
u AS (SELECT *, CASE WHEN y >= 2001 THEN 'val_time' WHEN ch IN ('Brand#4', 'Brand#5') AND st = 'ASIA' THEN 'val_both' WHEN ch IN ('Brand#4', 'Brand#5') THEN 'val_chem_only'
  WHEN st = 'ASIA' AND kind = 't' THEN 'val_strain_only' ELSE 'train' END sp FROM t),
c AS (SELECT l_orderkey k, l_linenumber l, log2(avg(l_extendedprice)) v FROM lineitem GROUP BY 1, 2),
pm AS (SELECT l, avg(v) pm FROM c JOIN u USING (k) WHERE sp = 'train' GROUP BY 1),
ct AS (SELECT d, st, m, te, y, l, avg(v) w FROM c JOIN u USING (k) WHERE kind = 'c' GROUP BY ALL)
SELECT sp, count(*), corr(pm - w, v - w) FROM c JOIN u USING (k) JOIN pm USING (l) JOIN ct USING (d, st, m, te, y, l) WHERE kind = 't' GROUP BY 1
"""


def test_anchor_scores(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = {name: (n, round(value, 6)) for name, n, value in con.execute(ANCHOR).fetchall()}
    got = {r["split"]: (r["n_cells"], r["fc_pcc"]) for r in entry.queries()["d09_fold_change_pcc"](spark, folder).collect()}
    assert got == want


def test_entry_has_a_stable_schema(spark):
    frame = entry.entry(spark)
    assert "fc_pcc" in frame.columns and frame.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name", ["c01_exact_control", "d15_response_report_by_split", "f09_holdout_r11", "g08_route_audit", "i14_grid_scoring", "k03_paired_cluster_bootstrap", "m01_identifier_mapping", "n04_control_coverage"]
)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


def test_controls_pool_is_respected(spark, small):
    samples, cells = small
    y = prepare.log2_cells(cells)
    empty_pool = samples.filter("sample_id = 'tr_a'")
    assert controls.control_means(samples, y, empty_pool).count() == 0


@pytest.mark.parametrize("name", ["h10_target_scale", "h11_standardised_cells", "h12_standardised_fold_changes"])
def test_scales_fit_every_protein(spark, name):
    test_queries_match_sql(spark, name)
    if name.startswith("h10"):
        found = {r["protein"]: r for r in entry.queries()[name](spark, SF).collect()}
        assert all(r["target_mean"] != 0 for r in found.values()) and "L7" in found


def test_every_required_axis_and_comparison_gates(spark):
    from cellshift.operators import selection
    from cellshift.plans import queries_decisions as decisions

    needed = selection.expected_checks(spark, decisions.GATE_AXES, decisions.GATE_RESIDUALS)
    shown = needed.filter("cluster_axis <> 'plate'").withColumn("passed", F.lit(True))
    promoted = lambda primary, negative: {r["scenario"] for r in decisions.gated_comparisons({"primary": primary, "negative_control": negative}).collect() if r["promoted"]}
    assert promoted(shown, shown) == {"val_chem_only", "val_strain_only", "val_both"}
    failed = shown.withColumn("passed", ~((F.col("scenario") == "val_both") & (F.col("cluster_axis") == "chemical")))
    assert promoted(failed, shown) == promoted(shown, failed) == {"val_chem_only", "val_strain_only"}
    assert promoted(shown.filter("cluster_axis = 'strain'"), shown) == {"val_strain_only"}


def test_gated_comparisons_match_sql(spark):
    test_queries_match_sql(spark, "l10_multi_comparison_verdict")
