"""Operators against hand values and plain numpy on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellshift.functions.moments import moment_aggs, pearson_agg, pearson_from_moments, r2_agg
from cellshift.functions.text import entity_key, plain_name, row_kind, slug, text_flag
from cellshift.operators import checks, controls, folds, inference, metrics, predict, prepare, priors, quantiles
from cellshift.operators.fingerprints import table_fingerprint
from cellshift.operators.quantiles import exact_quantile
from cellshift.operators.ranking import best_per_group, hash_rank, shifted_donor
from cellshift.sources import readers


def test_names_and_kinds(spark):
    rows = spark.createDataFrame([(" Water\t",), ("dmso",), ("Quality Control",), ("DrugA",)], "c string")
    assert [r[0] for r in rows.select(row_kind("c")).collect()] == ["control", "control", "quality_control", "treatment"]
    assert [r[0] for r in rows.select(plain_name("c")).collect()][0] == "water"


def test_entity_key_is_compatibility_normalised(spark):
    rows = spark.createDataFrame([("ＤｒｕｇＡ　ｘ",), ("  Straße \t B ",), ("Drug  A",), (None,)], "c string")
    assert [r[0] for r in rows.select(entity_key("c")).collect()] == ["druga x", "strasse b", "drug a", ""]


def test_flags_and_slugs(spark):
    rows = spark.createDataFrame([("Yes",), ("0",), ("",), ("maybe",)], "c string")
    assert [r[0] for r in rows.select(text_flag("c")).collect()] == [True, False, False, None]
    assert spark.range(1).select(slug(F.lit(" A--b (c) ")), slug(F.lit("??"))).first()[:] == ("a_b_c", "unknown")


def test_missingness_filter_and_log2(spark, small):
    samples, cells = small
    train = samples.filter("split = 'train'")
    rates = {r["protein"]: r["missing_rate"] for r in prepare.missing_rates(cells, train).collect()}
    assert rates["P1"] == 0 and rates["P3"] == 1.0
    kept = prepare.kept_proteins(prepare.missing_rates(cells, train), 0.80)
    y = {(r[0], r[1]): r[2] for r in prepare.log2_cells(cells, kept).collect()}
    assert y[("tr_ctrl", "P1")] == 3.0 and {p for _, p in y} == {"P1", "P2"}


def test_exact_control_and_response_split(spark, small):
    samples, cells = small
    y = prepare.log2_cells(cells)
    flags = {r["sample_id"]: r["has_exact_match"] for r in controls.match_flags(samples, samples).collect()}
    assert flags["tr_a"] and flags["val_chem"] and not flags["tr_b"]
    found = controls.exact_control(samples, y, samples.filter("sample_id = 'tr_a'")).collect()
    assert [(r["protein"], r["control"]) for r in found] == [("P1", 3.0)]
    deltas = controls.truth_deltas(samples, y, controls.control_means(samples, y))
    assert {r["split"] for r in deltas.filter("split <> 'train'").select("split").collect()} == {"val_chem_only"}


def test_missing_key_fields_match_each_other(spark):
    from cellshift.functions.text import composite_key

    rows = spark.createDataFrame([("a", None), ("a", None)], "x string, y string").select(composite_key(["x", "y"]).alias("k"))
    assert rows.distinct().count() == 1 and rows.first()[0] == "a\x1fnan"


def test_pearson_forms_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(17, 2, 400)
    y = 0.4 * x + rng.normal(0, 1, 400)
    rows = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    direct = {r["g"]: r["v"] for r in rows.groupBy("g").agg(pearson_agg("x", "y").alias("v")).collect()}
    stored = {r["g"]: r["v"] for r in rows.groupBy("g").agg(*moment_aggs("x", "y")).select("g", pearson_from_moments().alias("v")).collect()}
    for g in (0, 1):
        want = np.corrcoef(x[g::2], y[g::2])[0, 1]
        assert math.isclose(direct[g], want, rel_tol=1e-9) and math.isclose(stored[g], want, rel_tol=1e-7)


def test_undefined_scores_are_null(spark):
    rows = spark.createDataFrame([("const", 0.1, 1.0), ("const", 0.1, 2.0), ("const", 0.1, 4.0), ("one", 1.0, 2.0)], "g string, x double, y double")
    out = {r["g"]: (r["p"], r["r"]) for r in rows.groupBy("g").agg(pearson_agg("x", "y").alias("p"), r2_agg("x", "y").alias("r")).collect()}
    assert out["const"][0] is None and out["const"][1] is not None and out["one"] == (None, None)


@pytest.mark.parametrize("q", [0.0, 0.025, 0.25, 0.5, 0.975, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    random.seed(7)
    data = [(g, round(random.gauss(0, 1), 2)) for g in ("a", "b") for _ in range(11 if g == "a" else 30_000)]
    rows = spark.createDataFrame(data, "g string, v double")
    # A small sketch forces the bracket path for the large group.
    out = {r["g"]: r["quantile"] for r in exact_quantile(rows, ["g"], "v", q, accuracy=100).collect()}
    for g in ("a", "b"):
        assert math.isclose(out[g], np.quantile([v for k, v in data if k == g], q), abs_tol=1e-12)


def test_hash_rank_is_a_permutation_in_digest_order(spark):
    import hashlib

    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = {(r["g"], r["rank"]): r["k"] for r in hash_rank(rows, "k", "s", by=["g"], bucket_digits=1).collect()}
    for g in range(3):
        order = sorted(range(g, 300, 3), key=lambda k: hashlib.md5(f"s|{k}".encode()).hexdigest())
        assert [got[(g, i + 1)] for i in range(100)] == order


def test_shifted_donor_is_a_derangement(spark):
    pairs = shifted_donor(spark.range(40).select(F.col("id").alias("k")), "k", 1, 3).collect()
    assert len(pairs) == 40 and {r["donor"] for r in pairs} == set(range(40)) and all(r["donor"] != r["recipient"] for r in pairs)


def test_best_per_group_breaks_ties(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("a", None, 0), ("b", 0.5, 3)], "g string, s double, t int")
    assert {r["g"]: r["t"] for r in best_per_group(rows, ["g"], [("s", True), ("t", False)]).collect()} == {"a": 1, "b": 3}


def test_leave_one_out_covers_unobserved_cells(spark):
    rows = spark.createDataFrame([("r1", "S", "P", 1.0), ("r2", "S", "P", 3.0), ("r3", "S", "P", None), ("r4", "T", "P", 8.0)], "sample_id string, strain string, protein string, y double")
    out = {r["sample_id"]: (r["o"], r["g"]) for r in priors.leave_one_out_means(rows, "y", "strain", "o", "g").collect()}
    assert out["r1"] == (3.0, 5.5) and out["r3"] == (2.0, 4.0) and out["r4"] == (2.0, 2.0)


def _greedy(sizes, k):
    loads = [0] * k
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


def test_greedy_folds_match_sequential_walk(spark):
    random.seed(1)
    sizes = [random.choice([1, 1, 1, 2, 3, 3, 7, 20]) for _ in range(120)]
    rows = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
    out = folds.greedy_group_folds(rows, "g", 4, 9).collect()
    loads = [sum(r["n"] for r in out if r["fold"] == f) for f in range(4)]
    assert len(out) == len(sizes) and sorted(loads) == sorted(_greedy(sizes, 4))


def test_deal_equal_groups_matches_walk():
    random.seed(5)
    for _ in range(300):
        loads = [random.randint(0, 30) for _ in range(4)]
        size, groups = random.randint(1, 9), random.randint(0, 25)
        walk, counts = list(loads), [0] * 4
        for _ in range(groups):
            f = walk.index(min(walk))
            walk[f] += size
            counts[f] += 1
        assert folds.deal_equal_groups(loads, size, groups) == counts


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = spark.createDataFrame([(i, f"v{i % 5}") for i in range(200)], "a int, b string")
    base = table_fingerprint(rows).first()["fingerprint"]
    assert table_fingerprint(rows.orderBy(F.desc("a")).repartition(3)).first()["fingerprint"] == base
    assert table_fingerprint(rows.withColumn("b", F.when(F.col("a") == 7, "x").otherwise(F.col("b")))).first()["fingerprint"] != base
    assert table_fingerprint(rows.union(rows.limit(1))).first()["fingerprint"] != base


def test_linear_grid_equals_direct_scoring(spark):
    rng = np.random.default_rng(0)
    data = [("s", float(a), float(b), float(t), float(c), None) for a, b, t, c in rng.normal(0, 1.2, (500, 4))]
    rows = spark.createDataFrame(data, "g string, a double, b double, truth_delta double, context_ref double, drug_ref double")
    options = [{"w": w, "a": 1 - w, "b": w} for w in (0.0, 0.3, 1.0)]
    grid = {r["w"]: r for r in predict.linear_candidate_scores(rows, ["g"], ["a", "b"], options, {"w": "double"}).collect()}
    for item in options:
        cells = rows.withColumn("pred_delta", F.col("a") * item["a"] + F.col("b") * item["b"]).withColumn("sample_id", F.lit("x"))
        want = metrics.response_report(cells, ["g"]).first()
        for name in ("fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1"):
            assert math.isclose(grid[item["w"]][name], want[name], rel_tol=1e-9)
        assert grid[item["w"]]["drug_residual_pcc"] is None


def test_cluster_bootstrap_point_value_equals_direct(spark):
    rng = np.random.default_rng(2)
    data = [(f"c{i % 6}", i % 2, float(t), float(t + e), float(t + 2 * e)) for i, (t, e) in enumerate(rng.normal(0, 1, (240, 2)))]
    rows = spark.createDataFrame(data, "cluster string, fold int, truth_delta double, good double, bad double").withColumn("context_ref", F.lit(0.1)).withColumn("drug_ref", F.lit(None).cast("double"))
    both = rows.withColumn("_m", F.explode(F.array(F.struct(F.lit("good").alias("model"), F.col("good").alias("pred_delta")), F.struct(F.lit("bad").alias("model"), F.col("bad").alias("pred_delta"))))).select("*", "_m.*")
    stats = inference.cluster_statistics(both, ["model", "cluster", "fold"])
    out = {r["metric"]: r for r in inference.cluster_bootstrap(stats, "cluster", "good", "bad", draws=60).collect()}
    arr = np.array([d[1:] for d in data])
    want = np.mean([np.corrcoef(arr[arr[:, 0] == f][:, 2], arr[arr[:, 0] == f][:, 1])[0, 1] - np.corrcoef(arr[arr[:, 0] == f][:, 3], arr[arr[:, 0] == f][:, 1])[0, 1] for f in (0, 1)])
    assert math.isclose(out["fc_pcc"]["mean_delta"], want, rel_tol=1e-9)
    assert out["fc_pcc"]["ci_low"] <= out["fc_pcc"]["mean_delta"] <= out["fc_pcc"]["ci_high"] and out["fc_pcc"]["n_clusters"] == 6


def test_split_null_keeps_margins_and_agrees_with_the_rank_null(spark):
    rng = np.random.default_rng(4)
    data = [(i, f"p{rng.integers(6)}", f"t{rng.integers(3)}", "same") for i in range(600)]
    rows = spark.createDataFrame(data, "id int, plate string, strain string, one string")
    counts = inference.contingency(rows, "plate", ["strain", "one"]).cache()
    drawn = inference.split_contingency(counts, 150).cache()
    for level in ("u", "v"):
        want = {(r["target"], r[level], r["n"]) for r in counts.groupBy("target", level).agg(F.sum("n").alias("n")).collect()}
        got = drawn.groupBy("draw", "target", level).agg(F.sum("n").alias("n")).groupBy("target", level, "n").count().collect()
        assert {(r["target"], r[level], r["n"]) for r in got} == want and {r["count"] for r in got} == {150}
    value = "normalized_mutual_information"
    splits = inference.associations(drawn, ["draw", "target"]).filter("target = 'strain'").toPandas()[value]
    ranks = inference.associations(inference.permuted_contingency(rows, "id", "plate", ["strain"], 150, 1), ["draw", "target"]).toPandas()[value]
    error = 4 * math.hypot(splits.std(), ranks.std()) / math.sqrt(150)
    assert abs(splits.mean() - ranks.mean()) < error and abs(splits.quantile(0.95) - ranks.quantile(0.95)) < 3 * error
    exact = {r["target"]: r["expected_nmi"] for r in inference.expected_association(counts).collect()}
    assert abs(splits.mean() - exact["strain"]) < 4 * splits.std() / math.sqrt(150)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, inference.split_contingency(counts.repartition(3), 150).collect()))


def test_checks_reject(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "sample_id string")
    bad = checks.key_violations(rows, "sample_id")
    assert {(r["issue"], r["n_rows"]) for r in bad.collect()} == {("duplicate_key", 2), ("null_key", 1)}
    with pytest.raises(checks.ContractError):
        checks.require_empty(bad, "ids")
    with pytest.raises(checks.ContractError):
        checks.require_columns(rows)


def test_route_weights_are_validated(spark):
    rows = spark.createDataFrame([("R10", 1.0, 2.0)], "r string, a double, b double")
    with pytest.raises(ValueError):
        predict.route_rows(rows, {"R10": (1.5, {"b": 1.0})}, "r", "a")
    with pytest.raises(ValueError):
        predict.route_rows(rows, {"R10": (0.5, {"b": 0.7})}, "r", "a")
    assert predict.route_rows(rows, {"R10": (0.5, {"b": 1.0})}, "r", "a").first()["final"] == 1.5


def test_headers_cost_one_chunk_of_each_file(spark, tmp_path):
    import gzip

    wide = "x" * 100
    (tmp_path / "a.csv").write_text('"b, c",a\n' + f"1,{wide}\n" * 20_000)
    (tmp_path / "b.csv").write_text("a,d\r\n1,2\r\n")
    (tmp_path / "c.csv").write_text("")
    with gzip.open(tmp_path / "d.csv.gz", "wt") as out:
        out.write("a,d\n3,4\n")
    found = {r["path"].rpartition("/")[2]: r for r in readers.file_headers(spark, str(tmp_path)).collect()}
    assert {name: r["header"] for name, r in found.items()} == {"a.csv": '"b, c",a', "b.csv": "a,d", "d.csv.gz": "a,d"}
    assert found["a.csv"]["taken"] <= readers.HEADER_CHUNK < (tmp_path / "a.csv").stat().st_size
    groups = readers.header_groups(spark, str(tmp_path))
    assert [(names, len(files)) for names, files in groups] == [(["b, c", "a"], 1), (["a", "d"], 2)]


def test_merged_quantile_states_keep_their_rank_error(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"g{i % 2}", i % 7, float(v)) for i, v in enumerate(rng.lognormal(size=20_000))] + [("g0", 0, None)], "g string, part int, v double")
    states = rows.groupBy("g", "part").agg(quantiles.quantile_state("v").alias("state"))
    for q in (0.1, 0.5, 0.95):
        running = quantiles.merged_state(states, ["g"]).select("g", quantiles.state_quantile("state", q).alias("e"))
        found = quantiles.rank_errors(rows, ["g"], "v", running, "e", q).collect()
        assert {r["g"]: r["n"] for r in found} == {"g0": 10_000, "g1": 10_000} and all(r["error"] <= quantiles.RANK_ERROR for r in found)
