"""Graph tables, features, decisions and streaming."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellshift.operators import features, graph, selection, spectral
from cellshift.streaming import metric_processor
from cellshift.streaming.running_metrics import latest_state, metric_state, run_to_completion, state_scores


def test_edges_from_scored_names(spark):
    links = spark.createDataFrame([("x.A", "x.B", 800), ("x.B", "x.A", 500), ("x.A", "x.C", 300), ("x.A", "x.A", 900)], "protein1 string, protein2 string, combined_score bigint")
    nodes = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "name string, node int")
    edges = graph.build_edges(links, nodes, 400).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in edges] == [(0, 1, 0.8)]


def test_components_match_union_find(spark):
    random.seed(3)
    pairs = {tuple(sorted(random.sample(range(120), 2))) for _ in range(90)} | {(i, i + 1) for i in range(200, 260)}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: min(m for m in parent if find(m) == find(n)) for n in parent}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == want


def test_rewiring_keeps_degrees(spark):
    random.seed(5)
    pairs = sorted({tuple(sorted(random.sample(range(60), 2))) for _ in range(150)})
    edges = spark.createDataFrame(pairs, "src int, dst int")
    moved = graph.rewire(edges, 3, 1)
    row = graph.rewiring_violations(edges, moved).first()
    assert row["n_degree_changed"] == 0 and row["n_repeated"] == 0 and row["n_not_canonical"] == 0 and row["edge_count_change"] == 0
    assert {(r[0], r[1]) for r in moved.collect()} != set(pairs)


def test_classical_mds_recovers_distances(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(6, 2))
    rows = [(i, j, float(np.linalg.norm(points[i] - points[j]))) for i in range(6) for j in range(6)]
    out = features.classical_mds(spark.createDataFrame(rows, "i int, j int, d double"), 2).collect()
    found = np.zeros((6, 2))
    for r in out:
        found[r["entity"], r["dimension"]] = r["coordinate"]
    for i, j, d in rows:
        assert math.isclose(np.linalg.norm(found[i] - found[j]), d, abs_tol=1e-6)


def _reference_mds(d, dimensions):
    """The reference's full spectrum, padded with zeros."""
    q = d**2
    values, vectors = np.linalg.eigh(-0.5 * (q - q.mean(1, keepdims=True) - q.mean(0, keepdims=True) + q.mean()))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = np.zeros((len(d), dimensions))
    for k in range(min(dimensions, int((values > max(values[0] * 1e-12, 1e-12)).sum()))):
        v = vectors[:, k]
        out[:, k] = v * np.sign(v[np.abs(v).argmax()]) * np.sqrt(values[k])
    return out


def test_classical_mds_takes_all_positive_dimensions(spark):
    rng = np.random.default_rng(4)
    # Random distances have large negative eigenvalues before the fifth positive one; three entities have two dimensions at most.
    wide = np.triu(rng.uniform(0.1, 10, size=(12, 12)), 1)
    wide = wide + wide.T
    points = rng.normal(size=(3, 2))
    few = np.array([[np.linalg.norm(a - b) for b in points] for a in points])
    for d, dimensions in ((wide, 5), (few, 5)):
        n = len(d)
        rows = [(i, j, float(d[i, j])) for i in range(n) for j in range(n)]
        found = np.full((n, dimensions), np.nan)
        for r in features.classical_mds(spark.createDataFrame(rows, "i int, j int, d double"), dimensions).collect():
            found[r["entity"], r["dimension"]] = r["coordinate"]
        assert np.allclose(found, _reference_mds(d, dimensions), atol=1e-6)


def _responses(spark, matrix):
    rows = [(i, f"P{j:05d}", float(v)) for (i, j), v in np.ndenumerate(matrix)]
    return spark.createDataFrame(rows, "sample_id int, protein string, truth_delta double")


def test_response_basis_equals_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 5)) + 0.01 * rng.normal(size=(40, 5))
    basis = features.response_basis(_responses(spark, matrix), 7).collect()
    _, singular, right = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    want = singular**2 / (singular**2).sum()
    for k in range(7):
        own = sorted((r["protein"], r["loading"], r["energy"]) for r in basis if r["component"] == k)
        loadings = np.array([x for _, x, _ in own])
        # Ranks beyond the data's own are zero.
        v = right[k] * np.sign(right[k][abs(right[k]).argmax()]) if k < 5 else np.zeros(5)
        assert np.allclose(loadings, v, atol=1e-6) and math.isclose(own[0][2], want[k] if k < 5 else 0.0, rel_tol=1e-6)


def test_response_basis_of_many_proteins_brings_only_small_products_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(40, 4)) * [9, 6, 4, 1] @ rng.normal(size=(4, 5000)) + 0.05 * rng.normal(size=(40, 5000))
    frame = pd.DataFrame({"sample_id": np.repeat(np.arange(40), 5000), "protein": np.tile([f"P{j:05d}" for j in range(5000)], 40), "truth_delta": matrix.ravel()})
    deltas = spark.createDataFrame(frame)
    seen = []
    collect = type(deltas).collect
    monkeypatch.setattr(type(deltas), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    basis = features.response_basis(deltas, 3)
    monkeypatch.undo()
    assert max(map(len, seen)) == 3 * (3 + spectral.OVERSAMPLE) ** 2
    singular = np.linalg.svd(matrix - matrix.mean(axis=0), compute_uv=False)
    energies = sorted({(r["component"], r["energy"], r["residual"]) for r in basis.select("component", "energy", "residual").collect()})
    assert np.allclose([e for _, e, _ in energies], (singular**2 / (singular**2).sum())[:3], rtol=1e-6) and all(r <= 1e-6 for _, _, r in energies)
    assert basis.count() == 15_000


def test_hash_features_are_md5_bytes(spark):
    import hashlib

    got = spark.range(1).select(features.hash_features(F.lit("DrugA"), 20)).first()[0]
    raw = hashlib.md5(b"DrugA|0").digest() + hashlib.md5(b"DrugA|1").digest()
    assert np.allclose(got, [b / 255 for b in raw[:20]])


def _promotion_rows(spark, **changes):
    base = {"scenario": "R10", "cluster_axis": "chemical", "n_units": 8, "mean_delta": 0.02, "ci_low": 0.01, "all_seeds_positive": True, "min_seed_mean": 0.005}
    rows = [{**base, "metric": m} for m in ("fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1")]
    for row in rows:
        row.update(changes.get(row["metric"], {}))
    return spark.createDataFrame(rows)


def test_every_promotion_guard_blocks_alone(spark):
    verdict = lambda rows: selection.promotion_verdict(selection.promotion_checks(rows), ["scenario"]).first()
    assert verdict(_promotion_rows(spark))["promoted"] is True
    for metric, change in (
        ("fc_pcc", {"mean_delta": 0.009}),
        ("fc_pcc", {"ci_low": -0.001}),
        ("fc_pcc", {"all_seeds_positive": False}),
        ("context_residual_pcc", {"mean_delta": 0.0}),
        ("high_effect_pcc", {"mean_delta": -0.006}),
        ("high_effect_f1", {"min_seed_mean": -0.006}),
    ):
        row = verdict(_promotion_rows(spark, **{metric: change}))
        assert row["promoted"] is False and metric in row["reasons"]


def test_scale_selection_guards(spark):
    rows = [
        (0.0, 0.50, 0.10, 0.1, 0.60, 0.20),
        (0.5, 0.55, 0.09, 0.1, 0.60, 0.20),
        (1.0, 0.52, 0.10, 0.1, 0.597, 0.197),
    ]
    grid = spark.createDataFrame([("R10", *r) for r in rows], "scenario string, strain_scale double, fc_pcc double, context_residual_pcc double, drug_residual_pcc double, high_effect_pcc double, high_effect_f1 double")
    out = {r["strain_scale"]: r for r in selection.select_scales(grid, ["scenario"], ("context_residual_pcc",), scales=("strain_scale",)).collect()}
    assert not out[0.5]["guardrail_pass"] and out[1.0]["selected"] and not out[0.0]["selected"]


def test_stream_state_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"k{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 2, (300, 2)))], "k string, p double, t double")
    source = str(tmp_path / "in")
    rows.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = run_to_completion(metric_state(stream, "k", "p", "t"), "test-state")
    got = {r["k"]: r for r in state_scores(latest_state(spark, folder), "k").collect()}
    want = {r["k"]: r for r in state_scores(metric_state(rows, "k", "p", "t"), "k").collect()}
    assert len(spark.read.parquet(folder).select("batch").distinct().collect()) >= 5
    for key in want:
        assert got[key]["n"] == want[key]["n"] and math.isclose(got[key]["pcc"], want[key]["pcc"], rel_tol=1e-9)


def test_stateful_processor_survives_a_failed_batch_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(f"k{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 2, (300, 2)))] + [("k9", None, 1.0)], "key string, prediction double, truth double")
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "progress")
    rows.repartition(5).write.parquet(source)
    stream = lambda: metric_processor.metric_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), 1.0)

    def fail(frame, batch):
        if batch == 2:
            raise RuntimeError("lost in batch 2")

    with pytest.raises(Exception, match="lost in batch 2"):
        metric_processor.advance(stream(), checkpoint, fail)
    assert metric_processor.advance(stream(), checkpoint) == [2, 3, 4]
    rows.limit(0).union(spark.createDataFrame([("k0", 5.0, 5.0)], rows.schema)).coalesce(1).write.mode("append").parquet(source)
    assert metric_processor.advance(stream(), checkpoint) == [5]
    whole = rows.union(spark.createDataFrame([("k0", 5.0, 5.0)], rows.schema))
    want = {r["key"]: r for r in metric_state(whole, "key", "prediction", "truth").collect()}
    got = {r["key"]: r for r in metric_processor.stored_state(spark, checkpoint).collect()}
    assert set(got) == set(want)
    for key in want:
        for name in metric_processor.FIELDS:
            assert math.isclose(got[key][name], want[key][name], rel_tol=1e-9, abs_tol=1e-9), (key, name)


def test_pruned_centres_equal_the_full_product_and_look_at_few(spark):
    rng = np.random.default_rng(5)
    hubs = rng.normal(0, 10, (12, 3))
    points = [(i, [float(x) for x in hubs[i % 12] + rng.normal(0, 0.5, 3)]) for i in range(400)]
    rows = spark.createDataFrame(points[100:], "row int, v array<double>")
    # A repeated centre makes ties.
    centres = spark.createDataFrame([*points[:100], (500, points[3][1])], "c int, v array<double>")
    full = features.centre_distances(rows, "row", "v", centres, "c", "v").cache()
    index, pivots = features.pivot_index(centres, "c", "v")
    near = features.centres_within(rows, "row", "v", index, pivots).cache()
    assert sorted(map(tuple, features.nearest_centre(near, "row").collect())) == sorted(map(tuple, features.nearest_centre(full, "row").collect()))
    assert near.count() < 0.2 * full.count()
    width = spark.createDataFrame([(1.5,)], "bandwidth double")
    want = features.rbf_kernel(full, width).filter("value >= 0.1").select("row", "centre").collect()
    got = features.truncated_kernel(rows, "row", "v", index, pivots, width, 0.1).select("row", "centre").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
