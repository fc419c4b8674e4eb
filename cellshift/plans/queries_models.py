"""Registered queries: prediction algebra, routing and grid scoring (group I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import r6
from cellshift.operators import controls, metrics, predict, prepare
from cellshift.operators.grids import dense_grid, literal_rows
from cellshift.plans.queries_entities import audited
from cellshift.plans.queries_metrics import rounded
from cellshift.plans.registry import query, view
from cellshift.plans.sqltext import pcc, response
from cellshift.plans.study import Study
from cellshift.sources.star import Star

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
MEMBERS = {"m_a": 1.0, "m_b": 64.0}
# Route weight and component weights per regime.
ROUTES = {"R10": (0.5, {"m1": 0.5, "m2": 0.5}), "R01": (1.0, {"m2": 1.0}), "R11": (0.75, {"m2": 1.0})}
SPLIT_WEIGHTS = {"val_chem_only": 0.2, "val_strain_only": 0.4, "val_both": 0.6, "val_time": 0.8}


@query("i01_protein_mean_baseline", "SELECT sample_id, protein, r6(pm) AS value FROM v_samples CROSS JOIN v_pm WHERE split <> 'train'")
def i01(star: Star) -> DataFrame:
    means = Study(star).protein_means
    grid = dense_grid(star.samples.filter(F.col("split") != "train").select("sample_id"), means.select("protein"))
    return grid.join(means, "protein").select("sample_id", "protein", r6("protein_mean").alias("value"))


@query(
    "i02_matched_control_baseline",
    f"SELECT split, count(*) AS n_cells, r6(sqrt(avg((c - y) * (c - y)))) AS rmse, r6({pcc('c', 'y')}) AS pcc FROM v_score GROUP BY 1",
)
def i02(star: Star) -> DataFrame:
    from cellshift.functions.moments import pearson_agg

    preds = controls.exact_control(star.samples, star.log2, star.treatments)
    cells = prepare.with_samples(star.log2.join(preds, ["sample_id", "protein"]), star.samples.select("sample_id", "split"))
    return cells.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(metrics.rmse("control", "y")).alias("rmse"), r6(pearson_agg("control", "y")).alias("pcc")
    )


def member_predictions(star: Star) -> DataFrame:
    """Three ensemble members as long predictions."""
    study = Study(star)
    rows = prepare.with_samples(star.log2, star.samples.select("sample_id", "split", "strain", "chemical"))
    wide = study.predicted(rows, MEMBERS)
    # Exploded, since an unpivot would forget the buckets and the averages per cell would shuffle all members.
    members = F.array(*[F.struct(F.lit(name).alias("member"), F.col(name).alias("value")) for name in ("m1", *MEMBERS)])
    return wide.select("sample_id", "split", "protein", F.explode(members).alias("_m")).select("sample_id", "split", "protein", "_m.*")


@query(
    "i03_seed_average",
    "SELECT sample_id, protein, r6((m1 + ma + mb) / 3) AS value FROM v_abs",
)
def i03(star: Star) -> DataFrame:
    out = predict.seed_average(member_predictions(star), 3)
    return out.select("sample_id", "protein", r6("value").alias("value"))


@query(
    "i03_incomplete_members",
    "SELECT split, protein, CASE protein WHEN 'L7' THEN 2 WHEN 'L6' THEN 3 ELSE 2 END AS n_seeds, count(*) AS n_cells FROM v_abs WHERE protein IN ('L5', 'L6', 'L7') GROUP BY 1, 2, 3",
)
def i03_gaps(star: Star) -> DataFrame:
    """Faults put in: a member without L7, one that has L6 twice, one that has another's L5 twice in place of its own."""
    whole = member_predictions(star)
    last = F.col("member") == "m_b"
    kept = whole.filter(~(last & F.col("protein").isin("L5", "L7")))
    faulty = kept.unionByName(whole.filter(last & (F.col("protein") == "L6"))).unionByName(whole.filter((F.col("member") == "m_a") & (F.col("protein") == "L5")))
    gaps = predict.incomplete_cells(faulty, 3, ["sample_id", "split", "protein"])
    return gaps.groupBy("split", "protein", "n_seeds").agg(F.count(F.lit(1)).alias("n_cells"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else ("NULL" if v is None else f"CAST({v} AS DOUBLE)") for v in row) + ")" for row in rows)


WEIGHT_SQL = f"(SELECT * FROM (VALUES {_values([(w,) for w in WEIGHTS])}) AS w(weight))"


@query(
    "i04_linear_blend_grid",
    f"SELECT split, weight, count(*) AS n_cells, r6(sqrt(avg(pow((1 - weight) * m0 + weight * m2 - y, 2)))) AS rmse FROM v_abs CROSS JOIN {WEIGHT_SQL} GROUP BY 1, 2",
)
def i04(star: Star) -> DataFrame:
    rows = literal_rows(Study(star).absolute.select("split", "y", "m0", "m2"), [{"weight": w} for w in WEIGHTS], {"weight": "double"})
    blended = rows.withColumn("m", predict.blend(F.col("m0"), F.col("m2"), F.col("weight")))
    return blended.groupBy("split", "weight").agg(F.count(F.lit(1)).alias("n_cells"), r6(metrics.rmse()).alias("rmse"))


SPLIT_WEIGHT_SQL = "CASE split WHEN 'val_chem_only' THEN 0.2 WHEN 'val_strain_only' THEN 0.4 WHEN 'val_both' THEN 0.6 WHEN 'val_time' THEN 0.8 ELSE 0 END"


@query(
    "i05_per_split_blend",
    f"SELECT sample_id, protein, r6((1 - w) * m0 + w * m2) AS value FROM (SELECT *, {SPLIT_WEIGHT_SQL} AS w FROM v_abs)",
)
def i05(star: Star) -> DataFrame:
    weight = predict.split_weight(F.col("split"), SPLIT_WEIGHTS)
    rows = Study(star).absolute
    return rows.select("sample_id", "protein", r6(predict.blend(F.col("m0"), F.col("m2"), weight)).alias("value"))


def components(rows: DataFrame) -> DataFrame:
    """Named components of the additive predictor."""
    return rows.withColumns(
        {
            "B_U": F.col("m0"),
            "B_s": F.col("m1") - F.col("m0"),
            "C_obs": (F.col("m2") - F.col("m1")) * 0.1,
            "R_U": (F.col("m2") - F.col("m0")) * 0.05,
            "R_s": (F.col("m1") - F.col("m0")) * 0.5,
            "R_c": F.col("m2") - F.col("m1"),
            "R_sc": (F.col("m2") - F.col("m0")) * 0.25,
        }
    )


RECOMPOSED_SQL = """m0 + 0.5 * (m1 - m0) + (m2 - m1) * 0.1 + CASE WHEN kind = 'treatment' THEN (m2 - m0) * 0.05 + 0.5 * (m1 - m0) * 0.5 + 1.0 * (m2 - m1) + 0.25 * (m2 - m0) * 0.25 ELSE 0 END"""
SCALES = {"strain": 0.5, "chemical": 1.0, "pair": 0.25}


@query("i06_recomposition", f"SELECT sample_id, protein, r6({RECOMPOSED_SQL}) AS value FROM v_abs")
def i06(star: Star) -> DataFrame:
    rows = components(Study(star).absolute)
    return rows.select("sample_id", "protein", r6(predict.recompose(SCALES, F.col("kind") == "treatment")).alias("value"))


@query(
    "i07_reconstruction_check",
    "SELECT kind, count(*) AS n_cells, r6(max(abs(CASE WHEN sample_id % 997 = 5 THEN 0.001 ELSE 0 END))) AS max_gap, max(CASE WHEN sample_id % 997 = 5 THEN 1 ELSE 0 END) = 0 AS passed FROM v_abs GROUP BY 1",
)
def i07(star: Star) -> DataFrame:
    rows = components(Study(star).absolute)
    rebuilt = predict.recompose(SCALES, F.col("kind") == "treatment")
    # Some stored values are disturbed so that the check has something to find.
    stored = rebuilt + F.when(F.col("sample_id") % 997 == 5, 0.001).otherwise(0.0)
    return rounded(predict.reconstruction_gap(rows, rebuilt, stored, by=["kind"]), ["kind"])


# Responses of the fusion queries: main, second expert and the general part of the second.
FIRST, SECOND, GENERAL = "(m1 - m0)", "(1.5 * (m1 - m0) + 0.1 * coalesce(ctx, 0))", "(0.5 * (m1 - m0))"
FAMILIES = (
    [{"candidate": f"blend_w{w:g}", "family": "blend", "weight": w} for w in (0.0, 0.5, 1.0)]
    + [{"candidate": f"residual_w{w:g}", "family": "residual", "weight": w} for w in (0.25, 0.5)]
    + [
        {"candidate": f"high_specialist_w0.5_t{t:g}_g{g:g}", "family": "high_specialist", "weight": 0.5, "threshold": t, "takeover": g}
        for t in (0.05, 0.2)
        for g in (0.5, 1.0)
    ]
)
FAMILY_COLUMNS = {"candidate": "string", "family": "string", "weight": "double", "threshold": "double", "takeover": "double"}
FAMILY_SQL = "(SELECT * FROM (VALUES {}) AS f(candidate, family, weight, threshold, takeover))".format(
    _values([tuple(item.get(name) for name in FAMILY_COLUMNS) for item in FAMILIES])
)
RESPONSE_OF_FAMILY = f"""CASE family WHEN 'blend' THEN (1 - weight) * {FIRST} + weight * {SECOND} WHEN 'residual' THEN {FIRST} + weight * ({SECOND} - {GENERAL})
 ELSE (1 - weight) * {FIRST} + weight * {SECOND} + takeover * CASE WHEN abs({FIRST}) >= threshold THEN 1 ELSE 0 END * ({FIRST} - ((1 - weight) * {FIRST} + weight * {SECOND})) END"""
view("v_family", f"SELECT *, m0 - c + ({RESPONSE_OF_FAMILY}) AS p FROM v_oof CROSS JOIN {FAMILY_SQL}")


def fusion_cells(study: Study) -> DataFrame:
    """Out-of-fold cells with the predicted delta of every fusion candidate."""
    shift = F.col("m1") - F.col("m0")
    cells = study.oof.withColumns({"first": shift, "second": 1.5 * shift + 0.1 * F.coalesce("context_ref", F.lit(0.0)), "general": 0.5 * shift})
    rows = literal_rows(cells, FAMILIES, FAMILY_COLUMNS)
    fused = predict.fused_response(*[F.col(n) for n in ("family", "weight", "first", "second", "general", "threshold", "takeover")])
    return rows.withColumn("pred_delta", F.col("m0") - F.col("control") + fused)


@query(
    "i08_fusion_families",
    f"SELECT candidate, family, count(*) AS n_cells, r6(avg(p)) AS mean_prediction, r6({pcc('p', 't')}) AS fc_pcc FROM v_family WHERE family <> 'high_specialist' GROUP BY 1, 2",
)
def i08(star: Star) -> DataFrame:
    from cellshift.functions.moments import pearson_agg

    rows = fusion_cells(Study(star)).filter(F.col("family") != "high_specialist")
    return rows.groupBy("candidate", "family").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(F.avg("pred_delta")).alias("mean_prediction"), r6(pearson_agg("pred_delta", "truth_delta")).alias("fc_pcc")
    )


@query(
    "i09_high_effect_specialist",
    "SELECT sample_id, protein, r6((m1 + m2) / 2 - m0 + 0.5 * CASE WHEN abs(m1 - m0) >= 0.02 THEN 1 ELSE 0 END * ((m1 - m0) - ((m1 + m2) / 2 - m0))) AS value FROM v_abs",
)
def i09(star: Star) -> DataFrame:
    rows = Study(star).absolute
    first, second = F.col("m1") - F.col("m0"), F.col("m2") - F.col("m0")
    out = predict.gated_takeover(predict.blend(first, second, 0.5), first, 0.02, 0.5)
    return rows.select("sample_id", "protein", r6(out).alias("value"))


@query("i10_bounded_shrink", "SELECT sample_id, protein, r6(m2 + 0.3 * (m0 - m2)) AS value FROM v_abs")
def i10(star: Star) -> DataFrame:
    rows = Study(star).absolute
    return rows.select("sample_id", "protein", r6(predict.bounded_shrink(F.col("m2"), F.col("m0"), 0.3)).alias("value"))


@query(
    "i11_residual_overlay_grid",
    f"SELECT fold, weight AS alpha, r6({pcc('m0 - c + weight * (m1 - m0)', 't')}) AS fc_pcc, r6(sqrt(avg(pow(m0 + weight * (m1 - m0) - y, 2)))) AS rmse FROM v_oof CROSS JOIN {WEIGHT_SQL} GROUP BY 1, 2",
)
def i11(star: Star) -> DataFrame:
    from cellshift.functions.moments import pearson_agg

    rows = literal_rows(Study(star).oof, [{"alpha": w} for w in WEIGHTS], {"alpha": "double"})
    rows = rows.withColumn("m", predict.residual_overlay(F.col("m0"), F.col("m1"), F.col("m0"), F.col("alpha"))).withColumn("p", F.col("m") - F.col("control"))
    return rows.groupBy("fold", "alpha").agg(r6(pearson_agg("p", "truth_delta")).alias("fc_pcc"), r6(metrics.rmse()).alias("rmse"))


def routed_cells(star: Star) -> DataFrame:
    study = Study(star)
    regimes = audited(star).select("sample_id", "support_regime")
    cells = prepare.with_samples(study.absolute, regimes)
    return predict.route_rows(cells, ROUTES, "support_regime", "m0")


@query(
    "i12_row_routing",
    """
SELECT sample_id, protein, CASE WHEN support_regime IN ('R10', 'R01', 'R11') THEN support_regime ELSE 'base' END AS selected_route,
  r6(CASE support_regime WHEN 'R10' THEN 0.5 * m0 + 0.5 * (0.5 * m1 + 0.5 * m2) WHEN 'R01' THEN m2 WHEN 'R11' THEN 0.25 * m0 + 0.75 * m2 ELSE m0 END) AS value
FROM v_abs JOIN v_regime USING (sample_id)
""",
)
def i12(star: Star) -> DataFrame:
    return routed_cells(star).select("sample_id", "protein", "selected_route", r6("final").alias("value"))


@query(
    "i12_route_audit",
    """
SELECT selected_route, route_weight, count(DISTINCT sample_id) AS n_rows, count(*) AS n_cells FROM (
 SELECT sample_id, CASE WHEN support_regime IN ('R10', 'R01', 'R11') THEN support_regime ELSE 'base' END AS selected_route,
   CAST(CASE support_regime WHEN 'R10' THEN 0.5 WHEN 'R01' THEN 1 WHEN 'R11' THEN 0.75 ELSE 0 END AS DOUBLE) AS route_weight FROM v_abs JOIN v_regime USING (sample_id)) GROUP BY 1, 2
""",
)
def i12_audit(star: Star) -> DataFrame:
    return routed_cells(star).groupBy("selected_route", "route_weight").agg(F.countDistinct("sample_id").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"))


@query(
    "i12_route_violations",
    "SELECT 'route_without_rows' AS rule, 'R99' AS route, CAST(0 AS BIGINT) AS n",
)
def i12_bad(star: Star) -> DataFrame:
    return predict.route_violations(routed_cells(star), ["R10", "R01", "R11", "R99"], "support_regime")


@query(
    "i13_scale_grid",
    f"""
WITH s AS (SELECT DISTINCT support_regime AS scenario FROM v_regime WHERE support_regime <> 'control'
   UNION SELECT 'RT' FROM v_samples WHERE split = 'val_time'),
 g AS (SELECT a.weight AS strain_scale, b.weight AS chemical_scale, c.weight AS pair_scale FROM {WEIGHT_SQL} a CROSS JOIN {WEIGHT_SQL} b CROSS JOIN {WEIGHT_SQL} c)
SELECT scenario, strain_scale, chemical_scale, pair_scale FROM s CROSS JOIN g
WHERE CASE scenario WHEN 'RT' THEN true WHEN 'R11' THEN pair_scale = 0 WHEN 'R10' THEN pair_scale = 0 AND chemical_scale = 0
      WHEN 'R01' THEN pair_scale = 0 AND strain_scale = 0 ELSE pair_scale = 0 AND strain_scale = 0 AND chemical_scale = 0 END
""",
)
def i13(star: Star) -> DataFrame:
    regimes = audited(star).filter(F.col("support_regime") != "control").select(F.col("support_regime").alias("scenario"))
    timed = star.samples.filter(F.col("split") == "val_time").select(F.lit("RT").alias("scenario"))
    return predict.scale_grid(regimes.union(timed).distinct())


view("v_grid", f"SELECT split, weight, count(*) AS n_cells, {response('p', 't')} FROM (SELECT *, (1 - weight) * m0 + weight * m2 - c AS p FROM v_score CROSS JOIN {WEIGHT_SQL}) GROUP BY 1, 2")
GRID_METRICS = ["fc_pcc", "context_residual_pcc", "drug_residual_pcc", "high_effect_pcc", "high_effect_f1"]


def delta_components(scored: DataFrame) -> DataFrame:
    """Base and additive parts of the predictors as deltas."""
    return scored.withColumns(
        {"base": F.col("m0") - F.col("control"), "by_strain": F.col("m1") - F.col("m0"), "by_chemical": F.col("m2") - F.col("m1")}
    )


PARTS = ["base", "by_strain", "by_chemical"]


def blend_grid(study: Study) -> DataFrame:
    """Every blend weight scored per split from one scan of cross moments."""
    options = [{"weight": w, "base": 1.0, "by_strain": w, "by_chemical": w} for w in WEIGHTS]
    return rounded(predict.linear_candidate_scores(delta_components(study.scored), ["split"], PARTS, options, {"weight": "double"}), ["split", "weight"])


@query("i14_grid_scoring", f"SELECT split, weight, n_cells, {', '.join(GRID_METRICS)} FROM v_grid")
def i14(star: Star) -> DataFrame:
    return blend_grid(Study(star))


view(
    "v_family_grid",
    f"SELECT candidate, family, fold, fc_pcc, context_residual_pcc, high_effect_pcc, high_effect_f1 FROM (SELECT candidate, family, fold, {response('p', 't', drug='NULL::DOUBLE', zero=True)} FROM v_family GROUP BY 1, 2, 3)",
)


def family_grid(study: Study) -> DataFrame:
    """Fold metrics of every fusion candidate (gates are not linear, so cells repeat per candidate)."""
    report = metrics.response_report(fusion_cells(study), ["candidate", "family", "fold"], zero_when_no_hit=True)
    keep = ["candidate", "family", "fold"]
    return rounded(report.select(*keep, "fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1"), keep)


@query("i14_gated_grid_scoring", "SELECT * FROM v_family_grid")
def i14_gated(star: Star) -> DataFrame:
    return family_grid(Study(star))


@query(
    "i15_fixed_candidate_comparison",
    f"""
SELECT candidate, split, fc_pcc, context_residual_pcc, high_effect_f1 FROM (
 SELECT candidate, split, {response('p', 't')} FROM (
  SELECT 'frozen_blend' AS candidate, split, t, ctx, drug, (1 - w) * m0 + w * m2 - c AS p FROM (SELECT *, {SPLIT_WEIGHT_SQL} AS w FROM v_score)
  UNION ALL SELECT 'gated', split, t, ctx, drug, m0 - c + (m1 - m0) + 0.5 * CASE WHEN abs(m2 - m0) >= 0.05 THEN 1 ELSE 0 END * ((m2 - m0) - (m1 - m0)) AS p FROM v_score)
 GROUP BY 1, 2)
""",
)
def i15(star: Star) -> DataFrame:
    scored = Study(star).scored
    weight = predict.split_weight(F.col("split"), SPLIT_WEIGHTS)
    frozen = predict.blend(F.col("m0"), F.col("m2"), weight) - F.col("control")
    gated = F.col("m0") - F.col("control") + predict.gated_takeover(F.col("m1") - F.col("m0"), F.col("m2") - F.col("m0"), 0.05, 0.5)
    options = F.array(F.struct(F.lit("frozen_blend").alias("candidate"), frozen.alias("pred_delta")), F.struct(F.lit("gated").alias("candidate"), gated.alias("pred_delta")))
    rows = scored.withColumn("_o", F.explode(options)).select("*", "_o.*")
    report = metrics.response_report(rows, ["candidate", "split"])
    return rounded(report.select("candidate", "split", "fc_pcc", "context_residual_pcc", "high_effect_f1"), ["candidate", "split"])


@query(
    "q_routed_ensemble",
    f"""
WITH f AS (SELECT a.sample_id, a.protein, a.split, a.y, support_regime, (1 - w) * (m1 + ma + mb) / 3 + w * m2 AS blended, m0, m1, m2
  FROM (SELECT *, {SPLIT_WEIGHT_SQL} AS w FROM v_abs WHERE split <> 'train') a JOIN v_regime r USING (sample_id)),
 z AS (SELECT *, CASE WHEN support_regime = 'R10' THEN m0 + ((m1 + m2) / 2 - m0) + 0.25 * CASE WHEN abs(m1 - m0) >= 0.02 THEN 1 ELSE 0 END * ((m1 - m0) - ((m1 + m2) / 2 - m0)) ELSE blended END AS final FROM f)
SELECT split, support_regime, count(*) AS n_cells, r6(avg(final)) AS mean_final, r6(sqrt(avg(pow(final - y, 2)))) AS rmse FROM z GROUP BY 1, 2
""",
)
def q_routed(star: Star) -> DataFrame:
    from cellshift.plans.routed import routed_ensemble

    final = routed_ensemble(star, SPLIT_WEIGHTS, MEMBERS)
    return final.groupBy("split", "support_regime").agg(
        F.count(F.lit(1)).alias("n_cells"), r6(F.avg("final")).alias("mean_final"), r6(metrics.rmse("final", "y")).alias("rmse")
    )
