"""Selection and decision tables: guardrails, nested choice, nomination, promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.operators.priors import against_baseline
from cellshift.operators.ranking import best_per_group

# Decision thresholds.
BLEND_HIGH_EFFECT_DROP = 0.002
BLEND_SAMPLE_R2_DROP = 0.0005
SCALE_RESIDUAL_DROP = 1e-12
HIGH_EFFECT_MAX_DROP = 0.005
NOMINATION_FC_ABSOLUTE = 0.005
NOMINATION_FC_WITH_INTERVAL = 0.002
PRIMARY_FC_MIN_DELTA = 0.01
NEGATIVE_CONTROL_FC_MIN_DELTA = 0.0
RESIDUAL_METRICS = ("context_residual_pcc", "drug_residual_pcc")
HIGH_METRICS = ("high_effect_pcc", "high_effect_f1")


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _mark(frame: DataFrame, winners: DataFrame, keys: Sequence[str]) -> DataFrame:
    hits = winners.select(*keys).withColumn("selected", F.lit(True))
    return frame.join(hits, list(keys), "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


# --------------------------------------------------------------------------- blends
def blend_gain(scenario: Column, strain_scenarios: Sequence[str]) -> Column:
    """Selection gain from deltas: fold change + drug residual for unseen strains, else fold change + sample fidelity."""
    strain = F.lit(0.25) * F.col("fc_pcc_delta") + F.lit(0.20) * F.col("drug_residual_pcc_delta")
    other = (
        F.lit(0.05) * F.col("fc_pcc_delta")
        + F.lit(0.025) * F.col("absolute_sample_pcc_median_delta")
        + F.lit(0.025) * F.col("absolute_sample_r2_median_delta")
    )
    return F.when(scenario.isin(*strain_scenarios), strain).otherwise(other)


def select_blends(grid: DataFrame, strain_scenarios: Sequence[str] = ("S2",), scenario: str = "scenario", weight: str = "weight") -> DataFrame:
    """Best guarded weight per scenario (smaller weight on ties); the table keeps all candidates."""
    metrics = ["fc_pcc", "drug_residual_pcc", "absolute_sample_pcc_median", "absolute_sample_r2_median", *HIGH_METRICS]
    table = against_baseline(grid, [scenario], F.col(weight) == 0.0, metrics)
    table = table.withColumn("gain", blend_gain(F.col(scenario), strain_scenarios)).withColumn(
        "guardrail_pass",
        _true(F.col("high_effect_pcc_delta") >= -BLEND_HIGH_EFFECT_DROP)
        & _true(F.col("high_effect_f1_delta") >= -BLEND_HIGH_EFFECT_DROP)
        & _true(F.col("absolute_sample_r2_median_delta") >= -BLEND_SAMPLE_R2_DROP),
    )
    winners = best_per_group(table.filter("guardrail_pass"), [scenario], [("gain", True), (weight, False)])
    return _mark(table, winners, [scenario, weight])


# --------------------------------------------------------------------------- scales
def select_scales(
    grid: DataFrame, by: Sequence[str], residuals: Sequence[str] = RESIDUAL_METRICS, objective: str = "fc_pcc", scales: Sequence[str] = ("strain_scale", "chemical_scale", "pair_scale")
) -> DataFrame:
    """Best scale combination per group: no residual loss against the all-zero row, bounded high-effect loss."""
    metrics = [objective, *residuals, *HIGH_METRICS]
    zero = _all([F.col(name) == 0.0 for name in scales])
    table = against_baseline(grid, by, zero, metrics, "_delta_vs_zero")
    finite = _all([F.col(name).isNotNull() for name in metrics])
    residual = _all([_true(F.col(f"{name}_delta_vs_zero") >= -SCALE_RESIDUAL_DROP) for name in residuals])
    high = _all([_true(F.col(f"{name}_delta_vs_zero") >= -HIGH_EFFECT_MAX_DROP - SCALE_RESIDUAL_DROP) for name in HIGH_METRICS])
    table = table.withColumn("guardrail_pass", finite & residual & high)
    winners = best_per_group(table.filter("guardrail_pass"), by, [(objective, True), *[(name, False) for name in scales]])
    return _mark(table, winners, [*by, *scales])


def baseline_violations(grid: DataFrame, by: Sequence[str], scales: Sequence[str]) -> DataFrame:
    """Groups without exactly one all-zero baseline row."""
    zero = _all([F.col(name) == 0.0 for name in scales])
    counts = grid.groupBy(*by).agg(F.count(F.when(zero, F.lit(1))).alias("n_baseline"))
    return counts.filter(F.col("n_baseline") != 1)


# ------------------------------------------------------------------ nested selection
def nested_selection(
    fold_grid: DataFrame, selectors: Mapping[str, tuple[bool, str | None]], folds: int, metrics: Sequence[str] = ("fc_pcc", "context_residual_pcc", "high_effect_pcc", "high_effect_f1"), baseline: str = "blend_w0"
) -> DataFrame:
    """Leave one outer fold out, average the rest, choose: one winner per (selector, outer fold).

    ``fold_grid(candidate, family, fold, metrics)``; a selector is
    ``(guarded, family or None)``.  Guarding falls back to all candidates when
    none passes.
    """
    outer = fold_grid.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)).cast("array<bigint>"))).filter(F.col("outer_fold") != F.col("fold"))
    inner = outer.groupBy("outer_fold", "candidate", "family").agg(*[F.avg(name).alias(name) for name in metrics])
    base = inner.filter(F.col("candidate") == baseline).select("outer_fold", *[F.col(name).alias(f"_base_{name}") for name in HIGH_METRICS])
    joined = inner.join(base, "outer_fold")
    allowed = _all([_true(F.col(name) >= F.col(f"_base_{name}") - HIGH_EFFECT_MAX_DROP) for name in HIGH_METRICS])
    options = F.array(
        *[
            F.struct(F.lit(name).alias("selector"), F.lit(guarded).alias("_guarded"), F.lit(family).cast("string").alias("_family"))
            for name, (guarded, family) in selectors.items()
        ]
    )
    spread = joined.withColumn("_allowed", allowed).withColumn("_s", F.explode(options)).select("*", "_s.*")
    spread = spread.filter(F.col("_family").isNull() | (F.col("_family") == F.col("family")))
    some = spread.groupBy("selector", "outer_fold").agg(F.max("_allowed").alias("_some"))
    pool = spread.join(some, ["selector", "outer_fold"]).filter(~F.col("_guarded") | ~F.col("_some") | F.col("_allowed"))
    winners = best_per_group(
        pool, ["selector", "outer_fold"], [("fc_pcc", True), ("context_residual_pcc", True), ("high_effect_pcc", True), ("candidate", False)]
    )
    return winners.select("selector", "outer_fold", F.col("candidate").alias("selected_candidate"), *[F.col(n).alias(f"inner_{n}") for n in metrics])


# ---------------------------------------------------------------------- nominations
def discovery_nominations(table: DataFrame) -> DataFrame:
    """Nominate candidates from paired fold or entity deltas (never promotes)."""
    keys = ["candidate", "model_seed", "scenario"]
    high = table.filter(F.col("metric") == "high_effect_pcc").select(*keys, F.col("mean_delta").alias("high_effect_delta"))
    fc = table.filter(F.col("metric") == "fc_pcc").join(high, keys, "left")
    gain = _true(F.col("mean_delta") >= NOMINATION_FC_ABSOLUTE) | (
        _true(F.col("mean_delta") >= NOMINATION_FC_WITH_INTERVAL) & _true(F.col("ci_low") > 0)
    )
    nominate = gain & F.coalesce(F.col("high_effect_delta") >= -HIGH_EFFECT_MAX_DROP, F.lit(True))
    return fc.withColumns(
        {
            "nominate_for_confirmation": nominate,
            "promote": F.lit(False),
            "decision": F.when(nominate, "candidate_for_confirmation").otherwise("screen_only"),
        }
    )


def regime_nominations(table: DataFrame, regimes: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Check table per (candidate, regime) and overall verdict per candidate.

    ``regimes`` maps a regime to its relevant residual metric; every regime must
    be present and pass.
    """
    value = lambda metric, column="mean_delta": F.max(F.when(F.col("metric") == metric, F.col(column)))
    residual = lambda column: F.max(
        F.when(reduce(lambda a, b: a | b, [(F.col("scenario") == s) & (F.col("metric") == m) for s, m in regimes.items()]), F.col(column))
    )
    wide = table.filter(F.col("scenario").isin(*regimes)).groupBy("candidate", "scenario").agg(
        value("fc_pcc").alias("fc"),
        value("fc_pcc", "ci_low").alias("fc_low"),
        residual("mean_delta").alias("residual"),
        value("high_effect_pcc").alias("high_pcc"),
        value("high_effect_f1").alias("high_f1"),
    )
    # Check names of the nomination table.
    checks = wide.select(
        "candidate",
        "scenario",
        (_true(F.col("fc") >= NOMINATION_FC_ABSOLUTE) | (_true(F.col("fc") >= NOMINATION_FC_WITH_INTERVAL) & _true(F.col("fc_low") > 0))).alias("fc_nomination"),
        _true(F.col("residual") >= 0).alias("residual_nonnegative"),
        _true(F.col("high_pcc") >= -HIGH_EFFECT_MAX_DROP).alias("high_effect_pcc_guardrail"),
        _true(F.col("high_f1") >= -HIGH_EFFECT_MAX_DROP).alias("high_effect_f1_guardrail"),
    )
    names = ["fc_nomination", "residual_nonnegative", "high_effect_pcc_guardrail", "high_effect_f1_guardrail"]
    checks = checks.withColumn("passed", _all([F.col(name) for name in names]))
    verdict = checks.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n_regimes"),
        (F.bool_and("passed") & (F.count(F.lit(1)) == len(regimes))).alias("nominate_for_confirmation"),
    )
    return checks, verdict.withColumn("decision", F.when(F.col("nominate_for_confirmation"), "confirm").otherwise("screen_only"))


# ------------------------------------------------------------------------ scale screen
def screen_table(scores: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (axis, scale): macro objective over the axis' regimes, completeness, finiteness."""
    wanted = reduce(
        lambda a, b: a | b, [(F.col("axis") == axis) & F.col("scenario").isin(*regimes) for axis, regimes in axes.items()]
    )
    needed = {axis: ["context_residual_pcc"] if axis == "strain" else ["drug_residual_pcc"] if axis == "chemical" else list(RESIDUAL_METRICS) for axis in axes}
    finite = F.lit(True)
    for name in ("fc_pcc", *HIGH_METRICS):
        finite = finite & F.col(name).isNotNull()
    for axis, residuals in needed.items():
        finite = finite & ((F.col("axis") != axis) | _all([F.col(name).isNotNull() for name in residuals]))
    size = F.lit(0)
    for axis, regimes in axes.items():
        size = F.when(F.col("axis") == axis, len(regimes)).otherwise(size)
    return (
        scores.filter(wanted)
        .withColumn("_finite", finite)
        .groupBy("axis", "scale")
        .agg(F.avg("fc_pcc").alias("fc_macro"), F.countDistinct("scenario").alias("n_regimes"), F.bool_and("_finite").alias("metrics_finite"))
        .withColumn("complete", F.col("n_regimes") == size)
    )


def grid_completeness(screen: DataFrame, scales: Sequence[float]) -> DataFrame:
    """Per axis: whether exactly the locked scales are present, complete and finite."""
    observed = F.sort_array(F.collect_set("scale"))
    return screen.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (observed == F.array(*[F.lit(float(s)) for s in sorted(scales)])).alias("scales_match"),
        (F.bool_and("complete") & F.bool_and("metrics_finite")).alias("all_usable"),
    ).withColumn("valid", (F.col("n_rows") == len(scales)) & F.col("scales_match") & F.col("all_usable"))


def select_screen(scores: DataFrame, axes: Mapping[str, Sequence[str]], scales: Sequence[float]) -> DataFrame:
    """Choose one scale per axis: worst residual and high-effect deltas over the regimes guard, macro FC decides.

    Deltas are taken per regime against scale zero and reduced by their minimum,
    so one regime cannot pay for another.
    """
    metrics = ["fc_pcc", *RESIDUAL_METRICS, *HIGH_METRICS]
    screen = screen_table(scores, axes)
    valid = grid_completeness(screen, scales).filter("valid").select("axis")
    wanted = reduce(lambda a, b: a | b, [(F.col("axis") == a) & F.col("scenario").isin(*r) for a, r in axes.items()])
    deltas = against_baseline(scores.filter(wanted), ["axis", "scenario"], F.col("scale") == 0.0, metrics)
    c, d = F.col("context_residual_pcc_delta"), F.col("drug_residual_pcc_delta")
    relevant = F.when(F.col("axis") == "strain", c).when(F.col("axis") == "chemical", d).otherwise(F.least(c, d))
    worst = deltas.groupBy("axis", "scale").agg(
        F.avg("fc_pcc_delta").alias("fc_delta_vs_zero"),
        F.min(relevant).alias("residual_delta_vs_zero"),
        F.min("high_effect_pcc_delta").alias("_hp"),
        F.min("high_effect_f1_delta").alias("_hf"),
    )
    pair_high = F.least(F.col("_hp"), F.col("_hf"))
    table = (
        screen.join(worst, ["axis", "scale"])
        .join(valid, "axis", "left_semi")
        .withColumn("high_effect_delta_vs_zero", F.when(F.col("axis") == "pair", pair_high).otherwise(F.col("_hp")))
        .withColumn(
            "guardrail_pass",
            _true(F.col("residual_delta_vs_zero") >= -SCALE_RESIDUAL_DROP) & _true(F.col("_hp") >= -HIGH_EFFECT_MAX_DROP) & _true(F.col("_hf") >= -HIGH_EFFECT_MAX_DROP),
        )
        .drop("_hp", "_hf")
    )
    winners = best_per_group(
        table.filter("guardrail_pass"),
        ["axis"],
        [("fc_macro", True), ("residual_delta_vs_zero", True), ("high_effect_delta_vs_zero", True), ("scale", False)],
    )
    return _mark(table, winners, ["axis", "scale"])


# ------------------------------------------------------------------------- calibration
def select_calibration(profiles: DataFrame, reference: str, shuffled: str, key: str = "experiment_id") -> DataFrame:
    """Choose a guarded plate candidate that beats the reference and the shuffle, else the reference.

    ``profiles`` has the macro columns, ``calibration_rank`` and
    ``calibration_dropout``.
    """
    macros = ["macro_fc", "context_residual_macro", "drug_residual_macro", "high_effect_pcc_macro", "high_effect_f1_macro", "plate_fc"]
    table = against_baseline(profiles, [], F.col(key) == reference, macros, "_delta")
    guard = _all([_true(F.col(f"{name}_delta") >= -HIGH_EFFECT_MAX_DROP) for name in macros if name != "macro_fc"])
    candidate = ~F.col(key).isin(reference, shuffled)
    table = table.withColumn("guardrails_pass", guard).withColumn("selection_eligible", (F.col(key) == reference) | (candidate & F.col("guardrails_pass")))
    best = best_per_group(
        table.filter(candidate & F.col("guardrails_pass")), [], [("macro_fc", True), ("calibration_rank", False), ("calibration_dropout", True), (key, False)]
    )
    rivals = profiles.agg(F.max(F.when(F.col(key).isin(reference, shuffled), F.col("macro_fc")))).scalar()
    beats = best.filter(F.col("macro_fc") > rivals).select(F.col(key).alias("_best"))
    chosen = F.coalesce(beats.agg(F.max("_best")).scalar(), F.lit(reference))
    return table.withColumn("selected", F.col(key) == chosen)


# --------------------------------------------------------------------------- promotion
def promotion_checks(stats: DataFrame, fc_threshold: Column | float = PRIMARY_FC_MIN_DELTA) -> DataFrame:
    """Rule result of every (scenario, axis, metric) row of bootstrapped entity statistics."""
    threshold = fc_threshold if isinstance(fc_threshold, Column) else F.lit(float(fc_threshold))
    enough = F.col("n_units") >= 2
    firm = _true(F.col("ci_low") > 0) & F.col("all_seeds_positive")
    fc = enough & _true(F.col("mean_delta") >= threshold) & firm
    residual = enough & _true(F.col("mean_delta") > 0) & firm
    high = enough & _true(F.col("mean_delta") >= -HIGH_EFFECT_MAX_DROP) & _true(F.col("min_seed_mean") >= -HIGH_EFFECT_MAX_DROP)
    passed = F.when(F.col("metric") == "fc_pcc", fc).when(F.col("metric").isin(*RESIDUAL_METRICS), residual).otherwise(high)
    return stats.withColumn("passed", passed)


def expected_checks(spark: SparkSession, axes: Mapping[str, Sequence[str]], residuals: Mapping[str, Sequence[str]]) -> DataFrame:
    """(scenario, cluster_axis, metric) rows that a verdict needs: each scenario's own axes and residuals."""
    rows = [(scenario, axis, metric) for scenario in axes for axis in axes[scenario] for metric in ("fc_pcc", *residuals[scenario], *HIGH_METRICS)]
    return spark.createDataFrame(rows, "scenario string, cluster_axis string, metric string")


def promotion_verdict(checks: DataFrame, by: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Overall verdict with the failing rows as reasons; expected rows that are absent also block."""
    by = list(by)
    rows = checks
    if expected is not None:
        rows = expected.join(checks, [*by, "scenario", "cluster_axis", "metric"], "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    label = F.concat_ws("/", "scenario", "cluster_axis", "metric")
    has_residual = F.bool_or(F.col("metric").isin(*RESIDUAL_METRICS))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count(F.when(F.col("passed"), F.lit(1))).alias("n_passed"),
        (F.bool_and("passed") & has_residual).alias("promoted"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), label))), "; ").alias("reasons"),
    )


def combined_verdict(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Primary and all negative-control comparisons must promote."""
    return verdicts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_comparisons"), F.bool_and("promoted").alias("promoted"))


# ---------------------------------------------------------------------------- receipts
def receipt_audit(receipts: DataFrame, control: str) -> DataFrame:
    """Match every producer receipt to the control receipt of the same seed and fold.

    ``receipts(producer, model_seed, scenario, fold, source_sha, parent_sha,
    copied_sha, post_sha, final_sha, declared_unchanged, is_frozen)``.
    """
    keys = ["model_seed", "scenario", "fold"]
    parent = receipts.filter(F.col("producer") == control).select(*keys, F.col("source_sha").alias("_source"), F.col("parent_sha").alias("_parent"))
    joined = receipts.join(parent, keys, "left")
    same = lambda column: _true(F.col(column) == F.col("_parent"))
    # Check names of the receipt table.
    checks = {
        "source_matches_control": _true(F.col("source_sha") == F.col("_source")),
        "parent_matches_control": same("parent_sha"),
        "copy_matches_parent": same("copied_sha"),
        "frozen_state_matches_parent": same("post_sha"),
        "frozen_final_matches_parent": ~F.col("is_frozen") | same("final_sha"),
        "receipt_declares_unchanged": _true(F.col("declared_unchanged")),
    }
    table = joined.withColumns(checks)
    return table.withColumn("receipt_valid", _all([F.col(name) for name in checks]) & F.col("_parent").isNotNull()).select(
        "producer", *keys, *checks, "receipt_valid"
    )
