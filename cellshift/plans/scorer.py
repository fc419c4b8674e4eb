"""Batch scorer: truth and prediction tables in, overall and per-split reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions.numbers import missing_nan, non_finite
from cellshift.functions.text import composite_key, row_kind
from cellshift.operators import checks, controls, metrics, prepare
from cellshift.schema import MATCH_FIELDS, TEST_SPLITS
from cellshift.session import written


def score_frames(absolute: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overall (one row) and per-split reports from an absolute and a scored table."""
    every = lambda frame: frame.withColumn("_all", F.lit("all"))
    overall = (
        metrics.absolute_fidelity(every(absolute), ["_all"])
        .join(metrics.response_report(every(scored), ["_all"], groups=every(absolute)), "_all", "left")
        .drop("_all")
    )
    by_split = metrics.absolute_fidelity(absolute, ["split"]).join(
        metrics.response_report(scored, ["split"], groups=absolute), "split", "left"
    )
    return overall, by_split


def prepared_samples(samples: DataFrame, match_fields=MATCH_FIELDS) -> DataFrame:
    """Add row kind and match key to contract metadata."""
    return samples.withColumn("kind", row_kind("chemical")).withColumn("match_key", composite_key(match_fields))


def incomplete_predictions(samples: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Observed truth cells without a finite prediction: (sample_id, protein, reason)."""
    wanted = prepare.with_samples(truth.filter(missing_nan("value").isNotNull()), samples.select("sample_id"), "left_semi").select("sample_id", "protein")
    given = predictions.select("sample_id", "protein", F.col("value").alias("_p"), F.lit(True).alias("_given"))
    reason = (
        F.when(F.col("_given").isNull(), "absent").when(F.col("_p").isNull() | F.isnan("_p"), "missing").when(non_finite("_p"), "non_finite")
    )
    return wanted.join(given, ["sample_id", "protein"], "left").select("sample_id", "protein", reason.alias("reason")).filter(F.col("reason").isNotNull())


def score_study(
    samples: DataFrame,
    truth: DataFrame,
    predictions: DataFrame,
    context_reference: DataFrame,
    drug_reference: DataFrame,
    truth_scale: str = "auto",
    prediction_scale: str = "log2",
    control_samples: DataFrame | None = None,
    control_cells: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score a prediction set against truth cells and frozen references.

    Every observed truth cell needs a finite prediction; one that is absent, null or
    not finite stops the query.

    ``samples`` needs sample_id, split, kind, chemical and match_key.  Controls
    come from the scored samples themselves unless another pool is given.
    """
    y = prepare.to_log2_by_scale(truth, truth_scale)
    p = prepare.to_log2_by_scale(predictions, prediction_scale).withColumnRenamed("y", "m")
    ids = samples.select("sample_id", "split", "kind", "chemical", "match_key")
    # The aligned cells feed six aggregations, so they are written once.
    refused = F.raise_error(F.concat(F.lit("No finite prediction for "), F.col("sample_id").cast("string"), F.lit("/"), F.col("protein"))).cast("double")
    checked = F.when(F.col("m").isNull() | non_finite("m"), refused).otherwise(F.col("m"))
    paired = y.filter(F.col("y").isNotNull()).join(p, ["sample_id", "protein"], "left").withColumn("m", checked)
    absolute = written(prepare.with_samples(paired, ids), "absolute")
    pool_samples = samples if control_samples is None else control_samples
    pool_cells = y if control_cells is None else control_cells
    means = controls.control_means(pool_samples, pool_cells)
    deltas = (
        absolute.filter(F.col("kind") == "treatment")
        .join(means.select("match_key", "protein", "control"), ["match_key", "protein"])
        .withColumn("truth_delta", F.col("y") - F.col("control"))
        .withColumn("pred_delta", F.col("m") - F.col("control"))
    )
    scored = controls.with_reference(controls.with_reference(deltas, context_reference, ["match_key"]), drug_reference, ["chemical"])
    return score_frames(absolute, written(scored, "scored"))


def score_files(
    truth: DataFrame,
    predictions: DataFrame,
    samples: DataFrame,
    train_samples: DataFrame,
    train_cells: DataFrame,
    truth_scale: str = "auto",
    match_fields=MATCH_FIELDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full scorer on contract tables: checks, references, both reports and the module score.

    ``truth`` and ``predictions`` are long cells, ``samples`` the test metadata,
    ``train_samples`` and ``train_cells`` (raw) the released training data.
    """
    checks.require_empty(checks.key_violations(samples, "sample_id"), "test metadata ids must be unique")
    checks.require_empty(checks.overlap(train_samples, samples, "sample_id"), "train and test ids overlap")
    checks.require_empty(
        checks.key_set_difference(truth.select("sample_id").distinct(), predictions.select("sample_id").distinct(), "sample_id"),
        "truth and prediction ids differ",
    )
    checks.require_empty(
        checks.key_set_difference(truth.select("protein").distinct(), predictions.select("protein").distinct(), "protein"),
        "truth and prediction proteins differ",
    )
    domain = checks.value_domain(predictions)
    checks.require_empty(domain.filter(F.col("n_non_finite") > 0), "predictions must be finite")
    test = prepared_samples(samples, match_fields)
    train = prepared_samples(train_samples, match_fields).filter(F.col("split") == "train")
    train_y = prepare.log2_cells(train_cells)
    means = controls.control_means(train, train_y)
    deltas = controls.truth_deltas(train, train_y, means)
    context = controls.mean_reference(deltas, ["match_key"], "context_ref")
    drug = controls.mean_reference(deltas, ["chemical"], "drug_ref")
    overall, by_split = score_study(test, truth, predictions, context, drug, truth_scale)
    chem, strain, both, time = TEST_SPLITS
    splits = {"chemical": chem, "strain": strain, "both": both, "time": time}
    return overall, by_split, metrics.module_score(overall, by_split, splits)
