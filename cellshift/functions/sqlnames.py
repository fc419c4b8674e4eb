"""Scores over moment structs as functions of the session's SQL.

``register`` defines temporary SQL functions, so a query text can score, merge and read
high-effect measures without Python: their bodies are expressions that the optimizer
inlines.  A moment struct is what ``moments_sql`` builds over a group.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cellshift.functions.moments import MOMENTS

MOMENT_TYPE = "STRUCT<" + ", ".join(f"{name}: {'BIGINT' if name == 'n' else 'DOUBLE'}" for name in MOMENTS) + ">"


def moments_sql(x: str, y: str, where: str = "true") -> str:
    """Aggregate expression: the moment struct of the rows where both values exist and the condition holds."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL AND ({where})"
    total = lambda value: f"coalesce(sum(CASE WHEN {both} THEN {value} END), 0D)"
    values = {"sx": x, "sy": y, "sxx": f"({x}) * ({x})", "syy": f"({y}) * ({y})", "sxy": f"({x}) * ({y})"}
    return f"named_struct('n', count_if({both}), " + ", ".join(f"'{name}', {total(value)}" for name, value in values.items()) + ")"


def _functions() -> dict[str, str]:
    merged = ", ".join(f"'{name}', a.{name} + b.{name}" for name in MOMENTS)
    vx, vy = "m.sxx - m.sx * m.sx / m.n", "m.syy - m.sy * m.sy / m.n"
    # The same guards as the column form: two rows, and variance above the rounding noise of its sums.
    defined = f"m.n >= 2 AND {vx} > m.sxx * 1e-13 AND {vy} > m.syy * 1e-13"
    return {
        f"metric_merge(a {MOMENT_TYPE}, b {MOMENT_TYPE}) RETURNS {MOMENT_TYPE}": f"named_struct({merged})",
        f"metric_pearson(m {MOMENT_TYPE}) RETURNS DOUBLE": f"CASE WHEN {defined} THEN (m.sxy - m.sx * m.sy / m.n) / sqrt(({vx}) * ({vy})) END",
        "metric_share(part BIGINT, whole BIGINT) RETURNS DOUBLE": "CASE WHEN whole > 0 THEN CAST(part AS DOUBLE) / whole END",
        "metric_high_effect_f1(hit BIGINT, high_true BIGINT, high_pred BIGINT) RETURNS DOUBLE": "CASE WHEN hit > 0 THEN 2D * hit / (high_true + high_pred) END",
    }


def register(spark: SparkSession) -> None:
    """Define the functions in the session; a repeated call replaces them."""
    for head, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def response_report_sql(view: str, by: str) -> str:
    """SQL text of the response report per group over a view of (by, sample_id, pred_delta, truth_delta, context_ref, drug_ref)."""
    p, t = "pred_delta", "truth_delta"
    sets = {
        "fc": moments_sql(p, t),
        "ctx": moments_sql(f"{p} - context_ref", f"{t} - context_ref"),
        "drug": moments_sql(f"{p} - drug_ref", f"{t} - drug_ref"),
        "high": moments_sql(p, t, f"abs({t}) > 1"),
    }
    high = {"high_true": f"abs({t}) > 1", "high_pred": f"abs({p}) > 1", "same": f"signum({p}) = signum({t})"}
    counts = {
        "n_true": high["high_true"],
        "n_pred": high["high_pred"],
        "n_hit": f"{high['high_true']} AND {high['high_pred']} AND {high['same']}",
        "n_sign": f"{high['high_true']} AND {high['same']}",
    }
    return f"""
WITH pairs AS (SELECT * FROM {view} WHERE {p} IS NOT NULL AND {t} IS NOT NULL),
sums AS (
  SELECT {by}, count(DISTINCT sample_id) AS response_n_samples, count(*) AS response_n_observed_values,
    {", ".join(f"{text} AS {name}" for name, text in sets.items())},
    {", ".join(f"count_if({text}) AS {name}" for name, text in counts.items())}
  FROM pairs GROUP BY {by}
)
SELECT {by}, response_n_samples, response_n_observed_values,
  metric_pearson(fc) AS fc_pcc, metric_pearson(ctx) AS context_residual_pcc, metric_pearson(drug) AS drug_residual_pcc, metric_pearson(high) AS high_effect_pcc,
  metric_share(n_sign, n_true) AS high_effect_direction_accuracy, metric_share(n_hit, n_pred) AS high_effect_precision,
  metric_share(n_hit, n_true) AS high_effect_recall, metric_high_effect_f1(n_hit, n_true, n_pred) AS high_effect_f1
FROM sums
"""
