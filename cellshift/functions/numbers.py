"""Numeric guards: missing values, rounding, safe ratios and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def missing_nan(value: Column | str) -> Column:
    """Turn NaN into null so that aggregates skip it."""
    column = _col(value).cast("double")
    return F.when(F.isnan(column), F.lit(None).cast("double")).otherwise(column)


def non_finite(value: Column | str) -> Column:
    """True for NaN and infinities; null stays false."""
    column = _col(value).cast("double")
    return F.coalesce(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), F.lit(False))


def strict_log2(value: Column | str) -> Column:
    """log2 of a positive finite value; null and NaN stay missing, anything else stops the query."""
    column = missing_nan(value)
    good = (column > 0) & (column < F.lit(float("inf")))
    refused = F.raise_error(F.concat(F.lit("Observed value is not positive and finite: "), column.cast("string"))).cast("double")
    return F.when(column.isNull(), F.lit(None).cast("double")).when(good, F.log2(column)).otherwise(refused)


def ratio(top: Column, bottom: Column) -> Column:
    """Divide, null when the denominator is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def r6(value: Column | str) -> Column:
    """Round for cross-engine comparison and drop the sign of zero."""
    return F.round(_col(value).cast("double"), 6) + F.lit(0.0)


def text_hash(*parts: Column | str | int) -> Column:
    """md5 hex digest of the parts joined with '|'."""
    columns = [part if isinstance(part, Column) else F.lit(part) for part in parts]
    return F.md5(F.concat_ws("|", *[column.cast("string") for column in columns]))


def hash_int(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 digest as a non-negative BIGINT."""
    return F.conv(F.substring(text_hash(*parts), 1, 8), 16, 10).cast("bigint")
