"""Names, keys and text flags."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.schema import CONTROL_NAMES, KEY_SEP, QUALITY_CONTROL_NAMES

# ASCII white space as Python's str.split sees it.
_SPACE = r"[\t-\r\x1c-\x1f ]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def plain_name(value: Column | str) -> Column:
    """Strip outer white space and lower-case (ASCII names)."""
    return F.lower(F.regexp_replace(_col(value), rf"^{_SPACE}|{_SPACE}$", ""))


def ascii_entity_key(value: Column | str) -> Column:
    """Entity key for ASCII text: trim, collapse white space, lower-case, null to ''."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.lower(F.trim(F.regexp_replace(text, _SPACE, " ")))


@F.pandas_udf(T.StringType())
def _unicode_entity_key(values: pd.Series) -> pd.Series:
    # Only non-ASCII values arrive here; everything else is null.
    normal = values.str.normalize("NFKC")
    return normal.map(lambda text: None if text is None else " ".join(text.split()).casefold(), na_action="ignore")


def entity_key(value: Column | str, ascii_only: bool = False) -> Column:
    """Compatibility-normalised, white-space-collapsed, case-folded entity key.

    ASCII values never leave the JVM; the Arrow function sees nulls for them,
    so only the few non-ASCII names are shipped to Python.
    """
    text = _col(value).cast("string")
    fast = ascii_entity_key(text)
    if ascii_only:
        return fast
    is_ascii = F.coalesce(text.rlike(r"\A[\x00-\x7F]*\z"), F.lit(True))
    return F.when(is_ascii, fast).otherwise(_unicode_entity_key(F.when(~is_ascii, text)))


def key_part(value: Column | str) -> Column:
    """One field of a match key as text; a missing field is the text 'nan' and so matches itself."""
    return F.coalesce(_col(value).cast("string"), F.lit("nan"))


def composite_key(fields: Iterable[Column | str]) -> Column:
    """Join key parts with the unit separator."""
    return F.concat_ws(KEY_SEP, *[key_part(field) for field in fields])


def slug(value: Column | str, sep: str = "_") -> Column:
    """Lower-case identifier: runs of other characters become one separator."""
    body = F.regexp_replace(F.lower(F.trim(_col(value).cast("string"))), "[^a-z0-9]+", sep)
    body = F.regexp_replace(body, f"^{sep}+|{sep}+$", "")
    return F.when(body == "", F.lit("unknown")).otherwise(body)


def text_flag(value: Column | str) -> Column:
    """Parse a textual boolean; unknown text gives null (an issue row, never a guess)."""
    text = F.lower(F.trim(F.coalesce(_col(value).cast("string"), F.lit(""))))
    # Accepted spellings.
    return (
        F.when(text.isin("true", "1", "yes", "y"), F.lit(True))
        .when(text.isin("false", "0", "no", "n", ""), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def row_kind(
    chemical: Column | str,
    controls: Iterable[str] = CONTROL_NAMES,
    quality_controls: Iterable[str] = QUALITY_CONTROL_NAMES,
) -> Column:
    """Classify a row as control, quality_control or treatment by its chemical name."""
    name = plain_name(chemical)
    return (
        F.when(name.isin(*controls), F.lit("control"))
        .when(name.isin(*quality_controls), F.lit("quality_control"))
        .otherwise(F.lit("treatment"))
    )
