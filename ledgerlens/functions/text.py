"""Text expressions: header normalisation and number formatting for report text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(value) -> str:
    """Driver-side form of a header: trim, lower, non-alphanumeric runs to '_', strip '_'."""
    text = str(value).strip().lower()
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


def normalize_text(c: Column) -> Column:
    """Column form of :func:`normalize_name`."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[^a-z0-9]+", "_"), F.lit("_"))


def currency(c: Column, spaced: bool = False) -> Column:
    """`$1,234` (or `$ 1,234` for the copilot) with half-even rounding to whole units."""
    return F.concat(F.lit("$ " if spaced else "$"), F.format_number(c, 0))


def fixed(c: Column, decimals: int) -> Column:
    """Plain fixed-point text without grouping commas, half-even like Python's format."""
    return F.regexp_replace(F.format_number(c, decimals), ",", "")


def fixed_or_nan(c: Column, decimals: int) -> Column:
    """Like :func:`fixed` but prints ``nan`` for a missing value, as the report text does."""
    return F.coalesce(fixed(c, decimals), F.lit("nan"))
