"""Numeric coercions used by the cleaner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number with optional sign and outer blanks.
STRICT_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_amount(c: Column) -> Column:
    """Keep digits, '.' and '-' only, then read a double; anything else is null.

    `$1,200` -> 1200, `(1,200)` -> 1200, `12%` -> 12, `1e5` -> 15, `Rs. 5,000` -> 0.5,
    `1-2` / `1.2.3` / `-` / empty -> null.
    """
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def strict_number(c: Column) -> Column:
    """Strict numeric coercion: a well-formed number or null (`1,200` -> null)."""
    s = c.cast("string")
    return F.when(s.rlike(STRICT_NUMBER), F.trim(s).try_cast("double"))


def zero_fill(c: Column) -> Column:
    """Null and NaN become 0.0."""
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))
