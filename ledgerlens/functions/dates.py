"""Date coercion and calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category orders used by the reference for sorting and reindexing.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


_MONTH = "(" + "|".join(m.lower() for m in MONTHS) + ")[a-z]*"
_TIME = (r"(?:[t\s]+\d{1,2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?\s*(?:[ap]\.?m\.?)?"
         r"\s*(?:z|utc|gmt|[+-]\d{2}:?(?:\d{2})?)?)?")
# Layouts by shape: (pattern, group of year, month, day); no day group means the first of the
# month, no month group the first of January. A time and a zone may follow; the day is the one
# written. Month and day of an ambiguous numeric date: month first, unless it exceeds 12.
_SHAPES = (
    (r"(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})", 1, 2, 3),
    (r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
    (r"(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})", 3, 1, 2),
    (r"(\d{1,2})(?:st|nd|rd|th)?[-/., ]*" + _MONTH + r"[-/., ]*(\d{4})", 3, 2, 1),
    (r"(?:[a-z]{3,9},?\s+)?" + _MONTH + r"[-/. ]*(\d{1,2})(?:st|nd|rd|th)?,?[-/. ]+(\d{4})", 3, 1, 2),
    (r"(\d{4})[-/. ]" + _MONTH + r"[-/. ](\d{1,2})", 1, 2, 3),
    (r"(\d{4})[-/.](\d{1,2})", 1, 2, None),
    (_MONTH + r"[-/., ]+(\d{4})", 2, 1, None),
    (r"(\d{4})", 1, None, None),
)


def _text_day(text: Column) -> Column:
    """The day of a text date in any of the shapes; null for other text and impossible days."""
    found = []
    for shape, *groups in _SHAPES:
        pattern = "^" + shape + _TIME + "$"
        year, month, day = (F.lit("01") if g is None else F.regexp_extract(text, pattern, g) for g in groups)
        if _MONTH in shape:
            position = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), month)
            month = position.cast("string")
        elif shape.endswith(r"(\d{4})") and groups[1] is not None:
            swap = month.try_cast("int") > 12
            month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        found.append(F.when(text.rlike(pattern), iso))
    return F.coalesce(*found)


# The years whose days 64-bit nanoseconds hold in full.
FIRST_YEAR, LAST_YEAR = 1678, 2261


def to_day(c: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """Coerce any date-like column to a DateType at midnight; unparseable -> null.

    Text dates are recognised row by row (documented deviation: the reference infers one
    layout from the first value and nulls the rest); `formats` are tried first. Days outside
    FIRST_YEAR..LAST_YEAR count as unparseable, as they do in the reference, so one odd row cannot make
    a calendar of millions of days.
    """
    day = _any_day(c, dtype, formats)
    return F.when(day.between(F.lit(f"{FIRST_YEAR}-01-01").cast("date"), F.lit(f"{LAST_YEAR}-12-31").cast("date")), day)


def _any_day(c: Column, dtype: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.IntegralType):
        # yyyyMMdd integers (documented deviation: pandas reads them as nanoseconds)
        return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")))
    s = F.trim(c.cast("string"))
    given = [F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats]
    # inside a lambda, so the shapes are not compiled again for every use of the day
    day = F.get(F.transform(F.array(F.lower(s)), _text_day), F.lit(0))
    return F.coalesce(*given, day)


def calendar_columns(d: Column) -> dict[str, Column]:
    """MonthNum, Month (`Jan`), Quarter (`Q1`), ISO Week, Day (`Monday`)."""
    return {
        "MonthNum": F.month(d),
        "Month": F.date_format(d, "MMM"),
        "Quarter": F.concat(F.lit("Q"), F.quarter(d).cast("string")),
        "Week": F.weekofyear(d),
        "Day": F.date_format(d, "EEEE"),
    }

