"""The cleaner and segment filters.

`clean_sales` is one projection chain plus one filter: a single stage, no shuffle
(except the optional missing-date fallback, which needs a row order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import calendar_columns, to_day
from ..functions.numeric import parse_amount, strict_number, zero_fill
from ..plans.ordering import with_row_index
from .schema_map import STANDARD_COLUMNS, RoleMap, detect_roles, numeric_columns

CALENDAR_COLUMNS = ["MonthNum", "Month", "Quarter", "Week", "Day"]
CLEAN_COLUMNS = STANDARD_COLUMNS + CALENDAR_COLUMNS
FILTERABLE = ["Product", "Region", "Quarter", "Day"]

CLEANED_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Revenue", T.DoubleType()),
    T.StructField("Product", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("MonthNum", T.IntegerType()),
    T.StructField("Month", T.StringType()),
    T.StructField("Quarter", T.StringType()),
    T.StructField("Week", T.IntegerType()),
    T.StructField("Day", T.StringType()),
])


def empty_cleaned(spark: SparkSession) -> DataFrame:
    """The typed empty cleaned table."""
    return spark.createDataFrame([], CLEANED_SCHEMA)


def require_rows(df: DataFrame, message: str = "No usable rows found after cleaning.") -> DataFrame:
    """The API's empty guards (an action that reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip outer blanks from headers; a clash after stripping is an error."""
    names = [str(c).strip() for c in df.columns]
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"duplicate column names after stripping headers: {names}")
    return df.toDF(*names)


def _col(name: str) -> F.Column:
    """A column by its exact name (a header may hold dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _text_or_unknown(df: DataFrame, col: str | None) -> F.Column:
    if col is None:
        return F.lit("Unknown")
    return F.coalesce(_col(col).cast("string"), F.lit("Unknown"))


def clean_sales(df: DataFrame, as_of: str | None = None, order_by: Sequence[str] | None = None,
                formats: Sequence[str] | None = None) -> tuple[DataFrame, RoleMap]:
    """Raw upload -> every raw column + Date, Revenue, Product, Region, Quantity + calendar.

    Roles are detected after the header strip (documented deviation). Raw columns whose names
    equal a new column's name up to case are replaced by it, because Spark resolves column
    names case-insensitively.
    """
    df = strip_headers(df)
    roles = detect_roles(df)
    types = {f.name: f.dataType for f in df.schema.fields}

    # Date (P6) or the missing-date fallback
    if roles.date_col:
        date_expr = to_day(_col(roles.date_col), types[roles.date_col], tuple(formats or ()))
    else:
        if as_of is None:
            as_of_col = F.current_date()
        else:
            as_of_col = F.to_date(F.lit(as_of))
        order = list(order_by) if order_by else list(df.columns[:1])
        df = with_row_index(df, order, "__row_idx")
        date_expr = F.date_sub(as_of_col, (F.col("row_total") - 1 - F.col("__row_idx")).cast("int"))

    # Revenue (P4, P8)
    if roles.revenue_col:
        rc, rt = roles.revenue_col, types[roles.revenue_col]
        rev = _col(rc).cast("double") if isinstance(rt, T.NumericType) else parse_amount(_col(rc))
    else:
        nums = numeric_columns(df.drop("__row_idx", "row_total") if "__row_idx" in df.columns else df)
        rev = _col(nums[0]).cast("double") if nums else F.lit(0.0)
    revenue = zero_fill(rev)

    # Quantity (P10): strict coercion, zero fill
    if roles.quantity_col:
        qc, qt = roles.quantity_col, types[roles.quantity_col]
        q = _col(qc).cast("double") if isinstance(qt, T.NumericType) else strict_number(_col(qc))
        quantity = zero_fill(q)
    else:
        quantity = F.lit(0.0)

    new_cols = {
        "Date": date_expr,
        "Revenue": revenue,
        "Product": _text_or_unknown(df, roles.product_col),
        "Region": _text_or_unknown(df, roles.region_col),
        "Quantity": quantity,
    }
    lowered = {c.lower() for c in CLEAN_COLUMNS}
    keep = [_col(c) for c in df.columns
            if c.lower() not in lowered and c not in ("__row_idx", "row_total")]
    staged = df.select(*keep, *[e.alias(n) for n, e in new_cols.items()])
    out = staged.where(F.col("Date").isNotNull())                      # P11
    out = out.withColumns(calendar_columns(F.col("Date")))             # P12
    return out, roles


def clean_upload(raw: DataFrame, **how) -> tuple[DataFrame, RoleMap]:
    """S4 + P14: `clean_sales` behind the empty guards: an upload without rows, or without one usable row, is
    refused (each guard reads at most one row)."""
    require_rows(raw, "Uploaded file is empty.")
    clean, roles = clean_sales(raw, **how)
    return require_rows(clean), roles


def filterable_columns(df: DataFrame) -> list[str]:
    """L3: the standard filter columns present in the frame."""
    return [c for c in FILTERABLE if c in df.columns]


def segment_filter(df: DataFrame, filter_by: str | None, filter_value: str | None) -> DataFrame:
    """L1: text equality on one column; `None`/`All`/unknown column pass everything through."""
    if filter_by in (None, "None") or filter_value in (None, "All") or filter_by not in df.columns:
        return df
    return df.where(_col(filter_by).cast("string") == F.lit(str(filter_value)))


def filter_or_all(df: DataFrame, filter_by: str | None, filter_value: str | None) -> DataFrame:
    """L2: the filtered rows, or every row when the filter matches nothing.

    Lazy: whether any row matches is a one-row aggregate (stopping at the first match), joined
    to the rows as a broadcast flag.
    """
    hit = segment_filter(df, filter_by, filter_value)
    if hit is df:
        return df
    any_hit = hit.limit(1).agg((F.count(F.lit(1)) > 0).alias("__any"))
    matches = F.coalesce(_col(filter_by).cast("string") == F.lit(str(filter_value)), F.lit(False))
    return df.join(F.broadcast(any_hit)).where(matches | ~F.col("__any")).drop("__any")


def filter_values_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """T7 + X1 for several filter columns in one pass: (column, value) pairs are exploded
    from each row and de-duplicated once, plus one `All` row per column."""
    cols = list(columns) if columns is not None else filterable_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("filter_by"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    vals = (df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
            .withColumn("is_all", F.lit(False)))
    head = df.sparkSession.createDataFrame([(c, "All", True) for c in cols],
                                           "filter_by string, value string, is_all boolean")
    return head.unionByName(vals).orderBy("filter_by", F.col("is_all").desc(), "value")


def filter_values(df: DataFrame, filter_by: str) -> DataFrame:
    """T7 + X1: `All` followed by the sorted distinct text values of one column."""
    vals = (df.select(F.col(filter_by).cast("string").alias("value"))
            .where(F.col("value").isNotNull()).distinct()
            .withColumn("is_all", F.lit(False)))
    head = df.sparkSession.createDataFrame([("All", True)], "value string, is_all boolean")
    return (head.unionByName(vals)
            .select(F.lit(filter_by).alias("filter_by"), "value", "is_all")
            .orderBy(F.col("is_all").desc(), F.col("value")))
