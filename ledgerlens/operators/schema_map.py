"""Schema mapping: header normalisation and business-role detection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_name, normalize_text

# Role keyword lists, in the reference's order.
ROLE_KEYWORDS = {
    "date_col": ["date", "order_date", "invoice_date", "time", "month"],
    "revenue_col": ["revenue", "sales", "amount", "value", "total", "net_sales"],
    "product_col": ["product", "item", "sku", "name"],
    "region_col": ["region", "city", "state", "country", "market"],
    "quantity_col": ["quantity", "qty", "units", "count"],
}
ROLES = list(ROLE_KEYWORDS)
STANDARD_COLUMNS = ["Date", "Revenue", "Product", "Region", "Quantity"]


@dataclass
class RoleMap:
    date_col: str | None = None
    revenue_col: str | None = None
    product_col: str | None = None
    region_col: str | None = None
    quantity_col: str | None = None
    standard_columns: list[str] = field(default_factory=lambda: list(STANDARD_COLUMNS))

    def as_dict(self) -> dict:
        return {r: getattr(self, r) for r in ROLES} | {"standard_columns": list(self.standard_columns)}


def find_column(columns: list[str], keywords: list[str]) -> str | None:
    """First column (frame order) whose normalised name contains any normalised keyword."""
    kws = [normalize_name(k) for k in keywords]
    for c in columns:
        n = normalize_name(c)
        if any(k in n for k in kws):
            return c
    return None


def detect_roles(df: DataFrame) -> RoleMap:
    """Role map for one frame; a header is metadata, so this reads only the schema."""
    cols = list(df.columns)
    return RoleMap(**{r: find_column(cols, kws) for r, kws in ROLE_KEYWORDS.items()})


def keyword_frame(spark: SparkSession) -> DataFrame:
    rows = [(r, i, k) for r, kws in ROLE_KEYWORDS.items() for i, k in enumerate(kws)]
    return spark.createDataFrame(rows, "role string, kw_pos int, keyword string")


def schema_catalog(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """`(table_name, pos, column_name)` for every column of the given frames."""
    rows = [(name, i, c) for name, df in frames.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string")


def normalize_headers(catalog: DataFrame) -> DataFrame:
    """P1 over a catalog: adds `normalized`."""
    return catalog.withColumn("normalized", normalize_text(F.col("column_name")))


def detect_roles_catalog(catalog: DataFrame) -> DataFrame:
    """P2/P3 for many tables at once: one row per table, one column per role (null = no match).

    The column×keyword match is a theta join on `contains`; the keyword relation is a fixed
    25-row table, so it is broadcast and the join never shuffles the catalog. The lowest
    column position wins, whatever the keyword order (frame order first).
    """
    spark = catalog.sparkSession
    kw = keyword_frame(spark).withColumn("kw_norm", normalize_text(F.col("keyword")))
    cat = normalize_headers(catalog)
    hits = cat.join(F.broadcast(kw), F.col("normalized").contains(F.col("kw_norm")), "inner")
    best = (hits.groupBy("table_name")
            .pivot("role", ROLES)
            .agg(F.min_by("column_name", "pos")))
    tables = cat.select("table_name").distinct()
    return tables.join(best, "table_name", "left").select("table_name", *ROLES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in frame order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def axis_columns(df: DataFrame) -> list[str]:
    """date/time or text columns, usable as a chart x axis."""
    keep = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, keep)]
