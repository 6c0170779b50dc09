"""Cleaner, schema mapping and formatting edge cases (FIXTURES.md §4, SURVEY §1.3)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dates import calendar_columns, to_day
from ledgerlens.functions.numeric import parse_amount, strict_number
from ledgerlens.functions.text import currency, fixed, normalize_name
from ledgerlens.operators import clean as C
from ledgerlens.operators import schema_map as M


def _col(spark, values, f, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_amount_parse(spark):
    got = _col(spark, ["$1,200", "-$5", "12%", "(1,200)", "Rs. 5,000", "1e5", "1-2", "1.2.3", "-", "", None],
               parse_amount)
    assert got == [1200.0, -5.0, 12.0, 1200.0, 0.5, 15.0, None, None, None, None, None]


def test_quantity_strict(spark):
    assert _col(spark, ["1,200", "5", " 7 ", "1d", "x"], strict_number) == [None, 5.0, 7.0, None, None]


def test_date_parse_format_list(spark):
    got = _col(spark, ["2024-01-15", "01/16/2024", "bad", "2024-02-30"], lambda c: to_day(c, T.StringType()))
    assert got == [dt.date(2024, 1, 15), dt.date(2024, 1, 16), None, None]


def test_iso_week_and_names(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2023, 1, 1),)], "d date")
    rows = df.select(*[e.alias(n) for n, e in calendar_columns(F.col("d")).items()]).collect()
    assert [r.Week for r in rows] == [1, 52]
    assert rows[0].Month == "Dec" and rows[0].Quarter == "Q4" and rows[0].Day == "Monday"


def test_currency_and_one_decimal(spark):
    assert _col(spark, [2.5, 3.5, -1234.5], currency, "double") == ["$2", "$4", "$-1,234"]
    assert _col(spark, [0.25, 0.35], lambda c: fixed(c, 1), "double") == ["0.2", "0.3"]


def test_role_detection_frame_order():
    assert M.find_column(["Country", "Qty"], M.ROLE_KEYWORDS["quantity_col"]) == "Country"
    assert M.find_column(["Country", "Qty"], M.ROLE_KEYWORDS["region_col"]) == "Country"
    assert M.find_column(["sentiment", "order date"], M.ROLE_KEYWORDS["date_col"]) == "sentiment"
    assert normalize_name("  Net Sales ($) ") == "net_sales"


def test_role_catalog_matches_driver_rule(spark):
    frames = {"t1": spark.createDataFrame([], "Country string, Qty int, `Product Sales` double"),
              "t2": spark.createDataFrame([], "id int, note string")}
    out = {r.table_name: r for r in M.detect_roles_catalog(M.schema_catalog(spark, frames)).collect()}
    assert out["t1"].quantity_col == "Country" and out["t1"].region_col == "Country"
    assert out["t1"].product_col == "Product Sales" and out["t1"].revenue_col == "Product Sales"
    assert out["t2"].date_col is None and out["t2"].revenue_col is None


def test_clean_fills_and_fallbacks(spark):
    raw = spark.createDataFrame(
        [("2024-01-15", "$1,200", None, "", "3"), ("bad", "5", "A", "B", "1,200"), ("2024-01-16", None, "A", None, None)],
        "`order date ` string, amount string, product string, region string, qty string")
    out, roles = C.clean_sales(raw)
    assert roles.date_col == "order date" and roles.quantity_col == "qty"
    rows = sorted(out.collect(), key=lambda r: r.Date)
    assert len(rows) == 2                                   # the bad date is dropped
    assert rows[0].Revenue == 1200.0 and rows[0].Product == "Unknown" and rows[0].Region == ""
    assert rows[1].Revenue == 0.0 and rows[1].Region == "Unknown" and rows[1].Quantity == 0.0


def test_revenue_fallback_first_numeric(spark):
    raw = spark.createDataFrame([(7, "x", 2.0)], "id int, label string, price double")
    out, roles = C.clean_sales(raw, as_of="2024-01-31", order_by=["id"])
    r = out.collect()[0]
    assert roles.revenue_col is None and r.Revenue == 7.0 and r.Date == dt.date(2024, 1, 31)


def test_date_fallback_consecutive_days(spark):
    raw = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, v double")
    out, _ = C.clean_sales(raw, as_of="2024-03-10", order_by=["k"])
    got = {r.k: r.Date for r in out.collect()}
    assert got[9] == dt.date(2024, 3, 10) and got[0] == dt.date(2024, 3, 1)


def test_segment_filter_and_fallback(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "Region string, Revenue double")
    assert C.segment_filter(df, "Region", "A").count() == 1
    assert C.segment_filter(df, "None", "A").count() == 2
    assert C.segment_filter(df, "Missing", "A").count() == 2
    assert C.filter_or_all(df, "Region", "Z").count() == 2
    assert C.filter_or_all(df, "Region", "B").count() == 1
    vals = [r.value for r in C.filter_values(df, "Region").collect()]
    assert vals == ["All", "A", "B"]


def test_upload_guards(spark):
    import pytest
    full = spark.createDataFrame([("2024-01-02", "5"), ("bad", "7")], "order_date string, revenue string")
    assert C.clean_upload(full)[0].count() == 1
    with pytest.raises(ValueError, match="empty"):
        C.clean_upload(full.limit(0))
    with pytest.raises(ValueError, match="No usable rows"):
        C.clean_upload(full.where("order_date = 'bad'"))
