"""Readers for the driver tables and the derived views the queries run on.

`sales` is the star join that stands in for an uploaded sales file:
lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sales(order_date, revenue, product, region, quantity)`, one row per lineitem.

    Join order keeps the big sides on sort-merge/shuffle-hash joins keyed by their own
    keys (lineitem–orders on the order key, then part on the part key); Spark broadcasts the
    25-row nation⋈region geography by its size. Every projection is declared before the
    joins so the scans read only the needed columns.
    """
    t = lambda n: table(spark, sf_dir, n)
    geo = (t("nation").select("n_nationkey", "n_regionkey")
           .join(t("region").select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    cust = (t("customer").select("c_custkey", "c_nationkey")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "r_name"))
    orders = (t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "o_orderdate", "r_name"))
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    part = t("part").select("p_partkey", "p_name")
    return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_orderdate").alias("order_date"),
                    exact_revenue(F.col("l_extendedprice"), F.col("l_discount")).alias("revenue"),
                    F.col("p_name").alias("product"),
                    F.col("r_name").alias("region"),
                    F.col("l_quantity").alias("quantity")))


def exact_revenue(price, discount):
    """price × (1 − discount) from whole cents and whole discount points.

    Prices carry two decimals and discounts two, so the product is an exact multiple of
    1e-4; computing it from integers gives the same double in every engine.
    """
    return (F.round(price * 100) * (100 - F.round(discount * 100))) / F.lit(10000.0)


def sales_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sales` plus an actual `Profit` column (revenue × 0.34) for the actual-profit branch."""
    return sales(spark, sf_dir).withColumn("Profit", F.col("revenue") * F.lit(0.34))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text upload built from `orders` by `o_orderkey % k` (integers only, no float text).

    Columns in frame order: order_id, invoice_date, amount, item, market, units — each maps to
    exactly one role under the keyword rule.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    amt = F.floor(F.col("o_totalprice")).cast("bigint")
    grouped = F.format_number(amt, 0)
    amount = (F.when(k % 10 == 0, F.concat(F.lit("$"), grouped))
              .when(k % 10 == 1, F.concat(F.lit("Rs. "), grouped))
              .when(k % 10 == 2, F.concat(F.lit("("), grouped, F.lit(")")))
              .when(k % 10 == 3, F.lit(""))
              .when(k % 10 == 4, F.lit(None).cast("string"))
              .when(k % 10 == 5, F.concat(amt.cast("string"), F.lit("%")))
              .when(k % 10 == 6, F.concat(F.lit("-$"), amt.cast("string")))
              .when(k % 10 == 7, F.lit("n/a"))
              .otherwise(amt.cast("string")))
    d = F.col("o_orderdate")
    invoice_date = (F.when(k % 9 == 0, F.date_format(d, "MM/dd/yyyy"))
                    .when(k % 9 == 1, F.lit("bad"))
                    .when(k % 9 == 2, F.lit(None).cast("string"))
                    .when(k % 9 == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
                    .otherwise(F.date_format(d, "yyyy-MM-dd")))
    item = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
    market = (F.when(k % 13 == 0, F.lit(None).cast("string"))
              .when(k % 13 == 1, F.lit(""))
              .otherwise(F.col("o_orderstatus")))
    units = (F.when(k % 6 == 0, F.lit("1,200"))
             .when(k % 6 == 1, F.lit(None).cast("string"))
             .when(k % 6 == 2, F.lit("x"))
             .otherwise((F.col("o_custkey") % 50).cast("string")))
    return o.select(k.alias("order_id"), invoice_date.alias("invoice_date"), amount.alias("amount"),
                    item.alias("item"), market.alias("market"), units.alias("units"))


#: Text layouts of `dated_orders`, by `o_orderkey % len`; the last three: no date, null, day first
#: where the day tells (else month first).
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM", "d-MMM-yyyy", "M/d/yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'",
                "yyyy-MM-dd HH:mm:ss.SSS", "yyyyMMdd", "MMM d, yyyy", "EEEE, MMMM d, yyyy", "yyyy/M/d", "d MMMM yyyy",
                "MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss+05:30", "yyyy-MM-dd hh:mm a", "yyyy.MM.dd", "?", "null", "dd/MM/yyyy")


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` with its date written in one of `DATE_LAYOUTS`: order_id, layout, order_date, amount."""
    o = table(spark, sf_dir, "orders")
    layout = (F.col("o_orderkey") % len(DATE_LAYOUTS)).cast("int")
    d = F.col("o_orderdate")
    text = F.lit(None).cast("string")
    for i, name in enumerate(DATE_LAYOUTS):
        if name == "?":
            written = F.lit("soon")
        elif name == "null":
            continue
        elif name == "dd/MM/yyyy":
            written = F.when(F.dayofmonth(d) > 12, F.date_format(d, name)).otherwise(F.date_format(d, "MM/dd/yyyy"))
        else:
            written = F.date_format(d, name)
        text = F.when(layout == i, written).otherwise(text)
    return o.select(F.col("o_orderkey").alias("order_id"), layout.alias("layout"), text.alias("order_date"),
                    F.floor("o_totalprice").cast("bigint").alias("amount"))


def nan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as an upload whose revenue and quantity hold nulls and NaN."""
    o = table(spark, sf_dir, "orders")
    k, nan = F.col("o_orderkey"), F.lit(float("nan"))
    return o.select(k.alias("order_id"), F.to_date("o_orderdate").alias("order_date"),
                    F.when(k % 5 == 0, nan).when(k % 5 == 1, F.lit(None)).otherwise(F.floor("o_totalprice").cast("double")).alias("revenue"),
                    F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("region"),
                    F.when(k % 7 == 0, nan).otherwise((k % 50).cast("double")).alias("quantity"))


def dotted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as an upload with dots in its headers."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order.key"), F.to_date("o_orderdate").alias("Order.Date"),
                    F.concat(F.lit("$"), F.floor("o_totalprice").cast("bigint").cast("string")).alias("Net.Amount"),
                    F.col("o_orderpriority").alias("Item.Type"), F.col("o_orderstatus").alias("Market.Area"),
                    (F.col("o_orderkey") % 9).cast("string").alias("Units.Sold"))


def odd_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up batch in which three of five emails are null, blank or without '@'."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = (F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("   ")).when(k % 5 == 2, F.lit("nobody"))
             .when(k % 5 == 3, F.concat(F.lit("User"), (k % 20).cast("string"), F.lit("@Example.net ")))
             .otherwise(user_email(F.col("c_name"))))
    return c.select(k.alias("request_id"), email.cast("string").alias("email_raw"), F.lit(" Viewer").alias("role_raw"))


def events_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` seen as a sales upload: `event_time, value, event_type` (30 days of January 2024)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("event_time"), F.col("value").alias("value"),
                    F.col("event_type").alias("event_type"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a session table: one session per event, expiring seven days after `ts`."""
    from ..operators.users import expiry
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.lit("tok-"), F.col("event_id").cast("string")).alias("token"),
                    F.col("user_id"),
                    F.col("ts").alias("created_at"),
                    expiry(F.col("ts")).alias("expires_at"))


def user_email(name: F.Column, domain: str | F.Column = "example.com") -> F.Column:
    dom = F.lit(domain) if isinstance(domain, str) else domain
    return F.concat(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", ".")), F.lit("@"), dom)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as the user table (credential columns are not modelled)."""
    c = table(spark, sf_dir, "customer")
    seg = F.lower(F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), user_email(F.col("c_name")).alias("email"),
                    F.when(seg == "building", "admin").when(seg == "machinery", "analyst")
                    .otherwise("viewer").alias("role"))


def signup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up batch from `customer`: mixed-case padded emails, some without '@' or empty,
    building-segment customers on the existing domain, free-text roles."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    domain = F.when(F.lower(F.col("c_mktsegment")) == "building", "example.com").otherwise("example.org")
    good = F.concat(F.lit(" "), F.upper(user_email(F.col("c_name"), domain)), F.lit(" "))
    email = (F.when(k % 11 == 0, F.lit("  "))
             .when(k % 7 == 0, F.regexp_replace(good, "@", " at "))
             .otherwise(good))
    role = F.when(k % 3 == 0, F.lit(" Admin ")).when(k % 3 == 1, F.lit("analyst")).otherwise(F.col("c_mktsegment"))
    return c.select(k.alias("request_id"), email.alias("email_raw"), role.alias("role_raw"))
