"""Queries over stored, mergeable KPI states: date ranges and batches, answered without the raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as KPI
from ..operators import kpi_state as ST
from ..sources import files as FS
from . import catalog as K
from .oracle_sql import CLEAN_SALES, with_
from .registry import query, rounded

_FROM, _TO = "1994-03-15", "1996-08-20"
_RANGE = CLEAN_SALES + f""",
ranged AS (SELECT * FROM clean WHERE "Date" BETWEEN DATE '{_FROM}' AND DATE '{_TO}')"""


@query("kpi_state_date_range", oracle=K._kpi_sql(_RANGE, "ranged", ["Region"], K._ALL))
def q_kpi_state_date_range(spark, sf):
    """The KPI record per region of a date range, merged from states kept by year and day range."""
    path = FS.scratch_path(spark, "kpi-states")
    ST.write_states(ST.daily_states(K.clean_sales_view(spark, sf)), path)
    states = ST.read_states(spark, path, _FROM, _TO)
    return rounded(KPI.kpis_from_states(states, ["Region"]).select("Region", *K._ALL), K.R, K._KPI_DIGITS)


@query("kpi_state_batches", oracle=K._kpi_sql(CLEAN_SALES, "clean", ["Product"], K._ALL))
def q_kpi_state_batches(spark, sf):
    """Two batches that share products, regions and days, appended one after the other: the record equals
    that of all rows at once."""
    path = FS.scratch_path(spark, "kpi-states")
    clean = K.clean_sales_view(spark, sf)
    for part in (0, 1):
        ST.write_states(ST.daily_states(clean.where(F.pmod(F.col("Quantity").cast("int"), F.lit(2)) == part)), path)
    return rounded(KPI.kpis_from_states(ST.read_states(spark, path), ["Product"]).select("Product", *K._ALL), K.R, K._KPI_DIGITS)


@query("kpi_state_cells", oracle=with_(CLEAN_SALES) + """
SELECT "Product", "Region", CAST(year("Date") AS INTEGER) AS year, count(*) AS n,
       """ + ", ".join(f"{K.rnd_sql(e)} AS {c}" for e, c in (
           ('sum("Revenue")', "total"), ('avg("Revenue")', "mean"),
           ('CASE WHEN count(*) > 1 THEN stddev_samp("Revenue") END', "std"))) + """,
       min("Date") AS first_ds, max("Date") AS last_ds
FROM clean GROUP BY ALL""")
def q_kpi_state_cells(spark, sf):
    """Day states merged to (Product, Region, year): count, sum, mean, deviation and days of every cell."""
    states = ST.write_states(ST.daily_states(K.clean_sales_view(spark, sf)))
    merged = ST.merge_states(states.withColumn("year", F.year("Date")), ["Product", "Region", "year"])
    out = merged.withColumn("std", ST.std_samp(F.col("n"), F.col("m2")))
    return rounded(out.select("Product", "Region", "year", "n", "total", "mean", "std", "first_ds", "last_ds"), K.R)
