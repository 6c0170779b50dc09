"""Scale helpers: distributed row index, linear calendar fill, top-k with a hot key."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import kpi as K
from ledgerlens.operators import series as S
from ledgerlens.plans.ordering import with_row_index
from ledgerlens.plans.topk import group_top_k


def test_row_index_is_consecutive_across_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    out = with_row_index(df, ["k"], "i").collect()
    assert sorted(r.i for r in out) == list(range(1000))
    assert all(r.i == r.k for r in out) and out[0].row_total == 1000


def test_calendar_values_fill_gaps(spark):
    d0 = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", d0, 1.0), ("a", d0 + dt.timedelta(days=3), 4.0)], "g string, ds date, y double")
    cal = S.segment_calendar(df, ["g"]).first()
    assert cal.ys == [1.0, 0.0, 0.0, 4.0] and cal.n_days == 4 and cal.days[-1] == d0 + dt.timedelta(days=3)


def test_hot_key_top_k_and_kpis(spark):
    # one product holds a third of the rows
    rows = [("hot" if i % 3 == 0 else f"p{i % 50}", "r", float(i % 17 + 1)) for i in range(3000)]
    df = (spark.createDataFrame(rows, "Product string, Region string, Revenue double")
          .withColumn("Date", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.monotonically_increasing_id() % 90).cast("int")))
          .withColumn("Quantity", F.lit(1.0)))
    top = group_top_k(df, ["Product"], [F.col("Revenue").desc(), F.col("Date")], 3).where("Product = 'hot'").collect()
    assert [r.Revenue for r in top] == [17.0, 17.0, 17.0]
    k = K.calculate_kpis(df).first()
    hot_total = sum(r[2] for r in rows if r[0] == "hot")
    assert k.top_product == "hot" and abs(k.top_product_revenue - hot_total) < 1e-6
    assert k.total_records == 3000 and k.unique_products == 51
