"""Streaming ingest: the batch cleaner and daily revenue over a file stream."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import clean as C
from ledgerlens.operators import series as S
from ledgerlens.sources import tables as TB
from ledgerlens.streaming import uploads as U


def test_stream_matches_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    raw = TB.raw_orders(spark, SF_SMALL)
    raw.repartition(4).write.option("header", True).csv(src)
    stream = U.upload_stream(spark, src, raw.schema, "csv", max_files_per_trigger=1)
    daily = U.daily_revenue_stream(U.clean_stream(stream), ["Region"])
    q = (daily.writeStream.outputMode("complete").format("memory").queryName("daily_stream")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.Region, r.ds): round(r.y, 4) for r in spark.table("daily_stream").collect()}
    batch = S.daily(C.clean_sales(spark.read.option("header", True).schema(raw.schema).csv(src))[0], ["Region"])
    want = {(r.Region, r.ds): round(r.y, 4) for r in batch.collect()}
    assert got == want and len(got) > 100
