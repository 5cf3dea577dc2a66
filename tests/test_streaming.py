"""The composite on a stream of the events' files against the same windows in batch."""

from pyspark.sql import functions as F

from furrow.session import fresh_path, table
from furrow.streaming import composite_stream


def test_composite_stream(spark, small):
    events = table(spark, small, "events").select((F.col("user_id") % 7).alias("pixel_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    path = fresh_path(spark, "events")
    events.repartition(3).write.parquet(path)
    stream = composite_stream(spark.readStream.schema(events.schema).parquet(path), days=2, late="40 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("composites").option("checkpointLocation", fresh_path(spark, "stream")).start()
    query.processAllAvailable()
    query.stop()
    want = composite_stream(events, days=2).select("pixel_id", "start", F.round("mean", 6), "n")
    got = spark.table("composites").select("pixel_id", "start", F.round("mean", 6), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
