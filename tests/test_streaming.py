from pyspark.sql import functions as F

from lithospark.streaming.summaries import windowed_summary

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed_summary(stream, "ts", "value", "1 day", "60 days", "event_type")
    query = out.writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("windows").groupBy("start", "event_type").agg(F.max("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))
    whole = windowed_summary(events, "ts", "value", "1 day", "60 days", "event_type").select("start", "event_type", "n", "min", "max")
    assert whole.count() > 100 and last.exceptAll(whole).count() == whole.exceptAll(last).count() == 0
