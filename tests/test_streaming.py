from pyspark.sql import functions as F

from longwave.streaming import windows


def test_windows_and_sessions(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("file"), "value")
    events.write.parquet(str(tmp_path / "in"))
    for name, build in (("w", lambda s: windows.windowed_stats(s, "1 day")), ("s", lambda s: windows.sessions(s, "6 hours"))):
        stream = build(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        total = spark.table(f"out_{name}").agg(F.sum("n")).first()[0]
        assert total == events.count() if name == "w" else 0 < total <= events.count()
