"""The relational test tables read as signals: samples, bounds, frames, segment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longwave.operators import slicing, stats

DAY = 86400.0
#: Samples per second that event indices are read with, and the file of a table that is one piece.
EVENT_RATE, WHOLE = 0.01, "all"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (event type), i, t (seconds since the file's first event), x."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy("event_type")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", us.alias("us"), "value")
    return e.select(
        F.col("event_type").alias("file"),
        (F.row_number().over(by.orderBy("us", "event_id")) - 1).cast("long").alias("i"),
        ((F.col("us") - F.min("us").over(by)) / F.lit(1e6)).alias("t"),
        F.col("value").alias("x"),
    )


def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by_type = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("file"))
    return by_type.agg(((F.max(us) - F.min(us)) / F.lit(1e6)).alias("total"))


def user_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (user), ord, start, end: from each event of a user to the next one, in whole milliseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", us.alias("us"))
    e = e.select(
        F.col("user_id").cast("string").alias("file"),
        (F.row_number().over(by.orderBy("us", "event_id")) - 1).cast("long").alias("ord"),
        (F.col("us") - F.min("us").over(by)).alias("us"),
        (F.lead("us").over(by.orderBy("us", "event_id")) - F.min("us").over(by)).alias("next"),
    )
    seconds = lambda c: F.expr(f"{c} div 1000") / F.lit(1e3)
    return e.select("file", "ord", seconds("us").alias("start"), seconds("next").alias("end")).where("end > start")


def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_bounds(spark, sf_dir).groupBy("file").agg(F.max("end").alias("total"))


def daily_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant chop of the event files by days: file, segment, start, end, duration."""
    bounds = slicing.fixed(event_totals(spark, sf_dir), DAY)
    return bounds.select("file", F.col("ord").alias("segment"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample values by daily segment as frames: file, segment, start, end, duration, name, frame, value."""
    met = slicing.sample_slices(event_samples(spark, sf_dir), daily_segments(spark, sf_dir), EVENT_RATE)
    return met.select("file", "segment", "start", "end", "duration", F.lit("events.value").alias("name"), F.col("i").alias("frame"), F.col("x").alias("value"))


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long segment table: file, segment, start, end, duration, name, value."""
    keys = ("file", "segment", "start", "end", "duration", "name")
    return stats.frame_stats(daily_values(spark, sf_dir), ("mean", "stdev", "median", "min", "max"), keys)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One piece of all embeddings: file, segment, v (doubles), cluster."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(WHOLE).alias("file"), F.col("vec_id").alias("segment"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("label") + 1).alias("cluster"))


def embedding_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute components read as magnitudes; frames of a label follow each other."""
    rows = embedding_rows(spark, sf_dir)
    return rows.select(F.lit(WHOLE).alias("file"), "segment", F.transform("v", F.abs).alias("m"))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features: file, segment, name (f00 ..), value."""
    pairs = F.posexplode("v").alias("k", "value")
    return embedding_rows(spark, sf_dir).select("file", "segment", pairs).select("file", "segment", F.format_string("f%02d", "k").alias("name"), "value")
