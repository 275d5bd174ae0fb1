"""Aggregations: frame statistics, duration-weighted summaries, rollups per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statistics known by name, in the order of the configuration.
STATS = ("mean", "stdev", "median", "min", "max", "dmean", "dvar", "var", "dmean2", "dvar2")
DEFAULT_STATS = STATS[:7]
#: Statistics of vectors as a whole: their covariance matrix and its inverse, row by row.
VECTOR_STATS = ("cov", "icov")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _aggregate(stat: str) -> Column:
    made = {
        "mean": F.avg("value"),
        "stdev": F.stddev_pop("value"),
        "var": F.var_pop("value"),
        "median": F.percentile("value", F.lit(0.5)),
        "min": F.min("value"),
        "max": F.max("value"),
        "dmean": F.avg(F.abs("__d1")),
        "dvar": F.var_pop("__d1"),
        "dmean2": F.avg(F.abs("__d2")),
        "dvar2": F.var_pop("__d2"),
    }
    if stat not in made:
        raise ValueError(f"unknown statistic {stat!r}; known: {', '.join(STATS)}")
    return made[stat]


def frame_stats(values: DataFrame, stats: Sequence[str] = DEFAULT_STATS, keys: Sequence[str] = ("file", "segment", "name"), order: str = "frame") -> DataFrame:
    """Long form: keys with ``name`` extended by the statistic, and ``value``.

    Derivatives are differences between neighbouring frames of one key; dmean is the mean of their
    absolute values, dvar their population variance, and the second ones likewise.
    """
    if any(s.startswith("d") for s in stats):
        by = Window.partitionBy(*keys).orderBy(order)
        values = values.withColumn("__d1", F.col("value") - F.lag("value").over(by))
        if any(s.endswith("2") for s in stats):
            values = values.withColumn("__d2", F.col("__d1") - F.lag("__d1").over(by))
    wide = values.groupBy(*keys).agg(*(_aggregate(s).alias(s) for s in stats))
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats))).alias("p")
    others = [k for k in keys if k != "name"]
    # Components of a vector keep their index last: name.stat.index.
    base, index = F.regexp_extract("name", r"^(.*?)((?:\.\d+)?)$", 1), F.regexp_extract("name", r"^(.*?)((?:\.\d+)?)$", 2)
    named = F.concat(base, F.lit("."), F.col("p.stat"), index)
    return wide.select(*others, "name", pairs).select(*others, named.alias("name"), F.col("p.value").alias("value"))


def vector_covariance(values: DataFrame, keys: Sequence[str] = ("file", "segment")) -> DataFrame:
    """(keys, base, i, j, cov): population covariances of the components of vectors, base.i and base.j, over the frames of a key."""
    parts = values.select(*keys, "frame", F.regexp_extract("name", r"^(.*)\.(\d+)$", 1).alias("base"), F.regexp_extract("name", r"^(.*)\.(\d+)$", 2).alias("i"), "value").where("base <> ''")
    vectors = parts.groupBy(*keys, "base", "frame").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "value")).alias("v"))
    # A frame's vector is one row, so that its pairs need no join.
    pairs = vectors.select(*keys, "base", F.explode("v").alias("a"), "v").select(*keys, "base", "a", F.explode("v").alias("b"))
    return pairs.groupBy(*keys, "base", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.covar_pop("a.value", "b.value").alias("cov"))


def weighted_summary(table: DataFrame) -> DataFrame:
    """Per file and name the duration-weighted mean and deviation over finite values of (file, name, duration, value).

    Two passes: the deviation is taken from the mean, not from a difference of large sums.
    """
    kept = table.where(finite(F.col("value"))).withColumn("w", F.greatest("duration", F.lit(1e-9)))
    means = kept.groupBy("file", "name").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("wmean"))
    off = F.col("value") - F.col("wmean")
    return kept.join(means, ["file", "name"]).groupBy("file", "name").agg(F.max("wmean").alias("wmean"), F.sqrt(F.sum(F.col("w") * off * off) / F.sum("w")).alias("wstdev"))


def piece_durations(segments: DataFrame) -> DataFrame:
    d = F.col("duration")
    return segments.groupBy("file").agg(
        F.count("*").alias("n_segments"), F.sum(F.greatest(d, F.lit(1e-9))).alias("total_duration"),
        F.avg(d).alias("mean"), F.stddev_pop(d).alias("stdev"), F.min(d).alias("min"), F.max(d).alias("max"),
    )


#: Fixed value: what counts as a number in a table of texts.
NUMERIC = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def file_rollup(table: DataFrame, names: Sequence[str], duration: str = "duration") -> DataFrame:
    """Per file: rows, span from first start to last end, and weighted means over cells that are numbers.

    Cells may be texts; a duration that is no number weighs nothing; no weight at all gives null.
    """
    number = lambda c: F.when(is_numeric(F.col(c).cast("string")), F.col(c).cast("double"))
    weight = F.coalesce(number(duration), F.lit(0.0))
    means = []
    for name in names:
        total = F.sum(F.when(number(name).isNotNull(), weight))
        means.append(F.when(total != 0, F.sum(number(name) * weight) / total).alias(name))
    return table.groupBy("file").agg(F.count("*").alias("n_segments"), (F.max("end") - F.min("start")).alias("duration"), *means)


def cluster_report(assigned: DataFrame) -> DataFrame:
    """Per cluster of (cluster, duration, silhouette): rows, seconds, share in percent, mean silhouette."""
    per = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.avg("silhouette").alias("mean_s"))
    # A row per cluster: the window is over a handful of rows.
    return per.withColumn("share", 100 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))


def column_ranges(table: DataFrame, margin: float = 0.06) -> DataFrame:
    """Finite range of each name's values, widened for plotting; names without finite values are left out."""
    r = table.where(finite(F.col("value"))).groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    r = r.select("name", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    room = (F.col("hi") - F.col("lo")) * margin
    return r.select("name", (F.col("lo") - room).alias("lo"), (F.col("hi") + room).alias("hi"))
