"""Choosing, scaling and reshaping columns of the long segment table (file, segment, start, end, name, value)."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from longwave.operators.stats import finite

#: Columns that never are descriptors, and the groups that views show first.
INDEX_COLUMNS = ("segment", "start", "end", "duration")
GROUP_ORDER = ("dynamics", "psycho", "spectral", "noisiness", "harmonic", "tonal")

#: The columns shown and the patterns compared when none are asked for.
DEFAULT_VIEW = (
    "dynamics.rms.mean",
    "spectral.centroid.mean",
    "spectral.flatness.mean",
    "spectral.flux.mean",
    "noisiness.zcr.mean",
    "psycho.loudness.mean",
    "psycho.sharpness.mean",
    "psycho.roughness.mean",
)
DEFAULT_FEATURES = (
    "spectral.*.mean",
    "spectral.*.stdev",
    "noisiness.*.mean",
    "mfcc.coeffs.mean.*",
    "mfcc.coeffs.stdev.*",
    "barkbands.*.mean",
    "psycho.sharpness.mean",
    "psycho.roughness.mean",
    "psycho.loudness.bark_centroid",
)

#: Columns of the batch extract and their short names.
BATCH_COLUMNS = (
    ("dynamics.rms.mean", "rms.mean"),
    ("spectral.centroid.mean", "centroid.mean"),
    ("spectral.flatness.mean", "flatness.mean"),
    ("spectral.flux.mean", "flux.mean"),
    ("psycho.loudness.mean", "loudness.mean"),
    ("psycho.sharpness.mean", "sharpness.mean"),
    ("psycho.roughness.mean", "roughness.mean"),
    ("dynamics.dynamic_complexity", "dynamics.dynamic_complexity"),
    ("spectral.crest.mean", "crest.mean"),
    ("spectral.complexity.mean", "complexity.mean"),
    ("noisiness.dissonance.mean", "dissonance.mean"),
    ("psycho.tonality.n_tones", "tonality.n_tones"),
    ("psycho.tonality.strongest_tone_Hz", "tonality.strongest_tone_Hz"),
    ("noisiness.f0.max", "f0.max"),
    ("dynamics.loudness_dB", "dynamics.loudness_dB"),
)


def descriptor_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c not in INDEX_COLUMNS]


def order_columns(columns: Iterable[str]) -> list[str]:
    present = list(columns)
    return [c for c in INDEX_COLUMNS if c in present] + sorted(descriptor_columns(present))


def glob_select(names: Sequence[str], patterns: Sequence[str] | None = None, default: Sequence[str] = DEFAULT_VIEW) -> list[str]:
    """Names by pattern, in the patterns' order; an exact name wins, else matches come sorted; no repeats."""
    known, out = set(names), []
    for pattern in patterns or default:
        matches = [pattern] if pattern in known else sorted(n for n in known if fnmatch.fnmatchcase(n, pattern))
        out += [m for m in matches if m not in out]
    return out


def select_names(table: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, name) of the table's names that the patterns choose."""
    names = [r["name"] for r in table.select("name").distinct().collect()]
    chosen = glob_select(names, patterns)
    return table.sparkSession.createDataFrame(list(enumerate(chosen)), "ordinal long, name string")


def group_listing(names: DataFrame) -> DataFrame:
    """Groups (first dotted part) of distinct names with their sizes, in the order of views."""
    group = F.split("name", r"\.")[0]
    counted = names.select("name").distinct().groupBy(group.alias("group")).agg(F.count("*").alias("n"))
    place = F.lit(len(GROUP_ORDER))
    for k, g in reversed(list(enumerate(GROUP_ORDER))):
        place = F.when(F.col("group") == g, k).otherwise(place)
    # A row per group: the window is over a handful of rows.
    return counted.withColumn("ordinal", F.row_number().over(Window.orderBy(place, "group")).cast("long"))


def usable_features(table: DataFrame) -> DataFrame:
    """(file, name) of features that every segment has, all finite, not all equal; errors are left to callers."""
    per_file = table.groupBy("file").agg(F.countDistinct("segment").alias("rows"))
    per_name = table.groupBy("file", "name").agg(
        F.count(F.when(finite(F.col("value")), 1)).alias("good"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    return per_name.join(per_file, "file").where("good = rows AND hi > lo").select("file", "name")


def standardise(table: DataFrame, sent: Callable[[DataFrame], DataFrame] = lambda names: names) -> DataFrame:
    """(file, segment, name, z) of the usable features: population mean 0 and deviation 1 per file.

    ``sent`` is how tables of one row per file and name are joined: with ``F.broadcast``, which is for few of them, no value is shuffled by name.
    """
    used = table.join(sent(usable_features(table)), ["file", "name"])
    moments = used.groupBy("file", "name").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return used.join(sent(moments), ["file", "name"]).select("file", "segment", "name", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


def overlay(table: DataFrame, keys: Sequence[str] = ("file",), most: int | None = None) -> DataFrame:
    """value as a z-score within keys; 0 where all values are equal.  More than ``most`` names are an error: they would hide each other."""
    if most is not None and len(table.select("name").distinct().limit(most + 1).collect()) > most:
        raise ValueError(f"at most {most} series can be laid over each other")
    by = Window.partitionBy(*keys)
    s = F.stddev_pop("value").over(by)
    return table.withColumn("z", F.when(s > 0, (F.col("value") - F.avg("value").over(by)) / s).otherwise(0.0))


def by_start() -> WindowSpec:
    return Window.partitionBy("file").orderBy("start")


def rolling_median(table: DataFrame, rows: int, keys: Sequence[str] = ("file",), order: str = "i", into: str = "median") -> DataFrame:
    """The median of ``rows`` neighbouring rows, centred; non-finite values do not count."""
    value = F.when(finite(F.col("value")), F.col("value"))
    if rows <= 1:
        return table.withColumn(into, F.col("value"))
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1 - (rows - 1) // 2), (rows - 1) // 2)
    return table.withColumn(into, F.percentile(value, F.lit(0.5)).over(by))


def step_trace(table: DataFrame) -> DataFrame:
    """Two rows per segment, at its start and its end, for drawing steps."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("start").alias("t")), F.struct(F.lit(1).alias("pos"), F.col("end").alias("t"))))
    return table.withColumn("p", ends).select("file", "segment", "p.pos", "p.t", F.col("value").alias("v"))


def project(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """file, segment, start, end, duration and the columns of (name, short name) pairs; missing ones are null."""
    lead = [c for c in ("file", *INDEX_COLUMNS) if c in wide.columns]
    return wide.select(*lead, *((F.col(f"`{a}`") if a in wide.columns else F.lit(None).cast("double")).alias(b) for a, b in pairs))


def asof_segment(times: DataFrame, segments: DataFrame) -> DataFrame:
    """times (file, t) with the last segment that starts at or before t, 0 before the first.

    Both sides are merged in time order per file, so that nothing is compared pairwise.
    """
    marks = segments.select("file", F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("segment"))
    asked = times.select("file", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("segment"))
    by = Window.partitionBy("file").orderBy("t", "kind", "segment").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).withColumn("segment", F.last("segment", ignorenulls=True).over(by))
    return met.where("kind = 1").select("file", "t", F.coalesce("segment", F.lit(0)).cast("long").alias("segment"))


def merge_runs(labelled: DataFrame, order: str = "start") -> DataFrame:
    """Consecutive rows of one cluster in a file as one run (file, run, start, end, cluster)."""
    by = Window.partitionBy("file").orderBy(order)
    changed = F.coalesce((F.col("cluster") != F.lag("cluster").over(by)).cast("int"), F.lit(0))
    runs = labelled.withColumn("c", changed).withColumn("run", F.sum("c").over(by))
    return runs.groupBy("file", "run").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.first("cluster").alias("cluster"))


def change_points(labelled: DataFrame, order: str = "start") -> DataFrame:
    by = Window.partitionBy("file").orderBy(order)
    return labelled.withColumn("before", F.lag("cluster").over(by)).where("before <> cluster").drop("before")
