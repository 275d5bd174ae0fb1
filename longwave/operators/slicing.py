"""Slicing the time axis of files into segments.

Inputs are keyed by ``file``; nothing here looks across files, so every window is partitioned by it.
Times are seconds as doubles.  Bounds carry ``ord``, their place in the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register(name: str) -> Callable[[Strategy], Strategy]:
    """Make a strategy available by name; it takes totals (file, total) first and returns bounds."""

    def keep(strategy: Strategy) -> Strategy:
        _STRATEGIES[name] = strategy
        return strategy

    return keep


def strategies() -> list[str]:
    return sorted(_STRATEGIES)


def strategy(name: str) -> Strategy:
    if name not in _STRATEGIES:
        raise ValueError(f"unknown segmentation method {name!r}; known: {', '.join(strategies())}")
    return _STRATEGIES[name]


def _in_order(*order: str):
    return Window.partitionBy("file").orderBy(*order)


def _numbered(bounds: DataFrame, *order: str) -> DataFrame:
    return bounds.select("file", (F.row_number().over(_in_order(*order)) - 1).cast("long").alias("ord"), "start", "end")


@register("fixed")
def fixed(totals: DataFrame, window: float, hop: float | None = None, drop_last_partial: bool = True) -> DataFrame:
    """A constant grid.  Starts are running sums of the hop, not its multiples, which differ in floating point."""
    hop = hop or window
    grid = totals.where("total > 0").select("file", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / hop).cast("int"))).alias("k"))
    before = _in_order("k").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("start", F.coalesce(F.sum(F.lit(float(hop))).over(before), F.lit(0.0)))
    last_end = F.lag("start").over(_in_order("k")) + window
    more = (F.col("start") + window <= F.col("total")) if drop_last_partial else (F.col("start") < F.col("total")) & (last_end < F.col("total"))
    grid = grid.withColumn("keep", (F.col("k") == 0) | more).where("keep")
    return grid.select("file", F.col("k").cast("long").alias("ord"), "start", F.least(F.col("start") + window, "total").alias("end"))


def between_edges(edges: DataFrame) -> DataFrame:
    """Bounds between neighbouring distinct edges (file, t)."""
    edges = edges.select("file", F.round("t", 6).alias("start")).distinct()
    pairs = edges.withColumn("end", F.lead("start").over(_in_order("start"))).where("end > start")
    return _numbered(pairs, "start")


@register("onset")
def onset(totals: DataFrame, onsets: DataFrame, include_lead: bool = True) -> DataFrame:
    """Segments between onsets (file, t); the part before the first onset counts if asked for or if there is none."""
    inner = onsets.join(totals, "file").where("t > 0 AND t < total").select("file", "t")
    ends = totals.select("file", F.col("total").alias("t"))
    lead = totals.select("file", F.lit(0.0).alias("t"))
    if not include_lead:
        lead = lead.join(inner.select("file").distinct(), "file", "left_anti")
    return between_edges(inner.unionByName(ends).unionByName(lead))


@register("markers")
def markers(totals: DataFrame, marks: DataFrame, offset: float = 0.0) -> DataFrame:
    """Segments from marks (file, start, end): a file whose ends are all missing holds points, else intervals."""
    ends_missing = F.col("end").isNull() | F.isnan("end")
    kinds = marks.groupBy("file").agg(F.min(ends_missing).alias("points"))
    known = marks.join(kinds, "file").join(totals, "file")
    points = known.where("points").select("file", (F.col("start") - offset).alias("t"), "total").where("t > 0 AND t < total").select("file", "t")
    whole = kinds.where("points").join(totals, "file")
    edges = points.unionByName(whole.select("file", F.lit(0.0).alias("t"))).unionByName(whole.select("file", F.col("total").alias("t")))
    until = F.when(ends_missing, F.col("start")).otherwise(F.col("end"))
    clamp = lambda c: F.least(F.greatest(c - offset, F.lit(0.0)), F.col("total"))
    spans = known.where("NOT points").select("file", clamp(F.col("start")).alias("start"), clamp(until).alias("end")).where("end > start")
    return between_edges(edges).unionByName(_numbered(spans, "start", "end"))


def pad(bounds: DataFrame, totals: DataFrame, by: float) -> DataFrame:
    if not by:
        return bounds
    grown = bounds.join(totals, "file")
    return grown.select("file", "ord", F.greatest(F.lit(0.0), F.col("start") - by).alias("start"), F.least("total", F.col("end") + by).alias("end"))


def merge_short(bounds: DataFrame, least: float) -> DataFrame:
    """Fold a bound shorter than ``least`` into the one before it; a short first group into the second, once."""
    if least <= 0:
        return bounds
    order = _in_order("ord")
    long_enough = ~(F.col("end") - F.col("start") < least)
    marked = bounds.withColumn("g", F.sum(F.when((F.row_number().over(order) == 1) | long_enough, 1).otherwise(0)).over(order))
    fold = lambda df, key: df.groupBy("file", key).agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.max("ord").alias("ord"))
    groups = fold(marked, "g")
    per_file = Window.partitionBy("file")
    first_length = F.max(F.when(F.col("g") == 1, F.col("end") - F.col("start"))).over(per_file)
    groups = groups.withColumn("h", F.when((F.col("g") == 1) & (F.max("g").over(per_file) > 1) & (first_length < least), 2).otherwise(F.col("g")))
    return _numbered(fold(groups, "h"), "ord")


def split_long(bounds: DataFrame, most: float | None) -> DataFrame:
    """Cut a bound longer than ``most`` into equal parts."""
    if not most:
        return bounds
    parts = F.greatest(F.ceil((F.col("end") - F.col("start")) / most), F.lit(1)).cast("int")
    cut = bounds.withColumn("parts", parts).withColumn("step", (F.col("end") - F.col("start")) / F.col("parts"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = cut.select(
        "file",
        "ord",
        "k",
        (F.col("start") + F.col("k") * F.col("step")).alias("start"),
        F.when(F.col("k") == F.col("parts") - 1, F.col("end")).otherwise(F.col("start") + (F.col("k") + 1) * F.col("step")).alias("end"),
    )
    return _numbered(pieces, "ord", "k")


def constrain(bounds: DataFrame, totals: DataFrame, by: float = 0.0, least: float = 0.25, most: float | None = 30.0) -> DataFrame:
    """Pad, merge, split, then number and round."""
    done = split_long(merge_short(pad(bounds, totals, by), least), most)
    start, end = F.round("start", 6), F.round("end", 6)
    return done.select("file", F.col("ord").alias("segment"), start.alias("start"), end.alias("end"), F.round(end - start, 6).alias("duration"))


def segment(totals: DataFrame, method: str, by: float = 0.0, least: float = 0.25, most: float | None = 30.0, **options) -> DataFrame:
    """The whole chain: a registered strategy, then the shared constraints."""
    return constrain(strategy(method)(totals, **options), totals, by, least, most)


def duration_stats(segments: DataFrame) -> DataFrame:
    d = F.col("end") - F.col("start")
    return segments.groupBy("file").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"), F.min(d).alias("min"), F.max(d).alias("max"))


def sample_slices(samples: DataFrame, segments: DataFrame, rate: float, bucket: int = 4096) -> DataFrame:
    """Samples (file, i, x) joined with the segments whose index range [start*rate, end*rate) holds them.

    A range join as an equi-join on (file, bucket of the index); indices are rounded half to even.
    """
    ranged = segments.withColumn("i0", F.greatest(F.lit(0), F.bround(F.col("start") * rate)).cast("long")).withColumn("i1", F.bround(F.col("end") * rate).cast("long")).where("i1 > i0")
    spread = ranged.withColumn("b", F.explode(F.sequence(F.expr(f"i0 div {bucket}"), F.expr(f"(i1 - 1) div {bucket}"))))
    keyed = samples.withColumn("b", F.expr(f"i div {bucket}"))
    return keyed.join(spread, ["file", "b"]).where("i >= i0 AND i < i1").drop("b", "i0", "i1")


def inner_frames(arrays: DataFrame, size: int, hop: int) -> DataFrame:
    """Frames (file, segment, frame, x) of arrays (file, segment, x), from sample 0, the last one zero-padded.

    A frame begins at every hop that lies within the segment, so a short segment gives one padded frame
    and an empty one none.
    """
    count = F.ceil(F.size("x") / hop).cast("int")
    rows = arrays.where(F.size("x") > 0).withColumn("frame", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.slice("x", F.col("frame") * hop + 1, F.lit(size))
    return rows.select("file", "segment", "frame", F.concat(part, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part))).alias("x"))
