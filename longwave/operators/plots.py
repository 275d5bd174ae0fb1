"""Data that plots are drawn from: cell edges, merge trees, facets, reports.  Nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.operators import hierarchy, similarity

#: From this mean silhouette down, a clustering is called weak; beyond so many clusters, plots are split.
WEAK, FACETS = 0.25, 3


def map_edges(segments: DataFrame) -> DataFrame:
    """(file, ord, t): the edges of a similarity map's cells, all starts and then the last end."""
    last = segments.groupBy("file").agg(F.max_by("end", "segment").alias("t"), F.max("segment").alias("s"))
    starts = segments.select("file", F.col("segment").alias("ord"), F.col("start").alias("t"))
    return starts.unionByName(last.select("file", (F.col("s") + 1).alias("ord"), "t"))


def merge_steps(features: DataFrame, metric: str = "euclidean", link: str = "ward") -> DataFrame:
    """(file, step, a, b, height, size): the merge tree of each file's segments."""
    rows = features.select("file", "segment", "v")
    return hierarchy.merge_steps(rows, similarity.merges_of(rows, metric, link))


def colour_threshold(heights: list[float], k: int) -> float:
    """The height below which branches of a tree cut into k clusters are coloured."""
    return sorted(heights)[-(k - 1)] if 1 < k <= len(heights) else 0.0


def facets(clusters: list[int]) -> list[list[int]]:
    """One plot for few clusters, one per cluster for more."""
    ids = sorted(set(clusters))
    return [ids] if len(ids) <= FACETS else [[c] for c in ids]


def report(rows: list[dict]) -> list[str]:
    """Lines for rows of :func:`stats.cluster_report`."""
    total = sum(r["n"] for r in rows)
    mean = sum(r["mean_s"] * r["n"] for r in rows) / total if total else 0.0
    lines = [f"{r['cluster']:>3}  {r['n']:>5} segments  {r['seconds']:>9.1f} s  {r['share']:>5.1f} %  silhouette {r['mean_s']:.2f}" for r in sorted(rows, key=lambda r: r["cluster"])]
    return [*lines, f"mean silhouette {mean:.2f}" + (" (weak separation)" if mean < WEAK else "")]
