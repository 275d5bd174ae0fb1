"""Results that outlive the executors that made them, bitmaps that spare shuffles, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import itertools
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders of tables that are still there.
_KEPT: dict[str, SparkSession] = {}
#: After so many tables the garbage is collected: Spark deletes shuffles and broadcasts that no frame refers to any more only
#: when the driver does so, which a driver with little to do rarely does.
TIDY_EVERY = 6
_MADE = itertools.count(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that setting is missing (as in tests), a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read from there: without its lineage.  :func:`discard` deletes it.

    Tables that nobody discards, because the result still reads them, go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _KEPT:
        atexit.register(_discard_all)
    _KEPT[path] = spark
    if next(_MADE) % TIDY_EVERY == 0:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`durable` made.  Nothing may read them any more."""
    for table in tables:
        path = getattr(table, "kept_at", None)
        if path is not None and _KEPT.pop(path, None) is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the cluster's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _discard_all() -> None:
    for path, spark in list(_KEPT.items()):
        with contextlib.suppress(Exception):  # the session may have ended first
            delete(spark, path)


def membership(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits cells in which the cell of every key is set; for :func:`members`.

    Its size depends on ``bits`` alone.  It is made on the executors; a full bitmap only fails to
    exclude keys, so that what it lets through must be checked exactly afterwards.
    """
    cell = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.groupBy(F.shiftright(cell, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[np.asarray(words["w"])] = np.asarray(words["b"]).view(np.uint64)
    return out


def members(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit) may be in the bitmap."""
    cell = keys.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def may_hold(spark: SparkSession, bitmap: np.ndarray, key: Column) -> Column:
    """Whether the bitmap may hold a key, as a column: what it denies needs no shuffle to be told apart."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series(members(shared.value, keys.to_numpy(np.int64)))

    return held(key)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link, as a durable table; the root is the component's smallest node.

    Alternating large and small stars: edges are turned towards smaller neighbours until every
    component is a star around its root, that is until no edge begins where another one ends.  Each round is made durable.
    """

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        """A durable table of edges, and how many there are, counted while it is written."""
        seen = Observation()
        return durable(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]

    def nearest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    edges, count = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        if not count or edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty():
            # No root is a member elsewhere; what is left is to see that every member has one root.
            if edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("top")).where("low < top").isEmpty():
                break
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = edges.select(ways.alias("e")).select("e.u", "e.v")
        low = nearest(both).select("u", F.least("u", "m").alias("m"))
        large, _ = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = nearest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned, count = written(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(edges, large)
        edges = turned
    else:
        raise RuntimeError("the components did not settle")
    ends = F.explode(F.array("u", "v"))
    roots = durable(edges.select(ends.alias("node"), F.col("v").alias("root")).distinct())
    discard(edges)
    return roots


def at_random(*columns: str) -> Column:
    """A number in [0, 1) that follows from the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)
