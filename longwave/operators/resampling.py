"""Resampling by a polyphase bank of windowed-sinc filters, for whole signals and for any range of their output.

The ratio of the rates is reduced to up / down; output sample j stands at j * down / up of the input, in exact integers: base = j * down div up, phase = j * down mod up.
Each phase has its own short filter, made once.  An output sample needs the input within ``reach`` of its base alone, so that a range of the output made from a range
of the input with that halo is equal to the same range made from everything.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_WIDTH = 16
#: Output samples that are gathered at a time.
_BLOCK = 1 << 14


class Bank(NamedTuple):
    up: int
    down: int
    reach: int
    taps: np.ndarray  # (up, 2 reach): the weights of the input from base - reach + 1 on


@lru_cache(maxsize=16)
def bank(source: int, target: int, half_width: int = HALF_WIDTH) -> Bank:
    common = math.gcd(source, target)
    up, down = target // common, source // common
    cutoff = min(1.0, target / source)
    reach = int(np.ceil(half_width / cutoff))
    gap = np.arange(up)[:, None] / up - np.arange(-reach + 1, reach + 1)[None, :]
    return Bank(up, down, reach, cutoff * np.sinc(cutoff * gap) * np.where(np.abs(gap) < reach, 0.5 + 0.5 * np.cos(np.pi * gap / reach), 0))


def output_length(frames: int, source: int, target: int) -> int:
    return frames if source == target else -(-frames * target // source)


def input_range(first: int, last: int, frames: int, source: int, target: int) -> tuple[int, int]:
    """The range of input frames that the output samples first to last (exclusive) need."""
    if first >= last:
        return 0, 0
    if source == target:
        return min(first, frames), min(last, frames)
    b = bank(source, target)
    return max(0, first * b.down // b.up - b.reach + 1), min(frames, (last - 1) * b.down // b.up + b.reach + 1)


def resample_range(x: np.ndarray, start: int, first: int, last: int, source: int, target: int) -> np.ndarray:
    """Output samples first to last (exclusive) from the input samples x, which begin at index ``start``; beyond x all is zero."""
    x = np.asarray(x, float)
    if source == target:
        return x[first - start : last - start]
    b = bank(source, target)
    padded = np.concatenate((np.zeros(2 * b.reach), x, np.zeros(2 * b.reach)))
    out = np.empty(max(0, last - first))
    offsets = np.arange(-b.reach + 1, b.reach + 1) + 2 * b.reach - start
    for at in range(first, last, _BLOCK):
        place = np.arange(at, min(last, at + _BLOCK)) * b.down
        near = padded[np.clip(place[:, None] // b.up + offsets, 0, len(padded) - 1)]
        out[at - first : at - first + len(place)] = np.einsum("jk,jk->j", b.taps[place % b.up], near)
    return out


def resample_array(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """The whole signal at the target rate; as it is if rates agree or nothing is there."""
    x = np.asarray(x, float)
    return x if source == target or not len(x) else resample_range(x, 0, 0, output_length(len(x), source, target), source, target)


def resample(files: DataFrame, source: int, target: int) -> DataFrame:
    """Rows with their whole x brought to another rate; other columns stay."""

    def run(batches):
        for rows in batches:
            yield rows.assign(x=[resample_array(x, source, target).tolist() for x in rows["x"]])

    return files.mapInPandas(run, files.schema)


def resample_samples(samples: DataFrame, source: int, target: int) -> DataFrame:
    """(file, i, x) at the target rate from rows of single samples (file, i, x): a weighted sum for each output sample.

    Each input sample gives its weighted part to the outputs that it reaches, so that any length of file takes part in parallel.
    """
    if source == target:
        return samples.select("file", "i", "x")
    b = bank(source, target)
    taps = samples.sparkSession.createDataFrame([(k, [float(w) for w in row]) for k, row in enumerate(b.taps)], "phase int, taps array<double>")
    total = samples.groupBy("file").agg(((F.max("i") + 1) * F.lit(target) / F.lit(source)).alias("n"))
    # Outputs j with base(j) - reach < i <= base(j) + reach, that is (i - reach) up <= j down < (i + reach) up.
    low, high = (F.col("i") - b.reach) * b.up, (F.col("i") + b.reach) * b.up
    reached = F.sequence(F.greatest(F.lit(0), F.ceil(low / b.down).cast("long")), F.ceil(high / b.down).cast("long") - 1)
    parts = samples.where(high > 0).select("file", "i", "x", F.explode(reached).alias("j"))
    parts = parts.withColumn("base", F.expr(f"j * {b.down} div {b.up}")).withColumn("phase", F.expr(f"cast(j * {b.down} % {b.up} AS int)"))
    # The bank has as many rows as the target rate at most.
    weighed = parts.join(F.broadcast(taps), "phase").select("file", "j", (F.col("x") * F.get("taps", (F.col("i") - F.col("base") + (b.reach - 1)).cast("int"))).alias("part"))
    return weighed.groupBy("file", "j").agg(F.sum("part").alias("x")).join(total, "file").where("j < n").select("file", F.col("j").alias("i"), "x")
