"""Programme loudness and level statistics of whole files, from chunks (file, chunk, first, n, x, stereo) of any number.

The K-weighting runs chunk by chunk with carried state (:mod:`longwave.operators.recursion`).  Chunks give energies of short steps; blocks, both gates and the
loudness range are joins and aggregates over rows of energies, so that neither a file's samples nor its filtered signal ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwave.operators.recursion import Section, cascade, chunk_states

#: Fixed values (ITU-R BS.1770, EBU Tech 3342): gates in LUFS and LU, quantiles of the range, seconds of blocks and of their hop.
ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE, OFFSET, SILENCE = -70.0, -10.0, -20.0, -0.691, -70.0
RANGE_QUANTILES = (0.10, 0.95)
BLOCK, SHORT_TERM, STEP, SHORT_STEP = 0.4, 3.0, 0.1, 1.0
#: Seconds of a level block, and what is added to its power before the logarithm.
LEVEL_BLOCK, LEVEL_FLOOR = 0.2, 1e-9


def k_weighting(rate: float) -> list[Section]:
    """The shelf and the high pass before the energy of programme loudness, at any rate."""
    out = []
    # Frequency, Q and gain of the shelf and of the high pass.
    for f0, q, gain in ((1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773, None)):
        k = np.tan(np.pi * f0 / rate)
        scale = 1 + k / q + k * k
        a1, a2 = 2 * (k * k - 1) / scale, (1 - k / q + k * k) / scale
        if gain is None:
            b = (1.0, -2.0, 1.0)
        else:
            high = 10 ** (gain / 20)
            middle = high**0.4996667741545416
            b = tuple(v / scale for v in (high + middle * k / q + k * k, 2 * (k * k - high), high - middle * k / q + k * k))
        out.append(Section(*map(float, (*b, a1, a2))))
    return out


def step_energies(chunks: DataFrame, rate: float, sections: Sequence[Section], column: str = "stereo", step: float = STEP) -> DataFrame:
    """(file, step, energy, n): sums of squares, over all channels, of the filtered signal in steps of int(step * rate) samples."""
    size, state_size = int(step * rate), 2 * len(sections)
    signals = lambda row: [np.asarray(c, float) for c in (row[column] if column == "stereo" else [row[column]])]
    chunks = chunks.where(F.col(column).isNotNull())
    states = chunk_states(chunks, sections, signals, (column,))
    entered = chunks.select("file", "chunk", "first", column).join(states, ["file", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, first, held = batch.column("file")[k].as_py(), batch.column("first")[k].as_py(), signals({column: batch.column(column)[k].as_py()})
                state = batch.column("state")[k].as_py()
                power = sum(cascade(sections, x, state[c * state_size : (c + 1) * state_size])[0] ** 2 for c, x in enumerate(held))
                if not len(power):
                    continue
                at = (first + np.arange(len(power))) // size
                begin = np.flatnonzero(np.diff(at, prepend=-1))
                yield pa.RecordBatch.from_pydict({"file": [file] * len(begin), "step": at[begin], "energy": np.add.reduceat(power, begin), "n": np.diff(np.append(begin, len(power)))})

    parts = entered.mapInArrow(run, "file string, step long, energy double, n long")
    return parts.groupBy("file", "step").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))


def blocks(steps: DataFrame, size: int, steps_in: int, hop: int = 1) -> DataFrame:
    """(file, block, power): mean power of blocks of ``steps_in`` whole steps of ``size`` samples, every ``hop`` steps.

    Each step hands its energy to the blocks that hold it, so that no window runs over a file.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("step") - (steps_in - 1)) / hop).cast("long"))
    last = F.expr(f"step div {hop}")
    spread = steps.where(F.col("n") == size).where(first <= last).select("file", "energy", F.explode(F.sequence(first, last)).alias("block"))
    whole = spread.groupBy("file", "block").agg(F.sum("energy").alias("energy"), F.count("*").alias("held"))
    return whole.where(F.col("held") == steps_in).select("file", "block", (F.col("energy") / (steps_in * size)).alias("power"))


def lufs(power: Column) -> Column:
    return F.lit(OFFSET) + 10 * F.log10(F.greatest(power, F.lit(1e-12)))


def _gated(power: DataFrame, relative: float) -> DataFrame:
    """Blocks above the absolute gate and above their own mean plus the relative gate."""
    loud = power.where(lufs(F.col("power")) > ABSOLUTE_GATE)
    means = loud.groupBy("file").agg(F.avg("power").alias("mean"))
    return loud.join(means, "file").where(lufs(F.col("power")) > lufs(F.col("mean")) + relative)


def programme_loudness(steps: DataFrame, rate: float) -> DataFrame:
    """(file, name, value): integrated loudness, loudness range and largest short-term loudness from step energies."""
    size, per = int(STEP * rate), lambda seconds: round(seconds / STEP)
    momentary = blocks(steps, size, per(BLOCK))
    short = blocks(steps, size, per(SHORT_TERM), per(SHORT_STEP))
    integrated = _gated(momentary, RELATIVE_GATE).groupBy("file").agg(lufs(F.avg("power")).alias("i"))
    span = _gated(short, RANGE_GATE).groupBy("file").agg(F.percentile(lufs(F.col("power")), F.array(*map(F.lit, RANGE_QUANTILES))).alias("q")).select("file", (F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("r"))
    top = short.groupBy("file").agg(lufs(F.max("power")).alias("m"))
    met = steps.select("file").distinct().join(integrated, "file", "left").join(span, "file", "left").join(top, "file", "left")
    value = lambda name, c, otherwise: F.struct(F.lit(f"global.{name}").alias("name"), F.coalesce(c, F.lit(otherwise)).alias("value"))
    three = F.array(value("loudness_integrated_LUFS", F.col("i"), SILENCE), value("loudness_range_LU", F.col("r"), 0.0), value("loudness_short_term_max_LUFS", F.col("m"), SILENCE))
    return met.select("file", F.explode(three).alias("v")).select("file", "v.name", "v.value")


def level_blocks(chunks: DataFrame, rate: float) -> DataFrame:
    """(file, block, energy): sums of squares of the mixed signal in blocks of LEVEL_BLOCK seconds; the last one counts as filled up with silence."""
    size = max(1, int(LEVEL_BLOCK * rate))
    # Blocks within a chunk are slices of it; those at its edges meet in the sum.
    low, high = F.expr(f"first div {size}"), F.expr(f"(first + n - 1) div {size}")

    def energy(block):
        a = F.greatest(block * size - F.col("first"), F.lit(0).cast("long"))
        b = F.least((block + 1) * size - F.col("first"), F.col("n"))
        return F.aggregate(F.slice("x", (a + 1).cast("int"), (b - a).cast("int")), F.lit(0.0), lambda t, v: t + v * v)

    sums = F.transform(F.sequence(low, high), lambda block: F.struct(block.alias("block"), energy(block).alias("energy")))
    cut = chunks.where("n > 0").select("file", F.explode(sums).alias("b")).select("file", "b.block", "b.energy")
    return cut.groupBy("file", "block").agg(F.sum("energy").alias("energy"))


def dynamics(energies: DataFrame, rate: float) -> DataFrame:
    """(file, name, value): mean distance of block levels from the whole level, and that level, in dB."""
    size = max(1, int(LEVEL_BLOCK * rate))
    level = lambda power: 10 * F.log10(power + LEVEL_FLOOR)
    whole = energies.groupBy("file").agg(level(F.avg(F.col("energy") / size)).alias("whole"))
    gaps = energies.join(whole, "file").groupBy("file").agg(F.avg(F.abs(level(F.col("energy") / size) - F.col("whole"))).alias("d"), F.first("whole").alias("w"))
    two = F.array(F.struct(F.lit("global.dynamic_complexity").alias("name"), F.col("d").alias("value")), F.struct(F.lit("global.loudness_dB").alias("name"), F.col("w").alias("value")))
    return gaps.select("file", F.explode(two).alias("v")).select("file", "v.name", "v.value")


def file_globals(chunks: DataFrame, rate: float) -> DataFrame:
    """(file, name, value) of whole files from their chunks without halo; programme loudness for stereo files at 44.1 or 48 kHz."""
    found = dynamics(level_blocks(chunks, rate), rate)
    if rate not in (44100, 48000) or "stereo" not in chunks.columns:
        return found
    return found.unionAll(programme_loudness(step_energies(chunks, rate, k_weighting(rate)), rate))
