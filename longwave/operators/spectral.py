"""Descriptors of frames as column expressions over arrays: x (samples) or m (magnitudes of bins 0 .. n-1).

Bin k of n stands for the frequency k * nyquist / (n - 1).  Everything stays in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwave.functions.scalars import array_sum

NYQUIST = 22050.0


def frequencies(m: Column, nyquist: float = NYQUIST) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda k: k * F.lit(nyquist) / (F.size(m) - 1))


def weighted(m: Column, w: Column) -> Column:
    return array_sum(F.zip_with(m, w, lambda a, b: a * b))


def energy(x: Column) -> Column:
    return array_sum(F.transform(x, lambda v: v * v))


def loudness(x: Column) -> Column:
    """Stevens' law on the energy."""
    return F.pow(energy(x), F.lit(0.67))


def instant_power(x: Column) -> Column:
    return energy(x) / F.size(x)


def zero_crossings(x: Column) -> Column:
    """Share of neighbouring samples of opposite sign; zero counts as positive."""
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    return array_sum(pairs) / F.size(x)


def n_peaks(m: Column, threshold: float = 1e-5) -> Column:
    """Inner local maxima above a threshold."""
    inner = F.sequence(F.lit(2), F.size(m) - 1)
    at = lambda k: F.element_at(m, k.cast("int"))
    return F.size(F.filter(inner, lambda k: (at(k) > threshold) & (at(k) > at(k - 1)) & (at(k) >= at(k + 1))))


def _power(k: int):
    return lambda v: F.pow(v, F.lit(float(k)))


def with_moments(frames: DataFrame, m: str = "m", nyquist: float = NYQUIST) -> DataFrame:
    """Add centroid, spread (variance), skewness and kurtosis of the magnitudes; null for silence."""
    total = array_sum(F.col(m))
    frames = frames.withColumn("__f", frequencies(F.col(m), nyquist)).withColumn("__total", F.when(total > 0, total))
    frames = frames.withColumn("centroid", weighted(F.col(m), F.col("__f")) / F.col("__total"))
    away = F.transform("__f", lambda f: f - F.col("centroid"))
    for k in (2, 3, 4):
        power = F.transform(away, _power(k))
        frames = frames.withColumn(f"__m{k}", weighted(F.col(m), power) / F.col("__total"))
    spread = F.when(F.col("__m2") > 0, F.col("__m2"))
    return (
        frames.withColumn("spread", F.col("__m2")).withColumn("skewness", F.col("__m3") / F.pow(spread, F.lit(1.5)))
        .withColumn("kurtosis", F.col("__m4") / (spread * spread) - 3).drop("__f", "__total", "__m2", "__m3", "__m4")
    )


def rolloff(m: Column, share: float = 0.85, nyquist: float = NYQUIST) -> Column:
    """The first frequency below which a share of the energy lies."""
    wanted = energy(m) * share
    state = F.struct(F.lit(0.0).alias("e"), F.lit(-1).alias("k"), F.lit(0).alias("i"))
    found = F.aggregate(
        m, state,
        lambda s, v: F.struct((s["e"] + v * v).alias("e"), F.when((s["k"] < 0) & (s["e"] + v * v >= wanted), s["i"]).otherwise(s["k"]).alias("k"), (s["i"] + 1).alias("i")),
    )
    return F.greatest(found["k"], F.lit(0)) * F.lit(nyquist) / (F.size(m) - 1)


def decrease(m: Column, nyquist: float = NYQUIST) -> Column:
    """Slope of the regression of magnitude on frequency."""
    f, n = frequencies(m, nyquist), F.size(m)
    mean_f, mean_m = array_sum(f) / n, array_sum(m) / n
    return (weighted(m, f) - n * mean_f * mean_m) / (array_sum(F.transform(f, lambda v: v * v)) - n * mean_f * mean_f)


def flatness(m: Column) -> Column:
    """Geometric over arithmetic mean; 0 if a magnitude is 0."""
    logs = array_sum(F.transform(m, lambda v: F.ln(F.when(v > 0, v).otherwise(1.0))))
    return F.when(F.exists(m, lambda v: v <= 0), 0.0).otherwise(F.exp(logs / F.size(m)) / (array_sum(m) / F.size(m)))


def crest(m: Column) -> Column:
    total = array_sum(m)
    return F.when(total > 0, F.array_max(m) / (total / F.size(m)))


def entropy(m: Column) -> Column:
    """Shannon entropy in bits of the magnitudes as shares."""
    total = array_sum(m)
    return F.when(total > 0, -array_sum(F.transform(m, lambda v: F.when(v > 0, v / total * F.log2(F.when(v > 0, v / total).otherwise(1.0))).otherwise(0.0))))


def hfc(m: Column, nyquist: float = NYQUIST) -> Column:
    """High-frequency content: energy weighted by frequency."""
    return weighted(F.transform(m, lambda v: v * v), frequencies(m, nyquist))


def strong_peak(m: Column) -> Column:
    """The largest magnitude over the number of bins at half of it or more."""
    top = F.array_max(m)
    return F.when(top > 0, top / F.size(F.filter(m, lambda v: v >= top / 2)))


def band_ratio(m: Column, lo: float, hi: float, nyquist: float = NYQUIST) -> Column:
    """Share of the energy in lo <= f < hi, with hi at most nyquist - 1."""
    hi = min(hi, nyquist - 1)
    inside = F.zip_with(m, frequencies(m, nyquist), lambda v, f: F.when((f >= lo) & (f < hi), v * v).otherwise(0.0))
    return F.when(energy(m) > 0, array_sum(inside) / energy(m))


def with_flux(frames: DataFrame, m: str = "m", keys: tuple[str, ...] = ("file", "segment"), order: str = "frame") -> DataFrame:
    """Euclidean difference to the frame before, within a segment; the first frame is compared with silence."""
    before = F.lag(m).over(Window.partitionBy(*keys).orderBy(order))
    before = F.coalesce(before, F.transform(m, lambda v: F.lit(0.0)))
    return frames.withColumn("flux", F.sqrt(array_sum(F.zip_with(m, before, lambda a, b: (a - b) * (a - b)))))


#: Edges of the Bark bands in Hz.
BARK_EDGES = (
    0, 50, 100, 150, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500, 20500,
)


def bark_energies(m: Column, nyquist: float = NYQUIST) -> Column:
    """Energy in each of the 27 bands."""
    f = frequencies(m, nyquist)
    band = lambda lo, hi: array_sum(F.zip_with(m, f, lambda v, x: F.when((x >= lo) & (x < hi), v * v).otherwise(0.0)))
    return F.array(*(band(lo, hi) for lo, hi in zip(BARK_EDGES, BARK_EDGES[1:], strict=False)))


def dft_magnitudes(frames: DataFrame, x: str = "x") -> DataFrame:
    """(keys, bin, mag) of short frames from the definition, as an aggregation over samples and bins."""
    others = [c for c in frames.columns if c != x]
    spread = frames.select(*others, F.size(x).alias("n"), F.posexplode(x).alias("t", "v"))
    spread = spread.withColumn("bin", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))))
    angle = F.lit(2.0) * F.pi() * ((F.col("bin") * F.col("t")) % F.col("n")) / F.col("n")
    sums = spread.groupBy(*others, "bin").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return sums.select(*others, "bin", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))
