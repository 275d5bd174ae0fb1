"""Psychoacoustic metrics: guards, curve summaries, and the metrics of a segment by name.

The models are in :mod:`longwave.operators.zwicker` (loudness, sharpness), :mod:`longwave.operators.roughness` and :mod:`longwave.operators.hearing`.
They follow the published methods and their units; they are not certified implementations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial
from inspect import signature

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwave.functions.scalars import array_sum, pascal_factor
from longwave.operators import hearing, zwicker
from longwave.operators.roughness import daniel_weber
from longwave.operators.stats import finite

#: Percentiles of exceedance, and the durations within which segments are analysed.
PERCENTILES, LEAST_SECONDS, MOST_SECONDS, FULL_SCALE_DB = (5, 10, 50, 90), 0.3, 20.0, 94.0

Metric = Callable[[np.ndarray, float], dict[str, float]]
_METRICS: dict[str, Metric] = {}


def register(name: str) -> Callable[[Metric], Metric]:
    """Make a metric (pressure, rate) -> {column: value} available by name."""

    def keep(metric: Metric) -> Metric:
        _METRICS[name] = metric
        return metric

    return keep


def metrics() -> list[str]:
    return sorted(_METRICS)


def guard(segments: DataFrame, least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> DataFrame:
    """Add skipped (1.0 for segments too short) and analysed_duration (at most ``most``, null if skipped)."""
    short = F.col("duration") < least
    return segments.withColumn("skipped", F.when(short, 1.0).otherwise(0.0)).withColumn("analysed_duration", F.when(~short, F.least("duration", F.lit(float(most)))))


def exceedance(value: Column, percentile: float) -> Column:
    """The value exceeded during a percentage of the time, over finite values, with linear interpolation."""
    return F.percentile(F.when(finite(value), value), F.lit(1 - percentile / 100))


def curve_summary(curve: Column) -> list[Column]:
    """mean, max and population deviation of an array."""
    mean = array_sum(curve) / F.size(curve)
    return [mean.alias("mean"), F.array_max(curve).alias("max"), F.sqrt(array_sum(F.transform(curve, lambda v: (v - mean) * (v - mean))) / F.size(curve)).alias("std")]


def bark_moments(specific: Column, bark: Column) -> list[Column]:
    """Centroid and spread over the Bark axis of a specific-loudness pattern; null without loudness."""
    total = array_sum(specific)
    centroid = array_sum(F.zip_with(specific, bark, lambda n, z: n * z)) / F.when(total > 0, total)
    spread = F.sqrt(array_sum(F.zip_with(specific, bark, lambda n, z: n * (z - centroid) * (z - centroid))) / F.when(total > 0, total))
    return [centroid.alias("bark_centroid"), spread.alias("bark_spread")]


def strongest_tone(tones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key of tones (freq, tnr): their number, largest ratio, and the frequency of it (the lowest if tied)."""
    return tones.groupBy(*keys).agg(F.count("*").alias("n_tones"), F.max("tnr").alias("tnr_max_dB"), F.max_by("freq", F.struct("tnr", -F.col("freq"))).alias("strongest_tone_Hz"))


# ---- models on one segment's pressure -------------------------------------------------------------


def zwicker_loudness(p: np.ndarray, rate: float, field: str = "free", shared: dict | None = None) -> zwicker.Loudness:
    """The segment's loudness; shared keeps it for the segment's other metrics."""
    if shared is None:
        return zwicker.time_varying(p, rate, field)
    if "loudness" not in shared:
        shared["loudness"] = zwicker.time_varying(p, rate, field)
    return shared["loudness"]


def _summary(prefix: str, curve: np.ndarray, letter: str, percentiles: Sequence[float], std: bool = True) -> dict[str, float]:
    curve = curve[np.isfinite(curve)]
    if not len(curve):
        return {}
    out = {f"{prefix}.mean": curve.mean(), f"{prefix}.max": curve.max()} | ({f"{prefix}.std": curve.std()} if std else {})
    return {k: float(v) for k, v in (out | {f"{prefix}.{letter}_{p:g}": np.percentile(curve, 100 - p) for p in percentiles}).items()}


@register("loudness")
def loudness(p: np.ndarray, rate: float, percentiles: Sequence[float] = PERCENTILES, field: str = "free", shared: dict | None = None) -> dict[str, float]:
    found = zwicker_loudness(p, rate, field, shared)
    out = _summary("psycho.loudness", found.total, "N", percentiles)
    pattern = found.specific.mean(axis=1)
    if pattern.sum() > 0:
        centre = (pattern * found.bark).sum() / pattern.sum()
        out |= {"psycho.loudness.bark_centroid": float(centre), "psycho.loudness.bark_spread": float(np.sqrt((pattern * (found.bark - centre) ** 2).sum() / pattern.sum()))}
    return out


@register("sharpness")
def sharpness(p: np.ndarray, rate: float, percentiles: Sequence[float] = PERCENTILES, field: str = "free", shared: dict | None = None) -> dict[str, float]:
    return _summary("psycho.sharpness", zwicker.sharpness(zwicker_loudness(p, rate, field, shared)), "S", percentiles)


@register("roughness")
def roughness(p: np.ndarray, rate: float, percentiles: Sequence[float] = PERCENTILES) -> dict[str, float]:
    return _summary("psycho.roughness", daniel_weber(p, rate), "R", percentiles)


@register("tonality")
def tonality(p: np.ndarray, rate: float) -> dict[str, float]:
    """Tone-to-noise and prominence ratios of all local maxima.

    The first is a maximum against the other bins of its critical band, the second its critical band
    against the mean of the bands below and above (the lower one begins at 20 Hz and is scaled up to 100 Hz).
    """
    power = np.abs(np.fft.rfft(p * np.hanning(len(p)))) ** 2
    f = np.fft.rfftfreq(len(p), 1 / rate)
    inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] >= power[2:])) + 1
    # Maxima 120 dB below the largest are rounding.
    inner = inner[(f[inner] >= 90) & (f[inner] <= 11200) & (power[inner] > 1e-12 * power.max(initial=0))]
    critical = lambda hz: 25 + 75 * (1 + 1.4 * (hz / 1000) ** 2) ** 0.69
    sums = np.concatenate(([0.0], np.cumsum(power)))
    span = lambda a, b: sums[b] - sums[a]
    at = f[inner]
    width = critical(at)
    lo, hi = np.searchsorted(f, at - width / 2), np.searchsorted(f, at + width / 2)
    band, tone = span(lo, hi), span(np.maximum(lo, inner - 2), np.minimum(hi, inner + 3))
    below = np.maximum(20.0, at - width / 2 - critical(at - width))
    start, end = np.searchsorted(f, below), np.searchsorted(f, at + width / 2 + critical(at + width))
    scale = np.where(below == 20.0, 100 / np.maximum(at - width / 2 - below, 1e-9), 1.0)
    beside = (span(start, lo) * scale + span(hi, end)) / 2

    def picked(over: np.ndarray, under: np.ndarray, limit: np.ndarray) -> list[tuple[float, float]]:
        """Maxima whose ratio reaches the limit, the strongest first, none within half a critical band of one before it."""
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(under > 1e-13 * sums[-1], 10 * np.log10(over / np.maximum(under, 1e-300)), np.inf)
        left = np.flatnonzero(ratio >= limit)
        left = left[np.argsort(-power[inner[left]], kind="stable")]
        found = []
        while len(left):
            first = left[0]
            found.append((float(at[first]), float(ratio[first])))
            left = left[np.abs(at[left] - at[first]) > width[left] / 2]
        return found

    tones = picked(tone, band - tone, 8 + np.maximum(0.0, 8.33 * np.log10(1000 / at)))
    prominent = picked(band, beside, 9 + np.maximum(0.0, 10 * np.log10(1000 / at)))
    sum_dB = lambda found: float(10 * np.log10(sum(10 ** (t / 10) for _, t in found))) if found else 0.0  # noqa: E731, N806
    out = {"psycho.tonality.n_tones": float(len(tones)), "psycho.tonality.tnr_total_dB": sum_dB(tones), "psycho.tonality.pr_total_dB": sum_dB(prominent)}
    if tones:
        out |= {"psycho.tonality.tnr_max_dB": max(t for _, t in tones), "psycho.tonality.strongest_tone_Hz": max(tones, key=lambda t: t[1])[0]}
    if prominent:
        out["psycho.tonality.pr_max_dB"] = max(t for _, t in prominent)
    return out


@register("loudness_ecma")
def loudness_ecma(p: np.ndarray, rate: float, percentiles: Sequence[float] = PERCENTILES) -> dict[str, float]:
    """The hearing model's loudness; no deviation."""
    return _summary("psycho.loudness_ecma", hearing.loudness(p, rate), "N", percentiles, std=False)


@register("roughness_ecma")
def roughness_ecma(p: np.ndarray, rate: float, percentiles: Sequence[float] = PERCENTILES) -> dict[str, float]:
    """The hearing model's roughness; no deviation."""
    return _summary("psycho.roughness_ecma", hearing.roughness(p, rate), "R", percentiles, std=False)


def _with(metric: Metric, **given) -> Metric:
    """The metric with those of the given arguments that it takes."""
    return partial(metric, **{k: v for k, v in given.items() if k in signature(metric).parameters})


def describe(
    segments: DataFrame, rate: float, names: Sequence[str] = ("loudness", "sharpness", "roughness", "tonality"), full_scale_db: float = FULL_SCALE_DB, least: float = LEAST_SECONDS,
    most: float | None = MOST_SECONDS, percentiles: Sequence[float] = PERCENTILES, field: str = "free",
) -> DataFrame:
    """(file, segment, name, value) for segments (file, segment, x); a metric that fails leaves its columns out, and ``failed.<metric>`` is 1."""
    unknown = [n for n in names if n not in _METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {', '.join(metrics())}")
    factor, chosen = pascal_factor(full_scale_db), {n: _METRICS[n] for n in names}

    def run(batches):
        for rows in batches:
            out = []
            for file, segment, x in zip(rows["file"], rows["segment"], rows["x"], strict=True):
                x = np.asarray(x, float)
                if len(x) < least * rate:
                    out.append((file, segment, "psycho.skipped", 1.0))
                    continue
                p = (x if most is None else x[: int(most * rate)]) * factor
                level = np.sqrt((p * p).mean())
                values = {"psycho.skipped": 0.0, "psycho.spl_dB": 20 * np.log10(level / 20e-6) if level > 0 else -np.inf, "psycho.analysed_duration": len(p) / rate}
                shared: dict = {}
                for name, metric in chosen.items():
                    try:
                        values |= _with(metric, percentiles=tuple(percentiles), field=field, shared=shared)(p, rate)
                    except (ValueError, FloatingPointError, ZeroDivisionError):
                        values[f"failed.{name}"] = 1.0
                out += [(file, segment, k, float(v)) for k, v in values.items()]
            yield pd.DataFrame(out, columns=["file", "segment", "name", "value"])

    return segments.select("file", F.col("segment").cast("long").alias("segment"), "x").mapInPandas(run, "file string, segment long, name string, value double")
