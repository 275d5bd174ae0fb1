"""Signal kernels that need whole arrays: spectra, cepstra, pitch, harmony, onsets, change points, resampling.

They run in Arrow batches over rows (file, segment, x) or (file, x); a row is one segment or one file, so a
task holds a bounded number of samples.  A group that fails for a segment leaves its names out and the rest stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.operators import slicing
from longwave.operators.resampling import resample, resample_array
from longwave.operators.spectral import BARK_EDGES

FRAME, HOP = 2048, 1024


def frame_array(x: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames from every hop within x, the last ones zero-padded; one frame at least unless x is empty."""
    if not len(x):
        return np.zeros((0, size))
    count = max(1, -(-len(x) // hop))
    padded = np.pad(x, (0, max(0, (count - 1) * hop + size - len(x))))
    return padded[np.arange(count)[:, None] * hop + np.arange(size)]


#: Window functions by name, from the number of samples.
WINDOWS: dict[str, Callable[[int], np.ndarray]] = {
    "hann": lambda n: np.hanning(n + 1)[:-1],
    "hamming": lambda n: np.hamming(n + 1)[:-1],
    "blackman": lambda n: np.blackman(n + 1)[:-1],
    "square": np.ones,
}


def spectra(frames: np.ndarray, window: str = "hann") -> np.ndarray:
    """Magnitudes of windowed frames, scaled so that a full-scale sine gives about one half."""
    shape = WINDOWS[window](frames.shape[1])
    return np.abs(np.fft.rfft(frames * shape, axis=1)) / shape.sum()


def _triangles(edges: np.ndarray, f: np.ndarray) -> np.ndarray:
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


def mel_weights(f: np.ndarray, bands: int = 40) -> np.ndarray:
    mel = lambda x: 1127 * np.log1p(x / 700)
    return _triangles(700 * np.expm1(np.linspace(0, mel(f[-1]), bands + 2) / 1127), f)


def erb_weights(f: np.ndarray, bands: int = 40) -> np.ndarray:
    """Fourth-order gammatone magnitude responses on the equivalent rectangular bandwidth scale."""
    scale = lambda x: 21.4 * np.log10(1 + 0.00437 * x)
    centres = (10 ** (np.linspace(scale(50), scale(f[-1] * 0.95), bands) / 21.4) - 1) / 0.00437
    width = 1.019 * 24.7 * (1 + 0.00437 * centres)
    return (1 + ((f[None, :] - centres[:, None]) / width[:, None]) ** 2) ** -2.0


def bark_weights(f: np.ndarray, bands: int = len(BARK_EDGES) - 1) -> np.ndarray:
    edges = BARK_EDGES[: bands + 1]
    return np.array([(f >= lo) & (f < hi) for lo, hi in zip(edges, edges[1:], strict=False)], float)


def cosine_basis(bands: int, count: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, n = np.arange(count)[:, None], np.arange(bands)[None, :]
    basis = np.cos(np.pi * k * (n + 0.5) / bands) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return basis


def cepstra(m: np.ndarray, weights: np.ndarray, count: int = 13) -> np.ndarray:
    return 10 * np.log10((m**2) @ weights.T + 1e-10) @ cosine_basis(len(weights), count).T


def peaks(m: np.ndarray, f: np.ndarray, least: float = 1e-5, lo: float = 20.0, hi: float = 8000.0, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Parabolically interpolated local maxima of one spectrum, by frequency."""
    k = np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] >= m[2:]) & (m[1:-1] > least)) + 1
    a, b, c = m[k - 1], m[k], m[k + 1]
    bend = a - 2 * b + c
    shift = np.where(bend != 0, 0.5 * (a - c) / np.where(bend != 0, bend, 1), 0)
    freq, mag = (k + shift) * (f[1] - f[0]), b - 0.25 * (a - c) * shift
    keep = (freq >= lo) & (freq <= min(hi, f[-1] - 1))
    freq, mag = freq[keep], mag[keep]
    if len(freq) > most:
        top = np.sort(np.argsort(-mag, kind="stable")[:most])
        freq, mag = freq[top], mag[top]
    return freq, mag


#: By how many dB the ear's sensitivity weighs frequencies (Hz) before the pitch is searched.
PITCH_FREQUENCIES = (
    0, 20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 9000, 10000, 12500, 15000, 20000, 25100,
)
PITCH_WEIGHTS = (
    -75.8, -70.1, -60.8, -52.1, -44.2, -37.5, -31.3, -25.6, -20.9, -16.5, -12.6, -9.6, -7.0, -4.7, -3.0, -1.8, -0.8, -0.2, 0.0, 0.5, 1.6, 3.2, 5.4, 7.8, 8.1, 5.3, -2.4, -11.1, -12.8, -12.2, -7.4, -17.8, -17.8, -17.8,
)


def yin(m: np.ndarray, rate: float, lo: float = 20.0, hi: float = 22050.0, threshold: float = 0.15, window: str = "hann") -> np.ndarray:
    """(frames, 2): fundamental and confidence of all frames of magnitudes at once; half the rate and 0 for silence.

    The difference function comes from the weighted power spectrum by one inverse transform, freed of the window's own taper, and is divided by its running mean; the first dip below
    the threshold counts, else the deepest one, refined by a parabola.
    """
    size = 2 * (m.shape[1] - 1)
    weight = 10 ** (np.interp(np.arange(m.shape[1]) * rate / size, PITCH_FREQUENCIES, PITCH_WEIGHTS) / 20)
    taper = np.fft.irfft(np.abs(np.fft.rfft(WINDOWS[window](size))) ** 2, size)[: size // 2]
    r = np.fft.irfft((m * weight) ** 2, size, axis=1)[:, : size // 2] * (taper[0] / taper)
    difference = np.maximum(r[:, :1] - r, 0)
    mean = np.cumsum(difference[:, 1:], axis=1) / np.arange(1, size // 2)
    d = np.concatenate((np.ones((len(m), 1)), difference[:, 1:] / np.where(mean > 0, mean, 1)), axis=1)
    first, last = max(2, int(rate / hi)), min(size // 2 - 1, int(rate / lo))
    out = np.tile((rate / 2, 0.0), (len(m), 1))
    held = np.flatnonzero(r[:, 0] > 0)
    if last - first < 2 or not len(held):
        return out
    d = d[held]
    inner = d[:, first:last]
    # A dip: no lower one on either side.
    dip = (inner <= d[:, first - 1 : last - 1]) & (inner <= d[:, first + 1 : last + 1]) & (inner < threshold)
    tau = first + np.where(dip.any(axis=1), dip.argmax(axis=1), inner.argmin(axis=1))
    each = np.arange(len(held))
    a, b, c = d[each, tau - 1], d[each, tau], d[each, tau + 1]
    bend = a - 2 * b + c
    at = tau + np.where(bend > 0, 0.5 * (a - c) / np.where(bend > 0, bend, 1), 0)
    out[held, 0], out[held, 1] = rate / at, np.maximum(0.0, 1 - b)
    return out


def dissonance(freq: np.ndarray, mag: np.ndarray) -> float:
    """Plomp and Levelt's roughness of pairs of partials, weighted by magnitude."""
    i, j = np.triu_indices(len(freq), 1)
    gap = np.abs(freq[i] - freq[j]) / (1.72 * ((freq[i] + freq[j]) / 2) ** 0.65)
    weight = np.minimum(mag[i], mag[j])
    curve = np.where(gap < 1.2, np.exp(-3.5 * gap) - np.exp(-5.75 * gap), 0) / 0.1811
    return float((curve * weight).sum() / weight.sum()) if weight.sum() > 0 else 0.0


def harmonics(freq: np.ndarray, mag: np.ndarray, f0: float, most: int = 20, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """The peak nearest to each multiple of f0; magnitude 0 where there is none."""
    number = np.arange(1, most + 1)
    at = np.abs(freq[None, :] - number[:, None] * f0).argmin(axis=1)
    near = np.abs(freq[at] - number * f0) <= tolerance * f0
    return np.where(near, freq[at], number * f0), np.where(near, mag[at], 0.0)


def harmonic_values(freq: np.ndarray, mag: np.ndarray, f0: float) -> dict[str, float]:
    keep = freq > 0
    freq, mag = freq[keep], mag[keep]
    if f0 <= 0 or len(freq) < 2:
        return {}
    hf, hm = harmonics(freq, mag, f0)
    if (hm > 0).sum() < 2:
        return {}
    number, total, power = np.arange(1, len(hf) + 1), hm.sum(), hm**2
    odd, even = power[(number % 2 == 1)].sum(), power[number % 2 == 0].sum()
    return {
        "harmonic.inharmonicity": float((np.abs(hf - number * f0) * power).sum() / power.sum() * 2 / f0),
        "harmonic.tristimulus_1": float(hm[0] / total), "harmonic.tristimulus_2": float(hm[1:4].sum() / total), "harmonic.tristimulus_3": float(hm[4:].sum() / total),
        "harmonic.odd_to_even": float(min(odd / even, 1000.0)) if even > 0 else 1000.0,
    }


def pitch_classes(freq: np.ndarray, mag: np.ndarray, size: int = 12) -> np.ndarray:
    """Squared magnitudes folded into pitch classes from A, the largest one."""
    out = np.zeros(size)
    keep = (freq >= 40) & (freq <= 5000)
    np.add.at(out, np.mod(np.round(size * np.log2(freq[keep] / 440)).astype(int), size), mag[keep] ** 2)
    return out / out.max() if out.max() > 0 else out


def _entropy(v: np.ndarray) -> float:
    p = v[v > 0] / v.sum() if v.sum() > 0 else v[:0]
    return float(-(p * np.log2(p)).sum())


def _vector(prefix: str, rows: np.ndarray) -> dict[str, np.ndarray]:
    digits = len(str(rows.shape[1] - 1))
    return {f"{prefix}.{k:0{digits}d}": rows[:, k] for k in range(rows.shape[1])}


def _shape(prefix: str, bands: np.ndarray) -> dict[str, np.ndarray]:
    mean = bands.mean(axis=1)
    geometric = np.exp(np.log(np.maximum(bands, 1e-300)).mean(axis=1))
    return {f"{prefix}.flatness": np.where(mean > 0, geometric / np.where(mean > 0, mean, 1), 0), f"{prefix}.crest": np.where(mean > 0, bands.max(axis=1) / np.where(mean > 0, mean, 1), 0)}


def weighted_bands(spectra: DataFrame, weights: np.ndarray, coefficients: int = 0) -> DataFrame:
    """(segment, i, value) of spectra (segment, m): the energy in each weighted band, or that many cepstral coefficients of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            m = np.stack(batch.column("m").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, weights.shape[1]))
            found = cepstra(m, weights, coefficients) if coefficients else (m**2) @ weights.T
            segment = np.repeat(np.asarray(batch.column("segment")), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), len(found))), pa.array(found.ravel())], ["segment", "i", "value"])

    return spectra.select(F.col("segment").cast("long").alias("segment"), "m").mapInArrow(run, "segment long, i int, value double")


@dataclass(frozen=True)
class Settings:
    """What descriptor groups can be told."""

    window: str = "hann"
    mfcc_bands: int = 40
    mfcc_coefficients: int = 13
    gfcc_bands: int = 40
    gfcc_coefficients: int = 13
    bark_bands: int = len(BARK_EDGES) - 1
    mel_bands: int = 40
    erb_bands: int = 40
    rolloff_cutoff: float = 0.85
    peaks_magnitude_threshold: float = 1e-5
    peaks_max: int = 100
    peaks_min_frequency: float = 20.0
    peaks_max_frequency: float = 8000.0
    energy_bands: tuple[tuple[float, float], ...] = ((20, 150), (150, 800), (800, 4000), (4000, 20000))


class Frames:
    """The frames of a segment with what several groups need, computed once."""

    def __init__(self, x: np.ndarray, rate: float, size: int, hop: int, settings: Settings):
        self.x, self.rate, self.size, self.settings = frame_array(np.asarray(x, float), size, hop), rate, size, settings
        self.f = np.fft.rfftfreq(size, 1 / rate)

    @cached_property
    def m(self) -> np.ndarray:
        return spectra(self.x, self.settings.window)

    @cached_property
    def peaks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        s = self.settings
        return [peaks(row, self.f, s.peaks_magnitude_threshold, s.peaks_min_frequency, s.peaks_max_frequency, s.peaks_max) for row in self.m]

    @cached_property
    def pitch(self) -> np.ndarray:
        return yin(self.m, self.rate, window=self.settings.window)


Group = Callable[[Frames], dict[str, np.ndarray]]
_GROUPS: dict[str, Group] = {}


def group(name: str) -> Callable[[Group], Group]:
    """Make a descriptor group (frames) -> {name: values by frame} available."""

    def keep(made: Group) -> Group:
        _GROUPS[name] = made
        return made

    return keep


@group("dynamics")
def _dynamics(s: Frames) -> dict[str, np.ndarray]:
    power = (s.x**2).mean(axis=1)
    return {"dynamics.rms": np.sqrt(power), "dynamics.loudness": (power * s.size) ** 0.67, "dynamics.power_dB": 10 * np.log10(power + 1e-12)}


@group("spectral")
def _spectral(s: Frames) -> dict[str, np.ndarray]:
    m, f = s.m, s.f
    total = m.sum(axis=1)
    safe = np.where(total > 0, total, 1)
    c = (m @ f) / safe
    moment = lambda k: (m * (f[None, :] - c[:, None]) ** k).sum(axis=1) / safe
    m2 = moment(2)
    spread = np.where(m2 > 0, m2, 1)
    energy = np.cumsum(m**2, axis=1)
    p = m / safe[:, None]
    flux = np.sqrt((np.diff(m, axis=0, prepend=np.zeros((1, m.shape[1]))) ** 2).sum(axis=1))
    slope = ((m - m.mean(axis=1, keepdims=True)) @ (f - f.mean())) / ((f - f.mean()) ** 2).sum()
    top = m.max(axis=1)
    values = {
        "centroid": c, "spread": m2, "skewness": moment(3) / spread**1.5, "kurtosis": moment(4) / spread**2 - 3, "rolloff": f[(energy < s.settings.rolloff_cutoff * energy[:, -1:]).sum(axis=1)],
        "decrease": slope, "entropy": -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1), "hfc": (m**2) @ f, "complexity": np.array([len(peaks(r, f, 0.005, 100, 5000)[0]) for r in m], float),
        "strong_peak": top / np.maximum((m >= top[:, None] / 2).sum(axis=1), 1), "flux": flux,
    }
    for lo, hi in s.settings.energy_bands:
        inside = (f >= lo) & (f < min(hi, s.rate / 2 - 1))
        values[f"energy_band_{lo:g}_{hi:g}"] = (m[:, inside] ** 2).sum(axis=1) / np.where(energy[:, -1] > 0, energy[:, -1], 1)
    return {f"spectral.{k}": v for k, v in values.items()} | _shape("spectral", m)


@group("noisiness")
def _noisiness(s: Frames) -> dict[str, np.ndarray]:
    sign = s.x < 0
    pairs = [dissonance(*p) for p in s.peaks if len(p[0]) > 1]
    r = np.fft.irfft(np.abs(np.fft.rfft(s.x, 2 * s.size, axis=1)) ** 2, axis=1)[:, : s.size // 2]
    top = r[:, int(s.rate / 5000) :].max(axis=1, initial=0.0)
    salience = np.where(r[:, 0] > 0, np.maximum(0.0, top / np.where(r[:, 0] > 0, r[:, 0], 1)), 0.0)
    values = {"zcr": (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / s.size, "pitch_salience": salience, "f0": s.pitch[:, 0], "f0_confidence": s.pitch[:, 1], "n_peaks": np.array([len(p[0]) for p in s.peaks], float)}
    return {f"noisiness.{k}": v for k, v in values.items()} | ({"noisiness.dissonance": np.array(pairs)} if pairs else {})


def _bands(s: Frames, name: str, weights: np.ndarray) -> dict[str, np.ndarray]:
    energies = (s.m**2) @ weights.T
    return _vector(f"{name}.energies", energies) | _shape(name, energies)


group("mfcc")(lambda s: _vector("mfcc.coeffs", cepstra(s.m, mel_weights(s.f, s.settings.mfcc_bands), s.settings.mfcc_coefficients)))
group("gfcc")(lambda s: _vector("gfcc.coeffs", cepstra(s.m, erb_weights(s.f, s.settings.gfcc_bands), s.settings.gfcc_coefficients)))
group("barkbands")(lambda s: _bands(s, "barkbands", bark_weights(s.f, s.settings.bark_bands)))
group("melbands")(lambda s: _bands(s, "melbands", mel_weights(s.f, s.settings.mel_bands)))
group("erbbands")(lambda s: _bands(s, "erbbands", erb_weights(s.f, s.settings.erb_bands)))


@group("harmonic")
def _harmonic(s: Frames) -> dict[str, np.ndarray]:
    found = [v for v in (harmonic_values(*p, f0) for p, f0 in zip(s.peaks, s.pitch[:, 0], strict=True)) if v]
    return {k: np.array([v[k] for v in found]) for k in (found[0] if found else {})}


@group("tonal")
def _tonal(s: Frames) -> dict[str, np.ndarray]:
    profiles = np.array([pitch_classes(*p) for p in s.peaks if (p[0] > 0).any()])
    if not len(profiles):
        return {}
    return _vector("tonal.hpcp", profiles) | {"tonal.hpcp_entropy": np.array([_entropy(v) for v in profiles]), "tonal.hpcp_crest": profiles.max(axis=1) / np.maximum(profiles.mean(axis=1), 1e-300)}


#: The groups that come with this module, in the order of views; :func:`group` adds others.
GROUPS = ("dynamics", "spectral", "noisiness", "mfcc", "gfcc", "barkbands", "melbands", "erbbands", "harmonic", "tonal")


def known_groups() -> list[str]:
    return [*GROUPS, *sorted(set(_GROUPS) - set(GROUPS))]


def _chosen(groups: Sequence[str]) -> dict[str, Group]:
    """The functions of groups, taken on the driver, so that executors need no registry."""
    unknown = [g for g in groups if g not in _GROUPS]
    if unknown:
        raise ValueError(f"unknown groups {unknown}; known: {', '.join(known_groups())}")
    return {g: _GROUPS[g] for g in groups}


def describe_frames(x: np.ndarray, rate: float, groups: Sequence[str] | dict[str, Group], size: int = FRAME, hop: int = HOP, settings: Settings = Settings(), failed: list[str] | None = None) -> dict[str, np.ndarray]:
    """Per-frame values of the asked groups; names whose frames have no value are shorter or missing, those of groups that fail are too."""
    made = groups if isinstance(groups, dict) else _chosen(groups)
    frames, out = Frames(x, rate, size, hop, settings), {}
    if not len(frames.x):
        return {}
    for name, group_of in made.items():
        try:
            out |= group_of(frames)
        except (ValueError, IndexError, np.linalg.LinAlgError):
            if failed is not None:
                failed.append(name)
    return out


def dynamic_complexity(x: np.ndarray, rate: float) -> tuple[float, float]:
    """Mean distance of the level of 0.2 s blocks from the whole level, and that level, in dB."""
    size = max(1, int(0.2 * rate))
    blocks = frame_array(np.asarray(x, float), size, size)
    level = 10 * np.log10((blocks**2).mean(axis=1) + 1e-9)
    whole = 10 * np.log10((blocks**2).mean() + 1e-9)
    return float(np.abs(level - whole).mean()), float(whole)


def describe(segments: DataFrame, rate: float, groups: Sequence[str] = GROUPS[:6], size: int = FRAME, hop: int = HOP, settings: Settings = Settings()) -> DataFrame:
    """Long per-frame values (file, segment, frame, name, value) of segments (file, segment, x)."""
    chosen = _chosen(groups)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for file, segment, x in _signals(batches):
            found = describe_frames(x, rate, chosen, size, hop, settings)
            if found:
                count = np.array([len(v) for v in found.values()])
                columns = [
                    pa.array([file] * int(count.sum()), pa.string()), pa.array(np.full(count.sum(), segment, np.int64)), pa.array(np.concatenate([np.arange(n) for n in count])),
                    pa.array(np.repeat(np.array(list(found), object), count), pa.string()), pa.array(np.concatenate(list(found.values())).astype(float)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "segment", "frame", "name", "value"])

    return segments.selectExpr("file", "cast(segment as bigint) segment", "x").mapInArrow(run, "file string, segment long, frame long, name string, value double")


def _signals(batches: Iterable[pa.RecordBatch]) -> Iterable[tuple[str, int, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("file")[k].as_py(), batch.column("segment")[k].as_py(), np.asarray(batch.column("x")[k].values)


def summarise(values: dict[str, np.ndarray], wanted: Sequence[str]) -> dict[str, float]:
    """Statistics of a segment's frames: name.stat, and for components of a vector name.stat.index.

    Derivatives are differences between neighbouring frames; dmean is the mean of their absolute values, dvar their population
    variance, and the second ones likewise; with too few frames they are left out.  cov and icov are the
    covariance matrix of a vector and its (pseudo-)inverse, row by row.
    """
    out: dict[str, float] = {}
    by_length: dict[int, list[str]] = {}
    for name, v in values.items():
        by_length.setdefault(len(v), []).append(name)
    for length, names in by_length.items():
        if not length:
            continue
        x = np.stack([values[n] for n in names]).astype(float)
        first = np.diff(x, axis=1)
        second = np.diff(first, axis=1)
        made = {
            "mean": lambda: x.mean(axis=1), "stdev": lambda: x.std(axis=1), "var": lambda: x.var(axis=1), "median": lambda: np.median(x, axis=1), "min": lambda: x.min(axis=1), "max": lambda: x.max(axis=1),
            "dmean": lambda: np.abs(first).mean(axis=1), "dvar": lambda: first.var(axis=1), "dmean2": lambda: np.abs(second).mean(axis=1), "dvar2": lambda: second.var(axis=1),
        }
        need = {"dmean": first, "dvar": first, "dmean2": second, "dvar2": second}
        for stat in wanted:
            if stat in made and need.get(stat, x).shape[1]:
                for name, value in zip(names, made[stat]().tolist(), strict=True):
                    base, dot, index = name.rpartition(".")
                    out[f"{base}.{stat}.{index}" if dot and index.isdigit() else f"{name}.{stat}"] = value
        if {"cov", "icov"} & set(wanted):
            for base in dict.fromkeys(re.sub(r"\.\d+$", "", n) for n in names if re.search(r"\.\d+$", n)):
                parts = [k for k, n in enumerate(names) if re.fullmatch(re.escape(base) + r"\.\d+", n)]
                cov = np.atleast_2d(np.cov(x[parts], bias=True))
                for stat, matrix in (("cov", cov), ("icov", np.linalg.pinv(cov) if "icov" in wanted else None)):
                    if stat in wanted:
                        digits = len(str(matrix.size - 1))
                        out |= {f"{base}.{stat}.{k:0{digits}d}": float(v) for k, v in enumerate(matrix.ravel())}
    return out


def describe_segments(segments: DataFrame, rate: float, groups: Sequence[str] = GROUPS[:6], wanted: Sequence[str] = (), size: int = FRAME, hop: int = HOP, settings: Settings = Settings()) -> DataFrame:
    """(file, segment, name, value): statistics of each segment's frames and its values as a whole, in one pass over its samples.

    A segment is whole in its task, so no frame leaves it.  A group that fails leaves its names out; ``failed.<group>`` is 1 then.
    """
    chosen = _chosen(groups)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for file, segment, x in _signals(batches):
            if not len(x):
                continue
            failed: list[str] = []
            found = summarise(describe_frames(x, rate, chosen, size, hop, settings, failed), wanted) | {f"failed.{g}": 1.0 for g in failed}
            found |= whole_values(x, rate, groups, hop)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(found), pa.string()), pa.array(np.full(len(found), segment, np.int64)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())],
                ["file", "segment", "name", "value"],
            )

    return segments.selectExpr("file", "cast(segment as bigint) segment", "x").mapInArrow(run, "file string, segment long, name string, value double")


#: Fixed value: the name of a segment's frame count.
FRAME_COUNT = "essentia.n_frames"


def whole_values(x: np.ndarray, rate: float, groups: Sequence[str], hop: int) -> dict[str, float]:
    """Values of a whole segment that no statistic summarises: the frame count, and of the group dynamics complexity and level."""
    out = {FRAME_COUNT: float(max(1, -(-len(x) // hop)))}
    if "dynamics" in groups:
        out["dynamics.dynamic_complexity"], out["dynamics.loudness_dB"] = dynamic_complexity(x, rate)
    return out


def describe_whole(segments: DataFrame, rate: float, groups: Sequence[str] = GROUPS[:6], hop: int = HOP) -> DataFrame:
    """The values of whole segments alone: (file, segment, name, value); empty segments have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for file, segment, x in _signals(batches):
            if len(x):
                found = whole_values(x, rate, groups, hop)
                yield pa.RecordBatch.from_pydict({"file": [file] * len(found), "segment": [segment] * len(found), "name": list(found), "value": list(found.values())})

    return segments.selectExpr("file", "cast(segment as bigint) segment", "x").mapInArrow(run, "file string, segment long, name string, value double")


ONSET_METHODS = ("hfc", "complex", "complex_phase", "flux", "melflux", "rms", "superflux")


def onset_curve(x: np.ndarray, rate: float, method: str = "complex", size: int = 1024, hop: int = 512) -> np.ndarray:
    """One value per frame that rises where something begins."""
    if method == "superflux":
        size = max(size, 2048)
    frames = frame_array(np.asarray(x, float), size, hop)
    z = np.fft.rfft(frames * np.hanning(size), axis=1)
    m, phase, f = np.abs(z), np.angle(z), np.fft.rfftfreq(size, 1 / rate)
    before = np.vstack([np.zeros((1, m.shape[1])), m[:-1]])
    if method == "rms":
        level = np.sqrt((frames**2).mean(axis=1))
        return np.maximum(np.diff(level, prepend=0), 0)
    if method == "hfc":
        return (m**2) @ f / f[-1]
    if method == "flux":
        return np.maximum(m - before, 0).sum(axis=1)
    if method in ("melflux", "superflux"):
        bands = np.log10(1 + m @ mel_weights(f, 40).T)
        if method == "superflux":
            wide = np.pad(bands, ((0, 0), (1, 1)), mode="edge")
            held = np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
            lag = np.vstack([np.zeros((2, bands.shape[1])), held[:-2]])
            return np.maximum(bands - lag, 0).sum(axis=1)
        return np.maximum(np.diff(bands, axis=0, prepend=np.zeros((1, bands.shape[1]))), 0).sum(axis=1)
    if method in ("complex", "complex_phase"):
        p1 = np.vstack([np.zeros((1, m.shape[1])), phase[:-1]])
        p2 = np.vstack([np.zeros((2, m.shape[1])), phase[:-2]])[: len(m)]
        expected = 2 * p1 - p2
        if method == "complex":
            return np.abs(z - before * np.exp(1j * expected)).sum(axis=1)
        turned = np.angle(np.exp(1j * (phase - expected)))
        return (np.abs(turned) * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-12)
    raise ValueError(f"unknown onset method {method!r}; known: {', '.join(ONSET_METHODS)}")


def pick_onsets(curve: np.ndarray, frame_rate: float, alpha: float = 0.1, delay: int = 5, silence: float = 0.02) -> np.ndarray:
    """Times of frames that are the largest nearby and stand above the recent median and mean."""
    top = curve.max(initial=0)
    if top <= 0:
        return np.zeros(0)
    c = curve / top
    near = np.lib.stride_tricks.sliding_window_view(np.pad(c, 2, constant_values=-np.inf), 5).max(axis=1)
    limit = np.empty(len(c))
    for k in range(min(delay, len(c))):
        limit[k] = np.median(c[: k + 1]) + alpha * c[: k + 1].mean()
    for k in range(delay, len(c), 1 << 16):
        past = np.lib.stride_tricks.sliding_window_view(c[k - delay : k + (1 << 16)], delay + 1)
        limit[k : k + len(past)] = np.median(past, axis=1) + alpha * past.mean(axis=1)
    times: list[int] = []
    for k in np.flatnonzero((c >= silence) & (c == near) & (c > limit)).tolist():
        if not times or k - times[-1] > 2:
            times.append(k)
    return np.array(times) / frame_rate


def whole_chunks(files: DataFrame) -> DataFrame:
    """Files (file, x) as one chunk each."""
    none = F.lit(0).cast("long")
    return files.select("file", none.alias("chunk"), none.alias("first"), none.alias("lead"), F.size("x").cast("long").alias("n"), "x")


def _by_chunk(chunks: DataFrame, size: int, hop: int, before: int, values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(file, k, v): from the frames that begin in each chunk (with halos of ``before`` frames and ``size`` samples), in order, one row of v for each frame from k on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                file, first, lead, n = (batch.column(c)[r].as_py() for c in ("file", "first", "lead", "n"))
                x = np.asarray(batch.column("x")[r].values, float)
                k0, k1 = -(-first // hop), -(-(first + n) // hop)
                warm = min(before, k0)
                begin = (k0 - warm) * hop - (first - lead)
                if k1 > k0:
                    found = values(x[begin : (k1 - 1) * hop - (first - lead) + size])[warm : k1 - k0 + warm]
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([k0], pa.int64()), pa.array([np.ascontiguousarray(found).ravel()], pa.list_(pa.float64()))], ["file", "k", "v"])

    return chunks.select("file", "first", "lead", "n", "x").mapInArrow(run, "file string, k long, v array<double>")


def _edges_of(parts: DataFrame, find: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(file, t) found in the curves of each file: a few numbers for each frame, not its samples."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        t = np.asarray(find(np.concatenate([np.asarray(v.values, float) for v in table["v"]])), float)
        return pa.table({"file": pa.array([table["file"][0].as_py()] * len(t), pa.string()), "t": pa.array(t, pa.float64())})

    return parts.groupBy("file").applyInArrow(run, "file string, t double")


def onset_halo(size: int, hop: int) -> tuple[int, int]:
    """Samples before and after a chunk that its frames of :func:`detect_onsets` need."""
    return 2 * hop, max(size, 2048)


def detect_onsets(chunks: DataFrame, rate: float, method: str = "complex", size: int = 1024, hop: int = 512, alpha: float = 0.1, delay: int = 5, silence: float = 0.02) -> DataFrame:
    """(file, t) of chunks with a halo of at least :func:`onset_halo`."""
    long_frames = max(size, 2048) if method == "superflux" else size
    curves = _by_chunk(chunks, long_frames, hop, 2, lambda x: onset_curve(x, rate, method, size, hop))
    return _edges_of(curves, lambda c: pick_onsets(c, rate / hop, alpha, delay, silence))


class Moments:
    """Log determinants of covariances of any ranges of vectors, from running sums of the vectors and of their outer products.

    Sums are kept every STRIDE vectors; a range's costs a difference of two of them, and less than STRIDE vectors at each end.
    """

    STRIDE = 16

    def __init__(self, v: np.ndarray):
        self.v = v - v.mean(axis=0) if len(v) else v
        n, d = self.v.shape
        whole = self.v[: n // self.STRIDE * self.STRIDE].reshape(-1, self.STRIDE, d)
        self.first = np.concatenate((np.zeros((1, d)), np.cumsum(whole.sum(axis=1), axis=0)))
        self.second = np.concatenate((np.zeros((1, d, d)), np.cumsum(whole.transpose(0, 2, 1) @ whole, axis=0)))
        self.read = len(whole) * self.STRIDE  # vectors whose products were taken so far

    def _upto(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = at // self.STRIDE
        place = block[:, None] * self.STRIDE + np.arange(self.STRIDE)
        rest = np.where((place < at[:, None])[:, :, None], self.v[np.minimum(place, len(self.v) - 1)], 0.0)
        self.read += int((at - block * self.STRIDE).sum())
        return self.first[block] + rest.sum(axis=1), self.second[block] + rest.transpose(0, 2, 1) @ rest

    def spread(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        (s_lo, p_lo), (s_hi, p_hi) = self._upto(lo), self._upto(hi)
        n = (hi - lo).astype(float)
        mean = (s_hi - s_lo) / n[:, None]
        cov = (p_hi - p_lo) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        return np.linalg.slogdet(cov + 1e-8 * np.eye(self.v.shape[1]))[1]


#: Groups of candidates that become one.
_GROUPED = 16


def _first_gain(moments: Moments, gains: Callable[[int, np.ndarray, int], np.ndarray], penalty: Callable[[int, int], float], lo: int, n: int, size: int, step: int, least: int) -> int | None:
    """The first end of a window that grows from lo at which a candidate gains, or None; as if every candidate were tried at every end.

    Let s(a, b) be b - a times the log determinant of a range, and r(lo, at, hi) = s(lo, hi) - s(lo, at) - s(at, hi).  As s is no less than its sum over
    parts of a range, r(lo, at, hi) <= r(lo, at, old) + r(lo, old, hi) for at < old < hi.  Candidates that were tried at an older end are tried again only when
    this bound reaches the penalty.  They are held in groups, older ones in larger groups, whose number grows as the logarithm of the window.
    """
    s = lambda a, b: (b - a) * moments.spread(*np.broadcast_arrays(a, b))
    # What rounding may change in s, which is most where vectors are constant.
    slack = 1 + 8 * moments.v.shape[1] * np.finfo(float).eps * np.abs(moments.second[-1]).max() / 1e-8
    # By level, groups of candidates: the first one and the one after the last, the largest ratio at an older end, that end, and s(lo, end).
    levels: list[list[list]] = [[]]
    hi, known = min(lo + size, n), 0

    def gained(groups: list[list]) -> bool:
        """Try all candidates of some groups at hi."""
        ks = np.concatenate([np.arange(g[0], g[1]) for g in groups])
        found = gains(lo, lo + least + ks * step, hi)
        for group, most in zip(groups, np.maximum.reduceat(found, np.cumsum([0] + [g[1] - g[0] for g in groups[:-1]])), strict=True):
            group[2:] = 2 * (most + penalty(lo, hi)), hi, whole
        return bool(found.max() > 0)

    while True:
        whole = float(s(np.array([lo]), np.array([hi]))[0])
        held = [group for level in levels for group in level]
        again = []
        if held:
            ratio, old, own = (np.array([group[c] for group in held]) for c in (2, 3, 4))
            bound = ratio + whole - own - s(old, np.array([hi]))
            again = [held[k] for k in np.flatnonzero(~(bound < 2 * penalty(lo, hi) - slack))]
        if (there := (hi - lo - 2 * least) // step + 1) > known:
            levels[0].append([known, there, 0.0, hi, whole])
            again.append(levels[0][-1])
            known = there
        if again and gained(again):
            return hi
        for k, level in enumerate(levels):
            if len(level) >= 2 * _GROUPED:
                merged = [level[0][0], level[_GROUPED - 1][1], 0.0, hi, whole]
                del level[:_GROUPED]
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(merged)
                if gained([merged]):
                    return hi
        if hi >= n:
            return None
        hi = min(hi + step, n)


def change_frames(v: np.ndarray, cpw: float = 1.5, size1: int = 300, inc1: int = 60, size2: int = 200, inc2: int = 20, least: int = 10, moments: Moments | None = None) -> list[int]:
    """Frames where two Gaussians describe the vectors around them better than one (Bayesian criterion)."""
    n, d = v.shape
    moments = moments or Moments(v)
    penalty = lambda lo, hi: 0.5 * cpw * (d + d * (d + 1) / 2) * np.log(hi - lo)

    def gains(lo: int, at: np.ndarray, hi: int) -> np.ndarray:
        ends = lambda x: np.full(len(at), x)
        whole = moments.spread(np.array([lo]), np.array([hi]))[0]
        return 0.5 * ((hi - lo) * whole - (at - lo) * moments.spread(ends(lo), at) - (hi - at) * moments.spread(at, ends(hi))) - penalty(lo, hi)

    def gain(lo: int, at: int, hi: int) -> float:
        return float(gains(lo, np.array([at]), hi)[0])

    def best(lo: int, hi: int, step: int) -> tuple[float, int]:
        at = np.arange(lo + least, hi - least + 1, step)
        if not len(at):
            return -1.0, 0
        found = gains(lo, at, hi)
        # Of equal ones the last.
        k = len(at) - 1 - int(found[::-1].argmax())
        return float(found[k]), int(at[k])

    found, lo = [], 0
    while lo + 2 * least <= n:
        hi = _first_gain(moments, gains, penalty, lo, n, size1, inc1, least)
        if hi is None:
            break
        at = best(lo, hi, inc1)[1]
        fine, closer = best(max(lo, at - size2 // 2), min(n, at + size2 // 2), inc2)
        lo = closer if fine > 0 else at
        found.append(lo)
    # A boundary stays if it still separates the pieces on both sides of it.
    kept: list[int] = []
    for k, at in enumerate(found):
        a, b = kept[-1] if kept else 0, found[k + 1] if k + 1 < len(found) else n
        if at - a >= least and b - at >= least and gain(a, at, b) > 0:
            kept.append(at)
    return kept


def sbic_edges(chunks: DataFrame, rate: float, size: int = 2048, hop: int = 1024, coefficients: int = 13, **options) -> DataFrame:
    """(file, t) of timbral changes in files given as chunks (with ``size`` samples of halo after them); too few frames give none, as does no change."""
    least_frames = max(options.get("size1", 300), options.get("size2", 200))
    mel = mel_weights(np.fft.rfftfreq(size, 1 / rate))
    vectors = _by_chunk(chunks, size, hop, 0, lambda x: cepstra(spectra(frame_array(x, size, hop)), mel, coefficients))

    def find(flat: np.ndarray) -> np.ndarray:
        v = flat.reshape(-1, coefficients)
        return np.array(change_frames(v, **options) if len(v) >= least_frames else []) * (hop / rate)

    return _edges_of(vectors, find)


@slicing.register("sbic")
def sbic(totals: DataFrame, chunks: DataFrame, rate: float, size: int, hop: int, coefficients: int, window: float, grid_hop: float | None = None, drop_last_partial: bool = True, **options) -> DataFrame:
    """Bounds between change points of the chunks of files; files of too few frames for the criterion get the constant grid."""
    samples = chunks.groupBy("file").agg(F.sum("n").alias("samples"))
    known = totals.join(samples, "file").withColumn("changing", F.ceil(F.col("samples") / hop) >= max(options.get("size1", 300), options.get("size2", 200)))
    edges = sbic_edges(chunks, rate, size, hop, coefficients, **options)
    ends = known.where("changing").select("file", F.explode(F.array(F.lit(0.0), F.col("total"))).alias("t"))
    inner = edges.join(totals, "file").where("t > 0 AND t < total").select("file", "t")
    return slicing.between_edges(inner.unionByName(ends)).unionByName(slicing.fixed(known.where("NOT changing").select("file", "total"), window, grid_hop, drop_last_partial))
