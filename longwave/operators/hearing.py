"""Loudness and roughness of Sottek's hearing model (ECMA-418-2).

The outer and middle ear, then 53 overlapping auditory bands of half a Bark (gammatone filters of order five, run as complex low passes around each band's centre), rectified and
averaged in blocks that are longer in low bands, and compressed by a chain of power laws.  Roughness takes the bands' envelopes, whose spectra are weighted by loudness, freed of
what is not periodic, and searched for modulation rates.

Of the standard's roughness, the correction tables for the refinement of rates are left out; both units are fixed by their definitions: a tone of 1 kHz and 40 dB has
one sone, and, at 60 dB and fully modulated at 70 Hz, one asper.  Filters are those of the standard at 48 kHz; at other rates the ear's filter is left out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from longwave.operators.recursion import Section, cascade

REFERENCE, ORDER = 20e-6, 5
#: Width of the lowest band in Hz, and how widths grow; the bands' places.
WIDTH, GROWTH = 81.9289, 0.1618
PLACES = np.arange(1, 54) / 2
#: The ear's sections at 48 kHz (b0, b1, b2, a1, a2).
EAR = (
    (1.015896, -1.925299, 0.922118, -1.925299, 0.938014), (0.958943, -1.806088, 0.876439, -1.806088, 0.835382),
    (0.961372, -1.763632, 0.821788, -1.763632, 0.783160), (2.225804, -1.434650, -0.498204, -1.434650, 0.727599),
    (0.471735, -0.366092, 0.244145, -0.366092, -0.284120), (0.115267, 0.000000, -0.115267, -1.796003, 0.805838),
    (0.988029, -1.912434, 0.926132, -1.912434, 0.914161), (1.952238, 0.162320, -0.667994, 0.162320, 0.284244),
)
#: Thresholds in dB and exponents of the compression, and its sharpness.
KNEES, EXPONENTS, ALPHA = (15, 25, 35, 45, 55, 65, 75, 85), (1.0, 0.6602, 0.0864, 0.6384, 0.0328, 0.4068, 0.2082, 0.3994, 0.6434), 1.5
#: Specific loudness at the threshold in quiet, by band.
QUIET = (
    0.3310, 0.1625, 0.1051, 0.0757, 0.0576, 0.0453, 0.0365, 0.0298, 0.0247, 0.0207, 0.0176, 0.0151, 0.0131, 0.0115, 0.0103, 0.0093, 0.0086, 0.0081, 0.0077, 0.0074,
    0.0073, 0.0072, 0.0071, 0.0072, 0.0073, 0.0074, 0.0076, 0.0079, 0.0082, 0.0086, 0.0092, 0.0100, 0.0109, 0.0122, 0.0138, 0.0157, 0.0172, 0.0180, 0.0180, 0.0177,
    0.0176, 0.0177, 0.0182, 0.0190, 0.0202, 0.0217, 0.0237, 0.0263, 0.0296, 0.0339, 0.0398, 0.0485, 0.0622,
)
#: Seconds of a loudness frame; samples of a block at 48 kHz, by the place from which on it holds; samples of an envelope's block.
HOP_SECONDS = 256 / 48_000
BLOCKS = ((0.0, 8192), (2.0, 4096), (8.5, 2048), (13.0, 1024))
ENVELOPE_RATE, ENVELOPE_BLOCK = 1500.0, 512


def centres() -> np.ndarray:
    return WIDTH / GROWTH * np.sinh(GROWTH * PLACES)


def _through_ear(p: np.ndarray, rate: float) -> np.ndarray:
    return cascade([Section(*row) for row in EAR], p)[0] if rate == 48_000 else p


def _band(p: np.ndarray, rate: float, centre: float) -> np.ndarray:
    """The complex output of one auditory band, at the centre frequency moved to zero; its magnitude is the envelope."""
    width = math.sqrt(WIDTH**2 + (GROWTH * centre) ** 2)
    seconds = math.comb(2 * ORDER - 2, ORDER - 1) / 2 ** (2 * ORDER - 1) / width
    d = math.exp(-1 / (rate * seconds))
    turned = p * np.exp(-2j * np.pi * centre / rate * np.arange(len(p)))
    # Five equal real poles, then the numerator that makes the impulse response n^4 d^n.
    weights = np.array([0, 1, 11, 11, 1], float) * d ** np.arange(5)
    weights *= (1 - d) ** ORDER / weights.sum()
    turned = np.convolve(turned, weights)[: len(p)]
    pair, one = Section(1.0, 0.0, 0.0, -2 * d, d * d), Section(1.0, 0.0, 0.0, -d, 0.0)
    return 2 * (cascade([pair, pair, one], turned.real)[0] + 1j * cascade([pair, pair, one], turned.imag)[0])


def _compressed(level: np.ndarray) -> np.ndarray:
    """The compression of a band's effective pressure, up to the unit."""
    out = level / REFERENCE
    for knee, before, after in zip(KNEES, EXPONENTS[:-1], EXPONENTS[1:], strict=True):
        out = out * (1 + (level / (REFERENCE * 10 ** (knee / 20))) ** ALPHA) ** ((after - before) / ALPHA)
    return out


def _bands(p: np.ndarray, rate: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the bands below half the rate, and their complex outputs."""
    ear, centre = _through_ear(np.asarray(p, float), rate), centres()
    held = np.flatnonzero(centre < 0.45 * rate)
    return held, [_band(ear, rate, centre[b]) for b in held]


def _specific(held: np.ndarray, outputs: list[np.ndarray], rate: float, times: np.ndarray) -> np.ndarray:
    """(53, times): compressed effective pressure of the rectified bands in blocks around times (in seconds)."""
    found = np.zeros((len(PLACES), len(times)))
    for b, z in zip(held, outputs, strict=True):
        n = np.arange(len(z))
        rectified = np.maximum((z * np.exp(2j * np.pi * centres()[b] / rate * n)).real, 0) ** 2
        size = max(1, round([s for place, s in BLOCKS if PLACES[b] >= place][-1] * rate / 48_000))
        sums = np.concatenate(([0.0], np.cumsum(rectified)))
        end = np.clip(np.round(times * rate).astype(int) + size // 2, 0, len(z))
        start = np.clip(end - size, 0, len(z))
        found[b] = _compressed(np.sqrt(2 * (sums[end] - sums[start]) / np.maximum(end - start, 1)))
    return found


@lru_cache(maxsize=4)
def _sone(rate: float) -> float:
    """What brings a tone of 1 kHz and 40 dB to one sone."""
    t = np.arange(int(0.6 * rate)) / rate
    held, outputs = _bands(REFERENCE * 100 * np.sqrt(2) * np.sin(2 * np.pi * 1000 * t), rate)
    raw = _specific(held, outputs, rate, np.array([0.4]))
    quiet = np.array(QUIET)[:, None]
    low, high = 1e-4, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.maximum(middle * raw - quiet, 0).sum() * 0.5 < 1 else (low, middle)
    return middle


def _specific_loudness(held: np.ndarray, outputs: list[np.ndarray], rate: float, times: np.ndarray) -> np.ndarray:
    unit = _sone(rate) if rate > 2300 else 0.0217406
    return np.maximum(unit * _specific(held, outputs, rate, times) - np.array(QUIET)[:, None], 0)


def loudness(pressure: np.ndarray, rate: float) -> np.ndarray:
    """Sone (of the hearing model) by frame."""
    held, outputs = _bands(pressure, rate)
    times = np.arange(0, len(pressure) / rate, HOP_SECONDS)
    return _specific_loudness(held, outputs, rate, times).sum(axis=0) * 0.5


# ---- roughness ------------------------------------------------------------------------------------


def _rate_weight(hz: np.ndarray, most: np.ndarray, sharp: float, power: np.ndarray) -> np.ndarray:
    return 1 / (1 + ((hz / most - most / hz) * sharp) ** 2) ** power


def _amplitudes(held: np.ndarray, outputs: list[np.ndarray], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(53, blocks): weighted modulation of each band, and the seconds of the blocks."""
    step = max(1, round(rate / ENVELOPE_RATE))
    slow = rate / step
    envelopes = np.stack([np.abs(z)[: len(z) // step * step].reshape(-1, step).mean(axis=1) for z in outputs])
    if envelopes.shape[1] < ENVELOPE_BLOCK:
        envelopes = np.pad(envelopes, ((0, 0), (0, ENVELOPE_BLOCK - envelopes.shape[1])))
    starts = np.arange(0, envelopes.shape[1] - ENVELOPE_BLOCK + 1, ENVELOPE_BLOCK // 4)
    times = (starts + ENVELOPE_BLOCK / 2) / slow
    specific = _specific_loudness(held, outputs, rate, times)
    window, hz = np.hanning(ENVELOPE_BLOCK), np.arange(ENVELOPE_BLOCK // 2) * slow / ENVELOPE_BLOCK
    centre = centres()[held] / 1000
    out = np.zeros((len(PLACES), len(starts)))
    # Rate of the largest weight, and how weights fall off, by centre in kHz.
    most = np.maximum(72.6937 * (1 - 1.1739 * np.exp(-5.4583 * centre)), 20.0)
    low = centre < 1
    peak = 1 / (1 + np.where(low, 0.3560, 0.8024) * np.abs(np.log2(centre)) ** np.where(low, 0.8049, 0.9333))
    fast_power = np.where(low, 0.2471, 0.2471 + 0.0129 * np.log2(np.maximum(centre, 1)) ** 2)
    slow_power = np.maximum(1.0967 - 0.0640 * np.log2(centre), 0.2471)
    for t, s in enumerate(starts.tolist()):
        loud = specific[held, t]
        block = envelopes[:, s : s + ENVELOPE_BLOCK] * window
        energy = (block**2).sum(axis=1)
        if loud.max() <= 0:
            continue
        power = np.abs(np.fft.rfft(block, axis=1)[:, : len(hz)]) ** 2
        power = np.where(energy[:, None] > 0, (loud**2 / loud.max())[:, None] * power / np.maximum(energy, 1e-30)[:, None], 0.0)
        padded = np.pad(power, ((1, 1), (0, 0)))
        power = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
        # What stands out of the median over rates is periodic; the rest is noise.
        whole = power.sum(axis=0)
        periodic = 0.0856 * whole / (np.median(whole[2:]) + 1e-10) * np.clip(0.1891 * np.exp(0.0120 * np.arange(len(hz))), 0, 1)
        power = power * (np.clip(periodic - 0.1407, 0, 1) if periodic[2:].max(initial=0) >= 0.05 else 0.0)
        inner = (power[:, 2:-1] > power[:, 1:-2]) & (power[:, 2:-1] >= power[:, 3:]) & (power[:, 2:-1] > 0.05 * power[:, 2:].max(axis=1, keepdims=True))
        for b in np.flatnonzero(inner.any(axis=1)):
            k = np.flatnonzero(inner[b]) + 2
            k = k[np.argsort(-power[b, k])[:10]]
            around = power[b, k[:, None] + np.array([-1, 0, 1])]
            bend = around[:, 0] - 2 * around[:, 1] + around[:, 2]
            found = (k + np.where(bend < 0, (around[:, 0] - around[:, 2]) / (2 * np.where(bend < 0, bend, -1)), 0)) * slow / ENVELOPE_BLOCK
            size = around.sum(axis=1) * peak[b] * np.where(found > most[b], _rate_weight(found, most[b], 1.2822, fast_power[b]), 1.0)
            # The fundamental whose multiples hold most; its own rate decides how slow modulation is weighted.
            ratio = found[None, :] / found[:, None]
            of = (np.round(ratio) >= 1) & (np.abs(ratio / np.maximum(np.round(ratio), 1) - 1) < 0.04)
            held_by = (of * size[None, :]).sum(axis=1)
            first = int(held_by.argmax())
            total = held_by[first]
            if found[first] < most[b]:
                total *= _rate_weight(found[first], most[b], 0.7066, slow_power[b])
            out[held[b], t] = total if total >= 0.074376 else 0.0
    return out, times


def _rough(pressure: np.ndarray, rate: float) -> np.ndarray:
    """Roughness by 20 ms, up to the unit."""
    held, outputs = _bands(pressure, rate)
    found, times = _amplitudes(held, outputs, rate)
    grid = np.arange(0, max(len(pressure) / rate, 0.02), 0.02)
    fine = np.maximum(np.stack([np.interp(grid, times, row) for row in found]), 0)
    square, mean = np.sqrt((fine**2).mean(axis=0)), fine.mean(axis=0)
    spread = np.divide(square, mean, out=np.zeros_like(mean), where=mean > 0)
    power = 0.95555 * (np.tanh(1.6407 * (spread - 2.5804)) + 1) / 2 + 0.58449
    raw = fine**power
    smooth, now = np.empty_like(raw), raw[:, 0]
    up, down = math.exp(-0.02 / 0.0625), math.exp(-0.02 / 0.5)
    for t in range(raw.shape[1]):
        keep = np.where(raw[:, t] >= now, up, down)
        now = raw[:, t] * (1 - keep) + now * keep
        smooth[:, t] = now
    return smooth.sum(axis=0) * 0.5


@lru_cache(maxsize=4)
def _asper(rate: float) -> float:
    t = np.arange(int(1.2 * rate)) / rate
    tone = (1 + np.sin(2 * np.pi * 70 * t)) * np.sin(2 * np.pi * 1000 * t)
    return float(_rough(tone * REFERENCE * 1000 / np.sqrt((tone**2).mean()), rate)[20:40].mean())


def roughness(pressure: np.ndarray, rate: float) -> np.ndarray:
    """Asper (of the hearing model), fifty values a second."""
    if rate <= 2300:  # the reference tone cannot be sampled at this rate
        return np.zeros(max(1, int(len(pressure) / rate / 0.02)))
    return _rough(np.asarray(pressure, float), rate) / _asper(rate)
