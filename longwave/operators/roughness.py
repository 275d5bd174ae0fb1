"""Roughness after Daniel and Weber: modulation in 47 overlapping critical bands, weighted by rate, and how far neighbouring bands agree.

A frame of 200 ms is turned into excitations: each spectral component excites the channel it falls into, those below it down a slope of 27 dB per Bark, and those above along a slope that its
level flattens.  A channel's envelope gives a mean and, weighted by modulation rate, a fluctuation; their ratio is the modulation depth.  Neighbouring channels
(one Bark apart) count as far as their fluctuations correlate.  The unit is fixed by its definition: a tone of 1 kHz and 60 dB, fully modulated at 70 Hz, has one asper.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

CHANNELS, FRAME_SECONDS, REFERENCE = 47, 0.2, 20e-6
LOWER_SLOPE = 27.0
#: Fixed values (Daniel and Weber 1997): weights of modulation rates (Hz, weight), for channels from this number on.
RATE_WEIGHTS = {
    1: ((0, 0), (17, 0.8), (23, 0.95), (25, 0.975), (32, 1), (37, 0.975), (48, 0.9), (67, 0.8), (90, 0.7), (114, 0.6), (171, 0.4), (206, 0.3), (247, 0.2), (294, 0.1), (358, 0)),
    5: ((0, 0), (32, 0.8), (43, 0.95), (56, 1), (69, 0.975), (92, 0.9), (120, 0.8), (142, 0.7), (165, 0.6), (231, 0.4), (277, 0.3), (331, 0.2), (397, 0.1), (502, 0)),
    16: ((0, 0), (23.5, 0.4), (34, 0.6), (47, 0.8), (56, 0.9), (63, 0.95), (79, 1), (100, 0.975), (115, 0.95), (135, 0.9), (159, 0.85), (172, 0.8), (194, 0.7), (215, 0.6), (244, 0.5), (290, 0.4), (348, 0.3), (415, 0.2), (500, 0.1), (645, 0)),
    21: ((0, 0), (19, 0.4), (44, 0.8), (52.5, 0.9), (58, 0.95), (75, 1), (101.5, 0.95), (114.5, 0.9), (132.5, 0.85), (143.5, 0.8), (165.5, 0.7), (197.5, 0.6), (241, 0.5), (290, 0.4), (348, 0.3), (415, 0.2), (500, 0.1), (645, 0)),
    42: ((0, 0), (15, 0.4), (41, 0.8), (49, 0.9), (53, 0.965), (64, 0.99), (71, 1), (88, 0.95), (94, 0.9), (106, 0.85), (115, 0.8), (137, 0.7), (180, 0.6), (238, 0.5), (290, 0.4), (348, 0.3), (415, 0.2), (500, 0.1), (645, 0)),
}
#: Weight of a channel by its place in Bark, transmission of the ear (Bark, dB), and threshold in quiet (Bark, dB).
PLACE_WEIGHTS = ((0, 0), (1, 0.35), (2.5, 0.7), (4.9, 0.7), (6.5, 1.1), (8, 1.25), (9, 1.26), (10, 1.18), (11, 1.08), (11.5, 1), (13, 0.66), (17.5, 0.46), (21, 0.38), (24, 0.3))
EAR = ((0, 0), (10, 0), (12, 1.15), (13, 2.31), (14, 3.85), (15, 5.62), (16, 6.92), (16.5, 7.38), (17, 6.92), (18, 4.23), (18.5, 2.31), (19, 0), (20, -1.43), (21, -2.59), (21.5, -3.57), (22, -5.19), (22.5, -7.41), (23, -11.3), (23.5, -20), (24, -40))
QUIET = ((0, 130), (0.01, 70), (0.17, 60), (0.8, 30), (1, 25), (1.5, 20), (2, 15), (3.3, 10), (4, 8.1), (5, 6.3), (6, 5), (8, 3.5), (10, 2.5), (12, 1.7), (13.3, 0), (15, -2.5), (16, -4), (17, -3.7), (18, -1.5), (19, 1.4), (20, 3.8), (21, 5), (22, 7.5), (23, 15), (24, 48), (24.5, 60), (25, 130))


def _at(points, x):
    where, what = zip(*points, strict=True)
    return np.interp(x, where, what)


def bark(hz: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.76 * hz / 1000) + 3.5 * np.arctan((hz / 7500) ** 2)


class Plan(NamedTuple):
    window: np.ndarray
    bins: np.ndarray  # those of the spectrum that are audible
    place: np.ndarray  # their Bark
    gain: np.ndarray  # from magnitudes to pressure, with the ear's transmission
    quiet: np.ndarray  # their threshold in dB
    steep: np.ndarray  # the part of the upper slope that frequency sets
    rates: np.ndarray  # (channels, modulation bins)
    weight: np.ndarray  # of channels


@lru_cache(maxsize=8)
def plan(size: int, rate: float) -> Plan:
    f = np.fft.rfftfreq(size, 1 / rate)
    place = bark(f)
    bins = np.flatnonzero((f >= 20) & (place <= 24))
    window = np.blackman(size)
    centre = np.arange(1, CHANNELS + 1) / 2
    gain = 2 / window.sum() / np.sqrt(2) * 10 ** (_at(EAR, place[bins]) / -20)
    names = sorted(RATE_WEIGHTS)
    rates = np.stack([_at(RATE_WEIGHTS[max(n for n in names if n <= c)], f) for c in range(1, CHANNELS + 1)])
    return Plan(window, bins, place[bins], gain, _at(QUIET, place[bins]), 24 + 230 / f[bins], rates, _at(PLACE_WEIGHTS, centre))


def _frame(x: np.ndarray, p: Plan) -> float:
    """Roughness of one frame, up to the unit."""
    size = len(x)
    spectrum = np.fft.rfft(x * p.window)[p.bins] * p.gain
    level = 20 * np.log10(np.maximum(np.abs(spectrum), 1e-12) / REFERENCE)
    heard = level > p.quiet
    if not heard.any():
        return 0.0
    spectrum, level, place, bins = spectrum[heard], level[heard], p.place[heard], p.bins[heard]
    upper = np.maximum(p.steep[heard] - 0.2 * level, 0.0)
    centre = np.arange(1, CHANNELS + 1)[:, None] / 2
    above, below = (centre - 0.5) - place, place - (centre + 0.5)
    lost = np.where(above > 0, above * upper, np.where(below > 0, below * LOWER_SLOPE, 0.0))
    excited = level - lost
    part = np.where(excited > _at(QUIET, centre), 10 ** (-lost / 20), 0.0)
    full = np.zeros((CHANNELS, size), complex)
    full[:, bins] = part * spectrum
    envelope = np.abs(np.fft.ifft(full, axis=1)) * size
    mean = envelope.mean(axis=1)
    moved = np.fft.irfft(np.fft.rfft(envelope - mean[:, None], axis=1) * p.rates, size, axis=1)
    spread = np.sqrt((moved**2).mean(axis=1))
    depth = np.minimum(np.divide(spread, mean, out=np.zeros(CHANNELS), where=mean > 0), 1.0)
    # Channels two numbers apart are neighbours without overlap.
    power = spread[:-2] * spread[2:]
    agree = np.divide((moved[:-2] * moved[2:]).mean(axis=1), power, out=np.zeros(CHANNELS - 2), where=power > 0)
    before, after = np.concatenate((agree[:1], agree[:1], agree)), np.concatenate((agree, agree[-1:], agree[-1:]))
    return float(((p.weight * depth * np.sqrt(np.abs(before * after))) ** 2).sum())


@lru_cache(maxsize=8)
def unit(size: int, rate: float) -> float:
    """What the reference sound gives: a tone of 1 kHz and 60 dB, fully modulated at 70 Hz."""
    t = np.arange(size) / rate
    tone = (1 + np.sin(2 * np.pi * 70 * t)) * np.sin(2 * np.pi * 1000 * t)
    return _frame(tone * REFERENCE * 10 ** (60 / 20) / np.sqrt((tone**2).mean()), plan(size, rate))


def daniel_weber(pressure: np.ndarray, rate: float, overlap: float = 0.5) -> np.ndarray:
    """Asper by frame; a shorter signal is one frame, filled up with silence."""
    size = max(8, int(FRAME_SECONDS * rate))
    x = np.pad(np.asarray(pressure, float), (0, max(0, size - len(pressure))))
    one = unit(size, rate) if rate > 2200 else 0.0
    if not one:  # the reference tone cannot be sampled at this rate
        return np.zeros(1 + (len(x) - size) // max(1, int(size * (1 - overlap))))
    p = plan(size, rate)
    return np.array([_frame(x[s : s + size], p) for s in range(0, len(x) - size + 1, max(1, int(size * (1 - overlap))))]) / one
