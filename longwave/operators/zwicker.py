"""Time-varying loudness by Zwicker's method (ISO 532-1) and what builds on its specific loudness.

Third-octave bands by recursive filters, squared and smoothed to levels every half millisecond; critical bands with the ear's transmission; core loudness; a non-linear decay in time (sounds
that end fade slowly, the longer they were); upper slopes along 240 steps of 0.1 Bark, by which a loud band masks those above it; and
two low passes on the total.  All bands, and all frames of a segment, are worked on at once.

The third-octave filters are Butterworth band passes of order six, designed for the rate at hand, not the standard's fixed set for 48 kHz.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from longwave.operators.recursion import Section, cascade_bank

#: Fixed values (ISO 532-1, DIN 45631).  Of the third-octave bands from 25 Hz to 12.5 kHz, the eleven lowest lose
#: level: the columns, in steps of corrected level (rows up to these levels in dB).
LOW_LEVELS = (45.0, 55.0, 65.0, 71.0, 80.0, 90.0, 100.0, 120.0)
LOW_WEIGHTS = (
    (-32, -24, -16, -10, -5, 0, -7, -3, 0, -2, 0),
    (-29, -22, -15, -10, -4, 0, -7, -2, 0, -2, 0),
    (-27, -19, -14, -9, -4, 0, -6, -2, 0, -2, 0),
    (-25, -17, -12, -9, -3, 0, -5, -2, 0, -2, 0),
    (-23, -16, -11, -7, -3, 0, -4, -1, 0, -1, 0),
    (-20, -14, -10, -6, -3, 0, -4, -1, 0, -1, 0),
    (-18, -12, -9, -6, -2, 0, -3, -1, 0, -1, 0),
    (-15, -10, -8, -4, -2, 0, -3, -1, 0, -1, 0),
)
#: Threshold in quiet, transmission of the ear, diffuse against free field, and third octaves
#: against critical bands, in dB, for the 20 critical bands; then the upper limits of 21 bands in Bark.
QUIET = (30, 18, 12, 8, 7, 6, 5, 4, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3)
EAR = (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -0.5, -1.6, -3.2, -5.4, -5.6, -4, -1.5, 2, 5, 12)
DIFFUSE = (0, 0, 0.5, 0.9, 1.2, 1.6, 2.3, 2.8, 3, 2, 0, -1.4, -2, -1.9, -1, 0.5, 3, 4, 4.3, 4)
CRITICAL = (-0.25, -0.6, -0.8, -0.8, -0.5, 0, 0.5, 1.1, 1.5, 1.7, 1.8, 1.8, 1.7, 1.6, 1.4, 1.2, 0.8, 0.5, 0, -0.5)
LIMITS = (0.9, 1.8, 2.8, 3.5, 4.4, 5.4, 6.6, 7.9, 9.2, 10.6, 12.3, 13.8, 15.2, 16.7, 18.1, 19.3, 20.6, 21.8, 22.7, 23.6, 24.0)
#: Specific loudness from which down each row of slopes holds, and slopes in sone per Bark and Bark, by critical band.
SLOPE_FROM = (21.5, 18.0, 15.1, 11.5, 9.0, 6.1, 4.4, 3.1, 2.13, 1.36, 0.82, 0.42, 0.30, 0.22, 0.15, 0.10, 0.035, 0.0)
SLOPES = (
    (13.0, 8.2, 6.3, 5.5, 5.5, 5.5, 5.5, 5.5),
    (9.0, 7.5, 6.0, 5.1, 4.5, 4.5, 4.5, 4.5),
    (7.8, 6.7, 5.6, 4.9, 4.4, 3.9, 3.9, 3.9),
    (6.2, 5.4, 4.6, 4.0, 3.5, 3.2, 3.2, 3.2),
    (4.5, 3.8, 3.6, 3.2, 2.9, 2.7, 2.7, 2.7),
    (3.7, 3.0, 2.8, 2.35, 2.2, 2.2, 2.2, 2.2),
    (2.9, 2.3, 2.1, 1.9, 1.8, 1.7, 1.7, 1.7),
    (2.4, 1.7, 1.5, 1.35, 1.3, 1.3, 1.3, 1.3),
    (1.95, 1.45, 1.3, 1.15, 1.1, 1.1, 1.1, 1.1),
    (1.5, 1.2, 0.94, 0.86, 0.82, 0.82, 0.82, 0.82),
    (0.72, 0.67, 0.64, 0.63, 0.62, 0.62, 0.62, 0.62),
    (0.59, 0.53, 0.51, 0.5, 0.42, 0.42, 0.42, 0.42),
    (0.4, 0.33, 0.26, 0.24, 0.22, 0.22, 0.22, 0.22),
    (0.27, 0.21, 0.2, 0.18, 0.17, 0.17, 0.17, 0.17),
    (0.16, 0.15, 0.14, 0.12, 0.11, 0.11, 0.11, 0.11),
    (0.12, 0.11, 0.1, 0.08, 0.08, 0.08, 0.08, 0.08),
    (0.09, 0.08, 0.07, 0.06, 0.06, 0.06, 0.06, 0.05),
    (0.06, 0.05, 0.03, 0.02, 0.02, 0.02, 0.02, 0.02),
)
#: Seconds of the decay's short, long and variable constants, and of the two low passes with their shares.
SHORT, LONG, VARIABLE = 0.005, 0.015, 0.075
WEIGHTING = ((0.0035, 0.47), (0.070, 0.53))
REFERENCE = 20e-6
BANDS, STEPS = 28, 240
#: Levels a second, and frames of loudness a second.
LEVEL_RATE, FRAME_RATE = 2000, 500


class Loudness(NamedTuple):
    total: np.ndarray  # sone, by frame
    specific: np.ndarray  # (240, frames): sone per Bark at 0.1, 0.2, ... 24 Bark
    bark: np.ndarray
    seconds: np.ndarray


def band_centres() -> np.ndarray:
    """Exact centres of the third octaves from 25 Hz to 12.5 kHz."""
    return 1000.0 * 2 ** (np.arange(-16, BANDS - 16) / 3)


@lru_cache(maxsize=8)
def third_octaves(rate: float) -> tuple[np.ndarray, tuple[Section, ...]]:
    """Which bands lie below half the rate, and their filters: three sections each, with a gain of one at the centre.

    A Butterworth low pass of order three, turned into a band pass and brought to samples by the bilinear transform with the edges warped.
    """
    centre = band_centres()
    held = centre * 2 ** (1 / 6) < 0.49 * rate
    low, high = (2 * rate * np.tan(np.pi * centre[held] * 2 ** (s / 6) / rate) for s in (-1, 1))
    middle, width = np.sqrt(low * high), high - low
    zero = 2 * rate
    # Each pole of the low pass gives two of the band pass; of conjugates one will do, which with its conjugate makes a section.
    poles = []
    for pole in (np.exp(2j * np.pi / 3), -1.0 + 0j):
        half = pole * width / 2
        root = np.sqrt(half * half - middle * middle)
        poles += [half + root, half - root] if pole.imag else [half + root]
    made = []
    for pole in poles:
        z = (zero + pole) / (zero - pole)
        a1, a2 = -2 * z.real, np.abs(z) ** 2
        at = np.exp(-2j * np.pi * centre[held] / rate)
        gain = 1 / np.abs((1 - at * at) / (1 + a1 * at + a2 * at * at))
        made.append(Section(gain[:, None], np.zeros_like(gain)[:, None], -gain[:, None], a1[:, None], a2[:, None]))
    return held, tuple(made)


def _low_pass(seconds: np.ndarray | float, rate: float) -> Section:
    keep = np.exp(-1 / (rate * np.asarray(seconds, float)))
    return Section(1 - keep, np.zeros_like(keep), np.zeros_like(keep), -keep, np.zeros_like(keep))


def band_levels(p: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """(28, frames): third-octave levels in dB, and frames a second (LEVEL_RATE, or the rate if that is lower)."""
    held, sections = third_octaves(rate)
    power = cascade_bank(sections, np.broadcast_to(np.asarray(p, float), (int(held.sum()), len(p)))) ** 2
    smooth = _low_pass(2 / (3 * np.minimum(band_centres()[held], 1000.0))[:, None], rate)
    power = cascade_bank([smooth] * 3, power)
    step = max(1, round(rate / LEVEL_RATE))
    out = np.full((BANDS, len(range(0, len(p), step))), -100.0)
    out[held] = 10 * np.log10(np.maximum(power[:, ::step], 0) / REFERENCE**2 + 1e-10)
    return out, rate / step


def core_loudness(levels: np.ndarray, field: str = "free") -> np.ndarray:
    """(21, frames): core loudness of 20 critical bands, and silence in the last one."""
    low, weights = levels[:11], np.array(LOW_WEIGHTS, float)
    fits = low[None] <= np.array(LOW_LEVELS)[:, None, None] - weights[:, :, None]
    row = np.where(fits.any(axis=0), fits.argmax(axis=0), len(LOW_LEVELS) - 1)
    intensity = 10 ** ((low + weights[row, np.arange(11)[:, None]]) / 10)
    grouped = np.stack([intensity[a:b].sum(axis=0) for a, b in ((0, 6), (6, 9), (9, 11))])
    level = np.concatenate((10 * np.log10(np.maximum(grouped, 1e-10)), levels[11:]))
    column = lambda values: np.array(values, float)[:, None]
    excitation = level - column(EAR) + (column(DIFFUSE) if field == "diffuse" else 0.0)
    above = excitation - column(CRITICAL) - column(QUIET)
    share = 0.25
    core = 0.0635 * 10 ** (0.025 * column(QUIET)) * ((1 - share + share * 10 ** (0.1 * above)) ** 0.25 - 1)
    core = np.where(excitation > column(QUIET), np.maximum(core, 0), 0.0)
    core[0] *= np.minimum(1, 0.4 + 0.32 * core[0] ** 0.2)
    return np.concatenate((core, np.zeros((1, core.shape[1]))))


def decayed(core: np.ndarray, rate: float) -> np.ndarray:
    """The core loudness with the non-linear decay: two coupled stores that charge at once and discharge in 5, 15 and 75 ms."""
    dt = 1 / rate
    p, q = (VARIABLE + LONG) / (VARIABLE * SHORT), 1 / (SHORT * VARIABLE)
    r1, r2 = -p / 2 + math.sqrt(p * p / 4 - q), -p / 2 - math.sqrt(p * p / 4 - q)
    den, e1, e2 = VARIABLE * (r1 - r2), math.exp(r1 * dt), math.exp(r2 * dt)
    g1, g2 = VARIABLE * r1 + 1, VARIABLE * r2 + 1
    b0, b1, b2, b3 = (e1 - e2) / den, (g2 * e1 - g1 * e2) / den, (g1 * e1 - g2 * e2) / den, g1 * g2 * (e1 - e2) / den
    slow, charge = math.exp(-dt / LONG), math.exp(-dt / VARIABLE)
    out, held, store = np.empty_like(core), np.zeros(len(core)), np.zeros(len(core))
    for t in range(core.shape[1]):
        now = core[:, t]
        both = held > store
        falling = np.where(both, held * b2 - store * b3, held * slow)
        after = np.where(now < held, np.maximum(now, falling), now)
        emptied = np.where(both, np.minimum(held * b0 - store * b1, after), after)
        filled = (store - now) * charge + now
        store = np.where(now < held, emptied, np.where((np.abs(now - held) < 1e-5) & ~both, now, filled))
        held = after
        out[:, t] = after
    return out


def with_slopes(core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total loudness and specific loudness at every 0.1 Bark: each band's core, or what the slopes of those below it leave."""
    frames = core.shape[1]
    start, slope = np.array(SLOPE_FROM), np.array(SLOPES)
    edges = np.round(10 * np.array(LIMITS)).astype(int)
    band_of = np.searchsorted(edges, np.arange(STEPS), "right")
    level, total, out = np.zeros(frames), np.zeros(frames), np.empty((STEPS, frames))
    for step in range(STEPS):
        band = band_of[step]
        floor, column = core[band], max(0, min(band - 1, 7))
        level = np.maximum(level, floor)
        left = np.full(frames, 0.1)
        while True:
            down = (level > floor) & (left > 1e-12)
            if not down.any():
                break
            # The first row whose limit is below the level: rows hold down to their limit.
            row = np.minimum(np.searchsorted(-start, -level, "right"), len(start) - 1)
            goal = np.maximum(start[row], floor)
            steep = slope[row, column]
            width = np.where(down, np.minimum(left, np.maximum(level - goal, 0) / steep), 0.0)
            lower = np.where(down & (width < left), goal, level - width * steep)
            lower = np.where(down, lower, level)
            total += width * (level + lower) / 2
            left, level = left - width, lower
        total += left * level
        out[step] = level
    return total, out


def time_varying(p: np.ndarray, rate: float, field: str = "free") -> Loudness:
    """The loudness of a pressure signal, FRAME_RATE frames a second."""
    levels, level_rate = band_levels(p, rate)
    total, specific = with_slopes(decayed(core_loudness(levels, field), level_rate))
    weighted = sum(share * cascade_bank([_low_pass(seconds, level_rate)], total[None])[0] for seconds, share in WEIGHTING)
    step = max(1, round(level_rate / FRAME_RATE))
    return Loudness(weighted[::step], specific[:, ::step], np.arange(1, STEPS + 1) / 10, np.arange(0, len(total), step) / level_rate)


def sharpness(found: Loudness) -> np.ndarray:
    """DIN 45692, in acum, by frame: the weighted first moment of the specific loudness; 0 below 0.1 sone."""
    z = found.bark[:, None]
    weight = np.where(z > 15.8, 0.15 * np.exp(0.42 * (z - 15.8)) + 0.85, 1.0)
    moment = (found.specific * weight * z).sum(axis=0) * 0.1
    area = found.specific.sum(axis=0) * 0.1
    return np.where(area >= 0.1, 0.11 * moment / np.maximum(area, 1e-12), 0.0)
