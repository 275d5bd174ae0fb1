"""Tonality tries every maximum; configured durations and percentiles arrive."""

import numpy as np
import pytest

from longwave.operators import hearing, psycho, zwicker
from longwave.operators.roughness import daniel_weber

RATE = 8000


def test_weak_tone_beside_strong_noise():
    rng = np.random.default_rng(8)
    n = 4 * RATE
    spectrum = np.fft.rfft(rng.standard_normal(n))
    f = np.fft.rfftfreq(n, 1 / RATE)
    p = np.fft.irfft(np.where(f < 1500, spectrum, 1e-5 * spectrum), n) + 1e-3 * np.sin(2 * np.pi * 3000 * np.arange(n) / RATE)
    found = psycho.tonality(p, RATE)
    assert found["psycho.tonality.strongest_tone_Hz"] == pytest.approx(3000, abs=1)
    assert found["psycho.tonality.pr_max_dB"] > 20 and found["psycho.tonality.pr_total_dB"] >= found["psycho.tonality.pr_max_dB"] - 1e-9
    assert psycho.tonality(rng.standard_normal(n), RATE)["psycho.tonality.pr_total_dB"] == 0


def test_configured_durations_and_percentiles(spark):
    x = [float(v) for v in np.sin(np.arange(RATE))]
    rows = spark.createDataFrame([("a", 0, x), ("a", 1, x[: RATE // 2])], "file string, segment long, x array<double>")
    got = {(r["segment"], r["name"]): r["value"] for r in psycho.describe(rows, RATE, ["loudness"], least=0.6, most=0.75, percentiles=[20.0]).collect()}
    assert got[(0, "psycho.analysed_duration")] == 0.75 and got[(1, "psycho.skipped")] == 1
    assert (0, "psycho.loudness.N_20") in got and (0, "psycho.loudness.N_5") not in got


# ---- models against published values


def tone(hz, db, seconds=1.0, rate=48_000):
    return np.sqrt(2) * 20e-6 * 10 ** (db / 20) * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def modulated(hz, by, db=60, depth=1.0, rate=48_000):
    t = np.arange(rate) / rate
    x = (1 + depth * np.sin(2 * np.pi * by * t)) * np.sin(2 * np.pi * hz * t)
    return x * 20e-6 * 10 ** (db / 20) / np.sqrt((x * x).mean())


@pytest.mark.parametrize(("hz", "db", "sone"), [(1000, 40, 1.0), (1000, 60, 4.019), (250, 80, 14.655), (4000, 40, 1.549)])
def test_loudness_of_the_standards_tones(hz, db, sone):
    # Test signals 2 to 4 of ISO 532-1, and the definition of the sone.
    assert zwicker.time_varying(tone(hz, db), 48_000).total[-50:].mean() == pytest.approx(sone, rel=0.05)


def test_loudness_in_time():
    burst = lambda seconds: zwicker.time_varying(np.concatenate((tone(1000, 70, seconds), np.zeros(9600))), 48_000).total
    assert burst(0.01).max() < 0.75 * burst(0.1).max() < burst(0.5).max()  # short sounds are softer
    after = lambda seconds: burst(seconds)[int(500 * (seconds + 0.02))] / burst(seconds).max()
    assert after(0.005) < after(0.2)  # and fade faster
    assert zwicker.time_varying(np.zeros(4800), 48_000).total.max() == 0


def test_a_loud_tone_masks_what_is_above_it():
    loud, soft = tone(1000, 85), tone(1400, 45)
    alone, both = (zwicker.time_varying(x, 48_000) for x in (loud, loud + soft))
    # On its own the soft tone is heard, beside the loud one it adds next to nothing; below the loud one it would.
    assert zwicker.time_varying(soft, 48_000).total[-1] > 1 and both.total[-1] - alone.total[-1] < 0.02 * alone.total[-1]
    pattern = alone.specific[:, -1]
    assert pattern[110] > 4 * pattern[60] and 79 <= pattern.argmax() <= 92


def test_slopes_integrate_what_they_leave():
    core = np.zeros((21, 3))
    core[5] = (0.5, 5.0, 30.0)
    total, specific = zwicker.with_slopes(core)
    assert (np.diff(specific[54:], axis=0) <= 1e-12).all() and (specific[:44] == 0).all()
    assert np.allclose(total, specific.sum(axis=0) * 0.1, rtol=0.1) and (specific[44:54] == core[5]).all()


def test_sharpness_of_the_reference_noise():
    f = np.fft.rfftfreq(96_000, 1 / 48_000)
    noise = np.fft.irfft(np.where((f > 920) & (f < 1080), np.exp(2j * np.pi * np.random.default_rng(0).random(len(f))), 0))
    found = zwicker.time_varying(noise * 20e-6 * 1000 / np.sqrt((noise**2).mean()), 48_000)
    assert zwicker.sharpness(found)[300:].mean() == pytest.approx(1, rel=0.05)


def test_roughness_by_rate_and_depth():
    # Daniel and Weber: one asper at 70 Hz; about depth to the power 1.6; band-pass in rate, lower and slower in low bands.
    curve = {by: daniel_weber(modulated(1000, by), 48_000).mean() for by in (20, 40, 70, 100, 160)}
    assert curve[70] == pytest.approx(1, rel=0.01) and max(curve.values()) == curve[70] and curve[20] < 0.3 and 0.5 < curve[40] < 0.8 and 0.6 < curve[100] < 0.9 and curve[160] < 0.4
    for depth in (0.4, 0.6, 0.8):
        assert daniel_weber(modulated(1000, 70, depth=depth), 48_000).mean() == pytest.approx(depth**1.6, rel=0.15)
    low = {by: daniel_weber(modulated(250, by), 48_000).mean() for by in (30, 45, 90)}
    assert low[45] > low[90] and low[45] > low[30] and low[45] < 0.5
    assert daniel_weber(tone(1000, 60), 48_000).max() < 0.05 and daniel_weber(np.zeros(100), 48_000).tolist() == [0.0]


def test_hearing_model_units_and_growth():
    level = {db: hearing.loudness(tone(1000, db, 0.5), 48_000)[50:80].mean() for db in (0, 40, 60, 80)}
    assert level[40] == pytest.approx(1, rel=0.01) and level[0] == pytest.approx(0, abs=0.1) and 2 < level[60] < 4 and 6 < level[80] < 11
    assert hearing._sone(48_000.0) == pytest.approx(0.0217406, rel=0.01)  # the standard's own constant
    assert hearing.roughness(modulated(1000, 70), 48_000)[20:40].mean() == pytest.approx(1, rel=0.05)
    assert hearing.roughness(modulated(1000, 20), 48_000)[20:40].mean() < 0.3 and hearing.roughness(tone(1000, 60), 48_000)[20:40].mean() < 0.05


def test_all_metrics_at_odd_rates():
    for rate in (1000, 8000, 44_100):
        x = 0.02 * np.random.default_rng(1).standard_normal(rate // 2)
        for name in psycho.metrics():
            made = psycho._METRICS[name](x, rate)
            assert made and all(np.isfinite(v) for v in made.values()), (rate, name)
