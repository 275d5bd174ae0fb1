import numpy as np
import pytest

from longwave.operators import kernels, psycho, similarity

RATE = 44100
T = np.arange(RATE) / RATE


def sine(f, level=1.0):
    return level * np.sin(2 * np.pi * f * T)


def test_sine_descriptors():
    d = kernels.describe_frames(sine(1000.0), RATE, kernels.GROUPS)
    inner = slice(2, -4)
    assert abs(np.median(d["spectral.centroid"][inner]) - 1000) < 60
    assert abs(np.median(d["noisiness.f0"][inner]) - 1000) < 2
    assert abs(np.median(d["dynamics.rms"][inner]) - 2**-0.5) < 0.01
    assert np.median(d["noisiness.zcr"][inner]) == pytest.approx(2000 / RATE, rel=0.05)
    assert len([k for k in d if k.startswith("mfcc.coeffs.")]) == 13
    assert "mfcc.coeffs.00" in d and "barkbands.energies.26" in d


def test_silence_and_empty():
    d = kernels.describe_frames(np.zeros(RATE // 4), RATE, kernels.GROUPS)
    assert np.all(d["noisiness.f0"] == RATE / 2) and np.all(d["dynamics.rms"] == 0)
    assert kernels.describe_frames(np.zeros(0), RATE, kernels.GROUPS) == {}


def test_noise_is_flatter_than_a_tone():
    noise = np.random.default_rng(0).standard_normal(RATE // 2)
    flat = lambda x: np.median(kernels.describe_frames(x, RATE, ["spectral"])["spectral.flatness"])
    assert flat(noise) > 0.3 > flat(sine(440.0))


def test_harmonic_tone():
    x = sum(sine(220.0 * k, 1 / k) for k in range(1, 8))
    d = kernels.describe_frames(x, RATE, ["harmonic", "tonal"])
    assert np.median(d["harmonic.inharmonicity"]) < 0.05
    profile = [np.median(d[f"tonal.hpcp.{k:02d}"]) for k in range(12)]
    assert int(np.argmax(profile)) == 0


@pytest.mark.parametrize("method", kernels.ONSET_METHODS)
def test_onsets_of_bursts(method):
    x = np.zeros(2 * RATE)
    for at in (0.5, 1.2):
        k = int(at * RATE)
        x[k : k + 4000] = np.random.default_rng(1).standard_normal(4000) * np.exp(-np.arange(4000) / 900)
    t = kernels.pick_onsets(kernels.onset_curve(x, RATE, method), RATE / 512)
    assert any(abs(v - 0.5) < 0.06 for v in t) and any(abs(v - 1.2) < 0.06 for v in t)


def test_change_point_between_two_textures():
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(0, 1, (200, 4)), rng.normal(3, 1, (200, 4))])
    found = kernels.change_frames(v, size1=120, inc1=20, size2=80, inc2=4)
    assert any(abs(k - 200) <= 8 for k in found) and len(found) <= 3
    assert kernels.change_frames(rng.normal(0, 1, (300, 4))) == []


def test_resampling_keeps_a_sine():
    y = kernels.resample_array(sine(500.0), RATE, 48000)
    expected = np.sin(2 * np.pi * 500.0 * np.arange(len(y)) / 48000)
    assert len(y) == 48000 and np.abs(y - expected)[200:-200].max() < 1e-3
    assert kernels.resample_array(np.zeros(0), 3, 2).size == 0


def test_psychoacoustic_units():
    p = lambda db: sine(1000.0) * np.sqrt(2) * 20e-6 * 10 ** (db / 20)
    quiet, loud = (psycho.loudness(p(db), RATE)["psycho.loudness.mean"] for db in (40, 70))
    assert 0.4 < quiet < 2.5 and loud > 4 * quiet
    assert psycho.sharpness(sine(6000.0) * 0.02, RATE)["psycho.sharpness.mean"] > psycho.sharpness(sine(300.0) * 0.02, RATE)["psycho.sharpness.mean"]
    modulated = sine(1000.0) * (1 + np.sin(2 * np.pi * 70 * T))
    assert psycho.roughness(modulated, RATE)["psycho.roughness.mean"] > 20 * psycho.roughness(sine(1000.0), RATE)["psycho.roughness.mean"]
    assert psycho.tonality(sine(1000.0), RATE)["psycho.tonality.strongest_tone_Hz"] == pytest.approx(1000, abs=1)
    assert psycho.tonality(np.zeros(4096), RATE)["psycho.tonality.n_tones"] == 0


def test_linkage_and_cut():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.2, (10, 3)) for c in (0, 5, 10)])
    d = similarity.distance_matrix(x, "euclidean")
    for method in similarity.LINKAGES:
        labels = similarity.cut_tree(similarity.linkage(d, method), 3)
        assert labels.tolist() == [1] * 10 + [2] * 10 + [3] * 10


def test_single_linkage_is_the_spanning_tree():
    x = np.random.default_rng(4).normal(size=(30, 2))
    d = similarity.distance_matrix(x, "euclidean")
    inside, heights = {0}, []
    while len(inside) < len(x):
        h, j = min((d[i, j], j) for i in inside for j in range(len(x)) if j not in inside)
        inside.add(j)
        heights.append(h)
    assert np.allclose(np.sort(similarity.linkage(d, "single")[:, 2]), np.sort(heights))


def test_plot_data():
    from longwave.operators import plots

    assert plots.colour_threshold([1.0, 2.0, 5.0], 2) == 5.0 and plots.colour_threshold([1.0], 1) == 0.0
    assert plots.facets([1, 2, 2]) == [[1, 2]] and plots.facets([1, 2, 3, 4]) == [[1], [2], [3], [4]]
    assert "weak separation" in plots.report([{"cluster": 1, "n": 2, "seconds": 3.0, "share": 100.0, "mean_s": 0.1}])[-1]


def test_vector_names(spark):
    from longwave.operators import stats

    v = spark.createDataFrame([("f", 0, 0, "mfcc.coeffs.00", 1.0), ("f", 0, 0, "spectral.flux", 2.0)], "file string, segment long, frame long, name string, value double")
    assert sorted(r["name"] for r in stats.frame_stats(v, ["mean"]).collect()) == ["mfcc.coeffs.mean.00", "spectral.flux.mean"]


def test_pitch_of_all_frames_at_once():
    rate = 44_100
    t = np.arange(3 * rate) / rate
    # From 300 Hz: below, the ear's weighting pulls the single peak of a sine up, though not a sound with harmonics.
    sweep = np.sin(2 * np.pi * (300 * t + 300 * t * t))
    frames = kernels.frame_array(sweep, 2048, 1024)[:-3]
    found = kernels.yin(kernels.spectra(frames), rate)
    true = 300 + 600 * (np.arange(len(frames)) * 1024 + 1024) / rate
    assert (np.abs(found[:, 0] / true - 1) < 0.01).mean() > 0.97 and found[:, 1].min() > 0.5
    for hz in (82.4, 220.0, 987.0):
        saw = sum(np.sin(2 * np.pi * hz * n * t[:8192]) / n for n in range(1, 12))
        assert kernels.yin(kernels.spectra(kernels.frame_array(saw, 2048, 1024)[:4]), rate)[:, 0] == pytest.approx(hz, rel=0.01)
    silent = kernels.yin(np.zeros((2, 1025)), rate)
    assert silent.tolist() == [[rate / 2, 0.0]] * 2
