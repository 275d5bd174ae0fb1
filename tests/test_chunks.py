"""Chunked audio, resampling, recursion and loudness against whole files and plain versions."""

import io
import struct
import wave

import numpy as np
import pytest

from longwave.operators import kernels, loudness, recursion, resampling
from longwave.sources import files, ranges


def pcm(x, rate, width=2):
    """A WAV file of (channels, samples)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(width)
        w.setframerate(rate)
        whole = (np.asarray(x).T * ((1 << (8 * width - 1)) - 1)).round().astype("<i4")
        w.writeframes(whole.reshape(-1, 1).view(np.uint8)[:, :width].tobytes())
    return out.getvalue()


def floats(x, rate):
    data = np.asarray(x).T.astype("<f4").tobytes()
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 3, len(x), rate, rate * 4 * len(x), 4 * len(x), 32)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made, rng = tmp_path_factory.mktemp("long"), np.random.default_rng(0)
    (made / "a.wav").write_bytes(pcm(rng.standard_normal((2, 50_001)) * 0.1, 8000, 3))
    (made / "b.wav").write_bytes(pcm(rng.standard_normal((1, 30_000)) * 0.1, 44_100))
    (made / "bad.wav").write_bytes(b"RIFF....WAVEnothing")
    (made / "short.wav").write_bytes(pcm(np.zeros((1, 5)), 8000))
    return str(made)


@pytest.mark.parametrize("rate", [8000, 6000, 48_000])
def test_chunks_are_the_whole_file(spark, folder, rate):
    found = spark.read.format("binaryFile").load(folder)
    whole = {r["file"]: r for r in files.read_audio(found, rate, "mix", 0.1, 5.0).collect()}
    heads = ranges.excerpts(ranges.headers(found), rate, 0.1, 5.0)
    assert {r["file"]: r["error"] is None for r in heads.collect()} == {f: r["error"] is None for f, r in whole.items()}
    parts, pairs = {}, {}
    for r in ranges.read_ranges(ranges.chunk_ranges(heads, 4096, 100, 200), rate, stereo=True).orderBy("file", "chunk").collect():
        assert r["lead"] == min(100, r["first"]) and r["n"] <= 4096
        inner = slice(r["lead"], r["lead"] + r["n"])
        parts.setdefault(r["file"], []).append(np.array(r["x"])[inner])
        pairs.setdefault(r["file"], []).append(None if r["stereo"] is None else np.array(r["stereo"])[:, inner])
    assert len(parts) == 2
    for f, x in parts.items():
        assert np.abs(np.concatenate(x) - np.array(whole[f]["x"])).max() <= 1e-12
        if whole[f]["stereo"] is None:
            assert pairs[f][0] is None
        else:
            assert np.abs(np.concatenate(pairs[f], axis=1) - np.array(whole[f]["stereo"])).max() <= 1e-12


def test_segments_are_read_from_their_bytes(spark, folder):
    found = spark.read.format("binaryFile").load(folder)
    heads = ranges.excerpts(ranges.headers(found), 6000, 0.5)
    name = next(r["file"] for r in heads.collect() if r["file"].endswith("a.wav"))
    segments = spark.createDataFrame([(name, 0, 0.0, 1.0), (name, 1, 0.75, 2.25), (name, 2, 5.5, 99.0), (name, 3, 4.0, 4.0)], "file string, segment long, start double, end double")
    read = ranges.read_ranges(ranges.segments_of(heads, segments, 6000), 6000)
    assert read.columns == ["file", "segment", "start", "end", "x"]
    whole = np.array(next(r["x"] for r in files.read_audio(found, 6000, start=0.5).collect() if r["file"] == name))
    joined = ranges.assemble(ranges.read_ranges(ranges.chunk_ranges(heads, 1000), 6000), segments, 6000, 1000)
    for table in (read, joined):
        for r in table.collect():
            want = whole[round(r["start"] * 6000) : round(r["end"] * 6000)]
            assert len(r["x"]) == len(want) and np.allclose(r["x"], want, rtol=0, atol=1e-12)


def test_halos_from_neighbours(spark):
    rows = [("f", i, float(i)) for i in range(2500)] + [("g", i, -float(i)) for i in range(3)]
    chunks = ranges.chunked(spark.createDataFrame(rows, "file string, i long, x double"), 1000)
    got = {(r["file"], r["chunk"]): r for r in ranges.with_halo(chunks, 7, 20).collect()}
    assert got[("f", 1)]["x"] == [float(i) for i in range(993, 2020)] and got[("f", 1)]["lead"] == 7
    assert got[("f", 2)]["x"] == [float(i) for i in range(1993, 2500)] and got[("f", 0)]["lead"] == 0
    assert got[("g", 0)]["x"] == [0.0, -1.0, -2.0] and len(got) == 4


def test_headers(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((2, 700)) * 0.1
    (tmp_path / "float.wav").write_bytes(floats(x, 16_000))
    plain = pcm(x, 16_000)
    size = len(plain) - 44
    # RF64: sizes beyond 4 GB stand in a chunk of their own.
    wide = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, size, 700, 0) + plain[12:36] + b"data" + struct.pack("<I", 0xFFFFFFFF) + plain[44:]
    (tmp_path / "wide.wav").write_bytes(wide)
    (tmp_path / "adpcm.wav").write_bytes(plain[:20] + struct.pack("<H", 2) + plain[22:])
    (tmp_path / "cut.wav").write_bytes(plain[:-400])
    rows = {r["file"].rsplit("/", 1)[1]: r for r in ranges.headers(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (rows["float.wav"]["kind"], rows["float.wav"]["frames"], rows["wide.wav"]["frames"], rows["cut.wav"]["frames"]) == ("f", 700, 700, 600)
    assert "not PCM" in rows["adpcm.wav"]["error"]
    head = ranges.Header(*(rows["float.wav"][c] for c in ranges._HEAD_NAMES))
    assert np.allclose(ranges.read_frames(rows["float.wav"]["file"], head, 10, 20), x[:, 10:20], atol=1e-7)


def test_a_row_beyond_its_bound_is_an_error(spark, folder, monkeypatch):
    heads = ranges.excerpts(ranges.headers(spark.read.format("binaryFile").load(folder)), 8000)
    with pytest.raises(Exception, match="max_duration"):
        ranges.read_ranges(ranges.chunk_ranges(heads, 1 << 24).where("chunk = 0").withColumn("to", ranges.F.lit(1 << 24).cast("long")), 8000).collect()


@pytest.mark.parametrize(("source", "target"), [(44_100, 48_000), (48_000, 44_100), (3, 2), (8000, 44_100)])
def test_resampling_by_ranges_and_by_samples(spark, source, target):
    x = np.random.default_rng(2).standard_normal(3001)
    whole = resampling.resample_array(x, source, target)
    assert len(whole) == -(-3001 * target // source)
    # Straight from the definition.
    b = resampling.bank(source, target)
    for j in (0, 1, len(whole) // 2, len(whole) - 1):
        gap = j * source / target - np.arange(len(x))
        cutoff = min(1.0, target / source)
        weight = cutoff * np.sinc(cutoff * gap) * np.where(np.abs(gap) < b.reach, 0.5 + 0.5 * np.cos(np.pi * gap / b.reach), 0)
        assert whole[j] == pytest.approx((weight * x).sum(), abs=1e-11)
    for first, last in ((0, 100), (777, 1500), (len(whole) - 3, len(whole))):
        a, z = resampling.input_range(first, last, len(x), source, target)
        assert np.abs(resampling.resample_range(x[a:z], a, first, last, source, target) - whole[first:last]).max() <= 1e-12
    if target < 48_000:
        rows = spark.createDataFrame([("f", k, float(v)) for k, v in enumerate(x)], "file string, i long, x double")
        got = resampling.resample_samples(rows, source, target).orderBy("i").collect()
        assert [r["i"] for r in got] == list(range(len(whole))) and np.allclose([r["x"] for r in got], whole, atol=1e-12)


def plain_filter(section, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        past = lambda v, k: v[n - k] if n >= k else 0.0  # noqa: B023, E731
        y[n] = section.b0 * x[n] + section.b1 * past(x, 1) + section.b2 * past(x, 2) - section.a1 * past(y, 1) - section.a2 * past(y, 2)
    return y


def test_recursion_in_blocks_and_chunks(spark):
    x = np.random.default_rng(3).standard_normal(5003)
    sections = loudness.k_weighting(48_000)
    want = plain_filter(sections[1], plain_filter(sections[0], x))
    whole, _ = recursion.cascade(sections, x)
    assert np.abs(whole - want).max() < 1e-9
    samples = spark.createDataFrame([("f", k, float(v)) for k, v in enumerate(x)], "file string, i long, x double")
    states = {r["chunk"]: r["state"] for r in recursion.chunk_states(ranges.chunked(samples, 1000), sections).collect()}
    for k in range(6):
        part, _ = recursion.cascade(sections, x[1000 * k : 1000 * (k + 1)], states[k])
        assert np.abs(part - want[1000 * k : 1000 * (k + 1)]).max() < 1e-9
    assert len(recursion.filtered(sections[0], np.zeros(0))[0]) == 0


def tone(level, seconds, rate=48_000, hz=997.0):
    return 10 ** (level / 20) * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def globals_of(spark, x, size, rate=48_000):
    rows = [("f", c, c * size, len(x[c * size : (c + 1) * size]), x[c * size : (c + 1) * size].tolist(), [x[c * size : (c + 1) * size].tolist()] * 2) for c in range(-(-len(x) // size))]
    chunks = spark.createDataFrame(rows, "file string, chunk long, first long, n long, x array<double>, stereo array<array<double>>")
    return {r["name"]: r["value"] for r in loudness.file_globals(chunks, rate).collect()}


def test_programme_loudness(spark):
    # EBU Tech 3341, cases 1 and 3 with shorter parts (a loud one between quiet ones, which the relative gate leaves out); Tech 3342, case 1.
    one = globals_of(spark, tone(-23, 6), 1 << 16)
    assert one["global.loudness_integrated_LUFS"] == pytest.approx(-23, abs=0.1) and one["global.loudness_range_LU"] == pytest.approx(0, abs=0.1)
    gated = globals_of(spark, np.concatenate((tone(-36, 2), tone(-23, 30), tone(-36, 2))), 1 << 16)
    assert gated["global.loudness_integrated_LUFS"] == pytest.approx(-23, abs=0.1)
    steps = np.concatenate((tone(-20, 10), tone(-30, 10)))
    apart = globals_of(spark, steps, 1 << 16)
    assert apart["global.loudness_range_LU"] == pytest.approx(10, abs=1)
    whole = globals_of(spark, steps, len(steps))
    assert all(whole[k] == pytest.approx(v, abs=1e-9) for k, v in apart.items())
    silent = globals_of(spark, np.zeros(48_000 * 4), 1 << 16)
    assert silent["global.loudness_integrated_LUFS"] == -70 and silent["global.loudness_short_term_max_LUFS"] < -70
    complexity, level = kernels.dynamic_complexity(steps, 48_000)
    assert apart["global.dynamic_complexity"] == pytest.approx(complexity, abs=1e-9) and apart["global.loudness_dB"] == pytest.approx(level, abs=1e-9)


@pytest.mark.parametrize("method", kernels.ONSET_METHODS)
def test_edges_by_chunks(spark, method):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(40_000) * np.repeat(rng.choice([0.01, 0.5], 20), 2000)
    whole = spark.createDataFrame([("f", x.tolist())], "file string, x array<double>")
    want = kernels.pick_onsets(kernels.onset_curve(x, 8000, method, 512, 256), 8000 / 256)
    samples = ranges.chunked(spark.createDataFrame([("f", k, float(v)) for k, v in enumerate(x)], "file string, i long, x double"), 9000)
    chunks = ranges.with_halo(samples, *kernels.onset_halo(512, 256))
    for frames in (kernels.whole_chunks(whole), chunks):
        assert sorted(r["t"] for r in kernels.detect_onsets(frames, 8000, method, 512, 256).collect()) == want.tolist() and len(want)


def test_changes_by_chunks(spark):
    rng = np.random.default_rng(5)
    low = np.cumsum(rng.standard_normal(20_000)) % 1.0 - 0.5
    x = np.concatenate((low * 0.2, rng.standard_normal(20_000) * 0.3))
    chunks = ranges.with_halo(ranges.chunked(spark.createDataFrame([("f", k, float(v)) for k, v in enumerate(x)], "file string, i long, x double"), 7000), 0, 512)
    options = dict(size1=60, inc1=10, size2=40, inc2=4)
    found = [r["t"] for r in kernels.sbic_edges(chunks, 8000, 512, 256, 6, **options).collect()]
    assert any(abs(t - 2.5) < 0.2 for t in found)
    whole = kernels.whole_chunks(spark.createDataFrame([("f", x.tolist())], "file string, x array<double>"))
    assert sorted(found) == sorted(r["t"] for r in kernels.sbic_edges(whole, 8000, 512, 256, 6, **options).collect())


def test_running_moments_are_covariances():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 5)) @ rng.standard_normal((5, 5)) + 300
    v[400:] = v[400:] * 3 - 700
    moments = kernels.Moments(v)
    for lo, hi in ((0, 900), (3, 20), (16, 32), (399, 431), (100, 101)):
        want = np.linalg.slogdet(np.cov(v[lo:hi].T, bias=True) + 1e-8 * np.eye(5))[1]
        assert moments.spread(np.array([lo]), np.array([hi]))[0] == pytest.approx(want, abs=0.05 if hi - lo < 6 else 1e-6)
    counted = kernels.Moments(v)
    before = counted.read
    assert any(abs(k - 400) <= 20 for k in kernels.change_frames(v, moments=counted))
    # A pass over a window for each of its candidates would read it whole: some 300 vectors three times, for ten candidates or more.
    asked = kernels.Moments(v)
    asked.spread(np.full(20, 0), np.arange(20, 40))
    assert asked.read - len(v) // 16 * 16 < 20 * 16 and counted.read - before < 0.1 * 900 * 900


def _plain_changes(v, size, step, least):
    """The first end of a growing window at which a candidate gains, by trying all of them at every end."""
    s = lambda a, b: (b - a) * np.linalg.slogdet(np.cov(v[a:b].T, bias=True) + 1e-8 * np.eye(v.shape[1]))[1]
    d, n = v.shape[1], len(v)
    for hi in [*range(size, n, step), n]:
        if any(s(0, hi) - s(0, at) - s(at, hi) > 1.5 * (d + d * (d + 1) / 2) * np.log(hi) for at in range(least, hi - least + 1, step)):
            return hi
    return None


@pytest.mark.parametrize("change", [None, 470, 800])
def test_growing_windows_miss_no_gain(monkeypatch, change):
    v = np.random.default_rng(7).standard_normal((900, 4))
    v[change or 900 :] *= 1.8
    ends, found = [], kernels._first_gain
    monkeypatch.setattr(kernels, "_first_gain", lambda *a: ends.append(found(*a)) or ends[-1])
    kernels.change_frames(v, size1=60, inc1=10, size2=40, inc2=4)
    assert ends[0] == _plain_changes(v, 60, 10, 10) and (change is None) == (ends[0] is None)


def test_windows_without_changes_are_not_read_again_and_again():
    v = np.random.default_rng(8).standard_normal((6000, 4))
    read = []
    for n in (1500, 6000):
        moments = kernels.Moments(v[:n])
        assert kernels.change_frames(v[:n], size1=60, inc1=10, size2=40, inc2=4, moments=moments) == []
        read.append(moments.read)
    # All candidates at every end would read sixteen times as much.
    assert read[1] < 7 * read[0]
