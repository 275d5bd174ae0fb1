import io
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from longwave.functions import scalars
from longwave.operators import features, stats
from longwave.sources import config, files, sinks


def _wav(samples, rate=8000, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[0])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes((samples.T.reshape(-1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_wav_round_trip_and_errors(spark, tmp_path):
    x = np.vstack([np.sin(np.arange(800) / 10), np.zeros(800)])
    (tmp_path / "A.WAV").write_bytes(_wav(x))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("no audio")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in files.read_audio(files.scan_folder(spark, str(tmp_path)), rate=8000, how="left").collect()}
    assert set(rows) == {"A.WAV", "bad.wav"} and rows["bad.wav"]["error"]
    good = rows["A.WAV"]
    assert good["channels"] == 2 and good["duration"] == pytest.approx(0.1) and np.allclose(good["x"], x[0], atol=1e-3)
    late = files.read_audio(files.scan_folder(spark, str(tmp_path)), rate=8000, start=9.0).where("error LIKE 'no audio%'").count()
    assert late == 1
    assert [p.rsplit("/", 1)[1] for p in files.expand_inputs([str(tmp_path), str(tmp_path / "A.WAV")])] == ["A.WAV", "bad.wav"]


def test_markers(spark):
    lines = [("p", 0, "# comment"), ("p", 1, "start\tend"), ("p", 2, "1.5\t\t2.5\tname"), ("p", 3, "3"), ("c", 0, "1,x"), ("c", 1, ""), ("c", 2, "2")]
    rows = files.parse_markers(spark.createDataFrame(lines, "file string, ord long, line string")).orderBy("file", "ord").collect()
    assert [(r["file"], r["start"], r["end"]) for r in rows if not math.isnan(r["end"])] == [("p", 1.5, 2.5)]
    assert [r["start"] for r in rows] == [1.0, 2.0, 1.5, 3.0]


def test_segment_table_keeps_three_kinds_of_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("segment,start,end,a.b\n0.0,0.0,1.0,nan\n1.0,1.0,2.5,inf\n2.0,2.5,3.0,\n")
    t = files.read_segment_table(spark, str(tmp_path / "t.csv"))
    rows = t.orderBy("segment").collect()
    assert [r["duration"] for r in rows] == [1.0, 1.5, 0.5]
    assert math.isnan(rows[0]["a.b"]) and rows[1]["a.b"] == math.inf and rows[2]["a.b"] is None
    assert files.long_form(t.withColumn("file", F.lit("x"))).count() == 2
    (tmp_path / "u.csv").write_text("start,end\n0,1\n")
    with pytest.raises(ValueError, match="segment"):
        files.read_segment_table(spark, str(tmp_path / "u.csv"))


def test_scalars(spark):
    one = spark.createDataFrame([([1.0, -1.0], [], [0.0])], "x array<double>, e array<double>, z array<double>")
    r = one.select(scalars.spl(F.col("x"), 94.0), scalars.spl(F.col("e"), 94.0), scalars.spl(F.col("z"), 94.0)).first()
    assert r[0] == pytest.approx(94 + 10 * math.log10(2)) and math.isnan(r[1]) and r[2] == -math.inf
    texts = [("family.name.mean",), ("name.mean",), ('a"b,c',)]
    got = [tuple(x) for x in spark.createDataFrame(texts, "t string").select(scalars.short_name(F.col("t")), scalars.csv_field(F.col("t"))).collect()]
    assert got == [("name.mean", "family.name.mean"), ("name.mean", "name.mean"), ('a"b,c', '"a""b,c"')]
    v = [(None,), (float("nan"),), (float("inf"),), (0.1234565,)]
    assert [x[0] for x in spark.createDataFrame(v, "v double").select(scalars.format_number(F.col("v"))).collect()][:3] == ["", "nan", "inf"]
    n = [(t,) for t in ("1", "-.5", "1e-3", "+1", "nan", "1.")]
    assert [x[0] for x in spark.createDataFrame(n, "t string").select(stats.is_numeric(F.col("t"))).collect()] == [True, True, True, False, False, True]


def test_glob_selection():
    names = ["b.y.mean", "a.x.mean", "a.x.stdev", "a.z"]
    assert features.glob_select(names, ["a.z", "*.mean", "none", "a.*"]) == ["a.z", "a.x.mean", "b.y.mean", "a.x.stdev"]
    assert features.order_columns(["z", "end", "segment", "a", "start"]) == ["segment", "start", "end", "a", "z"]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"segmentation": {"window": 5.0, "hop": 2.5}}))
    c = config.load(str(p))
    assert (c.segmentation.window, c.segmentation.hop, c.segmentation.max_duration) == (5.0, 2.5, 30.0)
    config.validate(c)
    for bad in ({"none": 1}, {"segmentation": 3}, {"segmentation": {"none": 1}}, []):
        with pytest.raises(ValueError):
            config.overlay(config.AnalysisConfig(), bad)
    c.segmentation.method = "markers"
    with pytest.raises(ValueError, match="marker"):
        config.validate(c)
    for section, key, value in (("psychoacoustics", "metrics", ["none"]), ("output", "label_formats", ["none"]), ("essentia", "stats", ["none"]), ("essentia", "window", "none"), ("segmentation", "window", 0)):
        c = config.AnalysisConfig()
        setattr(getattr(c, section), key, value)
        with pytest.raises(ValueError, match=key):
            config.validate(c)
    with pytest.raises(AttributeError):
        c.audio.none = 1
    config.validate(config.AnalysisConfig())


def test_sinks(spark, tmp_path):
    seg = spark.createDataFrame([("f", 0, 0.0, 1.5), ("f", 1, 1.5, 2.0)], "file string, segment long, start double, end double")
    marks = sinks.markers(seg, 10.0)
    assert [r["line"] for r in sinks.label_format("audacity")[0](marks).orderBy("ord").collect()] == ["10.000000\t11.500000\t0000", "11.500000\t12.000000\t0001"]
    assert sinks.reaper(marks, regions=False).orderBy("ord").first()["line"] == "M1,0000,10.000000,,0,"
    text = sinks.script([r["line"] for r in sinks.reaper_script(marks).orderBy("ord").collect()])
    assert '{10.000000, 11.500000, "0000", 128, 128, 128},' in text
    (path,) = sinks.write_files(*sinks.label_lines(marks, "reaper")[:1], str(tmp_path / "labels"), ".regions.csv")
    assert open(path).read() == "#,Name,Start,End,Length,Color\nR1,0000,10.000000,11.500000,1.500000,\nR2,0001,11.500000,12.000000,0.500000,\n"
    (path,) = sinks.write_files(*sinks.label_lines(marks, "reaper_script")[:1], str(tmp_path / "labels"), ".lua", basename="named")
    assert path.endswith("labels/named.lua") and open(path).read() == text
    with pytest.raises(ValueError):
        sinks.label_format("none")
    long = spark.createDataFrame([("f", 0, 0.0, 1.5, 1.5, "a.b", 1.0), ("f", 1, 1.5, 2.0, 0.5, "a.c", float("nan"))], "file string, segment long, start double, end double, duration double, name string, value double")
    wide = sinks.wide_form(long, ["a.c", "a.b"])
    assert wide.columns == ["file", "segment", "start", "end", "duration", "a.b", "a.c"]
    (path,) = sinks.segments_csv(wide, str(tmp_path / "csv"))
    assert open(path, "rb").read() == b"segment,start,end,duration,a.b,a.c\r\n0.0,0.0,1.5,1.5,1.0,\r\n1.0,1.5,2.0,0.5,,nan\r\n"
    again = files.read_segment_table(spark, path)
    assert again.where("`a.b` IS NULL").count() == 1 and again.where("isnan(`a.c`)").count() == 1
    assert json.loads(sinks.plot_payload([{"start": 0.0, "end": 1.0, "a": math.nan, "b": 2.0}], ["a", "b"], ["a"]))["initial"] == ["b"]
    assert "NaN" in sinks.analysis_json({}, {}, [], {"x": math.nan}, [])


def test_rollup_of_texts(spark):
    t = spark.createDataFrame([("a", 0.0, 2.0, "2", "1.0"), ("a", 2.0, 3.0, "1", "nan"), ("a", 3.0, 9.0, "x", "5"), ("b", 0.0, 1.0, "0", "1")], "file string, start double, end double, duration string, v string")
    rows = {r["file"]: r for r in stats.file_rollup(t, ["v"]).collect()}
    assert (rows["a"]["n_segments"], rows["a"]["duration"], rows["a"]["v"]) == (3, 9.0, 1.0) and rows["b"]["v"] is None


def test_degenerate_features(spark):
    t = spark.createDataFrame([("f", 0, "k", 1.0), ("f", 1, "k", 1.0), ("f", 0, "v", 1.0), ("f", 1, "v", 3.0), ("f", 0, "gap", 1.0)], "file string, segment long, name string, value double")
    assert [tuple(r) for r in features.usable_features(t).collect()] == [("f", "v")]
    assert sorted(r["z"] for r in features.standardise(t).collect()) == [-1.0, 1.0]
    assert features.standardise(t.where("false")).count() == 0
