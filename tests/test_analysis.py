import json
import os

import numpy as np
import pytest

from longwave import analysis, cli
from longwave.sources.config import AnalysisConfig
from tests.test_sources import _wav


def test_analysis_of_files(spark, tmp_path):
    t = np.arange(3 * 8000) / 8000
    (tmp_path / "tone.wav").write_bytes(_wav(np.sin(2 * np.pi * 500 * t)[None, :] * 0.5))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    c = AnalysisConfig()
    c.audio.sample_rate, c.segmentation.window, c.essentia.groups = 8000, 1.0, ["dynamics", "spectral"]
    c.psychoacoustics.sample_rate = 8000
    out = analysis.analyse(spark, [str(tmp_path / "tone.wav"), str(tmp_path / "bad.wav")], c)
    assert out.segments.count() == 3
    values = {(r["segment"], r["name"]): r["value"] for r in out.table.collect()}
    assert values[(1, "spectral.centroid.median")] == pytest.approx(500, rel=0.1)
    assert values[(1, "psycho.skipped")] == 0.0
    assert out.pieces.where("error IS NOT NULL").count() == 1
    assert {r["name"] for r in out.summary.collect()} >= {"dynamics.rms.mean"}
    for method in ("onset", "sbic"):
        c.segmentation.method = method
        assert analysis.slice_files(analysis.files.read_audio(spark.read.format("binaryFile").load(str(tmp_path / "tone.wav")), 8000), c).count() >= 1


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["analyse", "--list"]) == 0 and "fixed" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["analyse"])
    flags = ["analyse", "x.wav", "--max-duration", "0", "--markers", "m.txt", "--reaper", "--no-psycho", "--label-markers", "--field-type", "diffuse", "--psycho-max-duration", "5", "--basename", "b", "--no-essentia"]
    c = cli.configure(cli._parser().parse_args(flags))
    assert c.segmentation.max_duration is None and c.segmentation.method == "markers" and c.output.label_formats == ["audacity", "reaper"] and not c.psychoacoustics.enabled
    assert (c.output.label_regions, c.psychoacoustics.field_type, c.psychoacoustics.max_duration, c.output.basename, c.essentia.enabled) == (False, "diffuse", 5.0, "b", False)
    assert cli.configure(cli._parser().parse_args(["analyse", "x.wav", "-s", "fixed", "--markers", "m.txt"])).segmentation.method == "fixed"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("audio")
    t = np.arange(6 * 8000) / 8000
    for name, hz in (("one", 500), ("two", 900)):
        (made / f"{name}.wav").write_bytes(_wav(np.sin(2 * np.pi * hz * t * (1 + 0.1 * t))[None, :] * 0.5))
    (made / "marks.txt").write_text("1.0\t2.5\tfirst\n3.0\t5.0\tsecond\n")
    return made


QUICK = ["--sample-rate", "8000", "--groups", "dynamics", "spectral", "mfcc", "--stats", "mean", "stdev", "cov", "--frame-size", "512", "--hop-size", "256", "--no-psycho", "-q"]


def test_markers_through_the_command_line(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["analyse", str(folder / "one.wav"), str(folder / "two.wav"), "--markers", str(folder / "marks.txt"), "-o", out, *QUICK]) == 0
    for name in ("one", "two"):
        assert open(f"{out}/{name}.labels.txt").read() == "1.000000\t2.500000\t0000\n3.000000\t5.000000\t0001\n"
    with pytest.raises(SystemExit):
        (folder / "none.txt").write_text("# nothing\n")
        cli.main(["analyse", str(folder / "one.wav"), "--markers", str(folder / "none.txt"), "-o", out, *QUICK])


def test_outputs_of_the_command_line(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    flags = ["--window", "1", "--hop", "0.5", "--basename", "named", "--reaper", "--reaper-script", "--label-markers", "-o", out, *QUICK]
    assert cli.main(["analyse", str(folder / "one.wav"), *flags]) == 0
    lines = open(f"{out}/named.segments.csv", newline="").read().split("\r\n")
    assert lines[0].startswith("segment,start,end,duration,dynamics.dynamic_complexity,") and len(lines) == 13 and lines[1].startswith("0.0,0.0,1.0,1.0,")
    assert "mfcc.coeffs.cov.168" in lines[0] and "mfcc.coeffs.mean.12" in lines[0]
    document = json.loads(open(f"{out}/named.analysis.json").read())
    assert list(document) == ["metadata", "config", "columns", "summary", "segments"] and len(document["segments"]) == 11
    assert document["config"]["segmentation"]["hop"] == 0.5 and document["columns"][:4] == ["segment", "start", "end", "duration"] and "dynamics.rms.mean.wmean" in document["summary"]
    # The form of the label track that the same settings give for a long piece: four-digit names, six decimals.
    assert open(f"{out}/named.labels.txt").read().splitlines()[:2] == ["0.000000\t1.000000\t0000", "0.500000\t1.500000\t0001"]
    regions = open(f"{out}/named.regions.csv").read().splitlines()
    assert regions[0] == "#,Name,Start,End,Length,Color" and regions[2] == "M2,0001,0.500000,,0,"
    text = open(f"{out}/named.regions.lua").read()
    assert text.startswith("local OFFSET") and text.count('"00') == 11 and text.rstrip().endswith("-1)")


def test_tables_of_different_headers_and_equal_stems(spark, tmp_path, capsys):
    """Cells are read by name; a table without a column has nulls there."""
    head = "segment,start,end,duration"
    (tmp_path / "a.segments.csv").write_text(f"{head},dynamics.rms.mean,spectral.centroid.mean\r\n0.0,0.0,2.0,2.0,0.5,900.0\r\n1.0,2.0,3.0,1.0,nan,\r\n")
    (tmp_path / "b [x].segments.csv").write_text(f"{head},dynamics.power_dB.mean,dynamics.rms.mean\r\n0.0,0.0,1.0,1.0,-7.0,0.25\r\n")
    (tmp_path / "c.segments.csv").write_text(f"{head},spectral.centroid.mean,dynamics.rms.mean\r\n0.0,0.0,4.0,4.0,800.0,0.125\r\n")
    (tmp_path / "d.segments.csv").write_text(f"{head},dynamics.rms.mean,spectral.centroid.mean\r\n0.0,0.0,4.0,4.0,1.5,x\r\n")
    table = cli.files.read_segment_table(spark, str(tmp_path / "*.segments.csv"))
    rows = {(os.path.basename(r["file"])[0], r["segment"]): r for r in table.collect()}
    get = lambda f, c: rows[f, 0.0][c]
    assert [get(f, "dynamics.rms.mean") for f in "abcd"] == [0.5, 0.25, 0.125, 1.5]
    assert [get(f, "spectral.centroid.mean") for f in "abcd"] == [900.0, None, 800.0, None] and [get(f, "dynamics.power_dB.mean") for f in "abcd"] == [None, -7.0, None, None]
    assert np.isnan(rows["a", 1.0]["dynamics.rms.mean"]) and len(rows) == 5
    out = str(tmp_path / "out")
    assert cli.main(["rollup", str(tmp_path), "-o", out]) == 0
    rolled = {r["file"]: r for r in spark.read.csv(f"{out}/all_files", header=True).collect()}
    assert sorted(rolled) == ["a", "b [x]", "c", "d"] and rolled["a"]["rms.mean"] == "0.5" and rolled["b [x]"]["centroid.mean"] is None and rolled["c"]["centroid.mean"] == "800"
    (tmp_path / "bad.segments.csv").write_text("segment,start\r\n0,0\r\n")
    with pytest.raises(ValueError, match="no column end"):
        cli.files.read_segment_table(spark, str(tmp_path / "bad.segments.csv"))
    for name in ("one.wav", "one.aiff"):
        (tmp_path / name).write_bytes(_wav(np.zeros((1, 80))))
    for command in (["analyse", str(tmp_path / "one.wav"), str(tmp_path / "one.aiff")], ["batch", str(tmp_path)]):
        with pytest.raises(SystemExit):
            cli.main([*command, "-o", out, *QUICK])
        assert "would both be written as one" in capsys.readouterr().err
    lines = spark.createDataFrame([("/x/one.wav", 0, "a"), ("/y/one.wav", 0, "b")], "file string, ord long, line string")
    with pytest.raises(ValueError, match="both be written"):
        cli.sinks.write_files(lines, out, ".txt")


def test_batch_similarity_and_visualise(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    flags = ["--window", "0.5", "--no-json", "--no-labels", "-o", out, *QUICK]
    assert cli.main(["batch", str(folder), *flags]) == 0
    made = os.path.getmtime(f"{out}/one.segments.csv")
    os.utime(f"{out}/one.segments.csv", (made + 60, made + 60))
    os.remove(f"{out}/two.segments.csv")
    assert cli.main(["batch", str(folder), *flags]) == 0 and os.path.getmtime(f"{out}/one.segments.csv") == made + 60 and os.path.exists(f"{out}/two.segments.csv")
    rolled = spark.read.csv(f"{out}/all_files", header=True).orderBy("file").collect()
    assert [(r["file"], r["n_segments"], r["duration"]) for r in rolled] == [("one", "12", "6.0000"), ("two", "12", "6.0000")]
    assert "rms.mean" in rolled[0].asDict() and spark.read.csv(f"{out}/all_segments", header=True).count() == 24
    capsys.readouterr()
    assert cli.main(["similarity", f"{out}/one.segments.csv", "-o", out, "-k", "3", "--save-matrix", "--reaper"]) == 0
    assert "silhouette" in capsys.readouterr().out
    assert spark.read.parquet(f"{out}/distances").count() == 144 and os.path.exists(f"{out}/one.clusters.regions.csv")
    lines = open(f"{out}/one.clusters.csv", newline="").read().split("\r\n")
    assert lines[0] == "segment,start,end,duration,cluster,silhouette,pc1,pc2" and len(lines) == 14 and lines[2].startswith("1,0.5,1.0,0.5,")
    near = open(f"{out}/one.neighbours.csv", newline="").read().split("\r\n")
    assert near[0] == "segment,start,rank,neighbour,neighbour_start,distance" and [x.split(",")[:3] for x in near[1:4]] == [["0", "0.0", str(k)] for k in (1, 2, 3)] and len(near) == 38
    assert cli.main(["visualise", f"{out}/one.segments.csv", "-o", out, "--smooth", "3"]) == 0
    payload = json.loads(open(f"{out}/one.segments.plot.json").read())
    text = open(f"{out}/one.segments.plot.html").read()
    assert json.loads(text.split('type="application/json">')[1].split("</script>")[0]) == payload and text.startswith("<!doctype html>") and "@" not in text.split("<script")[0]
    assert payload["short"]["spectral.centroid.mean"] == "centroid.mean" and len(payload["range"]["dynamics.rms.mean"]) == 2 and len(payload["starts"]) == 12
