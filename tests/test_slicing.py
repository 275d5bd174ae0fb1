import random

import pytest
from pyspark.sql import functions as F

from longwave.operators import slicing


def loop(total, window, hop, drop):
    out, start = [], 0.0
    while start < total:
        end = start + window
        if end > total:
            if drop and out:
                break
            end = total
        out.append((start, end))
        if end >= total:
            break
        start += hop
    return out


@pytest.mark.parametrize("drop", [True, False])
def test_grid_equals_an_accumulating_loop(spark, drop):
    rng = random.Random(3)
    for window, hop in [(1.0, 0.1), (0.3, 0.3), (2.5, 0.7), (0.5, 1.3)]:
        totals = [(str(k), round(rng.uniform(0.05, 12), 2)) for k in range(25)] + [("none", 0.0), ("edge", window)]
        found = slicing.fixed(spark.createDataFrame(totals, "file string, total double"), window, hop, drop).collect()
        for file, total in totals:
            got = [(r["start"], r["end"]) for r in sorted(found, key=lambda r: r["ord"]) if r["file"] == file]
            assert got == loop(total, window, hop, drop), (file, total, window, hop)


def fold(bounds, least):
    out = []
    for k, (s, e) in enumerate(bounds):
        if k and e - s < least:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    if len(out) > 1 and out[0][1] - out[0][0] < least:
        out[:2] = [(out[0][0], out[1][1])]
    return out


def test_merge_equals_a_fold(spark):
    rng = random.Random(5)
    files = {}
    for k in range(60):
        t, bounds = 0.0, []
        for _ in range(rng.randint(1, 8)):
            e = t + rng.choice([0.1, 0.2, 0.6, 1.5])
            bounds.append((t, e))
            t = e + rng.choice([0.0, 0.0, 0.3])
        files[str(k)] = bounds
    rows = [(f, k, *b) for f, bs in files.items() for k, b in enumerate(bs)]
    found = slicing.merge_short(spark.createDataFrame(rows, "file string, ord long, start double, end double"), 0.5).collect()
    for f, bs in files.items():
        assert [(r["start"], r["end"]) for r in sorted(found, key=lambda r: r["ord"]) if r["file"] == f] == fold(bs, 0.5)


def test_split_pad_and_degenerate_inputs(spark):
    b = spark.createDataFrame([("a", 0, 0.0, 7.0), ("a", 1, 7.0, 8.0)], "file string, ord long, start double, end double")
    t = spark.createDataFrame([("a", 8.0)], "file string, total double")
    cut = [(r["start"], r["end"]) for r in slicing.split_long(b, 3.0).orderBy("ord").collect()]
    assert cut == [(0.0, 7 / 3), (7 / 3, 14 / 3), (14 / 3, 7.0), (7.0, 8.0)]
    padded = [(r["start"], r["end"]) for r in slicing.pad(b, t, 0.5).orderBy("ord").collect()]
    assert padded == [(0.0, 7.5), (6.5, 8.0)]
    assert slicing.merge_short(b.where("false"), 1.0).count() == 0
    assert slicing.segment(t.where("false"), "fixed", window=1.0).count() == 0


def test_window_below_least_duration_folds_all_then_splits(spark):
    t = spark.createDataFrame([("a", 100.0)], "file string, total double")
    s = slicing.segment(t, "fixed", window=0.1, least=0.25, most=30.0).orderBy("segment").collect()
    assert [r["duration"] for r in s] == [25.0] * 4


def test_golden_grid_of_an_overlapping_chop(spark):
    # Window 5, hop 2.5 over a piece of 1313.7 seconds.
    t = spark.createDataFrame([("piece", 1313.7)], "file string, total double")
    g = slicing.fixed(t, 5.0, 2.5).orderBy("ord").collect()
    assert len(g) == 524 and (g[-1]["start"], g[-1]["end"]) == (1307.5, 1312.5)


def test_unknown_strategy():
    assert {"fixed", "markers", "onset"} <= set(slicing.strategies())
    with pytest.raises(ValueError, match="unknown segmentation"):
        slicing.strategy("nothing")


def test_inner_frames_pad_and_skip_empty(spark):
    a = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0]), ("a", 1, [])], "file string, segment long, x array<double>")
    f = slicing.inner_frames(a, 2, 2).orderBy("frame").collect()
    assert [r["x"] for r in f] == [[1.0, 2.0], [3.0, 0.0]]


def test_sample_slices_round_half_even(spark):
    x = spark.range(10).select(F.lit("a").alias("file"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    s = spark.createDataFrame([("a", 0, 0.5, 2.5), ("a", 1, 5.0, 5.0)], "file string, segment long, start double, end double")
    assert sorted(r["i"] for r in slicing.sample_slices(x, s, 1.0, bucket=2).collect()) == [0, 1]
