"""Operators against plain Python on small tables, and on long texts."""

import time

import numpy as np
from pyspark.sql import functions as F

from longwave.llm import chunks, licenses, lines


def test_chunks_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"])
    first, want = {}, {}
    for d, text in rows:
        b = text.encode()
        start, end, _ = chunks.borders(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        spans = []
        for x, y in zip(start.tolist(), end.tolist(), strict=True):
            if first.setdefault(b[x:y], (d, x)) != (d, x):
                if spans and spans[-1][1] == x:
                    spans[-1] = (spans[-1][0], y)
                else:
                    spans.append((x, y))
        want[d] = spans
    got = {r["doc_id"]: [(s["at"], s["to"]) for s in r["byte_spans"]] for r in chunks.find(docs).collect()}
    assert got == {d: want.get(d, []) for d in got} and any(want.values())


def test_long_texts(spark):
    many = "released under MIT and more words here. " * 20000
    text = "\n".join(f"line {k % 700} of many" for k in range(30000))
    docs = spark.createDataFrame([(1, many), (2, text)], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in licenses.scan(docs).select("doc_id", F.size("detections").alias("n"), "labels").collect()}
    assert found[1]["n"] == 20000 and found[1]["labels"] == "mit" and time.time() - began < 60
    cut = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert cut[2]["n_lines"] == 30000 and cut[2]["text"].count("\n") < 710
    assert {r["doc_id"]: r["dup_bytes"] for r in chunks.find(docs).collect()}[1] > 0.99 * len(many)


def test_columns_of_any_name(spark):
    """Dots, clashing and odd names are carried along; null ids, ties and repeated rows are scored alike."""
    from longwave.llm import langid, pieces, quality
    from longwave.llm.queries import PIECE_MODEL

    rows = [(1, "One two three", 1, "x", 2.0), (1, "One two three", 1, "x", 2.0), (None, None, None, None, None), (3, "", 5, "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__key` int, `a.b` string, `c0` double").withColumn("lo`ng", F.lit(9))
    kept = docs.columns
    made = [
        (pieces.encode(docs, pieces.load(PIECE_MODEL), F.col("doc_id"), proof="lossless"), ["pieces", "lossless"]),
        (quality.score(docs, (0.5, np.zeros(1 << quality.BITS, np.float32))), ["score", "predicted"]),
        (langid.predict(docs, None), ["lang_pred", "score"]),
    ]
    for frame, added in made:
        assert frame.columns == [*kept, *added]
        got = sorted((tuple(r)[: len(kept)] for r in frame.collect()), key=repr)
        assert got == sorted(((*r, 9) for r in rows), key=repr)
    back = pieces.decode(made[0][0], pieces.load(PIECE_MODEL)).collect()
    assert all(r["decoded"] == r["text"] for r in back) and all(r["lossless"] for r in back if r["text"])
