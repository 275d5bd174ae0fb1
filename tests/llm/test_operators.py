"""The Spark operators against plain versions on small tables, with nulls, ties, repeats and odd columns."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from longwave.llm import chunks, jaccard, langid, licenses, lines, mixing, pieces, quality, queries, vectors

DOCS = "doc_id long, text string"
SHORT = [(1, None), (2, ""), (3, "word"), (3, "word"), (4, " \n\t "), (None, "no id here")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


# ---- vectors


def brute(rows, measure, k=5):
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            scored = sorted(((-measure(a, b), c) for c, b in rows if c != q))[:k]
            out[q] = [(c, -s) for s, c in scored]
    return out


def test_inner_products(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.standard_normal(6)]) for k in range(120)]
    rows += [(k, rows[3][1]) for k in range(120, 130)] + [(500, [1.0, 2.0])]
    bad = [(600, None), (601, [None, 1.0]), (602, [float("nan")]), (603, [float("inf")])]
    table = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = defaultdict(list)
    for r in vectors.top_k_inner(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    pad = lambda v: np.floor(256 * np.array([np.float32(x) for x in v] + [0.0] * (6 - len(v)), float))
    assert dict(found) == brute([(k, pad(v)) for k, v in rows], lambda a, b: int(a @ b))
    assert vectors.top_k_inner(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_cosine_search_recall_and_edges(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    zero = spark.createDataFrame([(1000, [0.0] * 64), (1001, None)], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    found = vectors.nearest_cosine(e.unionByName(zero), F.col("vec_id") % 50 == 0).collect()
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in e.collect()]
    want = brute(rows, lambda a, b: float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    hits = sum((r["query_id"], r["vec_id"]) in {(q, c) for q, cs in want.items() for c, _ in cs} for r in found)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert not {r["vec_id"] for r in found} & {1000, 1001}
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in (0, 3, 7, 9)] + [(50, [1.0, -1.0])], "vec_id long, embedding array<float>")
    r = vectors.nearest_cosine(same, F.col("vec_id") % 50 == 0, 3).where("query_id = 0").orderBy("rank").collect()
    assert [x["vec_id"] for x in r] == [3, 7, 9]
    assert vectors.nearest_cosine(same.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# ---- classifiers


def auc(score, label):
    order = np.argsort(score, kind="stable")
    y = np.array(label)[order]
    n1, n0 = y.sum(), len(y) - y.sum()
    return ((np.arange(1, len(y) + 1)[y == 1]).sum() - n1 * (n1 + 1) / 2) / (n0 * n1)


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in queries.op9_quality(spark, "/root/testdata/sf0.1").where("held_out").collect() if r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert auc([r["score"] for r in held], [labels[r["doc_id"]] for r in held]) > 0.98
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97


def test_quality_edges(spark):
    d = docs_of(spark, SHORT).withColumn("score", F.lit("old")).withColumn("label", F.lit(7))
    labels = spark.createDataFrame([(3, 1), (2, 0), (1, None), (99, 1)], "doc_id long, label int")
    out = quality.score(d, quality.fit(d, labels)).collect()
    assert len(out) == len(SHORT) and all(0 <= r["score"] <= 1 for r in out) and out[0]["label"] == 7
    empty = quality.score(d, quality.fit(d, labels.where("false")))
    assert {round(r["score"], 6) for r in empty.collect()} == {0.5}
    assert quality.score(d.where("false"), quality.fit(d, labels)).count() == 0


def test_language_on_held_out_documents(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    out = queries.op4_langid(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_language_edges(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6)]
    train = spark.createDataFrame([*rows, (90, None, "en"), (91, "more", None)], "doc_id long, text string, lang string")
    d = docs_of(spark, [*SHORT, (7, "123 — !"), (8, "the dog"), (9, "die katze " * 3000)]).withColumn("score", F.lit("x"))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(d, langid.fit(train)).collect()]
    got = {k: x for k, x, _ in out}
    assert got[1] == got[2] == got[4] == got[7] == "und" and got[8] == "en" and got[9] == "de"
    assert all(0 <= s <= 1 for _, _, s in out)
    assert {r["lang_pred"] for r in langid.predict(d, langid.fit(train.where("false"))).collect()} == {"und"}


# ---- licenses


def test_license_base_against_brute_force(spark, documents):
    extra = docs_of(spark, [*SHORT, (7, "Under the MIT-License. under THE mit license"), (8, "cc by nc cc by nc 4.0"), (9, "xcc by nc"), (10, "écc by nc")])
    for r in licenses.scan(documents.select("doc_id", "text").unionAll(extra)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [(k, label) for label, p in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(at)
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: BSD-3-Clause", "released under CC BY-NC-SA 4.0", "This work is licensed under the GNU General Public License, version 3.", "the public garden", "permitted sublicense of limits"]
    out = [r["labels"] for r in licenses.scan(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert out[0] == "apache-2" and out[1] == "bsd-3-clause" and "cc-by-nc-sa" in out[2] and out[3] == "gpl-3" and out[4] == out[5] == ""
    r = licenses.scan(docs_of(spark, [(1, "under the mit license and licensed under the mit license")])).first()
    spans = [(d["s"], d["e"]) for d in r["detections"]]
    assert spans == [(0, 21), (26, 56)] and r["score"] == 1.0
    assert len(licenses.rules()) > 300 and licenses.scan(docs_of(spark, [])).count() == 0


def _example(parsed, rng):
    """A text that the parsed pattern takes, its choices made at random."""
    out = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            kind, value = arg[int(rng.integers(len(arg)))]
            out.append("w" if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else int(rng.integers(value[0], value[1] + 1))))
        elif op == "SUBPATTERN":
            out.append(_example(arg[3], rng))
        elif op == "BRANCH":
            out.append(_example(arg[1][int(rng.integers(len(arg[1])))], rng))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [_example(arg[2], rng) for _ in range(int(rng.integers(arg[0], min(arg[1], arg[0] + 3) + 1)))]
        else:
            assert op == "ASSERT_NOT", op
    return "".join(out)


def test_license_gates_lose_nothing(spark):
    rules = licenses.rules()
    rng = np.random.default_rng(4)
    texts = [f"so {_example(re._parser.parse(r.pattern), rng)} it is" for r in rules for _ in range(4)]
    texts += ["released under MIT", "distributed under BSD 3-Clause", "published under zlib", "available under Apache 2.0", "licensed under the PSF license", "licensed under the open data commons database license"]
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    rows = licenses.scan(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").select("text", "detections").collect()
    assert len(rows) == len(texts)
    for row in rows:
        s = " ".join(re.findall(r"[a-z0-9]+", row["text"].lower()))
        found = sorted((m.start(), -m.end(), r.priority, r.label) for r, x in compiled for m in x.finditer(s))
        want, top = [], -1
        for a, b, p, label in found:
            if -b > top:
                top = -b
                want.append((a, -b, p, label))
        assert want and [(d["s"], d["e"], d["p"], d["l"]) for d in row["detections"]] == want, s


# ---- lines, chunks


def test_line_dedup_equals_sql(spark, documents):
    made = [(2000, "a\nb\nc\nd"), (2001, "x\na\nb\nc\ny"), (2002, "r\nr\nr\nr\nr"), (2003, "\n\n\n\n"), (2004, None), (2005, ""), (2006, "b\nc\nd")]
    d = documents.select("doc_id", "text").unionAll(docs_of(spark, made))
    table = d.toArrow()
    connection = duckdb.connect()
    connection.register("documents", table)
    want = {r[0]: r[1:] for r in connection.execute(lines.ORACLE_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup(d.withColumn("n_lines", F.lit("x"))).collect()}
    assert got == want
    assert got[2001] == (5, 3, "x\ny") and got[2006][2] == "" and got[2002] == (5, 4, "r") and got[2003][1] > 0
    kept = {r["doc_id"]: r["n_removed"] for r in lines.dedup(docs_of(spark, made), skip_blank=True).collect()}
    assert kept[2003] == 0 and kept[2002] == 4


def test_line_dedup_with_clashing_columns(spark):
    names = ["id", "hash", "lines", "kept", "cut", "touched", "own", "at", "first", "n", "a.b"]
    rows = docs_of(spark, [(1, "p\nq\nr"), (2, "p\nq\nr\ns")])
    for name in names:
        rows = rows.withColumn(name, F.lit(name))
    got = {r["doc_id"]: r for r in lines.dedup(rows).collect()}
    assert got[2]["text"] == "s" and all(got[k][n] == n for k in got for n in names)
    assert {r["doc_id"]: r["dup_bytes"] for r in chunks.find(rows.withColumn("byte_spans", F.lit(0)).withColumn("spans0", F.lit(0))).collect()}.keys() == {1, 2}
    assert len(chunks.cut(chunks.find(rows), 1).collect()) == 2


def test_line_dedup_edges(spark):
    d = docs_of(spark, [*SHORT, (None, "p\nq\nr"), (1, "p\nq\nr"), (1, "p\nq\nr")])
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in lines.dedup(d).where("text IS NULL OR n_removed > 0 OR text LIKE 'p%'").collect())
    assert got == [(-1, 0), (1, 0), (1, 3), (1, 3)]
    assert lines.dedup(docs_of(spark, [])).count() == 0


def test_chunks_find_shared_passages_only(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    passage = " ".join(word() for _ in range(60))
    rows = [(k + 100, " ".join(word() for _ in range(150)) + (f" {passage} " if k in (3, 8, 11) else " ") + "é".join(word() for _ in range(80))) for k in range(15)]
    d = docs_of(spark, rows + SHORT[:2])
    found = chunks.find(d.withColumn("n_bytes", F.lit("x")))
    hit = {r["doc_id"]: r["dup_bytes"] for r in found.where("dup_bytes > 0").collect()}
    assert set(hit) == {108, 111} and all(v > 0.5 * len(passage) for v in hit.values())
    for r in chunks.cut(found).collect():
        before = dict(rows).get(r["doc_id"])
        if before is not None:
            assert len(r["text"].encode()) == len(before.encode()) - r["dup_bytes"]
            assert (r["text"] == before) == (r["dup_bytes"] == 0)
    assert chunks.find(docs_of(spark, [])).count() == 0


def test_chunks_report_short_duplicates(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    words = [word() for _ in range(400)]
    near = [word() if k % 14 == 7 else w for k, w in enumerate(words)]
    d = docs_of(spark, [(1, "a short text, twice"), (2, "a short text, twice"), (3, "another one"), (4, " ".join(words)), (5, " ".join(near))])
    found = chunks.find(d)
    got = {r["doc_id"]: r for r in found.collect()}
    assert [got[k]["dup_bytes"] for k in (1, 2, 3, 4)] == [0, 19, 0, 0]
    first, second = " ".join(words).encode(), " ".join(near).encode()
    cut_up = lambda t: chunks.borders(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2]
    known = {first[a:b] for a, b in zip(*cut_up(first), strict=True)}
    same = [(a, b) for a, b in zip(*cut_up(second), strict=True) if second[a:b] in known]
    assert got[5]["dup_bytes"] == sum(b - a for a, b in same) > 0
    assert any(s["to"] - s["at"] < chunks.LEAST_SPAN for s in got[5]["byte_spans"])
    texts = lambda least: {r["doc_id"]: r["text"] for r in chunks.cut(found, least).collect()}
    assert texts(100)[2] == "a short text, twice" and texts(1)[2] == ""


# ---- Jaccard join


def components_of(rows, k, num, den):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append(d)
    return [(d, len(sets[i]), min((x for x in groups[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join_equals_brute_force(spark, k, num, den):
    rng = np.random.default_rng(k)
    words = [f"w{x}" for x in range(400)]
    rows = [(100, None), (101, ""), (102, "One"), (103, "one"), (104, "one two"), (None, "alone here it stands")]
    for family in range(6):
        base = list(rng.choice(words, int(rng.integers(8, 160))))
        for _ in range(14):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            rows.append((200 + len(rows), " ".join(text)))
    want = components_of(rows, k, num, den)
    d = docs_of(spark, rows).withColumn("node", F.lit("x")).repartition(5)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(d, k, num, den).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_jaccard_cells_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_SETS", 8)
    rng = np.random.default_rng(9)
    base = [f"t{x}" for x in range(80)]
    rows = []
    for k in range(50):
        text = list(base)
        for _ in range(int(rng.integers(0, 5))):
            text[int(rng.integers(80))] = f"n{rng.integers(1000)}"
        rows.append((k, " ".join(text)))
    want = components_of(rows, 3, 90, 100)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of(spark, rows), 3, 90, 100).collect()]
    assert sorted(got) == sorted(want)


def test_jaccard_empty_tables(spark):
    assert jaccard.near_duplicates(docs_of(spark, [])).count() == 0
    assert [(r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of(spark, [(1, None)])).collect()] == [(0, 1)]


# ---- mixing, pieces


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(0, 300, 200)
    rows = [(int(n[k]), *map(float, p[k])) for k in range(200)]
    t = spark.createDataFrame(rows, "n_tokens long, p_a double, p_b double, p_c double")
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    got = np.array([r[0] for r in t.select(mixing.fit_rates(t, ["a", "b", "c"], weights)[0].alias("r")).collect()])
    have = n @ p
    target = have[0] / 0.7 * np.array([0.7, 0.2, 0.1])
    rate = np.ones(200)
    for _ in range(mixing.STEPS):
        off = (rate * n) @ p - target
        if np.abs(off).max() <= mixing.CLOSE * target.sum():
            break
        m = (p * (n * (rate > 0))[:, None]).T @ p
        rate = np.maximum(0, rate - p @ np.linalg.solve(m, off))
    assert np.allclose(got, rate, atol=1e-6) and (got >= 0).all()
    assert np.allclose((got * n) @ p, target, rtol=1e-3)


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(3, "clean"), (4, "low"), (1, None)], "doc_id long, domain string")
    d = docs_of(spark, SHORT).withColumn("rate", F.lit("x"))
    out = mixing.mix(d, labels, {"clean": 0.9, "low": 0.1}).collect()
    assert len(out) == len(SHORT) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in out)
    assert all(abs(r["p_clean"] + r["p_low"] - 1) < 1e-9 for r in out)
    plain = mixing.mix(d, labels.where("false"), {"clean": 1.0}).collect()
    assert {r["copies"] for r in plain} == {1}
    assert mixing.mix(d.where("false"), labels, {"clean": 1.0}).count() == 0


def test_mixing_meets_targets(spark):
    out = queries.op5_mixing(spark, "/root/testdata/sf0.01")
    sums = out.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in queries.MIX_WEIGHTS)).first()
    total = sum(sums)
    assert all(abs(sums[d] / total - w) < 0.002 for d, w in queries.MIX_WEIGHTS.items())


def test_pieces_round_trip(spark, documents):
    v = pieces.load(queries.PIECE_MODEL)
    d = documents.select("doc_id", "text").limit(200).unionAll(docs_of(spark, SHORT)).withColumn("pieces", F.lit("x"))
    out = pieces.decode(pieces.encode(d, v, F.col("doc_id"), seed=3), v)
    assert out.where("NOT (decoded <=> text)").count() == 0
    proved = pieces.encode(d, v, F.col("doc_id"), seed=3, proof="ok")
    assert proved.where("NOT ok").count() == 0 and proved.count() == 200 + len(SHORT)
    again = pieces.encode(d.repartition(7), v, F.col("doc_id"), seed=3)
    pairs = out.select("doc_id", "text", F.col("pieces").alias("a")).join(again.select("doc_id", "text", F.col("pieces").alias("b")).distinct(), ["doc_id", "text"])
    assert pairs.where("a <> b").count() == 0 and pairs.count() > 190
    assert pieces.encode(d.where("false"), v, F.col("doc_id")).count() == 0
