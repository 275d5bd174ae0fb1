"""SuperMinHash near duplicates, the filter audit and phrase collocations against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from longwave.llm import audit, jaccard, minhash, phrases
from longwave.llm import textbuf as tb

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words_of(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, num, den):
    """{row number: smallest id reachable}, by comparing every two rows."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return [least.get(top(k)) for k in range(len(rows))], [len(s) for s in sets]


# ---- SuperMinHash


def plain_signature(hashes, slots):
    """Element by element, with a whole permutation each, as the method is written down."""
    out = [np.iinfo(np.uint64).max] * slots
    for h in hashes:
        order = list(range(slots))
        for rank in range(slots):
            number, place = minhash._draw(np.array([h], np.uint64), rank, slots)
            k = int(place[0])
            order[rank], order[k] = order[k], order[rank]
            out[order[rank]] = min(out[order[rank]], int(number[0]) + (rank << minhash._BELOW))
    return out


@pytest.mark.parametrize("slots", [16, 64])
def test_signatures_are_those_of_the_plain_method(slots):
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 2, 7, 40, 400)]
    got = minhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), slots)
    for row, s in zip(got, sets, strict=True):
        assert row.tolist() == plain_signature(s, slots)


def test_signatures_estimate_with_low_variance():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(300):
        u = rng.integers(0, 2**64, 60, dtype=np.uint64)
        hashes, cut = np.concatenate((u[:45], u[15:])), np.array([0, 45, 90])
        a, b = minhash.signatures(hashes, cut, 64)
        gaps.append((a == b).mean() - 0.5)
    assert abs(np.mean(gaps)) < 0.01 and np.var(gaps) < 0.8 * 0.25 / 64  # independent hashes would give 0.25 / 64


def test_bands_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    missed = 0
    for n in (1, 4, 9, 50, 500):
        for _ in range(40):
            u = rng.integers(0, 2**64, n, dtype=np.uint64)
            gone = n // 9  # Jaccard at least 0.8
            hashes, cut = np.concatenate((u[gone:], u[: n - gone] if gone else u)), np.array([0, n - gone, 2 * (n - gone)])
            keys, owner = minhash.band_keys(hashes, cut, np.array([0, 1]))
            missed += not set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert missed == 0


def family(seed, size, words=60, changed=4):
    random.seed(seed)
    base = [f"f{seed}w{k}" for k in range(words)]
    out = [" ".join(base)]
    for m in range(size - 1):
        w = list(base)
        for k in random.sample(range(words), random.randint(0, changed)):
            w[k] = f"x{seed}{m}{k}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = family(1, 40) + family(2, 25, 200, 12) + family(3, 10, 9, 1) + ["One Two three", "one two THREE", "one", "one", "", None, " \n\t ", "tie a b c d", "tie a b c d"]
    texts += [" ".join(f"long{k % 977}x{k}" for k in range(20_000))] * 2
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)]
    rows += [(5, texts[3]), (5, texts[60])]  # an id twice, with different texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("component_id", F.lit(7))
    got = minhash.near_duplicates(docs, 4, 80, 100).collect()
    want, sizes = components(rows, 4, 80, 100)
    expected = Counter((d, n, c if c is not None else d, d == (c if c is not None else d)) for (d, _), n, c in zip(rows, sizes, want, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == expected
    assert minhash.near_duplicates(docs.where("false"), 4, 80, 100).count() == 0


def test_a_large_family_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_SETS", 16)
    rows = list(enumerate(family(9, 150, 80, 3)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, 100).collect()}
    assert [got[k] for k in range(150)] == components(rows, 4, 80, 100)[0]


# ---- filter audit


def plain_audit(rows, labels):
    """Rows (id, text, source) through every order of filters, one document at a time."""
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1 and d is not None} for k in (0, 1))
    masks = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        masks.append((s or "", d, {k for k, v in fails.items() if v}))
    out = {}
    for part in {m[0] for m in masks}:
        taken = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                hit = [m for m in left if letter in m[2]]
                row = [len(left) - len(hit), len(hit), sum(letter in m[2] for m in gone), sum(m[0] == part and m[2] == {letter} for m in masks), sum(m[1] in good for m in hit), sum(m[1] in toxic for m in hit)]
                left, gone = [m for m in left if letter not in m[2]], gone + hit
                taken[letter] += len(hit)
                out[part, "".join(order), step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("z")).withColumn("a.b", F.lit(1)).repartition(3)
    made = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = made.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}


@pytest.mark.parametrize("chain_bytes", [1 << 25, 50])
def test_audit_equals_the_plain_one(spark, monkeypatch, chain_bytes):
    monkeypatch.setattr(audit, "CHAIN_BYTES", chain_bytes)
    random.seed(4)
    rows = []
    for k in range(120):
        w = [random.choice(["alpha", "Beta", "GAMMA", "d#lta", "é日", "x"]) + str(random.randint(0, random.choice([2, 500]))) for _ in range(random.choice([0, 3, 49, 50, 51, 80]))]
        rows.append((k, random.choice([" ", "\n", "\t \x0b", "\xa0"]).join(w), random.choice(["s1", "s2", None, ""])))
    rows += [(random.choice([None, 5, 200 + k]), rows[random.randrange(40)][1], random.choice(["s1", "s3"])) for k in range(80)]
    rows += [(300, None, None), (301, "", "s1"), (302, None, "s4"), (7, rows[7][1], "s1"), (7, rows[7][1], "s1"), (400, "HOT text", "s1"), (401, "word " * 30_000, "s1")]
    rows += [(500 + k, "HOT text", "s2") for k in range(60)]
    labels = [(k, k % 2, k % 3) for k in range(0, 520, 3)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (9, None, None)]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == want and len(want) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert audited(spark, [(1, "a", "s")], []) == plain_audit([(1, "a", "s")], [])


def test_collisions_of_fingerprints_are_told_apart():
    held = audit.Chains()
    assert held.add(1, b"one", 5, Counter("x")) is None and held.add(1, b"two", 3, Counter("y")) is None
    assert held.add(1, b"one", 9, Counter("z")) == (9, Counter("z"))
    assert held.add(1, b"one", 5, Counter("z")) is None
    assert held.add(1, b"one", 2, Counter("w")) == (5, Counter("xz"))
    assert sorted(held.drain()) == [(1, (b"one", 2, Counter("w"))), (1, (b"two", 3, Counter("y")))]


def test_repeated_ids(spark):
    rows = [(1, "same"), (2, "same"), (2, "same"), (3, "other"), (None, "same"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {(r["doc_id"], r["n"]) for r in audit.repeated_ids(docs).collect()} == {(2, 2), (5, 1)}


# ---- phrases


def plain_phrases(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                counts[lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if a >= least and len(p) > 1]
        rows_of = []
        for p in candidates:
            a = f[p]
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in candidates if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if not any(100 * f[q] >= 80 * a for q in longer):
                rows_of.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def collocated(spark, rows, least=3, top=2000):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("piece", F.lit(1)).withColumn("a.b", F.lit(2))
    made = phrases.collocations(docs, least=least, top=top)
    return sorted(tuple(r) for r in made.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_ROWS", 50)
    random.seed(5)
    vocabulary = ["the", "The", "of", "New", "york", "é", "日本", "a-b", "city", "x\xa0y"]
    rows = []
    for _ in range(150):
        text = "".join(random.choice(vocabulary) + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(random.randint(0, 40)))
        rows.append((random.choice(["en", "fr", None, "und"]), text))
    rows += [("en", "Buffalo buffalo buffalo buffalo buffalo!")] * 20 + [("en", None), ("de", ""), ("de", " ,. "), ("xx", "y" * 100_000 + " z " + "y" * 100_000)] + [("en", "tie one; tie two")] * 5
    for top in (2000, 7):
        want = plain_phrases(rows, 3, top)
        assert want and collocated(spark, rows, 3, top) == want


def test_phrases_of_long_and_empty_tables(spark):
    long_text = " ".join(f"w{k % 50}" for k in range(30_000))
    assert collocated(spark, [("en", long_text)], 30) == plain_phrases([("en", long_text)], 30, 2000)
    assert collocated(spark, [("en", "nothing twice here")]) == [] and collocated(spark, [(None, None)]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 61
    frequent = spark.createDataFrame([("e", "a b", 2, big - 1, 0), ("e", "a", 1, big, 0), ("e", "b", 1, big + 5, 0)], "lang string, phrase string, size int, a long, key long")
    (row,) = phrases.scored(frequent).collect()
    assert row["score"] == 2_000_000 * (big - 1) // (2 * big + 5)


def test_duckdb_sums_beyond_its_memory(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_MEMORY", "32MB")
    grams = spark.range(400_000).select(F.lit("en").alias("lang"), F.concat(F.lit("phrase number "), F.pmod(F.col("id"), F.lit(200_000)).cast("string")).alias("phrase"), F.lit(20).cast("long").alias("w"))
    found = phrases._frequent(grams.coalesce(1), 3, 30)
    assert found.agg(F.count("*"), F.min("a"), F.max("a")).first() == (200_000, 40, 40)


def test_ngram_keys_depend_on_language_and_order():
    def key(lang, text):
        ((_, _, _, _, _, word),) = phrases._places(pa.array([lang]), pa.array([text]))
        return phrases._keys(word, 2).tolist()

    assert key("en", "a b") != key("fr", "a b") and key("en", "a b") != key("en", "b a") and key("en", "a b") == key("en", "a b")
    assert len(key("en", "a")) == 0 and len(tb.NOT_SPACE) == 256


def test_sampled_pieces_need_bounded_memory_and_do_not_depend_on_the_slices():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from longwave.llm import pieces, textbuf
    from longwave.llm.queries import PIECE_MODEL

    v = pieces.load(PIECE_MODEL)
    draw = np.random.default_rng(0)
    texts = pa.array([" ".join("".join(map(chr, draw.integers(97, 123, 6))) for _ in range(300)) for _ in range(500)])
    key = np.arange(len(texts), dtype=np.int64)
    run = lambda size: [pieces.sample_slice(buf, at, key[lo:hi], v, 1.0, 17)[0] for lo, hi, buf, at in textbuf.slices(texts, size)]
    whole = np.concatenate(run(1 << 20))
    tracemalloc.start()
    cut = np.concatenate(run(pieces.SLICE_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(whole, cut) and peak < 150e6
