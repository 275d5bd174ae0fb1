"""Plain-Python checks of the kernels under the Spark operators."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from longwave.llm import chunks, jaccard, langid, pieces, quality, vectors
from longwave.llm import textbuf as tb
from longwave.llm.queries import PIECE_MODEL

TEXTS = ["", "a", "One two  three\nFOUR", " lead and trail ", "é日本 語 x", "\n\n", "a▁b\t c", "word " * 50]


def _slice(texts):
    (part,) = list(tb.slices(pa.array(texts)))
    return part[2], part[3]


def test_slices_cover_all_rows_with_nulls_and_long_texts():
    texts = ["x" * 10, None, "y" * 5000, "", "z"] * 3
    seen = []
    for lo, hi, buf, offsets in tb.slices(pa.chunked_array([pa.array(texts).slice(1, 13)]), 100):
        seen += [buf[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(hi - lo)]
    assert seen == [t or "" for t in texts[1:14]]
    assert list(tb.slices(pa.array([], pa.string()))) == []


def test_spans_and_hashes():
    buf, offsets = _slice(TEXTS)
    start, end, doc = tb.spans(buf, offsets, tb.NOT_SPACE)
    got = [(int(d), buf[a:b].tobytes()) for a, b, d in zip(start, end, doc, strict=True)]
    assert got == [(k, w) for k, t in enumerate(TEXTS) for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    h = tb.span_hashes(buf, start, end)
    by_word = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingle_sets(words):
    texts = [*TEXTS, "a b c d", "A b C d", "a b c d a b c d"]
    hashes, cut = jaccard.shingle_sets(*_slice(texts), words)
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        want.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    assert np.diff(cut).tolist() == [len(s) for s in want]
    sets = [frozenset(hashes[a:b].tolist()) for a, b in itertools.pairwise(cut)]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("share", [0, 1, 2])
@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (60, 100)])
def test_similar_sets_share_a_key(num, den, share):
    rng = np.random.default_rng(num + share)
    edges = jaccard.band_edges(400, num, den)
    bands = []
    for k, (low, top) in enumerate(edges):
        most, spare = jaccard._difference(top, num, den), 1 + share
        need = most + 1 + spare * (2 if share else 1)
        twos = [0, (need + 1) // 4, (need + 1) // 2][share]
        bands.append(jaccard.Band(low, top, max(0, need - 2 * twos), twos, spare) if most else jaccard.Band(low, top, 0, 0, 0))
    plan = {f: np.array([getattr(b, f) for b in bands]) for f in ("low", "ones", "twos", "spare")}
    linked = 0
    for _ in range(300):
        size = int(rng.integers(2, 120))
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        keep = base[rng.random(size) > rng.choice([0, 0.02, 0.1])]
        other = np.unique(np.append(keep, rng.integers(0, 2**63, int(rng.integers(0, 2 + size // 8)), dtype=np.uint64)))
        base = np.unique(base)
        if not len(other) or np.array_equal(base, other):
            continue
        common = len(np.intersect1d(base, other))
        if den * common < num * (len(base) + len(other) - common):
            continue
        linked += 1
        hashes, cut = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
        key, owner = jaccard.keys_of(hashes, cut, np.array([0, 1]), plan)
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (len(base), len(other), common)
    assert linked > 30


def test_allocation_turns_to_deletions_as_sets_grow():
    few, many = (jaccard.allocate(465, 516, 418, n, 90, 100) for n in (1000, 10**12))
    assert few.twos == 0 and many.twos > 0
    for b in (few, many):
        assert b.ones + 2 * b.twos > jaccard._difference(516, 90, 100)


def test_common_counts():
    """Pairs of a bin are told to link exactly from whole texts."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.permutation(60)[: rng.integers(20, 60)]) for _ in range(40)]
    own = [frozenset(t.split()) for t in texts]
    pairs = list(itertools.combinations(range(len(texts)), 2))
    rows = [(i, i) for i in range(len(texts))] + pairs
    table = pa.table({"a": [a for a, _ in rows], "node": [b for _, b in rows], "text": [texts[b] for _, b in rows]})
    got = jaccard._links_of(1, 50, 100)(table)
    want = {(i, j) for i, j in pairs if 2 * len(own[i] & own[j]) >= len(own[i] | own[j])}
    assert want and set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want


def test_chunks_cover_texts_and_fall_into_step():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(600)]
    text = " ".join(words[:400])
    shifted = "é inserted here " + text
    texts = [text, shifted, "", "short", "é" * 700]
    buf, offsets = _slice(texts)
    start, end, doc = chunks.borders(buf, offsets)
    for d, t in enumerate(texts):
        parts = [buf[a:b].tobytes() for a, b in zip(start[doc == d], end[doc == d], strict=True)]
        assert b"".join(parts) == t.encode()
        assert all(len(p) <= chunks.MOST + 3 for p in parts)
        for p in parts:
            p.decode()
    digest = tb.span_hashes(buf, start, end)
    assert len(set(digest[doc == 0]) & set(digest[doc == 1])) >= (doc == 0).sum() - 3


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECE_MODEL)


def test_pieces_are_lossless_and_do_not_depend_on_the_slice(vocabulary):
    texts = [*TEXTS, "😀 tab\tand\r\n", "x" * 3000, "▁▁", "  two  blanks  "]
    buf, offsets = _slice(texts)
    keys = np.arange(len(texts)) + 5
    ids, cut = pieces.sample_slice(buf, offsets, keys, vocabulary, 0.3, 1)
    raw, back = pieces.decode_slice(ids, cut.astype(np.int64), vocabulary)
    assert [raw[a:b].tobytes().decode() for a, b in itertools.pairwise(back)] == texts
    for k, t in enumerate(texts):
        alone, _ = pieces.sample_slice(*_slice([t]), keys[k : k + 1], vocabulary, 0.3, 1)
        assert alone.tolist() == ids[cut[k] : cut[k + 1]].tolist()
    other, _ = pieces.sample_slice(buf, offsets, keys, vocabulary, 0.3, 2)
    assert other.tolist() != ids.tolist()


def test_samples_have_the_lattice_distribution(vocabulary):
    import sentencepiece

    model, alpha, n = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), 0.4, 8000
    weights = {}

    def walk(rest, ids, log):
        if not rest:
            weights[tuple(ids)] = np.exp(log)
        for k in range(1, len(rest) + 1):
            i = model.piece_to_id(rest[:k].replace(" ", "▁"))
            if i > 2:
                walk(rest[k:], [*ids, i], log + alpha * vocabulary.weight[i])

    walk(" then", [], 0.0)
    total = sum(weights.values())
    found = {}
    buf, offsets = _slice(["then"] * n)
    ids, cut = pieces.sample_slice(buf, offsets, np.arange(n), vocabulary, alpha, 0)
    for a, b in itertools.pairwise(cut):
        found[tuple(ids[a:b].tolist())] = found.get(tuple(ids[a:b].tolist()), 0) + 1
    assert set(found) <= set(weights)
    for path, w in weights.items():
        p = w / total
        assert abs(found.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_maxscore_equals_brute_force():
    rng = np.random.default_rng(2)
    docs = np.floor(rng.standard_normal((700, 9)) * 3)
    docs[100:300] = docs[100]
    ids = np.sort(rng.choice(5000, 700, replace=False))
    asked = np.arange(0, 700, 7)
    q, d, s = vectors._exact_cell(ids[asked], docs[asked], ids, docs, 5)
    scores = docs[asked] @ docs.T
    scores[np.arange(len(asked)), asked] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert np.array_equal(d, ids[order].ravel()) and np.array_equal(s, np.take_along_axis(scores, order, 1).ravel())
    assert np.array_equal(q, np.repeat(ids[asked], 5))


@pytest.mark.parametrize(("length", "radius", "number"), [(8, 1, 4), (6, 2, 5)])
def test_probing_finds_every_code_within_the_radius(spark, length, radius, number):
    """By the pigeonhole: m substrings probed to r meet every code within m (r + 1) - 1 bits."""
    v = np.random.default_rng(3).standard_normal((500, 16))
    codes = vectors.learn_rotation(v)._replace(length=length, radius=radius, number=number)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    pairs = vectors.probed_pairs(rows.where("vec_id < 20"), rows, codes).select("query_id", "vec_id").distinct().collect()
    met = {(r["query_id"], r["vec_id"]) for r in pairs}
    bits = codes.bits(v)[:, : length * number]
    within = {(q, k) for q in range(20) for k in np.flatnonzero((bits != bits[q]).sum(axis=1) <= number * (radius + 1) - 1).tolist()}
    assert len(within) > 20 and within <= met


def test_near_copies_meet_once(spark):
    """A pair that shares many of the first substrings is one row of the join, not one for each of them."""
    random = np.random.default_rng(4)
    v = random.standard_normal(16) + 1e-3 * random.standard_normal((200, 16))
    codes = vectors.learn_rotation(random.standard_normal((500, 16)))._replace(length=8, radius=1, number=12)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    pairs = vectors.probed_pairs(rows.where("vec_id < 10"), rows, codes).select("query_id", "vec_id")
    assert pairs.count() == pairs.distinct().count() == 10 * 200


def test_empty_slices_of_features():
    buf, offsets = _slice(["", " "])
    assert len(quality.features(buf, offsets)[0]) == 0
    seen, owner, _ = langid.presence(buf, offsets)
    assert owner.tolist() == [1] and len(seen) == 1
