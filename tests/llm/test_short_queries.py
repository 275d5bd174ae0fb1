"""Every valid query of the approximate search gets min(k, candidates) rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from longwave.llm import vectors


def test_outlying_queries_get_all_their_rows(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((4, 32))
    rows = [(k, [float(x) for x in centre[k % 4] + 0.02 * rng.standard_normal(32)]) for k in range(1, 400) if k % 50]
    odd = [(50 * k, [float(x) for x in rng.standard_normal(32)]) for k in range(8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = vectors.nearest_cosine(table, F.col("vec_id") % 50 == 0, 5).collect()
    assert Counter(r["query_id"] for r in found) == {50 * k: 5 for k in range(8)}
    assert all(r["rank"] in range(1, 6) and r["query_id"] != r["vec_id"] for r in found)
    few = vectors.nearest_cosine(table.where("vec_id in (0, 1, 2, 50)"), F.col("vec_id") % 50 == 0, 5).collect()
    assert Counter(r["query_id"] for r in few) == {0: 3, 50: 3}


def test_postings_read_less_than_all(spark):
    """MaxScore reads fewer postings than there are, and gives what reading all of them gives."""
    rng = np.random.default_rng(5)
    docs = np.floor(256 * rng.standard_normal((3000, 32)) * rng.exponential(1.0, (1, 32)))
    postings, read = vectors.Postings.of(docs), 0
    for q in range(40):
        query = docs[q] * (rng.random(32) < 0.7)
        doc, score, n = vectors.max_score(query, q, postings, 5)
        plain = docs @ query
        plain[q] = -np.inf
        assert doc.tolist() == np.lexsort((np.arange(3000), -plain))[:5].tolist() and np.array_equal(score, plain[doc])
        read += n
    assert read < 0.7 * 40 * docs.size


def test_large_components_are_exact_and_saturate(spark):
    rows = [(0, [1e12, 1.0]), (50, [3e15, 1.0]), (1, [1e12, 2.0]), (2, [1e12, 3.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_k_inner(table, F.col("vec_id") % 50 == 0, 5).collect()}
    assert [found[0, k][0] for k in (1, 2, 3, 4, 5)] == [1, 2, 3, 50, 4]  # saturated sums tie and go by id
    assert found[0, 1][1] == (1 << 63) - 1 and found[0, 5][1] == -(1 << 63)


def test_probes_reach_neighbours_in_few_buckets(spark):
    """Clustered vectors: most true neighbours are found although a small share of rows is probed."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal((60, 32))
    v = centre[rng.integers(0, 60, 3000)] + 0.25 * rng.standard_normal((3000, 32))
    table = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<float>").cache()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for r in vectors.nearest_cosine(table, F.col("vec_id") % 50 == 0, 5).collect():
        score = unit @ unit[r["query_id"]]
        score[r["query_id"]] = -2
        hits += r["vec_id"] in np.argsort(-score)[:5]
    assert hits >= 0.9 * 300
    rows = table.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    codes = vectors.learn_codes(rows, 5)
    met = vectors.probed_pairs(rows.where("vec_id % 50 = 0"), rows, codes).select("query_id", "vec_id").distinct().count()
    assert met < 0.1 * 60 * 3000


def test_copies_of_a_vector_are_one_entry(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 400)] + [(1000 + k, [1.0, 2.0, 3.0 + k]) for k in range(1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in vectors.nearest_cosine(table, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(found[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and sorted(found[50])[0] == (1, 0) and len(found) == 8
