"""Queries over embeddings cover every row, whatever its id."""

import numpy as np
import pytest

from longwave.plans import catalogue

ROWS = 320


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((ROWS, 64)) + np.repeat(np.arange(4), ROWS // 4)[:, None]
    folder = tmp_path_factory.mktemp("whole")
    rows = [(k, [float(x) for x in np.float32(v[k])], k % 3) for k in range(ROWS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), np.float32(v).astype(float)


def _measures(z):
    euclid = lambda a, b: np.sqrt(((a - b) ** 2).sum())
    cosine = lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    return {"euclidean": euclid, "cityblock": lambda a, b: np.abs(a - b).sum(), "cosine": cosine, "correlation": lambda a, b: cosine(a - a.mean(), b - b.mean())}


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine", "correlation"])
def test_distances_of_the_whole_table(spark, small, metric):
    folder, v = small
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    got = {(r["i"], r["j"]): r["d"] for r in catalogue.QUERIES[f"dist_{metric}_whole"](spark, folder).collect()}
    assert len(got) == ROWS * (ROWS - 1) // 2
    measure = _measures(z)[metric]
    assert all(abs(d - measure(z[i], z[j])) < 2e-6 for (i, j), d in got.items())


def test_similarity_map_of_the_whole_table(spark, small):
    folder, v = small
    z = (v - v.mean(axis=0)) / v.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    got = {(r["i"], r["j"]): r["s"] for r in catalogue.QUERIES["similarity_map_whole"](spark, folder).collect()}
    assert len(got) == ROWS * (ROWS - 1) // 2
    assert all(abs(s - (1 - d[i, j] / d.max())) < 2e-6 for (i, j), s in got.items())


def test_merge_steps_and_clusters_of_the_whole_table(spark, small):
    folder, _ = small
    steps = catalogue.QUERIES["merge_steps"](spark, folder).collect()
    assert len(steps) == ROWS - 1 and max(r["size"] for r in steps) == ROWS
    assert sorted(r["segment"] for r in catalogue.QUERIES["auto_k"](spark, folder).collect()) == list(range(ROWS))
