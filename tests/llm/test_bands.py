"""Two sets that are alone in their bands link, however their number is estimated."""

from pyspark.sql import functions as F

from longwave.llm import jaccard


def test_pair_that_is_estimated_as_one_set_links(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[:-1], f"n{k}"])) for k in range(1, 4001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    register = F.shiftrightunsigned(F.xxhash64("node"), 55)
    placed = jaccard._describe(docs.withColumn("row", F.xxhash64("doc_id")), 3).select("doc_id", "node", register.alias("register")).cache()
    own = placed.where("doc_id = 0").first()["register"]
    pairs = [r["doc_id"] for r in placed.where((F.col("register") == own) & (F.col("doc_id") > 0)).collect()]
    lost = [k for k in pairs if placed.where(F.col("doc_id").isin(0, k)).agg(F.approx_count_distinct("node")).first()[0] == 1]
    assert lost
    got = jaccard.near_duplicates(docs.where(F.col("doc_id").isin(0, lost[0])), 3, 90, 100).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 2


def test_chains_that_no_pivot_connects(spark, monkeypatch):
    """Windows that slide over one long text: each links with the next few only, and many share keys without linking."""
    monkeypatch.setattr(jaccard, "CELL_SETS", 7)
    order = sorted(range(80), key=lambda k: (k * 37) % 80)
    texts = [" ".join(f"{c}{x}" for x in range(3 * k, 3 * k + 60)) for c in "ab" for k in range(40)]
    docs = spark.createDataFrame([(d, texts[k]) for d, k in enumerate(order)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 1, 80, 100).collect()}
    first = {c: min(d for d, k in enumerate(order) if k // 40 == c) for c in (0, 1)}
    assert got == {d: first[k // 40] for d, k in enumerate(order)}
