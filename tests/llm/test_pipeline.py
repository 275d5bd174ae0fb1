import corpus_pipeline
from longwave.llm import jaccard, lines


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    counts = {n: d.count() for n, d in kept.items()}
    assert 0 < counts["near_duplicates"] <= counts["line_dedup"] <= counts["quality"] <= whole
    assert kept["pieces"].where("NOT lossless").count() == 0 and counts["pieces"] == counts["mixing"] > 0
    assert lines.dedup(kept["line_dedup"].select("doc_id", "text")).where("n_removed > 0").count() <= 0.02 * counts["line_dedup"]
    assert jaccard.near_duplicates(kept["near_duplicates"]).where("doc_id <> component_id").count() == 0


def test_labels_separate_kept_and_rejected(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf).select("doc_id").join(labels, "doc_id").cache()
    assert good.where("quality = 1").count() >= 0.99 * labels.where("quality = 1").count()
    assert good.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
