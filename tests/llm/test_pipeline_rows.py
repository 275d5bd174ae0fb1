"""Near-duplicate removal decides by row: null, shared and repeated ids."""

import corpus_pipeline


def test_near_duplicates_by_row(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    base, alone, nulls = " ".join(base), " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [
        (1, base), (2, near), (2, alone),  # 2 is a later copy in one row and unique in the other
        (None, nulls), (None, nulls + " more"), (None, near),  # near copies without ids
        (7, "said twice"), (7, "said twice"), (8, None), (8, None), (9, None), (None, ""), (None, ""),
    ]
    docs = spark.createDataFrame([(*r, "en", "web", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    of_nulls = [g for g in got if g[0] is None and (g[1] or "").startswith("y0")]
    assert len(of_nulls) == 1
    rest = sorted((g for g in got if g not in of_nulls), key=repr)
    assert rest == sorted([(1, base, 0), (2, alone, 2), (7, "said twice", 6), (8, None, 8), (9, None, 10), (None, "", 11)], key=repr)


def test_mixing_by_row(spark):
    """Without labels that fit, every row stays once, whatever its id and text; extra columns go."""
    rows = [(1, "a b c"), (1, "other words"), (None, "no id"), (2, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "web", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs.selectExpr("*", "1 AS key", "2 AS copies"), "/root/testdata/sf0.001")
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= set(rows)
    assert corpus_pipeline.mix_sources(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (2, "x\n" * 50, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
        assert stage(spark, docs, "/root/testdata/sf0.001").count() <= 4


def test_mixing_shuffles_no_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus_pipeline.mix_sources(spark, docs, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
