"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longwave.llm import audit, chunks, jaccard, langid, licenses, lines, minhash, mixing, phrases, pieces, quality, vectors


#: A public vocabulary with byte pieces; another model file can be given instead.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


#: Target weights of the domains that the labels make.
MIX_WEIGHTS = {"clean": 0.94, "low": 0.03, "toxic": 0.03}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): clean, low (quality 0) or toxic."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return _table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, domain_labels(spark, sf_dir), MIX_WEIGHTS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.find(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_crc(5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, threshold=0.3).select("doc_id", (_crc(5) == 0).alias("held_out"), "score", "predicted")


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k_inner(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_cosine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_pieces(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    vocabulary = pieces.load(model_file)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sampled = pieces.encode(docs, vocabulary, F.col("doc_id"), alpha=1.0, seed=17, proof="lossless")
    return sampled.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "lossless")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_crc(4) != 2).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (_crc(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, num=80, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxscore": op1_maxscore,
    "op2_multi_index": op2_multi_index,
    "op3_pieces": op3_pieces,
    "op4_langid": op4_langid,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard": op7_jaccard,
    "op8_chunks": op8_chunks,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_superminhash": op11_superminhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_maxscore": vectors.ORACLE_SQL,
    "op6_line_dedup": lines.ORACLE_SQL,
    "op7_jaccard": jaccard.oracle_sql(words=3, num=90, den=100),
    "op11_superminhash": minhash.ORACLE_SQL,
    "op12_filter_audit": audit.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
