"""A pipeline over documents: quality filter, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; between stages
rows are written as Parquet and read again.  All but the last stage return the columns of documents, and drop any others.

Defined results, for every stage: nulls in any column, empty and very long texts, repeated rows and empty tables are taken as they
come.  Null and empty texts are documents like any others: the classifier scores them, they have no lines to cut, link with
nothing, hold no tokens and encode to no pieces.  Rows of equal id and text are treated alike until the near duplicates, which keep
one of them; ties go to the smaller id, then to a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longwave.llm import jaccard, lines, mixing, pieces, quality
from longwave.llm.durable import discard, durable, may_hold, membership
from longwave.llm.queries import PIECE_MODEL, domain_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cells (as a power of two) of the bitmaps of rows that a stage changes; rows outside of it are not shuffled.
TOUCHED_BITS = 24
#: Documents below this score are rejected.
LEAST_QUALITY = 0.3
#: Target weights after that: documents of low quality are no domain of the mixture any more.
MIX_WEIGHTS = {"clean": 0.97, "toxic": 0.03}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on all labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, LEAST_QUALITY).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of three-line windows; documents of which nothing is left go."""
    cut = lines.dedup(docs).where("n_removed = 0 OR n_removed < n_lines")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def _row_key() -> Column:
    """A hash of a row's id and text, null being equal to null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of Jaccard 0.8 or more connect, keep one row.

    It is decided by row, that is by id and text.  Of connected rows that of the smallest id stays (null
    ids come last, ties go to the text's hash), so rows that share an id but not a text stand or fall
    alone.  Rows equal in id and text, null being equal to null, stay once: that whose other columns sort
    first.  Rows without words are connected with nothing.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("__key"))
    groups = jaccard.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, num=80, den=100)
    places = groups.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    crowded = F.struct(F.min("__key").alias("low"), F.max("__key").alias("top"), F.max("n").alias("n"))
    by_component = places.groupBy("component").agg(crowded.alias("c")).where("c.low < c.top OR c.n > 1").select("component")
    # Rows of components of one row stay, and need no shuffle.
    touched = durable(places.join(by_component, "component").select("__key", "component"))
    flagged = keyed.withColumn("__touched", may_hold(spark, membership(touched, "__key", TOUCHED_BITS), F.col("__key")))
    alone = flagged.where("NOT __touched").select(*COLUMNS)
    met = flagged.where("__touched").join(touched, "__key", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    stay = met.groupBy(F.coalesce("component", "__key").alias("component")).agg(F.min_by("__key", order).alias("__key")).select("__key")
    # Repeated rows are equal in __key.
    first = met.join(stay, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return alone.unionAll(first.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin documents so that expected tokens meet the target weights; decided by row, that is by id and text.

    Without labels, or tokens, every row stays once.
    """
    labels = domain_labels(spark, sf_dir).where(F.col("domain").isin(*MIX_WEIGHTS))
    # Copies follow from a row alone, so rows are read once more rather than joined with them.
    rated = mixing.mix(docs.select(*COLUMNS), labels, MIX_WEIGHTS, keep_text=True)
    return rated.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, with proof that they decode to it."""
    vocabulary = pieces.load(PIECE_MODEL)
    sampled = pieces.encode(docs.select("doc_id", "text"), vocabulary, F.col("doc_id"), seed=17, proof="lossless")
    return sampled.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Classifiers and sampling cannot be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; it goes when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        discard(before)
        before = docs
    return docs
