"""Line dedup over overlapping three-line windows.

Every three consecutive lines of a text are hashed; a window that stands at several places of the corpus
is kept where it stands first (smallest doc_id, then position) and removed elsewhere: the lines that any
later occurrence covers are cut out of their texts.  A window needs no company of its own: nothing is
gathered by window but its first place and count, which partial aggregation shrinks before the shuffle.
Windows that stand at one place only, and texts of which nothing is cut, are told apart by bitmaps of fixed size, and are
not shuffled again; a very common window is joined back in many parts.

Defined results: a null text stays null and has no lines; an empty text has one empty line; texts of
fewer than three lines have no window and stay as they are; windows of blank lines are windows like any
others, unless ``skip_blank`` leaves those of three blank lines out.  Rows equal in doc_id and text count as
one occurrence, and get equal results; null ids sort first.  Texts are read whole.  Columns named like the
results are replaced, others carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.llm.durable import discard, durable, may_hold, membership
from longwave.llm.repeats import join_counted

WINDOW = 3
#: Cells (as a power of two) of the bitmaps of repeated windows and of texts to cut.
WINDOW_BITS, TEXT_BITS = 26, 24

ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS k
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l)
),
r AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n
    FROM w
  ) WHERE n > 1
),
c AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(qs), 0)::INT AS n_removed,
  CASE WHEN qs IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(qs, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text
FROM l LEFT JOIN c ON l.doc_id = c.doc_id
"""


def repeated_places(docs: DataFrame, skip_blank: bool = False) -> DataFrame:
    """Later occurrences of repeated windows: id, hash (of the text), at (first line, from 0)."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.split("text", "\n").alias("lines"))
    rows = rows.where(F.size("lines") >= WINDOW)
    # Two 64-bit hashes: with one, windows of a very large corpus would meet by chance.
    keys = F.expr(
        f"""filter(transform(sequence(0, size(lines) - {WINDOW}), i -> named_struct(
              'at', i, 'blank', trim(concat(lines[i], lines[i + 1], lines[i + 2])) = '',
              'a', xxhash64(lines[i], lines[i + 1], lines[i + 2]), 'b', xxhash64(7, lines[i + 2], lines[i], lines[i + 1]))),
            w -> NOT (w.blank AND {str(skip_blank).lower()}))"""
    )
    places = rows.select("id", "hash", F.explode(keys).alias("w")).select("id", "hash", F.col("w.at").alias("at"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    here = F.struct("id", "at", "hash")
    first = durable(places.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1"))
    may = places.where(may_hold(docs.sparkSession, membership(first, "a", WINDOW_BITS), F.col("a")))
    met = join_counted(may, first, ["a", "b"], "n", here).where(~here.eqNullSafe(F.col("first"))).select("id", "hash", "at")
    met = durable(met)
    discard(first)
    return met


def dedup(docs: DataFrame, skip_blank: bool = False) -> DataFrame:
    """docs with text without the lines of later occurrences, and n_lines and n_removed (before, cut)."""
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    places = repeated_places(docs, skip_blank)
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + (WINDOW - 1)))))
    cut = durable(places.groupBy("id", "hash").agg(covered.alias("cut")))
    discard(places)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col("doc_id").alias("own"), "text", F.xxhash64("text").alias("own_hash"))
    flagged = rows.withColumn("touched", may_hold(docs.sparkSession, membership(cut, "hash", TEXT_BITS), F.col("own_hash")))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    met = flagged.where("touched").join(cut, same, "left").select("kept", "text", "cut")
    met = flagged.where("NOT touched").select("kept", "text", F.lit(None).cast("array<int>").alias("cut")).unionAll(met).withColumn("lines", F.split("text", "\n"))
    rest = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), cut), i -> lines[i]), '\n')")
    return met.select(
        *(F.col(f"kept.`{c}`").alias(c) for c in kept),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.when(F.col("cut").isNotNull(), F.size("cut")), F.lit(0)).alias("n_removed"),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(rest).alias("text"),
    )
