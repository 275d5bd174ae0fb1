"""Phrase collocations: contiguous phrases of two to four words that stand together more often than their parts would suggest.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at blanks and tabs.

* Identical pieces become one piece with a multiplicity, so that boilerplate is worked on once.
* Level by level (one word, two, ...) tasks sum the weights of their n-grams and send them by the hash of the phrase.  A bucket is
  a partition; duckdb adds its rows up as they stream in, in a bounded memory, on disk beyond it, and keeps frequent phrases.  An n-gram whose two shorter
  n-grams are not both frequent cannot be frequent itself: a bitmap of fixed size keeps those from being sent (it lets through more than it must,
  never less, so counts are exact).
* Candidates ask for the counts of their parts: each cut makes two requests, which are shuffled to where the parts are
  (very common parts in many shares) and come back by candidate.

Duckdb's overflow lies in a temporary folder of the task, like Spark's own spill: it goes with the task and is made again with it.

Defined results: a null text is empty; an empty table or one without frequent phrases gives no rows; a null language is ``und``; repeated rows count again; texts and
words are read whole, whatever their length; ties go to the larger count, then to the smaller phrase by UTF-8 bytes.  Other columns
are not looked at.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwave.llm import textbuf as tb
from longwave.llm.durable import discard, durable, members, membership
from longwave.llm.repeats import join_counted

#: A phrase of this count is frequent; candidates have up to LONGEST words.
LEAST, LONGEST = 30, 4
#: A candidate goes if a longer one that holds it has num / den of its count.
HELD_NUM, HELD_DEN = 80, 100
SCALE, TOP = 2_000_000, 2000
#: Cells (as a power of two) of the bitmap of frequent n-grams of one level.
CELL_BITS = 26
#: Tasks send sums of about so many n-grams or bytes of them.
HELD_ROWS, HELD_BYTES = 1 << 20, 1 << 25
#: Memory of duckdb in a task; what is more goes to disk.
BUCKET_MEMORY = "256MB"
#: The ranking of a language is made of the best of so many shares.
SHARES = 16

_ENDS = "[.,;:!?\\x0A-\\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_BLANK = tb.class_table(lambda b: b != 0x20)

ORACLE_SQL = f"""
WITH raw AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
p AS (
  SELECT lang, ws, count(*) AS m
  FROM (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM raw) WHERE len(ws) > 0 GROUP BY lang, ws
),
total AS (SELECT lang, sum(m * len(ws))::BIGINT AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, phrase, size, sum(m)::BIGINT AS a FROM (
    SELECT lang, m, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, ws, m, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size)
  ) GROUP BY lang, phrase, size HAVING sum(m) >= {LEAST}
),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, u.a AS l, v.a AS r, (({SCALE}::HUGEINT * cut.a) // (u.a + v.a))::BIGINT AS score
  FROM cut JOIN f u ON u.lang = cut.lang AND u.phrase = cut.x JOIN f v ON v.lang = cut.lang AND v.phrase = cut.y
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT lang, ws, a, s, unnest(range(1, size - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < size) GROUP BY ALL
),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_parts i ON i.lang = best.lang AND i.phrase = best.phrase
  WHERE i.held IS NULL OR {HELD_DEN}::HUGEINT * i.held < {HELD_NUM}::HUGEINT * best.a
)
SELECT kept.lang, (row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase))::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept JOIN total ON total.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces of a language, words one blank apart, and how often each stands there."""
    cut = F.explode(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _ENDS)).alias("piece")
    words = F.trim(F.regexp_replace("piece", "[ \t]+", " "))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), cut).select("lang", words.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _places(lang: pa.Array, phrase: pa.Array) -> Iterator[tuple]:
    """By slice: first row, bytes, starts and ends of words, their rows (in the slice) and their hashes, which depend on the language too."""
    names = lang.dictionary_encode()
    of_name = np.array([int.from_bytes(str(x).encode()[:64].ljust(8, b"\0"), "little") % (1 << 61) for x in names.dictionary.to_pylist()] or [0], np.uint64)
    salt = tb.mix(of_name)[np.asarray(names.indices)]
    for lo, hi, buf, offsets in tb.slices(phrase):
        start, end, row = tb.spans(buf, offsets, _NOT_BLANK)
        yield lo, buf, start, end, row, tb.mix(tb.span_hashes(buf, start, end) + salt[lo:hi][row])


def _keys(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of the n-gram that begins at each word (meaningless where it would leave the piece)."""
    n = len(word) - size + 1
    return tb.chained([word[k : n + k] for k in range(size)]).view(np.int64) if n > 0 else np.zeros(0, np.int64)


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _grams(found: DataFrame, size: int, shorter: np.ndarray | None) -> DataFrame:
    """(lang, phrase, w): weights of the n-grams of ``size`` words whose two shorter n-grams the bitmap may hold, summed within tasks."""
    shared = None if shorter is None else found.sparkSession.sparkContext.broadcast(shorter)

    def summed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held).combine_chunks().group_by(["lang", "phrase"]).aggregate([("w", "sum")]).rename_columns(["lang", "phrase", "w"])
        # Batches of bounded bytes: phrases may be long.
        step = max(1, min(1 << 16, (table.num_rows << 25) // max(1, table.nbytes)))
        for k in range(0, table.num_rows, step):
            part = table.slice(k, step).combine_chunks()
            yield from pa.table({"lang": part["lang"], "phrase": part["phrase"].cast(pa.string()), "w": part["w"]}).to_batches()

    def run(batches):
        held, rows, size_of = [], 0, 0
        for batch in batches:
            lang, weight = batch.column("lang"), np.asarray(batch.column("m"))
            for lo, buf, start, end, row, word in _places(lang, batch.column("piece")):
                n = len(start) - size + 1
                if n <= 0:
                    continue
                good = row[size - 1 :] == row[:n]
                if shared is not None:
                    known = members(shared.value, _keys(word, size - 1))
                    good &= known[:n] & known[1 : n + 1]
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                own = row[at] + lo
                held.append(pa.table({"lang": lang.take(pa.array(own)), "phrase": _strings(buf, start[at], end[at + size - 1]), "w": weight[own]}))
                rows, size_of = rows + len(at), size_of + held[-1].nbytes
                if rows >= HELD_ROWS or size_of >= HELD_BYTES:
                    yield from summed(held)
                    held, rows, size_of = [], 0, 0
        if held:
            yield from summed(held)

    return found.mapInArrow(run, "lang string, phrase string, w long")


def _frequent(grams: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, phrase, size, a, key) of phrases with a count of ``least`` or more: added up by duckdb, one hash bucket a partition."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return

        def all_of():
            yield first
            yield from batches

        with tempfile.TemporaryDirectory(prefix="bucket-") as folder, duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as base:
            rows = pa.RecordBatchReader.from_batches(first.schema, all_of())
            base.register("rows", rows)
            sums = base.sql(f"SELECT lang, phrase, sum(w)::BIGINT AS a FROM rows GROUP BY lang, phrase HAVING sum(w) >= {least}")
            for batch in sums.to_arrow_reader(1 << 14):
                if batch.num_rows:
                    lang, phrase = batch.column("lang"), batch.column("phrase")
                    # A phrase has size words; its key is that of the n-gram at its first one.
                    key = np.concatenate([_keys(word, size)[np.searchsorted(row, np.arange(row[-1] + 1))] for _, _, _, _, row, word in _places(lang, phrase)])
                    yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(key), size, np.int32)), batch.column("a"), pa.array(key)], ["lang", "phrase", "size", "a", "key"])

    return grams.repartition("lang", "phrase").mapInArrow(run, "lang string, phrase string, size int, a long, key long")


def frequent_phrases(found: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a, key) of all phrases of up to ``longest`` words with a count of ``least`` or more, as a durable table."""
    levels, shorter = [], None
    for size in range(1, longest + 1):
        levels.append(durable(_frequent(_grams(found, size, shorter), size, least)))
        if size < longest:
            shorter = membership(levels[-1], "key", CELL_BITS)
            if not shorter.any():
                break
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionAll(level)
    out = durable(whole)
    discard(*levels)
    return out


def _words(column: str, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(column, " "), first, count), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more: its lowest-scoring cut, ties to the earliest."""
    asked = frequent.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), _words("phrase", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), _words("phrase", F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    requests = asked.select("lang", F.col("phrase").alias("whole"), "a", "k", F.explode(sides).alias("s")).select("lang", F.col("s.part").alias("phrase"), "whole", "a", "k", "s.left")
    times = requests.groupBy("lang", "phrase").agg(F.count("*").alias("asked"))
    parts = durable(times.join(frequent.select("lang", "phrase", F.col("a").alias("f")), ["lang", "phrase"]))
    answers = join_counted(requests, parts, ["lang", "phrase"], "asked", F.col("whole"))
    both = answers.groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Decimals: the product may not fit in 64 bits.
    score = F.expr(f"(cast(a AS decimal(20, 0)) * cast({SCALE} AS decimal(8, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    best = both.withColumn("score", score.cast("long")).groupBy("lang", "whole", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    out = durable(best.select("lang", F.col("whole").alias("phrase"), "a", "best.l", "best.r", "best.score"))
    discard(parts)
    return out


def _not_held(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The candidates without those that a longer one with nearly their count holds."""
    wider = frequent.where("size > 2").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    inside = wider.select("lang", "phrase", "a", "inner", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("at"))
    held = inside.select("lang", _words("phrase", F.col("at"), F.col("inner")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (exact("held") * HELD_DEN < exact("a") * HELD_NUM)).drop("held")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = durable(pieces(docs))
    frequent = frequent_phrases(found, least, longest)
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = found.groupBy("lang").agg(F.sum(F.col("m") * words).cast("long").alias("n"))
    best = scored(frequent)
    kept = _not_held(best, frequent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are among the best of its shares: no task sorts a whole language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    first = kept.select("*", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = durable(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(found, frequent, best)
    return out
