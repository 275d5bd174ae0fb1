"""What filters remove together and alone: every order of five filters audited from counts of failure masks.

A document's mask has a bit for each filter it fails.  A to D follow from its text; E (a repeated text) from the table:

* A bitmap of fixed size tells which fingerprints (xxhash64) may be there more than once; a text of any other fingerprint is not repeated and stays in its task.
* The others go through an RDD.  Each task keeps chains of the texts of one fingerprint with the smallest id, so that of a very
  common text it sends one row; what is not smallest there is known to be repeated already.
* The smallest ones are partitioned by fingerprint.  A chain holds whole texts, so documents whose fingerprints collide are not taken for
  copies, and all but those of a text's smallest id are given out as repeated.
* Masks meet the labels by id as rows of a few bytes; ``combineByKey`` adds vectors of counts by mask for each part, within tasks first.  All orders
  are sums over these vectors.

Defined results: a null text is empty, a null source the part ''; rows without id are never repeated, nor does any row repeat
them, and have no labels; rows equal in id are not repeats of each other; a document is good or toxic if any of its labels says so; empty
tables give no rows.  Texts are read whole.  Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.llm.repeats import CELL_BITS, repeated

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
#: A task forgets its chains beyond so many bytes of texts: then a common text is sent once more.
CHAIN_BYTES = 1 << 25

_REPEATED = 1 << LETTERS.index("E")
_CAPITALS = bytes(range(65, 91))
#: all documents, good ones and toxic ones
_KINDS = 3
_ORDERS = ["".join(p) for p in permutations(LETTERS)]
_SLIM = "doc_id long, part string, mask int, n long"

ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
m AS (
  SELECT doc_id, part,
    (len(ws) < {LEAST_WORDS})::INT
    + 2 * (100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d
),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
v AS (SELECT part, mask, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (x = 1) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)
),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM v, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def text_mask(data: bytes, code_points: int) -> int:
    """The bits of the filters that look at a document's own text (UTF-8)."""
    words = data.split()  # bytes split at 0x20 and 0x09-0x0D alone
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * code_points, any(s in data for s in SYMBOLS))
    return sum(1 << k for k, f in enumerate(failed) if f)


class Chains:
    """By fingerprint, texts with their smallest id and the parts of the rows of that id."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: bytes, doc_id: int, parts: Counter) -> tuple[int, Counter] | None:
        """Take rows in; gives back (id, parts) of rows of the text that are now known to be repeated."""
        chain = self.chains.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    entry[2].update(parts)
                    return None
                if doc_id > entry[1]:
                    return doc_id, parts
                out = entry[1], entry[2]
                entry[1:3] = doc_id, Counter(parts)
                return out
        chain.append([text, doc_id, Counter(parts)])
        self.size += len(text) + 200
        return None

    def drain(self) -> Iterator[tuple[int, tuple[bytes, int, Counter]]]:
        for fingerprint, chain in self.chains.items():
            for text, doc_id, parts in chain:
                yield fingerprint, (text, doc_id, parts)
        self.chains, self.size = {}, 0


def _slim(doc_id: int | None, parts: Counter, mask: int) -> Iterator[tuple]:
    for part, n in parts.items():
        yield doc_id, part, mask, n


def _within_task(bitmap: Broadcast[np.ndarray]):
    """From (fingerprint, id, text, part): (fingerprint, (text, id, parts)) of what may be smallest, and (any number, slim row) of what is decided."""

    def run(rows: Iterable) -> Iterator[tuple]:
        held, cells = Chains(), bitmap.value
        for k, (fingerprint, doc_id, text, part) in enumerate(rows):
            data = text.encode("utf-8", "surrogatepass")
            cell = (fingerprint & (1 << 64) - 1) >> 64 - CELL_BITS
            if doc_id is None or not int(cells[cell >> 6]) >> (cell & 63) & 1:
                yield k, (doc_id, part, text_mask(data, len(text)), 1)
                continue
            known = held.add(fingerprint, data, doc_id, Counter((part,)))
            if known:
                for row in _slim(*known, text_mask(data, len(text)) | _REPEATED):
                    yield k, row
            if held.size > CHAIN_BYTES:
                yield from held.drain()
        yield from held.drain()

    return run


def _between_tasks(rows: Iterable) -> Iterator[tuple]:
    """Slim rows: repeated ones as they are found, the smallest of each text in the end."""
    held = Chains()
    mask = lambda text: text_mask(text, len(text.decode("utf-8", "surrogatepass")))
    for fingerprint, row in rows:
        if len(row) == 4:
            yield row
            continue
        text, doc_id, parts = row
        known = held.add(fingerprint, text, doc_id, parts)
        if known:
            yield from _slim(*known, mask(text) | _REPEATED)
    for _, (text, doc_id, parts) in held.drain():
        yield from _slim(doc_id, parts, mask(text))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): every document's failures; n rows that are equal in these."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    fingerprints = docs.select(F.xxhash64(text).alias("fingerprint"))
    bitmap = spark.sparkContext.broadcast(repeated(fingerprints, lambda batches: (np.asarray(b.column("fingerprint")) for b in batches), docs.count()))
    rows = docs.select(F.xxhash64(text), F.col("doc_id").cast("long"), text, F.coalesce(F.col("source").cast("string"), F.lit(""))).rdd
    buckets = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitions(_within_task(bitmap)).partitionBy(buckets, lambda fingerprint: fingerprint)
    return spark.createDataFrame(routed.mapPartitions(_between_tasks), _SLIM, verifySchema=False)


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n) of rows whose text a row of a smaller id has."""
    return failure_masks(docs).where(F.col("mask").bitwiseAND(_REPEATED) != 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


def _vector(row: tuple[int, int, int, int]) -> np.ndarray:
    return _counted(np.zeros((_KINDS, 1 << len(LETTERS)), np.int64), row)


def _counted(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def mask_counts(masks: DataFrame, labels: DataFrame) -> RDD:
    """(part, vectors of counts by mask: of all documents, of good ones, of toxic ones)."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = masks.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", zero("good"), zero("toxic"))
    rows = known.unionAll(masks.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0), F.lit(0))).rdd
    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _counted, np.add)


def _orders_of(part: str, counts: np.ndarray) -> list[tuple]:
    """All orders and steps of a part, from its counts by mask."""
    masks = np.arange(1 << len(LETTERS))
    rows, taken = [], Counter()
    for order in _ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, gone = masks & bit != 0, masks & before != 0
            removed, good, toxic = counts[:, fails & ~gone].sum(axis=1).tolist()
            kept, redundant = int(counts[0, masks & (before | bit) == 0].sum()), int(counts[0, fails & gone].sum())
            rows.append((part, order, step, kept, removed, redundant, int(counts[0, bit]), good, toxic))
            taken[letter] += removed
            before |= bit
    return [(*row, taken[row[1][row[2] - 1]]) for row in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(failure_masks(docs), labels)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: _orders_of(*x)), schema, verifySchema=False)
