"""Search over dense vectors: exact inner products by MaxScore, near cosines by multi-index hashing.

The exact search deals rows into a grid of (block of queries) x (shard of candidates); a cell holds a bounded
number of both, whatever the tables' sizes, and returns its best ``k`` rows per query, and one window per query merges
the shards.  The approximate search is a global index of code substrings, of which queries meet only the buckets they probe.

Defined results, for both searches: vectors that are null or hold a null, NaN or infinite component take
no part, neither as query nor as candidate (for the cosine, zero vectors too).  Shorter vectors count as
padded with zeros.  Rows that repeat an id count once, with the vector that sorts first.  Ties go to the
smaller id.  With fewer than ``k`` candidates all of them are returned; without queries, no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwave.llm.durable import discard, durable

SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Documents of a block of postings, for which the bounds of its terms are kept, and terms between two tests.
BLOCK_DOCS, TERMS_AT_A_TIME = 1024, 8
#: Rows that the codes are learned from (those of the smallest hashed ids), and how many of them act as queries, over all rows.
FIT_ROWS, FIT_QUERIES = 8192, 256
#: The share of true neighbours of the fitted queries that probing must meet, and the share of rows it should not exceed.
REACH, PROBED = 0.95, 0.09
#: Bits of a code at most, of the part that is compared before reranking, and choices of a substring's length and radius.
CODE_BITS, COMPARED, LENGTHS, RADII = 1024, 256, (8, 10, 12, 14, 16, 18, 20), (0, 1, 2, 3)

#: The exact search in SQL, with queries vec_id % 50 = 0 and k = 5.
ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_RESULT = "query_id long, vec_id long, score double"
#: The range of a long.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _valid(vectors: DataFrame, nonzero: bool) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col("vec_id").isNotNull() & v.isNotNull() & finite
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return doubles.where(keep).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten(), np.float64)
    return out


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller document; sorted."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return query[keep], doc[keep], score[keep]


# ---- exact search ---------------------------------------------------------------------------------


class Postings(NamedTuple):
    """A shard's documents by term: a term's values in order of document, and their extremes in each block of documents."""

    values: np.ndarray  # terms x documents
    top: np.ndarray  # terms x blocks
    low: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray) -> Postings:
        values = np.ascontiguousarray(docs.T)
        edges = np.arange(0, values.shape[1], BLOCK_DOCS)
        return cls(values, np.maximum.reduceat(values, edges, axis=1), np.minimum.reduceat(values, edges, axis=1))


def max_score(query: np.ndarray, skip: int, postings: Postings, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents (numbers, scores) of one query, other than number ``skip``, and how many postings were read.

    A term's bound in a block is the largest contribution that a document there can get from it.  Blocks are taken in
    order of their bounds' sum; one whose sum is below the k-th best score so far ends the search.  In a block, terms come in
    order of their bounds.  Those at the end whose bounds' sum cannot lift a document above that score on their own are
    non-essential: documents are only probed in them while they can still compete, and the same test drops
    documents between groups of essential terms.  The most promising documents are completed early, to raise the score to beat.
    """
    terms = np.flatnonzero(query)
    weight, n_docs = query[terms], postings.values.shape[1]
    bound = np.maximum(weight[:, None] * postings.top[terms], weight[:, None] * postings.low[terms])
    whole = bound.sum(axis=0)
    found, scores, threshold, read = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0
    for block in np.argsort(-whole, kind="stable").tolist():
        if whole[block] < threshold:
            break
        first, last = block * BLOCK_DOCS, min(n_docs, (block + 1) * BLOCK_DOCS)
        order = np.argsort(-bound[:, block], kind="stable")
        rest = np.append(np.cumsum(bound[order[::-1], block])[::-1], 0.0)  # what the terms from a place on can still give
        doc = np.arange(first, last)
        doc, score = doc[doc != skip], np.zeros(last - first - (first <= skip < last))
        for place in range(0, len(order), TERMS_AT_A_TIME):
            if not len(doc):
                break
            part = order[place : place + TERMS_AT_A_TIME]
            rows = terms[part]
            dense = len(doc) == last - first
            score = score + weight[part] @ (postings.values[rows, first:last] if dense else postings.values[np.ix_(rows, doc)])
            read += len(doc) * len(part)
            left = order[place + len(part) :]
            if 3 * TERMS_AT_A_TIME <= place + len(part) and len(left) and len(doc) > 4 * k:
                ahead = np.argpartition(-score, k - 1)[:k]
                full = score[ahead] + weight[left] @ postings.values[np.ix_(terms[left], doc[ahead])]
                read += k * len(left)
                threshold = max(threshold, np.partition(np.append(scores, full), -k)[-k])
            if threshold > -np.inf:
                alive = score + rest[place + len(part)] >= threshold
                if alive.mean() < 0.8:
                    doc, score = doc[alive], score[alive]
        found, scores = np.append(found, doc), np.append(scores, score)
        order = np.lexsort((found, -scores))[:k]
        found, scores = found[order], scores[order]
        if len(found) == k:
            threshold = max(threshold, scores[-1])
    return found, scores, read


def _exact_cell(query_ids, queries, doc_ids, docs, k):
    """One cell of the exact search; vectors hold whole numbers, documents come in order of id."""
    if max(np.abs(queries).max(initial=0), np.abs(docs).max(initial=0)) ** 2 * queries.shape[1] >= 2.0**53:
        return _large_cell(query_ids, queries, doc_ids, docs, k)
    postings, found = Postings.of(docs), []
    for q in range(len(queries)):
        at = int(np.searchsorted(doc_ids, query_ids[q]))
        skip = at if at < len(doc_ids) and doc_ids[at] == query_ids[q] else -1
        doc, score, _ = max_score(queries[q], skip, postings, k)
        found.append((np.full(len(doc), query_ids[q]), doc_ids[doc], score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _large_cell(query_ids, queries, doc_ids, docs, k):
    """The same where doubles would lose digits, in Python's integers; scores outside of a long's range become its ends."""
    whole, found = [[int(x) for x in row] for row in docs], []
    for q, row in zip(query_ids.tolist(), queries, strict=True):
        terms = [int(x) for x in row]
        scored = ((min(_MOST, max(_LEAST, sum(map(int.__mul__, terms, other)))), d) for d, other in zip(doc_ids.tolist(), whole, strict=True) if d != q)
        found += [(q, d, s) for s, d in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    query, doc, score = zip(*found, strict=True) if found else ((), (), ())
    return np.array(query, np.int64), np.array(doc, np.int64), np.array(score, np.int64)


def _in_grid(rows: DataFrame, is_query: Column, cell, k: int, kind: str) -> DataFrame:
    """Deal rows into grid cells, run ``cell`` in each and merge the shards."""
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards, blocks = -(-sizes["n"] // SHARD_ROWS) or 1, -(-sizes["q"] // BLOCK_QUERIES) or 1
    deal = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "v", F.lit(False).alias("query"), deal(1, shards).alias("shard"), every(blocks).alias("block"))
    queries = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("query"), every(shards).alias("shard"), deal(2, blocks).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        asked = np.asarray(table["query"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids, v = np.asarray(table["vec_id"]), _matrix(table["v"])
        by_id = lambda part: part[np.argsort(ids[part], kind="stable")]
        left, right = by_id(np.flatnonzero(asked)), by_id(np.flatnonzero(~asked))
        none = np.zeros(0, np.int64)
        found = cell(ids[left], v[left], ids[right], v[right], k) if len(left) and len(right) else (none, none, none.astype(kind))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = candidates.unionAll(queries).groupBy("block", "shard").applyInArrow(run, f"query_id long, vec_id long, score {'long' if kind == 'int64' else 'double'}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_inner(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k largest inner products of each query with all other rows, exactly (MaxScore).

    vectors: vec_id, embedding; components are used as floor(256 * x).  is_query is a condition on
    vec_id.  Returns query_id, rank, vec_id, score (long).  Whatever the components, sums are exact; a sum outside
    of a long's range becomes the range's end, and equal scores go by id.
    """
    scaled = lambda q, v: (q, np.floor(v * 256.0))

    def cell(query_ids, queries, doc_ids, docs, k):
        with np.errstate(over="ignore"):
            return _exact_cell(*scaled(query_ids, np.clip(queries, -1e300, 1e300)), *scaled(doc_ids, np.clip(docs, -1e300, 1e300)), k)

    return _in_grid(_valid(vectors, nonzero=False), is_query, cell, k, "int64")


# ---- approximate search ---------------------------------------------------------------------------


def _tamed(v: np.ndarray) -> np.ndarray:
    """Rows of extreme size times a power of two, which leaves every cosine as it is."""
    top = np.abs(v).max(axis=1, initial=0)
    power = np.where((top > 1e100) | ((top < 1e-100) & (top > 0)), np.frexp(top)[1], 0)
    return np.ldexp(v, -power[:, None])


class Codes(NamedTuple):
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    length: int  # bits of a substring
    radius: int  # bits by which a probed bucket may differ
    number: int  # of substrings
    compared: int  # most bits by which the first COMPARED bits may differ

    def bits(self, v: np.ndarray) -> np.ndarray:
        """(rows, bits): the signs of the rotated, centred unit vectors."""
        width = len(self.mean)
        v = np.pad(v, ((0, 0), (0, max(0, width - v.shape[1]))))[:, :width]
        unit = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]
        return (unit - self.mean) @ self.rotation > 0

    def buckets(self, bits: np.ndarray) -> np.ndarray:
        """(rows, substrings): each substring as a number."""
        parts = bits[:, : self.number * self.length].reshape(len(bits), self.number, self.length)
        return parts @ (1 << np.arange(self.length, dtype=np.int64))

    def ball(self) -> np.ndarray:
        """What to change in a bucket's number to get all buckets within the radius."""
        flips = [sum(1 << b for b in chosen) for r in range(self.radius + 1) for chosen in itertools.combinations(range(self.length), r)]
        return np.array(flips, np.int64)


#: The first COMPARED bits as columns.
_W = [f"w{k}" for k in range(COMPARED // 64)]


def _words(bits: np.ndarray) -> np.ndarray:
    """The first COMPARED bits of codes as 64-bit words."""
    part = np.zeros((len(bits), COMPARED), bool)
    part[:, : min(COMPARED, bits.shape[1])] = bits[:, :COMPARED]
    return np.packbits(part, axis=1).view(np.int64)


def learn_rotation(sample: np.ndarray, rounds: int = 20) -> Codes:
    """Principal axes, then rotations that best fit signs (iterative quantisation) from several starts, as many as make CODE_BITS."""
    unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    mean = unit.mean(axis=0)
    low = (unit - mean) @ (axes := np.linalg.eigh((unit - mean).T @ (unit - mean))[1][:, ::-1][:, :CODE_BITS])
    random, found = np.random.default_rng(7), []
    for _ in range(max(1, CODE_BITS // axes.shape[1])):
        rotation = np.linalg.qr(random.standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ rotation > 0, 1.0, -1.0).T @ low)
            rotation = (left @ right).T
        found.append(axes @ rotation)
    return Codes(mean, np.concatenate(found, axis=1), 8, 8, 1, COMPARED)


def choose_probes(codes: Codes, asked: np.ndarray, near: np.ndarray, others: np.ndarray, rows: int) -> Codes:
    """Length, radius and number of substrings: the cheapest of those that meet enough of the neighbours.

    asked and near hold the bits of pairs of neighbours, others those of a sample of all rows.  The cost of a choice is
    its probed buckets plus the rows expected in them.
    """
    wanted, best = asked != near, None
    apart = asked[: len(others)] != others[: len(asked)]
    for length in LENGTHS:
        number = min(wanted.shape[1] // length, 128)
        if not number or (1 << length) > 64 * max(rows, 1):
            continue
        gaps = lambda x: np.minimum.accumulate(x[:, : number * length].reshape(len(x), number, length).sum(axis=2), axis=1)  # noqa: B023, E731
        met_gap, other_gap = gaps(wanted), gaps(apart)
        for radius in RADII:
            reach, probed = (met_gap <= radius).mean(axis=0), (other_gap <= radius).mean(axis=0)
            enough = np.flatnonzero(reach >= REACH)
            n = int(enough[0]) if len(enough) else number - 1
            cost = (n + 1) * sum(math.comb(length, r) for r in range(radius + 1)) + probed[n] * rows
            order = (not len(enough), probed[n] > PROBED, probed[n] if probed[n] > PROBED else cost, -reach[n])
            if best is None or order < best[0]:
                best = (order, codes._replace(length=length, radius=radius, number=n + 1))
    chosen = best[1] if best else codes
    head = wanted[:, :COMPARED].sum(axis=1)
    return chosen._replace(compared=int(np.quantile(head, 0.985)) if len(head) else COMPARED)


def _closest(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> pa.Table:
    """The k nearest rows (query, v) of a few queries among all rows: what codes are measured against."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True))))

    def run(batches):
        ids, asked = shared.value
        for batch in batches:
            own, v = np.asarray(batch.column("vec_id")), _matrix(pa.chunked_array([batch.column("v")]), asked.shape[1])
            unit = _tamed(v)
            unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            score = asked @ unit[:, : asked.shape[1]].T
            score[ids[:, None] == own[None, :]] = -2.0
            part = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(ids)), part.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, part.ravel()]), batch.column("v").take(pa.array(part.ravel()))], ["q", "score", "v"])

    found = rows.mapInArrow(run, "q long, score double, v array<double>").where("score > -2")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k).select("q", "v").toArrow()


def learn_codes(rows: DataFrame, k: int) -> Codes | None:
    """Codes fitted on at most ``FIT_ROWS`` rows; how to probe, on ``FIT_QUERIES`` of them and their neighbours among all rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        return None
    v, ids = _tamed(_matrix(sample["v"])), np.asarray(sample["vec_id"])
    codes = learn_rotation(v)
    known = _closest(rows, ids[:FIT_QUERIES], v[:FIT_QUERIES], k)
    if not known.num_rows:
        return codes
    bits = codes.bits(v)
    asked = bits[np.asarray(known["q"])]
    near = codes.bits(_tamed(_matrix(known["v"], v.shape[1])))
    return choose_probes(codes, asked, near, np.roll(bits, 1, axis=0)[np.asarray(known["q"])], rows.count())


def _postings(rows: DataFrame, codes: Codes, probe: bool) -> DataFrame:
    """The index (bucket, vec_id, w0, w1, ...), a row per substring; for queries, a row per probed bucket."""
    shared = rows.sparkSession.sparkContext.broadcast((codes, codes.ball() if probe else np.zeros(1, np.int64)))

    def run(batches):
        codes, ball = shared.value
        step = max(1, (1 << 18) // (codes.number * len(ball)))
        for batch in batches:
            bits = codes.bits(_tamed(_matrix(pa.chunked_array([batch.column("v")]))))
            ids, words = np.asarray(batch.column("vec_id")), _words(bits)
            place = (np.arange(codes.number, dtype=np.int64) << 32)[None, :, None]
            own = codes.buckets(bits)
            for a in range(0, len(ids), step):
                bucket = (own[a : a + step, :, None] ^ ball[None, None, :]) + place
                each = np.repeat(np.arange(a, min(len(ids), a + step)), bucket.shape[1] * bucket.shape[2])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(ids[each]), *(pa.array(words[each, k]) for k in range(len(_W)))], ["bucket", "vec_id", *_W])

    return rows.mapInArrow(run, f"bucket long, vec_id long, {', '.join(f'{w} long' for w in _W)}")


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))), F.lit(0.0), lambda t, z: t + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _moderate(v: Column) -> Column:
    """v, divided by its largest component where squares could leave the range of doubles."""
    top = F.array_max(F.transform(v, F.abs))
    return F.when((top > 1e100) | (top < 1e-100), F.transform(v, lambda x: x / top)).otherwise(v)


def probed_pairs(asked: DataFrame, rows: DataFrame, codes: Codes) -> DataFrame:
    """(query_id, vec_id, differ) for buckets in which a query meets a row; differ: bits among the compared ones.

    Near copies share most of their substrings.  The compared bits tell whether a pair meets in the first substrings
    already, so that only the first of those buckets gives it; pairs that meet only in later ones may come repeatedly.
    """
    probes = _postings(asked, codes, probe=True).select("bucket", F.col("vec_id").alias("query_id"), *(F.col(w).alias(f"q{w}") for w in _W))
    gaps = [F.col(w).bitwiseXOR(F.col(f"q{w}")) for w in _W]
    count = lambda parts: functools.reduce(Column.__add__, map(F.bit_count, parts))
    place, first = F.shiftright("bucket", 32), F.lit(True)
    for k in range(min(codes.number, COMPARED // codes.length)):
        bits = np.zeros((1, COMPARED), bool)
        bits[0, k * codes.length : (k + 1) * codes.length] = True
        apart = count(g.bitwiseAND(F.lit(m)) for g, m in zip(gaps, _words(bits)[0].tolist(), strict=True) if m)
        first = first & ((place <= k) | (apart > codes.radius))
    met = _postings(rows, codes, probe=False).join(probes, "bucket").where(first)
    return met.select("query_id", "vec_id", count(gaps).alias("differ"))


def nearest_cosine(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k rows of largest cosine found for each query (multi-index hashing over learned codes).

    Codes of up to ``CODE_BITS`` bits are cut into substrings, and every row is indexed under each of its substrings.  A query
    probes, for each substring, all buckets within a radius r: by the pigeonhole principle it meets every code of
    m substrings within a Hamming distance of m (r + 1) - 1, and others by chance.  What it meets is reranked by
    the cosine of the original vectors unless the first ``COMPARED`` bits differ too much.  Length, radius and number of substrings
    are the cheapest that meet ``REACH`` of the true neighbours of the fitted queries.  Equal vectors are one entry of the index,
    with their k + 1 smallest ids.  Queries that meet fewer than k rows are compared with all rows, in blocks.
    Returns query_id, rank, vec_id, score (double).
    """
    spark = vectors.sparkSession
    rows = durable(_valid(vectors, nonzero=True))
    entry = F.xxhash64("v")
    place = F.row_number().over(Window.partitionBy(entry, "v").orderBy("vec_id"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = durable(firsts.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    codes = learn_codes(entries, k)
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = rows.where(is_query)
    named = durable(queries.select("v", F.col("vec_id").alias("query_id")).join(entries.select("v", F.col("vec_id").alias("entry")), "v").select("query_id", "entry"))
    asked = entries.join(named.select(F.col("entry").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "v")
    pairs = durable(probed_pairs(asked, entries.select("vec_id", "v"), codes).where(F.col("differ") <= codes.compared).select("query_id", "vec_id").distinct())
    scored = pairs.join(entries, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = scored.select(F.col("query_id").alias("entry"), _cosine(_moderate(F.col("q")), _moderate(F.col("v"))).alias("score"), F.explode("ids").alias("vec_id"))
    by_entry = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    best = durable(scored.withColumn("place", F.row_number().over(by_entry)).where(F.col("place") <= k + 1))
    each = named.join(best, "entry").where("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = durable(each.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, rows.count() - 1)).select("query_id")
    short = durable(named.select("query_id").join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        again = rows.join(short.select(F.col("query_id").alias("vec_id"), F.lit(True).alias("asked")), "vec_id", "left")
        found = found.join(short, "query_id", "left_anti").unionByName(_in_grid(again, F.col("asked").isNotNull(), _cosine_cell, k, "float64"))
        found, before = durable(found), found
        discard(before)
    discard(entries, named, pairs, best, short, rows)
    return found


def _cosine_cell(query_ids, queries, doc_ids, docs, k):
    """One cell of the plain search, row by row, so that equal vectors get equal scores."""
    width = max(queries.shape[1], docs.shape[1])
    queries, docs = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (_tamed(queries), _tamed(docs)))
    norm, found = np.sqrt((docs * docs).sum(axis=1)), []
    for q in range(len(queries)):
        near = np.flatnonzero(doc_ids != query_ids[q])
        score = (docs[near] * queries[q]).sum(axis=1) / (norm[near] * np.sqrt((queries[q] ** 2).sum()))
        found.append(_best(np.full(len(near), q), near, score, k))
    query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return query_ids[query], doc_ids[doc], score
