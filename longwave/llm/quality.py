"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (proximal) updates and scored as sparse dot products.

Tokens are delimited by ASCII white space.  A token gives two words: its lower-cased bytes, and its
shape (which byte classes occur in it, and whether it repeats the token before).  N-grams of one and
two words and of one to three shapes are hashed into ``2**BITS`` columns; a text's vector holds
log(1 + count) and has unit length.

Defined results: a null or empty text, or one without tokens, has no features and gets the score of
the intercept alone.  Rows are scored one by one, so repeated rows get equal scores; texts of any
length are read whole.  If no labelled row of both classes exists the model is the constant
(positives + 1) / (rows + 2).  Columns other than the ones named are carried along untouched by
:func:`score`; the score's own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwave.llm import textbuf as tb

BITS = 18
#: The model is fitted on at most so many labelled rows, those of the smallest hashed ids.
FIT_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3

_CLASSES = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (
        1 if "a" <= _c <= "z" or _b >= 0x80 else 2 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9"
        else 8 if _c in ",.;:'\"-" else 16 if _c in "!?" else 32 if _c in "|<>{}[]()/\\=_" else 64 if _b > 32 else 128
    )


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a slice of texts: (text number, column, value), sorted by text and column."""
    start, end, doc = tb.spans(buf, offsets, tb.NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word = tb.span_hashes(tb.LOWER[buf], start, end)
    seen = np.bitwise_or.reduceat(_CLASSES[buf], start)
    seen &= np.uint64(127)
    head = _CLASSES[buf[start]] << np.uint64(8)
    same = np.zeros(len(start), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = tb.mix(seen + head + (same << np.uint64(20)) + np.uint64(1))
    columns, owners = [], []
    for kind, base, longest in ((1, word, 2), (2, shape, 3)):
        for n in range(1, longest + 1):
            if len(base) < n:
                continue
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            parts = [np.full(int(inside.sum()), kind * 8 + n, np.uint64)]
            parts += [base[k : len(base) - n + 1 + k][inside] for k in range(n)]
            columns.append(tb.chained(parts) >> np.uint64(64 - BITS))
            owners.append(doc[: len(doc) - n + 1][inside])
    key = (np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(columns)
    key.sort()
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    value = np.log1p(np.diff(np.append(fresh, len(key))))
    key = key[fresh]
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    norm = np.sqrt(tb.sums(value * value, owner, len(offsets) - 1))
    return owner, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), value / norm[owner]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[float, np.ndarray]:
    """FTRL-proximal over (columns, values, label) rows in the given order: intercept, weights."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    w = np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    positive = sum(y for _, _, y in rows)
    if not 0 < positive < len(rows):
        p = (positive + 1) / (len(rows) + 2)
        return float(np.log(p / (1 - p))), w[:size]
    for _ in range(EPOCHS):
        for column, value, y in rows:
            # Widened here, one row at a time: all rows at once would take the driver several times their size.
            i, x = np.append(column, size), np.append(value.astype(np.float64), 1.0)
            wi = weights(i)
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * wi
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return float(w[size]), w[:size]


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in tb.slices(batch.column("text")):
            owner, column, value = features(buf, offsets)
            cut = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    batch.column("label").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(cut, pa.array(column.astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))),
                ],
                ["doc_id", "label", "columns", "values"],
            )


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[float, np.ndarray]:
    """Fit on docs (doc_id, text) that labels (doc_id, label 0/1) marks; rows with nulls take no part.

    At most ``fit_rows`` labelled rows are used: those whose id hashes lowest, whatever the tables'
    sizes.  Ids are chosen first, so that only the chosen texts are read into features.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"))
    known = labels.where("label is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = known.join(texts.select("doc_id"), "doc_id").orderBy(*order).limit(fit_rows)
    table = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "label")
        .mapInArrow(_sampled_features, "doc_id long, label int, columns array<int>, values array<float>")
        .orderBy(*order)
        .limit(fit_rows)
        .toArrow()
    )
    rows = []
    for batch in table.to_batches():
        # Views of the batches, not copies.
        columns, values = batch.column("columns"), batch.column("values")
        cut, flat, weight = np.asarray(columns.offsets), np.asarray(columns.values), np.asarray(values.values)
        rows += [(flat[a:b], weight[a:b], y) for a, b, y in zip(cut[:-1], cut[1:], batch.column("label").to_pylist(), strict=True)]
    return train(rows)


def score(docs: DataFrame, model: tuple[float, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 if score >= threshold)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    plain, at = tb.plainly(docs, kept), kept.index("text")
    schema = T.StructType(list(plain.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intercept, weights = shared.value
        for batch in batches:
            for lo, hi, buf, offsets in tb.slices(batch.column(at)):
                owner, column, value = features(buf, offsets)
                logit = intercept + tb.sums(value * weights[column], owner, hi - lo)
                p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                made = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in batch.columns), *made], names=schema.names)

    return plain.mapInArrow(scored, schema).toDF(*kept, "score", "predicted")
