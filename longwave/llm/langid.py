"""Language identification with a blended-spectrum string kernel.

A block (up to ``BLOCK`` bytes of a text; blocks cover the whole text) is the set of byte n-grams (one
to four bytes, ASCII and Latin-1 letters lower-cased, other ASCII bytes read as blanks) that begin in
it, hashed into ``2**BITS`` columns.  The kernel of two blocks is the size of the common set over the
root of the product of the set sizes; that of a text with a block is the mean over the text's blocks,
weighted by bytes, so that the language of most of a mixed text wins.  Landmark blocks give a Nyström
map, in which one ridge regression per language is fitted against the rest.  Scoring a batch is two
matrix products: presence x landmarks, then kernel values x coefficients.

Defined results: null texts and texts without any letter give ``und`` with score 0, as do all texts if
no labelled row exists.  Texts of any length are read whole; repeated rows get equal results; columns
named like the two results are replaced, all others are carried along.  The score is the softmax of
the regressions' outputs; equal outputs go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwave.llm import textbuf as tb

BITS, LONGEST, BLOCK = 13, 4, 1024
#: Bounds of the fit: labelled texts, landmarks among them, words of the excerpts added per text, and languages.
FIT_ROWS, LANDMARKS, EXCERPTS, LANGUAGES = 3000, 96, (1, 4, 16, 64), 1024
RIDGE, SHARPNESS = 1e-2, 3.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # columns x landmarks, each divided by the root of its size
    coefficients: np.ndarray  # landmarks x languages
    intercept: np.ndarray


def presence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which hashed n-grams occur, as a (blocks, columns) matrix of 0 and 1; each block's text and bytes."""
    length = np.diff(offsets)
    count = -(-length // BLOCK)
    owner = np.repeat(np.arange(len(length)), count)
    inner = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
    begin = offsets[:-1][owner] + inner
    size = np.minimum(length[owner] - inner, BLOCK)
    out = np.zeros((len(owner), 1 << BITS), np.uint8)
    folded = np.append(_FOLD[buf], np.full(BLOCK + LONGEST, 32, np.uint8))
    folded[np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1] += 0x20
    place = np.arange(BLOCK + LONGEST - 1)
    for k in range(0, len(owner), 64):
        rows = slice(k, k + 64)
        span = folded[begin[rows, None] + place]
        span[place >= np.minimum(size[rows] + LONGEST - 1, offsets[1:][owner[rows]] - begin[rows])[:, None]] = 32
        flat, row = out[rows].reshape(-1), (np.arange(len(span), dtype=np.uint32) << np.uint32(BITS))[:, None]
        code = np.zeros(span.shape, np.uint32)
        for n in range(1, LONGEST + 1):
            code = (code[:, : span.shape[1] - n + 1] << np.uint32(8)) | span[:, n - 1 :]
            flat[(((code + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) + row] = 1
    return out, owner, size


def _kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = seen.sum(axis=1, dtype=np.uint32)
    return (seen.astype(np.float32) @ landmarks) / np.sqrt(np.maximum(size, 1)).astype(np.float32)[:, None]


def outputs(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The regressions' outputs for each text of a slice."""
    seen, owner, size = presence(buf, offsets)
    values = np.concatenate([np.zeros((0, model.landmarks.shape[1]), np.float32)] + [_kernel(seen[k : k + 256], model.landmarks) for k in range(0, len(seen), 256)])
    made = values.astype(np.float64) @ model.coefficients
    n, whole = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    return np.stack([tb.sums(made[:, c] * size, owner, n) / whole for c in range(made.shape[1])], axis=1) + model.intercept


def train(packed: np.ndarray, names: list[str], whole: np.ndarray) -> Model | None:
    """Fit on bit-packed presence rows; landmarks are drawn evenly from the languages' whole texts."""
    languages = sorted(set(names))
    if not languages:
        return None
    target = np.array([languages.index(x) for x in names])
    unpack = lambda rows: np.unpackbits(packed[rows], axis=1)[:, : 1 << BITS]
    share = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([np.flatnonzero((target == k) & whole)[:share] for k in range(len(languages))])
    base = unpack(chosen).astype(np.float32)
    landmarks = np.ascontiguousarray((base / np.sqrt(np.maximum(base.sum(axis=1), 1))[:, None]).T)
    gram = np.zeros((len(chosen) + 1, len(chosen) + 1))
    right = np.zeros((len(chosen) + 1, len(languages)))
    values, vectors = np.linalg.eigh(_kernel(unpack(chosen), landmarks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # the Nyström map: kernel values @ root
    weight = 1 / np.bincount(target, minlength=len(languages))[target]
    for k in range(0, len(packed), 512):
        rows = slice(k, k + 512)
        x = np.hstack([_kernel(unpack(rows), landmarks).astype(np.float64) @ root, np.ones((len(target[rows]), 1))])
        wx = x * weight[rows][:, None]
        gram += wx.T @ x
        right += wx.T @ np.where(target[rows][:, None] == np.arange(len(languages)), 1.0, -1.0)
    fitted = np.linalg.solve(gram + RIDGE / len(chosen) * np.eye(len(gram)), right)
    return Model(languages, landmarks, root @ fitted[:-1], fitted[-1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in tb.slices(batch.column("text")):
            start, end, owner = tb.spans(buf, offsets, tb.NOT_SPACE)
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            full = np.flatnonzero(np.diff(cut) > 0)
            rows, bits, size = [], [], []
            for words in (0, *EXCERPTS):
                # A run of words, or for 0 a block's worth of bytes, from a place that follows from the length.
                room = np.diff(cut)[full]
                first = cut[full] + (np.diff(offsets)[full] * 7919) % (np.maximum(room - words + 1, 1) if words else np.maximum(room // 2, 1))
                last = np.minimum(first + words, cut[full + 1]) - 1
                stop = end[last] if words else np.minimum(start[first] + BLOCK, offsets[full + 1])
                pieces = [buf[a:b][:BLOCK] for a, b in zip(start[first], stop, strict=True)]
                part = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                seen = presence(np.concatenate(pieces) if pieces else buf[:0], part)[0]
                rows += (full + lo).tolist()
                bits += [x.tobytes() for x in np.packbits(seen, axis=1)]
                size += [words] * len(full)
            out = batch.select(["doc_id", "lang"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(size, pa.int32()), pa.array(bits, pa.binary())], ["doc_id", "lang", "words", "bits"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, languages: int = LANGUAGES) -> Model | None:
    """Fit on docs (doc_id, text, lang); rows with a null among these or without a letter take no part.

    At most ``fit_rows`` texts are used, those whose id hashes lowest, evenly over the languages, but two of each at
    least.  The model has a regression for each language, so their number is bounded too: of more than ``languages`` the
    most frequent are learned.  Of a text, excerpts of up to ``BLOCK`` bytes are learned from.
    """
    known = docs.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    if not langs:
        return None
    each = max(2, fit_rows // len(langs))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = known.where(F.col("lang").isin(langs)).select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang")
    table = (
        known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])
        .select("doc_id", "lang", "text")
        .mapInArrow(_sampled, "doc_id long, lang string, words int, bits binary")
        .orderBy(*order, "words", "lang")
        .limit(max(fit_rows, 2 * len(langs)) * (1 + len(EXCERPTS)))
        .toArrow()
    )
    packed = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return train(packed, table["lang"].to_pylist(), np.asarray(table["words"]) == 0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to docs, which has a column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    lettered = tb.plainly(docs, kept, lettered=F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    at = kept.index("text")
    schema = T.StructType(lettered.schema.fields[:-1]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            letter = np.asarray(batch.columns[-1].to_numpy(zero_copy_only=False), bool)
            for lo, hi, buf, offsets in tb.slices(batch.column(at)):
                names, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None:
                    out = outputs(buf, offsets, model)
                    soft = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
                    names, score = np.array(model.languages, object)[out.argmax(axis=1)], 1 / soft.sum(axis=1)
                    names[~letter[lo:hi]], score[~letter[lo:hi]] = "und", 0.0
                columns = [x.slice(lo, hi - lo) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return lettered.mapInArrow(predicted, schema).toDF(*kept, "lang_pred", "score")
