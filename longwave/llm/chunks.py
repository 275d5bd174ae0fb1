"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's bytes: h = 2h + gear[byte], kept to 16 bits, so that it depends on the
last 16 bytes alone.  A chunk ends where the upper ``MASK_BITS`` bits are zero and it has ``LEAST`` bytes, or
at ``MOST`` bytes; so chunk borders follow the content and fall into step again soon after an insertion.
Chunks are compared by a 128-bit digest.  A chunk's first place in the corpus (smallest doc_id, then
position) stays; elsewhere it is a duplicate.  Duplicates that follow each other form a span.  All spans
are reported, however short; :func:`cut` takes out those of at least ``least_span`` bytes.

Only chunks whose digest may repeat are shuffled (see repeats.py).  Nothing is gathered by chunk but its first
place and count, which partial aggregation shrinks before the shuffle; a very common chunk is joined back in many parts.

Defined results: null and empty texts have no chunks and no spans; texts shorter than ``LEAST`` bytes are one
chunk.  Rows equal in doc_id and text count as one place.  Texts are read whole.  Offsets count bytes of
UTF-8; spans begin and end on whole characters.  Columns named like the results are replaced, others carried
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.llm import textbuf as tb
from longwave.llm.durable import discard, durable
from longwave.llm.repeats import join_counted, may_repeat, repeated

MASK_BITS, LEAST, MOST = 5, 16, 128
#: Bytes that a run of duplicate chunks needs to be cut.
LEAST_SPAN = 100

_GEAR = np.random.default_rng(1618).integers(0, 1 << 16, 256, dtype=np.uint16)


def borders(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a slice of texts: start, end, text number."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        # h over 2k bytes: that of the last k, and that of the k before, shifted out by k.
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    # Chunks end after a whole character: before a byte that does not continue one.
    whole = np.ones(len(buf), bool)
    whole[:-1] = (buf[1:] & 0xC0) != 0x80
    ends = (np.flatnonzero((h >> np.uint16(16 - MASK_BITS) == 0) & whole) + 1).tolist()
    cuts: list[int] = []
    owner: list[int] = []
    k, n_ends = 0, len(ends)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        last = a
        while last < b:
            floor, roof = last + LEAST, last + MOST
            while k < n_ends and ends[k] < floor:
                k += 1
            if k < n_ends and ends[k] <= roof and ends[k] < b:
                last = ends[k]
            elif roof < b:
                last = roof
                while last < b and not whole[last - 1]:
                    last += 1
            else:
                last = b
            cuts.append(last)
            owner.append(d)
    end = np.array(cuts, np.int64)
    doc = np.array(owner, np.int64)
    start = np.empty_like(end)
    if len(end):
        start[1:] = end[:-1]
        fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
        start[fresh] = offsets[:-1][doc[fresh]]
    return start, end, doc


def _digests(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """row, two digests, first and end byte of the chunks, some texts at a time."""
    for lo, _, buf, offsets in tb.slices(batch.column("text")):
        start, end, doc = borders(buf, offsets)
        digest = tb.span_hashes(buf, start, end)
        other = tb.span_hashes(buf[::-1].copy(), len(buf) - end, len(buf) - start)
        yield doc + lo, digest.view(np.int64), other.view(np.int64), (start - offsets[doc]).astype(np.int32), (end - offsets[doc]).astype(np.int32)


def _chunks(texts: DataFrame, expected: float) -> DataFrame:
    """id, hash (of the text), and a chunk that may repeat: a, b (digest), at, to (bytes)."""
    wanted = repeated(texts, lambda batches: (a for batch in batches for _, a, _, _, _ in _digests(batch)), expected)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, a, b, at, to in _digests(batch):
                keep = may_repeat(shared.value, a)
                rows = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("hash").take(rows), *(pa.array(x[keep]) for x in (a, b, at, to))], ["id", "hash", "a", "b", "at", "to"]
                )

    return texts.mapInArrow(run, "id long, hash long, a long, b long, at int, to int")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """id, hash (of the text), byte_spans: the runs of later occurrences, as array<struct<at, to>> in bytes, in order."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = durable(_chunks(texts, size / (LEAST + (1 << MASK_BITS))))
    here = F.struct("id", "at", "hash")
    # Text-internal repeats of a chunk count too, except at its very first place.
    first = durable(chunks.groupBy("a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_counted(chunks, first, ["a", "b"], "n", here).where(~here.eqNullSafe(F.col("first")))
    sorted_runs = later.groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.struct("at", "to"))).alias("x"))
    last = "size(x) - 1"
    starts = F.expr(f"transform(filter(sequence(0, {last}), i -> i = 0 OR x[greatest(i - 1, 0)].to <> x[i].at), i -> x[i].at)")
    ends = F.expr(f"transform(filter(sequence(0, {last}), i -> i = {last} OR x[least(i + 1, {last})].at <> x[i].to), i -> x[i].to)")
    spans = durable(sorted_runs.select("id", "hash", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), b.alias("to"))).alias("byte_spans")))
    discard(chunks, first)
    return spans


def find(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, dup_bytes and byte_spans (empty where nothing repeats)."""
    kept = [c for c in docs.columns if c not in ("n_bytes", "dup_bytes", "byte_spans")]
    spans = duplicate_spans(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_hash"), size)
    met = marked.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")
    none = F.expr("cast(array() AS array<struct<at:int,to:int>>)")
    return met.select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept),
        F.col("size").alias("n_bytes"),
        F.coalesce(F.aggregate("byte_spans", F.lit(0), lambda t, s: t + s["to"] - s["at"]), F.lit(0)).alias("dup_bytes"),
        F.coalesce("byte_spans", none).alias("byte_spans"),
    )


def cut(found: DataFrame, least_span: int = LEAST_SPAN) -> DataFrame:
    """The result of :func:`find` with the spans of at least ``least_span`` bytes cut out of text."""
    long_spans = F.filter("byte_spans", lambda s: s["to"] - s["at"] >= least_span)
    shown = found.columns
    spans = next(name for k in range(len(shown) + 1) if (name := f"spans{k}") not in shown)
    found = found.withColumn(spans, long_spans)
    kept_parts = F.expr(
        f"""transform(sequence(0, size({spans})), i -> substring(
             encode(text, 'UTF-8'),
             if(i = 0, 1, {spans}[i - 1].to + 1),
             if(i = size({spans}), octet_length(text), {spans}[i].at) - if(i = 0, 0, {spans}[i - 1].to)))"""
    )
    whole = F.expr(f"size({spans}) = 0 OR text IS NULL")
    rest = F.decode(F.aggregate(kept_parts, F.lit(b""), lambda t, p: F.concat(t, p)), "UTF-8")
    return found.withColumn("text", F.when(whole, F.col("text")).otherwise(rest)).select(*(F.col(f"`{c}`") for c in shown))
