"""Long audio by ranges: headers first, then only the bytes that a chunk or a segment needs.

A file is never one row.  :func:`headers` reads a few hundred bytes of each file; :func:`chunk_ranges` cuts its time axis into chunks, and :func:`segments_of` takes
segments instead; :func:`read_ranges` opens the file at the right byte, decodes, mixes down and resamples the range with the halo
that resampling needs.  What it makes is equal, sample by sample, to what decoding the whole file would give.  Rows are bounded by the length of
a chunk or segment, tasks hold one range at a time, and no audio is shuffled: each range is read where it is used.

PCM and floating-point WAV (RIFF and RF64, for files beyond 4 GB) and PCM AIFF can be read in ranges; files of other decoders
(:func:`longwave.sources.files.decoder`) are decoded whole and then cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.operators.resampling import input_range, resample_range
from longwave.sources import files

#: Samples of a chunk (at the target rate): 2 MB of doubles.
CHUNK = 1 << 18
#: A row of samples beyond so many bytes is an error; segments are bounded by the option max_duration.
MOST_ROW_BYTES = 1 << 26

_HEAD = "source_rate long, channels long, width int, kind string, at long, frames long"
HEADER_SCHEMA = f"file string, {_HEAD}, error string"
_HEAD_NAMES = ("source_rate", "channels", "width", "kind", "at", "frames")


class Header(NamedTuple):
    source_rate: int
    channels: int
    width: int  # bytes of a sample
    kind: str  # < or >: integers of that byte order; f: floats; whole: to be decoded whole
    at: int  # first byte of the samples
    frames: int


def open_file(path: str) -> BinaryIO:
    """A file of any file system that Arrow knows, to be read from any place."""
    if path.startswith("file:") or not re.match(r"\w+:/", path):
        return open(re.sub("^file:/*", "/", path), "rb")  # noqa: SIM115
    system, name = pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_header(source: BinaryIO, length: int) -> Header | None:
    """What a WAV or AIFF file says about its samples; None for other contents."""
    start = source.read(12)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64", b"FORM") or start[8:12] not in (b"WAVE", b"AIFF"):
        return None
    wav = start[8:12] == b"WAVE"
    order = "little" if wav else "big"
    number = lambda b, signed=False: int.from_bytes(b, order, signed=signed)
    at, long_data, form = 12, None, None
    data: tuple[int, int] | None = None
    while at + 8 <= length and data is None or form is None and at + 8 <= length:
        source.seek(at)
        head = source.read(8)
        name, size = head[:4], number(head[4:])
        if name == b"ds64":
            long_data = number(source.read(24)[8:16])
        elif name == b"fmt ":
            body = source.read(min(size, 40))
            tag = number(body[:2])
            tag = number(body[24:26]) if tag == 0xFFFE and len(body) >= 26 else tag
            if tag not in (1, 3):
                raise ValueError(f"WAV format {tag} is not PCM")
            form = number(body[4:8]), number(body[2:4]), (number(body[14:16]) + 7) // 8, "f" if tag == 3 else "<"
        elif name == b"COMM":
            body = source.read(18)
            rate = round(number(body[10:18]) * 2.0 ** (number(body[8:10]) - 16383 - 63))
            form = rate, number(body[:2]), (number(body[6:8]) + 7) // 8, ">"
        elif name in (b"data", b"SSND"):
            size = long_data if long_data is not None and size == 0xFFFFFFFF else size
            skip = 0 if wav else 8
            data = at + 8 + skip, min(size, length - at - 8) - skip
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("no samples")
    rate, channels, width, kind = form
    if not rate or not channels or not width:
        raise ValueError("an empty format")
    return Header(rate, channels, width, kind, data[0], max(0, data[1]) // (channels * width))


def _cut(raw: bytes, head: Header) -> np.ndarray:
    """(channels, frames) in -1..1."""
    if head.kind == "f":
        flat = np.frombuffer(raw, f"<f{head.width}").astype(float)
    else:
        flat = files._samples(raw, head.width, head.kind)
    return flat.reshape(-1, head.channels).T


def read_frames(path: str, head: Header, first: int, last: int) -> np.ndarray:
    """(channels, frames) of a range of frames."""
    with open_file(path) as source:
        if head.kind == "whole":
            return files.decode(source.read(), dict(files._DECODERS))[0][:, first:last]
        step = head.channels * head.width
        source.seek(head.at + first * step)
        raw = source.read((last - first) * step)
    return _cut(raw[: len(raw) // step * step], head)


def headers(found: DataFrame) -> DataFrame:
    """A row for each of found (path, length): file, what its header says, error."""
    decoders = dict(files._DECODERS)

    def one(path: str, length: int) -> Header:
        with open_file(path) as source:
            start = source.read(64)
            if any(start.startswith(s) for s in decoders):
                source.seek(0)
                parts, rate = files.decode(source.read(), decoders)
                return Header(rate, len(parts), 0, "whole", 0, parts.shape[1])
            source.seek(0)
            head = read_header(source, length)
        if head is None:
            raise ValueError("neither WAV nor AIFF, nor of a registered decoder")
        return head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    rows.append({"file": path, **one(path, length)._asdict(), "error": None})
                except (ValueError, OSError, EOFError) as failed:
                    rows.append({"file": path, **dict.fromkeys(_HEAD_NAMES), "error": str(failed) or type(failed).__name__})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("source_rate", pa.int64()), ("channels", pa.int64()), ("width", pa.int32()), ("kind", pa.string()), ("at", pa.int64()), ("frames", pa.int64()), ("error", pa.string())]))

    return found.select("path", "length").mapInArrow(run, HEADER_SCHEMA)


def excerpts(heads: DataFrame, rate: int, start: float = 0.0, duration: float | None = None) -> DataFrame:
    """headers with i0 and i1, the range of samples at the target rate that is asked for; an empty one is an error."""
    whole = F.when(F.col("source_rate") == rate, F.col("frames")).otherwise(F.ceil(F.col("frames").cast("decimal(20,0)") * rate / F.col("source_rate"))).cast("long")
    first = F.lit(round(start * rate))
    last = whole if duration is None else F.least(whole, F.lit(round(start * rate) + round(duration * rate)))
    ranged = heads.withColumn("i0", first.cast("long")).withColumn("i1", last.cast("long"))
    empty = F.col("error").isNull() & (F.col("i1") <= F.col("i0"))
    return ranged.withColumn("error", F.when(empty, "no audio in the requested range").otherwise(F.col("error")))


def chunk_ranges(ranged: DataFrame, size: int = CHUNK, before: int = 0, after: int = 0) -> DataFrame:
    """A row for each chunk of excerpts: chunk, first (its first sample, from 0), lead (halo samples before it), i0 and i1 of what is to be read."""
    good = ranged.where("error IS NULL")
    cut = good.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(i1 - i0 - 1) div {size}"))))
    first = F.col("chunk") * size
    lead = F.least(first, F.lit(before).cast("long"))
    return cut.select(
        "file", *_HEAD_NAMES, "chunk", first.alias("first"), lead.alias("lead"), F.least(F.lit(size).cast("long"), F.col("i1") - F.col("i0") - first).alias("n"),
        (F.col("i0") + first - lead).alias("from"), F.least("i1", F.col("i0") + first + size + after).alias("to"),
    )


def segments_of(ranged: DataFrame, segments: DataFrame, rate: int) -> DataFrame:
    """A row for each segment (file, segment, start, end, ...; relative seconds) of excerpts, with the range to be read."""
    at = lambda c: F.bround(F.col(c) * rate).cast("long")
    met = segments.join(ranged.where("error IS NULL").select("file", *_HEAD_NAMES, "i0", "i1"), "file")
    first, last = F.col("i0") + F.greatest(F.lit(0), at("start")), F.least("i1", F.col("i0") + at("end"))
    return met.select("*", first.alias("from"), F.greatest(first, last).alias("to")).drop("i0", "i1")


def read_ranges(ranges: DataFrame, rate: int, how: str = "mix", stereo: bool = False) -> DataFrame:
    """ranges (file, header, from, to, ...) with x, the samples of the range mixed down and, if asked for, stereo; header and range go."""
    kept = [f for f in ranges.schema.fields if f.name not in (*_HEAD_NAMES, "from", "to")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", x array<double>" + ", stereo array<array<double>>" * stereo

    def one(path: str, head: Header, first: int, last: int) -> tuple[np.ndarray, np.ndarray | None]:
        if (last - first) * 8 * (1 + 2 * stereo) > MOST_ROW_BYTES:
            raise ValueError(f"{path}: a row of {last - first} samples; bound segments by max_duration")
        a, b = input_range(first, last, head.frames, head.source_rate, rate)
        parts = read_frames(path, head, a, b)
        bring = lambda x: resample_range(x, a, first, last, head.source_rate, rate)
        pair = np.stack([bring(c) for c in parts[:2]]) if stereo and len(parts) >= 2 else None
        return bring(files.downmix(parts, how)), pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*("file", *_HEAD_NAMES), "from", "to"]).to_pylist()
            for k, r in enumerate(rows):
                x, pair = one(r["file"], Header(*(r[c] for c in _HEAD_NAMES)), r["from"], r["to"])
                columns = [batch.column(f.name).slice(k, 1) for f in kept] + [pa.array([x], pa.list_(pa.float64()))]
                if stereo:
                    columns.append(pa.array([None if pair is None else list(pair)], pa.list_(pa.list_(pa.float64()))))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["x"] + ["stereo"] * stereo)

    # Rows are small before they are read: without a number of tasks, Spark would take a few partitions for all of them.
    spark = ranges.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "file", "from").mapInArrow(run, schema)


def peak_scale(ranged: DataFrame, rate: int, how: str = "mix", size: int = CHUNK) -> DataFrame:
    """(file, scale): what brings the largest sample of the excerpt to one; 1 for silence."""
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    tops = read_ranges(chunk_ranges(ranged, size), rate, how).select("file", top.alias("top")).groupBy("file").agg(F.max("top").alias("top"))
    return tops.select("file", F.when(F.col("top") > 0, 1 / F.col("top")).otherwise(F.lit(1.0)).alias("scale"))


def scaled(read: DataFrame, scale: DataFrame | None) -> DataFrame:
    """Samples times their file's factor."""
    if scale is None:
        return read
    met = read.join(scale, "file").withColumn("x", F.transform("x", lambda v: v * F.col("scale")))
    if "stereo" in read.columns:
        met = met.withColumn("stereo", F.transform("stereo", lambda c: F.transform(c, lambda v: v * F.col("scale"))))
    return met.drop("scale")


def chunked(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks (file, chunk, first, lead, n, x) of rows of single samples (file, i, x), without halo."""
    chunk = F.expr(f"i div {size}").alias("chunk")
    gathered = samples.groupBy("file", chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    return gathered.select("file", "chunk", (F.col("chunk") * size).alias("first"), F.lit(0).cast("long").alias("lead"), F.size("x").cast("long").alias("n"), "x")


def with_halo(chunks: DataFrame, before: int, after: int) -> DataFrame:
    """Chunks with the end of the chunk before and the beginning of the one after; each hands its edges on.

    A halo is taken from the neighbouring chunks alone, so chunks (but a file's last) must be at least as long as it.
    """
    kind = lambda k, x, shift: chunks.select("file", (F.col("chunk") + shift).alias("chunk"), F.struct(F.lit(k).alias("k"), x.alias("x")).alias("part"))
    own = chunks.select("file", "chunk", "first", "n", "x")
    tails = kind(0, F.slice("x", F.greatest(F.size("x") - before, F.lit(0)) + 1, F.lit(before)), 1)
    heads = kind(1, F.slice("x", F.lit(1), F.lit(after)), -1)
    edges = tails.unionAll(heads).groupBy("file", "chunk").agg(F.max_by("part.x", F.when(F.col("part.k") == 0, 1)).alias("tail"), F.max_by("part.x", F.when(F.col("part.k") == 1, 1)).alias("head"))
    none = F.array().cast("array<double>")
    tail = F.coalesce("tail", none)
    return own.join(edges, ["file", "chunk"], "left").select("file", "chunk", "first", F.size(tail).cast("long").alias("lead"), "n", F.concat(tail, "x", F.coalesce("head", none)).alias("x"))


def assemble(chunks: DataFrame, segments: DataFrame, rate: float, size: int = CHUNK) -> DataFrame:
    """Segments (file, segment, start, end, ...) with their samples x from chunks without halo: a join by (file, chunk).

    Each chunk is cut to what a segment needs of it before the parts of a segment meet.
    """
    at = lambda c: F.bround(F.col(c) * rate).cast("long")
    ranged = segments.withColumn("__a", F.greatest(F.lit(0).cast("long"), at("start"))).withColumn("__b", at("end")).where("__b > __a")
    spread = ranged.select("file", "segment", "__a", "__b", F.explode(F.sequence(F.expr(f"__a div {size}"), F.expr(f"(__b - 1) div {size}"))).alias("chunk"))
    low = F.greatest(F.col("__a") - F.col("first"), F.lit(0).cast("long"))
    part = F.slice("x", (low + 1).cast("int"), F.greatest(F.least(F.col("__b") - F.col("first"), F.col("n")) - low, F.lit(0).cast("long")).cast("int"))
    parts = chunks.join(spread, ["file", "chunk"]).select("file", "segment", F.struct("chunk", part.alias("x")).alias("p"))
    whole = parts.groupBy("file", "segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"])).alias("x"))
    return segments.join(whole, ["file", "segment"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<double>")))

