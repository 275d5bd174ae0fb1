"""Readers: input expansion, PCM audio, marker files, segment tables, and manifests for incremental runs."""

from __future__ import annotations

import csv
import functools
import glob
import io
import os
import re
import wave
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: suffixes of audio files.
AUDIO_SUFFIXES = (".wav", ".aif", ".aiff", ".flac", ".ogg", ".mp3", ".m4a")

#: Markers that every file may get: a few MB.
MOST_MARKS = 100_000


def expand_inputs(inputs: Iterable[str]) -> list[str]:
    """Folders give their audio files, patterns whatever they match, other paths themselves; first ones stay."""
    out: list[str] = []
    for item in inputs:
        if os.path.isdir(item):
            found = [os.path.join(item, n) for n in sorted(os.listdir(item)) if n.lower().endswith(AUDIO_SUFFIXES)]
        elif glob.has_magic(item):
            found = sorted(glob.glob(item))
        else:
            found = [item]
        out += [p for p in found if p not in out]
    return out


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files directly in a folder of any file system: path, modificationTime, length, content."""
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in AUDIO_SUFFIXES) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)


Decoder = Callable[[bytes], tuple[np.ndarray, int]]
_DECODERS: dict[bytes, Decoder] = {}


def decoder(start: bytes) -> Callable[[Decoder], Decoder]:
    """Make a decoder of contents that begin so available, as for compressed audio: (channels, samples) in -1..1 and the rate."""

    def keep(made: Decoder) -> Decoder:
        _DECODERS[start] = made
        return made

    return keep


def decode(content: bytes, decoders: dict[bytes, Decoder]) -> tuple[np.ndarray, int]:
    for start, made in decoders.items():
        if content.startswith(start):
            return made(content)
    return decode_pcm(content)


def decode_pcm(content: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) in -1..1 and the rate of a PCM WAV or AIFF file."""
    if content[:4] == b"FORM":
        return _decode_aiff(content)
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    return _samples(raw, width, "<").reshape(-1, channels).T, rate


def _samples(raw: bytes, width: int, order: str) -> np.ndarray:
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if order == "<" else np.frombuffer(raw, np.int8) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        b = b if order == "<" else b[:, ::-1]
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    return np.frombuffer(raw, f"{order}i{width}") / float(1 << (8 * width - 1))


def _decode_aiff(content: bytes) -> tuple[np.ndarray, int]:
    at, channels, width, rate, raw = 12, 1, 2, 0, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "big")
        body = content[at + 8 : at + 8 + size]
        if name == b"COMM":
            channels, width = int.from_bytes(body[:2], "big"), (int.from_bytes(body[6:8], "big") + 7) // 8
            power = int.from_bytes(body[8:10], "big") - 16383 - 63
            rate = round(int.from_bytes(body[10:18], "big") * 2.0**power)
        elif name == b"SSND":
            raw = body[8:]
        at += 8 + size + size % 2
    raw = raw[: len(raw) // (channels * width) * channels * width]
    return _samples(raw, width, ">").reshape(-1, channels).T, rate


def downmix(channels: np.ndarray, how: str = "mix") -> np.ndarray:
    if how == "mix":
        return channels.mean(axis=0)
    return channels[0 if how == "left" or len(channels) < 2 else 1]


def read_audio(files: DataFrame, rate: int = 44100, how: str = "mix", start: float = 0.0, duration: float | None = None, normalize: bool = False, keep_stereo: bool = True) -> DataFrame:
    """Decoded files (path, content): file, sample_rate, source_rate, channels, offset, duration, x, stereo, error.

    A file that cannot be decoded, or has no samples in the asked range, has an error and null samples.
    """
    from longwave.operators.resampling import resample_array

    decoders = dict(_DECODERS)

    def one(content: bytes) -> dict:
        parts, source = decode(content, decoders)
        count = len(parts)
        mono = resample_array(downmix(parts, how), source, rate)
        pair = [resample_array(c, source, rate) for c in parts[:2]] if keep_stereo and count >= 2 else None
        first = round(start * rate)
        last = len(mono) if duration is None else first + round(duration * rate)
        mono = mono[first:last]
        if not len(mono):
            raise ValueError("no audio in the requested range")
        top = float(np.abs(mono).max()) if normalize else 0.0
        scale = 1 / top if top > 0 else 1.0
        if pair is not None:
            size = min(map(len, pair))
            pair = [(c[:size][first:last] * scale).tolist() for c in pair]
        return {"source_rate": source, "channels": count, "duration": len(mono) / rate, "x": (mono * scale).tolist(), "stereo": pair, "error": None}

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    made = one(content)
                except (ValueError, EOFError, wave.Error) as failed:
                    made = {"source_rate": None, "channels": None, "duration": None, "x": None, "stereo": None, "error": str(failed) or type(failed).__name__}
                yield pd.DataFrame([{"file": path, "sample_rate": rate, "offset": float(start)} | made])[_AUDIO_COLUMNS].astype({"source_rate": "Int64", "channels": "Int64"})

    return files.select("path", "content").mapInPandas(run, _AUDIO_SCHEMA)


_AUDIO_COLUMNS = ["file", "sample_rate", "source_rate", "channels", "offset", "duration", "x", "stereo", "error"]
_AUDIO_SCHEMA = "file string, sample_rate int, source_rate long, channels long, offset double, duration double, x array<double>, stereo array<array<double>>, error string"


def parse_markers(lines: DataFrame) -> DataFrame:
    """(file, ord, start, end, label) of marker lines (file, ord, line).

    The delimiter of a file is a tab if any line holds one, else a comma.  Cells are stripped and empty ones
    dropped before they are counted; comments and rows whose first cell is no number are skipped; a second
    cell that is no number leaves the end open (NaN).
    """
    kinds = lines.groupBy("file").agg(F.max(F.contains(F.col("line"), F.lit("\t"))).alias("tabs"))
    cells = F.when(F.col("tabs"), F.split("line", "\t")).otherwise(F.split("line", ","))
    cells = F.filter(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), lambda c: c != "")
    read = lines.join(kinds, "file").withColumn("c", cells).where("NOT coalesce(startswith(get(c, 0), '#'), true)")
    read = read.withColumn("start", F.expr("try_cast(get(c, 0) AS double)")).where("start IS NOT NULL")
    end = F.coalesce(F.expr("try_cast(get(c, 1) AS double)"), F.lit(float("nan")))
    return read.select("file", "ord", "start", end.alias("end"), F.expr("get(c, 2)").alias("label"))


def markers_for(marks: DataFrame, files: DataFrame) -> DataFrame:
    """The marks of one marker file for every one of files (file); without a usable mark it is an error."""
    count = marks.limit(MOST_MARKS + 1).count()
    if not count:
        raise ValueError("no usable marker")
    if count > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} markers for every file")
    # What every file gets is the whole marker file, which is a list made by hand, and of checked size.
    one = F.lit(1).alias("one")
    each = files.select("file", one).join(F.broadcast(marks.drop("file").select("*", one)), "one")
    return each.drop("one")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))
    return parse_markers(lines)


def table_headers(found: DataFrame) -> DataFrame:
    """(file, header) of tables (path): the first line, read alone."""
    from longwave.sources.ranges import open_file

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for rows in batches:
            lines = []
            for path in rows["path"]:
                with open_file(path) as source:
                    head = b""
                    while b"\n" not in head and (more := source.read(1 << 16)):
                        head += more
                lines.append(head.split(b"\n")[0].decode("utf-8-sig").rstrip("\r"))
            yield pd.DataFrame({"file": rows["path"], "header": lines})

    return found.select("path").mapInPandas(run, "file string, header string")


def read_segment_table(spark: SparkSession, path: str) -> DataFrame:
    """Wide tables with segment, start and end, and the name of each (file, unless they have a column of that name); duration is derived if it is not there.

    Each table is read by its own header: those of one header in one scan, all together by name.  A column that a table lacks is null in
    its rows, as is a cell that is no number.  The driver has each different header once, with the paths of its tables.
    """
    found = spark.read.format("binaryFile").load(path).select("path")
    layouts = table_headers(found).groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    parts = []
    for layout in layouts:
        names = next(csv.reader([layout["header"]]), [])
        missing = [c for c in ("segment", "start", "end") if c not in names]
        if missing:
            raise ValueError(f"not a segment table: no column {', '.join(missing)} in {layout['files'][0]}")
        if len(set(names)) < len(names):
            raise ValueError(f"a column twice in {layout['files'][0]}")
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        # One path each: a name may hold what a pattern would give a meaning.
        table = spark.read.csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in layout["files"]], schema=schema, header=True, enforceSchema=True)
        quoted = lambda n: F.col(f"`{n.replace('`', '``')}`")
        columns = [quoted(n) if n == "file" else F.expr(f"try_cast(`{n.replace('`', '``')}` AS double)").alias(n) for n in names]
        own = [] if "file" in names else [F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("file")]
        duration = [] if "duration" in names else [(F.expr("try_cast(`end` AS double)") - F.expr("try_cast(`start` AS double)")).alias("duration")]
        parts.append(table.select(*own, *columns, *duration))
    if not parts:
        raise ValueError(f"no table at {path}")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def long_form(wide: DataFrame, index: Sequence[str] = ("file", "segment", "start", "end", "duration")) -> DataFrame:
    """Index columns, name and value; null cells have no row."""
    keep = [c for c in index if c in wide.columns]
    names = [c for c in wide.columns if c not in keep]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names)))
    return wide.select(*keep, pairs.alias("p")).select(*keep, "p.name", "p.value").where("value IS NOT NULL")


def stale_inputs(inputs: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Inputs (path, modificationTime, key) without an output (key, modificationTime, length) that is newer and not empty."""
    if force:
        return inputs
    done = outputs.where("length > 0").select("key", F.col("modificationTime").alias("__made"))
    return inputs.join(done, (inputs["key"] == done["key"]) & (F.col("__made") > F.col("modificationTime")), "left_anti")
