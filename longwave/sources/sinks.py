"""Writers: segment tables, label tracks, region lists, analysis documents, cluster tables.

Files are made by the executors: a table of lines is dealt by stem, each stem is written as one part, and the driver only
renames parts.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longwave.functions.scalars import csv_field, format_number
from longwave.operators.features import order_columns
from longwave.sources.page import page

Lines = Callable[[DataFrame], DataFrame]
_LABELS: dict[str, tuple[Lines, str]] = {}


def register(name: str, suffix: str) -> Callable[[Lines], Lines]:
    """Make a label format available: markers (file, ord, start, end, name, color) -> (file, ord, line)."""

    def keep(lines: Lines) -> Lines:
        _LABELS[name] = (lines, suffix)
        return lines

    return keep


def label_formats() -> list[str]:
    return sorted(_LABELS)


def label_format(name: str) -> tuple[Lines, str]:
    if name not in _LABELS:
        raise ValueError(f"unknown label format {name!r}; known: {', '.join(sorted(_LABELS))}")
    return _LABELS[name]


def markers(segments: DataFrame, offset: float = 0.0) -> DataFrame:
    """Segments as markers; a segment without a label is named by its number."""
    name = F.format_string("%04d", F.col("segment"))
    if "label" in segments.columns:
        name = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(name)
    return segments.select("file", F.col("segment").alias("ord"), (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"), name.alias("name"), F.lit(None).cast("string").alias("color"))


@register("audacity", ".labels.txt")
def audacity(marks: DataFrame) -> DataFrame:
    return marks.select("file", "ord", F.format_string("%.6f\t%.6f\t%s", "start", "end", "name").alias("line"))


@register("reaper", ".regions.csv")
def reaper(marks: DataFrame, regions: bool = True) -> DataFrame:
    """#,Name,Start,End,Length,Color; markers instead of regions leave End blank and Length 0."""
    number = F.concat(F.lit("R" if regions else "M"), F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("string"))
    six = lambda c: F.format_string("%.6f", c)
    end, length = (six(F.col("end")), six(F.col("end") - F.col("start"))) if regions else (F.lit(""), F.lit("0"))
    colour = F.coalesce(F.replace(F.col("color"), F.lit("#"), F.lit("")), F.lit(""))
    return marks.select("file", "ord", F.concat_ws(",", number, csv_field(F.col("name")), six(F.col("start")), end, length, colour).alias("line"))


#: Fixed value: the header of a region list.
REAPER_HEADER = "#,Name,Start,End,Length,Color"


@register("reaper_script", ".regions.lua")
def reaper_script(marks: DataFrame) -> DataFrame:
    """One table row of a region script per marker."""
    from longwave.functions.scalars import channel, lua_string

    rgb = [channel(F.col("color"), k).cast("string") for k in range(3)]
    cells = F.concat_ws(", ", F.format_string("%.6f", "start"), F.format_string("%.6f", "end"), F.concat(F.lit('"'), lua_string(F.col("name")), F.lit('"')), *(F.coalesce(c, F.lit("128")) for c in rgb))
    return marks.select("file", "ord", F.concat(F.lit("  {"), cells, F.lit("},")).alias("line"))


#: The calls of the editor's scripting interface that add regions.
SCRIPT_HEAD = "local OFFSET = {offset:.6f}\nlocal CLEAR_EXISTING = {clear}\nlocal regions = {{"
SCRIPT_TAIL = (
    "}\n"
    "reaper.Undo_BeginBlock()\n"
    "if CLEAR_EXISTING then for i = reaper.CountProjectMarkers(0) - 1, 0, -1 do reaper.DeleteProjectMarkerByIndex(0, i) end end\n"
    "for _, r in ipairs(regions) do\n"
    "  reaper.AddProjectMarker2(0, true, r[1] + OFFSET, r[2] + OFFSET, r[3], -1, reaper.ColorToNative(r[4], r[5], r[6]) | 0x1000000)\n"
    "end\nreaper.UpdateArrange()\nreaper.Undo_EndBlock('Import regions', -1)"
)


def script(rows: list[str], offset: float = 0.0, clear: bool = False) -> str:
    """A script that adds the rows as coloured regions to the open project."""
    return "\n".join([SCRIPT_HEAD.format(offset=offset, clear=str(clear).lower()), *rows, SCRIPT_TAIL]) + "\n"


def label_lines(marks: DataFrame, name: str, regions: bool = True) -> tuple[DataFrame, str]:
    """The lines of a label file, with the head and tail that its format has, and the suffix of its name."""
    made, suffix = label_format(name)
    lines = made(marks, regions) if made is reaper else made(marks)
    head = {"reaper": REAPER_HEADER, "reaper_script": SCRIPT_HEAD.format(offset=0.0, clear="false")}.get(name)
    tail = SCRIPT_TAIL if name == "reaper_script" else None
    return framed(lines, head, tail), suffix


def framed(lines: DataFrame, head: str | None, tail: str | None = None) -> DataFrame:
    """lines (file, ord, line) with a first and a last line for each file."""
    files = lines.groupBy("file").agg((F.min("ord") - 1).alias("first"), (F.max("ord") + 1).alias("last"))
    for text, place in ((head, "first"), (tail, "last")):
        if text is not None:
            lines = lines.unionByName(files.select("file", F.col(place).alias("ord"), F.lit(text).alias("line")))
    return lines


def stem(file: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def write_files(lines: DataFrame, folder: str, suffix: str, line_end: str = "\n", basename: str | None = None) -> list[str]:
    """One text file per file of lines (file, ord, line) as <folder>/<stem><suffix>; the paths.

    With a basename the file is called by that; several files then need their stems too.  Files of one stem are an error, since one would
    be written over the other.
    """
    spark = lines.sparkSession
    named = lines.withColumn("stem", stem(F.col("file")))
    double = named.groupBy("stem").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a < b").first()
    if double:
        raise ValueError(f"{double['a']} and {double['b']} would both be written as {double['stem']}{suffix}")
    made = f"{folder}/.parts{suffix}"
    value = F.concat("line", F.lit("\r")) if line_end == "\r\n" else F.col("line")
    named.repartition("stem").sortWithinPartitions("stem", "ord").select("stem", value.alias("value")).write.partitionBy("stem").mode("overwrite").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(made).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [d.getPath() for d in system.listStatus(path(made)) if d.isDirectory()]
    out = []
    for at in found:
        name = unquote(at.getName().split("=", 1)[1])
        name = name if basename is None else basename if len(found) == 1 else f"{basename}.{name}"
        (part,) = [f.getPath() for f in system.listStatus(at) if f.getPath().getName().startswith("part-")]
        target = path(f"{folder}/{name}{suffix}")
        system.delete(target, False)
        system.rename(part, target)
        out.append(f"{folder}/{name}{suffix}")
    system.delete(path(made), True)
    return sorted(out)


def wide_form(table: DataFrame, names: list[str]) -> DataFrame:
    """The wide segment table of the given names; absent values are null."""
    keys = ["file", "segment", "start", "end", "duration"]
    return table.groupBy(*keys).pivot("name", names).agg(F.first("value")).select("file", *(F.col(f"`{c}`") for c in order_columns([*keys[1:], *names])))


def segment_lines(wide: DataFrame, precision: int | None = 6) -> DataFrame:
    """The wide table as (file, ord, line) of comma-separated texts: empty for absent, nan, inf and -inf as such; a header for each file."""
    columns = [c for c in wide.columns if c != "file"]
    cell = lambda c: csv_field(format_number(F.col(f"`{c}`").cast("double"), 17 if precision is None else precision))
    lines = wide.select("file", F.col("segment").cast("long").alias("ord"), F.concat_ws(",", *(cell(c) for c in columns)).alias("line"))
    return framed(lines, ",".join(f'"{c}"' if '"' in c or "," in c else c for c in columns))


def segments_csv(wide: DataFrame, folder: str, precision: int | None = 6, basename: str | None = None) -> list[str]:
    """<stem>.segments.csv for each file, with CRLF line ends."""
    return write_files(segment_lines(wide, precision), folder, ".segments.csv", "\r\n", basename)


def rounded(value, precision: int | None):
    """Finite floats of nested lists and mappings, rounded; as they are without a precision."""
    if precision is None:
        return value
    if isinstance(value, dict):
        return {k: rounded(v, precision) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [rounded(v, precision) for v in value]
    return round(value, precision) if isinstance(value, float) and math.isfinite(value) else value


def analysis_json(metadata: dict, config: dict, columns: list[str], summary: dict, segments: list[dict], precision: int | None = 6) -> str:
    return json.dumps(rounded({"metadata": metadata, "config": config, "columns": columns, "summary": summary, "segments": segments}, precision), indent=2, allow_nan=True)


def analysis_documents(pieces: DataFrame, table: DataFrame, summary: DataFrame, whole: DataFrame, config: dict, precision: int | None = 6) -> DataFrame:
    """(file, ord, line): the analysis of each file as one JSON text; a file's own rows are all that a task holds."""
    meta = pieces.where("error IS NULL")
    number = lambda c: F.col(c).cast("double")
    none = F.lit(None).cast("double")
    about = [c for c in ("sample_rate", "source_rate", "channels", "offset", "duration") if c in meta.columns]
    described = meta.select("file", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), number(c).alias("value")) for c in about))).alias("p"))
    row = lambda df, kind, segment, start, end, name, value: df.select("file", F.lit(kind).alias("kind"), segment.alias("segment"), start.alias("start"), end.alias("end"), name.alias("name"), value.alias("value"))
    nothing = F.lit(None).cast("long")
    rows = row(described, "metadata", nothing, none, none, F.col("p.name"), F.col("p.value"))
    rows = rows.unionAll(row(whole, "metadata", nothing, none, none, F.col("name"), number("value")))
    for column in ("wmean", "wstdev"):
        rows = rows.unionAll(row(summary, "summary", nothing, none, none, F.concat("name", F.lit(f".{column}")), number(column)))
    rows = rows.unionAll(row(table, "segment", F.col("segment").cast("long"), number("start"), number("end"), F.col("name"), number("value")))

    def document(part: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: part[part["kind"] == kind]
        pairs = lambda rows: dict(sorted(zip(rows["name"], map(float, rows["value"]), strict=True)))
        segments = [
            {"segment": float(k), "start": float(g["start"].iloc[0]), "end": float(g["end"].iloc[0]), "duration": float(g["end"].iloc[0] - g["start"].iloc[0])} | pairs(g)
            for k, g in of("segment").groupby("segment", sort=True)
        ]
        file = part["file"].iloc[0]
        columns = order_columns(dict.fromkeys(c for s in segments for c in s))
        text = analysis_json({"file": file} | pairs(of("metadata")), config, columns, pairs(of("summary")), segments, precision)
        return pd.DataFrame({"file": [file], "ord": [0], "line": [text]})

    return rows.groupBy("file").applyInPandas(document, "file string, ord long, line string")


def plot_payload(wide: list[dict], names: list[str], initial: list[str]) -> str:
    """The values of an interactive plot as JSON; columns without finite values are left out, others' are null."""
    finite = lambda v: isinstance(v, (int, float)) and math.isfinite(v)
    kept = [n for n in names if any(finite(r.get(n)) for r in wide)]
    shown = [n for n in initial if n in kept] or kept[:6]
    values = {n: [round(r[n], 6) if finite(r.get(n)) else None for r in wide] for n in kept}
    ranges = {}
    for n in kept:
        known = [v for v in values[n] if v is not None]
        low, high = (min(known), max(known)) if min(known) < max(known) else (min(known) - 0.5, max(known) + 0.5)
        ranges[n] = [round(low - 0.06 * (high - low), 6), round(high + 0.06 * (high - low), 6)]
    starts, ends = [r["start"] for r in wide], [r["end"] for r in wide]
    short = {n: n.split(".", 1)[1] if n.count(".") > 1 else n for n in kept}
    groups = {n: n.split(".")[0] for n in kept}
    payload = {"names": kept, "groups": groups, "short": short, "initial": shown, "values": values, "range": ranges, "starts": starts, "ends": ends, "t0": min(starts, default=0.0), "t1": max(ends, default=0.0)}
    return json.dumps(payload, allow_nan=False)


def plot_documents(wide: DataFrame, names: list[str], initial: list[str], as_page: bool = False) -> DataFrame:
    """(file, ord, line): the plot payload of each file, or the page that shows it."""

    plain = [f"c{k}" for k in range(len(names))]  # grouped functions take no dotted names
    wide = wide.select("file", "start", "end", *(F.col(f"`{n}`").cast("double").alias(p) for n, p in zip(names, plain, strict=True)))

    def document(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.rename(columns=dict(zip(plain, names, strict=True))).sort_values("start").to_dict("records")
        file, text = part["file"].iloc[0], plot_payload(rows, names, initial)
        return pd.DataFrame({"file": [file], "ord": [0], "line": [page(text, file.rsplit("/", 1)[-1]) if as_page else text]})

    return wide.groupBy("file").applyInPandas(document, "file string, ord long, line string")


def table_lines(table: DataFrame, order: list[str], decimals: dict[str, int]) -> DataFrame:
    """(file, ord, line) of a table with a header for each file, in the order of whole-number columns; columns with decimals are rounded to them."""
    names = [c for c in table.columns if c != "file"]
    cell = lambda c: csv_field(format_number(F.col(c).cast("double"), decimals[c])) if c in decimals else F.coalesce(F.col(c).cast("string"), F.lit(""))
    # At most so many rows share all but the last of the ordering columns.
    place = functools.reduce(lambda a, b: a * (1 << 20) + b, (F.col(c).cast("long") for c in order))
    return framed(table.select("file", place.alias("ord"), F.concat_ws(",", *map(cell, names)).alias("line")), ",".join(names))


def clusters_table(analysed: DataFrame, segments: DataFrame) -> DataFrame:
    four = lambda c: F.bround(c, 4).alias(c)
    return analysed.join(segments, ["file", "segment"]).select("file", "segment", *(four(c) for c in ("start", "end", "duration")), "cluster", *(four(c) for c in ("silhouette", "pc1", "pc2")))


def neighbours_table(near: DataFrame, segments: DataFrame) -> DataFrame:
    own = segments.select("file", "segment", F.bround("start", 4).alias("start"))
    other = segments.select("file", F.col("segment").alias("neighbour"), F.bround("start", 4).alias("neighbour_start"))
    return near.join(own, ["file", "segment"]).join(other, ["file", "neighbour"]).select("file", "segment", "start", "rank", "neighbour", "neighbour_start", F.bround("distance", 5).alias("distance"))
