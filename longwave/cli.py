"""Command line: analyse files, compare segments, extract folders, give out plot data."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longwave.operators import features, kernels, plots, psycho, similarity, slicing, stats
from longwave.sources import config, files, sinks

#: Flags of ``analyse`` and the options that they set.
FLAGS = """
sample-rate             audio.sample_rate                    int
downmix                 audio.downmix                        str
start                   audio.start                          float
duration                audio.duration                       float
segmentation            segmentation.method                  str
window                  segmentation.window                  float
hop                     segmentation.hop                     float
onset-method            segmentation.onset_method            str
onset-frame-size        segmentation.onset_frame_size        int
onset-hop-size          segmentation.onset_hop_size          int
onset-alpha             segmentation.onset_alpha             float
onset-silence-threshold segmentation.onset_silence_threshold float
markers                 segmentation.markers_file            str
min-duration            segmentation.min_duration            float
max-duration            segmentation.max_duration            float
pad                     segmentation.pad                     float
groups                  essentia.groups                      list
frame-size              essentia.frame_size                  int
hop-size                essentia.hop_size                    int
stats                   essentia.stats                       list
psycho-metrics          psychoacoustics.metrics              list
spl-full-scale          psychoacoustics.spl_full_scale       float
field-type              psychoacoustics.field_type           str
psycho-max-duration     psychoacoustics.max_duration         float
out                     output.directory                     str
basename                output.basename                      str
precision               output.precision                     int
label-format            output.label_formats                 list
jobs                    jobs                                 int
"""
#: Switches, the option that each sets, and to what.
SWITCHES = """
normalize     audio.normalize         true
no-essentia   essentia.enabled        false
no-psycho     psychoacoustics.enabled false
no-csv        output.csv              false
no-json       output.json             false
no-labels     output.labels           false
label-markers output.label_regions    false
verbose       verbose                 true
"""
_SHORT = {"segmentation": "-s", "out": "-o", "jobs": "-j", "verbose": "-v"}
_KINDS = {"int": int, "float": float, "str": str, "list": str}


def _rows(table: str) -> list[list[str]]:
    return [line.split() for line in table.strip().splitlines()]


def _analyse_flags(a: argparse.ArgumentParser) -> None:
    a.add_argument("--list", action="store_true", help="what is available")
    a.add_argument("--config")
    a.add_argument("--dry-run", action="store_true", help="slice only")
    for flag, _, kind in _rows(FLAGS):
        a.add_argument(*filter(None, (_SHORT.get(flag), f"--{flag}")), type=_KINDS[kind], nargs="+" if kind == "list" else None)
    for flag, _, _ in _rows(SWITCHES):
        a.add_argument(*filter(None, (_SHORT.get(flag), f"--{flag}")), action="store_true")
    a.add_argument("--reaper", action="store_true")
    a.add_argument("--reaper-script", action="store_true")
    a.add_argument("-q", "--quiet", action="store_true")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="longwave")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="slice and describe audio files")
    a.add_argument("inputs", nargs="*")
    _analyse_flags(a)
    s = sub.add_parser("similarity", help="compare the segments of a table")
    s.add_argument("csv")
    s.add_argument("-f", "--features", nargs="+")
    s.add_argument("-l", "--list", action="store_true", help="the columns of the table by group")
    s.add_argument("--metric", default="euclidean", choices=similarity.METRICS)
    s.add_argument("--method", default="hierarchical", choices=("hierarchical", "kmeans"))
    s.add_argument("--linkage", default="ward", choices=similarity.LINKAGES)
    s.add_argument("-k", type=int)
    s.add_argument("--k-range", nargs=2, type=int, default=(2, 10))
    s.add_argument("--neighbours", type=int, default=3)
    s.add_argument("--seed", type=int, default=0)
    s.add_argument("--label-format", nargs="+", default=[])
    s.add_argument("--reaper", action="store_true")
    s.add_argument("--reaper-script", action="store_true")
    s.add_argument("--no-merge-labels", action="store_true")
    s.add_argument("--save-matrix", action="store_true", help="write the square of distances as a table")
    s.add_argument("-o", "--out", default="analysis")
    s.add_argument("-q", "--quiet", action="store_true")
    v = sub.add_parser("visualise", help="data of an interactive plot of a table")
    v.add_argument("csv")
    v.add_argument("-d", "--descriptors", nargs="+")
    v.add_argument("-l", "--list", action="store_true")
    v.add_argument("--overlay", action="store_true")
    v.add_argument("--smooth", type=int, default=1)
    v.add_argument("-o", "--out", default="analysis")
    b = sub.add_parser("batch", help="analyse a folder's new files, then extract and roll up all of them")
    b.add_argument("folder")
    b.add_argument("--force", action="store_true", help="analyse all files anew")
    _analyse_flags(b)
    r = sub.add_parser("rollup", help="one row per file from segment tables")
    r.add_argument("folder")
    r.add_argument("-o", "--out", default="analysis")
    return top


def configure(args: argparse.Namespace) -> config.AnalysisConfig:
    """Defaults, then the file, then flags."""
    c = config.load(args.config) if args.config else config.AnalysisConfig()
    given = lambda flag: getattr(args, flag.replace("-", "_"))

    def put(name: str, value) -> None:
        section, _, key = name.rpartition(".")
        setattr(getattr(c, section) if section else c, key, value)

    for flag, name, _ in _rows(FLAGS):
        if given(flag) is not None:
            put(name, given(flag))
    for flag, name, value in _rows(SWITCHES):
        if given(flag):
            put(name, json.loads(value))
    if args.max_duration == 0:
        c.segmentation.max_duration = None
    if args.markers and not args.segmentation:
        c.segmentation.method = "markers"
    c.output.label_formats = list(dict.fromkeys([*c.output.label_formats, *["reaper"] * args.reaper, *["reaper_script"] * args.reaper_script]))
    return c


def _available() -> None:
    listed = {"segmentation": slicing.strategies(), "groups": kernels.known_groups(), "metrics": psycho.metrics(), "statistics": (*stats.STATS, *stats.VECTOR_STATS), "labels": sinks.label_formats()}
    print("\n".join(f"{k}: {', '.join(v)}" for k, v in listed.items()))


def _distinct_names(paths: Sequence[str]) -> None:
    """Outputs are called by their inputs' stems: two inputs of one stem would write the same files."""
    seen: dict[str, str] = {}
    for path in paths:
        name = os.path.basename(path)
        stem = os.path.splitext(name)[0] or name
        if seen.setdefault(stem, path) != path:
            raise ValueError(f"{seen[stem]} and {path} would both be written as {stem}")


def _analyse(spark: SparkSession, paths: Sequence[str], c: config.AnalysisConfig, dry_run: bool, say) -> int:
    from longwave import analysis

    _distinct_names(paths)
    frames = analysis.analyse(spark, list(paths), c)
    try:
        if dry_run:
            slicing.duration_stats(frames.segments).show(truncate=False)
            return 0
        out, o = c.output.directory, c.output
        table = frames.table.cache()
        if o.csv:
            names = sorted(r["name"] for r in table.select("name").distinct().collect())
            for path in sinks.segments_csv(sinks.wide_form(table, names), out, o.precision, o.basename):
                say(path)
        if o.json:
            documents = sinks.analysis_documents(frames.pieces, table, frames.summary, frames.whole, c.as_dict(), o.precision)
            for path in sinks.write_files(documents, out, ".analysis.json", basename=o.basename):
                say(path)
        if o.labels:
            for name in o.label_formats:
                lines, suffix = sinks.label_lines(sinks.markers(frames.segments), name, o.label_regions)
                for path in sinks.write_files(lines, out, suffix, basename=o.basename):
                    say(path)
        if c.verbose:
            frames.failures.show(truncate=False)
        table.unpersist()
        bad = frames.pieces.where("error IS NOT NULL").select("file", "error")
        for r in bad.limit(1000).collect():
            print(f"{r['file']}: {r['error']}", file=sys.stderr)
        return int(not bad.isEmpty())
    finally:
        frames.release()


def _segment_table(spark: SparkSession, path: str) -> DataFrame:
    return files.read_segment_table(spark, path).withColumn("segment", F.col("segment").cast("long"))


def _groups(wide: DataFrame) -> None:
    names = features.descriptor_columns([c for c in wide.columns if c != "file"])
    for group in dict.fromkeys(n.split(".")[0] for n in names):
        print(f"{group}: {', '.join(n for n in names if n.split('.')[0] == group)}")


def _similarity(spark: SparkSession, args: argparse.Namespace, fail) -> int:
    wide = _segment_table(spark, args.csv)
    # Outputs are called like the tables, without what both have at the end.
    wide = wide.withColumn("file", F.regexp_replace("file", r"\.segments\.csv$", ".csv"))
    if args.list:
        _groups(wide)
        return 0
    names = features.glob_select(features.descriptor_columns([c for c in wide.columns if c != "file"]), args.features, features.DEFAULT_FEATURES)
    if not names:
        fail("no column fits the features")
    z = features.standardise(files.long_form(wide.select("file", *features.INDEX_COLUMNS, *(f"`{n}`" for n in names))))
    rows = z.groupBy("file", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "z"))), lambda s: s["z"]).alias("v")).cache()
    if rows.isEmpty():
        fail("no usable feature")
    try:
        done = similarity.analyse(rows, args.metric, args.method, args.linkage, args.k, tuple(args.k_range), args.seed).cache()
    except ValueError as wrong:
        fail(str(wrong))
    index = wide.select("file", *features.INDEX_COLUMNS).cache()
    table = sinks.clusters_table(done, index)
    sinks.write_files(sinks.table_lines(table, ["segment"], dict.fromkeys(("start", "end", "duration", "silhouette", "pc1", "pc2"), 4)), args.out, ".clusters.csv", "\r\n")
    near = similarity.neighbours(rows, args.neighbours, args.metric)
    closest = sinks.neighbours_table(near, index.select("file", "segment", "start"))
    sinks.write_files(sinks.table_lines(closest, ["segment", "rank"], {"start": 4, "neighbour_start": 4, "distance": 5}), args.out, ".neighbours.csv", "\r\n")
    if args.save_matrix:
        similarity.square(similarity.pairwise(rows, args.metric), rows).write.mode("overwrite").parquet(f"{args.out}/distances")
    clustered = done.select("file", "segment", "cluster", "silhouette").join(index, ["file", "segment"])
    runs = clustered if args.no_merge_labels else features.merge_runs(clustered)
    marks = runs.select("file", F.row_number().over(features.by_start()).cast("long").alias("ord"), "start", "end", F.concat(F.lit("cluster "), F.col("cluster").cast("string")).alias("name"), F.lit(None).cast("string").alias("color"))
    for name in dict.fromkeys([*args.label_format, *["reaper"] * args.reaper, *["reaper_script"] * args.reaper_script]):
        lines, suffix = sinks.label_lines(marks, name)
        sinks.write_files(lines, args.out, f".clusters{suffix}")
    if not args.quiet:
        print("\n".join(plots.report([r.asDict() for r in stats.cluster_report(clustered).collect()])))
    return 0


def _visualise(spark: SparkSession, args: argparse.Namespace, fail) -> int:
    wide = _segment_table(spark, args.csv)
    if args.list:
        _groups(wide)
        return 0
    known = features.descriptor_columns([c for c in wide.columns if c != "file"])
    names = features.glob_select(known, args.descriptors)
    if not names:
        fail("no column fits the descriptors")
    if args.overlay and len(names) > 8:
        fail("at most 8 series can be laid over each other")
    for n in names if args.smooth > 1 else ():
        part = features.rolling_median(wide.select("file", "segment", "start", F.col(f"`{n}`").cast("double").alias("value")), args.smooth, order="start", into="smooth")
        wide = wide.drop(n).join(part.select("file", "segment", F.col("smooth").alias(n)), ["file", "segment"])
    if args.overlay:
        for n in names:
            part = features.overlay(wide.select("file", "segment", F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")), ("file", "name"), 8)
            wide = wide.drop(n).join(part.select("file", "segment", F.col("z").alias(n)), ["file", "segment"])
    shown = wide.select("file", *features.INDEX_COLUMNS, *(F.col(f"`{n}`") for n in names)).cache()
    for suffix, as_page in ((".plot.json", False), (".plot.html", True)):
        for path in sinks.write_files(sinks.plot_documents(shown, names, list(features.DEFAULT_VIEW), as_page), args.out, suffix):
            print(path)
    shown.unpersist()
    return 0


def _six_digits(column: str) -> Column:
    """Six significant digits without zeros at the end; nothing where there is no value."""
    text = F.regexp_replace(F.format_string("%.6g", column), r"(\.[0-9]*?)0+(?=e|$)", "$1")
    return F.when(F.col(column).isNotNull(), F.regexp_replace(text, r"\.(?=e|$)", ""))


def _extract(spark: SparkSession, folder: str, out: str) -> int:
    """The tables of a batch: chosen columns of all segments, and one row per file."""
    wide = _segment_table(spark, f"{folder}/*.segments.csv")
    wide = wide.withColumn("file", sinks.stem(F.regexp_replace("file", r"\.segments\.csv$", "")))
    chosen = features.project(wide, features.BATCH_COLUMNS)
    chosen.write.mode("overwrite").csv(f"{out}/all_segments", header=True)
    plain = {short: short.replace(".", "_") for _, short in features.BATCH_COLUMNS}
    rows = chosen.select("file", "start", "end", "duration", *(F.col(f"`{k}`").alias(v) for k, v in plain.items()))
    rolled = stats.file_rollup(rows, list(plain.values()))
    shown = rolled.select("file", "n_segments", F.format_string("%.4f", "duration").alias("duration"), *(_six_digits(v).alias(k) for k, v in plain.items()))
    shown.coalesce(1).write.mode("overwrite").csv(f"{out}/all_files", header=True)
    return 0


def _batch(spark: SparkSession, args: argparse.Namespace, c: config.AnalysisConfig, fail, say) -> int:
    out = c.output.directory
    c.output.csv = True
    inputs = files.scan_folder(spark, args.folder).select("path", "modificationTime", sinks.stem(F.col("path")).alias("key"))
    if inputs.isEmpty():
        fail("no audio in the folder")
    made = spark.read.format("binaryFile").option("pathGlobFilter", "*.segments.csv")
    try:
        outputs = made.load(out).select(sinks.stem(F.regexp_replace("path", r"\.segments\.csv$", "")).alias("key"), "modificationTime", "length")
        outputs.isEmpty()
    except Exception as missing:  # noqa: BLE001  Spark raises an analysis error if the folder is not there yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        outputs = spark.createDataFrame([], "key string, modificationTime timestamp, length long")
    double = inputs.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).where("n > 1").first()
    if double:
        fail(f"{double['a']} and {double['b']} would both be written as {double['key']}")
    new = [r["path"] for r in files.stale_inputs(inputs, outputs, args.force).select("path").orderBy("path").collect()]
    say(f"{len(new)} of {inputs.count()} files to analyse")
    failed = _analyse(spark, new, c, False, say) if new else 0
    return max(failed, _extract(spark, out, out))


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    say = (lambda *_: None) if getattr(args, "quiet", False) else print
    if args.command in ("analyse", "batch") and args.list:
        _available()
        return 0
    if args.command in ("analyse", "batch"):
        try:
            c = configure(args)
            config.validate(c)
        except (ValueError, OSError) as wrong:
            parser.error(str(wrong))
    if args.command == "analyse":
        paths = files.expand_inputs(args.inputs)
        if not paths:
            parser.error("no inputs")
    builder = SparkSession.builder
    if getattr(args, "jobs", None):
        builder = builder.master(f"local[{args.jobs}]")
    spark = builder.getOrCreate()
    if args.command == "analyse":
        try:
            return _analyse(spark, paths, c, args.dry_run, say)
        except ValueError as wrong:
            parser.error(str(wrong))
    if args.command == "batch":
        return _batch(spark, args, c, parser.error, say)
    if args.command == "similarity":
        return _similarity(spark, args, parser.error)
    if args.command == "visualise":
        return _visualise(spark, args, parser.error)
    return _extract(spark, args.folder, args.out)


if __name__ == "__main__":
    sys.exit(main())
