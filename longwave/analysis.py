"""The whole analysis as one plan: read headers, slice, read and describe segments, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longwave.operators import kernels, loudness, psycho, slicing, stats
from longwave.sources import files, ranges
from longwave.sources.config import AnalysisConfig, validate


@dataclass
class AnalysisFrames:
    """Frames of one run; everything is lazy and keyed by file."""

    pieces: DataFrame  # file, sample_rate, source_rate, channels, offset, duration, error
    segments: DataFrame  # file, segment, start, end, duration (absolute seconds)
    table: DataFrame  # file, segment, start, end, duration, name, value
    summary: DataFrame  # file, name, wmean, wstdev
    whole: DataFrame  # file, name, value of whole-file globals
    failures: DataFrame  # file, name, n: groups and metrics that failed, and in how many segments
    heads: DataFrame  # the files' headers, kept by the executors until release()

    def release(self) -> None:
        self.heads.unpersist()


def slice_files(audio: DataFrame, c: AnalysisConfig, marks: DataFrame | None = None, chunks: Callable[[int, int], DataFrame] | None = None) -> DataFrame:
    """Segments (relative seconds) of files (file, duration) by the configured method.

    ``chunks`` reads the files in chunks with a halo of so many samples before and after; without it, the files have their samples in x.
    """
    s, rate = c.segmentation, c.audio.sample_rate
    chunks = chunks or (lambda before, after: kernels.whole_chunks(audio))
    totals = audio.select("file", F.col("duration").alias("total"))
    grid = (s.window, s.hop, s.drop_last_partial)
    options = {}
    if s.method == "fixed":
        options = dict(zip(("window", "hop", "drop_last_partial"), grid, strict=True))
    elif s.method == "onset":
        onsets = kernels.detect_onsets(chunks(*kernels.onset_halo(s.onset_frame_size, s.onset_hop_size)), rate, s.onset_method, s.onset_frame_size, s.onset_hop_size, s.onset_alpha, s.onset_delay, s.onset_silence_threshold)
        options = {"onsets": onsets, "include_lead": s.onset_include_lead}
    elif s.method == "sbic":
        options = {"chunks": chunks(0, s.sbic_frame_size), "rate": rate, "size": s.sbic_frame_size, "hop": s.sbic_hop_size, "coefficients": s.sbic_number_coefficients, "window": s.window, "grid_hop": s.hop, "drop_last_partial": s.drop_last_partial}
        options |= {"cpw": s.sbic_cpw, "size1": s.sbic_size1, "inc1": s.sbic_inc1, "size2": s.sbic_size2, "inc2": s.sbic_inc2, "least": s.sbic_min_length}
    elif s.method == "markers":
        if marks is None:
            raise ValueError("method markers needs marks")
        options = {"marks": files.markers_for(marks, totals), "offset": c.audio.start}
    return slicing.constrain(slicing.strategy(s.method)(totals, **options), totals, s.pad, s.min_duration, s.max_duration)


def kernel_settings(c: AnalysisConfig) -> kernels.Settings:
    known = kernels.Settings.__dataclass_fields__
    values = {k: v for k, v in c.essentia.as_dict().items() if k in known}
    return kernels.Settings(**values | {"energy_bands": tuple(map(tuple, values["energy_bands"]))})


def analyse(spark: SparkSession, paths: list[str], c: AnalysisConfig | None = None, marks: DataFrame | None = None) -> AnalysisFrames:
    """Plan the analysis of audio files; a file that fails has an error and no segments.

    Headers are read first.  Segments, and chunks where a whole file matters, are then read straight from their ranges of bytes, each where it is
    used; no row holds a file, and no audio is shuffled.
    """
    c = c or AnalysisConfig()
    validate(c)
    a, d, q = c.audio, c.essentia, c.psychoacoustics
    found = spark.read.format("binaryFile").load(paths).select("path", "length")
    heads = ranges.excerpts(ranges.headers(found), a.sample_rate, a.start, a.duration).persist()
    length = (F.col("i1") - F.col("i0")) / F.lit(a.sample_rate)
    good = F.col("error").isNull()
    shown = lambda column: F.when(good, F.col(column))
    pieces = heads.select(
        "file", F.lit(a.sample_rate).alias("sample_rate"), shown("source_rate").alias("source_rate"), shown("channels").alias("channels"), F.lit(float(a.start)).alias("offset"), F.when(good, length).alias("duration"), "error"
    )
    scale = ranges.peak_scale(heads, a.sample_rate, a.downmix) if a.normalize else None

    def chunks(before: int = 0, after: int = 0, stereo: bool = False) -> DataFrame:
        return ranges.scaled(ranges.read_ranges(ranges.chunk_ranges(heads, before=before, after=after), a.sample_rate, a.downmix, stereo), scale)

    if marks is None and c.segmentation.method == "markers":
        marks = files.read_markers(spark, c.segmentation.markers_file)
    relative = slice_files(pieces.where(good).select("file", "duration"), c, marks, chunks)
    arrays = ranges.scaled(ranges.read_ranges(ranges.segments_of(heads, relative, a.sample_rate), a.sample_rate, a.downmix), scale)
    parts = []
    if d.enabled:
        parts.append(kernels.describe_segments(arrays, c.audio.sample_rate, d.groups, d.stats, d.frame_size, d.hop_size, kernel_settings(c)))
    if q.enabled:
        resampled = kernels.resample(arrays.select("file", "segment", "x"), c.audio.sample_rate, q.sample_rate)
        parts.append(psycho.describe(resampled, q.sample_rate, q.metrics, q.spl_full_scale, q.min_duration, q.max_duration, q.percentiles, q.field_type))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    offset = F.lit(float(c.audio.start))
    segments = relative.withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset)
    failed = F.startswith(F.col("name"), F.lit("failed."))
    table = segments.join(values.where(~failed), ["file", "segment"])
    failures = values.where(failed).groupBy("file", F.substring("name", 8, 1000).alias("name")).agg(F.count("*").alias("n"))
    whole = loudness.file_globals(chunks(stereo=a.keep_stereo), a.sample_rate)
    return AnalysisFrames(pieces, segments, table, stats.weighted_summary(table), whole, failures, heads)
