"""The registered queries and, where SQL can express them, their equivalents on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longwave.functions import scalars
from longwave.operators import features, kernels, loudness, plots, psycho, recursion, resampling, similarity, slicing, spectral, stats
from longwave.sources import adapters as src
from longwave.sources import ranges, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- shared parts of the SQL ----------------------------------------------------------------------

EV = """ev AS (
  SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1e6 AS t, value AS x FROM events
), tot AS (SELECT file, max(t) AS total FROM ev GROUP BY file)"""
UB = """ub0 AS (
  SELECT user_id::VARCHAR AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 / 1e3 AS s,
    (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 / 1e3 AS e FROM events
), ub AS (SELECT * FROM ub0 WHERE e > s), ut AS (SELECT file, max(e) AS total FROM ub GROUP BY file)"""


def grid_sql(window: float, hop: float, drop: bool, name: str = "g") -> str:
    more = f"k * {hop}::DOUBLE + {window}::DOUBLE <= total" if drop else f"k * {hop}::DOUBLE < total AND (k - 1) * {hop}::DOUBLE + {window}::DOUBLE < total"
    return f"""{name} AS (
  SELECT file, k AS segment, k * {hop}::DOUBLE AS s, least(k * {hop}::DOUBLE + {window}::DOUBLE, total) AS e
  FROM (SELECT file, total, unnest(range(0, ceil(total / {hop}::DOUBLE)::BIGINT + 1)) AS k FROM tot WHERE total > 0) WHERE k = 0 OR ({more})
)"""


SEG = f"{EV}, {grid_sql(86400, 86400, True, 'seg')}"
SLICE = f"""{SEG}, sl AS (
  SELECT ev.file, segment, s, e, e - s AS d, i, x FROM ev JOIN seg ON ev.file = seg.file AND i >= greatest(0, round_even(s * 0.01, 0)) AND i < round_even(e * 0.01, 0)
)"""
SV = f"""{SLICE}, sa AS (
  SELECT file, segment, s, e, d, avg(x) AS mean, stddev_pop(x) AS stdev, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) AS max FROM sl GROUP BY ALL
), sv AS (SELECT file, segment, s, e, d, 'events.value.' || stat AS name, value FROM (UNPIVOT sa ON mean, stdev, median, min, max INTO NAME stat VALUE value))"""
EM = "em AS (SELECT vec_id AS segment, list_transform(embedding, lambda x: x::DOUBLE) AS v, label + 1 AS cluster FROM embeddings)"
EL = f"{EM}, el AS (SELECT segment, cluster, 'f' || lpad(k::VARCHAR, 2, '0') AS name, v[k + 1] AS value FROM (SELECT *, unnest(range(0, 64)) AS k FROM em))"
EZ = f"{EL}, mo AS (SELECT name, avg(value) AS m, stddev_pop(value) AS sd FROM el GROUP BY name), ez AS (SELECT segment, cluster, el.name, (value - m) / sd AS z FROM el JOIN mo USING (name))"
SP = f"{EM}, sp AS (SELECT segment, list_transform(v, lambda x: abs(x)) AS m FROM em), sl AS (SELECT segment, k, m[k + 1] AS a, k * 22050::DOUBLE / 63 AS f FROM (SELECT *, unnest(range(0, 64)) AS k FROM sp))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(q: Query) -> Query:
        QUERIES[name] = q
        if sql:
            ORACLE_SQL[name] = sql
        return q

    return keep


def r(column: str | F.Column, name: str | None = None, digits: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits).alias(name or column)


def bounds_out(b: DataFrame) -> DataFrame:
    return b.select("file", F.col("ord").cast("long").alias("segment"), r("start"), r("end"))


def _bounds_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT file, segment::BIGINT AS segment, round(s, 6) AS start, round(e, 6) AS \"end\" FROM {source}"


def _between_sql(ctes: str, edges: str) -> str:
    """Bounds from edges (file, t)."""
    return f"""WITH {ctes}, ed AS (SELECT DISTINCT file, round(t, 6) AS t FROM ({edges})),
p AS (SELECT file, t AS s, lead(t) OVER (PARTITION BY file ORDER BY t) AS e FROM ed)
SELECT file, (row_number() OVER (PARTITION BY file ORDER BY s) - 1)::BIGINT AS segment, round(s, 6) AS start, round(e, 6) AS "end" FROM p WHERE e > s"""


# ---- slicing --------------------------------------------------------------------------------------


@query("fixed_chop", _bounds_sql(SEG, "seg"))
def fixed_chop(spark, d):
    return bounds_out(slicing.fixed(src.event_totals(spark, d), src.DAY))


@query("fixed_chop_overlap", _bounds_sql(f"{EV}, {grid_sql(86400, 43200, True)}", "g"))
def fixed_chop_overlap(spark, d):
    return bounds_out(slicing.fixed(src.event_totals(spark, d), src.DAY, src.DAY / 2))


@query("fixed_keep_partial", _bounds_sql(f"{EV}, {grid_sql(100000, 100000, False)}", "g"))
def fixed_keep_partial(spark, d):
    return bounds_out(slicing.fixed(src.event_totals(spark, d), 100000.0, drop_last_partial=False))


@query(
    "fixed_chop_decimal_hop",
    """WITH RECURSIVE tot AS (SELECT n_nationkey::VARCHAR AS file, 10 + 0.7::DOUBLE * n_nationkey AS total FROM nation),
g AS (SELECT file, total, 0::BIGINT AS k, 0::DOUBLE AS s FROM tot UNION ALL
      SELECT file, total, k + 1, s + 0.3::DOUBLE FROM g WHERE s + 0.3::DOUBLE + 1.8::DOUBLE <= total)
SELECT file, k AS segment, s AS start, least(s + 1.8::DOUBLE, total) AS "end" FROM g""",
)
def fixed_chop_decimal_hop(spark, d):
    totals = src.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), (F.lit(10) + F.lit(0.7) * F.col("n_nationkey")).alias("total"))
    return slicing.fixed(totals, 1.8, 0.3).select("file", F.col("ord").alias("segment"), "start", "end")


@query(
    "onset_edges",
    _between_sql(
        f"{EV}, lim AS (SELECT file, avg(x) + 2 * stddev_pop(x) AS lim FROM ev GROUP BY file)",
        """SELECT ev.file, t FROM ev JOIN lim USING (file) JOIN tot USING (file) WHERE x > lim AND t > 0 AND t < total
UNION ALL SELECT file, total FROM tot UNION ALL SELECT file, 0 FROM tot""",
    ),
)
def onset_edges(spark, d):
    ev = src.event_samples(spark, d)
    limit = ev.groupBy("file").agg((F.avg("x") + 2 * F.stddev_pop("x")).alias("limit"))
    return bounds_out(slicing.onset(src.event_totals(spark, d), ev.join(limit, "file").where("x > limit").select("file", "t")))


@query(
    "marker_points",
    _between_sql(
        f"{UB}, e AS (SELECT user_id::VARCHAR AS file, event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 - 3600 AS t FROM events)",
        """SELECT e.file, t FROM e JOIN ut USING (file) WHERE event_type = 'error' AND t > 0 AND t < total
UNION ALL SELECT file, total FROM ut WHERE file IN (SELECT file FROM e WHERE event_type = 'error')
UNION ALL SELECT file, 0 FROM ut WHERE file IN (SELECT file FROM e WHERE event_type = 'error')""",
    ),
)
def marker_points(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = src.table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), "event_type", ((us - F.min(us).over(Window.partitionBy("user_id"))) / F.lit(1e6)).alias("start"))
    marks = e.where("event_type = 'error'").select("file", "start", F.lit(float("nan")).alias("end"))
    return bounds_out(slicing.markers(src.user_totals(spark, d), marks, 3600.0))


@query(
    "marker_intervals",
    f"""WITH {UB}, c AS (
  SELECT file, least(greatest(s - 3600, 0), total) AS s, least(greatest(CASE WHEN ord % 7 = 0 THEN s ELSE e END - 3600, 0), total) AS e FROM ub JOIN ut USING (file)
), k AS (SELECT * FROM c WHERE e > s)
SELECT file, (row_number() OVER (PARTITION BY file ORDER BY s, e) - 1)::BIGINT AS segment, round(s, 6) AS start, round(e, 6) AS "end" FROM k""",
)
def marker_intervals(spark, d):
    marks = src.user_bounds(spark, d).select("file", "start", F.when(F.col("ord") % 7 != 0, F.col("end")).alias("end"))
    return bounds_out(slicing.markers(src.user_totals(spark, d), marks, 3600.0))


PAD = "pd AS (SELECT file, ord, greatest(0, s - 600) AS s, least(total, e + 600) AS e FROM ub JOIN ut USING (file))"


def _merge_sql(source: str, least: int, name: str) -> str:
    return f"""{name}a AS (SELECT *, sum(CASE WHEN rn = 1 OR NOT (e - s < {least}) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ord) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM {source})),
{name}b AS (SELECT file, g, arg_min(s, ord) AS s, arg_max(e, ord) AS e, max(ord) AS ord FROM {name}a GROUP BY file, g),
{name}c AS (SELECT *, CASE WHEN g = 1 AND max(g) OVER (PARTITION BY file) > 1 AND e - s < {least} THEN 2 ELSE g END AS h FROM {name}b),
{name} AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY max(ord)) - 1 AS ord, arg_min(s, ord) AS s, arg_max(e, ord) AS e FROM {name}c GROUP BY file, h)"""


def _split_sql(source: str, most: int, name: str) -> str:
    return f"""{name}a AS (SELECT *, greatest(ceil((e - s) / {most}), 1)::BIGINT AS parts, (e - s) / greatest(ceil((e - s) / {most}), 1) AS step FROM {source}),
{name}b AS (SELECT *, unnest(range(0, parts)) AS k FROM {name}a),
{name} AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY ord, k) - 1 AS ord, s + k * step AS s, CASE WHEN k = parts - 1 THEN e ELSE s + (k + 1) * step END AS e FROM {name}b)"""


def _numbered_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT file, ord::BIGINT AS segment, round(s, 6) AS start, round(e, 6) AS \"end\" FROM {source}"


@query("pad_segments", _numbered_sql(f"{UB}, {PAD}", "pd"))
def pad_segments(spark, d):
    return bounds_out(slicing.pad(src.user_bounds(spark, d), src.user_totals(spark, d), 600.0))


@query("merge_short", _numbered_sql(f"{UB}, {_merge_sql('ub', 10000, 'mg')}", "mg"))
def merge_short(spark, d):
    return bounds_out(slicing.merge_short(src.user_bounds(spark, d), 10000.0))


@query("split_long", _numbered_sql(f"{UB}, {_split_sql('ub', 60000, 'sp')}", "sp"))
def split_long(spark, d):
    return bounds_out(slicing.split_long(src.user_bounds(spark, d), 60000.0))


DRIVER = f"{UB}, {PAD}, {_merge_sql('pd', 10000, 'mg')}, {_split_sql('mg', 60000, 'sp')}"


def _driver(spark, d):
    return slicing.constrain(src.user_bounds(spark, d), src.user_totals(spark, d), 600.0, 10000.0, 60000.0)


@query("segment_driver", f"WITH {DRIVER} SELECT file, ord::BIGINT AS segment, round(s, 6) AS start, round(e, 6) AS \"end\", round(round(e, 6) - round(s, 6), 6) AS duration FROM sp")
def segment_driver(spark, d):
    return _driver(spark, d)


@query(
    "slicing_stats",
    f"""WITH {DRIVER}, q AS (SELECT file, round(e, 6) - round(s, 6) AS d FROM sp)
SELECT file, count(*) AS n, round(avg(d), 7) AS mean, round(quantile_cont(d, 0.5), 7) AS median, round(min(d), 7) AS min, round(max(d), 7) AS max FROM q GROUP BY file""",
)
def slicing_stats(spark, d):
    s = slicing.duration_stats(_driver(spark, d))
    return s.select("file", "n", *(r(c, digits=7) for c in ("mean", "median", "min", "max")))


@query("sample_slice", f"WITH {SLICE} SELECT file, segment::BIGINT AS segment, count(*) AS n_samples, min(i)::BIGINT AS first_i, max(i)::BIGINT AS last_i FROM sl GROUP BY ALL")
def sample_slice(spark, d):
    met = slicing.sample_slices(src.event_samples(spark, d), src.daily_segments(spark, d), src.EVENT_RATE)
    return met.groupBy("file", "segment").agg(F.count("*").alias("n_samples"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query(
    "inner_frames",
    f"""WITH {SLICE}, a AS (SELECT file, segment, list(x ORDER BY i) AS xs FROM sl GROUP BY ALL),
f AS (SELECT file, segment, unnest(range(0, ceil(len(xs) / 8.0)::BIGINT)) AS frame, xs FROM a)
SELECT file, segment::BIGINT AS segment, count(*) AS n_frames, round(sum(list_sum(xs[frame * 8 + 1 : frame * 8 + 16])), 4) AS total, round(max(list_sum(xs[frame * 8 + 1 : frame * 8 + 16])), 4) AS largest FROM f GROUP BY ALL""",
)
def inner_frames(spark, d):
    arrays = src.daily_values(spark, d).groupBy("file", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda s: s["value"]).alias("x"))
    framed = slicing.inner_frames(arrays, 16, 8).withColumn("s", scalars.array_sum(F.col("x")))
    return framed.groupBy("file", "segment").agg(F.count("*").alias("n_frames"), r(F.sum("s"), "total", 4), r(F.max("s"), "largest", 4))


@query(
    "excerpt_normalise",
    f"WITH {EV}, x AS (SELECT file, i, x FROM ev WHERE i >= 100 AND i < 400) SELECT file, i::BIGINT AS i, round(x / max(abs(x)) OVER (PARTITION BY file), 6) AS x FROM x",
)
def excerpt_normalise(spark, d):
    part = src.event_samples(spark, d).where("i >= 100 AND i < 400")
    top = F.max(F.abs("x")).over(Window.partitionBy("file"))
    return part.select("file", "i", r(F.when(top > 0, F.col("x") / top).otherwise(F.col("x")), "x"))


# ---- statistics and rollups -----------------------------------------------------------------------


def _long_stats(aggregates: dict[str, str], source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT file, segment::BIGINT AS segment, 'events.value.{k}' AS name, round({k}_, 6) AS value FROM a" for k in aggregates)
    return f"WITH {source}, a AS (SELECT file, segment, {', '.join(f'{v} AS {k}_' for k, v in aggregates.items())} FROM dd GROUP BY ALL) {parts}"


DIFFS = f"""{SLICE}, d1 AS (SELECT file, segment, i, x, x - lag(x) OVER (PARTITION BY file, segment ORDER BY i) AS u FROM sl),
dd AS (SELECT *, u - lag(u) OVER (PARTITION BY file, segment ORDER BY i) AS w FROM d1)"""


@query("frame_stats", _long_stats({"mean": "avg(x)", "stdev": "stddev_pop(x)", "median": "quantile_cont(x, 0.5)", "min": "min(x)", "max": "max(x)", "var": "var_pop(x)"}, DIFFS))
def frame_stats(spark, d):
    return stats.frame_stats(src.daily_values(spark, d), ("mean", "stdev", "median", "min", "max", "var")).withColumn("value", r("value"))


@query("frame_derivative_stats", _long_stats({"dmean": "avg(abs(u))", "dvar": "var_pop(u)", "dmean2": "avg(abs(w))", "dvar2": "var_pop(w)"}, DIFFS))
def frame_derivative_stats(spark, d):
    return stats.frame_stats(src.daily_values(spark, d), ("dmean", "dvar", "dmean2", "dvar2")).withColumn("value", r("value"))


_VECTORS = "vv AS (SELECT cluster, segment, unnest(range(0, 8)) AS i, v FROM em), vc AS (SELECT cluster, segment, i, v[i + 1] AS value FROM vv)"


@query("frame_covariance", f"WITH {EM}, {_VECTORS} SELECT a.cluster, a.i::INT AS i, b.i::INT AS j, round(covar_pop(a.value, b.value), 6) AS cov FROM vc a JOIN vc b ON a.cluster = b.cluster AND a.segment = b.segment GROUP BY a.cluster, a.i, b.i")
def frame_covariance(spark, d):
    """Covariances of the first components of the vectors of a cluster, as frames."""
    parts = src.embedding_rows(spark, d).select("cluster", F.col("segment").alias("frame"), F.posexplode(F.slice("v", 1, 8)).alias("i", "value"))
    frames = parts.select("cluster", "frame", F.concat(F.lit("v."), F.col("i").cast("string")).alias("name"), "value")
    return stats.vector_covariance(frames, ("cluster",)).select("cluster", "i", "j", r("cov"))


@query(
    "weighted_summary",
    f"""WITH {SV}, m AS (SELECT file, name, sum(value * greatest(d, 1e-9)) / sum(greatest(d, 1e-9)) AS wm FROM sv GROUP BY ALL)
SELECT sv.file, sv.name, round(max(wm), 6) AS wmean, round(sqrt(sum(greatest(d, 1e-9) * (value - wm) ** 2) / sum(greatest(d, 1e-9))), 6) AS wstdev FROM sv JOIN m ON sv.file = m.file AND sv.name = m.name GROUP BY sv.file, sv.name""",
)
def weighted_summary(spark, d):
    return stats.weighted_summary(src.segment_table(spark, d)).select("file", "name", r("wmean"), r("wstdev"))


@query(
    "piece_durations",
    f"WITH {DRIVER}, q AS (SELECT file, round(round(e, 6) - round(s, 6), 6) AS d FROM sp) SELECT file, count(*) AS n_segments, round(sum(greatest(d, 1e-9)), 4) AS total_duration, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS stdev, round(min(d), 4) AS min, round(max(d), 4) AS max FROM q GROUP BY file",
)
def piece_durations(spark, d):
    return stats.piece_durations(_driver(spark, d)).select("file", "n_segments", *(r(c, digits=4) for c in ("total_duration", "mean", "stdev", "min", "max")))


@query(
    "file_rollup",
    """WITH t AS (SELECT o_orderpriority AS file, o_orderkey AS k, l_quantity AS w, l_extendedprice AS price, l_discount AS disc FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT file, count(*) AS n_segments, (max(k + w) - min(k))::DOUBLE AS duration, round(sum(price * w) / sum(w), 4) AS price, round(sum(disc * w) / sum(w), 6) AS disc FROM t GROUP BY file""",
)
def file_rollup(spark, d):
    o, line = src.table(spark, d, "orders"), src.table(spark, d, "lineitem")
    t = o.join(line, o["o_orderkey"] == line["l_orderkey"]).select(
        F.col("o_orderpriority").alias("file"), F.col("o_orderkey").cast("double").alias("start"), (F.col("o_orderkey") + F.col("l_quantity")).alias("end"),
        F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
    )
    return stats.file_rollup(t, ["price", "disc"], "weight").select("file", "n_segments", "duration", r("price", digits=4), r("disc"))


@query(
    "batch_projection",
    f"WITH {SV} SELECT file, segment::DOUBLE AS segment, round(max(value) FILTER (name = 'events.value.mean'), 6) AS level, round(max(value) FILTER (name = 'events.value.max'), 6) AS peak, NULL::DOUBLE AS missing FROM sv GROUP BY file, segment",
)
def batch_projection(spark, d):
    wide = sinks.wide_form(src.segment_table(spark, d), ["events.value.max", "events.value.mean"])
    p = features.project(wide, [("events.value.mean", "level"), ("events.value.max", "peak"), ("events.value.none", "missing")])
    return p.select("file", F.col("segment").cast("double").alias("segment"), r("level"), r("peak"), "missing")


@query(
    "union_files",
    f"WITH {EV} SELECT file, i::BIGINT AS i, CASE WHEN file IN ('error', 'purchase', 'view') THEN round(x, 6) END AS a, CASE WHEN file NOT IN ('error', 'purchase', 'view') THEN round(t, 6) END AS b FROM ev",
)
def union_files(spark, d):
    """Tables of some files with one column and of the others with another one."""
    ev = src.event_samples(spark, d)
    first = F.col("file").isin("error", "purchase", "view")
    return ev.where(first).select("file", "i", r("x", "a")).unionByName(ev.where(~first).select("file", "i", r("t", "b")), allowMissingColumns=True)


@query(
    "column_ranges",
    f"""WITH {SV}, c AS (SELECT name, min(value) AS lo, max(value) AS hi FROM sv GROUP BY name),
w AS (SELECT name, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM c)
SELECT name, round(lo - 0.06 * (hi - lo), 6) AS lo, round(hi + 0.06 * (hi - lo), 6) AS hi FROM w""",
)
def column_ranges(spark, d):
    return stats.column_ranges(src.segment_table(spark, d)).select("name", r("lo"), r("hi"))


#: Descriptor names of several groups that follow from the data: one for each event type, and one for each nation.
_NAMED = """nm AS (SELECT DISTINCT 'psycho.' || event_type || '.mean' AS name FROM events
UNION SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 'dynamics.' WHEN n_nationkey % 3 = 1 THEN 'zeta.' ELSE 'alpha.' END || lower(replace(n_name, ' ', '_')) || '.max' FROM nation)"""


def _named(spark, d) -> DataFrame:
    group = F.when(F.col("n_nationkey") % 3 == 0, "dynamics.").when(F.col("n_nationkey") % 3 == 1, "zeta.").otherwise("alpha.")
    nations = src.table(spark, d, "nation").select(F.concat(group, F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(".max")).alias("name"))
    events = src.table(spark, d, "events").select(F.concat(F.lit("psycho."), "event_type", F.lit(".mean")).alias("name"))
    return events.unionByName(nations).distinct().select(F.lit("all").alias("file"), F.lit(0).cast("long").alias("segment"), "name", F.lit(1.0).alias("value"))


@query(
    "group_listing",
    f"""WITH {_NAMED}, g AS (SELECT split_part(name, '.', 1) AS "group", count(*) AS n FROM nm GROUP BY 1)
SELECT "group", n, row_number() OVER (ORDER BY CASE "group" WHEN 'dynamics' THEN 0 WHEN 'psycho' THEN 1 ELSE 2 END, "group") AS ordinal FROM g""",
)
def group_listing(spark, d):
    return features.group_listing(_named(spark, d))


@query(
    "glob_select",
    f"""WITH {_NAMED}, p AS (SELECT name, CASE WHEN name = 'zeta.brazil.max' THEN 0 WHEN name GLOB 'psycho.*' THEN 2 WHEN name GLOB '*.[!c-m]*.max' THEN 3 END AS place FROM nm)
SELECT (row_number() OVER (ORDER BY place, name) - 1)::BIGINT AS ordinal, name FROM p WHERE place IS NOT NULL""",
)
def glob_select(spark, d):
    return features.select_names(_named(spark, d), ["zeta.brazil.max", "nothing.*", "psycho.*", "*.[!c-m]*.max"])


@query("usable_features", f"WITH {SV}, n AS (SELECT file, count(DISTINCT segment) AS n FROM sv GROUP BY file) SELECT sv.file, name FROM sv JOIN n USING (file) GROUP BY sv.file, name, n HAVING count(*) = n AND max(value) > min(value)")
def usable_features(spark, d):
    t = src.segment_table(spark, d)
    constant = t.where("endswith(name, 'mean')").withColumn("name", F.lit("test.constant")).withColumn("value", F.lit(1.0))
    missing = t.where("endswith(name, 'mean') AND segment > 0").withColumn("name", F.lit("test.missing"))
    broken = t.where("endswith(name, 'mean')").withColumn("name", F.lit("test.nan")).withColumn("value", F.when(F.col("segment") == 0, float("nan")).otherwise(F.col("value")))
    return features.usable_features(t.unionByName(constant).unionByName(missing).unionByName(broken))


@query(
    "standardise",
    f"""WITH {SV}, q AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi FROM sv WINDOW w AS (PARTITION BY file, name))
SELECT file, segment::BIGINT AS segment, name, round((value - m) / sd, 6) AS z FROM q WHERE hi > lo""",
)
def standardise(spark, d):
    return features.standardise(src.segment_table(spark, d)).select("file", "segment", "name", r("z"))


@query(
    "rolling_median",
    f"""WITH {EV} SELECT file, i::BIGINT AS i, round(quantile_cont(x, 0.5) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS med5,
round(quantile_cont(x, 0.5) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS med4 FROM ev""",
)
def rolling_median(spark, d):
    ev = src.event_samples(spark, d).withColumnRenamed("x", "value")
    both = features.rolling_median(features.rolling_median(ev, 5, into="med5"), 4, into="med4")
    return both.select("file", "i", r("med5"), r("med4"))


@query("overlay_zscore", f"WITH {EV} SELECT file, i::BIGINT AS i, round((x - avg(x) OVER (PARTITION BY file)) / stddev_pop(x) OVER (PARTITION BY file), 6) AS z FROM ev")
def overlay_zscore(spark, d):
    return features.overlay(src.event_samples(spark, d).withColumnRenamed("x", "value")).select("file", "i", r("z"))


@query("step_trace", f"WITH {SV} SELECT file, segment::BIGINT AS segment, pos::INT AS pos, round(CASE WHEN pos = 0 THEN s ELSE e END, 6) AS t, round(value, 6) AS v FROM (SELECT *, unnest([0, 1]) AS pos FROM sv WHERE name = 'events.value.mean')")
def step_trace(spark, d):
    t = features.step_trace(src.segment_table(spark, d).where("name = 'events.value.mean'"))
    return t.select("file", "segment", "pos", r("t"), r("v"))


@query(
    "asof_segment",
    f"WITH {SEG}, q AS (SELECT file, t FROM ev WHERE x > 100) SELECT q.file, round(q.t, 6) AS t, coalesce(seg.segment, 0)::BIGINT AS segment FROM q ASOF LEFT JOIN seg ON q.file = seg.file AND q.t >= seg.s",
)
def asof_segment(spark, d):
    times = src.event_samples(spark, d).where("x > 100").select("file", "t")
    return features.asof_segment(times, src.daily_segments(spark, d)).select("file", r("t"), "segment")


# ---- similarity -----------------------------------------------------------------------------------

_PAIR = "list_transform(range(1, 65), lambda i: a.v[i] {op} b.v[i])"
_STANDARD = f"""{EL}, mo AS (SELECT name, avg(value) AS m, stddev_pop(value) AS sd FROM el GROUP BY name HAVING max(value) > min(value)),
st AS (SELECT segment, list((value - m) / sd ORDER BY el.name) AS v FROM el JOIN mo ON el.name = mo.name GROUP BY segment)"""
_EUCLID = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) ** 2)))"
_COSINE = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


def _distance_sql(expression: str, source: str = "st") -> str:
    return f"WITH {_STANDARD}, ce AS (SELECT segment, list_transform(v, lambda x: x - list_avg(v)) AS v FROM st) SELECT a.segment AS i, b.segment AS j, round({expression}, 6) AS d FROM {source} a JOIN {source} b ON a.segment < b.segment"


def _standard_rows(spark, d) -> DataFrame:
    z = features.standardise(src.embedding_features(spark, d), F.broadcast)  # one file, a name for each component
    return z.groupBy("file", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "z"))), lambda s: s["z"]).alias("v"))


def _distances(metric: str) -> Query:
    return lambda spark, d: similarity.pairwise(_standard_rows(spark, d), metric).select("i", "j", r("d"))


# Each under a second name, which it had when the first ones compared fewer rows.
for _metric, _expression, _source in (
    ("euclidean", _EUCLID, "st"), ("cityblock", "list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i])))", "st"), ("cosine", _COSINE, "st"), ("correlation", _COSINE, "ce"),
):
    for _name in (f"dist_{_metric}", f"dist_{_metric}_whole"):
        query(_name, _distance_sql(_expression, _source))(_distances(_metric))


_MAP_SQL = f"WITH {_STANDARD}, q AS (SELECT a.segment AS i, b.segment AS j, {_EUCLID} AS d FROM st a JOIN st b ON a.segment < b.segment) SELECT i, j, round(1 - d / max(d) OVER (), 6) AS s FROM q"


@query("similarity_map", _MAP_SQL)
@query("similarity_map_whole", _MAP_SQL)
def similarity_map(spark, d):
    return similarity.similarity_map(_standard_rows(spark, d)).select("i", "j", r("s"))


@query("distance_matrix", f"WITH {EM} SELECT a.segment AS i, b.segment AS j, round({_EUCLID}, 6) AS d FROM em a JOIN em b ON true")
def distance_matrix(spark, d):
    rows = src.embedding_rows(spark, d)
    return similarity.square(similarity.pairwise(rows), rows).select("i", "j", r("d"))


_ALL_PAIRS = f"{EM}, pr AS (SELECT a.segment AS i, b.segment AS j, a.cluster AS ci, b.cluster AS cj, {_EUCLID} AS d FROM em a JOIN em b ON a.segment <> b.segment)"
_SILHOUETTE = f"""{_ALL_PAIRS}, mn AS (SELECT i, ci, cj, avg(d) AS m FROM pr GROUP BY ALL),
ab AS (SELECT i, ci, max(m) FILTER (ci = cj) AS a, min(m) FILTER (ci <> cj) AS b FROM mn GROUP BY ALL),
si AS (SELECT i AS segment, ci AS cluster, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


def _silhouette(spark, d):
    rows = src.embedding_rows(spark, d)
    return similarity.silhouette(rows, rows.select("file", "segment", "cluster"))


@query("silhouette", f"WITH {_SILHOUETTE} SELECT segment, cluster, round(s, 6) AS s FROM si")
def silhouette(spark, d):
    return _silhouette(spark, d).select("segment", "cluster", r("s"))


@query(
    "neighbours",
    f"WITH {_ALL_PAIRS}, k AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pr) SELECT i AS segment, rank::INT AS rank, j AS neighbour, round(d, 6) AS distance FROM k WHERE rank <= 3",
)
def neighbours(spark, d):
    near = similarity.neighbours(src.embedding_rows(spark, d), 3)
    return near.select("segment", "rank", "neighbour", r("distance"))


@query(
    "cluster_profiles",
    f"""WITH {EZ}, p AS (SELECT cluster, name AS feature, avg(z) AS mz FROM ez GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(mz) DESC, feature) AS rank FROM p)
SELECT cluster, rank::INT AS rank, feature, round(mz, 6) AS mean_z FROM k WHERE rank <= 6""",
)
def cluster_profiles(spark, d):
    clusters = src.embedding_rows(spark, d).select("file", "segment", "cluster")
    p = similarity.profiles(features.standardise(src.embedding_features(spark, d)), clusters)
    return p.select("cluster", "rank", "feature", r("mean_z"))


@query(
    "cluster_report",
    f"""WITH {_SILHOUETTE}, c AS (SELECT cluster, count(*) AS n, sum(1 + segment % 5)::DOUBLE AS seconds, avg(s) AS ms FROM si GROUP BY cluster)
SELECT cluster, n, seconds, round(100 * seconds / sum(seconds) OVER (), 6) AS share, round(ms, 6) AS mean_s FROM c""",
)
def cluster_report(spark, d):
    s = _silhouette(spark, d).select("cluster", F.col("s").alias("silhouette"), (1 + F.col("segment") % 5).cast("double").alias("duration"))
    return stats.cluster_report(s).select("cluster", "n", "seconds", r("share"), r("mean_s"))


_LABELLED = f"{UB}, lb AS (SELECT file, ord, s, e, (floor(s / 86400)::BIGINT % 2)::INT AS c FROM ub)"


def _labelled(spark, d):
    return src.user_bounds(spark, d).withColumn("cluster", (F.floor(F.col("start") / 86400) % 2).cast("int"))


@query(
    "merge_runs",
    f"""WITH {_LABELLED}, a AS (SELECT *, CASE WHEN c <> lag(c) OVER (PARTITION BY file ORDER BY s) THEN 1 ELSE 0 END AS ch FROM lb),
b AS (SELECT *, sum(ch) OVER (PARTITION BY file ORDER BY s) AS run FROM a)
SELECT file, run::BIGINT AS run, round(arg_min(s, s), 6) AS start, round(arg_max(e, s), 6) AS "end", min(c) AS cluster FROM b GROUP BY file, run""",
)
def merge_runs(spark, d):
    return features.merge_runs(_labelled(spark, d)).select("file", "run", r("start"), r("end"), "cluster")


@query("change_points", f"WITH {_LABELLED}, a AS (SELECT *, lag(c) OVER (PARTITION BY file ORDER BY s) AS p FROM lb) SELECT file, ord::BIGINT AS segment FROM a WHERE p <> c")
def change_points(spark, d):
    return features.change_points(_labelled(spark, d)).select("file", F.col("ord").alias("segment"))


#: Colours of the first eight clusters.
PALETTE = ("#2a6f97", "#e07a5f", "#3d9970", "#b5838d", "#f2b134", "#6d597a", "#8ab17d", "#444444")
_HEX = ", ".join(f"({k + 1}, '{c}')" for k, c in enumerate(PALETTE))
_LIN = "CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(
    "cluster_colours",
    f"""WITH c AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) AS k FROM (SELECT DISTINCT label + 1 AS cluster FROM embeddings)),
p AS (SELECT * FROM (VALUES {_HEX}) t(k, hex)),
q AS (SELECT cluster, hex, coalesce(('0x' || substr(hex, 2, 2))::INT, 128) AS r, coalesce(('0x' || substr(hex, 4, 2))::INT, 128) AS g, coalesce(('0x' || substr(hex, 6, 2))::INT, 128) AS b FROM c LEFT JOIN p USING (k)),
l AS (SELECT *, 0.2126::DOUBLE * ({_LIN.format(c='r::DOUBLE')}) + 0.7152::DOUBLE * ({_LIN.format(c='g::DOUBLE')}) + 0.0722::DOUBLE * ({_LIN.format(c='b::DOUBLE')}) AS y FROM q)
SELECT cluster, hex, r, g, b, CASE WHEN (y + 0.05) / 0.05 >= 1.05 / (y + 0.05) THEN '#000000' ELSE '#ffffff' END AS ink FROM l""",
)
def cluster_colours(spark, d):
    clusters = src.embedding_rows(spark, d).select("cluster").distinct()
    # A row per cluster: the window is over a handful of rows.
    ranked = clusters.withColumn("k", F.dense_rank().over(Window.orderBy("cluster")))
    palette = spark.createDataFrame(list(enumerate(PALETTE, 1)), "k int, hex string")
    met = ranked.join(F.broadcast(palette), "k", "left")
    channels = [F.coalesce(scalars.channel(F.col("hex"), k), F.lit(128)).alias(c) for k, c in enumerate("rgb")]
    shown = F.coalesce("hex", F.lit("#808080"))
    return met.select("cluster", "hex", *channels, scalars.ink(shown).alias("ink"))


# ---- spectral descriptors -------------------------------------------------------------------------

_TOTALS = f"{SP}, t AS (SELECT segment, sum(a) AS total, sum(a * f) / sum(a) AS c FROM sl GROUP BY segment)"


@query("spectral_centroid", f"WITH {_TOTALS} SELECT segment, round(c, 6) AS centroid FROM t")
def spectral_centroid(spark, d):
    return spectral.with_moments(src.embedding_spectra(spark, d)).select("segment", r("centroid"))


@query(
    "spectral_moments",
    f"""WITH {_TOTALS}, q AS (SELECT segment, sum(a * (f - c) ** 2) / max(total) AS m2, sum(a * (f - c) ** 3) / max(total) AS m3, sum(a * (f - c) ** 4) / max(total) AS m4 FROM sl JOIN t USING (segment) GROUP BY segment)
SELECT segment, round(m2, 2) AS spread, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM q""",
)
def spectral_moments(spark, d):
    return spectral.with_moments(src.embedding_spectra(spark, d)).select("segment", r("spread", digits=2), r("skewness"), r("kurtosis"))


@query(
    "spectral_rolloff",
    f"WITH {SP}, q AS (SELECT segment, f, sum(a * a) OVER (PARTITION BY segment ORDER BY k) AS e, sum(a * a) OVER (PARTITION BY segment) AS t FROM sl) SELECT segment, round(min(f), 6) AS rolloff FROM q WHERE e >= 0.85 * t GROUP BY segment",
)
def spectral_rolloff(spark, d):
    return src.embedding_spectra(spark, d).select("segment", r(spectral.rolloff(F.col("m")), "rolloff"))


@query("spectral_decrease", f"WITH {SP} SELECT segment, round(regr_slope(a, f) * 1e6, 6) AS decrease FROM sl GROUP BY segment")
def spectral_decrease(spark, d):
    return src.embedding_spectra(spark, d).select("segment", r(spectral.decrease(F.col("m")) * 1e6, "decrease"))


@query(
    "spectral_shape",
    f"""WITH {SP}, t AS (SELECT segment, sum(a) AS total FROM sl GROUP BY segment)
SELECT segment, round(CASE WHEN min(a) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN a > 0 THEN a ELSE 1 END))) / avg(a) END, 6) AS flatness, round(max(a) / avg(a), 6) AS crest,
round(-sum(CASE WHEN a > 0 THEN a / total * log2(CASE WHEN a > 0 THEN a / total ELSE 1 END) ELSE 0 END), 6) AS entropy FROM sl JOIN t USING (segment) GROUP BY segment""",
)
def spectral_shape(spark, d):
    m = F.col("m")
    return src.embedding_spectra(spark, d).select("segment", r(spectral.flatness(m), "flatness"), r(spectral.crest(m), "crest"), r(spectral.entropy(m), "entropy"))


@query("spectral_hfc", f"WITH {SP} SELECT segment, round(sum(a * a * f), 5) AS hfc FROM sl GROUP BY segment")
def spectral_hfc(spark, d):
    return src.embedding_spectra(spark, d).select("segment", r(spectral.hfc(F.col("m")), "hfc", 5))


@query(
    "spectral_flux",
    f"WITH {EM}, g AS (SELECT cluster, segment, unnest(range(1, 65)) AS k, v FROM em), q AS (SELECT cluster, segment, k, abs(v[k]) - coalesce(lag(abs(v[k])) OVER (PARTITION BY cluster, k ORDER BY segment), 0) AS u FROM g) SELECT segment, round(sqrt(sum(u * u)), 6) AS flux FROM q GROUP BY segment",
)
def spectral_flux(spark, d):
    frames = src.embedding_rows(spark, d).select("cluster", F.col("segment"), F.transform("v", F.abs).alias("m"))
    return spectral.with_flux(frames, keys=("cluster",), order="segment").select("segment", r("flux"))


_BANDS = ((20, 150), (150, 800), (800, 4000), (4000, 20000))


@query(
    "energy_bands",
    f"WITH {SP} SELECT segment, {', '.join(f'round(coalesce(sum(a * a) FILTER (f >= {lo} AND f < {hi}), 0) / sum(a * a), 6) AS band_{lo}_{hi}' for lo, hi in _BANDS)} FROM sl GROUP BY segment",
)
def energy_bands(spark, d):
    return src.embedding_spectra(spark, d).select("segment", *(r(spectral.band_ratio(F.col("m"), lo, hi), f"band_{lo}_{hi}") for lo, hi in _BANDS))


_EDGES = ", ".join(f"({k}, {lo}, {hi})" for k, (lo, hi) in enumerate(zip(spectral.BARK_EDGES, spectral.BARK_EDGES[1:], strict=False)))


@query(
    "band_energies",
    f"WITH {SP}, b AS (SELECT * FROM (VALUES {_EDGES}) t(band, lo, hi)) SELECT s.segment, band::INT AS band, round(coalesce(sum(a * a) FILTER (f >= lo AND f < hi), 0), 6) AS energy FROM sl s JOIN b ON true GROUP BY s.segment, band",
)
def band_energies(spark, d):
    spread = src.embedding_spectra(spark, d).select("segment", F.posexplode(spectral.bark_energies(F.col("m"))).alias("band", "energy"))
    return spread.select("segment", "band", r("energy"))


_MEL = """ed AS (SELECT j, 700 * (exp(j * ln(1 + 22050::DOUBLE / 700) / 9) - 1) AS e FROM (SELECT unnest(range(0, 10)) AS j)),
tr AS (SELECT m.j - 1 AS b, l.e AS lo, m.e AS mid, h.e AS hi FROM ed m JOIN ed l ON l.j = m.j - 1 JOIN ed h ON h.j = m.j + 1),
en AS (SELECT segment, b, sum(a * a * greatest(0, least((f - lo) / (mid - lo), (hi - f) / (hi - mid)))) AS energy FROM sl JOIN tr ON true GROUP BY segment, b)"""
_BINS = np.arange(64) * 22050.0 / 63


@query("mel_energies", f"WITH {SP}, {_MEL} SELECT segment, b::INT AS band, round(energy, 6) AS energy FROM en")
def mel_energies(spark, d):
    found = kernels.weighted_bands(src.embedding_spectra(spark, d), kernels.mel_weights(_BINS, 8))
    return found.select("segment", F.col("i").alias("band"), r("value", "energy"))


@query(
    "cepstra",
    f"""WITH {SP}, {_MEL}, q AS (SELECT unnest(range(0, 5)) AS q)
SELECT segment, q::INT AS i, round(sum(10 * log10(energy + 1e-10) * cos(pi() * q * (b + 0.5::DOUBLE) / 8)) * sqrt(2 / 8.0::DOUBLE) / CASE WHEN q = 0 THEN sqrt(2::DOUBLE) ELSE 1 END, 5) AS value FROM en JOIN q ON true GROUP BY segment, q""",
)
def cepstra(spark, d):
    return kernels.weighted_bands(src.embedding_spectra(spark, d), kernels.mel_weights(_BINS, 8), 5).select("segment", "i", r("value", digits=5))


@query(
    "erb_energies",
    f"""WITH {SP}, s AS (SELECT 21.4 * log10(1 + 0.00437::DOUBLE * 50) AS low, 21.4 * log10(1 + 0.00437::DOUBLE * 22050 * 0.95) AS top),
ce AS (SELECT b, (pow(10, (low + b * (top - low) / 7) / 21.4) - 1) / 0.00437::DOUBLE AS c FROM s, (SELECT unnest(range(0, 8)) AS b)),
wi AS (SELECT b, c, 1.019::DOUBLE * 24.7 * (1 + 0.00437::DOUBLE * c) AS w FROM ce)
SELECT segment, b::INT AS band, round(sum(a * a * pow(1 + pow((f - c) / w, 2), -2)), 6) AS energy FROM sl JOIN wi ON true GROUP BY segment, b""",
)
def erb_energies(spark, d):
    found = kernels.weighted_bands(src.embedding_spectra(spark, d), kernels.erb_weights(_BINS, 8))
    return found.select("segment", F.col("i").alias("band"), r("value", "energy"))


@query("zcr", f"WITH {EM} SELECT segment, round(list_sum(list_transform(range(1, 64), lambda i: ((v[i] < 0) <> (v[i + 1] < 0))::INT)) / 64.0, 6) AS zcr FROM em")
def zcr(spark, d):
    return src.embedding_rows(spark, d).select("segment", r(spectral.zero_crossings(F.col("v")), "zcr"))


@query("dynamics", f"WITH {EM}, q AS (SELECT segment, list_dot_product(v, v) AS e FROM em) SELECT segment, round(sqrt(e / 64), 6) AS rms, round(pow(e, 0.67), 6) AS loudness, round(10 * log10(e / 64 + 1e-12), 6) AS power_db FROM q")
def dynamics(spark, d):
    v = F.col("v")
    return src.embedding_rows(spark, d).select("segment", r(scalars.rms(v), "rms"), r(spectral.loudness(v), "loudness"), r(scalars.power_db(spectral.instant_power(v)), "power_db"))


@query("n_peaks", f"WITH {SP} SELECT segment, len(list_filter(range(2, 64), lambda k: m[k] > 1e-5 AND m[k] > m[k - 1] AND m[k] >= m[k + 1]))::INT AS n_peaks FROM sp")
def n_peaks(spark, d):
    return src.embedding_spectra(spark, d).select("segment", spectral.n_peaks(F.col("m")).alias("n_peaks"))


@query(
    "dft_magnitude",
    f"""WITH {EM}, x AS (SELECT segment, t, v[t + 1] AS a FROM (SELECT *, unnest(range(0, 64)) AS t FROM em)), b AS (SELECT unnest(range(0, 33)) AS bin)
SELECT segment, bin::INT AS bin, round(sqrt(sum(a * cos(2 * pi() * ((bin * t) % 64) / 64)) ** 2 + sum(a * sin(2 * pi() * ((bin * t) % 64) / 64)) ** 2), 6) AS mag FROM x JOIN b ON true GROUP BY segment, bin""",
)
def dft_magnitude(spark, d):
    return spectral.dft_magnitudes(src.embedding_rows(spark, d).select("segment", F.col("v").alias("x"))).select("segment", "bin", r("mag"))


@query(
    "spl_calibration",
    f"WITH {EM}, q AS (SELECT segment, sqrt(list_dot_product(v, v) / 64) AS rms FROM em) SELECT segment, round(rms * sqrt(2) * 20e-6 * pow(10, 94 / 20.0), 6) AS rms_pa, round(20 * log10(rms * sqrt(2)) + 94, 6) AS spl_db, round(10 * log10(rms * rms + 1e-12), 6) AS power_db FROM q",
)
def spl_calibration(spark, d):
    v = F.col("v")
    return src.embedding_rows(spark, d).select(
        "segment", r(scalars.rms(scalars.to_pascal(v, 94.0)), "rms_pa"), r(scalars.spl(v, 94.0), "spl_db"), r(scalars.power_db(scalars.rms(v) * scalars.rms(v)), "power_db")
    )


# ---- psychoacoustic aggregations ------------------------------------------------------------------


@query("exceedance_percentiles", f"WITH {SLICE} SELECT file, segment::BIGINT AS segment, {', '.join(f'round(quantile_cont(x, {(100 - p) / 100}), 6) AS n_{p}' for p in psycho.PERCENTILES)} FROM sl GROUP BY ALL")
def exceedance_percentiles(spark, d):
    return src.daily_values(spark, d).groupBy("file", "segment").agg(*(r(psycho.exceedance(F.col("value"), p), f"n_{p}") for p in psycho.PERCENTILES))


@query("curve_summary", f"WITH {SP} SELECT segment, round(avg(a), 6) AS mean, round(max(a), 6) AS max, round(stddev_pop(a), 6) AS std FROM sl GROUP BY segment")
def curve_summary(spark, d):
    s = src.embedding_spectra(spark, d).select("segment", *psycho.curve_summary(F.col("m")))
    return s.select("segment", r("mean"), r("max"), r("std"))


@query(
    "bark_moments",
    f"WITH {SP}, c AS (SELECT segment, sum(a * (k + 0.5)::DOUBLE) / sum(a) AS c FROM sl GROUP BY segment) SELECT segment, round(max(c), 6) AS bark_centroid, round(sqrt(sum(a * ((k + 0.5)::DOUBLE - c) ** 2) / sum(a)), 6) AS bark_spread FROM sl JOIN c USING (segment) GROUP BY segment",
)
def bark_moments(spark, d):
    bark = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k + F.lit(0.5))
    s = src.embedding_spectra(spark, d).select("segment", *psycho.bark_moments(F.col("m"), bark))
    return s.select("segment", r("bark_centroid"), r("bark_spread"))


@query(
    "strongest_tone",
    f"WITH {SP}, q AS (SELECT * FROM sl WHERE a > 0.1) SELECT segment, count(*) AS n_tones, round(max(a), 6) AS tnr_max, round(arg_max(f, (a, -f)), 6) AS strongest FROM q GROUP BY segment",
)
def strongest_tone(spark, d):
    spread = src.embedding_spectra(spark, d).select("segment", F.posexplode("m").alias("k", "tnr")).where("tnr > 0.1")
    tones = spread.select("segment", (F.col("k") * F.lit(22050.0) / 63).alias("freq"), "tnr")
    return psycho.strongest_tone(tones, ["segment"]).select("segment", "n_tones", r("tnr_max_dB", "tnr_max"), r("strongest_tone_Hz", "strongest"))


@query("psycho_guard", f"WITH {UB} SELECT file, ord::BIGINT AS segment, CASE WHEN e - s < 3600 THEN 1.0::DOUBLE ELSE 0 END AS skipped, CASE WHEN e - s >= 3600 THEN round(least(e - s, 50000), 6) END AS analysed_duration FROM ub")
def psycho_guard(spark, d):
    b = src.user_bounds(spark, d).withColumn("duration", F.col("end") - F.col("start"))
    return psycho.guard(b, 3600.0, 50000.0).select("file", F.col("ord").alias("segment"), "skipped", r("analysed_duration"))


# ---- labels ---------------------------------------------------------------------------------------


@query("audacity_labels", f"WITH {SEG} SELECT file, segment::BIGINT AS ord, printf('%.6f', s) || chr(9) || printf('%.6f', e) || chr(9) || lpad(segment::VARCHAR, 4, '0') AS line FROM seg")
def audacity_labels(spark, d):
    return sinks.audacity(sinks.markers(src.daily_segments(spark, d)))


@query("reaper_csv", f"WITH {SEG} SELECT file, segment::BIGINT AS ord, 'R' || (segment + 1) || ',' || lpad(segment::VARCHAR, 4, '0') || ',' || printf('%.6f', s) || ',' || printf('%.6f', e) || ',' || printf('%.6f', e - s) || ',' AS line FROM seg")
def reaper_csv(spark, d):
    return sinks.reaper(sinks.markers(src.daily_segments(spark, d)))


@query(
    "time_labels",
    f"""WITH {SEG} SELECT file, segment::BIGINT AS segment, (floor(s / 60)::BIGINT)::VARCHAR || ':' || lpad((s::BIGINT % 60)::VARCHAR, 2, '0') AS clock,
CASE WHEN s = 0 THEN '0' WHEN s >= 1000 THEN printf('%.0f', s) WHEN s >= 10 THEN printf('%.1f', s) ELSE printf('%.2f', s) END AS shown, 'centroid.mean' AS short FROM seg""",
)
def time_labels(spark, d):
    seg = src.daily_segments(spark, d)
    return seg.select("file", "segment", scalars.format_time(F.col("start")).alias("clock"), scalars.format_value(F.col("start")).alias("shown"), scalars.short_name(F.lit("spectral.centroid.mean")).alias("short"))


# ---- clustering and kernels -----------------------------------------------------------------------


def _kmeans_sql(k: int, steps: int) -> str:
    near = lambda c, out: (
        f"{out} AS (SELECT segment, v, cluster FROM (SELECT e.segment, e.v, c.cluster, row_number() OVER (PARTITION BY e.segment ORDER BY sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) ** 2))), c.cluster) AS n FROM e JOIN {c} c ON true) WHERE n = 1)"
    )
    parts = [f"{EM}, e AS (SELECT segment, v FROM em), c0 AS (SELECT (row_number() OVER (ORDER BY segment))::INT AS cluster, v FROM e ORDER BY segment LIMIT {k})"]
    for t in range(steps):
        parts.append(near(f"c{t}", f"p{t}"))
        parts.append(
            f"m{t} AS (SELECT cluster, list(m ORDER BY j) AS v FROM (SELECT cluster, j, avg(v[j]) AS m FROM (SELECT cluster, v, unnest(range(1, 65)) AS j FROM p{t}) GROUP BY cluster, j) GROUP BY cluster), c{t + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m USING (cluster))"
        )
    parts.append(near(f"c{steps}", "z"))
    return f"WITH {', '.join(parts)} SELECT segment, cluster FROM z"


@query("kmeans_fixed_init", _kmeans_sql(4, 3))
def kmeans_fixed_init(spark, d):
    rows = src.embedding_rows(spark, d)
    starts = [list(x["v"]) for x in rows.orderBy("segment").limit(4).collect()]
    return similarity.kmeans_fixed_start(rows, starts, 3).select("segment", "cluster")


@query("kmeans")
def kmeans(spark, d):
    return similarity.analyse(src.embedding_rows(spark, d), method="kmeans", k=5).select("segment", "cluster", "silhouette")


@query("linkage_cut")
def linkage_cut(spark, d):
    return similarity.analyse(src.embedding_rows(spark, d), method="hierarchical", link="ward", k=6).select("segment", "cluster", "silhouette")


@query("merge_steps")
def merge_steps(spark, d):
    return plots.merge_steps(src.embedding_rows(spark, d), link="average").select("step", "a", "b", "height", "size")


@query(
    "single_linkage_cut",
    """WITH RECURSIVE e AS (SELECT vec_id AS segment, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.segment AS x, b.segment AS y, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) ** 2))) AS d FROM e a JOIN e b ON a.segment <> b.segment),
t AS (SELECT round(avg(m), 6) AS t FROM (SELECT min(d) AS m FROM p GROUP BY x)),
l AS (SELECT x, y FROM p, t WHERE d <= t),
reach AS (SELECT segment AS x, segment AS y FROM e UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT x::BIGINT AS segment, min(y)::BIGINT AS root FROM reach GROUP BY x""",
)
def single_linkage_cut(spark, d):
    """Single linkage in rounds, cut at the mean distance of nearest neighbours."""
    _, placed = similarity.spanning_forest(src.embedding_rows(spark, d), cut=True)
    roots = placed.groupBy("file", "cluster").agg(F.min("segment").alias("root"))
    return placed.join(roots, ["file", "cluster"]).select("segment", "root")


@query("map_edges", f'WITH {SEG} SELECT file, segment::BIGINT AS ord, round(s, 6) AS t FROM seg UNION ALL SELECT file, max(segment)::BIGINT + 1, round(arg_max(e, segment), 6) FROM seg GROUP BY file')
def map_edges(spark, d):
    return plots.map_edges(src.daily_segments(spark, d)).select("file", "ord", r("t"))


@query("auto_k")
def auto_k(spark, d):
    return similarity.analyse(src.embedding_rows(spark, d)).select("segment", "cluster", "k", "silhouette")


@query("pca")
def pca(spark, d):
    """Components of all rows; they need no clusters, so none are made."""
    rows, _ = similarity.checked(src.embedding_rows(spark, d), "euclidean")
    at = lambda c, k: F.get(c, F.lit(k))
    return similarity.principal_components(rows).select("segment", at("xy", 0).alias("pc1"), at("xy", 1).alias("pc2"), at("share", 0).alias("explained1"), at("share", 1).alias("explained2"))


def _event_arrays(spark, d) -> DataFrame:
    ev = src.event_samples(spark, d)
    return ev.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"] / 500.0).alias("x"))


@query("kernel_descriptors")
def kernel_descriptors(spark, d):
    """All descriptor groups of the event files as signals of 44.1 kHz, summarised per file."""
    arrays = _event_arrays(spark, d).withColumn("segment", F.lit(0).cast("long"))
    return kernels.describe_segments(arrays, 44100, kernels.GROUPS, stats.DEFAULT_STATS, 512, 256)


@query("psycho_describe")
def psycho_describe(spark, d):
    arrays = _event_arrays(spark, d).withColumn("segment", F.lit(0).cast("long"))
    return psycho.describe(arrays, 1000.0, psycho.metrics())


#: Samples of a chunk of the event files.
EVENT_CHUNK = 1024


@query("onset_detect")
def onset_detect(spark, d):
    chunks = ranges.with_halo(ranges.chunked(_half_scale(src.event_samples(spark, d)), EVENT_CHUNK), 32, 64)
    return kernels.detect_onsets(chunks, 100.0, "flux", 32, 16)


@query("sbic")
def sbic(spark, d):
    chunks = ranges.with_halo(ranges.chunked(_half_scale(src.event_samples(spark, d)), EVENT_CHUNK), 0, 64)
    return kernels.sbic_edges(chunks, 100.0, 64, 16, 6, size1=60, inc1=10, size2=40, inc2=4)


def _half_scale(samples: DataFrame) -> DataFrame:
    return samples.select("file", "i", (F.col("x") / 500.0).alias("x"))


@query(
    "resample",
    f"""WITH {EV}, n AS (SELECT file, ceil((max(i) + 1) * 2 / 3.0)::BIGINT AS n FROM ev GROUP BY file),
j AS (SELECT file, unnest(range(0, n)) AS j FROM n),
k AS (SELECT file, j, j * 3 // 2 AS base, (j * 3 % 2) / 2.0::DOUBLE AS part, unnest(range(-23, 25)) AS o FROM j),
w AS (SELECT k.file, j, x / 500.0::DOUBLE AS x, part - o AS gap FROM k JOIN ev ON ev.file = k.file AND ev.i = base + o)
SELECT file, j AS i, round(sum(x * (2 / 3.0::DOUBLE) * CASE WHEN gap = 0 THEN 1 ELSE sin(pi() * gap * 2 / 3.0::DOUBLE) / (pi() * gap * 2 / 3.0::DOUBLE) END
  * CASE WHEN abs(gap) < 24 THEN 0.5 + 0.5 * cos(pi() * gap / 24) ELSE 0 END), 6) AS x FROM w GROUP BY file, j""",
)
def resample(spark, d):
    """Three to two by the polyphase bank, over single samples."""
    return resampling.resample_samples(_half_scale(src.event_samples(spark, d)), 3, 2).select("file", "i", r("x"))


@query(
    "dynamic_complexity",
    f"""WITH {EV}, b AS (SELECT file, i // 20 AS b, sum(x * x / 250000.0::DOUBLE) / 20 AS p FROM ev GROUP BY ALL),
w AS (SELECT file, 10 * log10(avg(p) + 1e-9) AS w FROM b GROUP BY file),
d AS (SELECT file, avg(abs(10 * log10(p + 1e-9) - w)) AS d, any_value(w) AS w FROM b JOIN w USING (file) GROUP BY file)
SELECT file, 'global.dynamic_complexity' AS name, round(d, 6) AS value FROM d UNION ALL SELECT file, 'global.loudness_dB', round(w, 6) FROM d""",
)
def dynamic_complexity(spark, d):
    return loudness.file_globals(ranges.chunked(_half_scale(src.event_samples(spark, d)), EVENT_CHUNK), 100.0).select("file", "name", r("value"))


def _gates_sql() -> str:
    # greatest() would pass a null over, as of a file without blocks.
    loud = lambda p: f"(CASE WHEN {p} IS NOT NULL THEN -0.691 + 10 * log10(greatest({p}, 1e-12)) END)"
    gated = lambda name, source, gate: f"{name}0 AS (SELECT file, p, avg(p) OVER (PARTITION BY file) AS m FROM {source} WHERE {loud('p')} > -70), {name} AS (SELECT file, p FROM {name}0 WHERE {loud('p')} > {loud('m')} + {gate})"
    block = lambda name, size, hop: f"{name} AS (SELECT file, b, sum(e) / {size * 10} AS p FROM (SELECT file, s, e, unnest(range(greatest(0, ceil((s - {size - 1}) / {hop}::DOUBLE)::BIGINT), s // {hop} + 1)) AS b FROM st) GROUP BY file, b HAVING count(*) = {size})"
    return f"""WITH {EV}, st AS (SELECT file, i // 10 AS s, sum(x * x / 250000.0::DOUBLE) AS e FROM ev GROUP BY ALL HAVING count(*) = 10),
{block('mo', 4, 1)}, {block('sh', 30, 10)}, {gated('gi', 'mo', -10)}, {gated('gr', 'sh', -20)},
v AS (
  SELECT f.file, (SELECT {loud('avg(p)')} FROM gi WHERE gi.file = f.file) AS i, (SELECT quantile_cont({loud('p')}, 0.95) - quantile_cont({loud('p')}, 0.10) FROM gr WHERE gr.file = f.file) AS r,
    (SELECT {loud('max(p)')} FROM sh WHERE sh.file = f.file) AS m FROM (SELECT DISTINCT file FROM ev) f
)
SELECT file, 'global.loudness_integrated_LUFS' AS name, round(coalesce(i, -70), 6) AS value FROM v
UNION ALL SELECT file, 'global.loudness_range_LU', round(coalesce(r, 0), 6) FROM v UNION ALL SELECT file, 'global.loudness_short_term_max_LUFS', round(coalesce(m, -70), 6) FROM v"""


@query("loudness_gates", _gates_sql())
def loudness_gates(spark, d):
    """Programme loudness of the event files: blocks and both gates, with a filter that changes nothing in place of the K-weighting."""
    steps = loudness.step_energies(ranges.chunked(_half_scale(src.event_samples(spark, d)), EVENT_CHUNK), 100.0, [recursion.Section(1.0, 0.0, 0.0, 0.0, 0.0)], "x")
    return loudness.programme_loudness(steps, 100.0).select("file", "name", r("value"))


@query("assembled_segments", f"""WITH {EV}, s AS (SELECT file, unnest(range(0, (max(i) + 500) // 700 + 1)) AS segment FROM ev GROUP BY file)
SELECT s.file, segment, count(*) AS n, round(sum(x * (i - segment * 700 + 1)) / 1e6, 6) AS moment FROM s JOIN ev ON ev.file = s.file AND i >= segment * 700 AND i < segment * 700 + 1500 GROUP BY s.file, segment""")
def assembled_segments(spark, d):
    """Overlapping segments of 1,500 samples every 700, put together from chunks; checked by length and first moment."""
    samples = src.event_samples(spark, d).select("file", "i", "x")
    ends = samples.groupBy("file").agg(F.max("i").alias("last"))
    segments = ends.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(last + 500) div 700"))).alias("segment")).selectExpr("file", "segment", "segment * 700D AS start", "segment * 700D + 1500D AS end")
    made = ranges.assemble(ranges.chunked(samples, EVENT_CHUNK), segments, 1.0, EVENT_CHUNK).where(F.size("x") > 0)
    moment = F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda t, v: t + v)
    return made.select("file", "segment", F.size("x").cast("long").alias("n"), r(moment / 1e6, "moment"))
