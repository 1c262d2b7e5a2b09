"""Every operator as a query over the test tables, and its SQL."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer, scalar, signal, wire
from ..operators import align, faults, stats, windows
from ..schema import AuditConfig
from ..sources import corec, simulate, text
from ..streaming import stateful
from . import api, packets, reports, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RATE = 256.0
#: The SQL of the domain views.
EEG = f"eeg AS (SELECT vec_id::BIGINT AS sequence_id, vec_id * {views.EEG_STEP_NS}::BIGINT AS t, embedding FROM embeddings)"
GAZE = f"gaze AS (SELECT event_id::BIGINT AS idx, event_id * {views.GAZE_STEP_NS}::BIGINT AS g, value AS x, user_id::DOUBLE AS y FROM events)"
BUY = "l AS (SELECT user_id::BIGINT AS user_id, epoch_us(ts) AS t, event_id::BIGINT AS event_id FROM events WHERE event_type = 'purchase')"
VIEW = "r AS (SELECT user_id::BIGINT AS user_id, epoch_us(ts) AS t, event_id::BIGINT AS event_id, value FROM events WHERE event_type = 'view')"
ASOF = f"""{BUY}, {VIEW},
b AS (SELECT l.*, r.t AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t),
n AS (SELECT b.*, r.t AS nt, r.value AS nv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t < r.t),
m AS (SELECT user_id, event_id, t, CASE WHEN bt IS NULL OR nt - t < t - bt THEN nt ELSE bt END AS matched,
      CASE WHEN bt IS NULL OR nt - t < t - bt THEN nv ELSE bv END AS v FROM n WHERE bt IS NOT NULL OR nt IS NOT NULL)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    anchors, stream = views.two_streams(spark, d)
    return align.asof_nearest(anchors.drop("value"), stream, ["value"], ["user_id"], ts="ts_us", left_idx="event_id", right_idx="event_id")


@query(f"WITH {ASOF} SELECT user_id, event_id, t AS ts_us, matched AS matched_us, matched - t AS offset_us, v AS value FROM m")
def asof_nearest_by_user(spark: SparkSession, d: str) -> DataFrame:
    return _by_user(spark, d).select("user_id", "event_id", "ts_us", F.col("matched_ns").alias("matched_us"), F.col("alignment_offset_ns").alias("offset_us"), "value")


@query(f"WITH {ASOF} SELECT user_id, count(*)::BIGINT AS frames_fused, round(avg(abs(matched - t)), 4) AS mean_offset, round(avg((abs(matched - t) > 10000000)::INT), 8) AS degraded_fraction FROM m GROUP BY user_id")
def alignment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return align.alignment_metrics(_by_user(spark, d), ["user_id"]).select("user_id", "frames_fused", F.round("mean_alignment_ns", 4).alias("mean_offset"), F.round("degraded_fraction", 8).alias("degraded_fraction"))


@query(f"WITH {ASOF} SELECT event_id, abs(matched - t) > 600000000 AS degraded FROM m")
def degraded_flag(spark: SparkSession, d: str) -> DataFrame:
    return align.with_degraded(_by_user(spark, d), 600.0).select("event_id", "degraded")


NEAR = """b AS (SELECT eeg.*, gaze.g AS bg, gaze.x AS bx FROM eeg ASOF LEFT JOIN gaze ON t >= g),
n AS (SELECT b.*, gaze.g AS ng, gaze.x AS nx FROM b ASOF LEFT JOIN gaze ON t < g),
m AS (SELECT sequence_id, t, embedding, CASE WHEN bg IS NULL OR ng - t < t - bg THEN ng ELSE bg END AS g,
      CASE WHEN bg IS NULL OR ng - t < t - bg THEN nx ELSE bx END AS x FROM n)"""


@query(f"WITH {EEG}, {GAZE}, {NEAR} SELECT sequence_id, t AS timestamp_ns, g AS matched_ns, g - t AS alignment_offset_ns, x FROM m")
def asof_nearest_global(spark: SparkSession, d: str) -> DataFrame:
    out = align.asof_nearest_bucketed(views.eeg(spark, d), views.gaze(spark, d), ["x"], 100_000_000)
    return out.select("sequence_id", "timestamp_ns", "matched_ns", "alignment_offset_ns", "x")


def _clamped(hi: str, lo: str) -> str:
    """The buffered search as SQL: candidates are the rows numbered lo to hi - 1."""
    return f"""WITH {EEG}, {GAZE},
q AS (SELECT *, row_number() OVER (ORDER BY g, idx) - 1 AS k FROM gaze),
e AS (SELECT sequence_id, t, row_number() OVER (ORDER BY t, sequence_id) AS i FROM eeg),
h AS (SELECT e.*, {hi} AS hi FROM e), v AS (SELECT h.*, {lo} AS lo FROM h WHERE hi > 0),
c AS (SELECT v.sequence_id, v.t, q.g, q.x, row_number() OVER (PARTITION BY v.sequence_id ORDER BY abs(q.g - v.t), q.g) AS rk
      FROM v JOIN q ON q.k >= v.lo AND q.k < v.hi)
SELECT sequence_id, t AS timestamp_ns, g AS matched_ns, g - t AS alignment_offset_ns, x FROM c WHERE rk = 1"""


@query(_clamped("least((SELECT count(*) FROM q), floor(i * (60.0 / 256.0))::BIGINT)", "greatest(0, hi - 32)"))
def asof_replay_mode(spark: SparkSession, d: str) -> DataFrame:
    out = align.asof_buffered(views.eeg(spark, d), views.gaze(spark, d), ["x"], "replay", 60.0 / 256.0, 32)
    return out.select("sequence_id", "timestamp_ns", "matched_ns", "alignment_offset_ns", "x")


@query(_clamped("(SELECT count(*) FROM q)", "greatest(0, hi - 256)"))
def asof_bench_mode(spark: SparkSession, d: str) -> DataFrame:
    out = align.asof_buffered(views.eeg(spark, d), views.gaze(spark, d), ["x"], "bench")
    return out.select("sequence_id", "timestamp_ns", "matched_ns", "alignment_offset_ns", "x")


@query("""WITH l AS (SELECT event_id::BIGINT AS event_id, epoch_us(ts) // 600000000 * 600000000 AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id::BIGINT AS view_id, epoch_us(ts) // 600000000 * 600000000 AS t FROM events WHERE event_type = 'view'),
b AS (SELECT l.event_id, l.t, arg_max(r.view_id, (r.t, r.view_id)) AS bv, max(r.t) AS bt FROM l LEFT JOIN r ON r.t <= l.t GROUP BY ALL),
n AS (SELECT l.event_id, arg_min(r.view_id, (r.t, r.view_id)) AS nv, min(r.t) AS nt FROM l LEFT JOIN r ON r.t > l.t GROUP BY ALL)
SELECT event_id, CASE WHEN bt IS NULL OR nt - t < t - bt THEN nv ELSE bv END AS view_id,
       CASE WHEN bt IS NULL OR nt - t < t - bt THEN nt ELSE bt END - t AS offset_us FROM b JOIN n USING (event_id)""")
def asof_duplicate_ties(spark: SparkSession, d: str) -> DataFrame:
    coarse = (F.floor(F.col("ts_us") / 600_000_000) * 600_000_000).cast("bigint")
    anchors, stream = (x.withColumn("ts_us", coarse) for x in views.two_streams(spark, d))
    stream = stream.withColumn("view_id", F.col("event_id"))
    out = align.asof_nearest_bucketed(anchors.select("event_id", "ts_us"), stream, ["view_id"], 3_600_000_000, ts="ts_us", left_idx="event_id", right_idx="event_id")
    return out.select("event_id", "view_id", F.col("alignment_offset_ns").alias("offset_us"))


@query(f"WITH {BUY}, {VIEW} SELECT l.user_id, l.event_id, r.event_id AS view_id, r.t - l.t AS offset_us FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 300000000")
def interval_join_tolerance(spark: SparkSession, d: str) -> DataFrame:
    anchors, stream = views.two_streams(spark, d)
    r = stream.select("user_id", F.col("event_id").alias("view_id"), F.col("ts_us").alias("view_us"))
    out = align.interval_join(anchors, r, ["user_id"], "ts_us", "view_us", 300_000_000)
    return out.select("user_id", "event_id", "view_id", (F.col("view_us") - F.col("ts_us")).alias("offset_us"))


def _spectrum_sql(size: int) -> str:
    """List SQL of the newest ``size`` samples' power spectrum, from a column ``w`` (list of double)."""
    angle = f"-2 * pi() * ((k * i) % {size}) / {size}"
    part = lambda f: f"list_sum([s[i + 1] * (0.5 * (1 - cos(2 * pi() * i / {size - 1}))) * {f}({angle}) for i in range({size})])"
    return f"[(pow({part('cos')}, 2) + pow({part('sin')}, 2)) / {size * size} for k in range({size // 2})]"


def _bands_sql(size: int, rate: float) -> str:
    sums = [f"coalesce(list_sum(p[{lo + 1}:{hi}]), 0.0) AS {name}" if hi > lo else f"0.0::DOUBLE AS {name}" for (lo, hi), (name, _, _) in zip(signal.band_bins(size, rate), signal.BANDS, strict=True)]
    return ", ".join([*sums, "list_sum(p) AS total"])


SPECTRA = f"""w AS (SELECT vec_id::BIGINT AS sequence_id, [x::DOUBLE for x in embedding] AS w FROM embeddings),
s AS (SELECT sequence_id, w, w[-32:] AS s FROM w), p AS (SELECT sequence_id, w, {_spectrum_sql(32)} AS p FROM s),
bands AS (SELECT sequence_id, w, p, {_bands_sql(32, RATE)} FROM p)"""
NAMES = [n for n, _, _ in signal.BANDS]


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    size = signal.fft_size(64)
    df = views.eeg(spark, d).withColumn("w", F.transform("channels", lambda x: x.cast("double")))
    df = df.withColumn("s", signal.newest(F.col("w"), size)).withColumn("p", signal.power_spectrum(F.col("s"), size))
    return df.select("sequence_id", "w", "p", *signal.band_powers(F.col("p"), size, RATE))


@query(f"WITH {SPECTRA} SELECT sequence_id, {', '.join(f'round({n}, 10) AS {n}' for n in [*NAMES, 'total'])} FROM bands")
def band_powers(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("sequence_id", *[F.round(n, 10).alias(n) for n in [*NAMES, "total"]])


@query(f"WITH {SPECTRA} SELECT sequence_id, {', '.join(f'round(CASE WHEN total < 1e-30 THEN 0 ELSE {n} / total END, 8) AS {n}' for n in NAMES)} FROM bands")
def relative_powers(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("sequence_id", *[F.round(signal.relative(F.col(n), F.col("total")), 8).alias(n) for n in NAMES])


@query(f"WITH {SPECTRA} SELECT sequence_id, {', '.join([f'round({n} / total, 7) AS rel_{n}' for n in NAMES] + [f'round(ln({n} + 1e-30), 6) AS ln_{n}' for n in NAMES])}, round(sqrt(list_sum([x * x for x in w]) / 64), 8) AS rms FROM bands")
def eeg_features_spatial(spark: SparkSession, d: str) -> DataFrame:
    """The Arrow form; its SQL is the transform written out."""
    df = views.eeg(spark, d).withColumn("f", signal.features_arrow(RATE)("channels"))
    cols = [F.round(F.col("f")[i], 7).alias(f"rel_{n}") for i, n in enumerate(NAMES)] + [F.round(F.col("f")[5 + i], 6).alias(f"ln_{n}") for i, n in enumerate(NAMES)]
    return df.select("sequence_id", *cols, F.round(F.col("f")[10], 8).alias("rms"))


@query(f"""WITH c AS (SELECT vec_id::BIGINT AS sequence_id, embedding[1]::DOUBLE AS v FROM embeddings),
w AS (SELECT sequence_id, list(v) OVER (ORDER BY sequence_id ROWS 31 PRECEDING) AS w, row_number() OVER (ORDER BY sequence_id) AS rn FROM c),
s AS (SELECT sequence_id, w, w[-16:] AS s FROM w WHERE rn >= 32), p AS (SELECT sequence_id, w, {_spectrum_sql(16)} AS p FROM s),
bands AS (SELECT sequence_id, w, p, {_bands_sql(16, RATE)} FROM p)
SELECT sequence_id, {', '.join(f'round({n} / total, 7) AS rel_{n}' for n in NAMES)}, round(sqrt(list_sum([x * x for x in w]) / 32), 8) AS rms FROM bands""")
def eeg_features_temporal(spark: SparkSession, d: str) -> DataFrame:
    """Features over the last 32 ticks of one channel, rows dealt to overlapping ranges first."""
    one = views.eeg(spark, d).select("sequence_id", F.col("channels")[0].cast("double").alias("v")).withColumn("rn", F.col("sequence_id") + 1)
    df = windows.sliding_ranges(one, "v", 32, name="w").withColumn("f", signal.features_arrow(RATE)("w"))
    return df.select("sequence_id", *[F.round(F.col("f")[i], 7).alias(f"rel_{n}") for i, n in enumerate(NAMES)], F.round(F.col("f")[10], 8).alias("rms"))


@query(f"WITH {SPECTRA} SELECT sequence_id, (list_position(p, list_max(p)) - 1)::BIGINT AS peak_bin FROM bands")
def power_peak_bin(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d).select("sequence_id", (F.array_position("p", F.array_max("p")) - 1).cast("bigint").alias("peak_bin"))


@query("SELECT vec_id::BIGINT AS sequence_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) / len(embedding)), 8) AS rms FROM embeddings")
def rms(spark: SparkSession, d: str) -> DataFrame:
    return views.eeg(spark, d).select("sequence_id", F.round(signal.rms(F.transform("channels", lambda x: x.cast("double"))), 8).alias("rms"))


_COS = "round(list_sum([a[i]::DOUBLE * b[i]::DOUBLE for i in range(1, 65)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in a])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in b]))), 8)"


@query(f"WITH p AS (SELECT x.vec_id::BIGINT AS sequence_id, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id - 1) SELECT sequence_id, {_COS} AS similarity FROM p")
def cosine_consecutive(spark: SparkSession, d: str) -> DataFrame:
    e = views.eeg(spark, d).select("sequence_id", F.transform("channels", lambda x: x.cast("double")).alias("a"))
    before = e.select((F.col("sequence_id") + 1).alias("sequence_id"), F.col("a").alias("b"))
    return e.join(before, "sequence_id").select("sequence_id", F.round(signal.cosine_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))


@query(f"""WITH u AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS v FROM u GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS b FROM m GROUP BY label),
p AS (SELECT vec_id::BIGINT AS sequence_id, e.embedding AS a, c.b FROM embeddings e JOIN c USING (label)) SELECT sequence_id, round({_COS}, 5) AS similarity FROM p""")
def cosine_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("sequence_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("a")[i]) for i in range(64)]).alias("b"))
    return e.join(means, "label").select("sequence_id", F.round(F.round(signal.cosine_similarity(F.col("a"), F.col("b")), 8), 5).alias("similarity"))


@query(f"""WITH {EEG}, {GAZE}, {NEAR}, {SPECTRA},
k AS (SELECT *, row_number() OVER (ORDER BY t, sequence_id) AS rn FROM m)
SELECT t AS timestamp_ns, rn - 1 AS sequence_id, x::FLOAT AS gaze_x, 3.0::FLOAT AS pupil_diameter, g - t AS alignment_offset_ns, 64::BIGINT AS n_channels,
  round(bands.alpha / total, 4) AS rel_alpha, round(sqrt(list_sum([v * v for v in w]) / 64), 4) AS rms,
  (CASE WHEN rn >= 500 AND rn % 100 = 0 THEN 0.5 ELSE 0.0 END)::FLOAT AS confidence,
  CASE WHEN rn >= 500 AND rn % 100 = 0 THEN 'observe' ELSE 'accumulating' END AS classification
FROM k JOIN bands ON bands.sequence_id = k.sequence_id""")
def fused_packet(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recordings to fused, featured, classified packets."""
    aligned = align.asof_nearest_bucketed(views.eeg(spark, d), views.gaze(spark, d), ["x", "y", "pupil_diameter"], 100_000_000)
    p = packets.fused_packets(aligned, RATE)
    return p.select("timestamp_ns", "sequence_id", "gaze_x", "pupil_diameter", "alignment_offset_ns", F.size("eeg_channels").cast("bigint").alias("n_channels"), F.round(F.col("features")[2].cast("double"), 4).alias("rel_alpha"), F.round(F.col("features")[10].cast("double"), 4).alias("rms"), "confidence", "classification")


@query(f"""WITH {EEG}, {GAZE}, {NEAR}, k AS (SELECT *, row_number() OVER (ORDER BY t, sequence_id) - 1 AS rn FROM m)
SELECT t AS timestamp_ns, rn AS sequence_id, x::FLOAT AS gaze_x, g - t AS alignment_offset_ns, 0::BIGINT AS n_features, embedding[1]::FLOAT AS raw_first FROM k""")
def embedding_packet(spark: SparkSession, d: str) -> DataFrame:
    aligned = align.asof_nearest_bucketed(views.eeg(spark, d), views.gaze(spark, d), ["x", "y", "pupil_diameter"], 100_000_000)
    p = packets.embedding_packets(packets.fused_packets(aligned, RATE, features=False))
    return p.select("timestamp_ns", "sequence_id", "gaze_x", "alignment_offset_ns", F.size("eeg_features").cast("bigint").alias("n_features"), F.col("raw_eeg")[0].alias("raw_first"))


@query("SELECT event_type, count(value)::BIGINT AS count, round(avg(value), 8) AS mean, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 8) AS std_dev FROM events GROUP BY event_type")
def welford_by_type(spark: SparkSession, d: str) -> DataFrame:
    out = views.arrivals(spark, d).groupBy("event_type").agg(*stats.welford(F.col("value")))
    return out.select("event_type", "count", F.round("mean", 8).alias("mean"), F.round("variance", 6).alias("variance"), F.round("std_dev", 8).alias("std_dev"))


@query("SELECT event_id::BIGINT AS event_id, 1::BIGINT AS count, round(value, 8) AS mean, 0.0::DOUBLE AS variance, 0.0::DOUBLE AS std_dev FROM events WHERE event_type = 'signup' UNION ALL SELECT -1, 0, 0.0, 0.0, 0.0")
def welford_single_and_empty(spark: SparkSession, d: str) -> DataFrame:
    e = views.arrivals(spark, d)
    one = e.where("event_type = 'signup'").groupBy("event_id").agg(*stats.welford(F.col("value")))
    none = e.where("event_type = 'none'").agg(*stats.welford(F.col("value"))).select(F.lit(-1).cast("bigint").alias("event_id"), "*")
    return one.unionByName(none).withColumn("mean", F.round("mean", 8))


LAT = "x AS (SELECT l_returnflag, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) * 86400000000 AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey), v AS (SELECT * FROM x WHERE us >= 0), h AS (SELECT l_returnflag, CASE WHEN us = 0 THEN 0 ELSE length(bin(us)) - 1 END AS bucket, count(*) AS n FROM v GROUP BY ALL)"


@query(f"WITH {LAT} SELECT l_returnflag, bucket::BIGINT AS bucket, n::BIGINT AS n FROM h")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.log2_histogram(views.latencies(spark, d).where("us >= 0"), "us", ["l_returnflag"])


@query(f"""WITH {LAT}, r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h)
SELECT l_returnflag, p::DOUBLE AS p, (1::BIGINT << min(bucket)::INT) AS ns FROM r, (VALUES (50.0), (90.0), (99.0), (99.9)) q(p) WHERE run >= greatest(1, ceil(total * p / 100)) GROUP BY ALL""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    hist = stats.log2_histogram(views.latencies(spark, d).where("us >= 0"), "us", ["l_returnflag"])
    return stats.histogram_percentiles(hist, [50.0, 90.0, 99.0, 99.9], ["l_returnflag"])


@query(f"WITH {LAT} SELECT l_returnflag, count(*)::BIGINT AS count, (least(sum(us::HUGEINT), 9223372036854775807) // count(*))::BIGINT AS mean_ns, min(us)::BIGINT AS min_ns, max(us)::BIGINT AS max_ns FROM v GROUP BY l_returnflag")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return views.latencies(spark, d).where("us >= 0").groupBy("l_returnflag").agg(*stats.latency_summary(F.col("us")))


@query("""WITH k AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events), i AS (SELECT user_id, CASE WHEN d < 0 THEN 0 ELSE d END AS s FROM k)
SELECT user_id::BIGINT AS user_id, round(coalesce(avg(s), 0), 3) AS mean_interval, round(coalesce(stddev_samp(s), 0), 3) AS jitter_std_dev, count(s)::BIGINT AS n_intervals FROM i GROUP BY user_id""")
def jitter_by_user(spark: SparkSession, d: str) -> DataFrame:
    out = stats.jitter(views.arrivals(spark, d), "ts_us", ["user_id"], ["ts_us", "event_id"])
    return out.select("user_id", F.round("mean_interval", 3).alias("mean_interval"), F.round("jitter_std_dev", 3).alias("jitter_std_dev"), "n_intervals")


@query("""WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS count, round(median(v), 8) AS median, round(stddev_samp(v), 8) AS stdev, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(v) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM r GROUP BY event_type""")
def client_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.picked_percentiles(views.arrivals(spark, d), "value", ["event_type"])
    return out.select("event_type", "count", F.round("median", 8).alias("median"), F.round("stdev", 8).alias("stdev"), "p95", "p99")


HOPS = """r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
e AS (SELECT rn AS w FROM r WHERE rn >= {n} AND rn % {s} = 0)
SELECT w::BIGINT AS window_end, count(*)::BIGINT AS n_rows, round(sum(value), 4) AS total, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id FROM e JOIN r ON rn > w - {n} AND rn <= w GROUP BY w"""


@query("WITH " + HOPS.format(n=500, s=100))
def hop_windows_500_100(spark: SparkSession, d: str) -> DataFrame:
    numbered = windows.with_global_row_number(views.arrivals(spark, d), "ts_us", 86_400_000_000)
    out = windows.complete_windows(windows.hop_members(numbered, 500, 100), 500, [], [F.sum("value").alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")])
    return out.withColumn("total", F.round("total", 4))


@query("WITH r AS (SELECT vec_id::BIGINT + 1 AS rn, embedding[1]::DOUBLE AS v FROM embeddings), e AS (SELECT rn AS w FROM r WHERE rn >= 8 AND rn % 4 = 0) SELECT w AS window_end, round(sum(v), 8) AS total FROM e JOIN r ON rn > w - 8 AND rn <= w GROUP BY w")
def hop_windows_8_4(spark: SparkSession, d: str) -> DataFrame:
    one = views.eeg(spark, d).select((F.col("sequence_id") + 1).alias("rn"), F.col("channels")[0].cast("double").alias("v"))
    out = windows.complete_windows(windows.hop_members(one, 8, 4), 8, [], [F.sum("v").alias("total")])
    return out.select("window_end", F.round("total", 8).alias("total"))


@query("WITH r AS (SELECT vec_id::BIGINT + 1 AS rn, embedding[1]::DOUBLE AS v FROM embeddings), e AS (SELECT rn AS w FROM r WHERE rn >= 50 AND rn % 15 = 0) SELECT w AS window_end, s AS ring_slot, r.rn AS tick, r.v AS value FROM e, range(0, 50) t(s), r WHERE r.rn = w - ((w - 1 - s) % 50)")
def ring_order_window(spark: SparkSession, d: str) -> DataFrame:
    one = views.eeg(spark, d).select((F.col("sequence_id") + 1).alias("rn"), F.col("channels")[0].cast("double").alias("value"))
    return windows.hop_members(one, 50, 15).select("window_end", windows.ring_slot(F.col("rn"), 50).alias("ring_slot"), F.col("rn").alias("tick"), "value").join(one.agg(F.max("rn").alias("last")), F.col("window_end") <= F.col("last")).drop("last")


@query("WITH w AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 15 PRECEDING) AS w FROM events) SELECT user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, round(sqrt(list_sum([x * x for x in w]) / 16), 8) AS rms FROM w WHERE len(w) = 16")
def sliding_rms(spark: SparkSession, d: str) -> DataFrame:
    held = windows.sliding(views.arrivals(spark, d).withColumn("k", F.struct("ts_us", "event_id")), "value", 16, "k", ["user_id"])
    return held.select("user_id", "event_id", F.round(signal.rms(F.col("window")), 8).alias("rms"))


@query("WITH s AS (SELECT user_id, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) / 1000000.0 AS s FROM events) SELECT user_id::BIGINT AS user_id, round(coalesce(1.0 / median(s), 256.0), 8) AS rate FROM s GROUP BY user_id")
def lag_diff_rate(spark: SparkSession, d: str) -> DataFrame:
    seconds = views.arrivals(spark, d).select("user_id", (F.col("ts_us") / 1e6).alias("s"))
    return stats.rate_from_times(seconds, "s", RATE, ["user_id"]).select("user_id", F.round("rate", 8).alias("rate"))


@query("WITH r AS (SELECT event_id::BIGINT AS event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, rn FROM r WHERE rn % 100 = 0")
def sample_every_100(spark: SparkSession, d: str) -> DataFrame:
    return windows.sample_every(windows.with_global_row_number(views.arrivals(spark, d), "ts_us", 86_400_000_000), 100).select("event_id", "rn")


@query("WITH r AS (SELECT event_id::BIGINT AS event_id, ts FROM events ORDER BY ts, event_id LIMIT 250) SELECT event_id, epoch_us(ts) AS ts_us FROM r")
def limit_first_n(spark: SparkSession, d: str) -> DataFrame:
    """The player's frame limit: the first rows in order."""
    return views.arrivals(spark, d).orderBy("ts_us", "event_id").limit(250).select("event_id", "ts_us")


@query("SELECT vec_id::BIGINT AS sequence_id, CASE WHEN vec_id + 1 >= 50 AND (vec_id + 1) % 10 = 0 THEN 0.5 ELSE 0.0 END::FLOAT AS confidence, CASE WHEN vec_id + 1 >= 50 AND (vec_id + 1) % 10 = 0 THEN 'observe' ELSE 'accumulating' END AS classification FROM embeddings")
def stub_classify(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sequence_id") + 1
    p = infer.with_fallback((n >= 50) & (n % 10 == 0), infer.stub_prediction())
    return views.eeg(spark, d).select("sequence_id", p.alias("p")).select("sequence_id", "p.confidence", "p.classification")


@query("SELECT event_id::BIGINT AS event_id, round((1 / (1 + exp(-(value - 50) / 10)))::FLOAT::DOUBLE, 5) AS confidence, CASE WHEN (1 / (1 + exp(-(value - 50) / 10)))::FLOAT >= 0.5 THEN 'intent' ELSE 'observe' END AS classification FROM events")
def sigmoid_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = scalar.sigmoid((F.col("value") - 50) / 10)
    return views.arrivals(spark, d).select("event_id", F.round(c.cast("double"), 5).alias("confidence"), scalar.threshold_class(c).alias("classification"))


@query("SELECT CASE WHEN quality = 1 THEN 'intent' ELSE 'observe' END AS classification, count(*)::BIGINT AS n, count(*) FILTER (WHERE toxic = 1)::BIGINT AS flagged FROM labels GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    labelled = views.table(spark, d, "labels").withColumn("classification", scalar.threshold_class(F.col("quality").cast("double")))
    return labelled.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"))


_XS = """i AS (SELECT event_id, (CASE WHEN {s} = 0 THEN 1 ELSE {s} END)::UBIGINT AS a FROM events),
j AS (SELECT event_id, xor(a, ((a::UHUGEINT << 13) & 18446744073709551615::UHUGEINT)::UBIGINT) AS a FROM i),
k AS (SELECT event_id, xor(a, a >> 7) AS a FROM j),
z AS (SELECT event_id, xor(a, ((a::UHUGEINT * 131072) % 18446744073709551616::UHUGEINT)::UBIGINT) AS a FROM k)"""


@query("WITH " + _XS.format(s="event_id") + " SELECT event_id::BIGINT AS event_id, a::VARCHAR AS bits FROM z")
def xorshift_hash(spark: SparkSession, d: str) -> DataFrame:
    bits = scalar.xorshift(F.col("event_id")).cast("decimal(20,0)")
    shown = F.when(bits < 0, bits + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits)
    return views.arrivals(spark, d).select("event_id", shown.cast("decimal(20,0)").cast("string").alias("bits"))


@query("WITH " + _XS.format(s="event_id") + ", " + _XS.format(s="event_id + 1").replace("i AS", "i2 AS").replace("j AS", "j2 AS").replace("k AS", "k2 AS").replace("z AS", "z2 AS").replace("FROM i)", "FROM i2)").replace("FROM j)", "FROM j2)").replace("FROM k)", "FROM k2)") + " SELECT z.event_id::BIGINT AS event_id, round(sqrt(-2 * ln(greatest(z.a::DOUBLE / 18446744073709551616.0::DOUBLE, 1e-30))) * cos(2 * pi() * (z2.a::DOUBLE / 18446744073709551616.0::DOUBLE)), 6) AS noise FROM z JOIN z2 USING (event_id)")
def pseudo_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return views.arrivals(spark, d).select("event_id", F.round(scalar.pseudo_gaussian(F.col("event_id")), 6).alias("noise"))


def _xs(e: str) -> str:
    """One xorshift step of an unsigned expression."""
    for op in ("<< 13", ">> 7", "<< 17"):
        n = int(op[3:])
        e = f"xor({e}, ((({e})::UHUGEINT * {1 << n}) % 18446744073709551616::UHUGEINT)::UBIGINT)" if op[0] == "<" else f"xor({e}, ({e}) >> {n})"
    return e


def _gauss(e: str) -> str:
    unit = lambda x: f"(({_xs(f'greatest(({x}), 1)::UBIGINT')})::DOUBLE / 18446744073709551616.0::DOUBLE)"
    return f"(sqrt(-2 * ln(greatest({unit(e)}, 1e-30))) * cos(2 * pi() * {unit(f'{e} + 1')}))"


@query(f"WITH f AS (SELECT i, c, i / 256.0 + c * 0.1 AS t FROM range(0, 500) a(i), range(0, 4) b(c)) SELECT i::BIGINT AS sequence_id, c::BIGINT AS channel, round((sin(2 * pi() * 10 * t) * 20 + sin(2 * pi() * 20 * t) * 10 + {_gauss('(i * 1000 + c)')} * 5)::FLOAT::DOUBLE, 3) AS value FROM f")
def simulated_eeg(spark: SparkSession, d: str) -> DataFrame:
    frames = simulate.simulated_eeg(spark, 500, 4)
    one = frames.select("sequence_id", F.posexplode("channels").alias("channel", "v"))
    return one.select("sequence_id", F.col("channel").cast("bigint").alias("channel"), F.round(F.col("v").cast("double"), 3).alias("value"))


@query(f"""WITH RECURSIVE j(jump) AS (SELECT {simulate.FIRST_SACCADE}::BIGINT UNION ALL SELECT jump + 30 + ({_xs('(jump * 7919 + 15)::UBIGINT')} % 60)::BIGINT FROM j WHERE jump < 2000),
f AS (SELECT i, max(jump) AS jump FROM range(0, 2000) r(i) LEFT JOIN j ON j.jump <= i GROUP BY i),
g AS (SELECT i, CASE WHEN jump IS NULL THEN 0 ELSE {_gauss('(jump * 7919 + 13)')} * 15 END::FLOAT AS x, CASE WHEN jump IS NULL THEN 0 ELSE {_gauss('(jump * 7919 + 14)')} * 10 END::FLOAT AS y,
  ({_gauss('(i * 31 + 7)')} * 0.1)::FLOAT AS nx, ({_gauss('(i * 37 + 11)')} * 0.1)::FLOAT AS ny, ({_gauss('(i + 1)')} * 0.5)::FLOAT AS np FROM f)
SELECT i::BIGINT AS idx, i * 16666666::BIGINT AS timestamp_ns, round((x + nx)::DOUBLE, 3) AS x, round((y + ny)::DOUBLE, 3) AS y, round((3.0::FLOAT + np)::DOUBLE, 3) AS pupil_diameter FROM g""")
def simulated_gaze(spark: SparkSession, d: str) -> DataFrame:
    g = simulate.simulated_gaze(spark, 2000)
    return g.select("idx", "timestamp_ns", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("x", "y", "pupil_diameter")])


def _faults_sql(packets: int, drop_rate: float, corrupt_rate: float, size: int) -> str:
    """s(i, ..., dropped, position): both fault streams, packet by packet."""
    drop, hit = int(drop_rate * 2.0**64), int(corrupt_rate * 2.0**64)
    return f"""RECURSIVE s(i, d, c, dropped, position) AS (SELECT -1::BIGINT, {faults.DROP_SEED}::UBIGINT, {faults.CORRUPT_SEED}::UBIGINT, false, NULL::BIGINT UNION ALL
SELECT i + 1, d1, CASE WHEN d1 < {drop}::UBIGINT THEN c WHEN c1 < {hit}::UBIGINT THEN {_xs('c1')} ELSE c1 END, d1 < {drop}::UBIGINT,
  CASE WHEN d1 >= {drop}::UBIGINT AND c1 < {hit}::UBIGINT THEN ({_xs('c1')} % {size})::BIGINT END
FROM (SELECT i, c, {_xs('d')} AS d1, {_xs('c')} AS c1 FROM s WHERE i < {packets - 1}))"""


@query(f"WITH {_faults_sql(2000, 0.01, 0.005, 128_020)} SELECT i AS packet, dropped, position FROM s WHERE i >= 0")
def fault_drop_corrupt(spark: SparkSession, d: str) -> DataFrame:
    return faults.fault_plan(spark, 2_000, 0.01, 0.005, 128_020)


@query(f"""WITH {_faults_sql(10_000, 0.01, 0.005, 128_020)}, n AS (SELECT count(*) AS seen, count(*) FILTER (WHERE dropped) AS dropped, count(position) AS corrupted, count(*) FILTER (WHERE NOT dropped) AS sent FROM s WHERE i >= 0)
SELECT seen::BIGINT AS seen, dropped::BIGINT AS dropped, corrupted::BIGINT AS corrupted, sent::BIGINT AS sent, dropped / seen::DOUBLE AS drop_fraction, round(dropped / sent::DOUBLE, 10) AS loss_fraction, round((seen - sent) / seen::DOUBLE * 100, 10) AS loss_percent FROM n""")
def loss_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = faults.fault_summary(faults.fault_plan(spark, 10_000, 0.01, 0.005, 128_020))
    return s.withColumn("loss_fraction", F.round(stats.loss_fraction(F.col("sent"), F.col("dropped"), F.lit(0)), 10)).withColumn("loss_percent", F.round(stats.loss_percent(F.col("seen"), F.col("sent")), 10))


@query("SELECT vec_id::BIGINT AS sequence_id, vec_id * 3906250::BIGINT AS timestamp_ns, 64::BIGINT AS channel_count, len(embedding)::BIGINT AS n_samples, round(list_sum([x::DOUBLE for x in embedding]), 5) AS total, NULL::VARCHAR AS error FROM embeddings")
def packet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = views.eeg(spark, d)
    out = e.select(wire.decode_neural_packet(wire.encode_neural_packet("timestamp_ns", F.lit(64).cast("bigint"), "channels", "sequence_id")).alias("p")).select("p.*")
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("sequence_id", F.col("timestamp_ns").cast("bigint").alias("timestamp_ns"), "channel_count", F.size("samples").cast("bigint").alias("n_samples"), F.round(total, 5).alias("total"), "error")


@query("""SELECT * FROM (VALUES ('empty', NULL::VARCHAR), ('varint end', 'UnexpectedEof'), ('varint long', 'VarintOverflow'), ('field 0', 'InvalidFieldNumber'), ('wire 3', 'InvalidWireType(3)'), ('length', 'InvalidLength'), ('length overflow', 'InvalidLength'), ('unknown', NULL), ('fixed short', 'UnexpectedEof')) t(name, error)""")
def decode_errors(spark: SparkSession, d: str) -> DataFrame:
    cases = {"empty": "", "varint end": "0880", "varint long": "08" + "ff" * 11, "field 0": "00", "wire 3": "0b", "length": "1ae807", "length overflow": "0affffffffffffffffff1f", "unknown": "98062a", "fixed short": "0d0000"}
    rows = spark.createDataFrame([(k, bytearray.fromhex(v)) for k, v in cases.items()], "name string, payload binary")
    return rows.select("name", wire.decode_neural_packet("payload").alias("p")).select("name", F.col("p.error").alias("error"))


#: The audit's configuration, and the bytes of a packet and of those before its samples.
AUDIT = AuditConfig(packet_count=2_000, channel_count=8, samples_per_channel=16, drop_rate=0.01, corrupt_rate=0.005)
AUDIT_BYTES = len(wire.encode_packet(1 << 60, 8, [0.0] * 128, 2_000))
_LATENCY = ", ".join(f"coalesce(max(ns) FILTER (WHERE p = {p}), 0)::BIGINT AS latency_p{str(p).removesuffix('.0').replace('.', '')}_ns" for p in reports.PERCENTS)


@query(f"""WITH {_faults_sql(2000, 0.01, 0.005, AUDIT_BYTES)},
k AS (SELECT i, dropped, position, (1::BIGINT << 60) + i * 125000 AS send FROM s WHERE i >= 0),
v AS (SELECT *, send + 42100 + (({_xs('greatest(i, 1)::UBIGINT')} >> 3) % 258000)::BIGINT AS recv FROM k),
c AS (SELECT count(*) FILTER (WHERE NOT dropped) AS sent, count(*) FILTER (WHERE dropped) AS lost, count(position) AS hit, (max(recv) - min(send)) / 1e6 AS ms FROM v),
l AS (SELECT recv - send AS ns FROM v WHERE NOT dropped),
h AS (SELECT length(bin(ns)) - 1 AS bucket, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS run, sum(n) OVER () AS total FROM h),
q AS (SELECT p, 1::BIGINT << min(bucket)::INT AS ns FROM r, (VALUES {', '.join(f'({p})' for p in reports.PERCENTS)}) w(p) WHERE run >= greatest(1, ceil(total * p / 100)) GROUP BY p),
j AS (SELECT CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS step FROM (SELECT recv - lag(recv) OVER (ORDER BY i) AS d FROM v WHERE NOT dropped))
SELECT sent::BIGINT AS packets_sent, sent::BIGINT AS packets_received, lost::BIGINT AS packets_dropped, hit::BIGINT AS packets_corrupted, 0::BIGINT AS decode_errors, ms::DOUBLE AS duration_ms, pq.*,
  (SELECT (sum(ns) // count(*))::BIGINT FROM l) AS latency_mean_ns, (SELECT min(ns)::BIGINT FROM l) AS latency_min_ns, (SELECT max(ns)::BIGINT FROM l) AS latency_max_ns,
  (SELECT round(stddev_samp(step), 4) FROM j) AS jitter_std_dev_ns, (SELECT round(avg(step), 4) FROM j) AS mean_interval_ns,
  round(sent / (ms / 1000), 6) AS throughput_pps, round(lost / sent::DOUBLE, 12) AS loss_fraction, 0::BIGINT AS heap_allocs
FROM c, (SELECT {_LATENCY} FROM q) pq""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """No hit of this run falls on a byte before the samples, so nothing fails to decode."""
    out = reports.audit_report(reports.audit_packets(spark, AUDIT))
    return out.withColumns({c: F.round(c, n) for c, n in (("jitter_std_dev_ns", 4), ("mean_interval_ns", 4), ("throughput_pps", 6), ("loss_fraction", 12))})


@query("SELECT user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS ts_us FROM events")
def rebase_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return windows.rebased(views.arrivals(spark, d), "ts_us", ["user_id"]).select("user_id", "event_id", "ts_us")


@query("SELECT p_partkey::BIGINT AS p_partkey, round(try_cast(split_part(p_name, ' ', 2) AS DOUBLE), 6) AS word_number, round(try_cast(substr(p_type, 1, 1) AS DOUBLE), 6) AS type_number FROM part WHERE try_cast(p_size AS DOUBLE) IS NOT NULL")
def lenient_parse(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part")
    word = F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit(""))
    return p.where(F.col("p_size").cast("string").try_cast("double").isNotNull()).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.round(word.try_cast("double"), 6).alias("word_number"), F.round(F.substring("p_type", 1, 1).try_cast("double"), 6).alias("type_number"))


@query("SELECT event_id::BIGINT AS event_id, CASE WHEN event_id % 5 = 0 THEN 3.0 WHEN event_id % 5 = 1 THEN 0.0 ELSE value END AS x FROM events")
def missing_default(spark: SparkSession, d: str) -> DataFrame:
    e = views.arrivals(spark, d)
    field = F.when(F.col("event_id") % 5 == 0, "-").when(F.col("event_id") % 5 == 1, "").otherwise(F.col("value").cast("string"))
    parts = F.array(F.lit("t"), field)
    return e.select("event_id", F.when(F.col("event_id") % 5 == 0, text.value_or(parts, 1, text.PUPIL)).otherwise(text.value_or(parts, 1, 0.0)).alias("x"))


@query("WITH n AS (SELECT count(*) AS c FROM labels), l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) SELECT i::BIGINT AS i, doc_id::BIGINT AS doc_id FROM range(0, 1000) t(i), n, l WHERE k = floor(i * (c - 1) / 999.0)")
def linspace_resample(spark: SparkSession, d: str) -> DataFrame:
    labels = views.table(spark, d, "labels").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    numbered = windows.with_global_row_number(labels, "doc_id", 10_000).withColumn("k", F.col("rn") - 1)
    n = numbered.count()
    picks = spark.range(1000).select(F.col("id").alias("i"), windows.linspace_index(F.col("id"), 1000, n).alias("k"))
    return picks.join(numbered, "k").select("i", "doc_id")


@query("SELECT doc_id::BIGINT AS doc_id, CASE WHEN source LIKE 'src1%' THEN 'EEGET-RSOD' WHEN source LIKE 'src2%' THEN 'EEGET-ALS' ELSE 'EEGEyeNet' END AS dataset FROM documents")
def dataset_tag(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("source", "^src1", "rsod-"), "^src2", "als-")
    return views.table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.dataset_of(name).alias("dataset"))


@query("SELECT user_id::BIGINT AS user_id, count(*)::BIGINT AS frames, (count(*) * 1000 // 109)::BIGINT AS fps, round(floor(count(*) / 500.0 * 1000) / 109.0, 8) AS real_time_factor, round(count(*) / 0.109, 6) AS throughput_pps FROM events GROUP BY user_id")
def throughput_rtf(spark: SparkSession, d: str) -> DataFrame:
    n = views.arrivals(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))
    ms = F.lit(109).cast("bigint")
    return n.select("user_id", "frames", stats.frames_per_second(F.col("frames"), ms).alias("fps"), F.round(stats.real_time_factor(F.col("frames"), F.lit(500.0), ms), 8).alias("real_time_factor"), F.round(stats.throughput_pps(F.col("frames"), ms), 6).alias("throughput_pps"))


@query("SELECT vec_id::BIGINT AS sequence_id, embedding[i]::DOUBLE AS value, i - 1 AS channel FROM embeddings, range(1, 17) t(i)")
def channel_prefix(spark: SparkSession, d: str) -> DataFrame:
    return views.eeg(spark, d).select("sequence_id", F.posexplode(F.slice("channels", 1, 16)).alias("channel", "v")).select("sequence_id", F.col("v").cast("double").alias("value"), F.col("channel").cast("bigint").alias("channel"))


@query("SELECT doc_id::BIGINT AS doc_id, (CASE WHEN n_chars <= 1 THEN 1 ELSE 1::BIGINT << length(bin(n_chars - 1)) END)::BIGINT AS window_size FROM documents")
def window_sizes(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), scalar.next_power_of_two(F.col("n_chars").cast("bigint")).alias("window_size"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").cast("bigint").alias("user_id"), "event_type", F.unix_micros(ts).alias("ts_us"), F.col("event_id").cast("bigint").alias("event_id"), "value", ts.alias("ts"))


def _folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors see it; of our own only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/run-{os.urandom(8).hex()}"


@query(f"WITH {ASOF} SELECT user_id, t AS ts_us, event_id, v AS value, matched AS matched_us, matched - t AS offset_us FROM m")
def stream_asof(spark: SparkSession, d: str) -> DataFrame:
    """The batch alignment's rows from streams that end."""
    folder, events = _folder(spark), _stream(spark, d)
    anchors = events.where("event_type = 'purchase'").select("user_id", "ts_us", "event_id", "ts")
    views_ = events.where("event_type = 'view'").select("user_id", "event_id", "value", "ts")
    out = stateful.stream_asof(anchors, views_, ["value"], ["user_id"], ends=stateful.end_marks(spark, folder))
    return stateful.drained(out, folder, ends=True).drop("ts")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT e.user_id::BIGINT AS user_id, e.rn AS window_end, round(sum(r.value), 4) AS total FROM r e JOIN r ON e.user_id = r.user_id AND r.rn > e.rn - 8 AND r.rn <= e.rn WHERE e.rn >= 8 AND e.rn % 4 = 0 GROUP BY ALL""")
def stream_hop(spark: SparkSession, d: str) -> DataFrame:
    return stateful.drained(stateful.stream_hops(_stream(spark, d)), _folder(spark)).withColumn("total", F.round("total", 4))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = stateful.drained(stateful.tumbling(_stream(spark, d)), _folder(spark), "complete")
    return out.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH k AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER o < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM k)
SELECT user_id::BIGINT AS user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    events = views.arrivals(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    return stateful.sessions(events, "6 hours").select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query(ORACLE["interval_join_tolerance"])
def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    buy = _stream(spark, d).where("event_type = 'purchase'").select("user_id", "event_id", "ts_us", F.col("ts").alias("buy_ts"))
    seen = _stream(spark, d).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts_us").alias("view_us"), F.col("ts").alias("view_ts"))
    near = stateful.within(buy, seen.withColumnRenamed("user_id", "view_user"), ("user_id", "view_user"), "buy_ts", "view_ts", "300 SECONDS")
    out = near.select("user_id", "event_id", "view_id", (F.col("view_us") - F.col("ts_us")).alias("offset_us"))
    return stateful.drained(out, _folder(spark))


def _recording(spark: SparkSession, d: str) -> str:
    """All frames of the test tables written as one recording, in the shared folder."""
    corec.register(spark)
    path = f"{_folder(spark)}/all.corec"
    corec.write_corec(path, RATE, 60.0, views.eeg(spark, d), views.gaze(spark, d))
    return path


def _frames(df: DataFrame) -> DataFrame:
    total = F.aggregate("channels", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select("sequence_id", "timestamp_ns", F.size("channels").cast("bigint").alias("n_channels"), F.round(total, 5).alias("total"))


@query("SELECT vec_id::BIGINT AS sequence_id, vec_id * 3906250::BIGINT AS timestamp_ns, len(embedding)::BIGINT AS n_channels, round(list_sum([x::DOUBLE for x in embedding]), 5) AS total FROM embeddings")
def corec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The EEG frames written as a recording and scanned back in small splits."""
    return _frames(spark.read.format("corec").option("framesPerPartition", 128).load(_recording(spark, d)))


@query(ORACLE["corec_roundtrip"])
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The recording followed as a stream."""
    stream = spark.readStream.format("corec").option("framesPerPartition", 4096).load(_recording(spark, d))
    return _frames(stateful.drained(stream, _folder(spark)))


@query("SELECT event_id::BIGINT AS idx, event_id * 16666667::BIGINT AS timestamp_ns, value::FLOAT AS x, user_id::FLOAT AS y, 3.0::FLOAT AS pupil_diameter FROM events")
def corec_gaze(spark: SparkSession, d: str) -> DataFrame:
    """All gaze frames of the recording, scanned back."""
    return spark.read.format("corec").options(section="gaze", framesPerPartition=8192).load(_recording(spark, d)).drop("recording")


@query("SELECT 'all.corec' AS recording, 256.0::DOUBLE AS sample_rate_hz, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS eeg_channels, 60.0::DOUBLE AS gaze_rate_hz, (SELECT count(*) FROM embeddings)::BIGINT AS num_eeg_frames, (SELECT count(*) FROM events)::BIGINT AS num_gaze_frames")
def corec_header(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.format("corec").option("section", "header").load(_recording(spark, d))


@query(_clamped("(SELECT count(*) FROM q)", "greatest(0, hi - 256)").rpartition("SELECT sequence_id, t AS")[0] + """, m AS (SELECT *, abs(g - t) AS off FROM c WHERE rk = 1),
buckets AS (SELECT CASE WHEN off = 0 THEN 0 ELSE length(bin(off)) - 1 END AS bucket, count(*) AS n FROM m GROUP BY 1),
run AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS run, sum(n) OVER () AS total FROM buckets),
w AS (SELECT p, (1::BIGINT << min(bucket)::INT) AS ns FROM run, (VALUES (50.0), (90.0), (99.0)) v(p) WHERE run >= greatest(1, ceil(total * p / 100)) GROUP BY p)
SELECT count(*)::BIGINT AS fused, (count(*) // 100)::BIGINT AS features, greatest(0, count(*) // 100 - 4)::BIGINT AS inferences, round(avg((off > 10000000)::INT) * 100, 8) AS degraded_percent, round(avg(off), 2) AS mean_alignment_ns,
  (SELECT ns FROM w WHERE p = 50) AS offset_p50_ns, (SELECT ns FROM w WHERE p = 90) AS offset_p90_ns, (SELECT ns FROM w WHERE p = 99) AS offset_p99_ns FROM m""")
def replay_bench(spark: SparkSession, d: str) -> DataFrame:
    """What the replay benchmark counts; its times are left out."""
    got = api.replay_bench(spark, _recording(spark, d))
    kinds = {"fused": "long", "features": "long", "inferences": "long", "degraded_percent": "double", "mean_alignment_ns": "double", **{f"offset_p{p}_ns": "long" for p in (50, 90, 99)}}
    row = spark.createDataFrame([tuple(got[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return row.withColumn("degraded_percent", F.round("degraded_percent", 8)).withColumn("mean_alignment_ns", F.round("mean_alignment_ns", 2))


@query("SELECT row_number() OVER (ORDER BY event_id) AS idx, (epoch_us(ts) - first_value(epoch_us(ts)) OVER (ORDER BY event_id)) * 1000 AS timestamp_ns, value::FLOAT AS x, user_id::FLOAT AS y, 3.0::FLOAT AS pupil_diameter FROM events")
def gaze_csv(spark: SparkSession, d: str) -> DataFrame:
    """The events as a text export, read back line by line."""
    path = _folder(spark)
    e = views.arrivals(spark, d).select(F.format_string("%d.%06d", F.floor(F.col("ts_us") / 1_000_000).cast("bigint"), F.pmod("ts_us", F.lit(1_000_000))).alias("t"), "value", "user_id", "event_id")
    e.repartition(1).sortWithinPartitions("event_id").drop("event_id").write.option("header", True).csv(path)  # an export is one file
    seconds = text.read_gaze_csv(spark, path)
    return seconds.select("idx", (F.round(F.col("timestamp_ns") / 1000) * 1000).cast("bigint").alias("timestamp_ns"), "x", "y", "pupil_diameter")


@query(f"""WITH w AS (SELECT vec_id::BIGINT AS sequence_id, list_concat([0.0 for i in range(12)], [x::DOUBLE for x in embedding[1:20]]) AS s FROM embeddings), p AS (SELECT sequence_id, {_spectrum_sql(32)} AS p FROM w),
bands AS (SELECT sequence_id, {_bands_sql(32, RATE)} FROM p) SELECT sequence_id, {', '.join(f'round({n}, 10) AS {n}' for n in [*NAMES, 'total'])} FROM bands""")
def padded_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Band powers of windows shorter than the transform: zeros stand before them."""
    df = views.eeg(spark, d).withColumn("s", signal.newest(F.transform(F.slice("channels", 1, 20), lambda x: x.cast("double")), 32)).withColumn("p", signal.power_spectrum(F.col("s"), 32))
    return df.select("sequence_id", *signal.band_powers(F.col("p"), 32, RATE)).select("sequence_id", *[F.round(n, 10).alias(n) for n in [*NAMES, "total"]])


@query("WITH r AS (SELECT vec_id::BIGINT + 1 AS rn, embedding FROM embeddings), e AS (SELECT rn AS w FROM r WHERE rn >= 50 AND rn % 25 = 0) SELECT w AS window_end, (len(embedding) * 50)::BIGINT AS n_values, round(sum(embedding[1]::DOUBLE * (rn - w + 50)), 5) AS weighted FROM e JOIN r ON rn > w - 50 AND rn <= w GROUP BY w, len(embedding)")
def model_input_windows(spark: SparkSession, d: str) -> DataFrame:
    """Channel-major model windows; the weighted sum holds the first channel's order."""
    frames = views.eeg(spark, d).withColumn("rn", F.col("sequence_id") + 1).withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "pupil_diameter": F.lit(3.0)})
    out = packets.model_windows(frames, 50, 25)
    first = F.slice("eeg", 1, 50)
    weighted = F.aggregate(F.transform(first, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return out.select("window_end", F.size("eeg").cast("bigint").alias("n_values"), F.round(weighted, 5).alias("weighted"))
