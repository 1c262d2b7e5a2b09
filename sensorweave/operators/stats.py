"""Aggregates of self-measurement, all of built-in functions that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import log2_bucket
from .windows import cell_of

LARGEST = (1 << 63) - 1


def welford(value: Column, prefix: str = "") -> list[Column]:
    """count, mean, variance (n - 1) and standard deviation; 0.0 where undefined."""
    x = value.cast("double")
    return [
        F.count(x).alias(f"{prefix}count"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{prefix}mean"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias(f"{prefix}variance"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{prefix}std_dev"),
    ]


def log2_histogram(df: DataFrame, ns: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """bucket = floor(log2 ns) and n; 64 rows a key at most."""
    return df.groupBy(*by, log2_bucket(F.col(ns)).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentiles(hist: DataFrame, percents: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """p and ns: the lower bound of the first bucket with running count >= max(1, ceil(n p / 100))."""
    w = Window.partitionBy(*by)
    ran = hist.withColumn("running", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    wanted = ran.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    reached = wanted.where(F.col("running") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("p") / 100)))
    lower = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.min("bucket").cast("int"))
    return reached.groupBy(*by, "p").agg(lower.alias("ns"))


def latency_summary(ns: Column) -> list[Column]:
    """count, integer mean of a saturating sum, min and max; 0 where empty."""
    total = F.least(F.sum(ns.cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint")
    n = F.count(ns)
    return [
        n.alias("count"),
        F.coalesce(_div(total, n), F.lit(0).cast("bigint")).alias("mean_ns"),
        F.coalesce(F.min(ns), F.lit(0).cast("bigint")).alias("min_ns"),
        F.coalesce(F.max(ns), F.lit(0).cast("bigint")).alias("max_ns"),
    ]


def _whole(a: Column, b: Column) -> Column:
    """a DIV b for non-negative whole numbers."""
    return F.call_function("div", a, F.nullif(b, F.lit(0))).cast("bigint")


def _div(total: Column, n: Column) -> Column:
    """Integer division, null for an empty group."""
    return F.when(n > 0, _whole(total, n))


def intervals(df: DataFrame, ts: str, by: list[str] = [], order: list[str] | None = None, width: int | None = None) -> DataFrame:  # noqa: B006
    """``interval``: the time since the row before in arrival order, at least 0; the first row of a key has none.

    With ``width`` the rows go to cells of so much of the first order column; what
    a cell's first row follows comes from a table with one row a cell.
    """
    order = order or [ts]
    if width is None:
        before = F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    else:
        keys = [*by, "__cell"]
        df = df.withColumn("__cell", cell_of(order[0], width))
        ends = df.groupBy(*keys).agg(F.max_by(ts, F.struct(*order)).alias("__end"))
        ends = ends.select(*keys, F.lag("__end").over(Window.partitionBy(*by).orderBy("__cell")).alias("__carried"))
        df = df.join(ends, keys)
        before = F.coalesce(F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order)), "__carried")
    step = F.col(ts) - before
    return df.withColumn("interval", F.when(step.isNotNull(), F.greatest(step, F.lit(0)))).drop("__cell", "__carried")


def jitter(df: DataFrame, ts: str, by: list[str] = [], order: list[str] | None = None, width: int | None = None) -> DataFrame:  # noqa: B006
    """mean_interval, jitter_std_dev and n_intervals."""
    n, mean, _, sd = welford(F.col("interval"))
    return intervals(df, ts, by, order, width).groupBy(*by).agg(mean.alias("mean_interval"), sd.alias("jitter_std_dev"), n.alias("n_intervals"))


def picked_percentiles(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sorted picks: median, stdev (n > 1), p95 = sorted[int(n .95)] (n > 20), p99 = sorted[int(n .99)] (n > 100), else 0.

    Values are counted in cells a 64th of a power of two wide; only the cells that
    hold a wanted rank are sorted.
    """
    v = F.col("v")
    size = F.floor(F.log2(F.abs(v)) * 64) + (1 << 20)
    cell = F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL").withColumn("cell", cell)
    summary = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"))
    w = Window.partitionBy(*by).orderBy("cell")
    counted = rows.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    n = F.col("total")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.when(n > 20, F.floor(n * 0.95)), "p99": F.when(n > 100, F.floor(n * 0.99))}
    wanted = counted.select(*by, "cell", "n", "upto", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])).alias("want"))
    wanted = wanted.where("want.rank < upto AND want.rank >= upto - n").select(*by, "cell", "want.name", (F.col("want.rank") - F.col("upto") + F.col("n")).alias("i"))
    cells = wanted.select(*by, "cell").distinct()
    inside = rows.join(cells, [*by, "cell"]).withColumn("i", (F.row_number().over(Window.partitionBy(*by, "cell").orderBy("v")) - 1).cast("bigint"))
    found = inside.join(wanted, [*by, "cell", "i"])
    pick = lambda k: F.max(F.when(F.col("name") == k, v)).alias(k)
    picks = found.groupBy(*by).agg(*map(pick, ranks))
    out = summary.join(picks, by, "left") if by else summary.crossJoin(picks)  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*by, "count", "mean", zero((F.col("low") + F.col("high")) / 2).alias("median"), "stdev", zero(F.col("p95")).alias("p95"), zero(F.col("p99")).alias("p99"))


def rate_from_times(df: DataFrame, ts: str, fallback: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``rate``: 1 / median of the differences of successive times in seconds, or the fallback for one row."""
    w = Window.partitionBy(*by).orderBy(ts)
    steps = df.select(*by, (F.col(ts) - F.lag(ts).over(w)).alias("step"))
    return steps.groupBy(*by).agg(F.coalesce(1.0 / F.nullif(F.median("step"), F.lit(0.0)), F.lit(fallback)).alias("rate"))


def throughput_pps(received: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, received / (duration_ms / 1000.0)).otherwise(0.0)


def frames_per_second(frames: Column, ms: Column) -> Column:
    """Whole frames a second."""
    return F.when(ms > 0, _whole(frames * 1000, ms)).otherwise(F.lit(0).cast("bigint"))


def real_time_factor(frames: Column, rate_hz: Column, ms: Column) -> Column:
    """Recorded time, in whole ms, over the time taken."""
    return F.when(ms > 0, F.floor(frames / rate_hz * 1000).cast("double") / ms).otherwise(0.0)


def loss_fraction(sent: Column, dropped: Column, decode_errors: Column) -> Column:
    return F.when(sent > 0, (dropped + decode_errors) / sent.cast("double")).otherwise(0.0)


def loss_percent(sent: Column, received: Column) -> Column:
    return F.when(sent > 0, (sent - received) / sent.cast("double") * 100.0).otherwise(0.0)
