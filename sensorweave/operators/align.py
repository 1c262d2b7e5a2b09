"""Nearest-timestamp alignment of two streams.

``left`` rows are anchors; each takes the ``right`` row nearest in time: of the
last at or before it and the first after it the closer one, the earlier on ties.
Of equal right timestamps the last counts before an anchor and the first after
it, in ``idx`` order.  Anchors without any candidate are dropped (inner join).
Results hold the anchor's columns, the right row's ``right_cols``, its time as
``matched_ns`` and ``alignment_offset_ns`` = matched - anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import cell_of, with_global_row_number, with_row_number

DEGRADED_MS = 10.0
#: Recordings are cut into buckets of a minute where nothing else is asked for.
MINUTE_NS = 60_000_000_000


def _neighbours(left: DataFrame, right: DataFrame, by: list[str], ts: str, left_idx: str, right_idx: str, right_cols: list[str]) -> DataFrame:
    """Anchors with ``__before`` and ``__after`` structs (ts, idx, right_cols).

    Every right row first learns its successor, so one pass over both streams in
    time order gives the last row at or before an anchor and, through it, the
    first one after.  A frame to the end of the partition would be quadratic.
    """
    held = F.struct(F.col(ts).alias("ts"), F.col(right_idx).alias("idx"), *right_cols)
    successor = F.lead(held).over(Window.partitionBy(*by).orderBy(ts, right_idx))
    r = right.select(*by, F.col(ts).alias("__t"), F.lit(0).alias("__k"), F.col(right_idx).cast("bigint").alias("__i"), F.struct(held.alias("at"), successor.alias("next")).alias("__r"))
    row = F.struct(*left.columns)
    anchors = left.select(*by, F.col(ts).alias("__t"), F.lit(1).alias("__k"), F.col(left_idx).cast("bigint").alias("__i"), row.alias("__l"))
    both = r.unionByName(anchors, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__k", "__i")
    last = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = both.select("*", last.alias("__last"), first.alias("__first")).where("__k = 1")
    after = F.when(F.col("__last").isNull(), F.col("__first.at")).otherwise(F.col("__last.next"))
    return near.select(*by, "__l", F.col("__last.at").alias("__before"), after.alias("__after"))


def _nearest(df: DataFrame, ts: Column, before: Column, after: Column, columns: list[Column], right_cols: list[str]) -> DataFrame:
    later = after.isNotNull() & (before.isNull() | (after["ts"] - ts < ts - before["ts"]))
    df = df.select("*", F.when(later, after).otherwise(before).alias("__m")).where("__m IS NOT NULL")
    return df.select(*columns, *[F.col("__m")[c].alias(c) for c in right_cols], F.col("__m")["ts"].alias("matched_ns"), (F.col("__m")["ts"] - ts).alias("alignment_offset_ns"))


def asof_nearest(left: DataFrame, right: DataFrame, right_cols: list[str], by: list[str] = [], ts: str = "timestamp_ns", left_idx: str = "sequence_id", right_idx: str = "idx") -> DataFrame:  # noqa: B006
    """The alignment within each key of ``by``."""
    near = _neighbours(left, right, by, ts, left_idx, right_idx, right_cols)
    t = F.col("__l")[ts]
    return _nearest(near, t, F.col("__before"), F.col("__after"), [F.col("__l")[c].alias(c) for c in left.columns], right_cols)


def asof_nearest_bucketed(left: DataFrame, right: DataFrame, right_cols: list[str], width_ns: int, by: list[str] = [], ts: str = "timestamp_ns", left_idx: str = "sequence_id", right_idx: str = "idx") -> DataFrame:  # noqa: B006
    """The same for few, very long recordings: time is cut into buckets that align in parallel."""
    near = _bucketed(left, right, width_ns, by, ts, left_idx, right_idx, right_cols)
    t = F.col("__l")[ts]
    return _nearest(near, t, F.col("__before"), F.col("__after"), [F.col("__l")[c].alias(c) for c in left.columns], right_cols)


def _bucketed(left: DataFrame, right: DataFrame, width: int, by: list[str], ts: str, left_idx: str, right_idx: str, right_cols: list[str]) -> DataFrame:
    """Anchors with their neighbours, as above, bucket by bucket.

    What a bucket needs of the others, the last right row before it and the first
    after it, comes from a table with one row for each bucket.
    """
    cut = cell_of(ts, width)
    keys = [*by, "__bucket"]
    l, r = left.withColumn("__bucket", cut), right.withColumn("__bucket", cut)
    held = F.struct(F.col(ts).alias("ts"), F.col(right_idx).alias("idx"), *right_cols)
    place = F.struct(F.col(ts), F.col(right_idx))
    ends = r.groupBy(*keys).agg(F.min_by(held, place).alias("first"), F.max_by(held, place).alias("last"))
    table = l.select(*keys).distinct().join(ends, keys, "full_outer")
    w = Window.partitionBy(*by)
    before = F.last("last", ignorenulls=True).over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(w.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1))
    carried = table.select(*keys, before.alias("__carried_before"), after.alias("__carried_after"))
    near = _neighbours(l, r, keys, ts, left_idx, right_idx, right_cols).join(carried, keys, "left")
    return near.select(*by, "__l", F.coalesce("__before", "__carried_before").alias("__before"), F.coalesce("__after", "__carried_after").alias("__after"))


def asof_buffered(left: DataFrame, right: DataFrame, right_cols: list[str], mode: str, rate_ratio: float = 1.0, cap: int = 256, by: list[str] = [], ts: str = "timestamp_ns", left_idx: str = "sequence_id", right_idx: str = "idx", width: int | None = None, limits: tuple[str, str] | None = None) -> DataFrame:  # noqa: B006
    """Alignment against a bounded FIFO of right rows, as a clamp of row numbers.

    ``replay``: before the i-th anchor floor((i + 1) * rate_ratio) right rows have
    been pushed.  ``live``: one with the first anchor and with every ``rate_ratio``-th
    after it.  ``bench``: all of them have.  The newest ``cap`` (at least one)
    are visible; ordered input makes them a range [lo, hi) of row numbers.  With
    ``width``, or without keys, rows are numbered and aligned by buckets of so much
    time, else key by key, which needs no shuffle but by key.  ``limits`` names two of the
    anchors' columns that hold each one's rate ratio and cap.
    """
    if mode not in ("replay", "live", "bench"):
        raise ValueError(mode)
    number = lambda df, name, idx: with_row_number(df, ts, by, name, [idx]) if width is None and by else with_global_row_number(df, ts, width or MINUTE_NS, name, by, [idx])
    numbered = number(right, "__n", right_idx).withColumn("__n", F.col("__n") - 1)
    anchors = number(left, "__row", left_idx)
    if width is None and by:
        near = _neighbours(anchors, numbered, by, ts, left_idx, right_idx, ["__n"])
    else:
        near = _bucketed(anchors, numbered, width or MINUTE_NS, by, ts, left_idx, right_idx, ["__n"])
    ratio, most = (F.col("__l")[c] for c in limits) if limits else (F.lit(rate_ratio), F.lit(cap))
    most = F.greatest(most.cast("bigint"), F.lit(1))
    total = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))
    near = near.join(total, by, "left") if by else near.crossJoin(total)  # one row without keys
    row = F.col("__l")["__row"]
    pushed = {"replay": F.floor(row * ratio).cast("bigint"), "live": F.floor((row - 1) / ratio).cast("bigint") + 1, "bench": F.col("__total")}[mode]
    near = near.withColumn("__hi", F.least(F.coalesce("__total", F.lit(0)), pushed)).withColumn("__lo", F.greatest(F.lit(0), F.col("__hi") - most)).where("__hi > 0")
    at = F.coalesce(F.col("__before")["__n"], F.lit(-1))
    low, high = F.least(at, F.col("__hi") - 1), F.greatest(at + 1, F.col("__lo"))
    near = near.select(*by, "__l", F.when(low >= F.col("__lo"), low).alias("__b"), F.when(high < F.col("__hi"), high).alias("__a"))
    held = F.struct(F.col(ts).alias("ts"), *right_cols)
    for number, name in (("__b", "__before"), ("__a", "__after")):
        near = near.join(numbered.select(*by, F.col("__n").alias(number), held.alias(name)), [*by, number], "left")
    t = F.col("__l")[ts]
    return _nearest(near, t, F.col("__before"), F.col("__after"), [F.col("__l")[c].alias(c) for c in left.columns], right_cols)


def with_degraded(df: DataFrame, max_ms: float = DEGRADED_MS) -> DataFrame:
    """``degraded``: the offset is larger than the limit; the row stays."""
    return df.withColumn("degraded", F.abs("alignment_offset_ns") > int(max_ms * 1e6))


def alignment_metrics(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """frames_fused, mean_alignment_ns and degraded_fraction, 0.0 where nothing was fused."""
    return with_degraded(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames_fused"),
        F.coalesce(F.avg(F.abs("alignment_offset_ns").cast("double")), F.lit(0.0)).alias("mean_alignment_ns"),
        F.coalesce(F.avg(F.col("degraded").cast("double")), F.lit(0.0)).alias("degraded_fraction"),
    )


def interval_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, tolerance: int) -> DataFrame:
    """All pairs within ``tolerance``; both sides share time cells, so it is an equi-join on key and cell."""
    cell = lambda c: F.floor(c / (tolerance + 1)).cast("bigint")
    l = left.withColumn("__cell", cell(F.col(ts)))
    r = right.withColumn("__cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(F.col(right_ts)) + d)))
    return l.join(r, [*by, "__cell"]).where(F.abs(F.col(ts) - F.col(right_ts)) <= tolerance).drop("__cell")
