"""Stateful stream operators: as-of alignment, count windows, monitoring windows, fan-out."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_STATE = "times array<long>, places array<long>, rows array<string>, p_times array<long>, p_places array<long>, p_rows array<string>"
_HOP_STATE = "seen long, held array<double>"
END = "__time timestamp"


def _nearest(times: list[tuple], t: int) -> int | None:
    """Which of the (time, place) sorted rows an anchor at ``t`` takes: the last at or before it or the first after it, the earlier on ties."""
    after = bisect.bisect_right(times, (t, 1 << 63))
    if after == len(times) or (after and t - times[after - 1][0] <= times[after][0] - t):
        return after - 1 if after else None
    return after


def stream_asof(anchors: DataFrame, stream: DataFrame, right_cols: list[str], by: list[str], time: str = "ts", late: str = "10 minutes", left_idx: str = "event_id", right_idx: str = "event_id", ends: DataFrame | None = None) -> DataFrame:
    """The nearest alignment of two streams within each key: the anchors' columns, ``right_cols``, matched_us and offset_us.

    An anchor is given out once no row that is still to come can be nearer: rows
    behind the watermark are late and take no part, so what comes lies at or
    beyond it.  State holds the rows from the watermark on, the last one before it
    and the pending anchors; the watermark's passing flushes keys without new
    rows.  ``ends`` (see :func:`end_marks`) closes the streams: the anchors that
    are still pending take the nearest row known.
    """
    left_cols = [c for c in anchors.columns if c not in by]
    packed = lambda cols: F.to_json(F.struct(*cols), _STAMPS)
    row = lambda df, anchor, idx, cols: df.select(*by, F.lit(anchor).alias("__anchor"), F.col(time).alias("__time"), F.unix_micros(time).alias("__us"), F.col(idx).cast("bigint").alias("__place"), packed(cols).alias("__row"))
    both = row(anchors, True, left_idx, left_cols).unionByName(row(stream, False, right_idx, right_cols))
    if ends is not None:
        both = both.unionByName(ends, allowMissingColumns=True)

    def align(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = [], []
        if state.exists:
            times, places, rows, p_times, p_places, p_rows = state.get
            held, waiting = list(zip(times, places, rows, strict=True)), list(zip(p_times, p_places, p_rows, strict=True))
        passed = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            for anchor, us, place, body in zip(batch["__anchor"], batch["__us"], batch["__place"], batch["__row"], strict=True):
                if not pd.isna(us) and us >= passed:  # else an end mark, or late
                    (waiting if anchor else held).append((int(us), int(place), body))
        held.sort(key=lambda r: r[:2])
        waiting.sort(key=lambda r: r[:2])
        times = [r[:2] for r in held]
        out, left, wake = [], [], None
        for t, place, body in waiting:
            at = _nearest(times, t)
            if at is not None and (abs(times[at][0] - t) <= passed - t if times[at][0] <= t else times[at][0] < passed):
                out.append((*key, body, held[at][2], t, times[at][0]))
            else:
                left.append((t, place, body))
                if at is not None:
                    due = max(t + abs(times[at][0] - t), times[at][0]) + 1
                    wake = due if wake is None else min(wake, due)
        first = min([passed, *(t for t, _, _ in left)])  # what lies before is needed no more, but for the last of it
        keep = max(bisect.bisect_right(times, (first, 1 << 63)) - 1, 0)
        state.update(tuple([*c] for part in (held[keep:], left) for c in (zip(*part, strict=True) if part else ((), (), ()))))
        if wake is not None:
            state.setTimeoutTimestamp(max(-(-wake // 1000), passed // 1000 + 1))
        yield pd.DataFrame(out, columns=[*by, "l", "r", "us", "matched_us"])

    keys = [anchors.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("l", T.StringType()), T.StructField("r", T.StringType()), T.StructField("us", T.LongType()), T.StructField("matched_us", T.LongType())])
    found = both.withWatermark("__time", late).groupBy(*by).applyInPandasWithState(align, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    unpacked = lambda c, df, cols: F.from_json(c, T.StructType([df.schema[x] for x in cols]), _STAMPS).alias(c)
    found = found.select(*by, unpacked("l", anchors, left_cols), unpacked("r", stream, right_cols), "us", "matched_us")
    return found.select(*by, *[F.col("l")[c].alias(c) for c in left_cols], *[F.col("r")[c].alias(c) for c in right_cols], "matched_us", (F.col("matched_us") - F.col("us")).alias("offset_us"))


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that is empty until :func:`end_streams` is called for the folder."""
    spark.createDataFrame([], END).write.mode("append").parquet(f"{folder}/end")
    return spark.readStream.schema(END).parquet(f"{folder}/end")


def end_streams(spark: SparkSession, folder: str) -> None:
    """Move the watermark beyond all times, to the last year that pandas knows."""
    spark.range(1).select(F.lit("2262-01-01").cast("timestamp").alias("__time")).write.mode("append").parquet(f"{folder}/end")


def stream_hops(events: DataFrame, value: str = "value", by: list[str] = ["user_id"], order: list[str] = ["ts_us", "event_id"], size: int = 8, stride: int = 4) -> DataFrame:  # noqa: B006
    """window_end and the sum of ``value`` over each key's last ``size`` rows, every ``stride`` rows; state is one window.

    Rows of a micro-batch are taken by ``order``.
    """

    def hop(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (0, [])
        held = deque(held, maxlen=size)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in rows["__value"]:
            seen += 1
            held.append(float(x))
            if seen >= size and seen % stride == 0:
                out.append((*key, seen, sum(held)))
        state.update((seen, list(held)))
        yield pd.DataFrame(out, columns=[*by, "window_end", "total"])

    schema = T.StructType([*(events.schema[c] for c in by), T.StructField("window_end", T.LongType()), T.StructField("total", T.DoubleType())])
    cut = events.select(*dict.fromkeys([*by, *order]), F.col(value).cast("double").alias("__value"))
    return cut.groupBy(*by).applyInPandasWithState(hop, schema, _HOP_STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Rows and value sum for each event type and time window, late rows beyond the watermark left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Activity sessions of each user."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def within(left: DataFrame, right: DataFrame, keys: tuple[str, str], left_time: str, right_time: str, tolerance: str, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of rows of one key within a tolerance; both watermarks bound the state.  Names must differ."""
    l, r = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    near = F.expr(f"{right_time} BETWEEN {left_time} - INTERVAL {tolerance} AND {left_time} + INTERVAL {tolerance}")
    return l.join(r, (F.col(keys[0]) == F.col(keys[1])) & near)


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One query that hands every micro-batch to several sinks, computed once."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def drained(stream: DataFrame, folder: str, mode: str = "append", ends: bool = False) -> DataFrame:
    """Run a stream over what its source holds now and give the result as a table; ``ends`` then closes its :func:`end_marks`."""
    spark = stream.sparkSession
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")
    for last in (False, True) if ends else (True,):
        out = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
        query = out.format("parquet").option("path", f"{folder}/out").start() if mode == "append" else out.foreachBatch(write).start()
        query.awaitTermination()
        if not last:
            end_streams(spark, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
