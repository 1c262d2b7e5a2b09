"""Count-based windows: sliding, hopping, ring order, sampling, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_of(order: str, width: int) -> Column:
    """The cell of a number, cells being ``width`` wide; nulls have one before all others."""
    return F.coalesce(F.floor(F.col(order) / width).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))


def with_row_number(df: DataFrame, order: str, by: list[str] = [], name: str = "rn", ties: list[str] = []) -> DataFrame:  # noqa: B006
    """1-based row numbers within ``by``.  Without keys, or for few long ones, use :func:`with_global_row_number`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties)).cast("bigint"))


def with_global_row_number(df: DataFrame, order: str, width: int, name: str = "rn", by: list[str] = [], ties: list[str] = []) -> DataFrame:  # noqa: B006
    """1-based row numbers over the whole table, or each key of ``by``, without one task seeing all of it.

    Rows are numbered by ``order`` (a number), then ``ties``, in cells of the
    given width; the cells' counts, one row each, give the offsets.
    """
    keys = [*by, "__cell"]
    celled = df.withColumn("__cell", cell_of(order, width))
    counts = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))
    return celled.withColumn(name, inside).join(offsets, keys).select(*[c for c in df.columns if c != name], (F.col(name) + F.col("__offset")).cast("bigint").alias(name))


def sliding(df: DataFrame, value: str, size: int, order: str, by: list[str] = [], name: str = "window") -> DataFrame:  # noqa: B006
    """The last ``size`` values in order, only once as many have come."""
    w = Window.partitionBy(*by).orderBy(order)
    full = df.withColumn("__rn", F.row_number().over(w)).withColumn(name, F.collect_list(value).over(w.rowsBetween(-(size - 1), 0)))
    return full.where(F.col("__rn") >= size).drop("__rn")


def sliding_ranges(df: DataFrame, value: str, size: int, rn: str = "rn", span: int = 8192, name: str = "window") -> DataFrame:
    """The last ``size`` values by dense row number, once as many have come, of one long stream.

    Ranges of ``span`` row numbers are windowed apart; the last ``size`` - 1 rows
    of a range also go, as copies, to the next one.
    """
    span = max(span, size)
    at = F.floor(F.col(rn) / span).cast("bigint")
    ranges = F.when(F.pmod(F.col(rn), F.lit(span)) > span - size, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = df.select("*", F.explode(ranges).alias("__range"))
    w = Window.partitionBy("__range").orderBy(rn).rowsBetween(-(size - 1), 0)
    full = dealt.withColumn(name, F.collect_list(value).over(w)).where((F.floor(F.col(rn) / span) == F.col("__range")) & (F.size(name) == size))
    return full.drop("__range")


def hop_members(df: DataFrame, size: int, stride: int, rn: str = "rn") -> DataFrame:
    """Every row once for each window it belongs to, as ``window_end`` (a row number) and ``slot`` (0-based, in order).

    Windows end at row numbers that are multiples of ``stride`` and at least
    ``size``.  A row goes to at most ceil(size / stride) windows, so a grouped
    aggregation over (keys, window_end) needs no window frame.
    """
    first = F.ceil(F.greatest(F.col(rn), F.lit(size)) / stride).cast("bigint") * stride
    last = F.floor((F.col(rn) + size - 1) / stride).cast("bigint") * stride
    ends = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint")))
    return df.withColumn("window_end", F.explode(ends)).withColumn("slot", F.col(rn) - F.col("window_end") + size - 1)


def complete_windows(members: DataFrame, size: int, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of windows that are full; those the stream ended in are left out."""
    grouped = members.groupBy(*keys, "window_end").agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    return grouped.where(F.col("n_rows") == size)


def ring_slot(rn: Column, size: int) -> Column:
    """Where a fixed ring that is never rotated holds row ``rn`` (1-based)."""
    return F.pmod(rn - 1, F.lit(size)).cast("bigint")


def sample_every(df: DataFrame, n: int, rn: str = "rn", zero_based: bool = False) -> DataFrame:
    """Every n-th row, counting from 1 or from 0."""
    return df.where(F.pmod(F.col(rn) - (1 if zero_based else 0), F.lit(n)) == 0)


def rebased(df: DataFrame, ts: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Times relative to the first of each key."""
    return df.withColumn(ts, F.col(ts) - F.min(ts).over(Window.partitionBy(*by)))


def linspace_index(i: Column, n: int, length: int) -> Column:
    """The truncated i-th of n evenly spaced indices over ``length`` rows."""
    if n == 1:
        return F.lit(0).cast("bigint")
    return F.floor(i.cast("double") * (length - 1) / (n - 1)).cast("bigint")
