"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a key belongs to the first
point clockwise of its hash.  Each shard has a fixed capacity, and a key whose
shard is full continues clockwise to the next point whose shard has room.

The rule is applied in bulk.  Keys are first counted per ring cell (the arcs
between points, cut further at fixed positions); this table is bounded by the
ring's parameters, whatever the number of rows.  The driver walks the ring over
these counts, arcs first taking their own keys and the overflow then moving on,
and gets a list of (first key, last key, shard, first slot) intervals.  Rows
find their interval from their rank in their cell.  The result equals inserting
the keys one by one: those that their home shard takes in ring order, then the
overflow in ring order (tests/llm/test_sharding.py does just that).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A frequent key's rows are ranked in so many parts at most.
PARTS = 4096


@dataclass(frozen=True)
class Ring:
    """``vnodes`` points a shard; ``cells`` fixed cuts bound the rows that are ranked together."""

    shards: int
    vnodes: int = 256
    cells: int = 16384
    seed: int = 7

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ring order and their shards."""
        named = [(xxhash.xxh3_64_intdigest(f"{s}/{v}".encode(), self.seed), s) for s in range(self.shards) for v in range(self.vnodes)]
        named.sort()
        return np.array([p for p, _ in named], np.uint64), np.array([s for _, s in named], np.int64)

    def cuts(self) -> np.ndarray:
        """All cell boundaries in ring order: the points and the fixed cuts."""
        step = (1 << 64) // self.cells
        return np.unique(np.concatenate([self.points()[0], np.arange(1, self.cells, dtype=np.uint64) * np.uint64(step)]))

    def cell_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts(), position, side="left")

    def cell_owner(self) -> np.ndarray:
        """For each cell the index of the ring point that its keys belong to."""
        points, _ = self.points()
        cuts = np.append(self.cuts(), np.uint64(0xFFFFFFFFFFFFFFFF))
        return np.searchsorted(points, cuts, side="left") % len(points)


def position(key: Column) -> Column:
    """Ring position of a key as a signed long; ``unsigned`` turns it into the ring's order."""
    return F.xxhash64(key, F.lit("ring"))


def unsigned(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64)


def capacities(total: int, shards: int, load_factor: float | None) -> list[int]:
    """Rows that each shard may hold: equal shares if ``load_factor`` is None, else ceil(load_factor * mean)."""
    if load_factor is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    return [int(-(-total * load_factor // shards))] * shards


def place(ring: Ring, counts: np.ndarray, load_factor: float | None) -> list[tuple[int, int, int, int]]:
    """Intervals (first, end, shard, slot) over the keys numbered in cell order."""
    _, shard_of = ring.points()
    owner = ring.cell_owner()
    room = capacities(int(counts.sum()), ring.shards, load_factor)
    filled = [0] * ring.shards
    first = np.concatenate(([0], np.cumsum(counts)))
    out: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []

    def take(start: int, n: int, shard: int) -> None:
        out.append((start, start + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for cell in np.flatnonzero(counts).tolist():
        start, n, point = int(first[cell]), int(counts[cell]), int(owner[cell])
        shard = int(shard_of[point])
        fits = min(n, room[shard])
        if fits:
            take(start, fits, shard)
        if fits < n:
            over.append((start + fits, n - fits, point))
    order = shard_of.tolist()
    for start, n, point in over:
        while n:
            point = (point + 1) % len(order)
            if fits := min(n, room[order[point]]):
                take(start, fits, order[point])
                start, n = start + fits, n - fits
    return sorted(out)


def ring_shards(df: DataFrame, key: str, ring: Ring, load_factor: float | None = None, ties: list[Column] | None = None, most_rows: int = 100_000) -> DataFrame:
    """``df`` with columns ``shard`` int and ``slot`` long (gapless from 0 in a shard).

    ``load_factor`` None makes shard counts differ by one at most; a larger one
    keeps more keys at home.  Null keys are one key.  Rows with equal keys are
    told apart by ``ties``; equal rows are interchangeable.  An empty table
    gives an empty table.  Existing columns ``shard`` and ``slot`` are replaced,
    all others pass through, whatever they are called.

    A cell of more than ``most_rows`` rows, and of four times the mean, holds a
    frequent key: its rows are ranked in parts, by their ties' hash.
    """

    @F.pandas_udf("int")
    def cell(p: pd.Series) -> pd.Series:
        return pd.Series(ring.cell_of(unsigned(p.to_numpy())).astype("int32"))

    ties = ties or []
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), position(F.col(key)).alias("position"), *[t.alias(f"tie{i}") for i, t in enumerate(ties)])
    rows = rows.withColumn("cell", cell("position"))
    counted = rows.groupBy("cell").count().toPandas()
    counts = np.zeros(len(ring.cuts()) + 1, np.int64)
    counts[counted["cell"].to_numpy(dtype=np.int64)] = counted["count"].to_numpy(dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(counts)))
    spans = place(ring, counts, load_factor)
    starts = np.array([s for s, _, _, _ in spans], np.int64)
    shard_of = np.array([s for _, _, s, _ in spans], np.int64)
    slot_of = np.array([s for _, _, _, s in spans], np.int64)
    hot = [(int(c), int(min(PARTS, -(-n // most_rows)))) for c, n in enumerate(counts.tolist()) if n > max(most_rows, 4 * counts.mean())]
    first = {(c, 0): int(base[c]) for c in range(len(counts))}
    if hot:
        parts = F.create_map(*[F.lit(x) for pair in hot for x in pair])
        bits = F.shiftrightunsigned(F.xxhash64(*[f"tie{i}" for i in range(len(ties))], F.lit("part")), 33)
        rows = rows.withColumn("part", F.coalesce(F.floor(bits * F.try_element_at(parts, F.col("cell")) / (1 << 31)), F.lit(0)).cast("int"))
        sizes = {(r["cell"], r["part"]): r["count"] for r in rows.where(F.col("cell").isin([c for c, _ in hot])).groupBy("cell", "part").count().collect()}
        for c, n in hot:
            at = int(base[c])
            for k in range(n):
                first[c, k] = at
                at += sizes.get((c, k), 0)
    else:
        rows = rows.withColumn("part", F.lit(0))
    numbers = np.array(sorted(c * PARTS + k for c, k in first), np.int64)
    offsets = np.array([first[divmod(int(x), PARTS)] for x in numbers], np.int64)

    @F.pandas_udf("shard int, slot long")
    def placed(c: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        number = offsets[np.searchsorted(numbers, c.to_numpy().astype(np.int64) * PARTS + part.to_numpy())] + rank.to_numpy() - 1
        at = np.searchsorted(starts, number, side="right") - 1
        return pd.DataFrame({"shard": shard_of[at].astype("int32"), "slot": slot_of[at] + number - starts[at]})

    place_in = Window.partitionBy("cell", "part").orderBy("position", *[f"tie{i}" for i in range(len(ties))])
    ranked = rows.withColumn("rank", F.row_number().over(place_in)).select("row", placed("cell", "part", "rank").alias("placed"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    return ranked.select(*kept, F.col("placed.shard").alias("shard"), F.col("placed.slot").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    A null text has size 1 and the checksum of an empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring_shards(light, "doc_id", Ring(shards), ties=[F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
