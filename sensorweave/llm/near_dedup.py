"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every text becomes the set of its five-word shingles and a MinHash signature
   of ``bands * rows`` 16-bit values.  Documents of the same words in the same
   order (by 128 bits of their SHA-256) are one node from here on, named by their
   smallest doc_id; others are compared, however alike.
2. Nodes that agree in a band share a bucket.  Each bucket's smallest node leads
   it, and every member is compared with the leader: as many pairs as members.
3. Buckets whose other members still lie in several components are compared
   among themselves, but only across components: every pair of a bucket is
   either compared or already connected.  Such a bucket is dealt out by pairs of
   hash blocks of some ``block`` members and ``mass`` shingles at most, so no task
   holds more than two blocks of it, and each group of two blocks gives only
   links that connect its components, never its pairs.
4. A comparison goes through the signatures in batches of ``batch`` values.
   After n values with m agreeing, the posterior probability (uniform prior)
   that the similarity reaches the threshold is the binomial probability of at
   most m hits in n + 1 tries; a pair below ``miss`` is pruned.  Survivors are
   compared on their full shingle sets.
5. Verified links give connected components.

A pair at the threshold shares no band with probability
(1 - threshold**rows)**bands, 4e-6 at the defaults.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .words import WordHashes, lower_words, mixed, shingle_set
from .workers import kept


@dataclass(frozen=True)
class NearDup:
    percent: int = 85
    k: int = 5
    bands: int = 32
    rows: int = 7
    batch: int = 32
    miss: float = 1e-5
    block: int = 512
    mass: int = 1 << 20
    seed: int = 20240601

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 32, self.size, dtype=np.uint32) | np.uint32(1)
        return a, rng.integers(0, 1 << 32, self.size, dtype=np.uint32)

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, matches that a pair needs to go on) batch by batch."""
        t = self.percent / 100
        out = []
        for n in [*range(self.batch, self.size, self.batch), self.size]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """16-bit MinHash values of a non-empty shingle set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    low = None
    for i in range(0, len(h), step):
        part = (h[i : i + step] * a + b).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    low = low.astype(np.uint64)
    return (mixed(low + np.uint64(1)) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, n_shingles, the words' key (hi, lo) and signature; empty sets have neither."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = kept("words", WordHashes), p.multipliers()
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for text in batch.column(1):
                words = lower_words(text.as_py())
                s = shingle_set(known.of(words), p.k)
                n.append(len(s))
                if len(s):
                    key = np.frombuffer(hashlib.sha256(b" ".join(words)).digest(), "<i8", 2).tolist()
                    hi.append(key[0]), lo.append(key[1])
                    sig.append(signature(s, a, b).tobytes())
                else:
                    hi.append(None), lo.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "sig"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(sketch, "doc_id long, n_shingles long, hi long, lo long, sig binary")


def likely(a: np.ndarray, b: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices stay after every batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    at = 0
    for n, least in needs:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        stay = matches >= least
        alive, matches, at = alive[stay], matches[stay], n
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def pruned(pairs: DataFrame, signatures: DataFrame, p: NearDup) -> DataFrame:
    """The (a, b) pairs that the signatures leave."""
    needs = p.least_matches()

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(likely(_signatures(batch.column(2)), _signatures(batch.column(3)), needs))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    left = signatures.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(prune, "a long, b long")


class FullSets:
    """Shingle sets of texts by node, a bounded number remembered."""

    def __init__(self, p: NearDup, limit: int = 64):
        self.p, self.limit, self.known = p, limit, kept("words", WordHashes)
        self.sets: dict[int, np.ndarray] = {}

    def of(self, node: int, text: bytes) -> np.ndarray:
        if node not in self.sets:
            if len(self.sets) >= self.limit:
                self.sets.clear()
            self.sets[node] = shingle_set(self.known.of(lower_words(text)), self.p.k)
        return self.sets[node]

    def linked(self, a: tuple[int, bytes], b: tuple[int, bytes]) -> bool:
        x, y = self.of(*a), self.of(*b)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common * 100 >= self.p.percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach the threshold; ``texts`` has node, text."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = FullSets(p)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            keep = pa.array([i for i, (a, b, text_a, text_b) in enumerate(rows) if full.linked((a, text_a), (b, text_b))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(verify, "a long, b long")


def group_links(rows: list[tuple], needs: list[tuple[int, int]], p: NearDup) -> Iterator[tuple[int, int]]:
    """Verified links that connect components of one dealt group.

    Rows are (bucket, i, j, own block, node, label, signature, text).  In a group
    of two blocks only pairs between them are compared.  A link makes its two
    components one, whose pairs then need no comparison.
    """
    i, j, own, nodes, labels = (np.array(c) for c in list(zip(*(r[1:6] for r in rows), strict=True)))
    if (labels == labels[0]).all():
        return
    sig = np.frombuffer(b"".join(r[6] for r in rows), "<u2").reshape(len(rows), -1)
    full = FullSets(p, limit=len(rows) + 1)
    for x in range(len(rows)):
        rest = np.arange(x + 1, len(rows))
        rest = rest[labels[rest] != labels[x]]
        if i[0] != j[0]:
            rest = rest[own[rest] != own[x]]
        if not len(rest):
            continue
        for y in rest[likely(np.broadcast_to(sig[x], (len(rest), sig.shape[1])), sig[rest], needs)].tolist():
            if labels[x] != labels[y] and full.linked((int(nodes[x]), rows[x][7]), (int(nodes[y]), rows[y][7])):
                labels[labels == labels[y]] = labels[x]
                yield int(nodes[x]), int(nodes[y])


def across(members: DataFrame, labels: DataFrame, signatures: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Links (a, b) between components among buckets' other members."""
    needs = p.least_matches()
    others = members.where("n > 2 AND node <> leader")
    others = others.join(labels, "node", "left").select("bucket", "node", "n", "mass", F.coalesce("label", "node").alias("label"))
    others = written(others, "bucket-members")
    mixed_up = others.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    blocks = F.ceil(F.greatest(F.col("n") / p.block, F.col("mass") / p.mass)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    places = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = others.join(mixed_up, "bucket").withColumn("own", own).select("bucket", "node", "label", "own", F.explode(places).alias("at"))
    dealt = dealt.select("bucket", "at.i", "at.j", "own", "node", "label").join(signatures, "node").join(texts, "node")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").select("bucket", "i", "j", "own", "node", "label", "sig", "text")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = list(group_links(held, needs, p))
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield done()
                    held = []
                if not held or held[-1][4] != row[4]:
                    held.append(row)
        if held:
            yield done()

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Rows of equal doc_id and text are one document and share a result.  Empty
    and null texts link with nothing.  A row without doc_id takes the component
    of its equal texts; where there is none it is kept, with a null component.
    """
    sketched = written(sketches(docs, p), "sketches")
    sets = written(sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "sets")
    nodes = sketched.select("hi", "lo", F.col("doc_id").alias("node"), "n_shingles", "sig").join(sets, ["hi", "lo", "node"]).select("node", "n_shingles", "sig")
    nodes = written(nodes, "nodes")
    width = 2 * p.rows
    bucket = F.explode(F.array(*[F.xxhash64(F.substring("sig", 1 + width * b, width), F.lit(b)) for b in range(p.bands)])).alias("bucket")
    banded = nodes.select("node", "n_shingles", bucket)
    led = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("mass")).where("n > 1")
    members = written(banded.drop("n_shingles").join(led, "bucket"), "members")
    signatures = written(nodes.select("node", "sig").join(members.select("node").distinct(), "node", "left_semi"), "signatures")
    nodes_met = members.select("node").distinct()
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    texts = written(texts.join(nodes_met.hint("merge"), "node", "left_semi"), "texts")  # the nodes grow with the corpus
    first = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = written(verified(written(pruned(first, signatures, p), "likely"), texts, p), "links")
    labels = components(links)
    found = written(across(members, labels, signatures, texts, p), "links")
    if not found.isEmpty():
        named = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        joined = found.join(named[0], "a", "left").join(named[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        stars = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = components(stars.unionByName(joined))
    named = sets.join(labels, "node", "left").select("hi", "lo", F.coalesce("label", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """``docs`` with one document of each group, in their columns; rows without doc_id stay."""
    dropped = near_duplicates(docs, p).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(written(dropped, "dropped").hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
