import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import table
from pyspark.sql import functions as F

from sensorweave.llm import sharding
from sensorweave.llm.sharding import Ring, capacities, place


def one_by_one(ring, cells, load_factor):
    """Keys (given by cell, in ring order) inserted singly: those at home first, then the overflow."""
    _, shard_of = ring.points()
    owner = ring.cell_owner()
    room = capacities(len(cells), ring.shards, load_factor)
    out, over = {}, []
    for k, c in enumerate(cells):
        s = int(shard_of[owner[c]])
        if room[s]:
            room[s] -= 1
            out[k] = s
        else:
            over.append((k, int(owner[c])))
    for k, point in over:
        while True:
            point = (point + 1) % len(shard_of)
            s = int(shard_of[point])
            if room[s]:
                room[s] -= 1
                out[k] = s
                break
    return [out[k] for k in range(len(cells))]


@pytest.mark.parametrize("load_factor", [None, 1.0, 1.25, 3.0])
def test_bulk_equals_single_insertion(load_factor):
    rng = np.random.default_rng(2)
    ring = Ring(5, vnodes=8, cells=16)
    n = len(ring.cuts()) + 1
    for _ in range(20):
        cells = np.sort(rng.choice(n, 400, p=rng.dirichlet(np.full(n, 0.2))))
        counts = np.bincount(cells, minlength=n)
        got = [s for a, b, s, _ in place(ring, counts, load_factor) for _ in range(a, b)]
        assert got == one_by_one(ring, cells.tolist(), load_factor)


def test_growing_moves_few_keys():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    homes = []
    for shards in (16, 17):
        ring = Ring(shards)
        cell = ring.cell_of(keys)
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=len(ring.cuts()) + 1)
        shard = np.empty(len(keys), int)
        for a, b, s, _ in place(ring, counts, 1.25):
            shard[order[a:b]] = s
        assert np.bincount(shard).max() <= 1.25 * len(keys) / shards + 1
        homes.append(shard)
    assert (homes[0] != homes[1]).mean() < 0.12


def check(rows, texts):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(16)]) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_documents(documents, texts):
    rows = sharding.shard_documents(documents).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows(odd, none, odd_rows):
    rows = sharding.shard_documents(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert max(Counter(r.shard for r in rows).values()) == 1
    assert sharding.shard_documents(none).count() == 0


def test_frequent_keys_are_ranked_in_parts(spark):
    """A third of the rows without a key, a third with one."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 400}") for i in range(3000)]
    df = table(spark, rows).repartition(4)
    ties = [F.length("text"), F.crc32(F.col("text").cast("binary"))]
    for ring, load in ((Ring(5, 8, 16), None), (Ring(5, 8, 16), 1.3)):
        for most in (100, 10**6):
            out = sharding.ring_shards(df, "doc_id", ring, load, ties, most).collect()
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out) == sorted((i is None, i or 0, t) for i, t in rows)
            counts = Counter(r.shard for r in out)
            assert max(counts.values()) <= (1.3 if load else 1) * 600 + 1
            assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
            assert all(r["__cell"] == "my __cell" and r.bucket == 2 for r in out)
    plan = sharding.ring_shards(df, "doc_id", Ring(5, 8, 16), None, ties, 100)
    assert plan.select("shard").distinct().count() == 5


def test_placement_does_not_depend_on_partitions(documents):
    a = sharding.shard_documents(documents).collect()
    b = sharding.shard_documents(documents.repartition(7)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in a} == {r.doc_id: (r.shard, r.slot) for r in b}
