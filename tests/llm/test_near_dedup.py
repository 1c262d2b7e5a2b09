import random

import numpy as np
from conftest_llm import prose, table, words

from sensorweave.llm import near_dedup
from sensorweave.llm.components import components
from sensorweave.llm.near_dedup import NearDup, signature


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def by_brute_force(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def check(rows, docs):
    want = by_brute_force(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def near_copies(n, edits, seed):
    """A group of copies with up to ``edits`` words changed, many pairs of which lie near the threshold."""
    rng, base = random.Random(seed), words(150, seed)
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
        out[i] = " ".join(w)
    return out


def test_documents(documents, texts):
    check(near_dedup.near_duplicates(documents).collect(), texts)


def test_groups_of_near_copies(spark):
    docs = near_copies(120, 6, 1) | {1000 + i: t for i, t in near_copies(80, 12, 2).items()} | {2000 + i: prose(100, i) for i in range(30)}
    df = table(spark, docs.items()).repartition(5)
    check(near_dedup.near_duplicates(df).collect(), docs)
    check(near_dedup.near_duplicates(df, NearDup(block=16)).collect(), docs)
    check(near_dedup.near_duplicates(df, NearDup(mass=2000)).collect(), docs)


def test_equal_sets_in_other_orders(spark):
    """Words over and over, and lines dealt anew, have the sets of other texts without their words."""
    line = words(40, 5)
    docs = {1: " ".join(line * 2), 2: " ".join(line * 3), 3: "\n".join([" ".join(line * 2)] * 2).upper(), 4: " ".join(line), 5: "of " * 30, 6: "of " * 40, 7: "of of of of", 8: "of of of of of"}
    check(near_dedup.near_duplicates(table(spark, docs.items())).collect(), docs)


def test_odd_rows(odd, none, odd_rows):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    named = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (named[1].n_shingles, named[2].n_shingles, named[3].n_shingles) == (0, 0, 0)
    assert all(named[i].component_id == i for i in (1, 2, 3, 9, -7))
    assert named[5].component_id == named[4].component_id == 4
    assert sorted((r.component_id, r.kept) for r in rows if r.doc_id is None and r.n_shingles) == [(4, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None and not r.n_shingles] == [(None, True)]
    assert near_dedup.near_duplicates(none).count() == near_dedup.deduplicated(none).count() == 0


def test_deduplicated(odd):
    out = near_dedup.deduplicated(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns
    assert 5 not in ids and 4 in ids and 9 in ids


def test_signatures_estimate_similarity():
    p, rng = NearDup(), np.random.default_rng(0)
    apart = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(pool[:200]), np.unique(pool[60:260])
        apart.append((signature(a, *p.multipliers()) == signature(b, *p.multipliers())).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(apart)) < 0.02


def test_pruning_keeps_pairs_at_the_threshold():
    p, rng = NearDup(), np.random.default_rng(1)
    a = rng.integers(0, 60_000, (4000, p.size)).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.85, a, a ^ 1)
    assert len(near_dedup.likely(a, b, p.least_matches())) >= 3995
    far = np.where(rng.random(a.shape) < 0.5, a, a ^ 1)
    assert len(near_dedup.likely(a, far, p.least_matches())) == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 102), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 104)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
