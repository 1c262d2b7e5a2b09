import random

import pytest

from sensorweave.operators import align


def fused(spark, gaze, eeg, **kwargs):
    right = spark.createDataFrame([(t, i, float(i)) for i, t in enumerate(gaze)], "timestamp_ns long, idx long, x double")
    left = spark.createDataFrame([(t, i) for i, t in enumerate(eeg)], "timestamp_ns long, sequence_id long")
    return {r.sequence_id: r for r in align.asof_nearest(left, right, ["x"], **kwargs).collect()}


@pytest.mark.parametrize(
    ("gaze", "eeg", "offset"),
    [([10**6], 10**6, 0), ([500_000, 1_500_000], 10**6, -500_000), ([10**6, 2 * 10**6, 3 * 10**6], 2_500_000, -500_000), ([0], 10_000_000, -10_000_000), ([5], 3, 2)],
)
def test_published_cases(spark, gaze, eeg, offset):
    assert fused(spark, gaze, [eeg])[0].alignment_offset_ns == offset


def test_nothing_to_align_with(spark):
    assert fused(spark, [], [10**6]) == {}


def test_duplicates(spark):
    got = fused(spark, [5, 5], [7, 3])
    assert (got[0].x, got[1].x) == (1.0, 0.0)


def test_degraded_is_strict(spark):
    left = spark.createDataFrame([(10_000_000, 0), (10_000_001, 1)], "timestamp_ns long, sequence_id long")
    right = spark.createDataFrame([(0, 0)], "timestamp_ns long, idx long")
    rows = align.with_degraded(align.asof_nearest(left, right, [])).orderBy("sequence_id").collect()
    assert [r.degraded for r in rows] == [False, True]


def test_metrics(spark):
    left = spark.createDataFrame([(i * 10**6 + 100, i) for i in range(10)], "timestamp_ns long, sequence_id long")
    right = spark.createDataFrame([(i * 10**6, i) for i in range(10)], "timestamp_ns long, idx long")
    row = align.alignment_metrics(align.asof_nearest(left, right, [])).first()
    assert (row.frames_fused, row.mean_alignment_ns, row.degraded_fraction) == (10, 100.0, 0.0)
    none = align.alignment_metrics(align.asof_nearest(left, right.where("idx < 0"), [])).first()
    assert (none.frames_fused, none.mean_alignment_ns, none.degraded_fraction) == (0, 0.0, 0.0)


def brute(times, t, lo=0, hi=None):
    near = [(abs(g - t), g, k) for k, g in enumerate(times) if k >= lo and (hi is None or k < hi)]
    if not near:
        return None
    _, g, _ = min(near)
    same = [k for _, other, k in near if other == g]
    return g, (max(same) if g <= t else min(same))


def test_forms_agree_with_brute_force(spark):
    rng = random.Random(3)
    gaze = sorted(rng.randrange(500) for _ in range(120))
    eeg = sorted(rng.randrange(-50, 600) for _ in range(150))
    right = spark.createDataFrame([(t, i) for i, t in enumerate(gaze)], "timestamp_ns long, idx long").selectExpr("*", "idx AS k")
    left = spark.createDataFrame([(t, i) for i, t in enumerate(eeg)], "timestamp_ns long, sequence_id long")
    for out in (align.asof_nearest(left, right, ["k"]), align.asof_nearest_bucketed(left, right, ["k"], 37)):
        got = {r.sequence_id: (r.matched_ns, r.k) for r in out.collect()}
        assert got == {i: brute(gaze, t) for i, t in enumerate(eeg)}
    for mode, cap, width in (("replay", 7, 40), ("replay", 0, 10**9), ("bench", 16, 100), ("live", 9, 70)):
        ratio = 2.0 if mode == "live" else 0.6
        got = {r.sequence_id: r.matched_ns for r in align.asof_buffered(left, right, ["k"], mode, ratio, cap, width=width).collect()}
        want = {}
        for i, t in enumerate(eeg):
            hi = min(len(gaze), {"replay": int((i + 1) * 0.6), "live": i // 2 + 1, "bench": len(gaze)}[mode])
            if near := brute(gaze, t, max(0, hi - max(cap, 1)), hi):
                want[i] = near[0]
        assert got == want


def test_published_replay(spark):
    eeg = spark.range(20_000).selectExpr("id * 2000000 AS timestamp_ns", "id AS sequence_id")
    gaze = spark.range(2_400).selectExpr("(id DIV 60) * 1000000000 + (id % 60) * 16666666 AS timestamp_ns", "id AS idx")
    rows = align.alignment_metrics(align.asof_buffered(eeg, gaze, [], "replay", 60 / 500, 500)).first()
    assert rows.frames_fused == 19_992
    assert rows.degraded_fraction == 1.0
    assert round(rows.mean_alignment_ns, 2) == 22_666_286.19
    bench = align.alignment_metrics(align.asof_buffered(eeg, gaze, [], "bench")).first()
    assert (bench.frames_fused, round(bench.degraded_fraction * 20_000)) == (20_000, 17_865)
    assert round(bench.mean_alignment_ns, 2) == 15_962_227_273.89
    near = align.alignment_metrics(align.asof_nearest(eeg, gaze, [])).first()
    assert (near.frames_fused, round(near.degraded_fraction * 20_000), round(near.mean_alignment_ns, 1)) == (20_000, 3, 4_161_334.1)
