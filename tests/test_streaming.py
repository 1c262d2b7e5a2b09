import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from sensorweave.plans import views
from sensorweave.sources import simulate
from sensorweave.streaming import stateful


def in_batches(spark, df, tmp_path, parts):
    """A stream that gets ``df`` in ``parts`` files of successive times, one a micro-batch."""
    folder = str(tmp_path / "in")
    w = df.orderBy("ts_us", "event_id").toPandas()
    step = -(-len(w) // parts)
    for k in range(parts):
        spark.createDataFrame(w.iloc[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_batches_do_not_matter(spark, sf, tmp_path):
    events = views.arrivals(spark, sf).where("user_id < 6")
    once = stateful.drained(stateful.stream_hops(in_batches(spark, events, tmp_path / "1", 1)), str(tmp_path / "one"))
    often = stateful.drained(stateful.stream_hops(in_batches(spark, events, tmp_path / "4", 4)), str(tmp_path / "four"))
    key = lambda r: [round(v, 6) for v in r]
    assert sorted(map(key, once.collect())) == sorted(map(key, often.collect()))
    assert once.count() > 0


def aligned_in_batches(spark, df, tmp_path, folder, parts, late="1 hour", shuffled=None):
    """Rows of ``df`` (k, at seconds, anchor) as two streams, some out of order."""
    source = str(tmp_path / f"in-{folder}")
    rows = df if shuffled is None else sorted(df, key=lambda r: r[1] + shuffled.randrange(1800))
    step = -(-len(rows) // parts)
    for k in range(parts):
        some = [(a, t, i, datetime.fromtimestamp(t, UTC), anchor, f"body {i}") for a, t, i, anchor in rows[k * step : (k + 1) * step]]
        spark.createDataFrame(some, "k string, at long, i long, time timestamp, anchor boolean, body string").coalesce(1).write.mode("append").parquet(source)
    both = spark.readStream.schema("k string, at long, i long, time timestamp, anchor boolean, body string").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / f"out-{folder}")
    got = stateful.stream_asof(both.where("anchor").select("k", "i", "time", "body"), both.where("NOT anchor").select("k", "i", "time", F.col("body").alias("seen"), "at"), ["seen", "at"], ["k"], "time", late, "i", "i", stateful.end_marks(spark, out))
    return sorted((r.k, r.i, r.body, r.seen, r.at, r.offset_us) for r in stateful.drained(got, out, ends=True).collect())


def test_stream_alignment_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), 1_700_000_000 + rng.randrange(40_000), i, rng.random() < 0.4) for i in range(300)]
    rows += [("only anchors", 1_700_000_000 + i, 900 + i, True) for i in range(3)] + [("late view", 1_700_000_500, 950, True), ("late view", 1_700_030_000, 951, False)]
    want = []
    for k, t, i, anchor in rows:
        near = [(abs(at - t), at, (-1 if at <= t else 1) * j, j) for kk, at, j, a in rows if kk == k and not a]
        if anchor and near:
            _, at, _, j = min(near)
            want.append((k, i, f"body {i}", f"body {j}", at, (at - t) * 1_000_000))
    for folder, parts, shuffled in (("one", 1, None), ("many", 6, None), ("mixed", 6, random.Random(1))):
        assert aligned_in_batches(spark, sorted(rows, key=lambda r: r[1]), tmp_path, folder, parts, shuffled=shuffled) == sorted(want)


def test_late_rows_take_no_part(spark, tmp_path):
    t = 1_700_000_000
    rows = [("a", t, 1, False), ("a", t + 50_000, 2, False), ("a", t + 90_000, 3, False), ("a", t + 10, 4, True), ("a", t + 49_000, 5, False), ("a", t + 88_000, 6, True)]
    got = aligned_in_batches(spark, rows, tmp_path, "late", len(rows))
    assert [(r[1], r[3]) for r in got] == [(6, "body 3")]


def test_fan_out(spark, sf, tmp_path):
    events = views.arrivals(spark, sf)
    got = {"a": 0, "b": 0}

    def sink(name):
        def add(batch, _):
            got[name] += batch.count()

        return add

    query = stateful.fan_out(in_batches(spark, events, tmp_path, 2), [sink("a"), sink("b")], str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == {"a": events.count(), "b": events.count()}


def test_rate_source_has_the_frames_of_the_batch_source(spark):
    stream = simulate.stream_eeg(spark, channels=2)
    assert stream.isStreaming
    assert [f.name for f in stream.schema][:3] == [f.name for f in simulate.simulated_eeg(spark, 1, 2).schema]


def test_tumbling_counts_everything(spark, sf):
    events = views.arrivals(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    assert stateful.tumbling(events).agg(F.sum("n")).first()[0] == events.count()
