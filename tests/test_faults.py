import json

import pytest
from pyspark.sql import functions as F

from sensorweave.functions import infer
from sensorweave.operators import faults
from sensorweave.plans import reports
from sensorweave.schema import AuditConfig


def test_generator():
    rng = faults.Xorshift64(12345)
    assert len({rng.next() for _ in range(100)}) == 100
    with pytest.raises(ValueError):
        faults.Xorshift64(0)
    still = faults.Xorshift64(5)
    assert not still.roll(0) and still.roll(1) and still.state == 5
    hits = sum(faults.Xorshift64.roll(rng, 0.25) for _ in range(100_000))
    assert abs(hits / 100_000 - 0.25) < 0.01


@pytest.mark.parametrize("steps", [0, 1, 7, 1000])
def test_jump(steps):
    rng = faults.Xorshift64(99)
    for _ in range(steps):
        rng.next()
    assert faults.jumped(99, steps) == rng.state


def test_published_counts(spark):
    plan = faults.fault_plan(spark, 10_000, 0.01, 0.005, 128_020)
    assert tuple(faults.fault_summary(plan).first())[:4] == (10_000, 85, 51, 9_915)
    flags = faults.drop_flags(spark, 10_000, 0.01, slices=7).orderBy("packet").collect()
    assert [r.dropped for r in flags] == [r.dropped for r in plan.orderBy("packet").collect()]
    assert faults.drop_flags(spark, 0, 0.5).count() == 0


def test_corruptor():
    c = faults.PacketCorruptor(0.0, 1, 7)
    buf = bytearray(b"\xaa" * 64)
    assert not c.maybe_corrupt(buf) and buf == b"\xaa" * 64
    one = faults.PacketCorruptor(1.0, 1, 7)
    assert one.maybe_corrupt(buf) and sum(b != 0xAA for b in buf) == 1
    assert not one.maybe_corrupt(bytearray()) and (one.total, one.corrupted) == (2, 1)


def test_audit(spark):
    cfg = AuditConfig(packet_count=2000, channel_count=4, samples_per_channel=8, drop_rate=0.01, corrupt_rate=0.005)
    row = reports.audit_report(reports.audit_packets(spark, cfg)).first().asDict()
    assert row["packets_sent"] + row["packets_dropped"] == 2000
    assert row["latency_p50_ns"] <= row["latency_p99_ns"] and row["latency_min_ns"] >= 42_100
    assert json.loads(reports.render(row, {"n": 1}, "json"))["results"]["heap_allocs"] == 0
    assert "packets_sent" in reports.render(row) and "| metric |" in reports.render(row, fmt="markdown", compare={"packets_sent": 1})


def test_empty_audit(spark):
    row = reports.audit_report(reports.audit_packets(spark, AuditConfig(packet_count=0, channel_count=1, samples_per_channel=1))).first()
    assert (row.packets_sent, row.latency_p50_ns, row.throughput_pps, row.loss_fraction) == (0, 0, 0.0, 0.0)


def test_client_summary(spark):
    df = spark.createDataFrame([(i * 10, i, "intent" if i % 3 else "", 0.5) for i in range(30)], "timestamp_ns long, sequence_id long, classification string, confidence double")
    row = reports.client_summary(df).first()
    assert (row.packets, row.intent, row.observe, row.intervals, row.p95, row.p99) == (30, 20, 10, 28, 10.0, 0.0)


def test_model_and_fallbacks(spark):
    predict = infer.classifier(channels=4, samples=10)
    rows = [([0.1] * 40, [0.2] * 30), ([0.1] * 7, [0.2] * 30)]
    df = spark.createDataFrame(rows, "e array<float>, g array<float>")
    got = df.select(predict("e", "g").alias("p")).collect()
    assert 0 < got[0].p.confidence < 1 and got[0].p.classification in ("intent", "observe")
    assert got[1].p is None or got[1].p.classification is None
    stub = spark.range(1).select(infer.with_fallback(F.lit(False), infer.stub_prediction()).alias("a"), infer.with_fallback(F.lit(True), F.lit(None).cast("struct<confidence:float,classification:string,inference_ns:bigint>")).alias("b")).first()
    assert (stub.a.classification, stub.b.classification, stub.b.confidence) == ("accumulating", "observe", 0.5)
