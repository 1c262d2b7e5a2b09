import decimal
import random

import pytest

from sensorweave.functions import wire

GOLDEN = bytes.fromhex("088094ebdc0310401a100000803f000000400000404000008040202a")


def test_varints():
    assert [wire.read_varint(bytes.fromhex(h), 0)[0] for h in ("01", "00", "ac02", "ff" * 9 + "01")] == [1, 0, 300, 2**64 - 1]


@pytest.mark.parametrize(("data", "error"), [("80", "UnexpectedEof"), ("ff" * 11, "VarintOverflow"), ("", "UnexpectedEof")])
def test_bad_varints(data, error):
    with pytest.raises(wire.DecodeError, match=error):
        wire.read_varint(bytes.fromhex(data), 0)


@pytest.mark.parametrize(
    ("data", "error"),
    [("00", "InvalidFieldNumber"), ("0b", r"InvalidWireType\(3\)"), ("1ae807", "InvalidLength"), ("0a" + "ff" * 9 + "01", "InvalidLength"), ("0d0000", "UnexpectedEof"), ("090000", "UnexpectedEof")],
)
def test_bad_packets(data, error):
    with pytest.raises(wire.DecodeError, match=error):
        wire.decode_packet(bytes.fromhex(data))


def test_golden_packet():
    assert wire.encode_packet(10**9, 64, [1.0, 2.0, 3.0, 4.0], 42) == GOLDEN
    t, n, data, seq = wire.decode_packet(GOLDEN)
    assert (t, n, seq, wire.samples_of(data).tolist()) == (10**9, 64, 42, [1.0, 2.0, 3.0, 4.0])


def test_defaults_unknown_fields_and_last_wins():
    assert wire.decode_packet(b"") == (0, 0, b"", 0)
    assert wire.decode_packet(bytes.fromhex("98062a") + GOLDEN) == wire.decode_packet(GOLDEN)
    assert wire.decode_packet(bytes.fromhex("08010802")) == (2, 0, b"", 0)
    assert wire.decode_packet(bytes.fromhex("0d01000000")) == (0, 0, b"", 0)  # a known field of another type
    assert len(wire.samples_of(b"\0" * 7)) == 1


def test_random_bytes_never_raise(spark):
    rng = random.Random(1)
    rows = [(i, bytearray(rng.randbytes(rng.randrange(60)))) for i in range(500)] + [(500, None)]
    got = spark.createDataFrame(rows, "i long, b binary").select("i", wire.decode_neural_packet("b").alias("p")).collect()
    assert len(got) == 501
    assert all((r.p.error is None) != (r.p.timestamp_ns is None) for r in got)


def test_unsigned_round_trip(spark):
    buf = wire.encode_packet(2**64 - 1, 2**32 - 1, [0.5] * 32_000, 2**32 - 1)
    p = spark.createDataFrame([(bytearray(buf),)], "b binary").select(wire.decode_neural_packet("b").alias("p")).first().p
    assert p.timestamp_ns == decimal.Decimal(2**64 - 1)
    assert (p.channel_count, p.sequence_id, len(p.samples)) == (2**32 - 1, 2**32 - 1, 32_000)


def test_nulls_have_no_packet_and_change_no_other(spark):
    big = 2**62 + 1
    rows = [(1, big, 2, [1.0], 7), (2, None, 2, [1.0], 7), (3, big, None, [1.0], 7), (4, big, 2, None, 7), (5, big, 2, [1.0], None)]
    df = spark.createDataFrame(rows, "i long, t long, n long, s array<float>, q long").coalesce(1)
    got = {r.i: r.b for r in df.select("i", wire.encode_neural_packet("t", "n", "s", "q").alias("b")).collect()}
    assert bytes(got[1]) == wire.encode_packet(big, 2, [1.0], 7) and bytes(got[4]) == wire.encode_packet(big, 2, [], 7)
    assert got[2] is got[3] is got[5] is None
