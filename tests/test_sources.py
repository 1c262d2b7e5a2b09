import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.plans import packets
from sensorweave.sources import arrays, corec, simulate, text


@pytest.fixture
def recording(spark, tmp_path):
    corec.register(spark)
    eeg = spark.createDataFrame([(i * 3_906_250, [float(i * 32 * 0.1), 1.0, 2.0, 3.0], i) for i in range(100)], "timestamp_ns long, channels array<float>, sequence_id long")
    gaze = spark.createDataFrame([(i * 16_666_667, 0.5 * i, -0.3 * i, 3.0, i) for i in range(25)], "timestamp_ns long, x float, y float, pupil_diameter float, idx long")
    path = str(tmp_path / "a.corec")
    corec.write_corec(path, 256.0, 60.0, eeg, gaze)
    return path, eeg, gaze


def scan(spark, path, section, **options):
    return spark.read.format("corec").options(section=section, **options).load(path)


def test_header_golden():
    h = corec.Header(256.0, 32, 60.0, 100, 25)
    assert h.to_bytes().hex() == "43524543010000000000000000007040200000000000000000004e40640000001900000000000000"
    assert corec.Header.parse(h.to_bytes()) == h


def test_round_trip(spark, recording):
    path, eeg, gaze = recording
    for size in ("7", "1000"):
        got = scan(spark, path, "eeg", framesPerPartition=size).orderBy("sequence_id")
        assert got.drop("recording").collect() == eeg.collect()
        assert scan(spark, path, "gaze", framesPerPartition=size).drop("recording").orderBy("idx").collect() == gaze.collect()
    assert tuple(scan(spark, path, "header").first()) == ("a.corec", 256.0, 4, 60.0, 100, 25)


def test_cut_off_files(spark, recording, tmp_path):
    path, _, _ = recording
    data = open(path, "rb").read()
    short = tmp_path / "short.corec"
    short.write_bytes(data[: 40 + 10 * 24 + 5])
    assert scan(spark, str(short), "eeg").count() == 10
    with pytest.raises(Exception, match="cut off"):
        scan(spark, str(short), "gaze").count()
    for name, content in (("magic", b"XREC" + data[4:40]), ("tiny", b"CREC")):
        bad = tmp_path / f"{name}.corec"
        bad.write_bytes(content)
        with pytest.raises(Exception, match="corec"):
            scan(spark, str(bad), "eeg").count()


def test_empty_recording(spark, tmp_path):
    corec.register(spark)
    path = tmp_path / "none.corec"
    path.write_bytes(corec.Header(256.0, 8, 60.0, 0, 0).to_bytes())
    assert scan(spark, str(path), "eeg").count() == scan(spark, str(path), "gaze").count() == 0


def test_folder_of_recordings(spark, recording, tmp_path):
    path, _, _ = recording
    (tmp_path / "b.corec").write_bytes(open(path, "rb").read())
    got = scan(spark, str(tmp_path), "eeg").groupBy("recording").count().collect()
    assert {r.recording: r["count"] for r in got} == {"a.corec": 100, "b.corec": 100}


def test_gaze_csv_skips_bad_rows(spark, tmp_path):
    f = tmp_path / "g.csv"
    f.write_text("t,x,y\n100.5,1,2\nbad,1,2\n100.75,,3\n101.5,4,5\n103,6\n102.5,7,8\n")
    rows = text.read_gaze_csv(spark, str(f)).orderBy("idx").collect()
    assert [(r.timestamp_ns, r.x, r.y, r.pupil_diameter) for r in rows] == [(0, 1.0, 2.0, 3.0), (10**9, 4.0, 5.0, 3.0), (2 * 10**9, 7.0, 8.0, 3.0)]
    assert text.read_gaze_csv(spark, str(f), 1.0).count() == 2


def test_smi(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text("## note\n\nTime,Type,L POR X [px],L POR Y [px],L Pupil Diameter [mm]\n1000,SMP,1.5,2.5,4\n2000,MSG,9,9,9\n3000,smp ,-,.,\n4000,SMP,x,1,2\nbad,SMP,1,1,1\n")
    rows = text.read_smi(spark, str(f)).orderBy("idx").collect()
    assert [(r.timestamp_ns, r.x, r.y, r.pupil_diameter) for r in rows] == [(0, 1.5, 2.5, 4.0), (2_000_000, 0.0, 0.0, 3.0)]
    right = tmp_path / "r.txt"
    right.write_text("Time,R POR X,R POR Y\n1,5,6\n")
    assert text.read_smi(spark, str(right)).select("x", "y").first() == (5.0, 6.0)


def test_physio_tsv(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text("t\tx\ty\n1.5\t2\t3\n2.5\t4\t5\n")
    assert [r.timestamp_ns for r in text.read_physio_tsv(spark, str(f)).orderBy("idx").collect()] == [1_500_000_000, 2_500_000_000]
    assert text.placeholder_gaze(spark, 3, 30.0).count() == 3


def test_benchmark_log(spark, tmp_path):
    f = tmp_path / "als-1.log"
    f.write_text("32 EEG channels @ 128 Hz\nDuration: 60.5 s\nThroughput: 99 frames/sec\nThroughput: 1,234,567 frames/sec\nReal-time 9,000.5x\nFusion latency p50: 96ns p99: 3 us\nFeature extraction p50 1.5 µs\n")
    row = text.read_benchmark_log(spark, str(f)).first()
    assert tuple(row)[1:] == (32, 128.0, 60.5, 1_234_567, 9000.5, "96 ns", "1.5 µs", "1", "EEGET-ALS")


def test_lines_of_long_files(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 10)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\r\n" if i % 7 else "\r\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999b")
    try:
        rows = text.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.recording, r.line, r.text) for r in rows) == sorted((f"{x}.txt", i, f"{x}{i}") for x, n in (("a", 4000), ("b", 10)) for i in range(n) if i % 7)


def test_npz(spark, tmp_path):
    eeg, labels = np.arange(2 * 3 * 4, dtype=np.float32).reshape(2, 3, 4), np.array([[1.0, 2.0], [3.0, 4.0]])
    buf = io.BytesIO()
    np.savez(buf, EEG=eeg, labels=labels)
    (tmp_path / "x.npz").write_bytes(buf.getvalue())
    got = arrays.read_npz(spark, str(tmp_path / "x.npz")).orderBy("sequence_id").collect()
    assert [list(r.channels) for r in got[:2]] == [[0.0, 4.0, 8.0], [1.0, 5.0, 9.0]]
    assert len(got) == 8
    gaze = arrays.read_npz(spark, str(tmp_path / "x.npz"), "gaze").orderBy("idx").collect()
    assert [(g.x, g.y) for g in gaze] == [(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)][: len(gaze)]


def test_simulation(spark):
    assert simulate.saccades(200) == [59, 95, 174]
    first = simulate.simulated_eeg(spark, 3).orderBy("sequence_id").first()
    assert len(first.channels) == 64
    assert [round(v, 4) for v in first.channels[:3]] == [34.3213, 34.3213, 33.8127]
    gaze = simulate.simulated_gaze(spark, 200).orderBy("idx").collect()
    assert len(gaze) == 200
    assert len({round(g.x / 10) for g in gaze}) > 1
    assert simulate.simulated_gaze(spark, 0).count() == 0


def test_synthetic_recording_replays(spark):
    eeg, gaze, labels = simulate.synthetic_recording(spark, trials=4, channels=4)
    assert (eeg.count(), gaze.count(), [tuple(r) for r in labels.collect()]) == (2000, 240, [(0, 1), (1, 0), (2, 1), (3, 0)])
    got = packets.replay(eeg, gaze, 500.0, 60.0, "replay", features=False)
    classes = {r.classification: r["count"] for r in got.groupBy("classification").count().collect()}
    assert sum(classes.values()) == 1992
    assert classes["observe"] == 15


def test_synthetic_conditions(spark):
    """What tells the conditions apart, over many trials."""
    eeg, gaze, _ = simulate.synthetic_recording(spark, trials=40, channels=112)
    rows = eeg.select("timestamp_ns", F.slice("channels", 79, 34).alias("c")).repartition(3).orderBy("timestamp_ns").collect()
    x = np.array([r.c for r in rows]).reshape(40, 500, 34)  # channels 78 to 111
    assert [r.timestamp_ns for r in rows[:502:501]] == [0, 10**9 + 2_000_000]
    moved = x[::2].mean(axis=0) - x[1::2].mean(axis=0)
    late, early = moved[460:, 2:33].mean(), moved[:250, 2:33].mean()
    assert late < -3.5 and abs(early) < 0.7
    assert abs(moved[460:, [0, 1, 33]].mean()) < 1.5
    power = x.std(axis=(0, 1), where=(np.arange(500) >= 350)[None, :, None])
    damped = x[::2, 350:, 2:33].std(axis=0).mean() / x[1::2, 350:, 2:33].std(axis=0).mean()
    assert 0.62 < damped < 0.8 and power.shape == (34,)
    spectrum = np.abs(np.fft.rfft(x[1::2, :, 0], axis=1)).mean(axis=0)
    assert spectrum[9:12].max() > 4 * spectrum[13:17].mean() and spectrum[18:23].mean() > spectrum[28:60].mean()
    g = gaze.orderBy("idx").toPandas()
    g["trial"], g["tick"] = g["idx"] // 60, g["idx"] % 60
    held = g[g["tick"] >= 15].groupby("trial")["x"].std()
    assert abs(held[::2].mean() - 0.15) < 0.02 and abs(held[1::2].mean() - 0.25) < 0.03
    assert abs(g[g["tick"] < 9]["x"].mean()) < 0.05 and g[g["tick"] >= 15].groupby("trial")["x"].mean().abs().max() > 5
    wide = g.groupby(g["trial"] % 2)["pupil_diameter"].mean()
    assert abs(wide[0] - wide[1] - 0.3) < 0.03
    again = simulate.synthetic_recording(spark, trials=40, channels=112)[1].orderBy("idx").toPandas()
    assert again["x"].equals(g["x"]) and not simulate.synthetic_recording(spark, 40, seed=7)[1].orderBy("idx").toPandas()["x"].equals(g["x"])


def test_file_is_little_endian(recording):
    path, _, _ = recording
    with open(path, "rb") as f:
        f.seek(40 + 24)
        assert struct.unpack("<Qf", f.read(12)) == (3_906_250, pytest.approx(3.2))
