import pytest

from sensorweave.plans import api, packets
from sensorweave.sources import corec, simulate
from sensorweave.streaming import stateful


@pytest.fixture(scope="module")
def recording(spark, tmp_path_factory):
    eeg, gaze, _ = simulate.synthetic_recording(spark, trials=4, channels=4)
    path = str(tmp_path_factory.mktemp("r") / "s.corec")
    corec.write_corec(path, 500.0, 60.0, eeg, gaze)
    return path


def test_replay(spark, recording):
    got = api.replay(spark, recording)
    assert got.count() == 1992
    assert got.where("classification = 'observe'").count() == 15
    assert api.replay(spark, recording, limit=100, mode="nearest").count() == 100
    assert [len(r.features) for r in got.limit(3).collect()] == [11, 11, 11]


def test_replay_with_a_model(spark, recording):
    rows = api.replay(spark, recording, mode="nearest", with_model=True).where("classification <> 'accumulating'").collect()
    assert len(rows) == 16
    assert all(0 < r.confidence < 1 and r.classification == ("intent" if r.confidence >= 0.5 else "observe") for r in rows)
    assert len({r.confidence for r in rows}) > 1


def test_bench(spark, recording):
    got = api.replay_bench(spark, recording)
    assert (got["fused"], got["features"], got["inferences"]) == (2000, 20, 16)
    assert got["frames_per_s"] > 0
    assert api.replay_bench(spark, recording, limit=150)["features"] == 1


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Recordings of other rates and channel counts in one folder, and each in a folder of its own."""
    root = tmp_path_factory.mktemp("mixed")
    for name, rate, gaze_rate, channels in (("a", 500.0, 60.0, 4), ("b", 128.0, 30.0, 6)):
        eeg, gaze, _ = simulate.synthetic_recording(spark, 6, 1.0, channels, rate, gaze_rate)
        for folder in ("all", name):
            (root / folder).mkdir(exist_ok=True)
            corec.write_corec(str(root / folder / f"{name}.corec"), rate, gaze_rate, eeg, gaze)
    return root


@pytest.mark.parametrize("mode", ["replay", "bench", "nearest"])
def test_every_recording_has_its_own_rates(spark, mixed, mode):
    key = lambda rows: sorted((r.recording, r.sequence_id, r.timestamp_ns, r.alignment_offset_ns, r.classification, tuple(r.features)) for r in rows)
    together = key(api.replay(spark, str(mixed / "all"), mode=mode, size=50, stride=10).collect())
    alone = [x for name in "ab" for x in key(api.replay(spark, str(mixed / name), mode=mode, size=50, stride=10).collect())]
    assert together == alone and {r[0] for r in together} == {"a.corec", "b.corec"}


def test_models_fit_every_recording(spark, mixed):
    rows = api.replay(spark, str(mixed / "all"), mode="nearest", with_model=True, size=100, stride=50).where("classification <> 'accumulating'").collect()
    assert {r.recording for r in rows if r.confidence != 0.5} == {"a.corec", "b.corec"}
    got = api.replay_bench(spark, str(mixed / "all"))
    assert got["fused"] == 3000 + 768 and abs(got["recorded_s"] - 12.0) < 1e-9


def test_streams_equal_batches(spark, mixed, tmp_path):
    corec.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    stream = lambda: stateful.drained(spark.readStream.format("corec").option("framesPerPartition", 500).load(str(folder)), str(tmp_path / "out"))
    for name in "ab":
        (folder / f"{name}.corec").write_bytes((mixed / name / f"{name}.corec").read_bytes())
        got = stream()  # goes on from its checkpoint
        want = spark.read.format("corec").load(str(folder))
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_recordings_are_written_side_by_side(spark, mixed, tmp_path):
    corec.register(spark)
    read = lambda section, path: spark.read.format("corec").option("section", section).load(str(path))
    headers = read("header", mixed / "all").unionByName(spark.createDataFrame([("none.corec", 9.0, 0, 3.0, 0, 0)], read("header", mixed / "all").schema))
    sizes = {r.recording: r.bytes for r in corec.write_recordings(str(tmp_path), headers, read("eeg", mixed / "all"), read("gaze", mixed / "all")).collect()}
    for name in "ab":
        data = (tmp_path / f"{name}.corec").read_bytes()
        assert data == (mixed / name / f"{name}.corec").read_bytes() and sizes[f"{name}.corec"] == len(data)
    assert corec.read_header(str(tmp_path / "none.corec")) == corec.Header(9.0, 0, 3.0, 0, 0)
    assert corec.files(f"file://{tmp_path}") == [f"file://{tmp_path}/{n}.corec" for n in ("a", "b", "none")]
    assert read("eeg", f"file://{tmp_path}/[ab].corec").count() == 3768


def test_live_and_audit(spark):
    live = api.simulate_live(spark, 2.0, channels=4)
    assert live.count() == 512
    assert {r.classification for r in live.select("classification").distinct().collect()} == {"observe"}
    assert packets.embedding_packets(live).columns[2] == "raw_eeg"
    row = api.audit(spark, 500, 2, 4, drop_rate=1.0).first()
    assert (row.packets_sent, row.packets_dropped, row.loss_fraction) == (0, 500, 0.0)
