"""The ``corec`` recording format as a Spark data source.

A 40-byte little-endian header (magic, version, rate, channels, gaze rate, EEG
and gaze frame counts, 4 bytes of padding), then EEG frames of 8 + 4 * channels
bytes and gaze frames of 20 bytes.  ``spark.read.format("corec")`` takes

* ``path``: a file, folder or glob, on the local or any shared file system (a URI);
* ``section``: ``eeg`` (default), ``gaze`` or ``header``;
* ``framesPerPartition``: frames are fixed-width, so a file splits by frame number.

A short EEG section ends the scan quietly; gaze frames behind a short EEG section
are an error.  ``recording`` names the file and ``sequence_id`` / ``idx`` the
place in it, which the file does not store.  ``spark.readStream`` takes the same
options and follows a folder.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MAGIC = b"CREC"
HEADER = struct.Struct("<4sIdIdII4x")
GAZE = np.dtype([("t", "<u8"), ("x", "<f4"), ("y", "<f4"), ("p", "<f4")])
SCHEMAS = {
    "eeg": "recording STRING, timestamp_ns BIGINT, channels ARRAY<FLOAT>, sequence_id BIGINT",
    "gaze": "recording STRING, timestamp_ns BIGINT, x FLOAT, y FLOAT, pupil_diameter FLOAT, idx BIGINT",
    "header": "recording STRING, sample_rate_hz DOUBLE, eeg_channels BIGINT, gaze_rate_hz DOUBLE, num_eeg_frames BIGINT, num_gaze_frames BIGINT",
}


@dataclass(frozen=True)
class Header:
    sample_rate_hz: float
    eeg_channels: int
    gaze_rate_hz: float
    num_eeg_frames: int
    num_gaze_frames: int

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise EOFError("a corec header has 40 bytes")
        magic, _, *fields = HEADER.unpack(data[: HEADER.size])
        if magic != MAGIC:
            raise ValueError("not a corec file")
        return cls(*fields)

    def to_bytes(self) -> bytes:
        return HEADER.pack(MAGIC, 1, self.sample_rate_hz, self.eeg_channels, self.gaze_rate_hz, self.num_eeg_frames, self.num_gaze_frames)

    @property
    def eeg_type(self) -> np.dtype:
        return np.dtype([("t", "<u8"), ("c", "<f4", (self.eeg_channels,))])

    @property
    def gaze_offset(self) -> int:
        return HEADER.size + self.num_eeg_frames * self.eeg_type.itemsize


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def read_header(path: str) -> Header:
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        return Header.parse(f.read(HEADER.size))


def files(path: str) -> list[str]:
    """The recordings of a file, folder or glob (in the last part), as paths or URIs like ``path``."""
    folder, _, pattern = path.rpartition("/")
    if not set("*?[") & set(pattern):
        fs, at = opened(path)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            return [path]
        folder, pattern = path.rstrip("/"), "*.corec"
    fs, at = opened(folder or ".")
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
    return [f"{folder}/{n}" if folder else n for n in names]


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    end: int


class _Frames:
    """Scans of frame ranges, for batches and streams."""

    def __init__(self, options: dict[str, str]):
        self.section = options.get("section", "eeg")
        self.size = int(options.get("framesPerPartition", 100_000))
        self.path = options["path"]

    def count(self, path: str) -> int:
        h = read_header(path)
        return {"eeg": h.num_eeg_frames, "gaze": h.num_gaze_frames, "header": 1}[self.section]

    def ranges(self, path: str, first: int, end: int) -> list[FrameRange]:
        return [FrameRange(path, lo, min(lo + self.size, end)) for lo in range(first, end, self.size)]

    def read(self, partition: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no frames at all
            return
        path, name = partition.path, os.path.basename(partition.path)
        schema = arrow_schema(self.section)
        fs, at = opened(path)
        with fs.open_input_file(at) as f:
            h = Header.parse(f.read(HEADER.size))
            if self.section == "header":
                row = [name, h.sample_rate_hz, h.eeg_channels, h.gaze_rate_hz, h.num_eeg_frames, h.num_gaze_frames]
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)
                return
            kind, offset = (h.eeg_type, HEADER.size) if self.section == "eeg" else (GAZE, h.gaze_offset)
            if self.section == "gaze" and f.size() < offset:
                raise EOFError(f"{name}: the EEG section is cut off")
            for lo in range(partition.first, partition.end, 8192):
                f.seek(min(offset + lo * kind.itemsize, f.size()))
                data = f.read((min(lo + 8192, partition.end) - lo) * kind.itemsize)
                frames = np.frombuffer(data, kind, count=len(data) // kind.itemsize)
                if not len(frames):
                    return
                n = len(frames)
                names, times = pa.array([name] * n), pa.array(frames["t"].astype(np.int64))
                numbers = pa.array(np.arange(lo, lo + n))
                if self.section == "eeg":
                    flat = pa.array(np.ascontiguousarray(frames["c"]).reshape(-1))
                    ends = pa.array(np.arange(0, (n + 1) * h.eeg_channels, h.eeg_channels)[: n + 1].astype(np.int32) if h.eeg_channels else np.zeros(n + 1, np.int32))
                    yield pa.RecordBatch.from_arrays([names, times, pa.ListArray.from_arrays(ends, flat).cast(schema.field("channels").type), numbers], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays([names, times, *(pa.array(np.ascontiguousarray(frames[c])) for c in "xyp"), numbers], schema=schema)


class CorecReader(_Frames, DataSourceReader):
    def partitions(self) -> list[FrameRange]:
        return [r for path in files(self.path) for r in self.ranges(path, 0, self.count(path))]


class CorecStream(_Frames, DataSourceStreamReader):
    """A folder's recordings as a stream: an offset holds the frames of each file so far, new files join as they come."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {os.path.basename(path): self.count(path) for path in files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        paths = {os.path.basename(p): p for p in files(self.path)}
        return [r for name in sorted(end) for r in self.ranges(paths[name], start.get(name, 0), end[name])]


def arrow_schema(section: str) -> pa.Schema:
    kinds = {"STRING": pa.string(), "BIGINT": pa.int64(), "FLOAT": pa.float32(), "DOUBLE": pa.float64(), "ARRAY<FLOAT>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in SCHEMAS[section].split(", "))])


class CorecSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corec"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("section", "eeg")]

    def reader(self, schema: StructType) -> CorecReader:
        return CorecReader(dict(self.options))

    def streamReader(self, schema: StructType) -> CorecStream:
        return CorecStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorecSource)


def _payloads(eeg: DataFrame, gaze: DataFrame, by: list[str]) -> DataFrame:
    """Both streams' frames as (by, section, number, frame): section 0 is EEG."""

    def encoded(section: int):
        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                times = batch.column("t").to_numpy().astype("<u8")
                if section:
                    frames = np.zeros(len(times), GAZE)
                    frames["t"] = times
                    for c in "xyp":
                        frames[c] = batch.column(c).to_numpy(zero_copy_only=False)
                    data = [f.tobytes() for f in frames]
                else:
                    data = [t.tobytes() + np.asarray(c.as_py() or [], "<f4").tobytes() for t, c in zip(times, batch.column("c"), strict=True)]
                keys = [batch.column(c) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(times), section, np.int32)), batch.column("number"), pa.array(data, pa.binary())], names=[*by, "section", "number", "frame"])

        return encode

    schema = "".join(f"{c} string, " for c in by) + "section int, number long, frame binary"
    e = eeg.select(*by, F.col("timestamp_ns").alias("t"), F.col("channels").alias("c"), F.col("sequence_id").cast("long").alias("number"))
    g = gaze.select(*by, F.col("timestamp_ns").alias("t"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("pupil_diameter").cast("float").alias("p"), F.col("idx").cast("long").alias("number"))
    return e.mapInArrow(encoded(0), schema).unionByName(g.mapInArrow(encoded(1), schema))


def write_corec(path: str, sample_rate_hz: float, gaze_rate_hz: float, eeg: DataFrame, gaze: DataFrame) -> None:
    """Write one recording; EEG in sequence_id order, gaze in idx order.

    The channel count is that of the first frame.  Tasks write the frames of
    ranges side by side next to ``path``, on any file system that they share; one
    task then joins the files' bytes, as a recording is one file.
    """
    spark = eeg.sparkSession
    folder = f"{path}-{uuid.uuid4().hex}"
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    try:
        first = eeg.select("sequence_id", F.size("channels").alias("n")).orderBy("sequence_id").limit(1).collect()
        channels = max(0, first[0]["n"]) if first else 0

        def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
            own, place = opened(folder)
            n = [0, 0]
            outs = [None, None]
            for batch in batches:
                for section, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    outs[section] = outs[section] or own.open_output_stream(f"{place}/{section}-{name}", compression=None, buffer_size=1 << 20)
                    outs[section].write(frame)
                    n[section] += 1
            for section, out in enumerate(outs):
                if out:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"section": pa.array([section], pa.int32()), "part": pa.array([part], pa.int32()), "name": [f"{section}-{name}"], "n": pa.array([n[section]], pa.int64())})

        dealt = _payloads(eeg, gaze, []).repartitionByRange("section", "number").sortWithinPartitions("section", "number").select("section", "frame")
        parts = sorted(map(tuple, dealt.mapInArrow(write, "section int, part int, name string, n long").collect()))  # two rows a task at most
        header = Header(sample_rate_hz, channels, gaze_rate_hz, *(sum(p[3] for p in parts if p[0] == k) for k in (0, 1)))

        def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own, place = opened(folder)
                    with own.open_output_stream(f"{place}/whole", compression=None) as out:
                        out.write(header.to_bytes())
                        for *_, name, _ in parts:
                            with own.open_input_stream(f"{place}/{name}", compression=None) as part:
                                while data := part.read(8 << 20):
                                    out.write(data)
                yield batch

        spark.range(0, 1, 1, 1).mapInArrow(join, "id long").collect()
        fs.move(f"{root}/whole", opened(path)[1])
    finally:
        fs.delete_dir(root)


def write_recordings(folder: str, headers: DataFrame, eeg: DataFrame, gaze: DataFrame) -> DataFrame:
    """Write a file for each ``recording`` of the streams, each in a task; gives recording and file size.

    ``headers`` holds recording, sample_rate_hz and gaze_rate_hz; streams of other
    recordings are left out.  A file is written under another name and moved, so a
    repeated task changes nothing.
    """
    sizes = eeg.groupBy("recording").agg(F.count(F.lit(1)).alias("n_eeg"), F.min_by(F.size("channels"), "sequence_id").alias("channels"))
    counts = headers.select("recording", "sample_rate_hz", "gaze_rate_hz").join(sizes, "recording", "left").join(gaze.groupBy("recording").agg(F.count(F.lit(1)).alias("n_gaze")), "recording", "left")
    heads = counts.select("recording", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("number"), F.struct("sample_rate_hz", F.coalesce("channels", F.lit(0)).alias("channels"), "gaze_rate_hz", F.coalesce("n_eeg", F.lit(0)).alias("n_eeg"), F.coalesce("n_gaze", F.lit(0)).alias("n_gaze")).alias("head"))
    rows = _payloads(eeg, gaze, ["recording"]).unionByName(heads, allowMissingColumns=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out = name = part = None
        size = 0

        def done() -> pa.RecordBatch:
            out.close()
            fs.move(f"{root}/{part}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"recording": [name], "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for recording, section, frame, head in zip(*(batch.column(c).to_pylist() for c in ("recording", "section", "frame", "head")), strict=True):
                if section < 0:
                    if out:
                        yield done()
                    name, part = recording, f".{recording}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{part}", compression=None, buffer_size=1 << 20)
                    frame = Header(*head.values()).to_bytes()
                    size = 0
                elif recording != name:
                    continue
                out.write(frame)
                size += len(frame)
        if out:
            yield done()

    dealt = rows.repartition("recording").sortWithinPartitions("recording", "section", "number").select("recording", "section", "frame", "head")
    return dealt.mapInArrow(write, "recording string, bytes long")
