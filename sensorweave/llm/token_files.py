"""Token ids in files of independent zstandard frames with a seek table.

Layout, readable by any zstandard tool:

* data frames, each the ids of whole documents, at least ``frame_ids`` of them
  but for the last; every frame carries zstandard's own content checksum;
* one index frame: for every document of the file its id, frame and number of ids;
* a skippable frame, the seek table: for each frame its compressed size, its
  size and the low half of the XXH64 of its content (all unsigned 32-bit), then
  the number of frames, a descriptor byte and the closing magic number.

A reader seeks to the table, then to the index, and decompresses only the frames
that hold the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import more_partitions, shared_folder, written
from .tokens import END_ID, default_vocabulary, encoder

#: Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")
_INDEX = np.dtype([("frame", "<u4"), ("n", "<u4"), ("known", "u1"), ("doc_id", "<i8")])


class TokenWriter:
    """Writes one file; ``add`` takes little-endian unsigned 32-bit ids."""

    def __init__(self, out, width: int, frame_ids: int = 1 << 16, level: int = 3):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((len(self.frames), len(ids), doc_id is not None, doc_id or 0))
        self.held.append(ids.astype(f"<u{self.width}").tobytes())
        self.n_held += len(ids)
        if self.n_held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        self._frame(b"".join(self.held))
        self.held, self.n_held = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._flush()
        self._frame(bytes([self.width]) + np.array(self.index, _INDEX).tobytes())
        table = np.array(self.frames, "<u4").tobytes() + _FOOTER.pack(len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(_HEAD.pack(SKIPPABLE_MAGIC, len(table)) + table)


class TokenReader:
    """Random access to a file written by :class:`TokenWriter`."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, descriptor, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or descriptor != HAS_CHECKSUMS:
            raise ValueError("no seek table")
        table = self._at(size - _FOOTER.size - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        index = self._frame(n - 1)
        self.width = index[0]
        self.index = np.frombuffer(index, _INDEX, offset=1)
        counts = self.index["n"].astype(np.int64)
        ends = np.cumsum(counts)
        self.starts = ends - counts
        _, first = np.unique(self.index["frame"], return_index=True)
        self.frame_start = dict(zip(self.index["frame"][first].tolist(), self.starts[first].tolist(), strict=True))
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.frames[k, 0])))
        if len(content) != self.frames[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def document(self, row: int) -> np.ndarray:
        """Ids of the ``row``-th document of the file; only its frame is decompressed."""
        k = int(self.index["frame"][row])
        if self.last[0] != k:
            self.last = (k, np.frombuffer(self._frame(k), f"<u{self.width}").astype("<u4"))
        start = int(self.starts[row]) - self.frame_start[k]
        return self.last[1][start : start + int(self.index["n"][row])]


def text_batches(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """(first column, texts) in pieces of about ``most`` characters; null texts are empty."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        lo, held, n = 0, [], 0
        for i, t in enumerate(texts):
            held.append(t.as_py() or "")
            n += len(held[-1])
            if n >= most:
                yield keys[lo : i + 1], held
                lo, held, n = i + 1, [], 0
        if held:
            yield keys[lo:], held


def by_id(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id over all partitions, nulls first, rows of one id by their text's hash.

    Equal rows are interchangeable and also numbered, so that however many of
    them there are, they go to several tasks.  There are as many partitions as
    the session asks for, or as the size of the input does if that is more.
    """
    keys = ["doc_id", "__hash", "__row"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    return keyed.repartitionByRange(*more_partitions(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order; one manifest row a file.

    Files are named by attempt and count only through the manifest, which is
    written once: a repeated or speculative task leaves an unread file behind.
    Null texts are empty, null ids come first, rows of one id go by their text's hash.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        coder = encoder(vocabulary)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = TokenWriter(out, width)
            for keys, texts in text_batches(batches):
                for key, ids in zip(keys, coder.encode_many(texts), strict=True):
                    got = np.frombuffer(ids + end, "<u4")
                    writer.add(key, got)
                    n_docs, n_ids = n_docs + 1, n_ids + len(got)
            writer.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            fs.delete_file(f"{root}/{name}")

    return written(by_id(docs).mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    ``start`` counts the ids of all files and documents before it.  What reaches
    the driver is the manifest, one row for each file.
    """
    spark = manifest.sparkSession
    files = sorted((r["part"], r["file"], r["n_ids"]) for r in manifest.collect())
    bases = np.concatenate(([0], np.cumsum([n for _, _, n in files], dtype=np.int64))).tolist() if files else [0]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{files[i][1]}") as source:
                    reader = TokenReader(source)
                    index = reader.index
                    crcs = [zlib.crc32(reader.document(row).tobytes()) for row in range(len(index))]
                    ids = [int(d) if known else None for d, known in zip(index["doc_id"], index["known"], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(bases[i] + reader.starts, pa.int64()), "n_tokens": pa.array(index["n"].astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read every document back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary), folder).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
