"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents keep their doc_id order and form one stream for each range partition.
A window may end at a document end (free), after a token that ends a sentence
(``sentence_penalty``), or, where neither comes for ``stride`` tokens, at a
forced cut (``forced_penalty``).  With f(e) the least cost of cutting the stream
at e,

    f(e) = penalty(e) + capacity - e + min over e - capacity <= s < e of (f(s) + s)

whose minimum over a sliding range of s comes from a monotone queue, so a stream
of n candidate cuts takes O(n).  The recurrence runs over the whole stream: a cut
is given out as soon as all candidates that can still be followed lead back to
it, so what is held are the ids since then, whatever the blocks they come in.
The last window of a stream is written as windows of power-of-two lengths, which
need no padding, where that is cheaper.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import modest_batches
from .token_files import by_id, text_batches
from .tokens import END_ID, default_vocabulary, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Costs:
    capacity: int = 1024
    sentence_penalty: int = 6
    forced_penalty: int = 48
    stride: int = 64


class Cutter:
    """The recurrence over a stream that comes in parts.

    Of starts of equal cost the later one is taken: then the ways to the
    candidates soon run together.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at, self.keys, self.back = [0], [0], [0]  # keys: f(e) + e
        self.queue = deque([0])  # candidates of rising keys

    def extend(self, ends: list[int], penalties: list[int]) -> None:
        """``ends`` ascend from above the last one and no two neighbours lie more than ``capacity`` apart."""
        at, keys, back, queue, capacity = self.at, self.keys, self.back, self.queue, self.capacity
        for end, penalty in zip(ends, penalties, strict=True):
            while at[queue[0]] < end - capacity:
                queue.popleft()
            i = queue[0]
            key = keys[i] + capacity + penalty
            while queue and keys[queue[-1]] >= key:
                queue.pop()
            queue.append(len(at))
            at.append(end), keys.append(key), back.append(i)

    def _path(self, j: int) -> list[int]:
        cuts = []
        while j:
            cuts.append(self.at[j])
            j = self.back[j]
        return cuts[::-1]

    def _restart(self, j: int) -> None:
        self.at, self.keys = self.at[j:], [k - self.keys[j] for k in self.keys[j:]]
        self.back = [0, *(max(b - j, 0) for b in self.back[j + 1 :])]

    def settled(self) -> list[int]:
        """Cuts that every way on shares; the stream goes on behind the last of them."""
        alive = [-j for j in self.queue]
        heapify(alive)
        while len(alive) > 1:
            j = -heappop(alive)
            if j != -alive[0]:
                heappush(alive, -self.back[j])
        j = -alive[0]
        cuts = self._path(j)
        if cuts:
            self._restart(j)
            self.queue = deque(i - j for i in self.queue)
        return cuts

    def rest(self) -> list[int]:
        """Cuts of the best way to the last end; a stream that goes on starts there."""
        j = len(self.at) - 1
        cuts = self._path(j)
        self._restart(j)
        self.queue = deque([0])
        return cuts


def best_cuts(ends: list[int], penalties: list[int], capacity: int) -> list[int]:
    """Cut positions (the last of ``ends`` included) of least padding plus penalties."""
    cutter = Cutter(capacity)
    cutter.extend(ends, penalties)
    return cutter.rest()


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, costs: Costs) -> tuple[list[int], list[int]]:
    """Possible cuts of a stream and their penalties."""
    ends_here = sentence_end[ids]
    ends_doc = np.zeros(len(ids), bool)
    ends_doc[doc_ends - 1] = True
    at = np.flatnonzero(ends_here | ends_doc) + 1
    gaps = np.diff(np.concatenate(([0], at)))
    wide = np.flatnonzero(gaps > costs.stride)
    filled = [np.arange(at[i] - gaps[i] + costs.stride, at[i], costs.stride) for i in wide]
    forced = np.concatenate(filled) if filled else np.empty(0, np.int64)
    ends = np.concatenate([at, forced])
    penalty = np.concatenate([np.where(ends_doc[at - 1], 0, costs.sentence_penalty), np.full(len(forced), costs.forced_penalty)])
    order = np.argsort(ends, kind="stable")
    return ends[order].tolist(), penalty[order].tolist()


def last_windows(length: int, costs: Costs) -> list[int]:
    """Lengths that the last window of a stream is written in."""
    powers = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return powers if (len(powers) - 1) * costs.forced_penalty < costs.capacity - length else [length]


class Packer:
    """Takes documents in order and gives the pieces of finished windows.

    ``block`` ids are taken into the recurrence together, which changes nothing
    in the result.  Only a stream of which ``most`` ids are held without a
    settled cut (lengths that fall into step with the windows for long, or one
    document of that many ids) is cut along the best way so far.
    """

    def __init__(self, sentence_end: np.ndarray, costs: Costs, first_sequence: int, block: int = 1 << 17, most: int = 1 << 25):
        self.sentence_end, self.costs, self.sequence, self.block, self.most = sentence_end, costs, first_sequence, block, most
        self.cutter = Cutter(costs.capacity)
        self.new: list[np.ndarray] = []
        self.parts: deque[tuple[int | None, int, int, np.ndarray]] = deque()  # doc_id, ids given out, all ids, ids left
        self.cut = self.end = self.seen = 0  # places in the stream: last cut, all ids, those in the recurrence

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append((doc_id, 0, len(ids), ids))
        self.new.append(ids)
        self.end += len(ids)
        if self.end - self.seen >= self.block:
            self._extend()
            yield from self._pieces(self.cutter.settled())
            if self.end - self.cut > self.most:
                yield from self._pieces(self.cutter.rest())

    def finish(self) -> Iterator[tuple]:
        if self.new:
            self._extend()
        cuts = self.cutter.rest()
        if cuts:
            start = cuts[-2] if len(cuts) > 1 else self.cut
            cuts = [*cuts[:-1], *(start + np.cumsum(last_windows(cuts[-1] - start, self.costs))).tolist()]
        yield from self._pieces(cuts)

    def _extend(self) -> None:
        doc_ends = np.cumsum([len(x) for x in self.new])
        ends, penalties = candidates(np.concatenate(self.new), doc_ends, self.sentence_end, self.costs)
        self.cutter.extend([self.seen + e for e in ends], penalties)
        self.new, self.seen = [], self.end

    def _pieces(self, cuts: list[int]) -> Iterator[tuple]:
        for cut in cuts:
            offset = 0
            while self.cut < cut:
                doc_id, given, total, ids = self.parts[0]
                n = min(cut - self.cut, len(ids))
                yield doc_id, given, n, zlib.crc32(ids[:n].tobytes()), total, self.sequence, offset
                offset += n
                self.cut += n
                if n < len(ids):
                    self.parts[0] = (doc_id, given + n, total, ids[n:])
                else:
                    self.parts.popleft()
            self.sequence += 1


def pack_documents(docs: DataFrame, costs: Costs = Costs(), vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids, each with its sequence and offset there.

    A null or empty text is its end id alone.  Documents are taken in ascending
    doc_id (nulls first, rows of one id by their text's hash).  A range partition
    is one stream: windows never reach over into the next, and ``sequence_id`` is
    the partition times 2**40 plus a count.
    """
    vocabulary = vocabulary or default_vocabulary()
    modest_batches(docs.sparkSession)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(coder.sentence_ends, costs, TaskContext.get().partitionId() << 40)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

        for keys, texts in text_batches(batches):
            rows: list[tuple] = []
            for key, ids in zip(keys, coder.encode_many(texts), strict=True):
                rows.extend(packer.add(key, np.frombuffer(ids + end, "<u4")))
            if rows:
                yield table(rows)
        if rows := list(packer.finish()):
            yield table(rows)

    return by_id(docs).mapInArrow(pack, PIECES)
