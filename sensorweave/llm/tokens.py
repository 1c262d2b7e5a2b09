"""Byte-level BPE encoding by the ``tokenizers`` library, remembered chunk by chunk.

The library's pre-tokeniser never lets a token cross from a non-space character
to a following single space or newline that is itself followed by a non-space
character.  A text is therefore cut before every space and newline, each
different chunk is encoded once per worker by the library, and the ids are
joined; a text in which white space touches white space, or which spells a
special token, goes to the library whole.  The ids equal those of encoding the
whole text (tests/llm/test_tokens.py).

Chunks are cut, hashed (two 64-bit polynomials over their bytes, from running
sums), looked up and replaced by their ids in numpy, a batch of texts at a time.
What is found by hash is compared byte by byte; a text with a chunk that only
shares another's hashes goes to the library whole.  A remembered chunk takes some
40 bytes besides its own, and at most ``limit`` are.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from .words import Powers
from .workers import kept

END_ID = 0



def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_NEWLINE = _BYTE_LETTERS[10]


class ChunkTable:
    """Token ids by 128-bit hash: open addressing over entries of growing arrays of ids and of the chunks' bytes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.mask = np.uint64((1 << max(4, (2 * limit - 1).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0
        self.first, self.second = np.empty(limit, np.uint64), np.empty(limit, np.uint64)
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.n_ids = np.empty(1 << 14, np.uint32), 0
        self.text_start, self.text_length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.text, self.n_text = np.empty(1 << 14, np.uint8), 0

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Entry of each hash pair, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            e = self.slots[at]
            there = e >= 0
            left, at, e = left[there], at[there], e[there]
            same = (self.first[e] == h[left]) & (self.second[e] == g[left])
            out[left[same]] = e[same]
            left, at = left[~same], (at[~same] + np.uint64(1)) & self.mask
        return out

    def holds(self, entries: np.ndarray, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether each entry's bytes are those of its chunk; the chunks follow each other over all of ``raw``."""
        lengths = np.diff(np.append(start, len(raw)))
        fits = self.text_length[entries] == lengths
        at = np.repeat(np.where(fits, self.text_start[entries], 0) - np.where(fits, start, 0), lengths)
        at += np.arange(len(raw)) * np.repeat(fits, lengths)
        return fits & ~np.logical_or.reduceat(self.text[at] != raw, start)

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[bytes], chunks: list[bytes]) -> np.ndarray:
        """Entries for new, different hash pairs; those beyond the limit hold until the next call only."""
        entries = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        self.start = _grown(self.start, self.n + len(ids))
        self.length = _grown(self.length, self.n + len(ids))
        self.ids = _grown(self.ids, self.n_ids + len(flat))
        self.start[entries] = self.n_ids + np.cumsum(lengths) - lengths
        self.length[entries] = lengths
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = np.frombuffer(b"".join(chunks), np.uint8)
        self.text_start = _grown(self.text_start, self.n + len(ids))
        self.text_length = _grown(self.text_length, self.n + len(ids))
        self.text = _grown(self.text, self.n_text + len(text))
        self.text_start[entries] = self.n_text + np.cumsum(sizes) - sizes
        self.text_length[entries] = sizes
        self.text[self.n_text : self.n_text + len(text)] = text
        keep = min(len(ids), self.limit - self.n)
        self._place(entries[:keep], h[:keep], g[:keep])
        self.n += keep
        self.n_ids += int(lengths[:keep].sum())
        self.n_text += int(sizes[:keep].sum())
        return entries

    def _place(self, entries: np.ndarray, h: np.ndarray, g: np.ndarray) -> None:
        self.first[entries], self.second[entries] = h, g
        at = h & self.mask
        while len(entries):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]] = entries[put]
            left = np.ones(len(entries), bool)
            left[put] = False
            entries, at = entries[left], (at[left] + np.uint64(1)) & self.mask

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of entries, and where each entry's begin there (one more for the end)."""
        lengths = self.length[entries].astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.start[entries] - begin[:-1], lengths)
        at += np.arange(len(at))
        return self.ids[at], begin


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


#: Texts are taken together, and longer ones apart, up to about so many bytes.
TOGETHER = 1 << 19


class Encoder:
    """Texts to little-endian uint32 ids, with bounded memory of chunks."""

    def __init__(self, vocabulary: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.newline = self.tokenizer.token_to_id(_NEWLINE)
        self.by_word = Tokenizer.from_file(vocabulary)
        self.by_word.pre_tokenizer = pre_tokenizers.Split(_NEWLINE, "isolated")
        self.known = ChunkTable(limit)
        self.first, self.second = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks; none at all for one with white space inside or nothing else, where a cut proves nothing."""
        newline = self.newline.to_bytes(4, "little")
        bare = [c[1:] if c[0] == "\n" else c for c in chunks]
        letters = [i for i, c in enumerate(bare) if (c[1:] if c[:1] == " " else c).isalpha()]
        alike = set(letters)
        others = [i for i, c in enumerate(bare) if i not in alike and len(c.split()) == 1 and not c[-1].isspace() and (c[0] == " " or not c[0].isspace()) and not (c[0] == " " and chunks[i][0] == "\n")]
        out = [b""] * len(chunks)
        mapped = "\n".join([bare[i] for i in letters]).encode().decode("latin-1").translate(_BYTE_LETTERS).split(_NEWLINE) if letters else []
        for rows, found in ((letters, self._apart(self.by_word, mapped, _NEWLINE)), (others, self._apart(self.tokenizer, [bare[i] for i in others], "\n"))):
            for i, ids in zip(rows, found, strict=True):
                out[i] = newline + ids if chunks[i][0] == "\n" else ids
        return out

    def _apart(self, tokenizer, words: list[str], newline: str, together: int = 64) -> Iterator[bytes]:
        """Ids of each word, many in a call: newlines, always tokens of their own before a word, part them.

        Letters behind at most one space are one pre-token, so ``by_word`` need
        not search for pre-tokens in them.
        """
        texts = [newline.join(words[i : i + together]) for i in range(0, len(words), together)]
        for encoded in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield from self._split(encoded.ids)

    def _split(self, ids: list[int]) -> list[bytes]:
        """The ids between newlines as bytes."""
        whole = array("I", ids).tobytes()
        if self.size <= self.newline << 8:  # then no two ids hold the newline's bytes across their border
            return whole.split(self.newline.to_bytes(4, "little"))
        cuts = [i for i, x in enumerate(ids) if x == self.newline]
        return [whole[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids of one whole text, without an end id."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, without end ids."""
        out: list[bytes | None] = [None if t and not any(s in t for s in self.specials) else b"" for t in texts]
        whole = [i for i, t in enumerate(texts) if t and out[i] is not None]
        held: list[tuple[int, bytes]] = []
        n = 0
        for i, t in enumerate(texts):
            if out[i] is None:
                data = t.encode()
                if len(data) > TOGETHER:
                    out[i] = self._long(data)
                    continue
                held.append((i, data))
                n += len(data)
                if n >= TOGETHER:
                    self._batch(held, out)
                    held, n = [], 0
        if held:
            self._batch(held, out)
        for i in [*whole, *(i for i, ids in enumerate(out) if ids is None)]:
            out[i] = self._library([texts[i]])[0]
        return out

    def _long(self, data: bytes) -> bytes | None:
        """Ids of a long text, cut before spaces that stand alone; None if there are none or a part is unsafe."""
        parts, at = [], 0
        while len(data) - at > TOGETHER:
            cut = data.rfind(b" ", at + 1, at + TOGETHER)
            if cut < 0:
                return None
            parts.append(data[at:cut])
            at = cut
        parts.append(data[at:])
        out: list[bytes | None] = [None] * len(parts)
        for k, part in enumerate(parts):
            self._batch([(k, part)], out)
        return None if None in out else b"".join(out)

    def _batch(self, held: list[tuple[int, bytes]], out: list[bytes | None]) -> None:
        """Put the ids of each (place, text) into ``out``, or leave None where a cut would be unsafe."""
        data = b"".join([d for _, d in held])
        raw = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *(len(d) for _, d in held)])
        cut = (raw == 32) | (raw == 10)
        cut[begins[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        numbers = raw.astype(np.uint64)
        h, g = self.first.hashes(numbers, start, end), self.second.hashes(numbers, start, end)
        entries = self.known.find(h, g)
        new = np.flatnonzero(entries < 0)
        if len(new):
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[one]
            chunks = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            entries[new] = self.known.add(h[at], g[at], self._encoded([c.decode("utf-8", "replace") for c in chunks]), chunks)[back]
        ids, place = self.known.ids_of(entries)
        first = np.searchsorted(start, begins[:-1])
        unsafe = np.logical_or.reduceat((self.known.length[entries] == 0) | ~self.known.holds(entries, raw, start), first)
        at = place[np.append(first, len(start))].tolist()
        for k, (i, _) in enumerate(held):
            if not unsafe[k]:
                out[i] = ids[at[k] : at[k + 1]].tobytes()

    @cached_property
    def sentence_ends(self) -> np.ndarray:
        """For every id, whether its text ends a sentence or a line."""
        ends = np.zeros(self.size, bool)
        for i in range(self.size):
            piece = self.tokenizer.decode([i], skip_special_tokens=False)
            ends[i] = piece.rstrip(" \"')")[-1:] in (".", "!", "?", "\n", "。") if piece else False
        return ends


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process, which keeps its chunks from task to task."""
    return kept(("encoder", vocabulary), lambda: Encoder(vocabulary))
