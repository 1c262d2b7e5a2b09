"""SentencePiece merge models with seeded merge-dropout.

Encoding starts from single characters and keeps an agenda of neighbouring
symbols whose join is a piece; the best piece (highest score, then leftmost) is
taken off first.  With dropout each candidate taken off is skipped for good if
the keyed hash of (seed, variant, word, the candidate's place) falls below the
rate, so a seed gives the same segmentation on every machine and attempt, and
different seeds and variants give different ones.  At rate 0 the result equals
the library's own.

No piece joins a character that is no space to a following space, so a text is
encoded word by word.  The variant is the word's occurrence: its document's key
and its place there.  Words are remembered without dropout, with the candidates
that their agendas take; only occurrences where one of these is skipped are
encoded anew, together, one agenda step of all of them at a time.  Characters without a piece
become byte pieces.  Decoding joins the pieces' bytes: it gives the text back
exactly, whatever was dropped.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .shared import modest_batches
from .token_files import text_batches
from .words import mixed
from .workers import kept

_WORD = re.compile(r" *[^ ]+| +")
_LONG = 24
_NEVER = np.int32(1 << 30)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Pieces:
    """A merge model; ids are those of the model file."""

    def __init__(self, model: str, rate: float = 0.1, seed: int = 1, limit: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rate, self.seed, self.limit = rate, seed, limit
        self.size = sp.vocab_size()
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        text = {i: sp.id_to_piece(i).replace("▁", " ") for i in range(self.size) if i not in special and not sp.is_byte(i)}
        self.id_of = {p: i for i, p in text.items()}
        self.content = [text[i].encode() if i in text else b"" for i in range(self.size)]
        for byte, i in self.byte_id.items():
            self.content[i] = bytes([byte])
        order = sorted(text, key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(self.size, _NEVER, np.int32)
        self.rank[order] = self._ranks([sp.get_score(i) for i in order])
        self.never = np.int32(_NEVER) if len(order) >= 32767 else np.int16(32767)
        self.first = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.first[0x2581] = -1  # the space mark itself is no space: bytes keep it apart
        pairs = {}
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = pairs
        self._index(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.threshold = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        self._forget()

    def _index(self, keys: np.ndarray, joins: np.ndarray) -> None:
        """An open table of pairs, at most a quarter full: their keys, what they join to, and its rank."""
        self.bits = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys, self.joins, self.orders = np.full(size, -1, np.int64), np.full(size, -1, np.int32), np.full(size, self.never)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.joins[at[put]], self.orders[at[put]] = keys[put], joins[put], self.rank[joins[put]]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, joins, at = keys[left], joins[left], (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def _forget(self) -> None:
        """Words without dropout: their numbers, ids, hashes, and the places of the candidates that their agendas take."""
        self.number: dict[str, int] = {}
        self.ids, self.n_ids, self.start, self.size_of = np.empty(1 << 14, np.uint32), 0, np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.base, self.first_place, self.places = np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)

    @staticmethod
    def _ranks(scores: list[float]) -> list[int]:
        """Ranks of descending scores, equal ones alike."""
        out, last = [], None
        for s in scores:
            out.append(out[-1] if out and s == last else len(out))
            last = s
        return out

    def word_hashes(self, words: list[str]) -> np.ndarray:
        digest, seed = xxhash.xxh3_64_intdigest, self.seed
        return np.array([digest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)

    def word_keys(self, words: list[str], variants: list[int]) -> np.ndarray:
        return mixed(self.word_hashes(words) ^ mixed(np.array(variants, np.uint64)))

    @staticmethod
    def _place_hashes(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = (start.astype(np.uint64) << np.uint64(42)) ^ (mid.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
        return mixed(place + np.uint64(0x9E3779B97F4A7C15))

    def _skipped(self, keys: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(keys ^ self._place_hashes(start, mid, end)) < self.threshold

    def one_word(self, word: str, variant: int, taken: list | None = None) -> list[int]:
        """The agenda with a heap; symbols without a piece are given as -1 - code point.  With ``taken``, places go there and none is skipped."""
        key = self.word_keys([word], [variant])
        symbols = [int(self.first[ord(c)]) if self.first[ord(c)] >= 0 else -1 - ord(c) for c in word]
        n = len(symbols)
        start, end = list(range(n)), list(range(1, n + 1))
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[a] >= 0 and symbols[b] >= 0:
                joined = self.pairs.get(symbols[a] * self.size + symbols[b])
                if joined is not None:
                    heapq.heappush(agenda, (int(self.rank[joined]), a, b, end[b], joined))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = [True] * n
        while agenda:
            _, a, b, stop, joined = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or end[b] != stop or self.pairs.get(symbols[a] * self.size + symbols[b]) != joined:
                continue
            if taken is not None:
                taken.append((start[a], start[b], stop))
            elif self.rate > 0 and self._skipped(key, np.array([start[a]]), np.array([start[b]]), np.array([stop]))[0]:
                continue
            symbols[a], end[a], alive[b], after[a] = joined, stop, False, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the table holds pairs of symbols; an empty place where it doesn't."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.size + b, -2)
        at = self._slot(key)
        found = self.keys[at]
        left = np.flatnonzero((found >= 0) & (found != key))
        flat, wanted = at.reshape(-1), key.reshape(-1)
        while len(left):
            flat[left] = (flat[left] + 1) & (len(self.keys) - 1)
            found = self.keys[flat[left]]
            left = left[(found >= 0) & (found != wanted[left])]
        return at

    def many_words(self, words: list[str], keys: np.ndarray, taken: list | None = None) -> list[bytes]:
        """Ids of many words of at most ``_LONG`` characters: their agendas, one step of each at a time; ``taken`` as above, with word numbers.

        ``keys`` are those of :meth:`word_keys`.
        """
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        width = int(lengths.max()) + 1
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        inside = np.arange(width)[None, :] < lengths[:, None]
        symbols = np.full((n, width), -(1 << 22), np.int32)
        first = self.first[points]
        symbols[inside] = np.where(first >= 0, first, -1 - points)
        starts = np.minimum(np.arange(width, dtype=np.int8)[None, :], lengths[:, None].astype(np.int8))
        order = np.full((n, width), self.never)
        order[:, :-1] = self.orders[self._pairs(symbols[:, :-1], symbols[:, 1:])]
        out = [b""] * n
        left, column = np.arange(n), np.arange(width)
        while len(left):
            at = order.argmin(axis=1)
            row = np.arange(len(left))
            live = order[row, at] < self.never
            if live.sum() <= 0.8 * len(left):  # finished words stay until a fifth is
                self._finish(out, left[~live], lengths[~live], symbols[~live])
                left, at, keys, lengths = left[live], at[live], keys[live], lengths[live]
                symbols, starts, order = symbols[live], starts[live], order[live]
                row, live = np.arange(len(left)), np.ones(len(left), bool)
            place = starts[row, at], starts[row, at + 1], starts[row, np.minimum(at + 2, width - 1)]
            if taken is not None:
                taken.append((left[live], *(x[live] for x in place)))
            elif self.rate > 0:
                skip = live & self._skipped(keys, *place)
                order[row[skip], at[skip]] = self.never
                live &= ~skip
            if not live.any():
                continue
            row, at = row[live], at[live]
            symbols[row, at] = self.joins[self._pairs(symbols[row, at], symbols[row, at + 1])]
            last = np.full(len(left), width)
            last[row] = at
            behind = column[None, :-1] > last[:, None]
            for m in (symbols, starts, order):
                np.copyto(m[:, :-1], m[:, 1:].copy(), where=behind)
            lengths[row] -= 1
            r, side = np.concatenate([row[at > 0], row]), np.concatenate([at[at > 0] - 1, at])
            order[r, side] = self.orders[self._pairs(symbols[r, side], symbols[r, side + 1])]
        return out

    def _finish(self, out: list[bytes], numbers: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> None:
        whole = np.logical_or.reduce((symbols < 0) & (np.arange(symbols.shape[1]) < lengths[:, None]), axis=1).tolist()
        for i, n, s, odd in zip(numbers.tolist(), lengths.tolist(), symbols.astype("<u4"), whole, strict=True):
            out[i] = self._bytes(s[:n].view("<i4").tolist()) if odd else s[:n].tobytes()

    def _bytes(self, symbols: list[int]) -> bytes:
        ids = []
        for s in symbols:
            ids.extend([s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")])
        return np.array(ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember words without dropout."""
        ids: dict[str, bytes] = {}
        owners, places = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        at = {w: i for i, w in enumerate(new)}
        for w in (w for w in new if len(w) > _LONG):
            taken: list = []
            ids[w] = self._bytes(self.one_word(w, 0, taken))
            if taken:
                owners.append(np.full(len(taken), at[w])), places.append(self._place_hashes(*np.array(taken).T))
        short = sorted((w for w in new if len(w) <= _LONG), key=len)  # words of one length are cheapest together
        for lo in range(0, len(short), 4096):
            part, taken = short[lo : lo + 4096], []
            ids.update(zip(part, self.many_words(part, np.zeros(len(part), np.uint64), taken), strict=True))
            numbers = np.array([at[w] for w in part])
            for own, *place in taken:
                owners.append(numbers[own]), places.append(self._place_hashes(*place))
        owner = np.concatenate(owners)
        self.places = np.concatenate([self.places, np.concatenate(places)[np.argsort(owner, kind="stable")]])
        self.first_place = np.concatenate([self.first_place, self.first_place[-1] + np.cumsum(np.bincount(owner, minlength=len(new)))])
        self.base = np.concatenate([self.base, self.word_hashes(new)])
        known = len(self.number)
        self.number.update(zip(new, range(known, known + len(new)), strict=True))
        self._keep(known, list(map(ids.__getitem__, new)))

    def _keep(self, first: int, ids: list[bytes]) -> None:
        """Put ids at the end of the flat array, as those of the entries from ``first`` on."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        self.start, self.size_of, self.ids = (grown(a, n) for a, n in ((self.start, first + len(ids)), (self.size_of, first + len(ids)), (self.ids, self.n_ids + len(flat))))
        self.start[first : first + len(ids)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size_of[first : first + len(ids)] = sizes
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text behind a space, each with the spaces before it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or "\x01" in text:
            return _WORD.findall(" " + text)
        return (" " + text).replace(" ", "\x01 ").split("\x01")[1:]

    def encode_many(self, keys: list[int], texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text; each word's dropout follows from the text's key and its place there.

        A word whose agenda without dropout has no candidate skipped is as
        remembered; the others' agendas run anew, occurrence by occurrence.
        """
        cut = [self.words(text) for text in texts]
        flat = [w for words in cut for w in words]
        if not flat:
            return [b"" for _ in texts]
        if len(self.number) > self.limit:
            self._forget()
        if new := [w for w in dict.fromkeys(flat) if w not in self.number]:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(words) for words in cut])
        held, entry = self.n_ids, number.copy()
        if self.rate > 0:
            places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            variants = mixed(np.repeat(mixed(np.array(keys, np.uint64) + np.uint64(1)), lengths) + places.astype(np.uint64))
            drops = mixed(self.base[number] ^ mixed(variants))
            first, n = self.first_place[number], self.first_place[number + 1] - self.first_place[number]
            own = np.repeat(np.arange(len(flat)), n)
            at = np.arange(len(own)) + np.repeat(first - (np.cumsum(n) - n), n)
            hit = np.unique(own[mixed(drops[own] ^ self.places[at]) < self.threshold])
            sizes = np.fromiter((len(flat[i]) for i in hit.tolist()), np.int64, len(hit))
            short = hit[np.argsort(sizes, kind="stable")][: int((sizes <= _LONG).sum())].tolist()
            far = hit[sizes > _LONG].tolist()
            anew = [self._bytes(self.one_word(flat[i], int(variants[i]))) for i in far]
            for lo in range(0, len(short), 4096):
                some = short[lo : lo + 4096]
                anew += self.many_words([flat[i] for i in some], drops[some])
            entry[far + short] = np.arange(len(self.number), len(self.number) + len(anew))
            self._keep(len(self.number), anew)  # until the next call
        size = self.size_of[entry]
        begin = np.cumsum(size) - size
        whole = self.ids[np.repeat(self.start[entry] - begin, size) + np.arange(int(size.sum()))]
        self.n_ids = held
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [whole[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str, key: int = 0) -> list[int]:
        return np.frombuffer(self.encode_many([key], [text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The exact text of encoded ids."""
        return b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def pieces(model: str, rate: float, seed: int) -> Pieces:
    """The model of this worker process, which keeps its words from task to task."""
    return kept(("pieces", model, rate, seed), lambda: Pieces(model, rate, seed))


def piece_report(docs: DataFrame, model: str | None = None, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_chars, ids_crc32 and whether decoding gave the text back, for every row.

    Null and empty texts have no tokens.  A word's dropout follows from its
    text's checksum and its place there, so equal texts are segmented alike
    whatever their ids.
    """
    model = model or default_model()
    modest_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model, rate, seed)
        for ids, texts in text_batches(batches):
            keys = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            encoded = coder.encode_many(keys, texts)
            same = [coder.decode(np.frombuffer(e, "<u4").tolist()) == t for e, t in zip(encoded, texts, strict=True)]
            counts = [[len(e) // 4 for e in encoded], [len(t) for t in texts], [zlib.crc32(e) for e in encoded]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(same)], names=["doc_id", "n_tokens", "n_chars", "ids_crc32", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_chars long, ids_crc32 long, lossless boolean")
