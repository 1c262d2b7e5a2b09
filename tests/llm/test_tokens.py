import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sensorweave.llm import packing, token_files, tokens
from sensorweave.llm.tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary(), limit=500)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_chunks_give_the_library_s_ids(encoder, texts):
    whole = list(texts.values())
    for _ in range(2):
        assert encoder.encode_many(whole) == encoder._library(whole)


def test_random_texts_give_the_library_s_ids(encoder):
    rng = random.Random(4)
    parts = ["a", "b", "é", "1", " ", "\n", "\t", ".", ",", "'", "s", "ll", "\x1c", "\x01", "日", "_", "\xa0", " ", "<|endoftext|>", "!", "A", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert encoder.encode(text) == encoder._library([text])[0], repr(text)


def test_long_texts(encoder, texts):
    long = "\n".join(list(texts.values())) * 3
    assert len(long.encode()) > 2 * tokens.TOGETHER
    for text in (long, long + "  x", "ab" * tokens.TOGETHER, long[: tokens.TOGETHER + 50].replace(" ", "_")):
        assert encoder.encode(text) == encoder._library([text])[0]


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_chunks_of_equal_hashes(library):
    """Polynomials modulo 2**64 give a Thue-Morse word and its complement one hash, whatever their base."""
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    for batches in ([[one], [other]], [[other, one]], [[f"x {one} y", f"x {other} y", f"{one} {other}"]], [["a"], [one], ["b", other, one]]):
        coder = Encoder(default_vocabulary(), limit=50)
        for _ in range(2):
            for batch in batches:
                assert coder.encode_many(batch) == coder._library(batch)


def test_table_of_chunks():
    rng = np.random.default_rng(1)
    table = tokens.ChunkTable(100)
    h = rng.integers(0, 40, 300, dtype=np.uint64) << np.uint64(40)  # many collisions of slots
    h, g = h + np.arange(300, dtype=np.uint64) * np.uint64(1 << 20), rng.integers(0, 2**63, 300, dtype=np.uint64)
    for lo in range(0, 300, 60):
        new = [np.full(k % 4, lo + k, "<u4").tobytes() for k in range(60)]
        chunks = [b"x" * (k % 5 + 1) + bytes([k]) for k in range(60)]
        entries = table.add(h[lo : lo + 60], g[lo : lo + 60], new, chunks)
        start = np.cumsum([0, *map(len, chunks)])[:-1]
        for k in (0, 7):
            raw = np.frombuffer(b"".join([*chunks[:k], chunks[k][:-1] + b"?", *chunks[k + 1 :]]), np.uint8)
            assert np.flatnonzero(~table.holds(entries, raw, start)).tolist() == [k]
        assert np.flatnonzero(~table.holds(np.roll(entries, 5), raw, start)).tolist() == list(range(60))
        ids, begin = table.ids_of(entries)
        assert [ids[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)] == new
    found = table.find(h, g)
    assert (found[:100] == np.arange(100)).all() and (found[100:] == -1).all()
    assert (table.find(h, g + np.uint64(1)) == -1).all()


def test_file_reads_back_single_documents():
    out = io.BytesIO()
    writer = token_files.TokenWriter(out, 2, frame_ids=10)
    docs = [np.arange(n, dtype="<u4") for n in (3, 0, 25, 4, 4)]
    for i, d in enumerate(docs):
        writer.add(i if i != 1 else None, d)
    writer.close()
    reader = token_files.TokenReader(pa.BufferReader(out.getvalue()))
    assert len(reader.frames) == 3
    for i in (4, 0, 2, 1, 3):
        assert reader.document(i).tolist() == docs[i].tolist()
    assert reader.index["known"].tolist() == [1, 0, 1, 1, 1]
    damaged = bytearray(out.getvalue())
    damaged[6] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  either library or checksum notices
        token_files.TokenReader(pa.BufferReader(bytes(damaged))).document(0)
    with pytest.raises(ValueError, match="seek table"):
        token_files.TokenReader(pa.BufferReader(b"\0" * 40))


def test_round_trip(documents, texts, library):
    rows = sorted(token_files.token_round_trip(documents).collect(), key=lambda r: r.doc_id)
    at = 0
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        want = ids(library, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), crc(want))
        at += len(want)


def test_round_trip_of_odd_rows(odd, none, odd_rows, library):
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.token_round_trip(odd).collect())
    assert got == sorted((repr(i), len(ids(library, t)), crc(ids(library, t))) for i, t in odd_rows)
    assert token_files.token_round_trip(none).count() == 0


def pieces_hold(rows, wanted):
    """Every id in one piece, windows gapless and short enough; gives the share of padding."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        want = wanted[key[0]]
        at = 0
        for p in pieces:
            assert p.start == at and p.length > 0 and p.ids_crc32 == crc(want[at : at + p.length])
            at += p.length
        assert at == len(want) == key[1]
    total = padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(total, 1)


def test_packing(documents, texts, library):
    rows = packing.pack_documents(documents).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert pieces_hold(rows, {k: ids(library, t) for k, t in texts.items()}) < 0.05


def test_hot_ids_and_few_partitions(spark, library):
    """A third of all rows may have one id, or none: they are dealt to several tasks."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "same text" if i % 2 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = token_files.by_id(docs).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        got = token_files.token_round_trip(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2.5 * 900 / len(sizes)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i is None, i or 0, crc(ids(library, t))) for i, t in rows)


def test_packing_odd_rows(odd, none, odd_rows, library):
    distinct = {}
    for i, t in odd_rows:
        distinct.setdefault(i, t)
    rows = packing.pack_documents(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    pieces_hold(rows, {k: ids(library, t) for k, t in distinct.items() if k is not None})
    total = sum(len(ids(library, t)) for _, t in odd_rows)
    assert sum(r.length for r in packing.pack_documents(odd).collect()) == total
    assert packing.pack_documents(none).count() == 0


def cost(ends, penalties, cuts, capacity):
    paid = dict(zip(ends, penalties, strict=True))
    return sum(paid[c] + capacity - (c - b) for b, c in zip([0, *cuts], cuts, strict=False))


def best_by_brute_force(ends, penalties, capacity):
    at = [0, *ends]
    best = [0]
    for j in range(1, len(at)):
        best.append(min(best[i] + capacity - (at[j] - at[i]) + penalties[j - 1] for i in range(j) if at[j] - at[i] <= capacity))
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(300):
        ends, at = [], 0
        for _ in range(rng.randrange(1, 40)):
            at += rng.randrange(1, 9)
            ends.append(at)
        penalties = [rng.choice([0, 1, 3, 7]) for _ in ends]
        cuts = packing.best_cuts(ends, penalties, 12)
        assert cuts[-1] == at and set(cuts) <= set(ends)
        assert cost(ends, penalties, cuts, 12) == best_by_brute_force(ends, penalties, 12)


def packed(docs, sentence_end, costs, **kwargs):
    packer = packing.Packer(sentence_end, costs, 0, **kwargs)
    return [x for i, d in enumerate(docs) for x in packer.add(i, d)] + list(packer.finish())


def test_blocks_change_nothing():
    rng = np.random.default_rng(6)
    costs = packing.Costs(capacity=32, stride=8)
    for trial in range(60):
        sentence_end = rng.random(50) < 0.1
        sizes = [8] * 100 if trial == 0 else rng.integers(1, (90, 12, 30)[trial % 3], 60)
        docs = [rng.integers(0, 50, n).astype("<u4") for n in sizes]
        whole = packed(docs, sentence_end, costs, block=1 << 20)
        for block in (1, 20, 300):
            assert packed(docs, sentence_end, costs, block=block) == whole
        stream = np.concatenate(docs)
        ends, penalties = packing.candidates(stream, np.cumsum(sizes), sentence_end, costs)
        windows = {}
        for _, _, length, _, _, sequence, _ in whole:
            windows[sequence] = windows.get(sequence, 0) + length
        cuts = np.cumsum([windows[k] for k in sorted(windows)]).tolist()
        cuts = [c for c in cuts if c in set(ends)]
        last = packing.last_windows(len(stream) - max([0, *(c for c in cuts if c < len(stream))]), costs)
        if len(last) == 1:  # else the last window is written in parts, of other costs
            assert cost(ends, penalties, cuts, 32) == best_by_brute_force(ends, penalties, 32)


def test_settled_cuts_come_early():
    """Equal lengths and endless sentences settle, too."""
    costs = packing.Costs()
    for sizes in ([64] * 40_000, [300, 724] * 3000, [1024] * 3000):
        packer, most = packing.Packer(np.zeros(10, bool), costs, 0, block=1), 0
        for i, n in enumerate(sizes):
            list(packer.add(i, np.ones(n, "<u4")))
            most = max(most, packer.end - packer.cut)
        assert most <= 4 * costs.capacity
    held = packing.Packer(np.zeros(10, bool), costs, 0, most=5000)
    rows = [x for i in range(3) for x in held.add(i, np.ones(1 << 18, "<u4"))] + list(held.finish())
    assert sum(r[2] for r in rows) == 3 << 18 and all(r[2] <= 1024 for r in rows)


def test_last_window():
    costs = packing.Costs()
    assert packing.last_windows(512, costs) == [512]
    assert sum(packing.last_windows(700, costs)) == 700
    assert packing.last_windows(1023, costs) == [1023]
