import random

import numpy as np
import pytest
import sentencepiece
from conftest_llm import table

from sensorweave.llm import pieces
from sensorweave.llm.pieces import Pieces, default_model

ODD = ["", " ", " a", "a  b", "\n", "x\ny", "日本語 テスト", "▁x ▁", "éè\tz", "a" * 60 + " bb", "    four   spaces ", "\x00\x01", "🙂 ok"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_without_dropout_it_is_the_library(texts, library):
    model = Pieces(default_model(), rate=0.0)
    for t in [*texts.values(), *(t for t in ODD if "▁" not in t)]:
        assert model.encode(t) == library.encode(t)


def test_batched_agendas_equal_the_heap(texts):
    model = Pieces(default_model(), rate=0.3, seed=5)
    w = sorted({x for t in texts.values() for x in pieces._WORD.findall(" " + t) if len(x) <= 24})[:4000] + ["日本", " ", "é"]
    assert model.many_words(w, model.word_keys(w, [2] * len(w))) == [model._bytes(model.one_word(x, 2)) for x in w]


def test_lossless_varied_and_repeatable(texts):
    model, other = Pieces(default_model(), rate=0.2, seed=1), Pieces(default_model(), rate=0.2, seed=2, limit=50)
    same = Pieces(default_model(), rate=0.2, seed=1, limit=10)
    differ = 0
    for i, t in enumerate([*list(texts.values())[:60], *ODD]):
        a = model.encode(t, i)
        assert model.decode(a) == other.decode(other.encode(t, i)) == t
        assert same.encode(t, i) == a
        differ += a != other.encode(t, i)
    assert differ > 50
    assert len({tuple(model.encode("internationalization", v)) for v in range(4)}) > 1


def test_everything_dropped_leaves_characters():
    model = Pieces(default_model(), rate=1.0)
    ids = model.encode("abc abc")
    assert len(ids) == 8 and model.decode(ids) == "abc abc"


def test_random_texts_are_lossless():
    rng, model = random.Random(1), Pieces(default_model(), rate=0.5, limit=100)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b", " ", "\n", "é", "日", "▁", "the", "🙂", "\x00", "<s>"]) for _ in range(rng.randrange(20)))
        assert model.decode(model.encode(t)) == t


def test_report(spark, documents, texts, odd, none, odd_rows):
    rows = pieces.piece_report(documents).collect()
    assert len(rows) == len(texts) and all(r.lossless and r.n_chars == len(texts[r.doc_id]) for r in rows)
    again = pieces.piece_report(documents.repartition(3)).collect()
    assert sorted(rows) == sorted(again)
    rows = pieces.piece_report(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.lossless for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert pieces.piece_report(none).count() == 0
    twins = pieces.piece_report(table(spark, [(1, "some words here"), (99, "some words here")])).collect()
    assert twins[0].ids_crc32 == twins[1].ids_crc32 and np.unique([r.n_tokens for r in twins]).size == 1


def test_each_occurrence_has_its_own_dropout():
    model = Pieces(default_model(), rate=0.1)
    word = "internationalization"
    ids = {tuple(model.encode(f"{word} " * 400, key)[:-1]) for key in range(3)}
    assert len(ids) == 3
    seen = {tuple(model.encode_many([k], [word])[0]) for k in range(400)}
    assert len(seen) > 8


def test_remembered_words_equal_their_agendas():
    model = Pieces(default_model(), rate=0.1)
    text = "the internationalization of " + "supercalifragilistic" * 2 + " the thing " * 20
    same = Pieces(default_model(), rate=0.1)
    places = [xs for xs in same.words(text)]
    variants = pieces.mixed(np.repeat(pieces.mixed(np.array([7], np.uint64) + np.uint64(1)), len(places)) + np.arange(len(places), dtype=np.uint64))
    want = [i for w, v in zip(places, variants.tolist(), strict=True) for i in np.frombuffer(same._bytes(same.one_word(w, v)), "<u4").tolist()]
    assert model.encode(text, 7) == want
