import corpus_pipeline
from conftest_llm import prose, table, untouched, words
from test_quality import good_line, verdict
from test_near_dedup import by_brute_force

from sensorweave.llm.near_dedup import deduplicated
from sensorweave.llm.quality import clean_documents
from sensorweave.llm.shared import scratch, written


def test_stages_keep_columns(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == odd.columns
            assert untouched(docs.collect())
        assert corpus_pipeline.packing_stage(spark, docs, "").columns[0] == "doc_id"


def test_first_stages_against_brute_force(spark, documents, texts):
    cleaned = clean_documents(documents)
    want = {i: "\n".join(x for x in t.split("\n") if good_line(x) or not x.split()) for i, t in texts.items() if verdict(t)}
    assert {r.doc_id: r.text for r in cleaned.collect()} == want
    kept = {r.doc_id for r in deduplicated(cleaned).collect()}
    assert kept == {i for i, (_, c) in by_brute_force(want).items() if i == c}


def test_near_dedup_stage_links_from_four_fifths_on(spark):
    docs = {}
    for i in range(40):
        w = words(300, 700 + i)
        docs[2 * i] = " ".join(w)
        for e in range(5 + i % 4):
            w[20 + 35 * e] = f"edit{i}x{e}"
        docs[2 * i + 1] = " ".join(w)
    want = {i for i, (_, c) in by_brute_force(docs, 80).items() if i == c}
    assert want != {i for i, (_, c) in by_brute_force(docs).items() if i == c} and len(want) < len(docs)
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, table(spark, docs.items()), "").collect()} == want


def test_decisions_take_effect(spark):
    rows = [(1, prose(120, 1)), (2, prose(120, 1) + " more."), (3, "a | b | c\n" * 60), (4, prose(150, 2) + "\n" + prose(70, 3)), (5, prose(160, 4) + "\n" + prose(70, 3)), (6, prose(100, 5) + '\nThe key is here. token = "' + "0f" * 20 + '"')]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {1, 4, 5, 6}
    assert got[1] == rows[0][1] and got[4] == rows[3][1]
    assert got[5].strip() == prose(160, 4)
    assert "0f0f" not in got[6] and got[6].startswith(prose(100, 5))


def test_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert out.count() > 0


def test_scratch_tables_go(spark):
    with scratch(spark):
        kept = written(spark.range(5), "numbers")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    assert not spark._jvm.java.io.File(path.removeprefix("file://").removeprefix("file:")).exists()
