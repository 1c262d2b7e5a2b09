import re
from collections import Counter

from conftest_llm import prose, table

from sensorweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def good_line(x):
    end = re.search(r"[.!?…。](?=[\s\"'”’»)\]]|$)", x)
    return bool(end) and 10 * len(re.findall(r"[#*$%&|<>]", x)) <= len(x) and len(re.findall("[|»›•]", x)) < 2 and not any(p in x.lower() for p in quality.BOILERPLATE)


def verdict(text):
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    held, left = len("\n".join(lines)), len("\n".join(x for x in lines if good_line(x)))
    return not measures(text)[-1] and 100 * (held - left) <= 30 * held


def compare(rows, docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)
    assert got == Counter((i, *measures(t), verdict(t)) for i, t in docs)


def test_documents(documents, texts):
    compare(quality.quality_report(documents).collect(), texts.items())


def test_odd_rows(odd, none, odd_rows):
    compare(quality.quality_report(odd).collect(), odd_rows)
    assert quality.quality_report(none).count() == quality.clean_documents(none).count() == 0


def test_no_python_in_the_plan(documents):
    plan = quality.quality_report(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_labelled_documents(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_report(documents).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == (r.quality == 1) for r in rows)


def test_cleaning(spark):
    text = prose(120, 1)
    df = table(spark, [(1, text + "\nHome | About | Contact\nWe use cookies to help."), (2, "a | b | c\n" * 40), (3, text)])
    rows = {r.doc_id: r for r in quality.clean_documents(df).collect()}
    assert set(rows) == {1, 3}
    assert rows[1].text == rows[3].text == text
    assert rows[1].n_chars == rows[3].n_chars == len(text)
    assert quality.clean_documents(df).columns == df.columns
