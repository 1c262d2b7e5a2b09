import hashlib
import re

from conftest_llm import prose, table
from pyspark.sql import functions as F

from sensorweave.llm import fingerprint

MOD = 2**60


def vector(paragraph):
    digest = hashlib.sha256(paragraph.encode()).hexdigest()
    w = [int(digest[15 * j : 15 * j + 15], 16) for j in range(4)]
    return [1, *w, *(w[j] >> s & fingerprint.LANES for j in range(4) for s in range(8))]


def total(text):
    out = [0] * fingerprint.WIDTH
    for p in text.split("\n"):
        out = [(a + b) % MOD for a, b in zip(out, vector(p), strict=True)]
    return out


def shown(v):
    return "".join(f"{x:015x}" for x in v)


def near(a, b):
    if a == b:
        return 1.0

    def signs(v):
        return [2 * (v[5 + i] >> 20 * lane & 0xFFFFF) - v[0] for i in range(32) for lane in range(3)]

    x, y = signs(a), signs(b)
    size = sum(p * p + q * q for p, q in zip(x, y, strict=True))
    return max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) / size) if size else 0.0


def check(rows, docs):
    """``docs`` in descending order of id, nulls last, rows of one id by text."""
    texts = [t or "" for _, t in docs]
    want = []
    for k, (i, _) in enumerate(docs):
        t, after = texts[k], texts[(k + 1) % len(docs)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = total(t), total(edited), total(after)
        want.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(near(a, b), 9), round(near(a, c), 9)))
    got = [(repr(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(want)


def test_documents(documents, texts):
    check(fingerprint.fingerprint_report(documents).collect(), sorted(texts.items(), reverse=True))


def test_buckets_do_not_matter(documents, texts):
    for size in (1, 7, 10**6):
        out = {r.doc_id: r.next for r in fingerprint.with_next(documents, rows_per_bucket=size).collect()}
        ids = sorted(texts, reverse=True)
        assert out == {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}


def test_far_ids_and_frequent_ones(spark):
    """One id far off, a third of the rows with one id, a third without: no bucket holds many rows, and each row has its next."""
    rows = [(i, f"text {i}") for i in range(500)] + [(2**61, "far"), (-(2**60), "below")] + [(77, f"same id {i}") for i in range(500)] + [(None, f"no id {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = fingerprint.with_next(docs, rows_per_bucket=16)
    got = {(r.doc_id, r.text): r.next for r in out.collect()}
    assert len(got) == len(rows) == len(set(got.values()))
    at, seen = (2**61, "far"), []
    by_text = {t: (i, t) for i, t in rows}
    for _ in rows:
        seen.append(at[0])
        at = by_text[got[at]]
    assert at == (2**61, "far") and seen == sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    _, grid = fingerprint._cells(docs.select("doc_id"), 16, 65536)
    assert sum(parts for *_, parts, _ in grid) > 60


def test_odd_rows(odd, none, odd_rows, spark):
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    check(fingerprint.fingerprint_report(odd).collect(), order)
    assert fingerprint.fingerprint_report(none).count() == 0
    check(fingerprint.fingerprint_report(table(spark, [(3, "only\none")])).collect(), [(3, "only\none")])


def test_no_python_in_the_plan(documents):
    assert not re.search("Python|Pandas|Arrow", fingerprint.fingerprint_report(documents)._jdf.queryExecution().toString())


def test_homomorphism(spark):
    a, b = prose(100, 1), prose(60, 2)
    df = spark.createDataFrame([(a, b, a + "\n" + b, b + "\n" + a)], "a string, b string, ab string, ba string")
    f = {c: fingerprint.fingerprint(F.col(c)) for c in df.columns}
    df = df.select(*[f[c].alias(c) for c in df.columns])
    row = df.select((F.col("ab") == F.col("ba")), (fingerprint.added(F.col("a"), F.col("b")) == F.col("ab")), (fingerprint.removed(F.col("ab"), F.col("b")) == F.col("a")), (F.col("a") != F.col("b"))).first()
    assert all(row)


def test_likeness_follows_common_paragraphs(spark):
    lines = prose(12 * 400, 3).split("\n")
    rows = [(k, "\n".join(lines[:200]), "\n".join(lines[200 - k : 400 - k])) for k in (0, 50, 100, 150, 200)]
    df = spark.createDataFrame(rows, "k long, a string, b string").select("k", fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    for r in df.select("k", fingerprint.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert abs(r.near - r.k / 200) < 0.3
