import pytest

CLASHING = ("__kept", "__spans", "__spans_", "__cell", "__hash", "__row", "__rank", "row", "good", "words", "ranges", "seed", "hi", "cleaned")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, bucket long, node long, label long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, "en", "src0", len(t or ""), True, 1, 2, 3, 4, *(f"my {c}" for c in CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


def words(n, seed):
    import random

    rng = random.Random(seed)
    return [rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(100)) for _ in range(n)]


def prose(n, seed):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, repeats, ties, very long and unusual texts."""
    long = prose(30_000, 9)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, prose(80, 1)),
        (4, prose(80, 1)),
        (5, prose(80, 1)),
        (6, prose(80, 1) + " extra tail words here."),
        (None, prose(80, 1)),
        (None, None),
        (-7, "日本語 ▁ текст\n\n\nx  y   z <|endoftext|>\x01 end"),
        (9, long),
        (10, "of " * 3000),
        (11, prose(200, 2) + "\n" + prose(70, 3)),
        (12, prose(150, 4) + "\n" + prose(70, 3)),
        (2**62, 'password = "hunter2hunter2"\nAll rights reserved.'),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def untouched(rows):
    """Whether columns that no operator writes came through as they were."""
    return all(r[c] == f"my {c}" for r in rows for c in CLASHING) and all((r.lang, r.kept, r.shard, r.bucket, r.node, r.label) == ("en", True, 1, 2, 3, 4) for r in rows)
