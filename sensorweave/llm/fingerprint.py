"""Homomorphic multiset fingerprints of documents, with DataFrame expressions only.

A paragraph (what ``\\n`` separates) is hashed to a vector of ``WIDTH`` integers:
a one, the four 60-bit words of its SHA-256, and 32 words that hold three single
bits of the digest each, 20 bits apart.  A document's fingerprint is the sum of
its paragraphs' vectors, each coordinate modulo 2**60.  So

* the order of paragraphs doesn't matter, and equal multisets are equal;
* a paragraph is inserted or deleted by adding or subtracting its vector;
* the single bits, read as +1 and -1, are 96 random signs for every paragraph,
  and the squared distance of two fingerprints' sign sums estimates the size of
  the multisets' difference: likeness is 1 - |a - b|^2 / (|a|^2 + |b|^2).

Sign sums are exact for documents of fewer than 2**20 paragraphs; beyond, lanes
carry over, which blurs likeness but not equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = (1 << 60) - 1  # as a mask
LANES = 1 | 1 << 20 | 1 << 40
SHIFTS = 8
WORDS = 4
WIDTH = 1 + WORDS + WORDS * SHIFTS


def paragraph_vector(paragraph: Column) -> Column:
    """The vector of one paragraph as array<bigint>."""
    digest = F.sha2(paragraph.cast("binary"), 256)
    words = F.array(*[F.conv(F.substring(digest, 1 + 15 * j, 15), 16, 10).cast("bigint") for j in range(WORDS)])

    def spread(w: Column) -> Column:
        signs = [F.shiftright(w[j], s).bitwiseAND(F.lit(LANES)) for j in range(WORDS) for s in range(SHIFTS)]
        return F.array(F.lit(1).cast("bigint"), *[w[j] for j in range(WORDS)], *signs)

    return F.transform(F.array(words), spread)[0]


def added(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of the first multiset without the second."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MODULUS)))


def fingerprint(text: Column) -> Column:
    """The vector of a whole text; ``text`` must not be null."""
    zero = F.array(*[F.lit(0).cast("bigint")] * WIDTH)
    return F.aggregate(F.split(text, "\n"), zero, lambda acc, p: added(acc, paragraph_vector(p)))


def as_string(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.lpad(F.lower(F.hex(v)), 15, "0")), "")


def sign_sums(vector: Column) -> Column:
    """The 96 sign sums of a fingerprint as array<double>."""
    lanes = F.array(F.lit(0), F.lit(20), F.lit(40))
    n = vector[0]
    return F.flatten(F.transform(F.slice(vector, 2 + WORDS, WORDS * SHIFTS), lambda w: F.transform(lanes, lambda s: (2 * F.call_function("shiftright", w, s).bitwiseAND(F.lit((1 << 20) - 1)) - n).cast("double"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs, 0 to 1; exactly 1 for equal fingerprints."""
    both = F.zip_with(sign_sums(a), sign_sums(b), lambda x, y: F.struct(((x - y) * (x - y)).alias("apart"), (x * x + y * y).alias("size")))
    zero = F.struct(F.lit(0.0).alias("apart"), F.lit(0.0).alias("size"))
    near = F.aggregate(
        both,
        zero,
        lambda t, p: F.struct((t["apart"] + p["apart"]).alias("apart"), (t["size"] + p["size"]).alias("size")),
        lambda t: F.when(t["size"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - t["apart"] / t["size"])),
    )
    return F.when(a == b, 1.0).otherwise(near)


def _low_bits(text: Column) -> Column:
    """31 bits of a text's hash, by which rows of one id are ordered and split."""
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def _cells(docs: DataFrame, rows_per_bucket: int, most_buckets: int) -> tuple[Column, list[tuple]]:
    """The cell of a doc_id (-1 for null) and what is known of each: cell, least id, width of its parts, how many, whether by hash.

    Cells are equally wide; one with too many rows is cut again between its own
    least and largest id, so single ids far off don't matter, and a cell of one
    id by its texts' hashes.
    """
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    rows_per_bucket = max(rows_per_bucket, -(-n // most_buckets))
    wide = max(1.0, float((high or 0) - (low or 0) + 1) / max(1, min(most_buckets, n // rows_per_bucket)))
    cell = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low or 0)) / wide).cast("long"), F.lit(-1).cast("long"))
    grid = []
    for r in docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect():
        parts = max(1, -(-r["n"] // rows_per_bucket)) if r["n"] > 2 * rows_per_bucket else 1
        first, last = r["low"] or 0, r["high"] or 0
        grid.append((r["cell"], first, -(-(last - first + 1) // parts), parts, parts > 1 and first == last))
    return cell, grid


def with_next(docs: DataFrame, rows_per_bucket: int = 256, most_buckets: int = 65536) -> DataFrame:
    """doc_id, text, its fingerprint ``f``, and the ``next`` text in descending doc_id with its ``h``.

    After the last document comes the first.

    Rows go to ranges of doc_id, and the first row of each range also to the
    range before it, so one shuffle of the texts serves and no task sees more
    than a range.  Ranges are cut where the rows are, one id's or null's rows by
    their texts' hashes; only equal rows stay together.  The tables that the
    driver and every task hold have some 3 * ``most_buckets`` rows at most.  Null
    ids come last; rows of one id go by their texts' hash.  A null text is an
    empty one.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cell, grid = _cells(df.select("doc_id"), rows_per_bucket, most_buckets)
    spark = docs.sparkSession
    table = spark.createDataFrame(grid, "cell long, low long, width long, parts long, by_hash boolean")
    hashed = any(by_hash for *_, by_hash in grid)
    bits = _low_bits(F.col("text")) if hashed else F.lit(0).cast("long")
    inside = F.floor((F.col("doc_id") - F.col("low")) / F.col("width"))
    part = F.when(F.col("by_hash"), F.floor(F.col("bits") * F.col("parts") / (1 << 31))).otherwise(F.coalesce(inside, F.lit(0))).cast("long")
    place = lambda d: d.withColumn("cell", cell).join(F.broadcast(table), "cell").withColumn("part", part)
    first = F.max(F.struct("doc_id", (-F.col("bits")).alias("bits")))  # null ids stand alone in their cell
    found = place(df.select("doc_id", bits.alias("bits"))).groupBy("cell", "part", "by_hash").agg(first.alias("first")).collect()
    found.sort(key=lambda r: (-r["cell"], r["part"] if r["by_hash"] else -r["part"]))
    rows = [(r["cell"], r["part"], r["first"]["doc_id"], -r["first"]["bits"], *(found[i - 1][c] for c in ("cell", "part"))) for i, r in enumerate(found)]
    tops = spark.createDataFrame(rows, "cell long, part long, top long, top_bits long, before_cell long, before_part long")
    df = place(df.withColumn("f", fingerprint(F.col("text"))).withColumn("bits", bits)).join(F.broadcast(tops), ["cell", "part"])
    here = F.struct("cell", "part", F.lit(False).alias("copy"))
    there = F.struct(F.col("before_cell").alias("cell"), F.col("before_part").alias("part"), F.lit(True).alias("copy"))
    is_first = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("bits") == F.col("top_bits"))
    df = df.select("doc_id", "text", "f", "bits", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("at")).select("doc_id", "text", "f", "bits", "at.*")
    order = Window.partitionBy("cell", "part").orderBy("copy", F.desc_nulls_last("doc_id"), "bits", "text")
    df = df.withColumn("next", F.lead("text").over(order)).withColumn("h", F.lead("f").over(order))
    return df.where("NOT copy").select("doc_id", "text", "f", "next", "h")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document.  ``near_next`` compares with the next
    document's fingerprint.  One document alone is its own next.
    """
    df = with_next(docs).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next", F.lit(1), half)))
    df = df.withColumn("g", fingerprint(F.col("edited")))
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("f")).alias("fingerprint"),
        as_string(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("h")).alias("near_next"),
    )
