"""Line-first cleaning with DataFrame expressions only.

Every line is judged first; failing lines are removed, and a document that loses
more than ``most_lost_percent`` of its non-blank-line characters is rejected.
A line fails if

* punctuation: it has no sentence end (``.``, ``!``, ``?``, ``…`` or ``。`` before
  white space, a closing quote or bracket, or the end), or more than one in ten
  of its characters is a symbol;
* navigation: two or more ``|``, ``»``, ``›`` or ``•`` separate its parts;
* boilerplate: it holds one of ``BOILERPLATE``'s phrases, in any case.

Blank lines neither fail nor count.  A null text is an empty one: no words, so
it fails the word count.  Lines are what ``\\n`` separates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches

#: Phrases of web boilerplate.
BOILERPLATE = (
    "javascript is disabled",
    "enable javascript",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "sign up for our newsletter",
    "subscribe to our",
    "click here to",
    "skip to content",
    "lorem ipsum",
)
SPACE = r"[\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
_SENTENCE_END = "[.!?…。](?=[\\s\"'”’»)\\]]|$)"
_NAVIGATION = "[|»›•].*[|»›•]"
_PHRASES = "(?i)" + "|".join(BOILERPLATE)


def line_passes(line: Column) -> Column:
    """Whether a line with a word passes the rules."""
    symbols = F.size(F.split(line, SYMBOLS, -1)) - 1
    return line.rlike(_SENTENCE_END) & (symbols * 10 <= F.length(line)) & ~line.rlike(_NAVIGATION) & ~line.rlike(_PHRASES)


def _joined(lines: str) -> Column:
    return F.array_join(F.col(lines), "\n")


def with_measures(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), ``text`` and its arrays; steps are kept apart so that no array is built twice."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("trimmed", F.btrim("text", F.lit(WHITE)))
    df = df.withColumn("words", F.split("trimmed", SPACE + "+")).withColumn("all_lines", F.split("text", "\n"))
    df = df.withColumn("n_words", F.when(F.col("trimmed") == "", 0).otherwise(F.size("words")).cast("long"))
    df = df.withColumn("lines", F.filter("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]))
    return df.withColumn("windows", F.when(F.size("words") < 4, F.array().cast("array<bigint>")).otherwise(windows))


def with_repeats(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in some three-word window that the text holds twice or more."""
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("by_hash", F.when(repeated, by_hash))
    e = F.col("by_hash")
    n = F.size(e)

    def has_twin(x: Column, k: Column) -> Column:
        before = F.when(k > 0, e[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]).otherwise(False)
        after = F.when(k < n - 1, e[F.least(k + 1, n - 1)]["h"] == x["h"]).otherwise(False)
        return before | after

    at = F.sort_array(F.transform(F.filter(e, has_twin), lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(F.when(e.isNotNull(), covered), F.lit(0)).cast("long"))


def judged(docs: DataFrame, wanted: list[Column], min_words: int = 50, most_repeat_percent: int = 50, most_lost_percent: int = 30) -> DataFrame:
    """``wanted`` of the measures, ``good`` (passing and blank lines), ``base_failed`` and ``kept``.

    They stand behind a generator: a filter above is not pushed down into the
    steps, which it would unfold into one expression.
    """
    modest_batches(docs.sparkSession)
    df = with_repeats(with_measures(docs))
    df = df.withColumn("good", F.filter("all_lines", lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | line_passes(x)))
    df = df.withColumn("held", F.length(_joined("lines"))).withColumn("left", F.length(F.array_join(F.filter("good", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "\n")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("held") - F.col("left")) <= most_lost_percent * F.col("held")))
    return df.select(F.inline(F.array(F.struct(*wanted))))


def quality_report(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row; other columns of ``docs`` are not read."""
    wanted = [
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.when(F.col("n_words") == 0, 0).otherwise(F.length(F.array_join("words", ""))).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        "kept",
    ]
    return judged(docs.select("doc_id", "text"), wanted, **limits)


def clean_documents(docs: DataFrame, **limits: int) -> DataFrame:
    """Kept documents without their failing lines, in the columns of ``docs``; ``n_chars`` follows the text.

    Any other columns pass through, whatever they are called.
    """
    changed = F.size("good") != F.size("all_lines")
    wanted = [F.col("row"), F.when(changed, _joined("good")).otherwise(F.col("row.text")).alias("cleaned"), changed.alias("changed"), F.col("kept")]
    df = judged(docs, wanted, **limits).where("kept")
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("cleaned")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
