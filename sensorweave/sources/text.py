"""Lenient text exports as frames: unparsable rows are skipped, missing values are constants.

Every reader gives ``recording`` (the file's name), ``timestamp_ns``, ``x``, ``y``,
``pupil_diameter`` and ``idx`` (the row's place).  Times of ``read_smi`` and
``read_gaze_csv`` count from the recording's first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands for a missing value in exports, and the default pupil.
MISSING = ("", "-", ".")
PUPIL = 3.0


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """recording, line (from 0) and text of text files; order is that within each file.

    A long file is read in blocks; their counts, one row a block, give the numbers.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = lines.withColumn("inside", inside).join(offsets, ["file", "block"])
    return numbered.select(F.element_at(F.split("file", "/"), -1).alias("recording"), (F.col("inside") + F.col("offset")).cast("bigint").alias("line"), "text").where(F.trim("text") != "")


def value_or(parts: Column, at: int | None, default: float) -> Column:
    """The number at a position: absent, blank, ``-`` and ``.`` give the default, other text null."""
    if at is None:
        return F.lit(default)
    text = F.trim(F.get(parts, F.lit(at)))
    return F.when(text.isNull() | text.isin(*MISSING), F.lit(default)).otherwise(text.try_cast("double"))


def rebased(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("recording")
    first = F.min_by("timestamp_ns", "idx").over(w)
    return df.withColumn("timestamp_ns", F.col("timestamp_ns") - first)


def _frames(df: DataFrame, ns: Column, x: Column, y: Column, pupil: Column) -> DataFrame:
    good = df.select("recording", ns.alias("timestamp_ns"), x.alias("x"), y.alias("y"), pupil.alias("p"), F.col("line").cast("bigint").alias("idx"))
    good = good.where("timestamp_ns IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL")
    return good.select("recording", "timestamp_ns", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("p").cast("float").alias("pupil_diameter"), "idx")


def read_gaze_csv(spark: SparkSession, path: str, max_seconds: float | None = None) -> DataFrame:
    """unix seconds, x, y behind one header row; rebased to the first good row."""
    parts = F.split("text", ",")
    df = numbered_lines(spark, path).where("line > 0")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    out = rebased(_frames(df, (number(0) * 1e9).cast("bigint"), number(1), number(2), F.lit(PUPIL)))
    return cropped(out, max_seconds)


def read_physio_tsv(spark: SparkSession, path: str, max_seconds: float | None = None) -> DataFrame:
    """seconds, x, y separated by tabs behind one header row; times are kept."""
    parts = F.split("text", "\t")
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    df = numbered_lines(spark, path).where("line > 0")
    return cropped(_frames(df, (number(0) * 1e9).cast("bigint"), number(1), number(2), F.lit(PUPIL)), max_seconds)


def read_smi(spark: SparkSession, path: str, max_seconds: float | None = None) -> DataFrame:
    """Comma-separated eye-tracker export of one layout.

    Blank and ``##`` lines are skipped, the first other line is the header (read
    on the driver).  Only rows of type SMP count.  The left eye is preferred; the
    right eye stands in where the left *column* is absent.  Times are microseconds.
    """
    lines = numbered_lines(spark, path).where(~F.ltrim("text").startswith("##"))
    header = lines.orderBy("recording", "line").select("text").first()
    if header is None:
        raise ValueError("no header line")
    at: dict[str, int] = {}
    for i, name in enumerate(c.strip().lower() for c in header["text"].split(",")):
        if name in ("time", "type"):
            at[name] = i
        else:
            at.update({k: i for k in ("l por x", "l por y", "r por x", "r por y", "l pupil diameter") if k in name})
    if "time" not in at:
        raise ValueError("no Time column")
    parts = F.split("text", ",")
    rows = lines.where(F.trim("text") != header["text"].strip())
    if "type" in at:
        rows = rows.where(F.upper(F.trim(F.get(parts, F.lit(at["type"])))) == "SMP")
    side = lambda axis: at.get(f"l por {axis}", at.get(f"r por {axis}"))
    ns = (F.trim(F.get(parts, F.lit(at["time"]))).try_cast("double") * 1000).cast("bigint")
    frames = _frames(rows, ns, value_or(parts, side("x"), 0.0), value_or(parts, side("y"), 0.0), value_or(parts, at.get("l pupil diameter"), PUPIL))
    return cropped(rebased(frames), max_seconds)


def cropped(df: DataFrame, max_seconds: float | None) -> DataFrame:
    """Rows up to and including the limit; None and 0 keep all."""
    return df.where(F.col("timestamp_ns") <= int(max_seconds * 1e9)) if max_seconds else df


def placeholder_gaze(spark: SparkSession, n: int, rate_hz: float, recording: str = "none") -> DataFrame:
    """Zero gaze on a regular grid, for recordings without eye tracking."""
    return spark.range(n).select(F.lit(recording).alias("recording"), (F.col("id") * int(1e9 / rate_hz)).alias("timestamp_ns"), F.lit(0.0).cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(PUPIL).cast("float").alias("pupil_diameter"), F.col("id").alias("idx"))


def read_benchmark_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a log file: subject and data set by its name, and what its lines say; the last line that says it counts.

    ``fusion_p50`` and ``feature_p50`` are texts of a number and a unit.
    """
    lines = numbered_lines(spark, path)
    channels = r"(\d+)\s*(?:EEG )?ch.*@\s*([\d.]+)\s*Hz"
    p50 = r".*p50[:\s]+([\d.]+\s*(?:ns|us|µs|ms))"

    def found(pattern: str, kind: str, group: int = 1) -> Column:
        got = F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
        value = F.regexp_replace(got, ",", "").try_cast(kind) if kind != "string" else F.regexp_replace(got, r"([\d.]+)\s*", "$1 ")
        return F.max_by(value, F.when(value.isNotNull(), F.col("line")))

    return lines.groupBy("recording").agg(
        found(channels, "bigint").alias("channels"),
        found(channels, "double", 2).alias("rate_hz"),
        found(r"[Dd]uration\D*([\d.]+)\s*s", "double").alias("duration_s"),
        found(r"([\d,]+)\s*frames/sec", "bigint").alias("throughput"),
        found(r"[Rr]eal-time\D*([\d,.]+)x", "double").alias("rt_factor"),
        found("Fusion" + p50, "string").alias("fusion_p50"),
        found("Feature" + p50, "string").alias("feature_p50"),
    ).withColumns({"subject": F.regexp_extract("recording", r"^(?:rsod-|als-)?(.*?)(?:\.[^.]*)?$", 1), "dataset": dataset_of(F.col("recording"))})


def dataset_of(recording: Column) -> Column:
    """Data set by the name's prefix."""
    return F.when(recording.startswith("rsod-"), "EEGET-RSOD").when(recording.startswith("als-"), "EEGET-ALS").otherwise("EEGEyeNet")
