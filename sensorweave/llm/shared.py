"""Files that the driver and every executor can see.

Intermediate tables are cut out of the lineage by writing them under the folder
named in ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a
recomputation of everything before.  Only where that setting is absent (a local
test session) is a folder of our own used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder URI under the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sensorweave-")
        spark.conf.set("spark.checkpoint.dir", base) if _settable(spark) else None
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def more_partitions(df: DataFrame, each: int = 64 << 20) -> list[int]:
    """[the number of partitions] that hold ``each`` bytes of ``df`` by the planner's estimate, or [] if the session's setting is as large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(-(-size // each), 1 << 17)
    return [n] if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores behind as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _settable(spark: SparkSession) -> bool:
    return spark.conf.isModifiable("spark.checkpoint.dir")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    modest_batches(spark)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session hands at most about ``most`` bytes of rows to Python at once and reads Parquet in small batches, so that long texts come few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b")) > most:
        spark.conf.set(key, most)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > 1024:
        spark.conf.set(key, 1024)


def files_for(df: DataFrame, each: int = 16 << 20, least: int = 16) -> int:
    """In how many files a table of the size of ``df``, a written one, is written again."""
    spark, size = df.sparkSession, 0
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return max(least, -(-size // each))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends: what is written needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what is still needed must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
