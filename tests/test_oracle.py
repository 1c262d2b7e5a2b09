"""Every query with SQL gives the SQL's rows; the others run."""

import pytest
from compare import differences, spark_rows, sql_rows

from sensorweave.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    expected, other = sql_rows(ORACLE[name], sf)
    assert columns == expected
    assert differences(rows, other) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("partitions", ["1", "17"])
@pytest.mark.parametrize("name", ["asof_nearest_by_user", "asof_nearest_global", "asof_replay_mode", "hop_windows_500_100", "latency_percentiles"])
def test_partition_count_does_not_matter(spark, sf, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _, usual = spark_rows(QUERIES[name](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert differences(spark_rows(QUERIES[name](spark, sf))[1], usual) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
