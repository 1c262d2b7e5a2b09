import pytest
from compare import differences, spark_rows, sql_rows

from sensorweave.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf, name):
    columns, rows = spark_rows(queries()[name](spark, sf))
    expected, other = sql_rows(oracle_sql()[name], sf)
    assert columns == expected
    assert differences(rows, other) == []


def test_all_ten_and_the_pipeline():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
