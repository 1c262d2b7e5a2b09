"""No plan of the global queries sends a whole table to one task."""

import re

import pytest

from sensorweave.plans import queries


def single_tasks(df):
    """What each exchange to a single partition reads, line by line of the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    return [" ".join(lines[i + 1 : i + 4]) for i, line in enumerate(lines) if "SinglePartition" in line]


@pytest.mark.parametrize("name", ["fused_packet", "embedding_packet", "asof_replay_mode", "asof_bench_mode", "hop_windows_500_100", "eeg_features_temporal", "sample_every_100", "audit_report"])
def test_single_tasks_read_one_row_a_cell(spark, sf, name):
    for read in single_tasks(queries.QUERIES[name](spark, sf)):
        assert re.search(r"HashAggregate|SortAggregate|LocalLimit|TakeOrdered|SortMergeJoin \[__bucket.*FullOuter", read), read
