"""Every registered query against its SQL, and the shape of its plan."""

import re
import sys
from pathlib import Path

import pytest
from helpers import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_point  # noqa: E402
import check_oracle  # noqa: E402

from tallyforge.harness.queries import QUERIES  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries()) >= set(NAMES)
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert check_oracle.compare(spark, con, name, SF).startswith("ok ")


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream_")])
def test_plan_shape(spark, name):
    frame = entry_point.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert slow not in plan
    # only aggregates' single rows, day totals and per-partition offsets may meet in one task
    for line in re.findall(r"Exchange SinglePartition.*\n(.*)", plan):
        assert any(op in line for op in ("Aggregate", "Project")), line
