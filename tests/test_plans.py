"""Plan-level guards for the scale rules (read from ``explain``)."""

import contextlib
import io
import re

import pytest

from conftest import SF01
from passkit.plans.registry import QUERIES, load_all

load_all()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join_or_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF01))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Python only through Arrow batches (pandas_udf / mapInPandas), never row at a time
    assert "BatchEvalPython" not in plan


def test_leaderboard_reads_lineitem_once_with_three_columns(spark):
    plan = _plan(QUERIES["leaderboard"](spark, SF01))
    scans = re.findall(r"ReadSchema: (struct<l_[^>]*>)", plan)
    assert scans == ["struct<l_partkey:bigint,l_suppkey:bigint,l_returnflag:string>"]


def test_filters_reach_the_scan(spark):
    plan = _plan(QUERIES["extract_code"](spark, SF01))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in plan


def test_only_fixed_size_dimensions_are_hinted(spark):
    """Broadcast hints appear only on nation/region; the rest is left to the planner's size check.

    The training-data operators check sizes themselves; their own tests cover them."""
    import inspect
    import passkit
    import pkgutil
    hinted = []
    for m in pkgutil.walk_packages(passkit.__path__, "passkit."):
        if m.name.startswith("passkit.llm"):
            continue
        src = inspect.getsource(__import__(m.name, fromlist=["x"]))
        for line in src.splitlines():
            if "F.broadcast(" in line:
                hinted.append((m.name, line.strip()))
    assert hinted and all(mod == "passkit.plans.views" for mod, _ in hinted), hinted
