"""Every registered query of the market-research operators against its SQL, and its plan's shape where that matters."""

from __future__ import annotations

import pytest

from tests.compare import assert_same, connect
from tidemark import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, data, con, name):
    assert_same(catalog.QUERIES[name](spark, data), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, data):
    text = plan(catalog.QUERIES["trade_metrics"](spark, data))
    assert "l_comment" not in text and "l_shipdate" not in text.split("ReadSchema", 1)[1].splitlines()[0]


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(event_type,view)" in plan(catalog.QUERIES["asof_last_purchase"](spark, data))


def test_no_pairs_in_range_join(spark, data):
    text = plan(catalog.QUERIES["range_join_paths"](spark, data))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def windows(node, found):
    """(columns of the partition, name of the operator below that isn't a projection or a window) of each window of a plan."""
    children = node.children()
    if node.nodeName() == "Window":
        below = node
        while below.nodeName() in ("Window", "Project"):
            below = below.children().apply(0)
        keys = node.partitionSpec()
        found.append((sorted(keys.apply(i).sql().split(".")[-1].strip("`") for i in range(keys.size())), below.nodeName()))
    for i in range(children.size()):
        windows(children.apply(i), found)
    return found


@pytest.mark.parametrize("name", ["sprt", "mixture_sprt", "loss_streak_inclusive", "loss_streak_strict", "overlap_clusters", "conformal_threshold", "label_concurrency"])
def test_windows_by_label_alone_see_sums_by_day(spark, data, name):
    found = windows(catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan(), [])
    alone = [below for keys, below in found if len(keys) == 1]
    assert alone and set(alone) == {"Aggregate"}, found


def test_adjusted_p_values_have_no_frame_to_the_end(spark, data):
    # Such a frame is gone through anew for each row; that of the whole family, without an order, is not.
    text = plan(catalog.QUERIES["benjamini_hochberg"](spark, data)).lower()
    assert "currentrow$(), unboundedfollowing" not in text and "currentrow, unboundedfollowing" not in text and "currentrow$(), specifiedwindowframe" not in text


def test_cusum_orders_whole_days(spark, data):
    assert "collect_list" in plan(catalog.QUERIES["cusum_by_pattern"](spark, data))


@pytest.mark.parametrize("name", ["leave_top_events_out", "portfolio_two_new_a_day"])
def test_first_rows_are_found_within_tasks(spark, data, name):
    assert "WindowGroupLimit" in plan(catalog.QUERIES[name](spark, data))


def test_feature_summary_gathers_no_values(spark, data):
    assert "percentile(" not in plan(catalog.QUERIES["feature_summary"](spark, data)).lower()
