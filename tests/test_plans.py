"""Plans that must hold at scale: no pairwise joins, no Python rows, pruning before the shuffle."""

import pytest
from test_tables import plan

from telespark.plans import queries, stream_queries

BATCH = sorted(set(queries.all_queries()) - set(stream_queries.all_queries()))
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins_or_python(spark, sf, name):
    text = plan(queries.all_queries()[name](spark, sf))
    assert not [word for word in FORBIDDEN if word in text]


@pytest.mark.parametrize("name", ["recent_per_robot", "fleet_status", "active_latest", "next_pending", "dedupe_deliveries", "error_samples"])
def test_ranks_are_pruned_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(queries.all_queries()[name](spark, sf))


def test_status_shuffles_once_per_robot(spark, sf):
    """The history fold reuses the partitioning of the ranking; only the final order exchanges again."""
    snapshot = queries._snapshot(spark, sf)
    assert plan(snapshot).count("Exchange") == 1


@pytest.mark.parametrize("name", ["recent_telemetry", "recent_events", "telemetry_ordered_page", "event_log_tail", "fleet_status_page"])
def test_top_k_is_not_a_full_sort(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(queries.all_queries()[name](spark, sf))


def test_the_analytics_response_reads_the_readings_once(spark, sf):
    text = plan(queries.all_queries()["fleet_analytics"](spark, sf))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 2 and "SortAggregate" not in text
