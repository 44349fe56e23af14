"""Joins of tables that grow must not gather either side at the driver, small as their files are."""

import pytest


@pytest.mark.parametrize("name", ["agg_match_group", "n_match", "n_enrich", "g_topology_confidence", "geo_distance_line_line", "join_semi_exists"])
def test_nothing_that_grows_is_broadcast(spark, name):
    import __spark_entry__ as e

    # the greatest size by default; adaptive plans would show before they are run only
    plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
