"""What is told of ways from their trees, against the ways written out."""

import numpy as np
import pytest
from test_search import both


@pytest.mark.parametrize("seed", range(6))
def test_measures_of_a_tree_equal_those_of_its_ways(seed):
    _, _, g = both(seed)
    for at in range(0, len(g.names), 7):
        _, _, via = g.tree(at)
        deep, last, groups = g.levels(via), g.before(via), g.groups_passed(at, via)
        turned = last >= 0
        bad = np.zeros(len(via), np.int64)
        bad[turned] = g.banned_turn(last[turned], via[turned])
        total, first = g.fold(via, bad), g.fold(via, np.where(bad > 0, deep - 1, 99), np.minimum)
        met = np.flatnonzero(via >= 0)
        ends, path = g.paths(via, deep, met)
        for i, n in enumerate(met):
            way = path[ends[i] : ends[i + 1]]
            turns = g.banned_turn(way[:-1], way[1:])
            assert (deep[n], groups[n]) == (len(way), len(set(g.group[way].tolist())))
            assert total[n] == turns.sum() and first[n] == (np.flatnonzero(turns)[0] + 1 if turns.any() else 99)


def test_batches_of_a_source_are_one_search(spark):
    """A source's targets came in batches; each was searched anew, and yet all have their ways."""
    from pyspark.sql import functions as F
    from roadweave.operators import routing

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        edges = spark.range(200).select(F.col("id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1).cast("long").alias("cost"), F.when(F.col("id") == 150, None).otherwise(2).alias("ms"))
        ask = spark.range(201).select(F.lit(0).alias("source"), F.col("id").alias("target"))
        got = routing.many_paths(ask, edges, None, total="ms").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.target, r.cost, len(r.arcs), r.ms) for r in got} == {(k, k, k, 2 * k if k <= 150 else None) for k in range(201)}
