"""The bulk search against the plain one, and what workers share."""

import random

import numpy as np
import pytest
from roadweave.operators import layout, routing, search


def both(seed, nodes=40, arcs=110, groups=9, bans=60):
    r = random.Random(seed)
    s, t = (np.array([r.randrange(nodes) for _ in range(arcs)]) for _ in range(2))
    cost, group = np.array([r.randrange(1, 30) for _ in range(arcs)]), np.array([r.randrange(groups) for _ in range(arcs)])
    ids = np.array(r.sample(range(1000), arcs))
    no = [[r.choice(ids.tolist()), r.choice(ids.tolist())] for _ in range(bans * arcs // 10)]
    parts = (ids, ids, s, t, cost, group, no)
    return r, routing.Graph.of(*parts), search.Graph.of(*search.Graph.lay_out(*parts))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("width", [3, 64])
def test_many_searches_at_once_equal_single_ones(seed, width, monkeypatch):
    monkeypatch.setattr(search.search, "__defaults__", (False, search.BUDGET, width))
    r, plain, bulk = both(seed)
    ask = [(r.randrange(42), r.randrange(42), r.choice([None, *range(9)])) for _ in range(150)]
    s, t, x = zip(*ask, strict=True)
    ban = bulk.group_of(np.array([-1 if k is None else k for k in x]))
    status, cost, ends, path, again, _ = search.routes(bulk, bulk.nodes(np.array(s)), bulk.nodes(np.array(t)), ban)
    for i, (a, b, k) in enumerate(ask):
        if a == b:
            continue
        want, best, _, turned = plain.route(a, b, k)
        assert (want == routing.OK) == (status[i] == search.FOUND)
        if want != routing.OK:
            continue
        assert cost[i] == best
        way = path[ends[i] : ends[i + 1]]
        assert bulk.cost[way].sum() == best and (k is None or (bulk.groups[bulk.group[way]] != k).all())
        assert bulk.names[bulk.tail[way[0]]] == a and bulk.names[bulk.head[way[-1]]] == b and (bulk.head[way[:-1]] == bulk.tail[way[1:]]).all()
        assert not bulk.banned_turn(way[:-1], way[1:]).any()


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_single_searches(seed):
    _, plain, bulk = both(seed)
    for s in bulk.names.tolist():
        at = int(bulk.nodes(np.array([s]))[0])
        _, dist, via = bulk.tree(at)
        _, best, how = plain.tree(s)
        assert {int(n): int(dist[n]) for n in np.flatnonzero(dist < search.FAR)} == best
        assert {int(n): int(via[n]) for n in np.flatnonzero(via >= 0)} == how
        met = np.flatnonzero(dist < search.FAR)
        ends, path = bulk.paths(via, bulk.levels(via), met)
        for i, n in enumerate(met):
            assert path[ends[i] : ends[i + 1]].tolist() == plain.path_back(how, s, int(bulk.names[n]))


def test_a_budget_stops_a_search():
    n = np.arange(50)
    g = search.Graph.of(*search.Graph.lay_out(n, n, n, n + 1, n * 0 + 1, n))
    ask = np.array([0]), np.array([50]), np.array([-1])
    assert search.search(g, *ask, budget=3)[0][0] == search.STOPPED
    assert search.search(g, *ask)[1][0] == 50 and search.search(g, ask[1], ask[0], ask[2])[0][0] == search.NONE


def test_workers_map_the_broadcast_file(spark):
    shared, _ = layout.ship(spark.sparkContext, {"a": np.arange(100_000), "b": np.array([True, False])}, "rest")

    def run(_):
        import mmap

        arrays, rest = layout.mapped(shared)
        base = arrays["a"]
        while isinstance(base, np.ndarray):
            base = base.base
        return [(int(arrays["a"].sum()), arrays["b"].tolist(), rest, isinstance(getattr(base, "obj", base), mmap.mmap), bool(arrays["a"].flags.aligned))]

    assert spark.sparkContext.parallelize([0], 1).mapPartitions(run).collect() == [(4_999_950_000, [True, False], "rest", True, True)]
