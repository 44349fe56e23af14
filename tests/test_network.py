"""Known answers on small networks, and the graph operators against plain versions."""

import random

import numpy as np
import pytest
from roadweave.operators import connectivity, routing


def links_of(spark, rows):
    """(link_id, source, target, length_mm, oneway, group)"""
    return spark.createDataFrame([(*r, True, True, 1, None) for r in rows], "link_id long, source long, target long, length_mm long, oneway boolean, closure_group_id string, mode_car boolean, mode_heavy boolean, rca_code int, speed_kph int")


def arcs_of(links):
    out = []
    for r in links.collect():
        out.append((r.link_id * 2, r.link_id, r.closure_group_id, r.source, r.target, r.length_mm))
        if not r.oneway:
            out.append((r.link_id * 2 + 1, r.link_id, r.closure_group_id, r.target, r.source, r.length_mm))
    return links.sparkSession.createDataFrame([(*r, None, True, True) for r in out], "arc_id long, link_id long, closure_group_id string, source long, target long, cost_mm long, cost_ms long, mode_car boolean, mode_heavy boolean")


SQUARE = [(1, 0, 1, 100, False, "S"), (2, 1, 2, 100, False, "E"), (3, 2, 3, 100, False, "N"), (4, 3, 0, 100, False, "W")]


def test_square_detour(spark):
    links = links_of(spark, SQUARE)
    rows = {(r.link_id, r.direction): r for r in routing.detours(links, arcs_of(links)).collect()}
    for d in (0, 1):
        r = rows[1, d]
        assert (r.alternative, r.added, r.penalty, r.normal, r.ratio, r.status) == (300, 200, 200, 100, 3.0, "OK")


def test_isolated_link_is_disconnected(spark):
    links = links_of(spark, [(1, 0, 1, 100, False, "A")])
    for r in routing.detours(links, arcs_of(links)).collect():
        assert (r.status, r.alternative, r.ratio) == ("DISCONNECTED", None, None)


def test_one_way_ring(spark):
    links = links_of(spark, [(1, 0, 1, 100, False, "X"), (2, 1, 2, 100, True, "B"), (3, 2, 3, 100, True, "C"), (4, 3, 0, 100, True, "D")])
    rows = {(r.link_id, r.direction): r for r in routing.detours(links, arcs_of(links)).collect()}
    assert rows[1, 0].status == "DISCONNECTED"
    assert rows[1, 1].alternative == 300
    assert (2, 1) not in rows


def test_shortcut_adds_a_negative_amount(spark):
    links = links_of(spark, [(1, 0, 1, 1000, False, "L"), (2, 0, 1, 100, False, "S")])
    r = next(r for r in routing.detours(links, arcs_of(links)).collect() if (r.link_id, r.direction) == (1, 0))
    assert (r.normal, r.alternative, r.added, r.penalty) == (100, 100, -900, 0)


def graph_of(edges, bans=None):
    """(source, target, cost, group) with arcs and links numbered as they come."""
    s, t, c, g = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    n = np.arange(len(edges))
    return routing.Graph.of(n, n, s, t, c, g, bans)


def test_budget_is_not_disconnection():
    g = graph_of([(i, i + 1, 1, i) for i in range(50)])
    assert g.cost(0, 50, budget=3)[0] == routing.TIMEOUT
    assert g.cost(0, 50) == (routing.OK, 50)
    assert g.cost(50, 0)[0] == routing.DISCONNECTED
    assert g.cost(7, 7) == (routing.OK, 0)
    assert g.tree(0, {50}, budget=3)[0] == routing.TIMEOUT


@pytest.mark.parametrize("seed", range(15))
def test_search_from_both_ends_equals_relaxation(seed):
    r = random.Random(seed)
    n, edges = 12, [(r.randrange(12), r.randrange(12), r.randrange(1, 9), r.randrange(4)) for _ in range(30)]
    g = graph_of(edges)
    for banned in (None, 0, 1):
        for s in range(n):
            best = {s: 0}
            for _ in range(n):
                for a, b, c, k in edges:
                    if k != banned and a in best and best[a] + c < best.get(b, 10**9):
                        best[b] = best[a] + c
            for t in range(n):
                status, cost, path = g.search(s, t, banned)
                assert cost == best.get(t)
                if status == routing.OK:  # the path is one, and costs what it says
                    assert sum(g.cost_of[k] for k in path) == cost
                    at = s
                    for k in path:
                        assert g.names[g.tail[k]] == at and g.group[k] != banned
                        at = g.names[g.head[k]]
                    assert at == t


@pytest.mark.parametrize("seed", range(10))
def test_banned_turns_equal_a_plain_search(seed):
    """Against relaxation over (node, last link) states."""
    r = random.Random(seed)
    edges = [(r.randrange(8), r.randrange(8), r.randrange(1, 9), 0) for _ in range(20)]
    bans = [[r.randrange(20), r.randrange(20)] for _ in range(25)]
    g = graph_of(edges, bans)
    for s in range(8):
        best = {(t, i): c for i, (a, t, c, _) in enumerate(edges) if a == s}
        for _ in range(25):
            for (n, i), d in list(best.items()):
                for j, (a, t, c, _) in enumerate(edges):
                    if a == n and j != i and [i, j] not in bans and d + c < best.get((t, j), 10**9):
                        best[t, j] = d + c
        for t in range(8):
            want = 0 if s == t else min((d for (n, _), d in best.items() if n == t), default=None)
            status, cost, path, _ = g.route(s, t)
            assert cost == want
            assert status != routing.OK or not g.violates(g.links_of(path))


def routes(spark, links, ask, bans=None, profile="car", metric="distance"):
    arcs = arcs_of(links)
    edges = routing.scan_edges(arcs, profile, metric).join(arcs.selectExpr("arc_id as id", "link_id"), "id")
    rows = spark.createDataFrame([(s, t, None) for s, t in ask], "source long, target long, banned long")
    seq = spark.createDataFrame([(b,) for b in bans], "seq array<long>") if bans else None
    return {(r.source, r.target): r for r in routing.route(rows, edges, None, seq).collect()}


BANNED_TURN = [(1, 0, 1, 100, False, "AB"), (2, 1, 2, 100, False, "BC"), (3, 1, 3, 100, False, "BD"), (4, 3, 2, 141, False, "DC")]


def test_banned_turn(spark):
    links = links_of(spark, BANNED_TURN)
    assert routes(spark, links, [(0, 2)])[0, 2].cost == 200
    r = routes(spark, links, [(0, 2)], [[1, 2]])[0, 2]
    assert (r.cost, r.links, r.exact) == (341, [1, 3, 4], True)
    # a ban of three links has no edge to leave out
    assert routes(spark, links, [(0, 2)], [[1, 2], [1, 3, 4]])[0, 2].status == routing.TURN
    bans = spark.createDataFrame([(1, 2)], "from_link long, to_link long")
    got = {(r.link_id, r.direction): r for r in routing.detours(links, arcs_of(links), restrictions=bans).collect()}
    assert got[2, 0].normal == 100 and got[2, 0].alternative == 241
    free = routing.detours(links, arcs_of(links), profile="emergency", restrictions=bans).where("turn_aware").count()
    assert free == 0


SCOPE = [(1, 0, 1, 100, False, "MAIN"), (2, 1, 2, 100, False, "MAIN"), (3, 0, 3, 100, False, "BY1"), (4, 3, 4, 200, False, "BY2"), (5, 4, 2, 100, False, "BY3")]


def test_scope(spark):
    links = links_of(spark, SCOPE)
    got = {s: {(r.link_id, r.direction): r for r in routing.detours(links, arcs_of(links), scope=s).collect()} for s in ("physical", "link", "directed")}
    assert got["physical"][1, 0].status == "DISCONNECTED"
    assert got["link"][1, 0].alternative == 500
    assert got["directed"][1, 0].alternative == 500
    # with one direction closed the other still runs
    assert got["directed"][1, 1].normal == 100


def test_self_loop_is_a_source_data_error(spark):
    links = links_of(spark, [(1, 0, 0, 100, True, "L"), *((i + 1, *r[1:]) for i, r in enumerate(SQUARE, 1))])
    r = next(r for r in routing.detours(links, arcs_of(links)).collect() if r.link_id == 1)
    assert (r.status, r.alternative, r.normal) == ("SOURCE_DATA_ERROR", None, None)


def test_many_paths_and_their_summary(spark):
    links = links_of(spark, [*SQUARE, (9, 7, 8, 50, False, "X")])
    arcs = arcs_of(links)
    ask = spark.createDataFrame([(0, 2), (0, 1), (1, 1), (0, 7), (0, 99)], "source long, target long")
    got = routing.many_paths(ask, routing.scan_edges(arcs))
    rows = {(r.source, r.target): r for r in got.collect()}
    assert [(rows[k].status, rows[k].cost) for k in ((0, 2), (0, 1), (1, 1), (0, 7), (0, 99))] == [("OK", 200), ("OK", 100), ("OK", 0), ("DISCONNECTED", None), ("DISCONNECTED", None)]
    s = {(r.source, r.target): r for r in routing.summarise(got, arcs, ["source", "target"]).collect()}
    assert (s[0, 1].distance_mm, s[0, 1].time_ms, s[0, 1].links) == (100, None, [1])
    assert (s[1, 1].distance_mm, s[1, 1].time_ms, s[1, 1].links) == (0, 0, [])
    stopped = routing.many_paths(ask, routing.scan_edges(arcs), budget=1).collect()
    assert {r.status for r in stopped if r.target in (2, 7)} == {routing.TIMEOUT}
    with pytest.raises(Exception, match="unknown arc"):
        routing.summarise(got, arcs.where("arc_id <> 2"), ["source", "target"]).collect()


def test_overlay_refuses_unusable_costs(spark):
    assert routing.scan_overlay(spark, [(-1, 0, 1, 2.5)]).first().cost == 2.5
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(Exception, match="unusable cost"):
            routing.scan_overlay(spark, [(-1, 0, 1, bad)]).collect()


def test_through_movements(spark):
    """A chain with a way round: the trip across the middle is interrupted and replaced."""
    links = links_of(spark, [(1, 0, 1, 100, False, "A"), (2, 1, 2, 100, False, "B"), (3, 2, 3, 100, False, "C"), (4, 0, 3, 900, False, "R")])
    moves = routing.movements(links, arcs_of(links))
    through = {(r.entry_arc, r.exit_arc): r for r in moves.where("closure_group_id = 'B' and reason = 'THROUGH_MOVEMENT'").collect()}
    assert (through[2, 6].intact, through[2, 6].replacement) == (100, 1100)
    assert {r.reason for r in moves.where("closure_group_id = 'B' and entry_arc = 2 and exit_arc = 3").collect()} == {"U_TURN_AT_BOUNDARY"}
    bans = spark.createDataFrame([(1, 4)], "from_link long, to_link long")
    got = {(r.entry_arc, r.exit_arc): r.status for r in routing.replacements(moves, bans).where("closure_group_id = 'B'").collect()}
    assert got[2, 6] == routing.TURN and got[7, 3] == routing.OK


def test_unknown_profile(spark):
    links = links_of(spark, SQUARE)
    with pytest.raises(ValueError, match="UNSUPPORTED_PROFILE"):
        routing.scan_edges(arcs_of(links), "bicycle")


def _plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_bridges(spark, seed):
    r = random.Random(seed)
    rows = [(i, *r.sample(range(25), 2), 100, False, "g") for i in range(24)]
    links = links_of(spark, rows)
    nodes = sorted({x for _, a, b, *_ in rows for x in (a, b)})
    want = _plain_components(nodes, [(a, b) for _, a, b, *_ in rows])
    label = connectivity.components(spark.createDataFrame([(n,) for n in nodes], "node_id long"), links)
    assert {x.node_id: x.component for x in label.collect()} == want
    bridges = set()
    for i, a, b, *_ in rows:
        without = _plain_components(nodes, [(c, d) for j, c, d, *_ in rows if j != i])
        if without[a] != without[b]:
            sides = [sum(v == without[x] for v in without.values()) for x in (a, b)]
            bridges.add((i, min(sides), sum(sides)))
    got = connectivity.bridges(label, links).collect()
    assert {(x.link_id, x.smaller_side, x.component_nodes) for x in got} == bridges


@pytest.mark.parametrize("seed", range(2))
def test_labels_by_tables_equal_one_task(spark, seed):
    r = random.Random(seed)
    e = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(45)], "u long, v long")
    one = {x.node: x.component for x in connectivity.label_edges(e).collect()}
    assert one == {x.node: x.component for x in connectivity.label_edges(e, one_task=0).collect()}


def test_shapes(spark):
    rows = [(1, 0, 1, 1, False, "one"), (2, 0, 1, 1, False, "chain"), (3, 1, 2, 1, False, "chain"), (4, 5, 6, 1, False, "ring"), (5, 6, 7, 1, False, "ring"), (6, 7, 5, 1, False, "ring")]
    rows += [(10 + i, a, b, 1, False, "rings") for i, (a, b) in enumerate([(20, 21), (21, 22), (22, 20), (30, 31), (31, 32), (32, 30)])]
    rows += [(20 + i, a, b, 1, False, "mixed") for i, (a, b) in enumerate([(40, 41), (41, 42), (42, 40), (50, 51)])]
    rows += [(30 + i, 60, 61 + i, 1, False, "star") for i in range(3)]
    got = {x.closure_group_id: (x.shape, x.pieces) for x in connectivity.closure_shapes(links_of(spark, rows)).collect()}
    assert got == {"one": ("single_segment", 1), "chain": ("simple_chain", 1), "ring": ("cycle", 1), "rings": ("disjoint", 2), "mixed": ("disjoint", 2), "star": ("branching", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_isolation_equals_removal(spark, seed):
    r = random.Random(seed)
    rows = [(i, *r.sample(range(16), 2), 100 + i, False, f"g{r.randrange(9)}") for i in range(22)]
    links = links_of(spark, rows)
    nodes = sorted({x for _, a, b, *_ in rows for x in (a, b)})
    label = connectivity.components(spark.createDataFrame([(n,) for n in nodes], "node_id long"), links)
    got = {x.closure_group_id: x for x in connectivity.isolation(links, label).collect()}
    for g in {x[5] for x in rows}:
        rest = [x for x in rows if x[5] != g]
        of = _plain_components(nodes, [(a, b) for _, a, b, *_ in rest])
        starts = sorted({n for x in rows if x[5] == g for n in x[1:3]})
        parts = []
        for c in {of[n] for n in starts}:
            held = [n for n in nodes if of[n] == c]
            inside = [x for x in rest if of[x[1]] == c]
            parts.append((-len(inside), -len(held), min(n for n in starts if of[n] == c), len(inside), len(held), sum(x[3] for x in inside)))
        # every link is a highway in this fixture
        parts.sort()
        x = got[g]
        assert (x.parts, x.separated_links, x.separated_nodes, x.separated_length_mm) == (len(parts), sum(p[3] for p in parts[1:]), sum(p[4] for p in parts[1:]), sum(p[5] for p in parts[1:]))


def test_reach_stops_at_its_limit(spark):
    links = links_of(spark, [(i, i, i + 1, 1, True, "g") for i in range(8)])
    starts = spark.createDataFrame([(0,), (6,)], "start long")
    rows = connectivity.reach(arcs_of(links), starts, limit=3).collect()
    assert sorted(r.node for r in rows if r.start == 6) == [6, 7, 8]
    assert sorted(r.node for r in rows if r.start == 0) == [0, 1, 2, 3]


def test_closure_events(spark, tmp_path):
    from roadweave.streaming.closure_events import analyse_events

    links = links_of(spark, SQUARE)
    spark.createDataFrame([(1,), (3,), (1,)], "link_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("link_id long").parquet(str(tmp_path / "in"))
    q = analyse_events(events, links, arcs_of(links), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.link_id, r.direction, r.alternative) for r in rows) == [(1, 0, 300), (1, 1, 300), (3, 0, 300), (3, 1, 300)]
