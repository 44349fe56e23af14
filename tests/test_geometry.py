"""Geometry, topology and naming against plain versions and known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F
from roadweave.functions import geometry as G
from roadweave.functions import names as N
from roadweave.operators import span, topology
from roadweave.plans.span_queries import hull, merge_lines

LINE = "array<struct<x:double,y:double>>"


def lines_of(spark, rows):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in rows], f"feature long, line {LINE}")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_projection_ground_truth(spark):
    """One of the published pairs of grid and geographic coordinates."""
    d = one(spark, G.to_degrees(F.lit(1756441.3212), F.lit(5918111.9628)))
    assert (d.lon, d.lat) == (pytest.approx(174.755178941904, abs=1e-9), pytest.approx(-36.8699897129233, abs=1e-9))
    g = one(spark, G.to_grid(F.lit(174.755178941904), F.lit(-36.8699897129233)))
    assert (g.x, g.y) == (pytest.approx(1756441.3212, abs=1e-3), pytest.approx(5918111.9628, abs=1e-3))


def nearest(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_distances_and_places_match_plain_loops(spark):
    r = random.Random(2)
    rows = [(i, [(r.randrange(100), r.randrange(100)) for _ in range(r.randrange(2, 5))]) for i in range(20)]
    df = lines_of(spark, rows)
    pairs = df.alias("a").crossJoin(df.select(F.col("feature").alias("g"), F.col("line").alias("other"))).select("feature", "g", G.distance_to_line(F.col("line"), F.col("other")).alias("d"), G.located(F.col("line"), F.element_at("other", 1).x, F.element_at("other", 1).y).alias("l"), G.length(G.substring(F.col("line"), F.lit(0.3), F.lit(0.9))).alias("part"), G.length(F.col("line")).alias("n"))
    known = dict(rows)
    for x in pairs.collect():
        a, b = known[x.feature], known[x.g]
        segs = lambda p: list(zip(p, p[1:], strict=False))
        turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        crossed = any(turn(s, t, u) * turn(s, t, v) < 0 and turn(u, v, s) * turn(u, v, t) < 0 for s, t in segs(a) for u, v in segs(b))
        want = 0.0 if crossed else min(min(nearest(p, u, v) for p in (s, t)) for s, t in segs(a) for u, v in segs(b))
        want = 0.0 if crossed else min(want, min(min(nearest(p, s, t) for p in (u, v)) for s, t in segs(a) for u, v in segs(b)))
        assert x.d == pytest.approx(want, abs=1e-9)
        assert x.l.distance == pytest.approx(min(nearest(b[0], s, t) for s, t in segs(a)), abs=1e-9)
        assert x.part == pytest.approx(0.6 * x.n)


def test_t_junction(spark):
    """A side road that ends on a through road: one cut, one shared node, no length lost."""
    df = lines_of(spark, [(1, [(0, 0), (200, 0)]), (2, [(100, 0), (100, 100)])])
    j = topology.junctions(df).collect()
    assert [(r.feature, r.owner, r.along, r.kind) for r in j] == [(1, 2, 100.0, "cut")]
    pieces, nodes = topology.build(df, topology.junctions(df).where("kind = 'cut'").select("feature", "along", "x", "y"))
    p = {(r.feature, r.part): r for r in pieces.withColumn("n", G.length(F.col("line"))).collect()}
    assert sum(r.n for r in p.values()) == 300 and len(p) == 3
    assert p[1, 0].target == p[1, 1].source == p[2, 0].source
    assert nodes.select("node").distinct().count() == 4


def test_junction_a_little_off_and_near_miss(spark):
    df = lines_of(spark, [(1, [(0, 0), (50, 0), (200, 0)]), (2, [(100, 0.03), (100, 100)]), (3, [(150, 3), (150, 90)]), (4, [(0.02, 0.0), (0, -50)])])
    got = {(r.feature, r.owner): r.kind for r in topology.junctions(df).collect()}
    assert got == {(1, 2): "cut", (1, 3): "near_miss"}
    pieces, _ = topology.build(df, topology.junctions(df).where("kind = 'cut'").select("feature", "along", "x", "y"))
    p = {(r.feature, r.part): r for r in pieces.collect()}
    # the side road's own end goes into the through road
    assert (p[1, 0].line[-1].x, p[1, 0].line[-1].y) == (100.0, 0.03) and p[1, 0].target == p[2, 0].source
    assert len(p[1, 0].line) == 3


def test_crossings_are_not_joined(spark):
    """Over and under: four nodes, one crossing at a right angle, none where a road ends or overlaps."""
    df = lines_of(spark, [(1, [(0, 50), (100, 50)]), (2, [(50, 0), (50, 50), (50, 100)]), (3, [(20, 50), (60, 50)]), (4, [(0, 0), (30, 30), (60, 90)])])
    rows = {(r.a, r.b): r for r in topology.crossings(df).collect()}
    assert set(rows) == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    assert (rows[1, 2].x, rows[1, 2].y, rows[1, 2].angle) == (50, 50, 90)
    assert rows[1, 4].angle == pytest.approx(math.degrees(math.atan2(2, 1)), abs=1e-6)


def test_one_road_recorded_twice(spark):
    df = lines_of(spark, [(1, [(0, 0), (300, 0)]), (2, [(0, 5), (150, -1), (300, -6)]), (3, [(200, -100), (200, 100)])])
    c = topology.crossings(df).withColumn("point", F.struct("a", "b"))
    assert [(r.point.a, r.point.b) for r in topology.same_corridor(c).collect()] == [(1, 2)]


def test_cuts_fold_in_order(spark):
    cuts = spark.createDataFrame([(1, x, x, 0.0) for x in (10.0, 10.04, 10.08, 10.2, 30.0, 30.0)], "feature long, along double, x double, y double")
    assert sorted(r.along for r in topology.dedupe_cuts(cuts).collect()) == [10.0, 10.08, 10.2, 30.0]


def test_nodes_chain_within_the_tolerance(spark):
    p = spark.createDataFrame([(0.0, 0.0), (0.008, 0.0), (0.016, 0.0), (5.0, 5.0), (0.0, 0.0)], "x double, y double")
    rows = {(r.x, r.y): r.node for r in topology.assign_nodes(p).collect()}
    assert rows == {(0.0, 0.0): 0, (0.008, 0.0): 0, (0.016, 0.0): 0, (5.0, 5.0): 1}


def test_restrictions_of_three_features(spark):
    rows = [(1, 0, 10, 11), (2, 0, 20, 11), (2, 1, 11, 21), (3, 0, 30, 31), (3, 1, 31, 21), (3, 2, 21, 33)]
    pieces = spark.createDataFrame(rows, "feature long, part int, source long, target long")
    seq = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 3])], "id long, features array<long>")
    assert {r.id: r.parts for r in topology.resolve_restrictions(seq, pieces).collect()} == {1: [0, 1, 1]}


def test_policies_are_guarded(spark):
    found = spark.createDataFrame([("ORDINARY_CROSSROADS", "AT_GRADE", None), ("MIXED_PLACE", "UNRESOLVED", "AT_GRADE"), ("RAMP", "UNRESOLVED", "AT_GRADE"), ("RAMP", "UNRESOLVED", "CONFLICT")], "reason string, disposition string, decision string")
    assert [r.noded for r in topology.gate(found, "evidence").collect()] == [False, False, True, False]
    with pytest.raises(ValueError, match="research"):
        topology.gate(found, "confirmed")
    assert [r.noded for r in topology.gate(found, "confirmed", research=True).collect()] == [True, False, False, False]


def test_nearest_lines_however_far(spark):
    r = random.Random(8)
    rows = [(i, [(x, y), (x + 30, y + 10)]) for i, (x, y) in enumerate((r.randrange(3000), r.randrange(3000)) for _ in range(25))]
    points = [(k, float(r.randrange(3000)), float(r.randrange(3000))) for k in range(12)]
    got: dict = {}
    for x in span.nearest(spark.createDataFrame(points, "point long, x double, y double"), lines_of(spark, rows), 3, radius=40.0).collect():
        got.setdefault(x.point, set()).add(x.feature)
    for k, x, y in points:
        order = sorted((nearest((x, y), *p), i) for i, p in rows)
        assert got[k] == {i for _, i in order[:3]}


def test_partial_closure(spark):
    """A main road closed from a quarter to a half, with a bypass."""
    links = spark.createDataFrame([(1, 0, 1, 400, False, True), (2, 0, 1, 800, False, True)], "link_id long, source long, target long, length_mm long, oneway boolean, mode_car boolean")
    arcs = spark.createDataFrame([(i * 2 + k, i, s, t, c, None, True) for i, c in ((1, 400), (2, 800)) for k, (s, t) in enumerate(((0, 1), (1, 0)))], "arc_id long, link_id long, source long, target long, cost_mm long, cost_ms long, mode_car boolean")
    got = {(r.link_id, r.direction): r for r in span.outages(links, arcs, 0.25, 0.5).collect()}
    r = got[1, "a_to_b"]
    assert (r.replacement_mm, r.added_mm, r.ratio, r.headline) == (1100, 1000, 11, "Replacement route found")


def test_merging_and_hulls():
    import pandas as pd

    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    got = merge_lines(pd.DataFrame({"g": ["a"] * 4, "line": [p((0, 0), (1, 0)), p((2, 0), (1, 0)), p((2, 0), (3, 1)), p((9, 9), (8, 8))]}))
    assert [len(x) for x in got["line"]] == [4, 2]
    r = random.Random(3)
    pts = [(r.randrange(30), r.randrange(30)) for _ in range(60)]
    h = [(q["x"], q["y"]) for q in hull(pd.DataFrame({"g": ["a"] * 60, "x": [x for x, _ in pts], "y": [y for _, y in pts]}))["hull"][0]]
    for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in pts)


@pytest.mark.parametrize(
    ("name", "key"),
    [("Essex Street (Sh 1)", "essex street"), ("ESSEX ST", "essex street"), ("St Heliers Bay Rd", "saint heliers bay road"), ("St", "street"), ("Mangamōteo Cway N", "mangamoteo causeway north"), ("()", None), ("O'Neill Cres", "o neill crescent")],
)
def test_search_keys(spark, name, key):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(N.search_key("n").alias("k")).first().k == key


@pytest.mark.parametrize(
    ("name", "number", "code"),
    [("SH 16/47", 16, True), ("016-0047-R1", 16, True), ("Sh 67 Buller Road", 67, False), ("SH 8 [BEAUMONT BRIDGE]", 8, False), ("State Highway 1", 1, True), ("SH1N RS 12", 1, True), ("Queen Street", None, False), ("SH12Bridge Road", None, False), ("MSR 20A", 20, True)],
)
def test_route_references(spark, name, number, code):
    df = spark.createDataFrame([(name,)], "n string")
    r = df.select(N.route_number("n").alias("k"), N.is_designation("n").alias("d")).first()
    assert (r.k, r.d) == (number, code)
