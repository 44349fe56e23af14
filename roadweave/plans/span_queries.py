"""Geometry of raw streets, places on them, and outages between two places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import span as S
from ..operators import topology as T
from ..sources.lattice import Network
from ..sources.streets import SQL as _STREETS
from ..sources.streets import Streets
from .catalogue import query
from .geometry_queries import _LINES, lines

_GAP = "sqrt(pow(greatest(0.0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) + pow(greatest(0.0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2))"


@query(_STREETS + f"\nSELECT a.feature AS a, b.feature AS b, round({_GAP}, 4) AS distance FROM fs a JOIN fs b ON a.feature < b.feature AND {_GAP} <= 30")
def geo_distance_line_line(net: Network) -> DataFrame:
    """Lines within thirty metres of each other, and how far apart they are."""
    f = Streets(net).features
    one, other = T.by_cell(f, ["feature"], 0.0), T.by_cell(f, ["feature"], 30.0)
    pairs = one.select(F.col("feature").alias("a"), "cx", "cy").join(other.select(F.col("feature").alias("b"), "cx", "cy").hint("merge"), ["cx", "cy"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: f.select(F.col("feature").alias(n), F.col("line").alias(f"line_{n}"))
    j = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("d", G.distance_to_line(F.col("line_a"), F.col("line_b")))
    return j.where("d <= 30").select("a", "b", F.round("d", 4).alias("distance"))


@query(_STREETS + "\nSELECT least(h.feature, v.feature) AS a, greatest(h.feature, v.feature) AS b, round(v.x1, 3) AS x, round(h.y1, 3) AS y FROM fs h JOIN fs v ON h.across AND NOT v.across AND v.x1 BETWEEN h.x1 AND h.x2 AND h.y1 BETWEEN v.y1 AND v.y2")
def geo_intersection_points(net: Network) -> DataFrame:
    """Points that two lines have in common, ends included."""
    return T.crossings(Streets(net).features, guard=-1.0).select("a", "b", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(_STREETS + "\nSELECT structure, feature FROM ss s JOIN fs f ON s.x1 BETWEEN f.x1 - 80 AND f.x2 + 80 AND s.y1 BETWEEN f.y1 - 80 AND f.y2 + 80 AND sqrt(pow(s.x1 - greatest(f.x1, least(f.x2, s.x1)), 2) + pow(s.y1 - greatest(f.y1, least(f.y2, s.y1)), 2)) <= 80")
def geo_buffer(net: Network) -> DataFrame:
    """Features within eighty metres of a point."""
    s = Streets(net)
    p = s.structures.select(F.col("structure").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return T.near_points(p, s.features, 80.0, 160.0).select(F.col("point").alias("structure"), "feature")


def _near(t: str, x: str, y: str) -> str:
    return f"sqrt(pow(px - {x}, 2) + pow(py - {y}, 2))"


_LOCATE = _LINES + """, q AS (SELECT *, xm + 35.0 AS px, ym - 20.0 AS py FROM h),
t AS (SELECT *, greatest(0.0, least(1.0, ((px - x1) * (xm - x1) + (py - y1) * (ym - y1)) / (d1 * d1))) AS t1, greatest(0.0, least(1.0, ((px - xm) * (x2 - xm) + (py - ym) * (y2 - ym)) / (d2 * d2))) AS t2 FROM q),
c AS (SELECT *, x1 + t1 * (xm - x1) AS ax, y1 + t1 * (ym - y1) AS ay, xm + t2 * (x2 - xm) AS bx, ym + t2 * (y2 - ym) AS by_ FROM t),
d AS (SELECT *, sqrt(pow(px - ax, 2) + pow(py - ay, 2)) AS da, sqrt(pow(px - bx, 2) + pow(py - by_, 2)) AS db FROM c)"""


@query(_LOCATE + "\nSELECT link_id, round(CASE WHEN db < da - 1e-9 THEN bx ELSE ax END, 4) AS x, round(CASE WHEN db < da - 1e-9 THEN by_ ELSE ay END, 4) AS y, round(CASE WHEN db < da - 1e-9 THEN d1 + t2 * d2 ELSE t1 * d1 END / (d1 + d2), 5) AS fraction FROM d WHERE abs(da - db) > 1e-6 OR (t1 = 1 AND t2 = 0)")
def geo_closest_point(net: Network) -> DataFrame:
    """The nearest place on each line to a point off its middle, and its share of the length."""
    m = F.element_at("line", 2)
    g = lines(net).withColumn("l", G.located(F.col("line"), m.x + 35.0, m.y - 20.0)).withColumn("n", G.length(F.col("line")))
    return g.select("link_id", F.round("l.x", 4).alias("x"), F.round("l.y", 4).alias("y"), F.round(F.col("l.along") / F.col("n"), 5).alias("fraction"))


@query(_LINES + "\nSELECT link_id, CAST(CASE WHEN d1 / (d1 + d2) > 0.2 AND d1 / (d1 + d2) < 0.8 THEN 3 ELSE 2 END AS INTEGER) AS points, round(0.6 * (d1 + d2), 4) AS length FROM h")
def geo_substring(net: Network) -> DataFrame:
    """The part of each line between a fifth and four fifths."""
    g = lines(net).withColumn("part", G.substring(F.col("line"), F.lit(0.2), F.lit(0.8)))
    return g.select("link_id", F.size("part").alias("points"), F.round(G.length(F.col("part")), 4).alias("length"))


@query(_LINES + "\nSELECT link_id, round((0.75 - 0.25) * (d1 + d2), 4) AS arithmetic, round(0.5 * (d1 + d2), 4) AS measured FROM h")
def o_span_geometry(net: Network) -> DataFrame:
    """The closed part of a link as measured and as reckoned from its share."""
    g = lines(net).withColumn("n", G.length(F.col("line")))
    return g.select("link_id", F.round(F.col("n") * 0.5, 4).alias("arithmetic"), F.round(G.length(G.substring(F.col("line"), F.lit(0.25), F.lit(0.75))), 4).alias("measured"))


@query(_LINES + "\nSELECT link_id, round(sqrt(pow(xm + 1 - x1, 2) + pow(ym - 2 - y1, 2)) + sqrt(pow(x2 - xm - 1, 2) + pow(y2 - ym + 2, 2)), 4) AS length FROM h")
def geo_setpoint(net: Network) -> DataFrame:
    m = F.element_at("line", 2)
    return lines(net).select("link_id", F.round(G.length(G.set_point(F.col("line"), 1, m.x + 1, m.y - 2)), 4).alias("length"))


@query(_LINES + """, s AS (SELECT *, k / 20.0 :: DOUBLE * (d1 + d2) AS a FROM h, range(21) AS r(k)) SELECT link_id, round(sum(CASE WHEN a <= d1 THEN x1 + (xm - x1) * a / d1 ELSE xm + (x2 - xm) * (a - d1) / d2 END), 3) AS x, round(sum(CASE WHEN a <= d1 THEN y1 + (ym - y1) * a / d1 ELSE ym + (y2 - ym) * (a - d1) / d2 END), 3) AS y FROM s GROUP BY link_id""")
def geo_sample(net: Network) -> DataFrame:
    """Twenty-one places at even shares of each line, added up."""
    g = lines(net).select("link_id", F.explode(G.sample(F.col("line"), 20)).alias("p"))
    return g.groupBy("link_id").agg(F.round(F.sum("p.x"), 3).alias("x"), F.round(F.sum("p.y"), 3).alias("y"))


@query(_LINES + "\nSELECT link_id, round(CASE WHEN (d1 + d2) / 2 <= d1 THEN x1 + (xm - x1) * (d1 + d2) / 2 / d1 ELSE xm + (x2 - xm) * ((d1 + d2) / 2 - d1) / d2 END, 4) AS x, round(CASE WHEN (d1 + d2) / 2 <= d1 THEN y1 + (ym - y1) * (d1 + d2) / 2 / d1 ELSE ym + (y2 - ym) * ((d1 + d2) / 2 - d1) / d2 END, 4) AS y FROM h")
def geo_centroid(net: Network) -> DataFrame:
    """The place half way along: it lies on the line, as a centroid may not."""
    g = lines(net).withColumn("p", G.midpoint(F.col("line")))
    return g.select("link_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM nodes")
def fn_reproject(net: Network) -> DataFrame:
    """Grid to degrees and back, to the millimetre."""
    n = net.nodes.select("node_id", G.to_degrees(F.col("x") + 1_600_000.0, F.col("y") + 5_400_000.0).alias("d"))
    n = n.select("node_id", G.to_grid(F.col("d.lon"), F.col("d.lat")).alias("g"))
    tidy = lambda c, off: (F.round(F.col(c) - off, 3) + 0.0)
    return n.select("node_id", tidy("g.x", 1_600_000.0).alias("x"), tidy("g.y", 5_400_000.0).alias("y"))


@query(_LINES + "\nSELECT link_id, CAST(x1 AS DOUBLE) AS x_first, CAST(y2 AS DOUBLE) AS y_last FROM h")
def geo_transform(net: Network) -> DataFrame:
    """Whole lines to degrees and back."""
    shift = F.transform("line", lambda p: G.to_degrees(p.x + 1_600_000.0, p.y + 5_400_000.0))
    back = lines(net).select("link_id", shift.alias("d")).select("link_id", F.transform("d", lambda p: G.to_grid(p.lon, p.lat)).alias("g"))
    return back.select("link_id", (F.round(F.element_at("g", 1).x - 1_600_000.0, 3) + 0.0).alias("x_first"), (F.round(F.element_at("g", -1).y - 5_400_000.0, 3) + 0.0).alias("y_last"))


@query("SELECT link_id, round(CAST(link_id % 1024 AS DOUBLE) * 39135.75848201024 - CAST(20037508.342789244 AS DOUBLE), 2) AS minx, round(CAST(20037508.342789244 AS DOUBLE) - CAST(link_id * 7 % 1024 AS DOUBLE) * 39135.75848201024, 2) AS maxy FROM links")
def geo_tile_envelope(net: Network) -> DataFrame:
    e = net.links.select("link_id", G.tile_envelope(F.lit(10.0), F.col("link_id") % 1024, F.col("link_id") * 7 % 1024).alias("e"))
    return e.select("link_id", F.round("e.minx", 2).alias("minx"), F.round("e.maxy", 2).alias("maxy"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, least(1.0, l_discount * 20 - 0.5)) AS fraction FROM lineitem")
def clamp_fraction(net: Network) -> DataFrame:
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 20 - 0.5))
    return net.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f.alias("fraction"))


def merge_lines(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lines of one group stitched where exactly two of them end at a place."""
    parts = {i: [(p["x"], p["y"]) for p in line] for i, line in enumerate(pdf["line"])}
    ends: dict[tuple, list[int]] = {}
    for i, p in parts.items():
        for e in (p[0], p[-1]):
            ends.setdefault(e, []).append(i)
    for e in sorted(ends):
        at = [i for i in ends[e] if i in parts]
        if len(at) != 2 or at[0] == at[1]:
            continue
        a, b = (parts.pop(i) for i in at)
        a = a if a[-1] == e else a[::-1]
        b = b if b[0] == e else b[::-1]
        parts[at[0]] = a + b[1:]
        for other in (a[0], b[-1]):
            ends[other] = [at[0] if i in at else i for i in ends[other]]
    rows = sorted(parts.values())
    return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(rows), "part": range(len(rows)), "line": [[{"x": x, "y": y} for x, y in r] for r in rows]})


_MERGED = _LINES + """, gn AS (SELECT closure_group_id AS g, source AS node FROM links UNION SELECT closure_group_id, target FROM links), ge AS (SELECT closure_group_id AS g, source AS a, target AS b FROM links UNION SELECT closure_group_id, target, source FROM links),
piece(g, node, p) USING KEY (g, node) AS (SELECT g, node, node FROM gn UNION SELECT n.g, n.node, n.p FROM (SELECT ge.g, ge.b AS node, min(piece.p) AS p FROM piece JOIN ge ON ge.g = piece.g AND ge.a = piece.node GROUP BY ge.g, ge.b) n JOIN recurring.piece r ON r.g = n.g AND r.node = n.node WHERE n.p < r.p),
mg AS (SELECT l.closure_group_id AS g, p, round(sum(d1 + d2), 4) AS length FROM links l JOIN h USING (link_id) JOIN piece ON piece.g = l.closure_group_id AND piece.node = l.source GROUP BY 1, 2)"""


def merged(net: Network) -> DataFrame:
    """The lines of each closure group, merged. A group has a handful of links."""
    g = lines(net).join(net.links.select("link_id", F.col("closure_group_id").alias("g")), "link_id").select("g", "line")
    m = g.groupBy("g").applyInPandas(merge_lines, "g string, part int, line array<struct<x:double,y:double>>")
    return m.withColumn("length", F.round(G.length(F.col("line")), 4))


@query(_MERGED + "\nSELECT g AS closure_group_id, count(*) AS parts, round(sum(length), 3) AS length FROM mg GROUP BY g")
def geo_linemerge(net: Network) -> DataFrame:
    return merged(net).groupBy(F.col("g").alias("closure_group_id")).agg(F.count("*").alias("parts"), F.round(F.sum("length"), 3).alias("length"))


@query(_MERGED + "\nSELECT g AS closure_group_id, max(length) AS longest FROM mg GROUP BY g")
def join_lateral_longest_part(net: Network) -> DataFrame:
    return merged(net).groupBy(F.col("g").alias("closure_group_id")).agg(F.max("length").alias("longest"))


def hull(pdf: pd.DataFrame) -> pd.DataFrame:
    """The convex hull of one group's points, against the clock from the leftmost."""
    points = sorted(set(zip(pdf["x"], pdf["y"], strict=True)))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = half(points) + half(points[::-1]) or points
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "hull": [[{"x": float(x), "y": float(y)} for x, y in h]]})


@query(""", p AS (SELECT rca_code AS g, n.node_id, n.x, n.y FROM links JOIN nodes n ON n.node_id IN (source, target)), u AS (SELECT DISTINCT g, node_id, x, y FROM p),
b AS (SELECT g, max(x) - min(x) AS width, max(y) - min(y) AS height FROM u GROUP BY g) SELECT g AS rca_code, width, height, (SELECT count(*) FROM u WHERE u.g = b.g) AS inside FROM b""")
def geo_convex_hull(net: Network) -> DataFrame:
    """The hull of each authority's nodes: its extent, and how many of them it holds (all)."""
    n = net.nodes
    p = net.links.select(F.col("rca_code").alias("g"), F.explode(F.array("source", "target")).alias("node_id")).distinct().join(n, "node_id")
    # of each row and column of nodes only the outermost can be on the hull
    few = p.groupBy("g", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("g", F.explode(F.array("a", "b")).alias("x"), "y").distinct()
    h = few.groupBy("g").applyInPandas(hull, "g int, hull array<struct<x:double,y:double>>")
    side = F.expr("forall(sequence(0, size(hull) - 1), i -> (hull[(i + 1) % size(hull)].x - hull[i].x) * (y - hull[i].y) - (hull[(i + 1) % size(hull)].y - hull[i].y) * (x - hull[i].x) >= -1e-9)")
    inside = p.join(h, "g").where(side).groupBy("g").agg(F.count("*").alias("inside"))
    xs, ys = F.transform("hull", lambda q: q.x), F.transform("hull", lambda q: q.y)
    size = lambda v: (F.array_max(v) - F.array_min(v)).cast("long")
    return h.join(inside, "g").select(F.col("g").alias("rca_code"), size(xs).alias("width"), size(ys).alias("height"), "inside")


# --- places on roads and outages ---------------------------------------------------------------
_SNAP = _STREETS + """, sp AS (SELECT structure AS point, feature, f.across, s.x1 AS px, s.y1 AS py, greatest(f.x1, least(f.x2, s.x1)) AS sx, greatest(f.y1, least(f.y2, s.y1)) AS sy, f.x1, f.y1, f.size FROM ss s JOIN fs f ON s.x1 BETWEEN f.x1 - 150 AND f.x2 + 150 AND s.y1 BETWEEN f.y1 - 150 AND f.y2 + 150),
so AS (SELECT *, round(sqrt(pow(px - sx, 2) + pow(py - sy, 2)), 6) AS off, round(CASE WHEN across THEN sx - x1 ELSE sy - y1 END / size, 9) AS fraction FROM sp WHERE sqrt(pow(px - sx, 2) + pow(py - sy, 2)) <= 150),
sk AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY off, feature) AS place FROM so),
sf AS (SELECT k.*, sqrt(pow(k.sx - c.sx, 2) + pow(k.sy - c.sy, 2)) AS apart, k.off - c.off AS behind FROM sk k JOIN sk c ON c.point = k.point AND c.place = 1 WHERE k.place <= 8),
sr AS (SELECT *, CASE WHEN place = 1 THEN 'chosen' WHEN apart <= 3 THEN 'equivalent' ELSE 'alternative' END AS role FROM sf)"""


@query(_SNAP + "\nSELECT point, place, feature, round(off, 3) AS distance, round(fraction, 6) AS fraction, role, bool_or(role = 'alternative' AND behind <= 6) OVER (PARTITION BY point) AS ambiguous FROM sr")
def o_snap(net: Network) -> DataFrame:
    """The roads a click may mean, the one it does, and whether that is a question."""
    s = Streets(net)
    clicks = s.structures.select(F.col("structure").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return S.snap(clicks, s.features).select("point", "place", "feature", F.round("offset", 3).alias("distance"), F.round("fraction", 6).alias("fraction"), "role", "ambiguous")


@query(_SNAP + "\nSELECT point, feature, off AS distance FROM (SELECT point, feature, round(off, 3) AS off, place FROM sk) WHERE place <= 3")
def join_knn(net: Network) -> DataFrame:
    """The three nearest features to each point: rings of cells widen until they are certain."""
    s = Streets(net)
    points = s.structures.select(F.col("structure").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return S.nearest(points, s.features, 3).select("point", "feature", F.round("distance", 3).alias("distance"))


@query(_STREETS + "\nSELECT feature, round(x1 + CASE WHEN across THEN 0.25 * size ELSE 0 END, 3) AS x, round(y1 + CASE WHEN across THEN 0 ELSE 0.25 * size END, 3) AS y FROM fs")
def o_at_position(net: Network) -> DataFrame:
    """A share of a feature's length as a point."""
    f = Streets(net).features.withColumn("p", G.interpolate(F.col("line"), F.lit(0.25)))
    return f.select("feature", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(""", ct AS (SELECT link_id, (link_id % 7) / 10.0 - 0.1 AS low, (link_id % 7) / 10.0 + 0.25 AS high FROM links), cc AS (SELECT link_id, low, high, list_sort(list_distinct([0.0, greatest(0.0, least(1.0, low)), greatest(0.0, least(1.0, high)), 1.0])) :: DOUBLE[] AS m FROM ct),
pc AS (SELECT a.arc_id, k - 1 AS piece, m[k] AS f0, m[k + 1] AS f1, low, high, cost_mm, cost_ms FROM arcs a JOIN cc USING (link_id), range(1, 4) AS r(k) WHERE k < len(m))
SELECT arc_id, CAST(piece AS INTEGER) AS piece, round(f0, 6) AS low, round(f1, 6) AS high, (f0 + f1) / 2 > low AND (f0 + f1) / 2 < high AS closed, round((f1 - f0) * cost_mm, 2) AS cost_mm, round((f1 - f0) * cost_ms, 2) AS cost_ms FROM pc""")
def o_vsplit(net: Network) -> DataFrame:
    """Arcs cut where a closure begins and ends, clamped to the link, both costs pro rata."""
    i = F.col("link_id") % 7
    cuts = net.links.select("link_id", (i / 10.0 - 0.1).alias("low"), (i / 10.0 + 0.25).alias("high"))
    p = S.split_arcs(net.arcs, cuts)
    return p.select("arc_id", "piece", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "closed", F.round("cost_mm", 2).alias("cost_mm"), F.round("cost_ms", 2).alias("cost_ms"))


@query(""", e AS (SELECT link_id, source, target, cost_mm AS cost FROM arcs WHERE mode_car), rq AS (SELECT link_id, length_mm, oneway, k, CASE k WHEN 0 THEN source ELSE target END AS s, CASE k WHEN 0 THEN target ELSE source END AS t FROM links, (VALUES (0), (1)) AS v(k) WHERE mode_car AND source <> target),
d(link_id, k, node, cost) USING KEY (link_id, k, node) AS (
  SELECT link_id, k, s, CAST(0 AS BIGINT) FROM rq
  UNION
  SELECT n.link_id, n.k, n.node, n.cost FROM (SELECT d.link_id, d.k, e.target AS node, min(d.cost + e.cost) AS cost FROM d JOIN e ON e.source = d.node AND e.link_id <> d.link_id GROUP BY d.link_id, d.k, e.target) n
  JOIN rq ON rq.link_id = n.link_id AND rq.k = n.k LEFT JOIN recurring.d r ON r.link_id = n.link_id AND r.k = n.k AND r.node = n.node LEFT JOIN recurring.d b ON b.link_id = n.link_id AND b.k = n.k AND b.node = rq.t
  WHERE (r.cost IS NULL OR n.cost < r.cost) AND (b.cost IS NULL OR n.cost < b.cost)
), ms AS (SELECT rq.link_id, CASE rq.k WHEN 0 THEN 'a_to_b' ELSE 'b_to_a' END AS direction, CASE WHEN d.cost IS NOT NULL AND (rq.k = 1 OR NOT oneway) THEN d.cost + 0.75 * length_mm END AS way, 0.25 * length_mm AS closed FROM rq LEFT JOIN d ON d.link_id = rq.link_id AND d.k = rq.k AND d.node = rq.t
), mz AS (SELECT DISTINCT * FROM ms)
SELECT link_id, direction, CASE WHEN way IS NULL THEN 'DISCONNECTED' ELSE 'OK' END AS status, round(CAST(way AS DOUBLE), 3) AS replacement_mm, round(CAST(way - closed AS DOUBLE), 3) AS added_mm, round(CAST(way AS DOUBLE) / closed, 3) AS ratio,
  CASE count(way) OVER (PARTITION BY link_id) WHEN 0 THEN 'No replacement route in the represented network' WHEN 1 THEN 'Replacement route found in one direction only' ELSE 'Replacement route found' END AS headline FROM mz""")
def o_analyse(net: Network) -> DataFrame:
    """Each link closed from a quarter to a half: the way from one end of the outage to the other."""
    return S.outages(net.links, net.arcs, 0.25, 0.5)
