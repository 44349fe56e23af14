"""Topology built from raw streets: junctions, nodes, crossings, what is decided about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import topology as T
from ..sources.lattice import Network
from ..sources.streets import SQL as _STREETS
from ..sources.streets import Streets
from .catalogue import query
from .scratch import materialise

#: Ends within five metres of another feature; along is measured from the feature's start.
_JUNCTIONS = _STREETS + """, ends AS (SELECT feature AS owner, x1 AS x, y1 AS y FROM fs UNION ALL SELECT feature, x2, y2 FROM fs),
jn AS (
  SELECT f.feature, e.owner, e.x, e.y, f.size, CASE WHEN f.across THEN greatest(0.0, least(f.size, e.x - f.x1)) ELSE greatest(0.0, least(f.size, e.y - f.y1)) END AS along,
         sqrt(pow(e.x - greatest(f.x1, least(f.x2, e.x)), 2) + pow(e.y - greatest(f.y1, least(f.y2, e.y)), 2)) AS distance,
         least(sqrt(pow(e.x - f.x1, 2) + pow(e.y - f.y1, 2)), sqrt(pow(e.x - f.x2, 2) + pow(e.y - f.y2, 2))) AS own
  FROM ends e JOIN fs f ON f.feature <> e.owner AND e.x BETWEEN f.x1 - 5 AND f.x2 + 5 AND e.y BETWEEN f.y1 - 5 AND f.y2 + 5
), jk AS (SELECT *, CASE WHEN distance > 0.05 THEN 'near_miss' WHEN along > 0.05 AND along < size - 0.05 THEN 'cut' END AS kind FROM jn WHERE distance <= 5 AND own > 0.05)"""


@query(_JUNCTIONS + "\nSELECT feature, owner, round(x, 3) AS x, round(y, 3) AS y, round(distance, 3) AS distance, round(along, 3) AS along, kind FROM jk WHERE kind IS NOT NULL")
def topo_split_tjunction(net: Network) -> DataFrame:
    """Where an end lies on another feature's inside (a cut) or near it (never joined)."""
    r = lambda c: F.round(c, 3).alias(c)
    return T.junctions(Streets(net).features).select("feature", "owner", r("x"), r("y"), r("distance"), r("along"), "kind")


_CUTS = _JUNCTIONS + """, cuts AS (SELECT DISTINCT feature, along, x, y FROM jk WHERE kind = 'cut'), kept AS (SELECT * FROM cuts QUALIFY coalesce(along - lag(along) OVER (PARTITION BY feature ORDER BY along, x, y) > 0.05, true))"""


def _cuts(net: Network) -> DataFrame:
    return T.junctions(Streets(net).features).where("kind = 'cut'").select("feature", "along", "x", "y")


@query(_CUTS + "\nSELECT feature, round(along, 3) AS along, round(x, 3) AS x, round(y, 3) AS y FROM kept")
def topo_dedupe_cuts(net: Network) -> DataFrame:
    return T.dedupe_cuts(_cuts(net)).select("feature", *(F.round(c, 3).alias(c) for c in ("along", "x", "y")))


_PIECES = _CUTS + """, marks AS (
  SELECT feature, CAST(0 AS DOUBLE) AS along, x1 AS x, y1 AS y FROM fs UNION ALL SELECT feature, CAST(size AS DOUBLE), x2, y2 FROM fs UNION ALL SELECT feature, along, x, y FROM kept
), pieces AS (
  SELECT feature, CAST(row_number() OVER w - 1 AS INTEGER) AS part, count(*) OVER (PARTITION BY feature) - 1 AS parts, x AS px1, y AS py1, lead(x) OVER w AS px2, lead(y) OVER w AS py2, along FROM marks WINDOW w AS (PARTITION BY feature ORDER BY along)
  QUALIFY px2 IS NOT NULL
)"""


@query(_PIECES + "\nSELECT feature, part, CAST(parts AS INTEGER) AS parts, round(px1, 3) AS x1, round(py1, 3) AS y1, round(px2, 3) AS x2, round(py2, 3) AS y2, round(sqrt(pow(px2 - px1, 2) + pow(py2 - py1, 2)), 3) AS length FROM pieces")
def topo_cut_line(net: Network) -> DataFrame:
    """Pieces between cuts; both roads of a junction end on the very same coordinates."""
    from ..functions import geometry as G

    p = T.cut_lines(Streets(net).features, _cuts(net))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    return p.select("feature", "part", "parts", F.round(a.x, 3).alias("x1"), F.round(a.y, 3).alias("y1"), F.round(b.x, 3).alias("x2"), F.round(b.y, 3).alias("y2"), F.round(G.length(F.col("line")), 3).alias("length"))


_NODES = _PIECES + """, pts AS (SELECT px1 AS x, py1 AS y FROM pieces UNION SELECT px2, py2 FROM pieces), nd AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS node FROM pts)"""


@query(_NODES + "\nSELECT p.feature, p.part, s.node AS source, t.node AS target FROM pieces p JOIN nd s ON s.x = px1 AND s.y = py1 JOIN nd t ON t.x = px2 AND t.y = py2")
def topo_assign_nodes(net: Network) -> DataFrame:
    """Coincident ends are one node, numbered by coordinates."""
    pieces, _ = T.build(Streets(net).features, _cuts(net))
    return pieces.select("feature", "part", "source", "target")


# --- crossings ---------------------------------------------------------------------------------
_FOUND = _STREETS + """, cr AS (
  SELECT least(h.feature, v.feature) AS a, greatest(h.feature, v.feature) AS b, round(v.x1, 6) AS x, round(h.y1, 6) AS y, v.x1 - h.x1 AS along_h, h.y1 - v.y1 AS along_v, h.feature < v.feature AS first, h.size AS hs, v.size AS vs
  FROM fs h JOIN fs v ON h.across AND NOT v.across AND v.x1 BETWEEN h.x1 AND h.x2 AND h.y1 BETWEEN v.y1 AND v.y2
), found AS (SELECT a, b, x, y, CASE WHEN first THEN along_h ELSE along_v END AS along_a, CASE WHEN first THEN along_v ELSE along_h END AS along_b, CAST(90 AS DOUBLE) AS angle FROM cr
  WHERE along_h > 0.05 AND along_h < hs - 0.05 AND along_v > 0.05 AND along_v < vs - 0.05)"""


@query(_FOUND + "\nSELECT a, b, round(x, 3) AS x, round(y, 3) AS y, round(along_a, 3) AS along_a, round(along_b, 3) AS along_b FROM found")
def topo_detect_crossings(net: Network) -> DataFrame:
    return T.crossings(Streets(net).features).select("a", "b", *(F.round(c, 3).alias(c) for c in ("x", "y", "along_a", "along_b")))


@query(_FOUND + "\nSELECT a, b, angle FROM found")
def fn_crossing_angle(net: Network) -> DataFrame:
    """The angle between bearings over ten metres either side, from 0 to 90."""
    return T.crossings(Streets(net).features).select("a", "b", F.round("angle", 3).alias("angle"))


#: Distances from a crossing to what lies around it, with lines as boxes of no width.
_CONTEXT = _FOUND + """, ends AS (SELECT feature AS owner, x1 AS ex, y1 AS ey FROM fs UNION ALL SELECT feature, x2, y2 FROM fs),
wt AS (SELECT DISTINCT a, b FROM found JOIN ends ON owner <> a AND owner <> b AND ex BETWEEN x - 1 AND x + 1 AND ey BETWEEN y - 1 AND y + 1 AND sqrt(pow(ex - x, 2) + pow(ey - y, 2)) <= 1),
cg AS (SELECT floor(x1 / 600) + i AS gx, floor(y1 / 600) + j AS gy, * FROM fs, range(-1, 2) AS r1(i), range(-1, 2) AS r2(j) WHERE is_ramp OR (rca_code = 1 AND oneway)),
nr AS (SELECT a, b, count(*) FILTER (is_ramp) AS ramps_near, count(*) FILTER (rca_code = 1 AND oneway) AS highways_near FROM found JOIN cg ON gx = floor(x / 600) AND gy = floor(y / 600)
  AND sqrt(pow(x - greatest(x1, least(x2, x)), 2) + pow(y - greatest(y1, least(y2, y)), 2)) <= 300 GROUP BY a, b),
sr AS (SELECT a, b, f.across, structure, round(sqrt(pow(x - greatest(x1, least(x1 + CASE WHEN f.across THEN 30 ELSE 0 END, x)), 2) + pow(y - greatest(y1, least(y1 + CASE WHEN f.across THEN 0 ELSE 30 END, y)), 2)), 6) AS d
  FROM found JOIN ss f ON x1 BETWEEN x - 55 AND x + 25 AND y1 BETWEEN y - 55 AND y + 25),
sn AS (SELECT a, b, d AS structure_distance FROM sr WHERE d <= 25 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY d, structure) = 1),
ctx AS (
  SELECT c.*, wt.a IS NOT NULL AS witness, coalesce(ramps_near, 0) AS ramps_near, coalesce(highways_near, 0) AS highways_near, structure_distance, CASE WHEN structure_distance IS NOT NULL THEN CAST(0 AS DOUBLE) END AS structure_align,
    fa.rca_code AS ra, fb.rca_code AS rb, fa.oneway AS oa, fb.oneway AS ob, fa.is_ramp AS pa, fb.is_ramp AS pb, fa.asset_type AS ta, fb.asset_type AS tb, fa.name AS na, fb.name AS nb, fa.height_limit AS ha, fb.height_limit AS hb
  FROM found c JOIN fs fa ON fa.feature = c.a JOIN fs fb ON fb.feature = c.b LEFT JOIN wt ON wt.a = c.a AND wt.b = c.b LEFT JOIN nr ON nr.a = c.a AND nr.b = c.b LEFT JOIN sn ON sn.a = c.a AND sn.b = c.b
)"""


def _context(net: Network) -> DataFrame:
    s = Streets(net)
    return T.context(materialise(T.crossings(s.features), "crossings"), s.features, s.structures)


@query(_CONTEXT + "\nSELECT a, b, witness, ramps_near, highways_near, round(structure_distance, 3) AS structure_distance, structure_align, false AS duplicate FROM ctx")
def topo_build_context(net: Network) -> DataFrame:
    return _context(net).select("a", "b", "witness", "ramps_near", "highways_near", F.round("structure_distance", 3).alias("structure_distance"), F.round("structure_align", 3).alias("structure_align"), "duplicate")


_CLASSIFIED = _CONTEXT + """, cl AS (
  SELECT *, ta = 1 AND tb = 1 AND NOT oa AND NOT ob AS ordinary, CASE WHEN structure_distance <= 25 THEN 'STRUCTURE_MAPPED' WHEN na LIKE '%bridge%' OR nb LIKE '%bridge%' THEN 'NAMED_STRUCTURE' WHEN pa OR pb THEN 'RAMP' WHEN ta = 2 OR tb = 2 THEN 'CONNECTOR'
    WHEN na LIKE '%Interchange%' OR nb LIKE '%Interchange%' THEN 'NAMED_ROAD_CLASS' WHEN (ra = 1 AND oa) OR (rb = 1 AND ob) THEN 'MOTORWAY_CARRIAGEWAY' WHEN ha OR hb THEN 'HEIGHT_LIMIT' WHEN ramps_near > 0 THEN 'RAMP_CONTEXT' WHEN highways_near > 0 THEN 'MOTORWAY_CONTEXT'
    WHEN witness AND ordinary THEN 'JUNCTION_WITNESS' WHEN ordinary THEN 'ORDINARY_CROSSROADS' ELSE 'NO_EVIDENCE_EITHER_WAY' END AS reason FROM ctx
), cd AS (SELECT a, b, x, y, along_a, along_b, reason, CASE WHEN reason IN ('STRUCTURE_MAPPED', 'NAMED_STRUCTURE') THEN 'GRADE_SEPARATED' WHEN reason IN ('JUNCTION_WITNESS', 'ORDINARY_CROSSROADS') THEN 'AT_GRADE' ELSE 'UNRESOLVED' END AS disposition,
  CASE WHEN reason IN ('STRUCTURE_MAPPED', 'NAMED_STRUCTURE', 'JUNCTION_WITNESS') THEN 'high' WHEN reason = 'ORDINARY_CROSSROADS' THEN 'medium' ELSE 'low' END AS confidence FROM cl)"""


def _classified(net: Network) -> DataFrame:
    return materialise(T.classify(_context(net)).select("a", "b", "x", "y", "along_a", "along_b", "disposition", "reason", "confidence"), "classified")


@query(_CLASSIFIED + "\nSELECT a, b, disposition, reason, confidence FROM cd")
def topo_classify_crossing(net: Network) -> DataFrame:
    """The first of fourteen rules that applies to what was measured around a crossing."""
    return _classified(net).select("a", "b", "disposition", "reason", "confidence")


_PLACES = _CLASSIFIED + """, cp AS (SELECT a, b, x, y, row_number() OVER (ORDER BY a, b) AS k, floor(x / 25) AS cx, floor(y / 25) AS cy FROM found),
pn AS (SELECT p.k AS u, q.k AS v FROM cp p, range(-1, 2) AS r1(i), range(-1, 2) AS r2(j) JOIN cp q ON q.cx = p.cx + i AND q.cy = p.cy + j WHERE p.k <> q.k AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 25),
pl(k, place) USING KEY (k) AS (
  SELECT k, k FROM cp
  UNION
  SELECT n.k, n.place FROM (SELECT pn.v AS k, min(pl.place) AS place FROM pl JOIN pn ON pn.u = pl.k GROUP BY pn.v) n JOIN recurring.pl r ON r.k = n.k WHERE n.place < r.place
), placed AS (SELECT cd.*, f.a AS place_a, f.b AS place_b FROM cd JOIN cp USING (a, b) JOIN pl USING (k) JOIN cp f ON f.k = pl.place),
mx AS (SELECT place_a, place_b, count(DISTINCT disposition) > 1 AS mixed FROM placed GROUP BY 1, 2),
dm AS (SELECT a, b, x, y, along_a, along_b, CASE WHEN mixed THEN 'UNRESOLVED' ELSE disposition END AS disposition, CASE WHEN mixed THEN 'MIXED_PLACE' ELSE reason END AS reason FROM placed JOIN mx USING (place_a, place_b))"""


@query(_PLACES + "\nSELECT a, b, place_a, place_b FROM placed")
def topo_cluster_places(net: Network) -> DataFrame:
    """Crossings chained within twenty-five metres are one place."""
    return T.places(_classified(net)).select("a", "b", F.col("place.a").alias("place_a"), F.col("place.b").alias("place_b"))


def _demoted(net: Network) -> DataFrame:
    return materialise(T.demote_mixed(T.places(_classified(net))), "demoted")


@query(_PLACES + "\nSELECT a, b, disposition, reason FROM dm")
def topo_demote_mixed(net: Network) -> DataFrame:
    """A place whose crossings disagree settles none of them."""
    return _demoted(net).select("a", "b", "disposition", "reason")


#: Reviewed decisions near crossings, by rule: some too far away, some retired, some at odds.
_OVERRIDES = """, ov AS (
  SELECT b AS source_a, a AS source_b, x + (a + b) % 9 AS x, y, CASE WHEN (a + b) % 2 = 0 THEN 'AT_GRADE' ELSE 'GRADE_SEPARATED' END AS decision, CASE WHEN a % 5 = 0 THEN DATE '2025-06-30' WHEN a % 5 = 1 THEN DATE '2026-06-30' END AS retired_on FROM found WHERE (a + b) % 3 = 0
  UNION ALL SELECT a, b, x, y + 1, 'AT_GRADE', NULL FROM found WHERE (a + b) % 21 = 0
), lv AS (SELECT * FROM ov WHERE retired_on IS NULL OR DATE '2026-01-01' < retired_on),
de AS (SELECT f.a, f.b, CASE WHEN count(DISTINCT decision) > 1 THEN 'CONFLICT' ELSE min(decision) END AS decision FROM found f JOIN lv ON least(source_a, source_b) = f.a AND greatest(source_a, source_b) = f.b AND sqrt(pow(f.x - lv.x, 2) + pow(f.y - lv.y, 2)) <= 5 GROUP BY f.a, f.b)"""
TODAY = "2026-01-01"


def overrides(found: DataFrame) -> DataFrame:
    k, date = F.col("a") + F.col("b"), lambda d: F.lit(d).cast("date")
    one = found.where(k % 3 == 0).select(
        F.col("b").alias("source_a"), F.col("a").alias("source_b"), (F.col("x") + k % 9).alias("x"), "y", F.when(k % 2 == 0, "AT_GRADE").otherwise("GRADE_SEPARATED").alias("decision"), F.when(F.col("a") % 5 == 0, date("2025-06-30")).when(F.col("a") % 5 == 1, date("2026-06-30")).alias("retired_on")
    )
    return one.unionByName(found.where(k % 21 == 0).select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), "x", (F.col("y") + 1).alias("y"), F.lit("AT_GRADE").alias("decision"), F.lit(None).cast("date").alias("retired_on")))


@query(_FOUND + _OVERRIDES + "\nSELECT source_a, source_b, decision, retired_on FROM lv")
def filter_live_override(net: Network) -> DataFrame:
    """Decisions that are not retired yet."""
    o = overrides(T.crossings(Streets(net).features))
    return o.where(F.col("retired_on").isNull() | (F.lit(TODAY).cast("date") < F.col("retired_on"))).select("source_a", "source_b", "decision", "retired_on")


@query(_FOUND + _OVERRIDES + "\nSELECT f.a, f.b, lv.decision, round(sqrt(pow(f.x - lv.x, 2) + pow(f.y - lv.y, 2)), 3) AS distance FROM found f JOIN lv ON least(source_a, source_b) = f.a AND greatest(source_a, source_b) = f.b AND sqrt(pow(f.x - lv.x, 2) + pow(f.y - lv.y, 2)) <= 5")
def join_override_match(net: Network) -> DataFrame:
    """Decisions by the unordered pair and within five metres."""
    found = T.crossings(Streets(net).features)
    o = overrides(found).where(F.col("retired_on").isNull() | (F.lit(TODAY).cast("date") < F.col("retired_on")))
    o = o.select(F.least("source_a", "source_b").alias("a"), F.greatest("source_a", "source_b").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"), "decision")
    apart = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return found.join(o, ["a", "b"]).where(apart <= 5).select("a", "b", "decision", F.round(apart, 3).alias("distance"))


_DECIDED = _PLACES + _OVERRIDES + """, dd AS (SELECT dm.*, de.decision, reason <> 'MIXED_PLACE' AS safe_to_node FROM dm LEFT JOIN de ON de.a = dm.a AND de.b = dm.b)"""


def _decided(net: Network) -> DataFrame:
    d = _demoted(net)
    return T.decide(d, overrides(d), TODAY)


@query(_DECIDED + "\nSELECT a, b, disposition, decision, safe_to_node, coalesce(decision = 'AT_GRADE', false) AND safe_to_node AS noded FROM dd")
def topo_override_decide(net: Network) -> DataFrame:
    """What the evidence decides: disagreement, like silence, connects nothing."""
    return T.gate(_decided(net), "evidence").select("a", "b", "disposition", "decision", "safe_to_node", "noded")


@query(_DECIDED + """, p AS (SELECT v.p AS policy, safe_to_node AND CASE v.p WHEN 'none' THEN false WHEN 'evidence' THEN coalesce(decision = 'AT_GRADE', false) WHEN 'confirmed' THEN disposition = 'AT_GRADE' ELSE disposition IN ('AT_GRADE', 'UNRESOLVED') END AS noded FROM dd, (VALUES ('none'), ('evidence'), ('confirmed'), ('possible')) AS v(p))
SELECT policy, count(*) AS crossings, count(*) FILTER (noded) AS noded FROM p GROUP BY policy""")
def topo_policy_gate(net: Network) -> DataFrame:
    """How many crossings each policy would make nodes of."""
    d = materialise(_decided(net), "decided")
    one = [T.gate(d, p, research=True).agg(F.lit(p).alias("policy"), F.count("*").alias("crossings"), F.count_if("noded").alias("noded")) for p in T.POLICIES]
    return one[0].union(one[1]).union(one[2]).union(one[3])


@query(_DECIDED + "\nSELECT a, b, round(x, 3) AS x, round(y, 3) AS y FROM dd WHERE safe_to_node AND NOT coalesce(decision = 'AT_GRADE', false)")
def filter_canonical_candidate(net: Network) -> DataFrame:
    """Crossings that are no node and could be one."""
    return T.gate(_decided(net), "evidence").where("NOT noded AND safe_to_node").select("a", "b", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


#: The same pieces and nodes with the cuts of noded crossings.
_NODED = _DECIDED.replace(_STREETS, _JUNCTIONS.replace("ends AS", "jends AS").replace("FROM ends e", "FROM jends e"), 1) + """, nc AS (SELECT * FROM dd WHERE safe_to_node AND decision = 'AT_GRADE'),
cuts AS (SELECT DISTINCT feature, along, x, y FROM jk WHERE kind = 'cut' UNION SELECT a, along_a, x, y FROM nc UNION SELECT b, along_b, x, y FROM nc),
kept AS (SELECT * FROM cuts QUALIFY coalesce(along - lag(along) OVER (PARTITION BY feature ORDER BY along, x, y) > 0.05, true)),
marks AS (SELECT feature, CAST(0 AS DOUBLE) AS along, x1 AS x, y1 AS y FROM fs UNION ALL SELECT feature, CAST(size AS DOUBLE), x2, y2 FROM fs UNION ALL SELECT feature, along, x, y FROM kept)"""


@query(_NODED + """, touch AS (SELECT DISTINCT feature, x, y FROM marks)
SELECT d.a, d.b, round(d.x, 3) AS x, round(d.y, 3) AS y FROM dd d JOIN touch s ON s.feature = d.a JOIN touch t ON t.feature = d.b AND t.x = s.x AND t.y = s.y AND sqrt(pow(d.x - t.x, 2) + pow(d.y - t.y, 2)) <= 1 WHERE NOT (safe_to_node AND coalesce(decision = 'AT_GRADE', false))""")
def topo_audit(net: Network) -> DataFrame:
    """Crossings left apart whose roads share a node there all the same."""
    found = materialise(T.gate(_decided(net), "evidence"), "gated")
    features = Streets(net).features
    pieces, nodes = T.build(features, _cuts(net).unionByName(T.crossing_cuts(found)))
    return T.audit(found, pieces, nodes).select("a", "b", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(_NODES + """, pe AS (SELECT p.feature, p.part, s.node AS u, t.node AS v FROM pieces p JOIN nd s ON s.x = px1 AND s.y = py1 JOIN nd t ON t.x = px2 AND t.y = py2),
sq AS (SELECT DISTINCT owner, feature FROM jk WHERE kind = 'cut')
SELECT q.owner, q.feature, min(struct_pack(p := a.part, q := b.part)).p AS from_part, min(struct_pack(p := a.part, q := b.part)).q AS to_part FROM sq q JOIN pe a ON a.feature = q.owner JOIN pe b ON b.feature = q.feature AND (b.u IN (a.u, a.v) OR b.v IN (a.u, a.v)) GROUP BY q.owner, q.feature""")
def topo_resolve_restrictions(net: Network) -> DataFrame:
    """Turns named by features, from a side road onto the road it ends on, as child pieces that meet."""
    features = Streets(net).features
    j = materialise(T.junctions(features).where("kind = 'cut'"), "junctions")
    pieces, _ = T.build(features, j.select("feature", "along", "x", "y"))
    turns = j.select(F.struct("owner", "feature").alias("id"), F.array("owner", "feature").alias("features")).distinct()
    r = T.resolve_restrictions(turns, pieces)
    return r.select("id.owner", "id.feature", F.get("parts", F.lit(0)).alias("from_part"), F.get("parts", F.lit(1)).alias("to_part"))
