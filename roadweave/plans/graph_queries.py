"""Routing, connectivity and closures over the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import connectivity as C
from ..operators import routing as R
from ..sources.lattice import Network
from .catalogue import query
from .scratch import materialise

#: Arcs for cars, the turns between them that are not banned, and the cheapest legal way of each
#: request: a row for each last arc, and one (upto = -1) for the target, which bounds the search.
LEGAL = """, e AS (SELECT arc_id, link_id, source, target, cost_mm AS cost, closure_group_id AS g FROM arcs WHERE mode_car),
turns AS (
  SELECT a.arc_id AS f, b.arc_id AS t, b.target AS node, b.cost, b.g FROM e a JOIN e b ON b.source = a.target AND b.link_id <> a.link_id
  WHERE NOT EXISTS (SELECT 1 FROM restrictions x WHERE x.from_link = a.link_id AND x.to_link = b.link_id)
), req AS (%s),
d(req, closed, upto, cost) USING KEY (req, closed, upto) AS (
  SELECT r.req, r.closed, z.upto, min(x.cost) FROM req r JOIN e x ON x.source = r.source AND (NOT r.closed OR x.g <> r.g),
    LATERAL (SELECT unnest([x.arc_id, CASE WHEN x.target = r.target THEN -1 END]) AS upto) z WHERE z.upto IS NOT NULL GROUP BY ALL
  UNION
  SELECT n.req, n.closed, n.upto, n.cost FROM (
    SELECT d.req, d.closed, z.upto, min(d.cost + u.cost) AS cost
    FROM d JOIN req r ON r.req = d.req AND r.closed = d.closed JOIN turns u ON u.f = d.upto AND (NOT d.closed OR u.g <> r.g),
      LATERAL (SELECT unnest([u.t, CASE WHEN u.node = r.target THEN -1 END]) AS upto) z WHERE z.upto IS NOT NULL GROUP BY d.req, d.closed, z.upto
  ) n LEFT JOIN recurring.d k ON k.req = n.req AND k.closed = n.closed AND k.upto = n.upto
      LEFT JOIN recurring.d b ON b.req = n.req AND b.closed = n.closed AND b.upto = -1
  WHERE (k.cost IS NULL OR n.cost < k.cost) AND (b.cost IS NULL OR n.cost < b.cost)
), best AS (SELECT req, closed, cost FROM d WHERE upto = -1)"""

_DETOURS = LEGAL % "SELECT arc_id AS req, closed, source, target, g FROM e, (VALUES (true), (false)) AS v(closed)" + """, detours AS (
SELECT o.link_id, CAST(o.arc_id % 2 AS INTEGER) AS direction, o.cost AS length, i.cost AS normal, a.cost AS alternative,
       a.cost - o.cost AS added, a.cost - i.cost AS penalty, round(a.cost / o.cost, 3) AS ratio,
       CASE WHEN a.cost IS NULL THEN 'DISCONNECTED' ELSE 'OK' END AS status
FROM e o LEFT JOIN best i ON i.req = o.arc_id AND NOT i.closed LEFT JOIN best a ON a.req = o.arc_id AND a.closed)"""


@query(_DETOURS + "\nSELECT * FROM detours")
def v1_detour(net: Network) -> DataFrame:
    """Closing the physical road of each link: all links of its closure group, with banned turns."""
    return R.detours(net.links, net.arcs, restrictions=net.restrictions, scope="physical").drop("turn_aware")


@query("SELECT arc_id AS id, source, target, cost_ms AS cost, CAST(-1 AS BIGINT) AS reverse_cost FROM arcs WHERE mode_heavy AND cost_ms IS NOT NULL AND link_id NOT IN (SELECT link_id FROM links WHERE rca_code = 1)")
def scan_edges(net: Network) -> DataFrame:
    urgent = net.arcs.join(net.links.where("rca_code = 1").select("link_id"), "link_id", "left_semi")
    return R.scan_edges(net.arcs, "heavy", "time", urgent)


@query("SELECT arc_id, a.source, a.target, cost_mm, s.x AS x1, s.y AS y1, t.x AS x2, t.y AS y2 FROM arcs a JOIN nodes s ON s.node_id = a.source JOIN nodes t ON t.node_id = a.target")
def scan_astar_edges(net: Network) -> DataFrame:
    s = net.nodes.select(F.col("node_id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = net.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return net.arcs.select("arc_id", "source", "target", "cost_mm").join(s, "source").join(t, "target")


@query("SELECT arc_id, link_id, source, target, cost_mm FROM arcs")
def topo_make_arcs(net: Network) -> DataFrame:
    return net.arcs.select("arc_id", "link_id", "source", "target", "cost_mm")


_TRANSITIONS = """, tr AS (
  SELECT a.arc_id AS from_arc, b.arc_id AS to_arc, a.target AS via_node FROM arcs a JOIN arcs b ON b.source = a.target
  WHERE b.link_id <> a.link_id AND NOT EXISTS (SELECT 1 FROM restrictions t WHERE t.from_link = a.link_id AND t.to_link = b.link_id)
)"""


def transitions(net: Network) -> DataFrame:
    """Movements from arc to arc: no turning back on a link, no banned turn."""
    a = net.arcs.select(F.col("arc_id").alias("from_arc"), F.col("target").alias("via_node"), F.col("link_id").alias("from_link"))
    b = net.arcs.select(F.col("arc_id").alias("to_arc"), F.col("source").alias("via_node"), F.col("link_id").alias("to_link"))
    pairs = a.join(b, "via_node").where("from_link <> to_link")
    return pairs.join(net.restrictions, ["from_link", "to_link"], "left_anti").select("from_arc", "to_arc", "via_node")


@query(_TRANSITIONS + "\nSELECT row_number() OVER (ORDER BY from_arc, to_arc) - 1 AS transition_id, from_arc, to_arc, via_node FROM tr")
def join_arc_transitions(net: Network) -> DataFrame:
    """Dense ids without a single-task sort: rows are ranged over partitions, numbered within them,
    and offset by what the partitions before hold."""
    t = transitions(net)
    n = t.sparkSession.sparkContext.defaultParallelism
    ranged = materialise(t.repartitionByRange(n, "from_arc", "to_arc").withColumn("part", F.spark_partition_id()), "transitions")
    within = F.row_number().over(Window.partitionBy("part").orderBy("from_arc", "to_arc"))
    # one row for each partition
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = ranged.withColumn("r", within).join(F.broadcast(before), "part")
    return numbered.select((F.col("before") + F.col("r") - 1).alias("transition_id"), "from_arc", "to_arc", "via_node")


@query(_TRANSITIONS + "\nSELECT from_arc, to_arc, t.cost_mm AS cost FROM tr JOIN arcs t ON t.arc_id = to_arc JOIN arcs f ON f.arc_id = from_arc WHERE t.mode_car AND f.mode_car")
def join_transition_costs(net: Network) -> DataFrame:
    car = net.arcs.where("mode_car")
    t = transitions(net).join(car.select(F.col("arc_id").alias("to_arc"), F.col("cost_mm").alias("cost")), "to_arc")
    return t.join(car.select(F.col("arc_id").alias("from_arc")), "from_arc", "left_semi").select("from_arc", "to_arc", "cost")


@query("""SELECT CAST(sum(i * o) AS BIGINT) AS transition_bound, CAST(max(i * o) AS BIGINT) AS worst FROM (
  SELECT n, count(*) FILTER (inn) AS i, count(*) FILTER (NOT inn) AS o FROM (SELECT target AS n, true AS inn FROM arcs UNION ALL SELECT source, false FROM arcs) GROUP BY n)""")
def topo_transition_guard(net: Network) -> DataFrame:
    ends = net.arcs.select(F.col("target").alias("n"), F.lit(1).alias("i")).union(net.arcs.select("source", F.lit(0)))
    by = ends.groupBy("n").agg((F.sum("i") * F.sum(1 - F.col("i"))).alias("p"))
    return by.agg(F.sum("p").alias("transition_bound"), F.max("p").alias("worst"))


_CC = """, und AS (SELECT source AS u, target AS v FROM links UNION SELECT target, source FROM links),
cc(node, c) USING KEY (node) AS (
  SELECT node_id, node_id FROM nodes
  UNION
  SELECT n.node, n.c FROM (SELECT und.v AS node, min(cc.c) AS c FROM cc JOIN und ON und.u = cc.node GROUP BY und.v) n
  JOIN recurring.cc r ON r.node = n.node WHERE n.c < r.c
)"""


@query(_CC + "\nSELECT node AS node_id, c AS component FROM cc")
def g_components(net: Network) -> DataFrame:
    return C.components(net.nodes, net.links)


_ROLLUP = _CC + """, rollup_ AS (
  SELECT c AS component, count(*) AS nodes, CAST(sum(coalesce(l, 0)) AS BIGINT) AS links, CAST(sum(coalesce(len, 0)) AS BIGINT) AS length_mm, CAST(sum(coalesce(hw, 0)) AS BIGINT) AS highway_links
  FROM cc LEFT JOIN (SELECT source, count(*) AS l, sum(length_mm) AS len, count(*) FILTER (rca_code = 1) AS hw FROM links GROUP BY source) x ON x.source = cc.node GROUP BY c
)"""


@query(_ROLLUP + "\nSELECT * FROM rollup_")
def agg_component_rollup(net: Network) -> DataFrame:
    return C.component_rollup(C.components(net.nodes, net.links), net.links)


@query(_ROLLUP + "\nSELECT * FROM rollup_ ORDER BY highway_links DESC, nodes DESC, component LIMIT 1")
def g_principal_component(net: Network) -> DataFrame:
    return C.principal(C.component_rollup(C.components(net.nodes, net.links), net.links))


@query(_ROLLUP + """
SELECT component, nodes, row_number() OVER (ORDER BY nodes DESC, component) AS place, round(nodes / (SELECT sum(nodes) FROM rollup_), 6) AS share FROM rollup_""")
def agg_component_sizes(net: Network) -> DataFrame:
    r = C.component_rollup(C.components(net.nodes, net.links), net.links).select("component", "nodes")
    whole = net.nodes.count()
    # one row for each component, not for each node
    return r.select("component", "nodes", F.row_number().over(Window.orderBy(F.desc("nodes"), "component")).cast("long").alias("place"), F.round(F.col("nodes") / whole, 6).alias("share"))


@query(_CC + "\nSELECT a.arc_id, cs.c = ct.c AS same_component FROM arcs a JOIN cc cs ON cs.node = a.source JOIN cc ct ON ct.node = (a.target + 7) % (SELECT n FROM cfg)")
def g_same_component(net: Network) -> DataFrame:
    label = C.components(net.nodes, net.links)
    s = label.select(F.col("node_id").alias("source"), F.col("component").alias("cs"))
    t = label.select(F.col("node_id").alias("to"), F.col("component").alias("ct"))
    a = net.arcs.select("arc_id", "source", ((F.col("target") + 7) % net.size).alias("to"))
    return a.join(s, "source").join(t, "to").select("arc_id", (F.col("cs") == F.col("ct")).alias("same_component"))


_SIDES = _CC + """, e2 AS (SELECT link_id, source AS a, target AS b FROM links WHERE source <> target UNION ALL SELECT link_id, target, source FROM links WHERE source <> target),
cut(link_id, node) USING KEY (link_id, node) AS (
  SELECT link_id, source FROM links WHERE source <> target
  UNION
  SELECT DISTINCT c.link_id, e2.b FROM cut c JOIN e2 ON e2.a = c.node AND e2.link_id <> c.link_id JOIN links o ON o.link_id = c.link_id
    LEFT JOIN recurring.cut k ON k.link_id = c.link_id AND k.node = e2.b LEFT JOIN recurring.cut t ON t.link_id = c.link_id AND t.node = o.target
  WHERE k.node IS NULL AND t.node IS NULL
), bridge AS (
  SELECT o.link_id, o.source, (SELECT count(*) FROM cut c WHERE c.link_id = o.link_id) AS side FROM links o
  WHERE o.source <> o.target AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.link_id = o.link_id AND c.node = o.target)
), sizes AS (SELECT c, count(*) AS n FROM cc GROUP BY c)"""


@query(_SIDES + "\nSELECT link_id, least(side, n - side) AS smaller_side, n AS component_nodes FROM bridge JOIN cc ON cc.node = bridge.source JOIN sizes USING (c)")
def g_tarjan(net: Network) -> DataFrame:
    """Bridges. The SQL walks from one end of each link without it."""
    return C.bridges(C.components(net.nodes, net.links), net.links)


@query(""", e2 AS (SELECT source AS a, target AS b FROM links WHERE source <> target UNION SELECT target, source FROM links WHERE source <> target),
seen(cut, node) USING KEY (cut, node) AS (
  SELECT a, min(b) FROM e2 GROUP BY a
  UNION
  SELECT DISTINCT s.cut, e2.b FROM seen s JOIN e2 ON e2.a = s.node AND e2.b <> s.cut LEFT JOIN recurring.seen k ON k.cut = s.cut AND k.node = e2.b WHERE k.node IS NULL
)
SELECT DISTINCT e2.a AS node_id FROM e2 LEFT JOIN seen ON seen.cut = e2.a AND seen.node = e2.b WHERE seen.node IS NULL""")
def g_articulation(net: Network) -> DataFrame:
    """Nodes whose removal parts their component."""
    return C.depth_first(C.components(net.nodes, net.links), net.links).where("articulation").select(F.col("id").alias("node_id"))


@query(""", ends AS (SELECT source AS node_id, link_id FROM links UNION ALL SELECT target, link_id FROM links)
SELECT node_id, count(DISTINCT link_id) AS degree FROM ends GROUP BY node_id""")
def k_degree(net: Network) -> DataFrame:
    return C.degrees(net.links)


_PIECES = """, gn AS (SELECT closure_group_id AS g, source AS node FROM links UNION SELECT closure_group_id, target FROM links),
ge AS (SELECT closure_group_id AS g, source AS a, target AS b FROM links UNION SELECT closure_group_id, target, source FROM links),
piece(g, node, p) USING KEY (g, node) AS (
  SELECT g, node, node FROM gn
  UNION
  SELECT n.g, n.node, n.p FROM (SELECT ge.g, ge.b AS node, min(piece.p) AS p FROM piece JOIN ge ON ge.g = piece.g AND ge.a = piece.node GROUP BY ge.g, ge.b) n
  JOIN recurring.piece r ON r.g = n.g AND r.node = n.node WHERE n.p < r.p
)"""


@query(_PIECES + """, ends AS (SELECT closure_group_id AS g, source AS node FROM links UNION ALL SELECT closure_group_id, target FROM links),
inner_ AS (SELECT g, node, count(*) AS d FROM ends GROUP BY g, node),
by_ AS (SELECT g, count(*) AS nodes, max(d) AS most, count(*) FILTER (d = 1) AS tips FROM inner_ GROUP BY g),
ps AS (SELECT g, count(DISTINCT p) AS pieces FROM piece GROUP BY g),
n AS (SELECT closure_group_id AS g, count(*) AS links, CAST(sum(length_mm) AS BIGINT) AS length_mm FROM links GROUP BY 1)
SELECT g AS closure_group_id, links, nodes, pieces, length_mm, CASE WHEN links = 1 THEN 'single_segment' WHEN pieces > 1 THEN 'disjoint' WHEN most > 2 THEN 'branching' WHEN tips = 0 THEN 'cycle' ELSE 'simple_chain' END AS shape
FROM n JOIN by_ USING (g) JOIN ps USING (g)""")
def c_shape(net: Network) -> DataFrame:
    return C.closure_shapes(net.links)


@query(""", cn AS (SELECT closure_group_id AS g, source AS node FROM links UNION SELECT closure_group_id, target FROM links)
SELECT cn.g AS closure_group_id, a.arc_id, CASE WHEN a.target = cn.node THEN 'entry' ELSE 'exit' END AS kind, cn.node AS at_node
FROM cn JOIN arcs a ON (a.target = cn.node OR a.source = cn.node) AND a.closure_group_id <> cn.g""")
def p_ports(net: Network) -> DataFrame:
    """Arcs that cross a closure's boundary: into one of its nodes, or out of one."""
    g = F.col("closure_group_id")
    cn = net.links.select(g.alias("g"), F.col("source").alias("at_node")).union(net.links.select(g, "target")).distinct()
    a = net.arcs.select("arc_id", g.alias("own"), F.explode(F.array(F.struct(F.lit("entry").alias("kind"), F.col("target").alias("at_node")), F.struct(F.lit("exit").alias("kind"), F.col("source").alias("at_node")))).alias("e"))
    a = a.select("arc_id", "own", "e.kind", "e.at_node")
    return cn.join(a, "at_node").where("own <> g").select(F.col("g").alias("closure_group_id"), "arc_id", "kind", "at_node")


@query("""SELECT closure_group_id, count(*) AS links, CAST(sum(length_mm) AS BIGINT) AS length_mm,
  substr(sha256(closure_group_id || '|' || string_agg(CAST(link_id AS VARCHAR), '|' ORDER BY link_id)), 1, 24) AS fingerprint FROM links GROUP BY closure_group_id""")
def c_resolve(net: Network) -> DataFrame:
    """The links of each source feature's closure, with an id that depends on them alone."""
    by = net.links.groupBy("closure_group_id").agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"), F.array_sort(F.collect_list("link_id")).alias("ids"))
    text = F.concat_ws("|", F.col("closure_group_id"), F.array_join(F.col("ids").cast("array<string>"), "|"))
    return by.select("closure_group_id", "links", "length_mm", F.substring(F.sha2(text, 256), 1, 24).alias("fingerprint"))


_DEPOTS = """, depots AS (SELECT n AS source FROM (SELECT n, count(*) FILTER (inn) * count(*) FILTER (NOT inn) AS m FROM (SELECT target AS n, true AS inn FROM arcs UNION ALL SELECT source, false FROM arcs) GROUP BY n) ORDER BY m DESC, n LIMIT 5)"""


def depots(net: Network) -> DataFrame:
    ends = net.arcs.select(F.explode(F.array(F.struct(F.col("target").alias("n"), F.lit(1).alias("i")), F.struct(F.col("source").alias("n"), F.lit(0).alias("i")))).alias("e"))
    by = ends.groupBy(F.col("e.n").alias("source")).agg((F.sum("e.i") * F.sum(1 - F.col("e.i"))).alias("m"))
    return by.orderBy(F.desc("m"), "source").limit(5).select("source")


@query(_DEPOTS + """, d(source, node, cost) USING KEY (source, node) AS (
  SELECT source, source, CAST(0 AS BIGINT) FROM depots
  UNION
  SELECT n.source, n.node, n.cost FROM (SELECT d.source, a.target AS node, min(d.cost + a.cost_mm) AS cost FROM d JOIN arcs a ON a.source = d.node WHERE a.mode_car GROUP BY d.source, a.target) n
  LEFT JOIN recurring.d r ON r.source = n.source AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost
) SELECT source, node, cost FROM d""")
def sp_many_costs(net: Network) -> DataFrame:
    """Costs from the five busiest nodes to all they reach."""
    return R.tree_costs(depots(net), R.scan_edges(net.arcs))


@query(_DEPOTS + _TRANSITIONS + """, first_ AS (SELECT min(arc_id) AS arc, cost_mm AS c FROM arcs JOIN depots USING (source) WHERE mode_car GROUP BY source, cost_mm QUALIFY row_number() OVER (PARTITION BY source ORDER BY min(arc_id)) = 1),
d(source, node, cost) USING KEY (source, node) AS (
  SELECT arc, arc, CAST(0 AS BIGINT) FROM first_
  UNION
  SELECT n.source, n.node, n.cost FROM (SELECT d.source, t.to_arc AS node, min(d.cost + a.cost_mm) AS cost FROM d JOIN tr t ON t.from_arc = d.node JOIN arcs a ON a.arc_id = t.to_arc JOIN arcs f ON f.arc_id = t.from_arc WHERE a.mode_car AND f.mode_car GROUP BY d.source, t.to_arc) n
  LEFT JOIN recurring.d r ON r.source = n.source AND r.node = n.node WHERE r.cost IS NULL OR n.cost < r.cost
) SELECT d.source AS first_arc, d.node AS last_arc, d.cost + first_.c AS cost FROM d JOIN first_ ON first_.arc = d.source""")
def sp_expanded(net: Network) -> DataFrame:
    """Costs over the graph whose nodes are arcs, where banned turns have no edge, from the first
    arc out of each of the five busiest nodes; the first arc's own cost counts."""
    car = net.arcs.where("mode_car")
    first = car.join(depots(net), "source").groupBy("source").agg(F.min(F.struct("arc_id", "cost_mm")).alias("m")).select(F.col("m.arc_id").alias("arc"), F.col("m.cost_mm").alias("c"))
    edges = R.scan_edges(net.arcs).join(net.arcs.select(F.col("arc_id").alias("id"), "link_id"), "id")
    tree = R.turn_costs(first.select("arc"), edges, R.ban_sequences(net.restrictions))
    return tree.join(first, "arc").select(F.col("arc").alias("first_arc"), F.col("last").alias("last_arc"), (F.col("cost") + F.col("c")).alias("cost"))
