"""Filters, joins, aggregates, windows, sorting, sampling and set operations over the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lattice import Network
from .catalogue import query


# --- filters -----------------------------------------------------------------------------------
@query("SELECT arc_id, CASE p WHEN 'car' THEN mode_car WHEN 'heavy' THEN mode_heavy WHEN 'emergency' THEN true END AS admitted, CASE WHEN p IN ('car', 'heavy', 'emergency') THEN 'OK' ELSE 'UNSUPPORTED_PROFILE' END AS status, p AS profile FROM arcs, (VALUES ('car'), ('heavy'), ('emergency'), ('bicycle')) AS v(p)")
def filter_profile(net: Network) -> DataFrame:
    p = F.explode(F.array(*map(F.lit, ("car", "heavy", "emergency", "bicycle")))).alias("profile")
    a = net.arcs.select("arc_id", "mode_car", "mode_heavy", p)
    admitted = F.when(F.col("profile") == "car", F.col("mode_car")).when(F.col("profile") == "heavy", F.col("mode_heavy")).when(F.col("profile") == "emergency", True)
    return a.select("arc_id", admitted.alias("admitted"), F.when(F.col("profile").isin("car", "heavy", "emergency"), "OK").otherwise("UNSUPPORTED_PROFILE").alias("status"), "profile")


@query("SELECT o_orderkey AS link_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def filter_source(net: Network) -> DataFrame:
    return net.table("orders").where("o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("link_id"))


@query("SELECT arc_id FROM arcs WHERE link_id NOT IN (SELECT from_link FROM restrictions)")
def filter_excluded(net: Network) -> DataFrame:
    return net.arcs.join(net.restrictions.select(F.col("from_link").alias("link_id")), "link_id", "left_anti").select("arc_id")


_BOX = "SELECT link_id FROM links l JOIN nodes s ON s.node_id = l.source JOIN nodes t ON t.node_id = l.target WHERE least(s.x, t.x) <= 1500 AND greatest(s.x, t.x) >= 500 AND least(s.y, t.y) <= 1500 AND greatest(s.y, t.y) >= 300"


@query(_BOX)
def filter_bbox(net: Network) -> DataFrame:
    s = net.nodes.select(F.col("node_id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = net.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = net.links.join(s, "source").join(t, "target")
    return e.where("least(x1, x2) <= 1500 AND greatest(x1, x2) >= 500 AND least(y1, y2) <= 1500 AND greatest(y1, y2) >= 300").select("link_id")


@query("SELECT link_id, z AS zoom FROM links, (VALUES (6), (9), (12)) AS v(z) WHERE z >= 12 OR rca_code = 1 OR (z >= 9 AND length_mm > 300000)")
def filter_tile_zoom(net: Network) -> DataFrame:
    z = net.links.select("link_id", "rca_code", "length_mm", F.explode(F.array(*map(F.lit, (6, 9, 12)))).alias("zoom"))
    return z.where("zoom >= 12 OR rca_code = 1 OR (zoom >= 9 AND length_mm > 300000)").select("link_id", "zoom")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1996-01-01' AND (o_totalprice > 100000 OR o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1996-01-01')")
def filter_live_name(net: Network) -> DataFrame:
    """Current rows whose time holds a moment; an open end counts as holding."""
    now = F.lit("1996-01-01").cast("timestamp")
    end = F.when(F.col("o_totalprice") <= 100000, F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))
    return net.table("orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") <= now) & F.coalesce(end >= now, F.lit(True))).select("o_orderkey")


# --- joins -------------------------------------------------------------------------------------
@query("SELECT l.link_id, n.c_name AS name FROM links l LEFT JOIN customer n ON n.c_custkey = l.source AND n.c_acctbal > 0")
def join_left_names(net: Network) -> DataFrame:
    n = net.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source"), F.col("c_name").alias("name"))
    return net.links.join(n, "source", "left").select("link_id", "name")


@query("""SELECT arc_id, 'missing' AS kind FROM arcs WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = link_id AND l_linenumber = 1 + arc_id % 2)
UNION ALL SELECT DISTINCT l_orderkey * 2 + l_linenumber - 1, 'extra' FROM lineitem WHERE l_linenumber <= 2 AND NOT EXISTS (SELECT 1 FROM arcs WHERE arc_id = l_orderkey * 2 + l_linenumber - 1)""")
def join_anti_missing(net: Network) -> DataFrame:
    """Expected keys that are not recorded, and recorded ones that nothing expects."""
    got = net.table("lineitem").where("l_linenumber <= 2").select((F.col("l_orderkey") * 2 + F.col("l_linenumber") - 1).alias("arc_id")).distinct()
    want = net.arcs.select("arc_id")
    return want.join(got, "arc_id", "left_anti").select("arc_id", F.lit("missing").alias("kind")).union(got.join(want, "arc_id", "left_anti").select("arc_id", F.lit("extra")))


_COORDS = "SELECT l.link_id, s.x AS x1, s.y AS y1, t.x AS x2, t.y AS y2, (s.x + t.x) / 2 AS mx, (s.y + t.y) / 2 AS my FROM links l JOIN nodes s ON s.node_id = l.source JOIN nodes t ON t.node_id = l.target"


def _coords(net: Network) -> DataFrame:
    s = net.nodes.select(F.col("node_id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = net.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return net.links.join(s, "source").join(t, "target").select("link_id", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))


@query(_COORDS)
def join_coords_nodes(net: Network) -> DataFrame:
    return _coords(net)


@query(", c AS (" + _COORDS + """), urgent AS (SELECT c.* FROM c JOIN links USING (link_id) WHERE rca_code = 1)
SELECT c.link_id, u.link_id AS near_link, round(sqrt((c.mx - u.mx) * (c.mx - u.mx) + (c.my - u.my) * (c.my - u.my)), 3) AS distance
FROM c JOIN urgent u ON u.link_id <> c.link_id AND (c.mx - u.mx) * (c.mx - u.mx) + (c.my - u.my) * (c.my - u.my) <= 62500""")
def join_spatial_dwithin(net: Network) -> DataFrame:
    """Midpoints within 250 units: both sides are dealt to grid cells of that size, one side to the
    cells around it too, so the theta join becomes an equi-join with an exact check."""
    return _within(net)


def _within(net: Network, radius: int = 250) -> DataFrame:
    c = _coords(net)
    cell = lambda v: F.floor(F.col(v) / radius)
    a = c.select("link_id", "mx", "my", cell("mx").alias("cx"), cell("my").alias("cy"))
    u = c.join(net.links.where("rca_code = 1").select("link_id"), "link_id", "left_semi")
    ring = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))")).alias("o")
    u = u.select(F.col("link_id").alias("near_link"), F.col("mx").alias("ux"), F.col("my").alias("uy"), ring)
    u = u.select("near_link", "ux", "uy", (cell("ux") + F.col("o.i")).alias("cx"), (cell("uy") + F.col("o.j")).alias("cy"))
    square = (F.col("mx") - F.col("ux")) ** 2 + (F.col("my") - F.col("uy")) ** 2
    return a.join(u, ["cx", "cy"]).where((F.col("link_id") != F.col("near_link")) & (square <= radius * radius)).select("link_id", "near_link", F.round(F.sqrt(square), 3).alias("distance"))


_NEAREST = ", c AS (" + _COORDS + """), urgent AS (SELECT c.* FROM c JOIN links USING (link_id) WHERE rca_code = 1),
p AS (SELECT c.link_id, u.link_id AS near_link, round(sqrt((c.mx - u.mx) * (c.mx - u.mx) + (c.my - u.my) * (c.my - u.my)), 3) AS distance
FROM c JOIN urgent u ON u.link_id <> c.link_id AND (c.mx - u.mx) * (c.mx - u.mx) + (c.my - u.my) * (c.my - u.my) <= 62500)
SELECT link_id, near_link, distance FROM p QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY distance, near_link) <= """


@query(_NEAREST + "1")
def join_lateral_nearest(net: Network) -> DataFrame:
    near = _within(net).groupBy("link_id").agg(F.min(F.struct("distance", "near_link")).alias("m"))
    return near.select("link_id", "m.near_link", "m.distance")


@query("SELECT closure_group_id, count(*) OVER w AS children, CAST(sum(length_mm) OVER w AS BIGINT) AS group_length, link_id FROM links WINDOW w AS (PARTITION BY closure_group_id)")
def join_group_stats(net: Network) -> DataFrame:
    w = Window.partitionBy("closure_group_id")
    return net.links.select("closure_group_id", F.count("*").over(w).alias("children"), F.sum("length_mm").over(w).alias("group_length"), "link_id")


@query(""", ends AS (SELECT road_name, closure_group_id AS g, source AS node FROM links UNION SELECT road_name, closure_group_id, target FROM links)
SELECT DISTINCT a.g AS closure_group_id, b.road_name AS neighbour FROM ends a JOIN ends b USING (node) WHERE a.g <> b.g AND b.road_name IS NOT NULL""")
def join_neighbour_names(net: Network) -> DataFrame:
    e = net.links.select("road_name", F.col("closure_group_id").alias("g"), F.explode(F.array("source", "target")).alias("node")).distinct()
    b = e.where("road_name is not null").select(F.col("road_name").alias("neighbour"), F.col("g").alias("other"), "node")
    return e.select("g", "node").distinct().join(b, "node").where("g <> other").select(F.col("g").alias("closure_group_id"), "neighbour").distinct()


@query("""SELECT o_orderkey, c_name, n_name, r_name, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def join_attribute_tables(net: Network) -> DataFrame:
    """A fact row with its dimensions and the sorted set of its details' flags."""
    flags = net.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    o = net.table("orders").select("o_orderkey", "o_custkey").join(net.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    o = o.join(net.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(net.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("flags", F.lit("")).alias("flags"))


@query("""SELECT coalesce(a.link_id, b.link_id) AS link_id, a.length_mm AS v1, b.length_mm AS v2, CASE WHEN a.link_id IS NULL THEN 'only_v2' WHEN b.link_id IS NULL THEN 'only_v1' WHEN abs(a.length_mm - b.length_mm) > 50 THEN 'metric' ELSE 'none' END AS difference
FROM (SELECT * FROM links WHERE link_id % 9 <> 0) a FULL JOIN (SELECT link_id, CASE WHEN link_id % 6 = 0 THEN length_mm + 51 ELSE length_mm + 50 END AS length_mm FROM links WHERE link_id % 4 <> 0) b ON a.link_id = b.link_id""")
def join_v1_v2(net: Network) -> DataFrame:
    """Two engines' answers side by side, and how they differ."""
    a = net.links.where("link_id % 9 <> 0").select("link_id", F.col("length_mm").alias("v1"))
    b = net.links.where("link_id % 4 <> 0").select("link_id", F.when(F.col("link_id") % 6 == 0, F.col("length_mm") + 51).otherwise(F.col("length_mm") + 50).alias("v2"))
    kind = F.when(F.col("v1").isNull(), "only_v2").when(F.col("v2").isNull(), "only_v1").when(F.abs(F.col("v1") - F.col("v2")) > 50, "metric").otherwise("none")
    return a.join(b, "link_id", "full").select("link_id", "v1", "v2", kind.alias("difference"))


# --- aggregates --------------------------------------------------------------------------------
@query("""SELECT (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM arcs) AS arcs, (SELECT count(*) FROM nodes) AS nodes, (SELECT CAST(sum(length_mm) AS BIGINT) FROM links) AS length_mm,
(SELECT count(road_name) FROM links) AS named, (SELECT count(*) FROM links WHERE oneway) AS oneway, (SELECT count(*) FROM restrictions) AS restrictions""")
def agg_totals(net: Network) -> DataFrame:
    """One pass for each table; the one-row results meet under a constant."""
    k = F.lit(1).alias("k")
    a = net.links.agg(F.count("*").alias("links"), F.sum("length_mm").alias("length_mm"), F.count("road_name").alias("named"), F.count_if("oneway").alias("oneway")).withColumn("k", k)
    for name, df in (("arcs", net.arcs), ("nodes", net.nodes), ("restrictions", net.restrictions)):
        a = a.join(df.agg(F.count("*").alias(name)).withColumn("k", k), "k")
    return a.drop("k")


@query("SELECT count(DISTINCT closure_group_id) AS groups, count(DISTINCT road_name) AS names, count(DISTINCT rca_code) AS authorities FROM links")
def agg_count_distinct(net: Network) -> DataFrame:
    return net.links.agg(F.countDistinct("closure_group_id").alias("groups"), F.countDistinct("road_name").alias("names"), F.countDistinct("rca_code").alias("authorities"))


_DEGREE = """SELECT n AS node_id, count(*) FILTER (inn) AS in_degree, count(*) FILTER (NOT inn) AS out_degree FROM (SELECT target AS n, true AS inn FROM arcs UNION ALL SELECT source, false FROM arcs) GROUP BY n"""


def _in_out(net: Network) -> DataFrame:
    ends = net.arcs.select(F.explode(F.array(F.struct(F.col("target").alias("n"), F.lit(True).alias("inn")), F.struct(F.col("source").alias("n"), F.lit(False).alias("inn")))).alias("e"))
    return ends.groupBy(F.col("e.n").alias("node_id")).agg(F.count_if("e.inn").alias("in_degree"), F.count_if(~F.col("e.inn")).alias("out_degree"))


@query(_DEGREE)
def agg_filtered(net: Network) -> DataFrame:
    return _in_out(net)


@query("SELECT count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS dear, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS urgent_open, count(*) FILTER (o_totalprice IS NULL) AS no_price, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS unknown FROM orders")
def agg_reconcile_filtered(net: Network) -> DataFrame:
    return net.table("orders").agg(
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).alias("dear"),
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent_open"),
        F.count_if(F.col("o_totalprice").isNull()).alias("no_price"),
        F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")).alias("unknown"),
    )


@query("SELECT closure_group_id, bool_or(oneway) AS any_oneway, min(road_name) AS name, string_agg(CAST(link_id AS VARCHAR), ',' ORDER BY length_mm, link_id) AS ids FROM links GROUP BY closure_group_id")
def agg_bool_or_ordered(net: Network) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("length_mm", "link_id"))), lambda s: s.link_id.cast("string")), ",")
    return net.links.groupBy("closure_group_id").agg(F.bool_or("oneway").alias("any_oneway"), F.min("road_name").alias("name"), ids.alias("ids"))


@query("SELECT closure_group_id, md5(string_agg(md5(link_id || ':' || length_mm), '' ORDER BY md5(link_id || ':' || length_mm))) AS digest FROM links GROUP BY closure_group_id")
def agg_string_digest(net: Network) -> DataFrame:
    """A digest that does not depend on the order of rows."""
    one = F.md5(F.concat_ws(":", "link_id", "length_mm"))
    return net.links.groupBy("closure_group_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(one)), "")).alias("digest"))


@query("""SELECT 'links' AS name, count(*) AS n, CAST(sum(link_id) AS BIGINT) AS ids, CAST(sum(length_mm) AS BIGINT) AS measure FROM links UNION ALL SELECT 'arcs', count(*), CAST(sum(arc_id) AS BIGINT), CAST(sum(cost_mm) AS BIGINT) FROM arcs
UNION ALL SELECT 'nodes', count(*), CAST(sum(node_id) AS BIGINT), CAST(sum(x + y) AS BIGINT) FROM nodes""")
def agg_fingerprint(net: Network) -> DataFrame:
    one = lambda df, name, i, m: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(i).alias("ids"), F.sum(m).alias("measure"))
    return one(net.links, "links", "link_id", "length_mm").union(one(net.arcs, "arcs", "arc_id", "cost_mm")).union(one(net.nodes, "nodes", "node_id", F.col("x") + F.col("y")))


@query("SELECT source, target, count(*) AS n FROM raw_links GROUP BY source, target HAVING count(*) > 1")
def agg_having_dupes(net: Network) -> DataFrame:
    w, n, k, across = net.width, net.size, F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    o = net.table("orders").where("o_orderkey % 5 = 0").where(F.when(across, (k % w < w - 1) & (k + 1 < n)).otherwise(k + w < n))
    return o.groupBy(k.alias("source"), (k + F.when(across, 1).otherwise(w)).alias("target")).agg(F.count("*").alias("n")).where("n > 1")


@query(""", flags AS (SELECT link_id, f FROM links, (VALUES ('ONEWAY'), ('NO_SPEED'), ('UNNAMED'), ('NO_CAR')) AS v(f)
WHERE (f = 'ONEWAY' AND oneway) OR (f = 'NO_SPEED' AND speed_kph IS NULL) OR (f = 'UNNAMED' AND road_name IS NULL) OR (f = 'NO_CAR' AND NOT mode_car))
SELECT f AS flag, count(*) AS n FROM flags GROUP BY f""")
def agg_status_counts(net: Network) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("oneway"), "ONEWAY"), F.when(F.col("speed_kph").isNull(), "NO_SPEED"), F.when(F.col("road_name").isNull(), "UNNAMED"), F.when(~F.col("mode_car"), "NO_CAR")))
    return net.links.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(""", s AS (SELECT rca_code, list(length_mm ORDER BY length_mm) AS l FROM links GROUP BY rca_code)
SELECT rca_code, p, l[least(len(l) - 1, CAST(floor(p * len(l) / 100) AS BIGINT)) + 1] AS value FROM s, (VALUES (50), (95), (99)) AS v(p)""")
def agg_percentile(net: Network) -> DataFrame:
    """Nearest rank with a floored place. Values are counted before they are ranked, so what a
    group holds is its distinct values."""
    by = net.links.groupBy("rca_code", "length_mm").agg(F.count("*").alias("c"))
    w = Window.partitionBy("rca_code").orderBy("length_mm")
    r = by.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("rca_code")))
    r = r.select("rca_code", "length_mm", "upto", "c", "n", F.explode(F.array(*map(F.lit, (50, 95, 99)))).alias("p"))
    at = F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n") / 100))
    return r.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select("rca_code", "p", F.col("length_mm").alias("value"))


# --- windows, order, samples -------------------------------------------------------------------
@query("SELECT link_id, rca_code FROM links QUALIFY row_number() OVER (PARTITION BY rca_code ORDER BY md5(CAST(link_id AS VARCHAR)), link_id) <= 8")
def win_stratified(net: Network) -> DataFrame:
    w = Window.partitionBy("rca_code").orderBy(F.md5(F.col("link_id").cast("string")), "link_id")
    return net.links.withColumn("r", F.row_number().over(w)).where("r <= 8").select("link_id", "rca_code")


@query("SELECT closure_group_id, link_id, CAST(sum(length_mm) OVER (PARTITION BY closure_group_id) AS BIGINT) AS whole FROM links QUALIFY row_number() OVER (PARTITION BY closure_group_id ORDER BY length_mm DESC, link_id) = 1")
def win_group_sum(net: Network) -> DataFrame:
    """The longest link of each feature with the feature's length: one aggregation does both."""
    g = net.links.groupBy("closure_group_id").agg(F.min_by("link_id", F.struct(-F.col("length_mm"), "link_id")).alias("link_id"), F.sum("length_mm").alias("whole"))
    return g.select("closure_group_id", "link_id", "whole")


@query("SELECT source, arc_id, cost_mm FROM arcs QUALIFY row_number() OVER (PARTITION BY source ORDER BY cost_mm, arc_id) = 1")
def win_distinct_on(net: Network) -> DataFrame:
    g = net.arcs.groupBy("source").agg(F.min(F.struct("cost_mm", "arc_id")).alias("m"))
    return g.select("source", "m.arc_id", "m.cost_mm")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def win_candidate_rank(net: Network) -> DataFrame:
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return net.table("lineitem").withColumn("r", F.row_number().over(w).cast("long")).where("r <= 2").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "r")


@query("SELECT node_id, in_degree * out_degree AS movements FROM (" + _DEGREE + ") ORDER BY movements DESC, node_id LIMIT 5")
def topk_degree(net: Network) -> DataFrame:
    return _in_out(net).select("node_id", (F.col("in_degree") * F.col("out_degree")).alias("movements")).orderBy(F.desc("movements"), "node_id").limit(5)


@query("SELECT source AS node_id, 'source' AS side FROM links UNION ALL SELECT target, 'target' FROM links")
def set_union_all(net: Network) -> DataFrame:
    return net.links.select(F.col("source").alias("node_id"), F.lit("source").alias("side")).unionByName(net.links.select(F.col("target").alias("node_id"), F.lit("target").alias("side")))


@query("SELECT closure_group_id, source AS node_id FROM links UNION SELECT closure_group_id, target FROM links")
def set_union_distinct(net: Network) -> DataFrame:
    return net.links.select("closure_group_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()


@query("SELECT from_link, to_link, from_link IN (SELECT link_id FROM links WHERE mode_heavy) AND to_link IN (SELECT link_id FROM links WHERE mode_heavy) AS contained FROM restrictions")
def set_contained_by(net: Network) -> DataFrame:
    """Link sequences that lie wholly in a set of links."""
    inside = net.links.where("mode_heavy").select("link_id", F.lit(True).alias("ok"))
    seq = net.restrictions.select("from_link", "to_link", F.explode(F.array("from_link", "to_link")).alias("link_id"))
    return seq.join(inside, "link_id", "left").groupBy("from_link", "to_link").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("contained"))


@query("SELECT node_id FROM nodes EXCEPT SELECT source FROM arcs WHERE mode_heavy")
def set_difference(net: Network) -> DataFrame:
    return net.nodes.select("node_id").join(net.arcs.where("mode_heavy").select(F.col("source").alias("node_id")), "node_id", "left_anti")


@query("""SELECT a.from_link, a.to_link, l.target AS shared FROM restrictions a JOIN links l ON l.link_id = a.from_link JOIN links m ON m.link_id = a.to_link WHERE l.target IN (m.source, m.target)""")
def set_intersection(net: Network) -> DataFrame:
    """Nodes that two links have in common."""
    ends = net.links.select("link_id", F.array("source", "target").alias("e"))
    a = net.restrictions.join(ends.select(F.col("link_id").alias("from_link"), F.col("e").alias("e1")), "from_link").join(ends.select(F.col("link_id").alias("to_link"), F.col("e").alias("e2")), "to_link")
    return a.select("from_link", "to_link", F.explode(F.array_intersect("e1", "e2")).alias("shared"))


# --- assurance ---------------------------------------------------------------------------------
