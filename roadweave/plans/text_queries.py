"""Scalar functions: naming, keys, hashes, speeds and geometry of single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lattice import Network
from .catalogue import query


@query("""SELECT link_id, CASE WHEN rca_code = 1 THEN 100 WHEN link_id % 10 = 0 THEN 20 WHEN link_id % 7 = 3 THEN 40 WHEN length_mm < 200000 THEN 50 ELSE 80 END AS speed FROM links""")
def fn_assign_speed(net: Network) -> DataFrame:
    """Ordered rules: the first that applies sets the speed."""
    i = F.col("link_id")
    return net.links.select("link_id", F.when(F.col("rca_code") == 1, 100).when(i % 10 == 0, 20).when(i % 7 == 3, 40).when(F.col("length_mm") < 200000, 50).otherwise(80).alias("speed"))


@query("SELECT arc_id, round(cost_mm / 1000.0 / (speed_kph * 1000 / 3600.0), 6) AS cost_time_s FROM arcs JOIN links USING (link_id)")
def fn_time_cost(net: Network) -> DataFrame:
    a = net.arcs.join(net.links.select("link_id", "speed_kph"), "link_id")
    return a.select("arc_id", F.round(F.col("cost_mm") / 1000.0 / (F.col("speed_kph") * 1000 / 3600.0), 6).alias("cost_time_s"))


@query("SELECT arc_id, CAST(CASE WHEN t.x > s.x THEN 90 WHEN t.x < s.x THEN 270 WHEN t.y > s.y THEN 0 ELSE 180 END AS DOUBLE) AS bearing FROM arcs a JOIN nodes s ON s.node_id = a.source JOIN nodes t ON t.node_id = a.target")
def fn_heading(net: Network) -> DataFrame:
    """Bearing clockwise from north."""
    s = net.nodes.select(F.col("node_id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = net.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    bearing = F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(360.0))
    return net.arcs.join(s, "source").join(t, "target").select("arc_id", F.round(bearing, 3).alias("bearing"))


@query("SELECT link_id, 'https://maps.example/link?id=' || link_id || '&name=' || coalesce(replace(road_name, ' ', '+'), '') AS url FROM links")
def fn_permalink(net: Network) -> DataFrame:
    return net.links.select("link_id", F.concat(F.lit("https://maps.example/link?id="), F.col("link_id").cast("string"), F.lit("&name="), F.coalesce(F.replace("road_name", F.lit(" "), F.lit("+")), F.lit(""))).alias("url"))


@query("SELECT arc_id, substr(sha256(arc_id || '|' || source || '|' || target), 1, 32) AS key FROM arcs")
def fn_hash_ids(net: Network) -> DataFrame:
    return net.arcs.select("arc_id", F.substring(F.sha2(F.concat_ws("|", "arc_id", "source", "target"), 256), 1, 32).alias("key"))


@query("SELECT node_id, printf('%.3f,%.3f', CAST(x AS DOUBLE), CAST(y AS DOUBLE)) AS key FROM nodes")
def fn_stable_keys(net: Network) -> DataFrame:
    return net.nodes.select("node_id", F.format_string("%.3f,%.3f", F.col("x").cast("double"), F.col("y").cast("double")).alias("key"))


@query(""", seqs AS (SELECT l_orderkey, list(l_suppkey % 4 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(range(1, len(s)), lambda i: s[i] = 1 AND s[i + 1] = 2)) > 0 AS violates FROM seqs""")
def fn_contains_subsequence(net: Network) -> DataFrame:
    """Whether a banned pair occurs next to each other in a sequence."""
    s = net.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    s = s.select("l_orderkey", F.transform("a", lambda x: x.l_suppkey % 4).alias("s"))
    return s.select("l_orderkey", F.expr("size(s) > 1 AND exists(sequence(0, greatest(size(s) - 2, 0)), i -> slice(s, i + 1, 2) = array(1L, 2L))").alias("violates"))


@query(""", seqs AS (SELECT l_orderkey, list(l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda i: i = 1 OR s[i] <> s[i - 1]), lambda i: s[i]), ',') AS path FROM seqs""")
def fn_dedupe_consecutive(net: Network) -> DataFrame:
    s = net.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("a"))
    s = s.select("l_orderkey", F.transform("a", lambda x: x.l_suppkey % 3).alias("s"))
    return s.select("l_orderkey", F.array_join(F.expr("filter(s, (x, i) -> i = 0 OR s[i - 1] <> x)").cast("array<string>"), ",").alias("path"))


@query("SELECT event_id, CAST(NULL AS VARCHAR) AS missing, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(net: Network) -> DataFrame:
    return net.table("events").select("event_id", F.get_json_object("props", "$.nothing").alias("missing"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT link_id, floor(length_mm / 100.0 + 0.5) / 10 AS metres FROM links")
def fn_round_display(net: Network) -> DataFrame:
    return net.links.select("link_id", (F.floor(F.col("length_mm") / 100.0 + 0.5) / 10).alias("metres"))
