"""Crossings, overrides, naming, sampling and assurance rules over the derived network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lattice import Network
from .catalogue import query

# --- joins -------------------------------------------------------------------------------------
@query("SELECT link_id, i AS place, CASE i WHEN 1 THEN source ELSE target END AS node, CASE i WHEN 1 THEN 0.0 ELSE 1.0 END :: DOUBLE AS fraction FROM links, (VALUES (1), (2)) AS v(i)")
def join_unnest(net: Network) -> DataFrame:
    """Parallel arrays as rows."""
    z = F.arrays_zip(F.array("source", "target").alias("node"), F.array(F.lit(0.0), F.lit(1.0)).alias("fraction"))
    r = net.links.select("link_id", F.posexplode(z).alias("i", "z"))
    return r.select("link_id", (F.col("i") + 1).alias("place"), F.col("z.node").alias("node"), F.col("z.fraction").alias("fraction"))


@query("""SELECT o_orderkey, count(l_orderkey) AS verdicts, CASE WHEN count(l_orderkey) = 0 THEN 'UNREVIEWED' WHEN count(DISTINCT l_returnflag) > 1 THEN 'DISPUTED' ELSE min(l_returnflag) END AS verdict
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def join_verdicts(net: Network) -> DataFrame:
    """Every card keeps its row, however many verdicts it got."""
    v = net.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("kinds"), F.min("l_returnflag").alias("f"))
    o = net.table("orders").select("o_orderkey").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    verdict = F.when(F.col("n").isNull(), "UNREVIEWED").when(F.col("kinds") > 1, "DISPUTED").otherwise(F.col("f"))
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("verdicts"), verdict.alias("verdict"))


# --- windows, order and samples ----------------------------------------------------------------
@query("""SELECT link_id, rca_code, r FROM (SELECT link_id, rca_code, row_number() OVER (PARTITION BY rca_code ORDER BY link_id) AS r, count(*) OVER (PARTITION BY rca_code) AS n FROM links) WHERE r % greatest(n // 40, 1) = 1 % greatest(n // 40, 1) OR r = n""")
def win_systematic_sample(net: Network) -> DataFrame:
    """Every k-th link of an authority, k set so that about forty are taken, and the last one."""
    w = Window.partitionBy("rca_code")
    s = net.links.select("link_id", "rca_code", F.row_number().over(w.orderBy("link_id")).cast("long").alias("r"), F.count("*").over(w).alias("n"))
    step = F.greatest(F.floor(F.col("n") / 40), F.lit(1))
    return s.where((F.col("r") % step == F.lit(1) % step) | (F.col("r") == F.col("n"))).select("link_id", "rca_code", "r")


@query("""SELECT closure_group_id, link_id, CAST(row_number() OVER (PARTITION BY closure_group_id ORDER BY rca_code, road_name IS NULL, coalesce(speed_kph, 0) DESC, round(length_mm / 1000.0, 3), link_id) AS BIGINT) AS place FROM links""")
def sort_span(net: Network) -> DataFrame:
    """Designation, named before unnamed, faster before slower, shorter, id."""
    w = Window.partitionBy("closure_group_id").orderBy("rca_code", F.col("road_name").isNull(), F.desc(F.coalesce("speed_kph", F.lit(0))), "length_mm", "link_id")
    return net.links.select("closure_group_id", "link_id", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT CASE WHEN oneway AND road_name IS NULL THEN 'oneway_unnamed' WHEN rca_code = 1 THEN 'highway' WHEN speed_kph IS NULL THEN 'no_speed' END AS cohort, link_id FROM links WHERE (oneway AND road_name IS NULL) OR rca_code = 1 OR speed_kph IS NULL""")
def sample_cohort(net: Network) -> DataFrame:
    c = F.when(F.col("oneway") & F.col("road_name").isNull(), "oneway_unnamed").when(F.col("rca_code") == 1, "highway").when(F.col("speed_kph").isNull(), "no_speed")
    return net.links.select(c.alias("cohort"), "link_id").where("cohort is not null")


# --- naming ------------------------------------------------------------------------------------
@query(""", n AS (SELECT closure_group_id AS g, road_name, rca_code, link_id, row_number() OVER (PARTITION BY closure_group_id ORDER BY rca_code, link_id) AS r FROM links WHERE road_name IS NOT NULL),
s AS (SELECT closure_group_id AS g FROM links GROUP BY 1)
SELECT s.g AS closure_group_id, (SELECT road_name FROM n WHERE n.g = s.g AND r = 1) AS name, (SELECT count(DISTINCT road_name) FROM n WHERE n.g = s.g) AS candidates,
       CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.g = s.g) THEN 'UNRESOLVED' ELSE 'NAMED' END AS status FROM s""")
def n_select(net: Network) -> DataFrame:
    """The governing name of each source feature, and whether there was one."""
    g = net.links.groupBy("closure_group_id").agg(
        F.min_by("road_name", F.when(F.col("road_name").isNotNull(), F.struct("rca_code", "link_id"))).alias("name"), F.countDistinct("road_name").alias("candidates")
    )
    return g.select("closure_group_id", "name", "candidates", F.when(F.col("name").isNull(), "UNRESOLVED").otherwise("NAMED").alias("status"))


@query(""", a AS (SELECT closure_group_id AS g, min(road_name) AS n1 FROM links WHERE link_id % 2 = 0 GROUP BY 1), b AS (SELECT closure_group_id AS g, min(road_name) AS n2 FROM links WHERE link_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.g, b.g) AS closure_group_id, CASE WHEN n1 IS NULL OR n2 IS NULL THEN 'ONE_SOURCE' WHEN n1 = n2 THEN 'AGREED' ELSE 'CONFLICT' END AS verdict FROM a FULL JOIN b ON a.g = b.g""")
def n_corroborate(net: Network) -> DataFrame:
    """Whether two sources agree on a feature's name."""
    even = F.col("link_id") % 2 == 0
    g = net.links.groupBy("closure_group_id").agg(F.min(F.when(even, F.col("road_name"))).alias("n1"), F.min(F.when(~even, F.col("road_name"))).alias("n2"))
    v = F.when(F.col("n1").isNull() | F.col("n2").isNull(), "ONE_SOURCE").when(F.col("n1") == F.col("n2"), "AGREED").otherwise("CONFLICT")
    return g.select("closure_group_id", v.alias("verdict"))


# --- assurance ---------------------------------------------------------------------------------
@query("""SELECT 'expected' AS measure, count(*) AS n FROM arcs UNION ALL SELECT 'recorded', count(DISTINCT l_orderkey * 2 + l_linenumber - 1) FROM lineitem WHERE l_linenumber <= 2
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def q_reconcile(net: Network) -> DataFrame:
    got = net.table("lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    one = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count("*").alias("n"))
    return one(net.arcs, "expected").union(one(got, "recorded")).union(one(got.where("c > 1"), "duplicates"))


@query("""SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT sha256(string_agg(k, ',' ORDER BY k)) AS h, count(*) AS n FROM (SELECT arc_id || ':' || cost_mm AS k, arc_id % 64 AS bucket FROM arcs) GROUP BY bucket)""")
def s_replay_digest(net: Network) -> DataFrame:
    """A digest of all rows in any order: by bucket first, so that no task gathers the table."""
    k = net.arcs.select(F.concat_ws(":", "arc_id", "cost_mm").alias("k"), (F.col("arc_id") % 64).alias("bucket"))
    b = k.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ","), 256).alias("h"), F.count("*").alias("n"))
    return b.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"), F.sum("n").alias("n"))


@query("""SELECT l.link_id, d.k AS direction, v.scope, a.arc_id FROM links l, (VALUES (0), (1)) AS d(k), (VALUES ('physical'), ('directed')) AS v(scope) JOIN arcs a ON (v.scope = 'physical' AND a.closure_group_id = l.closure_group_id) OR (v.scope = 'directed' AND a.arc_id = l.link_id * 2 + d.k) WHERE d.k = 0 OR NOT l.oneway""")
def v1_scope(net: Network) -> DataFrame:
    """Arcs that closing each direction of each link removes: those of the whole physical road, or
    the one traversal."""
    own = net.arcs.select("link_id", (F.col("arc_id") % 2).cast("int").alias("direction"), "closure_group_id", F.col("arc_id").alias("own"))
    road = own.join(net.arcs.select("closure_group_id", "arc_id"), "closure_group_id").select("link_id", "direction", F.lit("physical").alias("scope"), "arc_id")
    return road.unionByName(own.select("link_id", "direction", F.lit("directed").alias("scope"), F.col("own").alias("arc_id")))
