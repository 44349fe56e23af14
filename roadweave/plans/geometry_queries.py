"""Planar geometry over the links' lines. Each line bends at its middle, off to one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.lattice import Network
from .catalogue import query

_LINES = """, g AS (
  SELECT l.link_id, s.x * 1.0 AS x1, s.y * 1.0 AS y1, (s.x + t.x) / 2.0 + CASE WHEN s.x = t.x THEN l.link_id % 20 ELSE 0 END AS xm,
         (s.y + t.y) / 2.0 + CASE WHEN s.x = t.x THEN 0 ELSE l.link_id % 20 END AS ym, t.x * 1.0 AS x2, t.y * 1.0 AS y2
  FROM links l JOIN nodes s ON s.node_id = l.source JOIN nodes t ON t.node_id = l.target
), h AS (SELECT *, sqrt((xm - x1) * (xm - x1) + (ym - y1) * (ym - y1)) AS d1, sqrt((x2 - xm) * (x2 - xm) + (y2 - ym) * (y2 - ym)) AS d2 FROM g)"""


def lines(net: Network) -> DataFrame:
    s = net.nodes.select(F.col("node_id").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    t = net.nodes.select(F.col("node_id").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    up = F.col("x1") == F.col("x2")
    off = F.col("link_id") % 20
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    middle = point((F.col("x1") + F.col("x2")) / 2 + F.when(up, off).otherwise(0), (F.col("y1") + F.col("y2")) / 2 + F.when(up, 0).otherwise(off))
    return net.links.join(s, "source").join(t, "target").select("link_id", "length_mm", F.array(point(F.col("x1"), F.col("y1")), middle, point(F.col("x2"), F.col("y2"))).alias("line"))


@query(_LINES + "\nSELECT link_id, round(d1 + d2, 6) AS length FROM h")
def geo_length(net: Network) -> DataFrame:
    return lines(net).select("link_id", F.round(G.length(F.col("line")), 6).alias("length"))


@query(_LINES + "\nSELECT link_id, CAST(CASE WHEN x2 > x1 THEN 90 ELSE 0 END AS DOUBLE) AS azimuth FROM h")
def geo_azimuth(net: Network) -> DataFrame:
    return lines(net).select("link_id", G.azimuth(F.col("line")).alias("azimuth"))


@query(_LINES + """
SELECT link_id, f AS fraction, round(CASE WHEN f * (d1 + d2) <= d1 THEN x1 + (xm - x1) * f * (d1 + d2) / d1 ELSE xm + (x2 - xm) * (f * (d1 + d2) - d1) / d2 END, 6) AS x,
       round(CASE WHEN f * (d1 + d2) <= d1 THEN y1 + (ym - y1) * f * (d1 + d2) / d1 ELSE ym + (y2 - ym) * (f * (d1 + d2) - d1) / d2 END, 6) AS y
FROM h, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.7 AS DOUBLE))) AS v(f)""")
def geo_interpolate(net: Network) -> DataFrame:
    g = lines(net).select("link_id", "line", F.explode(F.array(F.lit(0.1), F.lit(0.7))).alias("fraction"))
    g = g.select("link_id", "fraction", G.interpolate(F.col("line"), F.col("fraction")).alias("p"))
    return g.select("link_id", "fraction", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _clamped(x1: str, y1: str, x2: str, y2: str, d: str) -> str:
    t = f"greatest(0.0, least(1.0, ((px - {x1}) * ({x2} - {x1}) + (py - {y1}) * ({y2} - {y1})) / ({d} * {d})))"
    return f"sqrt((px - {x1} - {t} * ({x2} - {x1})) * (px - {x1} - {t} * ({x2} - {x1})) + (py - {y1} - {t} * ({y2} - {y1})) * (py - {y1} - {t} * ({y2} - {y1})))"


@query(_LINES + ", q AS (SELECT *, xm + 35.0 AS px, ym - 20.0 AS py FROM h)\nSELECT link_id, round(least(" + _clamped("x1", "y1", "xm", "ym", "d1") + ", " + _clamped("xm", "ym", "x2", "y2", "d2") + "), 4) AS distance FROM q")
def geo_distance_point_line(net: Network) -> DataFrame:
    m = F.element_at("line", 2)
    return lines(net).select("link_id", F.round(G.distance_to_point(F.col("line"), m.x + 35.0, m.y - 20.0), 4).alias("distance"))


@query(_LINES + "\nSELECT link_id, least(x1, xm, x2) AS minx, least(y1, ym, y2) AS miny, greatest(x1, xm, x2) AS maxx, greatest(y1, ym, y2) AS maxy FROM h")
def geo_envelope(net: Network) -> DataFrame:
    e = lines(net).select("link_id", G.envelope(F.col("line")).alias("e"))
    return e.select("link_id", *(F.col(f"e.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")))


@query(_LINES + "\nSELECT link_id, CAST(x2 AS DOUBLE) AS x_first, CAST(y2 AS DOUBLE) AS y_first FROM h")
def geo_reverse(net: Network) -> DataFrame:
    p = F.element_at(F.reverse("line"), 1)
    return lines(net).select("link_id", p.x.alias("x_first"), p.y.alias("y_first"))


@query("SELECT link_id, '{\"type\":\"Feature\",\"id\":' || link_id || ',\"properties\":{\"length_mm\":' || length_mm || ',\"oneway\":' || CASE WHEN oneway THEN 'true' ELSE 'false' END || '}}' AS feature FROM links")
def sink_geojson(net: Network) -> DataFrame:
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("link_id").alias("id"), F.struct("length_mm", "oneway").alias("properties")))
    return net.links.select("link_id", f.alias("feature"))


@query("SELECT link_id, closure_group_id, length_mm FROM links")
def src_ndjson_gz(net: Network) -> DataFrame:
    """Written as compressed lines of JSON and read back with a declared schema."""
    from .scratch import scratch_path

    path = scratch_path(net.spark, "ndjson")
    net.links.select("link_id", "closure_group_id", "length_mm").write.json(path, compression="gzip")
    return net.spark.read.schema("link_id long, closure_group_id string, length_mm long").json(path)


@query("SELECT link_id, rca_code, length_mm FROM links WHERE rca_code = 3")
def sink_copy(net: Network) -> DataFrame:
    """Written as a table parted by authority; the filter then reads one part only."""
    from .scratch import scratch_path

    path = scratch_path(net.spark, "links")
    net.links.select("link_id", "rca_code", "length_mm").write.partitionBy("rca_code").parquet(path)
    return net.spark.read.schema("link_id long, length_mm long, rca_code int").parquet(path).where("rca_code = 3").select("link_id", "rca_code", "length_mm")


@query("SELECT link_id, coalesce(road_name, '') AS name, length_mm FROM links")
def sink_csv(net: Network) -> DataFrame:
    from .scratch import scratch_path

    path = scratch_path(net.spark, "csv")
    net.links.select("link_id", F.coalesce("road_name", F.lit("")).alias("name"), "length_mm").write.csv(path, header=True, emptyValue="")
    return net.spark.read.schema("link_id long, name string, length_mm long").csv(path, header=True).select("link_id", F.coalesce("name", F.lit("")).alias("name"), "length_mm")


@query("SELECT event_id, epoch_ms(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id * 86400000 END) AS at FROM events")
def fn_epoch_ms(net: Network) -> DataFrame:
    """Milliseconds to a time; the sentinel that means open becomes null."""
    ms = F.when(F.col("event_id") % 5 == 0, F.lit(-2208988800000)).otherwise(F.col("event_id") * 86400000)
    return net.table("events").select("event_id", F.timestamp_millis(F.nullif(ms, F.lit(-2208988800000))).cast("timestamp_ntz").alias("at"))


@query("""SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN true WHEN 'o' THEN false END AS tri, CAST(regexp_extract(o_orderpriority, '^([0-9])', 1) AS INTEGER) AS level FROM orders""")
def fn_parse(net: Network) -> DataFrame:
    s = F.lower("o_orderstatus")
    return net.table("orders").select("o_orderkey", F.when(s == "f", True).when(s == "o", False).alias("tri"), F.regexp_extract("o_orderpriority", "^([0-9])", 1).cast("int").alias("level"))


@query("SELECT link_id, -1000000000 - row_number() OVER (PARTITION BY closure_group_id ORDER BY link_id) AS virtual_id, closure_group_id FROM links")
def fn_virtual_ids(net: Network) -> DataFrame:
    """Ids of a reserved negative band, dense within a request."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("closure_group_id").orderBy("link_id"))
    return net.links.select("link_id", (F.lit(-1000000000) - r).cast("long").alias("virtual_id"), "closure_group_id")


@query("SELECT rca_code, link_id FROM links QUALIFY (row_number() OVER (PARTITION BY rca_code ORDER BY link_id) - 1) % 10 = 0")
def sample_stride(net: Network) -> DataFrame:
    """Every tenth link of each authority."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("rca_code").orderBy("link_id"))
    return net.links.withColumn("r", r - 1).where("r % 10 = 0").select("rca_code", "link_id")


@query("""SELECT link_id, rca_code FROM (SELECT link_id, rca_code, row_number() OVER (PARTITION BY rca_code ORDER BY md5(CAST(link_id AS VARCHAR))) AS r, md5(CAST(link_id AS VARCHAR)) AS m FROM links) ORDER BY r, m LIMIT 50""")
def sample_stratified(net: Network) -> DataFrame:
    """Fifty links, one authority after the other, by the hash of their ids."""
    from pyspark.sql import Window

    m = F.md5(F.col("link_id").cast("string"))
    s = net.links.select("link_id", "rca_code", m.alias("m"))
    # a rank above the limit can't be chosen, so each authority sends at most the limit on
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("rca_code").orderBy("m"))).where("r <= 50")
    return s.orderBy("r", "m").limit(50).select("link_id", "rca_code")
