"""Outages between two places on roads: snapping, partial closures and what they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import routing as R
from .topology import near_points

RADIUS, CANDIDATES, SAME, CLOSE = 150.0, 8, 3.0, 6.0


def snap(clicks: DataFrame, lines: DataFrame, radius: float = RADIUS, most: int = CANDIDATES) -> DataFrame:
    """``clicks(point, x, y)`` -> the nearest places on lines within the radius, the first ``most``
    by distance and feature: (point, place, feature, offset, fraction, sx, sy, role, ambiguous).
    Places where the chosen one is are equivalent hosts; another that is nearly as near is a
    question to whoever clicked."""
    met = near_points(clicks, lines, radius, 2 * radius)
    met = met.select("point", "feature", F.round("l.distance", 6).alias("offset"), F.round(F.col("l.along") / F.col("n"), 9).alias("fraction"), F.col("l.x").alias("sx"), F.col("l.y").alias("sy"))
    w = Window.partitionBy("point").orderBy("offset", "feature")
    ranked = met.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
    first = ranked.where("place = 1").select("point", F.col("sx").alias("fx"), F.col("sy").alias("fy"), F.col("offset").alias("fo"))
    j = ranked.join(first, "point")
    apart = F.hypot(F.col("sx") - F.col("fx"), F.col("sy") - F.col("fy"))
    role = F.when(F.col("place") == 1, "chosen").when(apart <= SAME, "equivalent").otherwise("alternative")
    j = j.withColumn("role", role)
    rival = (F.col("role") == "alternative") & (F.col("offset") - F.col("fo") <= CLOSE)
    by = j.groupBy("point").agg(F.bool_or(rival).alias("ambiguous"))
    return j.join(by, "point").select("point", "place", "feature", "offset", "fraction", "sx", "sy", "role", "ambiguous")


def nearest(points: DataFrame, lines: DataFrame, k: int, radius: float = RADIUS, rounds: int = 16) -> DataFrame:
    """``points(point, x, y)`` -> (point, feature, distance) of the k nearest lines, however far. The
    radius doubles for points that have fewer within it; what lies within is complete, so a point
    that has k is done. Points keep what there is once the radius spans all lines."""
    from ..plans.scratch import materialise

    box = lines.select(F.explode("line").alias("p")).agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first()
    reach = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None or reach[0] is None:
        return points.select("point", F.lit(0).cast("long").alias("feature"), F.lit(0.0).alias("distance")).where("false")
    span = max(box[2], reach[2]) - min(box[0], reach[0]) + max(box[3], reach[3]) - min(box[1], reach[1]) + 1
    w = Window.partitionBy("point").orderBy("distance", "feature")
    left, found = points, None
    for _ in range(rounds):
        radius = min(radius, span)
        met = near_points(left, lines, radius, 2 * radius).select("point", "feature", F.round("l.distance", 6).alias("distance"))
        got = materialise(met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k), "nearest")
        full = got.where(F.col("r") == k).select("point") if radius < span else got.select("point").distinct()
        part = got.join(full, "point", "left_semi").drop("r")
        found = part if found is None else found.unionByName(part)
        left = materialise(left.join(full, "point", "left_anti"), "nearest-left")
        if radius >= span or left.isEmpty():
            return found
        radius *= 2
    raise RuntimeError(f"nearest: not settled after {rounds} rings")


def split_arcs(arcs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts(link_id, low, high)``: the share of a link that is closed. Arcs of those links become
    pieces (arc_id, piece, low, high, closed, cost_mm, cost_ms) whose shares count from the link's
    start and whose costs are pro rata; a backward arc runs through the same pieces the other way."""
    marks = F.array_sort(F.array_distinct(F.array(F.lit(0.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("low"))), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("high"))), F.lit(1.0))))
    a = arcs.join(cuts, "link_id").withColumn("m", marks)
    a = a.select("arc_id", "low", "high", "cost_mm", "cost_ms", "m", F.explode(F.sequence(F.lit(0), F.size("m") - 2)).alias("k"))
    a = a.select("arc_id", F.col("k").alias("piece"), F.get("m", F.col("k")).alias("f0"), F.get("m", F.col("k") + 1).alias("f1"), "low", "high", "cost_mm", "cost_ms")
    middle, share = (F.col("f0") + F.col("f1")) / 2, F.col("f1") - F.col("f0")
    return a.select("arc_id", "piece", F.col("f0").alias("low"), F.col("f1").alias("high"), ((middle > F.col("low")) & (middle < F.col("high"))).alias("closed"), (share * F.col("cost_mm")).alias("cost_mm"), (share * F.col("cost_ms")).alias("cost_ms"))


def outages(links: DataFrame, arcs: DataFrame, low: float, high: float) -> DataFrame:
    """Each link closed between two shares of its length: the way from one end of the outage to the
    other, both ways, what it adds to the closed length, and one of four headlines.

    An end of an outage has two neighbours, of which one lies behind the closure, so a way leaves by
    the open piece on its side and comes back by the other, where their directions allow it."""
    edges = R.scan_edges(arcs).withColumnRenamed("id", "arc_id").join(arcs.select("arc_id", "link_id"), "arc_id").withColumnRenamed("arc_id", "id")
    open_links = links.where("mode_car and source <> target").select("link_id", "source", "target", "length_mm", "oneway")
    ways = F.array(F.struct(F.lit("a_to_b").alias("direction"), F.col("source").alias("s"), F.col("target").alias("t")), F.struct(F.lit("b_to_a").alias("direction"), F.col("target").alias("s"), F.col("source").alias("t")))
    ask = open_links.withColumn("w", F.explode(ways)).select("link_id", "length_mm", "oneway", "w.direction", F.col("w.s").alias("source"), F.col("w.t").alias("target"), F.col("link_id").alias("banned"))
    got = R.route(ask, edges, "link_id")
    # from A back to the start and from the end back to B runs against the road's direction
    allowed = (F.col("direction") == "b_to_a") | ~F.col("oneway")
    ok = (F.col("status") == R.OK) & allowed
    closed = (high - low) * F.col("length_mm")
    way = F.when(ok, F.col("cost") + (low + 1 - high) * F.col("length_mm"))
    m = got.select("link_id", "direction", F.when(ok, R.OK).when(F.col("status") == R.TIMEOUT, R.TIMEOUT).otherwise(R.DISCONNECTED).alias("status"), F.round(way, 3).alias("replacement_mm"), F.round(way - closed, 3).alias("added_mm"), F.round(way / closed, 3).alias("ratio"))
    routed, unresolved = F.count_if(F.col("status") == R.OK), F.count_if(F.col("status") == R.TIMEOUT)
    line = F.when(unresolved == 2, "Analysis unresolved").when(routed == 0, "No replacement route in the represented network").when(routed < 2, "Replacement route found in one direction only").otherwise("Replacement route found")
    return m.join(m.groupBy("link_id").agg(line.alias("headline")), "link_id")
