"""A deterministic road network over the ``orders`` and ``customer`` tables.

Customers are the nodes of a lattice; every fifth order gives a road between neighbours, some
one-way, some closed to heavy traffic, some without a known speed. Lengths and times are integers
(millimetres, milliseconds), so sums do not depend on their order."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Network:
    """One snapshot: nodes, links, and the permitted directed traversals of links."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def size(self) -> int:
        return self.table("customer").count()

    @cached_property
    def width(self) -> int:
        return math.ceil(math.sqrt(self.size))

    @cached_property
    def links(self) -> DataFrame:
        w, n = self.width, self.size
        k, across = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
        o = self.table("orders").where("o_orderkey % 5 = 0")
        o = o.where(F.when(across, (k % w < w - 1) & (k + 1 < n)).otherwise(k + w < n))
        o = o.select(
            k.alias("source"),
            (k + F.when(across, 1).otherwise(w)).alias("target"),
            across.alias("across"),
            F.struct("o_orderkey", F.expr("100000 + cast(floor(o_totalprice * 100 + 0.5) as bigint) % 400000").alias("length_mm"), "o_orderstatus", "o_orderpriority").alias("o"),
        )
        # several orders may pave one road: the first counts
        o = o.groupBy("source", "target", "across").agg(F.min("o").alias("o"))
        i = F.col("link_id")
        o = o.select(F.col("o.o_orderkey").alias("link_id"), "source", "target", "across", "o.length_mm", "o.o_orderstatus", "o.o_orderpriority")
        line = F.when(F.col("across"), F.floor(F.col("source") / w)).otherwise(F.col("source") % w)
        along = F.when(F.col("across"), F.col("source") % w).otherwise(F.floor(F.col("source") / w))
        return o.select(
            "link_id",
            "source",
            "target",
            "length_mm",
            ((F.col("o_orderstatus") == "F") & (i % 3 == 0)).alias("oneway"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise((2 + F.floor(i / 5) % 5).cast("int")).alias("rca_code"),
            (i % 17 != 0).alias("mode_car"),
            (i % 11 != 0).alias("mode_heavy"),
            F.when(i % 13 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, (40, 50, 80, 100))), (F.floor(i / 5) % 4 + 1).cast("int"))).alias("speed_kph"),
            F.when(i % 7 != 0, F.concat(F.when(F.col("across"), F.lit("Row ")).otherwise(F.lit("Column ")), line.cast("string"))).alias("road_name"),
            F.concat_ws("-", F.when(F.col("across"), F.lit("r")).otherwise(F.lit("c")), line.cast("string"), F.floor(along / 4).cast("string")).alias("closure_group_id"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        both = self.links.select(F.col("source").alias("node_id")).union(self.links.select("target")).distinct()
        return both.select("node_id", (F.col("node_id") % self.width * 100).alias("x"), (F.floor(F.col("node_id") / self.width) * 100).alias("y"))

    @cached_property
    def arcs(self) -> DataFrame:
        """Forward arcs have even ids, backward ones odd ids; one-way links have no backward arc."""
        one = lambda back, s, t: F.struct((F.col("link_id") * 2 + back).alias("arc_id"), F.col(s).alias("source"), F.col(t).alias("target"))
        ways = F.when(F.col("oneway"), F.array(one(0, "source", "target"))).otherwise(F.array(one(0, "source", "target"), one(1, "target", "source")))
        a = self.links.select("link_id", "closure_group_id", F.explode(ways).alias("a"), "length_mm", "speed_kph", "mode_car", "mode_heavy")
        time_ms = F.floor(F.col("length_mm") * 36 / (F.col("speed_kph") * 10)).cast("long")
        return a.select("a.arc_id", "link_id", "closure_group_id", "a.source", "a.target", F.col("length_mm").alias("cost_mm"), time_ms.alias("cost_ms"), "mode_car", "mode_heavy")

    @cached_property
    def restrictions(self) -> DataFrame:
        """Banned turns: from some links onto the next link of the lattice."""
        a, b = self.links.select("link_id", "target").alias("a"), self.links.select("link_id", "source").alias("b")
        pairs = a.join(b, F.col("a.target") == F.col("b.source")).where("(a.link_id + b.link_id) % 19 = 0")
        return pairs.select(F.col("a.link_id").alias("from_link"), F.col("b.link_id").alias("to_link"))


#: The same recipe in DuckDB SQL.
SQL = """
WITH RECURSIVE cfg AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer),
raw_links AS (
  SELECT o_custkey AS source, o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE w END AS target,
         o_orderkey % 2 = 0 AS across, o_orderkey, o_orderstatus, o_orderpriority,
         100000 + CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 400000 AS length_mm, w
  FROM orders, cfg WHERE o_orderkey % 5 = 0
    AND CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % w < w - 1 AND o_custkey + 1 < n ELSE o_custkey + w < n END
), picked AS (
  SELECT * FROM raw_links QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY o_orderkey) = 1
), links AS (
  SELECT o_orderkey AS link_id, source, target, length_mm, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS oneway,
         CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 + o_orderkey // 5 % 5 END AS INTEGER) AS rca_code,
         o_orderkey % 17 <> 0 AS mode_car, o_orderkey % 11 <> 0 AS mode_heavy,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE ([40, 50, 80, 100])[o_orderkey // 5 % 4 + 1] END AS speed_kph,
         CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN across THEN 'Row ' || (source // w) ELSE 'Column ' || (source % w) END END AS road_name,
         CASE WHEN across THEN 'r-' || (source // w) || '-' || (source % w // 4) ELSE 'c-' || (source % w) || '-' || (source // w // 4) END AS closure_group_id
  FROM picked
), nodes AS (
  SELECT node_id, node_id % w * 100 AS x, node_id // w * 100 AS y
  FROM (SELECT source AS node_id FROM links UNION SELECT target FROM links), cfg
), arcs AS (
  SELECT link_id * 2 + back AS arc_id, link_id, closure_group_id, CASE WHEN back = 0 THEN source ELSE target END AS source,
         CASE WHEN back = 0 THEN target ELSE source END AS target, length_mm AS cost_mm,
         CAST(floor(length_mm * 36 / (speed_kph * 10)) AS BIGINT) AS cost_ms, mode_car, mode_heavy
  FROM links, (VALUES (0), (1)) AS v(back) WHERE back = 0 OR NOT oneway
), restrictions AS (
  SELECT a.link_id AS from_link, b.link_id AS to_link FROM links a JOIN links b ON a.target = b.source WHERE (a.link_id + b.link_id) % 19 = 0
)"""
