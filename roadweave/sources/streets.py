"""Raw street features before any topology, derived from the ``part`` and ``supplier`` tables.

Each part is a straight feature across or up; their ends meet, nearly meet or pass by other features,
so that there are junctions to split, near misses and crossings. Suppliers are mapped structures."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import Network


class Streets:
    def __init__(self, net: Network) -> None:
        self.net = net

    @cached_property
    def side(self) -> int:
        return math.ceil(math.sqrt(self.net.table("part").count())) * 60

    @cached_property
    def features(self) -> DataFrame:
        """feature, line and attributes."""
        i, s = F.col("p_partkey"), F.col("p_size")
        even = lambda k: i * k % self.side - i * k % self.side % 2
        shift = F.when(i % 10 == 3, 0.02).when(i % 10 == 7, 1.0).otherwise(0.0)
        across = i % 2 == 0
        x, y = even(7919) + F.when(across, 0.0).otherwise(shift), even(104729) + F.when(across, shift).otherwise(0.0)
        size = 40 + 2 * (i * 31 % 80)
        name = F.when(i % 29 == 0, "Hill Overbridge").when(i % 31 == 0, "Valley Interchange").otherwise(F.concat(F.lit("Street "), i.cast("string")))
        f = self.net.table("part").select(
            i.alias("feature"),
            x.alias("x1"),
            y.alias("y1"),
            (x + F.when(across, size).otherwise(0)).alias("x2"),
            (y + F.when(across, 0).otherwise(size)).alias("y2"),
            F.when(s % 7 == 0, 1).otherwise(2).alias("rca_code"),
            (s % 5 == 0).alias("oneway"),
            (s % 13 == 0).alias("is_ramp"),
            F.when(s % 17 == 0, 2).otherwise(1).alias("asset_type"),
            name.alias("name"),
            (i % 37 == 0).alias("height_limit"),
        )
        return f.withColumn("line", F.array(_point("x1", "y1"), _point("x2", "y2")))

    @cached_property
    def structures(self) -> DataFrame:
        k = F.col("s_suppkey")
        across = k % 2 == 0
        s = self.net.table("supplier").select(k.alias("structure"), (k * 3571 % self.side).cast("double").alias("x1"), (k * 9973 % self.side).cast("double").alias("y1"), across.alias("across"))
        s = s.withColumn("x2", F.col("x1") + F.when(F.col("across"), 30.0).otherwise(0.0)).withColumn("y2", F.col("y1") + F.when(F.col("across"), 0.0).otherwise(30.0))
        return s.withColumn("line", F.array(_point("x1", "y1"), _point("x2", "y2")))


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


#: The same recipe in DuckDB SQL, to follow the network's.
SQL = """, sd AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) * 60 AS side FROM part),
st AS (
  SELECT p_partkey AS feature, p_partkey % 2 = 0 AS across, CAST(x + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE shift END AS DOUBLE) AS x1, CAST(y + CASE WHEN p_partkey % 2 = 0 THEN shift ELSE 0 END AS DOUBLE) AS y1, 40 + 2 * (p_partkey * 31 % 80) AS size,
         CASE WHEN p_size % 7 = 0 THEN 1 ELSE 2 END AS rca_code, p_size % 5 = 0 AS oneway, p_size % 13 = 0 AS is_ramp, CASE WHEN p_size % 17 = 0 THEN 2 ELSE 1 END AS asset_type,
         CASE WHEN p_partkey % 29 = 0 THEN 'Hill Overbridge' WHEN p_partkey % 31 = 0 THEN 'Valley Interchange' ELSE 'Street ' || p_partkey END AS name, p_partkey % 37 = 0 AS height_limit
  FROM (SELECT *, p_partkey * 7919 % side - p_partkey * 7919 % side % 2 AS x, p_partkey * 104729 % side - p_partkey * 104729 % side % 2 AS y, CAST(CASE p_partkey % 10 WHEN 3 THEN 0.02 WHEN 7 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS shift FROM part, sd)
), fs AS (SELECT *, x1 + CASE WHEN across THEN size ELSE 0 END AS x2, y1 + CASE WHEN across THEN 0 ELSE size END AS y2 FROM st),
ss AS (SELECT s_suppkey AS structure, s_suppkey % 2 = 0 AS across, CAST(s_suppkey * 3571 % side AS DOUBLE) AS x1, CAST(s_suppkey * 9973 % side AS DOUBLE) AS y1 FROM supplier, sd)"""
