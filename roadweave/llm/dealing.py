"""Dealing long posting lists into blocks that one task compares, so that rows grow with members.

First a list's blocks stand in a ring, and each is compared with itself and the next: two rows a
member. That joins families of near copies, whose members need no further look at each other. Then,
in lists longer than the ring's reach, the largest component found in the list is set against the
rest, and the rest against itself: no pair of two components is left out, and a family that the ring
joined costs one row a member for each block of what is not part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lists_of(posted: DataFrame, block: int) -> DataFrame:
    """``posted(list, node)`` -> (list, blocks) of the lists that hold a pair."""
    return posted.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def _place(blocks: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)")


def ring(posted: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of ``posted`` with blocks, side, lo and hi: a task compares all members of one
    (list, lo, hi), where lo = hi."""
    dealt = posted.join(lists, "list").withColumn("side", _place("blocks"))
    where = F.expr("if(blocks <= 2, array(0), array(side, cast(pmod(side - 1, blocks) as int)))")
    return dealt.withColumn("lo", F.explode(where)).withColumn("hi", F.col("lo"))


def still_apart(posted: DataFrame, lists: DataFrame, named: DataFrame, block: int) -> DataFrame:
    """The same for the lists beyond the ring's reach that hold more than one component: where
    lo <> hi a task compares members of different sides only. ``named`` is (node, component)."""
    known = posted.join(lists.where("blocks > 2"), "list").join(named, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")
    parts = known.groupBy("list", "of").agg(F.count("*").alias("n"))
    most = parts.groupBy("list").agg(F.max(F.struct("n", "of")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
    count = lambda n: F.ceil(n / block).cast("int")
    most = most.select("list", F.col("m.of").alias("most"), count(F.col("n") - F.col("m.n")).alias("rest_blocks"), count(F.col("m.n")).alias("most_blocks"))
    big = F.col("of") == F.col("most")
    side = F.when(big, F.col("rest_blocks") + _place("most_blocks")).otherwise(_place("rest_blocks"))
    dealt = known.join(most, "list").withColumn("side", side)
    last = F.when(big, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("most_blocks")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("of", "most", "rest_blocks", "most_blocks", "other")
