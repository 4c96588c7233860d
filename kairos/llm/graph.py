"""Connected components of a list of links, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import materialize

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest chain; beyond this something is wrong


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``links`` (columns ``a``, ``b``, both ways implied).

    Large-star and small-star rounds: each node is tied to the smallest node
    it knows, until every link points straight at a root. Each round reads a
    written table, so lost executors cost one round at most. Groups are only
    ever reduced to a minimum, never collected.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of a node goes to the smallest node around it
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node and its smaller neighbours go to the smallest of them
        large = materialize(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").distinct(), "links")
        # settled: every node has one link, and no root is itself linked on
        open_nodes = new.groupBy("a").count().where("count > 1").select("a").unionByName(
            new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a"))
        links = new
        if open_nodes.isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"links not settled after {MAX_ROUNDS} rounds")
