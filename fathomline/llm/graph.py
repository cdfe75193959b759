"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import discard, durable, shuffled


def settled(pairs: DataFrame) -> bool:
    """Whether the distinct ``pairs`` (a, b) are stars: no a hangs below two nodes, or has one below itself."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(pairs.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return nodes.where("above > 1 or above = 1 and below = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from every node of ``edges`` (u, v: long).

    Alternates two steps that hang nodes below smaller ones (large star, small star)
    until stars are left; the rounds needed grow with the logarithm of the longest
    path, and edges that are stars already need none. Every round is written to the
    shared folder, and the one before removed; nothing of it passes through the driver.
    Loops, repeated edges and nulls are dropped; a node without an edge isn't returned.
    """
    pairs = durable(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if settled(pairs):
            break
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large, "large-star")  # a row for each of the pairs; repeated ones go with the small star's
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, pairs = pairs, durable(small.distinct(), "small-star")
        discard(old)
        discard(large)
    else:
        raise RuntimeError("the components didn't settle")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
