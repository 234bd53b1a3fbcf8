"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Scratch


SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m, the least b of each a. A node with very many edges is dealt over SALTS tasks.

    The least are found per node and salt, then per node, and go back to the salts that the node has.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return dealt.join(least.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return told.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node tells itself and its smaller neighbours the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known = _with_least(down)
    lower = known.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(known.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a larger than b) is the larger end of one edge only, or of none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").count()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Loops and null ends are left out. The number of rounds grows with the logarithm of the longest
    path; rounds go on until the edges are stars, which need none. Only a count of the nodes that
    aren't done reaches the driver. A round's table is deleted when the next is written.
    """
    last = Scratch(edges.sparkSession, name)
    edges = last.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "edges")
    while not _is_stars(edges):
        round_ = Scratch(edges.sparkSession, name)
        edges = round_.put(_small_star(_large_star(edges)), "edges")
        last.drop()
        last = round_
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
