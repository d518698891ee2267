"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corymb.llm.shared import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows.

    The least neighbours are partial sums where the edges lie, and are written before they are joined:
    so both sides of the join come from a plain shuffle, and the edges of a hub can be split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", few=True)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), "least", few=True)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b: long) that isn't its component's least node.

    Self-loops and repeats are ignored.  Each round shuffles edges only, and is written to the shared
    folder; the number of rounds follows the logarithm of the longest path.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        now = materialise(_small(materialise(_large(now), "edges")), "edges")
        was, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == sign:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
