"""Connected components by alternating star contractions, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _stars(pairs: DataFrame) -> DataFrame:
    """From rows (node, next): every node's smallest reachable-in-one-step node beside each next.

    The minima are written first, so that the join of a node with very many
    neighbours can be split.
    """
    least = settle(pairs.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least")), "stars-least")
    return pairs.join(least, "node")


def _edges(found: DataFrame) -> DataFrame:
    return found.filter("node > next").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Per linked node: node and root, the smallest node of its component. Roots are not listed.

    links may hold repeated rows, both directions and loops. Each round writes its
    edges, so rounds don't add up and a lost executor costs one round at most.
    """
    both = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("next"))
    edges, seen = settle(_edges(both), "stars"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node, next))").alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select("node", F.col("next").alias("root"))
        seen = state
        around = edges.unionByName(edges.select(F.col("next").alias("node"), F.col("node").alias("next")))
        large = _stars(around).filter("next > node").select(F.col("next").alias("node"), F.col("least").alias("next"))
        large = settle(_edges(large), "stars")
        met = _stars(large)
        small = met.select("node", F.col("least").alias("next")).unionByName(met.select(F.col("next").alias("node"), F.col("least").alias("next")))
        edges = settle(_edges(small), "stars")
