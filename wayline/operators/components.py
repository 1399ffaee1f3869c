"""Connected components of an edge table by alternating large-star and small-star steps.

Edges always point from a node to a smaller one. A large-star step hands every larger neighbour of a node the smallest id the
node knows, a small-star step does the same for the smaller ones, so paths halve and every component ends as a star around its
smallest id, whatever the order of the ids. Each step is a map-side combined minimum per node and one join on the node, which
the runtime may split for a hub; steps are staged to shared storage, so a lost executor re-reads files. The loop ends when a
round changes nothing.
"""

from pyspark.sql import DataFrame, functions as F

from wayline.operators.stage import stage


def _down(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller id; loops and incomplete edges go."""
    return (pairs.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))))


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def stars(edges: DataFrame) -> DataFrame:
    """Every node that is not the smallest of its component, ``a``, with that smallest node, ``b``."""
    edges = stage(_down(edges.select("a", "b")))
    mark = _mark(edges)
    while mark[0]:
        edges = stage(_down(_small(_down(_large(edges)))))
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    return edges


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` -> ``component``, the smallest id reachable over ``a``-``b`` edges."""
    found = stars(edges).select(F.col("a").alias("id"), "b")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("b", "id").alias("component"))
