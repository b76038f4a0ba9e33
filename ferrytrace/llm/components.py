"""Connected components of a link table, with joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.session import written


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``component`` (the smallest node of it) for every node in ``links`` (a, b).

    In turns, every node's neighbours are linked to its smallest neighbour: first the larger ones,
    then the smaller ones with itself.  Stars are what stays; long chains shrink by halves.  Each
    round is written to the shared folder, so lost executors cost at most a round.  Neighbours are
    never collected: a node with very many is a sum and a join, which Spark splits.
    """
    both = links.where(F.col("a") != F.col("b"))
    edges = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), label)
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)), label)
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()
