"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf

FEW = 100_000  # edges, about 2 MB, that one task takes faster than they are dealt out


def connected(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the least node that it is connected with.

    Alternating large-star and small-star steps: each step replaces edges, never adds any, and the number of steps grows with
    the logarithm of the longest path. Every step is written to the shelf, so a lost executor costs one step. The steps end when
    the edges' count and sum of hashes stay the same. Of few edges each step is one task without an exchange.
    """
    turn, before, few = 0, None, False

    def kept(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    edges = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        turn, before, few = turn + 1, now, now[0] <= FEW  # their number never grows
        edges = kept(edges)
        both = kept(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours greater than the node go to the node's least neighbour
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours, and the node itself, go to the least of them
        large = kept(shelf.put(large, f"large{turn}"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = shelf.put(small, f"edges{turn}")
        shelf.drop(f"edges{turn - 1}", f"large{turn}")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
