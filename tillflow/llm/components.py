"""Connected components of an edge table, by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.common import forget, written


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: equal marks, equal edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) undirected edges -> (node, root): the smallest node of each component for every node of an edge.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours (large star, small star); a
    component becomes a star in a number of rounds that grows with the logarithm of its size. A hub is one row on the side that
    holds the minima, so adaptive execution can split its other side. Loops are ignored, no edges give no rows.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")),
                                                              F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        following = written(small.filter("a <> b").distinct(), "edges")
        now = _mark(following)
        forget(edges)
        edges = following
        if now == mark:
            break
        mark = now
    star = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
