"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces a node's neighbours' links by links to the least node among them; minima are
grouped aggregates with partial sums and come back by a join that adaptive execution can split, so
that a node with very many neighbours needs no task of its own. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _starred(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all v of the same u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    s = _starred(edges)
    return s.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(s.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, source: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs, no nulls -> (node, component): the least node each node is linked with.

    Nodes that are their own component's least are left out. Self-links are ignored. source: see written().
    """
    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), source)
    mark = None
    for _ in range(most_rounds):
        e = written(_small_star(_large_star(e)), source)
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(new)
    raise RuntimeError("components did not settle")
