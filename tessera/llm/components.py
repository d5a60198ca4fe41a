"""Connected components of a graph as DataFrames: alternating large-star and small-star steps.

Each step points vertices to the least vertex they see; a minimum per vertex
is a partial aggregation, and the join that follows may be skewed by a hub,
which adaptive execution splits.  The edges are written after every round, so
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

MAX_ROUNDS = 100


def _pairs(edges: DataFrame) -> DataFrame:
    """Both directions of the edges."""
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is the least vertex reachable.

    ``edges`` has ``u`` and ``v`` of one ordered type; NULLs and loops are left out.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seal = _seal(now)
    if seal[0]:
        for _ in range(MAX_ROUNDS):
            now = written(_small_star(_large_star(now)).distinct(), "edges")
            last, seal = seal, _seal(now)
            if seal == last:
                break
        else:
            raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def _seal(edges: DataFrame) -> tuple:
    """Edges' number and an order-free checksum of them."""
    h = F.xxhash64("u", "v")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first())
