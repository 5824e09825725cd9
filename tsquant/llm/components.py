"""Connected components by alternating large-star and small-star.

Edges only ever move towards smaller ids: the large star of a node hands its larger
neighbours to the smallest id around it, the small star hands the smaller ones. When
a round changes no edge, every node hangs on the smallest id it can reach. The least
neighbour of a node is a partial aggregate, and joining it back is left to the
optimiser, which splits nodes with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tsquant.llm.scratch import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """For edges whose `a` is the larger end, as `large_star` gives them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for every id in the edges (a, b); component is the least id reached.

    Loops and repeated edges change nothing; edges with a null end are left out. No
    edges give no rows. Every half round is a written table under `scratch`; those
    before the last are dropped.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held, before, at = scratch.table(clean, f"{name}-0"), None, 0
    while True:
        at += 1
        seen = Observation()
        step = large_star(held) if at % 2 else small_star(held)
        state = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")
        held = scratch.table(step.observe(seen, F.count(F.lit(1)).alias("n"), state), f"{name}-{at}")
        scratch.drop(f"{name}-{at - 1}")
        if at % 2 == 0:
            now = (seen.get["n"], seen.get["digest"])
            if now == before:
                break
            before = now
    roots = held.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
