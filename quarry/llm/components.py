"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.llm.common import removed, written


def _told(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and digest, which tell whether a round changed them."""
    seen = Observation()
    table = written(edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest")))
    return table, (seen.get["n"], seen.get["digest"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for each node of ``links`` (a, b).

    Each round joins every node's neighbours to their smallest, by aggregates and
    joins over the whole table; its edges are written to the shared folder. Nodes
    without links are not returned. Self-links and repeated links do no harm. Raises
    if ``rounds`` don't suffice.
    """
    edges, before = _told(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        last = edges
        edges, after = _told(small.where("u <> v").distinct())
        removed(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
