"""Connected components of a link table by alternating large-star and small-star rounds, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _minima(edges: DataFrame, name: str) -> DataFrame:
    # Written first: then both sides of the join that follows are plain exchanges, which Spark can split where a node has very many links.
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for each node in links. Links of a node to itself and with null are ignored."""
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_minima(both, "large"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes with smaller neighbours only keep them through their own minimum, so the star's centre is never lost.
        edges = written(large.distinct(), "edges")
        small = edges.join(_minima(edges, "small"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
