"""Connected components of an undirected edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import discard, materialize


def _star(links: DataFrame) -> DataFrame:
    """(node, low): each node with the smallest node among itself and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared
    folder. A null end drops the edge; loops and repeated edges change nothing;
    no edges, no rows. The joins are plain equi-joins on the node, so a node with
    very many neighbours is split by adaptive skew handling.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, before = materialize(e.distinct(), "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        small = large.join(_star(large), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("x")).select("x.u", "x.v")
        last, e = e, materialize(small.where("u != v").distinct(), "edges")
        discard(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
