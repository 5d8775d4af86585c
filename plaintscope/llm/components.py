"""Connected components of an edge table, without a graph on the driver or a node's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plaintscope.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b: bigint); component is the least node of it.

    Alternating star steps: every node's larger neighbours are hung on its least neighbour,
    then every node's smaller ones. All edges end at the least node of their component after
    a number of rounds logarithmic in its diameter. Least neighbours are aggregated map-side;
    the joins by node are inner equi-joins that adaptive execution splits where skewed. Each
    round is checkpointed. Self-edges and repeated edges do no harm; null ends are left out.
    """
    links = _ordered(edges.filter("a IS NOT NULL AND b IS NOT NULL"))
    nodes = stage(links)
    links, before = nodes.filter("a > b"), None
    while True:
        links = stage(_small_star(_large_star(links)))
        state = links.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    every = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(least, every["node"] == least["a"], "left").select("node", F.coalesce("least", "node").alias("component"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    hung = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = _ordered(links).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
