"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.session import durable


def _contract(edges: DataFrame, outward: bool) -> DataFrame:
    """One star step on (u, v) rows with ``u > v``.

    Every node is linked to the smallest node of its neighbourhood. ``outward`` keeps the links of
    larger neighbours, otherwise the links of the node itself and its smaller neighbours. The
    minimum is a plain aggregate joined back, so a node with very many neighbours is combined
    before the shuffle and its edges can be split over tasks.
    """
    if outward:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(low, "u")
    if outward:
        links = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        links = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for all nodes of ``edges``; component is the smallest node in it.

    Each round is written to the checkpoint folder, which keeps the plan short and survives lost
    executors. The loop ends when a round changes nothing.
    """
    links = durable(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    current = links.where("u <> v")
    nodes = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node")))
    state = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")
        ).first()
        if state is not None and tuple(mark) == state:
            break
        state = tuple(mark)
        current = durable(_contract(_contract(current, outward=True), outward=False))
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (
        nodes.distinct()
        .join(roots, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )


def with_singletons(nodes: DataFrame, components: DataFrame, node: str) -> DataFrame:
    """Components of all ``nodes``, with nodes outside every edge as their own component."""
    found = components.select(F.col("node").alias(node), "component")
    return nodes.join(found, node, "left").withColumn("component", F.coalesce("component", node))
