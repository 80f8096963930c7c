"""Distributed union-find: connected components of links by alternating star contractions, in DataFrame operations only.

Every node's row moves to the smallest neighbour that it knows (large star), then the smaller neighbours meet at their
smallest (small star), until nothing changes. Each step is written to the shared folder, so a lost executor costs one
step. A neighbour's minimum is an aggregate with partial sums and is joined back, so a node with very many links is
never gathered in one task.

Cases. No links: no rows. Repeated links, both directions and self links: same result. Labels: each component's smallest
node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import release, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another node, staged."""
    u, v = F.col(a), F.col(b)
    edges = staged(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = staged(large, "large-star")  # a row for each edge at most; equal ones meet in the small star
        # small star: the neighbours below u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, edges = edges, staged(small, "small-star")
        release(before, large)
        # done when every node has one label: an end of a link its own, the other end that one too
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("c")).union(edges.select("v", "v"))
        found = staged(ends.groupBy("node").agg(F.min("c").alias("component"), F.max("c").alias("other")), "components")
        if found.where("component != other").isEmpty():
            break
        release(found)
    release(edges)
    labels = found.select("node", "component")
    labels.__dict__["_staged_at"] = found.__dict__.pop("_staged_at")
    return labels


def stars(found: DataFrame) -> DataFrame:
    """Links (a, b) of each node of found (node, component) with its component: they connect what the component's links did."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))
