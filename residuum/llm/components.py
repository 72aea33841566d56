"""Connected components of an edge table, by alternating joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.storage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; root is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014): each step links the
    neighbours of a node to the smallest of them, which halves path lengths and
    keeps the number of edges. A hot node meets its neighbours in aggregates
    with map-side minima and in joins that split, never in one list.
    Null ends and self links are ignored; an empty table gives an empty one.
    """
    links = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        links = cut(large.join(low, "u").select(F.explode(star).alias("e")).select("e.*").where("u != v").distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(links: DataFrame) -> tuple:
    """Number and order-free checksum of the links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
