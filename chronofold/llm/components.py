"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import materialize


#: Links that a stored part has: few links make few files and tasks, however many partitions the session has.
PART_LINKS = 250_000


def _lowest(links: DataFrame) -> DataFrame:
    """Per node u of links (u, v): the smallest of u and its neighbours."""
    return links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node that links reach.

    Alternates large-star and small-star steps until the links are stars. A step is an
    aggregation with partial results and an equi-join, so no task holds a component. Null ends
    and links from a node to itself are left out.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links"
    )
    seen, n = None, edges.count()
    while True:
        # Large star: each larger neighbour of u is linked to the smallest around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = _lowest(large)
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u > v").distinct()
        )
        edges = materialize(small.coalesce(max(1, -(-n // PART_LINKS))), "links")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen, n = state, state[0]
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
