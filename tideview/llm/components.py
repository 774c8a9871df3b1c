"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideview.llm.shared import keep


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), any orderable type, in either order. Result: (node, root) for every linked node
    but the roots' own names too; the root is the smallest node reachable.

    Each round is two aggregations and joins over the links that are left, and its result is stored, so
    that a lost executor costs one round. Nodes never come together in one task: a node's neighbours
    are joined with their minimum, and adaptive execution may split a hot node. No links: no rows.
    ``links`` are counted first, so they should be a kept table; no round has more of them.
    """
    n = links.count()
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", n)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star", n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star", n)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
