"""Connected components of links, by alternating stars on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeeper.session import written

EDGES = "a bigint, b bigint"


def connected(links: DataFrame) -> DataFrame:
    """``id`` and the smallest id it is connected with (``component``), for all ids in links ``a``, ``b``.

    Each round hangs the neighbours of a node below the smallest of them, first the larger ones, then the smaller
    ones (Kiveris et al. 2014); after a few rounds (logarithmic in the longest path) every node hangs below the smallest of
    its component. Minima are taken by aggregation and joined back, so a node with very many links is no single task's work.
    Links to oneself and repeated links do no harm; no links give no rows.
    """
    edges = written(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            # Every edge leads from a node straight to the smallest one.
            tops = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter(F.col("a") != F.col("b")).distinct(), "large_star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lowest.select("a", F.col("m").alias("b")))
        edges = written(
            small.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
        )
