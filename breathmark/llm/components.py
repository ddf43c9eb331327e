"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges a task, at most: a table of few edges is not spread over as many files as the session has shuffle partitions.
EDGES = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, of every node of ``edges`` (columns ``a``, ``b``).

    Each step ties a node's neighbours to the least of them, first those above it, then those below. Components end
    as stars around their least node. Nothing but two numbers a step comes to the driver; loops and repeated edges
    do no harm; no edges give no rows. What a step writes is in as many parts as its edges need, counted after the
    step before, and never in more than the session's shuffle partitions.
    """
    now = durable(_tidy(edges.select("a", "b")))
    seen = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == seen or not found[0]:
            break
        seen = tuple(found)
        parts = 1 + found[0] // EDGES
        now = now.coalesce(parts)
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        least = least.select("n", F.least("n", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _tidy(large).coalesce(parts)
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(_tidy(small.union(least)).coalesce(parts))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
