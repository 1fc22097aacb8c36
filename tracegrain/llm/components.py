"""Connected components of a graph of ids, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.plans.materialize import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id in ``links(a, b)``; comp is the smallest id reachable.

    Alternates the large-star and small-star steps: every round rewires the
    neighbours of a node to the smallest of them, until the graph is a set of
    stars. Rows per round never exceed the number of links, and the number of
    rounds grows with the logarithm of the longest path. A round's table goes
    when the next is written. Repeated links and self-links change nothing; no
    links give no rows.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = staged(small, "links", instead=(edges,))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = staged(edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct()), "components")
    dropped(edges)
    return found
