"""Ranking of nodes and choice of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.model import ProvGraph

TYPES = ("file", "socket", "process")


def rank_by_type(scored: DataFrame) -> DataFrame:
    """(node, type, score, rank) of files, sockets and processes: best score first, then node order."""
    at = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "node_ord"))
    return scored.where(F.col("type").isin(*TYPES)).select("node", "type", "score", at.alias("rank"))


def seeds(ranked: DataFrame, n: int = 7) -> DataFrame:
    """The ``n`` best of each type with ``position``: file, socket, process of rank 1, then of rank 2, and so on."""
    place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    few = ranked.where(F.col("rank") <= n)
    return few.withColumn("position", F.row_number().over(Window.orderBy("rank", place)))  # 3 n rows at most


def entry_nodes(graph: ProvGraph) -> DataFrame:
    """Nodes whose first edge in time leaves them and is not a self-loop."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("src") != F.col("dst")).alias("leaves")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("leaves")))).alias("e"), "start_time", "edge_ord")
    # a self-loop gives two rows of one order, both false
    first = ends.groupBy("e.node").agg(F.min_by("e.leaves", F.struct("start_time", "edge_ord")).alias("leaves"))
    return first.where("leaves").select("node")


def _by_score(found: DataFrame) -> DataFrame:
    """(node, score, rank): best score first, then name; ranges are sorted side by side."""
    from tracegrain.operators.features import ranked

    rows = found.select("node", "score", (-F.col("score")).alias("down"))
    return ranked(rows, ["down", "node"], "rank").select("node", "score", (F.col("rank") + 1).cast("int").alias("rank"))


def rank_entries(graph: ProvGraph, scored: DataFrame) -> DataFrame:
    """Entry nodes with score and rank: best score first, then name."""
    return _by_score(scored.join(entry_nodes(graph), "node", "left_semi"))


def root_entries(graph: ProvGraph, scored: DataFrame) -> DataFrame:
    """Nodes that only they themselves point to, if any, with score and rank."""
    into = graph.edges.where("src <> dst").select(F.col("dst").alias("node"))
    return _by_score(scored.join(into, "node", "left_anti"))
