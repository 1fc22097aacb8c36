"""Filters on graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.model import EDGE_KEY, ProvGraph

# Path prefixes of system files.
SYSTEM_PREFIXES = ("/dev", "/proc", "/mnt", "/usr", "/root", "/etc", "/run", "/lib", "/var", "/sys")


def drop_readonly_files(graph: ProvGraph) -> ProvGraph:
    """Without files that nothing points to, in one pass; a self-loop counts as pointing."""
    written = graph.edges.select(F.col("dst").alias("node"))
    return graph.without_nodes(graph.nodes.where("type = 'file'").join(written, "node", "left_anti"))


def drop_system_files(graph: ProvGraph) -> ProvGraph:
    """Without files whose name starts with a system prefix (a plain prefix: /libfoo too)."""
    system = reduce(lambda a, b: a | b, (F.col("node").startswith(p) for p in SYSTEM_PREFIXES))
    return graph.without_nodes(graph.nodes.where((F.col("type") == "file") & system))


def remove_events(graph: ProvGraph, events: DataFrame) -> ProvGraph:
    """Without the given (src, dst, key); nodes stay."""
    return graph.with_edges(graph.edges.join(events.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(graph.edges.columns))


def neighborhood(graph: ProvGraph, nodes: DataFrame) -> ProvGraph:
    """Edges with either end in ``nodes``, each once, and their endpoints."""
    x = nodes.select("node").distinct()
    out = graph.edges.join(x.withColumnRenamed("node", "src"), "src", "left_semi").select(graph.edges.columns)
    into = graph.edges.join(x.withColumnRenamed("node", "dst"), "dst", "left_semi").join(x.withColumnRenamed("node", "src"), "src", "left_anti").select(graph.edges.columns)
    return graph.edge_subgraph(out.unionByName(into))


def single_type_nodes(graph: ProvGraph, nodes: DataFrame, outgoing: bool = True) -> DataFrame:
    """(node, one_type): whether a node has exactly one edge to (or from) each listed neighbour, all of one type.

    Nodes without a listed neighbour are false.
    """
    own, other = ("src", "dst") if outgoing else ("dst", "src")
    listed = nodes.select(F.col("node").alias(other)).distinct()
    per = graph.edges.join(listed, other, "left_semi").groupBy(F.col(own).alias("node"), other).agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("low"), F.max("type").alias("high"))
    one = per.groupBy("node").agg(((F.max("n") == 1) & (F.min("low") == F.max("high"))).alias("one_type"))
    return graph.nodes.select("node").join(one, "node", "left").select("node", F.coalesce("one_type", F.lit(False)).alias("one_type"))


def merge_candidates(graph: ProvGraph) -> DataFrame:
    """Nodes without predecessors, without successors, or with one neighbour that is both; isolated nodes are left out."""
    pairs = graph.edges.select("src", "dst").distinct()
    into = pairs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("one_in"))
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("one_out"))
    both = into.join(out, "node", "full_outer")
    return both.where("n_in IS NULL OR n_out IS NULL OR (n_in = 1 AND n_out = 1 AND one_in = one_out)").select("node")
