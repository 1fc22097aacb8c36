"""Whole investigations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.model import Poi, ProvGraph
from tracegrain.operators.features import discriminant_weights, edge_features, edge_weights
from tracegrain.operators.metrics import edge_confusion, graph_report
from tracegrain.operators.propagation import propagate, propagate_rounds
from tracegrain.operators.ranking import rank_by_type, rank_entries, seeds
from tracegrain.operators.reduction import compress, drop_redundant
from tracegrain.operators.traversal import forward, forward_onehop
from tracegrain.plans.materialize import staged

BASELINE = ("fs", "ft", "fc")


@dataclass
class Finding:
    scored: DataFrame
    seeds: DataFrame
    graph: ProvGraph


def weigh(graph: ProvGraph, poi: Poi, windows: int = 10, compat: bool = False, clustering: bool = False) -> DataFrame:
    rows = edge_features(graph, poi, windows)
    return staged(discriminant_weights(rows) if clustering else edge_weights(rows, compat=compat), "weights")


def score(graph: ProvGraph, poi: Poi, windows: int = 10, compat: bool = False, clustering: bool = False, exact: bool = True) -> DataFrame:
    """Nodes with their impact scores."""
    weighted = weigh(graph, poi, windows, compat, clustering)
    return (propagate if exact else propagate_rounds)(graph, weighted, poi)


def back_analysis(graph: ProvGraph, poi: Poi, windows: int = 10, n: int = 7, transitive: bool = False, **how) -> Finding:
    """Score a backward graph, take the ``n`` best seeds of each type, and go forward from them."""
    scored = score(graph, poi, windows, **how)
    chosen = staged(seeds(rank_by_type(scored), n), "seeds")
    return Finding(scored, chosen, (forward if transitive else forward_onehop)(graph, chosen))


def investigate(graph: ProvGraph, poi: Poi, windows: int = 10, n: int = 7, max_time: float = 10_000, **how) -> Finding:
    """Compress, then ``back_analysis``."""
    small = compress(graph, max_time)
    small = ProvGraph(staged(small.nodes, "nodes"), staged(small.edges, "edges"))
    return back_analysis(small, poi, windows, n, **how)


def resume(graph: ProvGraph, scored: DataFrame, n: int = 7, transitive: bool = False) -> Finding:
    """From stored scores on."""
    chosen = seeds(rank_by_type(scored), n)
    return Finding(scored, chosen, (forward if transitive else forward_onehop)(graph, chosen))


def sweep(graph: ProvGraph, ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, edges, tp, fp, fn) of the one-hop graph of the nodes (node, rank) of rank n or better, for every n.

    Each edge and pair enters at the smallest rank of its source, so one running
    sum over n answers all n at once.
    """
    first = ranks.groupBy(F.col("node").alias("src")).agg(F.min("rank").alias("rank"))
    pairs = truth.select("src", "dst").distinct().withColumn("hit", F.lit(1))
    edges = graph.edges.join(first, "src").join(pairs, ["src", "dst"], "left")
    per = edges.groupBy("rank").agg(F.count(F.lit(1)).alias("e"), F.count("hit").alias("h"), F.count_distinct(F.when(F.col("hit") == 1, F.struct("src", "dst"))).alias("c"))
    total = pairs.agg(F.count(F.lit(1))).first()[0]
    steps = ranks.select("rank").distinct().join(per, "rank", "left")
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # a row a rank
    add = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(upto)
    return steps.select(F.col("rank").alias("n"), add("e").alias("edges"), add("h").alias("tp"), (add("e") - add("h")).alias("fp"), (F.lit(total) - add("c")).alias("fn"))


def baseline_entries(graph: ProvGraph, poi: Poi, max_time: float = 10_000, least: int = 10, clustering: bool = False) -> Finding:
    """Redundant edges, three features, scores, and all entry nodes if they are ``least`` at most, else the better half."""
    small = drop_redundant(graph, max_time)
    small = ProvGraph(small.nodes, staged(small.edges, "edges"))
    rows = edge_features(small, poi, None)
    weighted = staged(discriminant_weights(rows, BASELINE) if clustering else edge_weights(rows, BASELINE), "weights")
    scored = propagate(small, weighted, poi)
    entries = staged(rank_entries(small, scored), "entries")
    n = entries.count()
    chosen = entries.where(F.col("rank") <= (n if n <= least else n // 2))
    return Finding(scored, chosen, forward_onehop(small, chosen))


def baseline_sweep(graph: ProvGraph, scored: DataFrame, truth: DataFrame, most: int = 10_003) -> DataFrame:
    """(n, fn, fp, tp) for the n best entry nodes, up to the first n whose fp reaches half the edges or ``most``."""
    entries = staged(rank_entries(graph, scored), "entries")
    rows = sweep(graph, entries, truth).where(F.col("n") < entries.count())
    stops = (F.col("fp") >= graph.edges.count() / 2) | (F.col("fp") >= most)
    before = F.max(stops.cast("int")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))  # a row an entry
    return rows.withColumn("over", F.coalesce(before, F.lit(0))).where("over = 0").select("n", "fn", "fp", "tp")


def report(finding: Finding, truth: DataFrame) -> DataFrame:
    return graph_report(finding.graph, truth)
