"""Time-respecting traversal.

Closures keep one row per node: the best threshold with which it was reached.
Each round joins the edges with the nodes whose threshold has just improved,
so work follows the frontier, and ends when nothing improves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.model import EDGE_KEY, Poi, ProvGraph, poi_row
from tracegrain.plans.materialize import staged


def relax(steps: DataFrame, init: DataFrame, better: str, admissible: Callable[[Column, Column], Column]) -> DataFrame:
    """The fixpoint of thresholds: (node, thr).

    ``steps`` is (from, to, gate, next): a step is taken from a node if
    ``admissible(gate, thr)``, and offers ``next`` to the other end. ``better``
    is "min" or "max".
    """
    pick = F.min if better == "min" else F.max
    improves = (lambda new, old: new < old) if better == "min" else (lambda new, old: new > old)
    state = frontier = staged(init.groupBy("node").agg(pick("thr").alias("thr")), "thresholds")
    while not frontier.isEmpty():
        before = (state, frontier)
        offers = steps.join(frontier.select(F.col("node").alias("from"), "thr"), "from").where(admissible(F.col("gate"), F.col("thr"))).groupBy(F.col("to").alias("node")).agg(pick("next").alias("new"))
        frontier = staged(offers.join(state, "node", "left").where(F.col("thr").isNull() | improves(F.col("new"), F.col("thr"))).select("node", F.col("new").alias("thr")), "frontier")
        state = staged(state.unionByName(frontier).groupBy("node").agg(pick("thr").alias("thr")), "thresholds", instead=before)
    return state


def backward(graph: ProvGraph, poi: Poi, or_equal: bool = False) -> ProvGraph:
    """The edges on which the event of interest can depend: each starts before (or with) an edge that it leads to."""
    row = poi_row(graph, poi)
    init = graph.nodes.sparkSession.createDataFrame([(poi.src, float(row["start_time"]))], "node string, thr double")
    before = (lambda gate, thr: gate <= thr) if or_equal else (lambda gate, thr: gate < thr)
    steps = graph.edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("start_time").alias("gate"), F.col("start_time").alias("next"))
    reached = relax(steps, init, "max", before)
    own = (F.col("src") == poi.src) & (F.col("dst") == poi.dst) & (F.col("key") == poi.key)
    edges = graph.edges.join(reached.withColumnRenamed("node", "dst"), "dst", "left").where(own | before(F.col("start_time"), F.col("thr"))).select(graph.edges.columns)
    return graph.edge_subgraph(edges)


def forward_onehop(graph: ProvGraph, seeds: DataFrame) -> ProvGraph:
    """The edges that leave the seeds."""
    x = seeds.select(F.col("node").alias("src")).distinct()
    return graph.edge_subgraph(graph.edges.join(x, "src", "left_semi").select(graph.edges.columns))


def forward(graph: ProvGraph, seeds: DataFrame) -> ProvGraph:
    """The edges reached from the seeds: each ends no earlier than an edge before it starts."""
    init = seeds.select("node", F.lit(float("-inf")).alias("thr")).distinct()
    steps = graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("end_time").alias("gate"), F.col("start_time").alias("next"))
    reached = relax(steps, init, "min", lambda gate, thr: gate >= thr)
    edges = graph.edges.join(reached.withColumnRenamed("node", "src"), "src").where("end_time >= thr").select(graph.edges.columns)
    return graph.edge_subgraph(edges)


def truth_events(graph: ProvGraph, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All parallel edges of the given pairs, and the nodes that are missing (the source first)."""
    pairs = truth.select("src", "dst").distinct()
    found = graph.edges.join(pairs, ["src", "dst"], "left_semi").select(graph.edges.columns)
    names = graph.nodes.select("node")
    no_src = pairs.join(names.withColumnRenamed("node", "src"), "src", "left_anti").select(F.col("src").alias("node"))
    no_dst = pairs.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").select(F.col("dst").alias("node"))
    return found, no_src.union(no_dst).distinct()


def truth_of_cases(truth: DataFrame, cases: DataFrame) -> DataFrame:
    """Ground truth of the cases that make up larger ones: (large, case) joined to (case, src, dst), repeats kept."""
    return cases.join(truth, "case").select(F.col("large").alias("case"), "src", "dst")


def edges_to_add(missing: DataFrame, origin: ProvGraph) -> DataFrame:
    """The original graph's edges of the missing pairs."""
    return origin.edges.join(missing.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(origin.edges.columns)


def add_edges(graph: ProvGraph, edges: DataFrame, origin: ProvGraph) -> ProvGraph:
    """The graph with edges of the original one and their endpoints; keys go on after the largest of the pair, in time order.

    The masked address ``xx.xx.xx.xx->xx.xx.xx.xx`` is a socket whatever the original says.
    """
    last = graph.edges.groupBy("src", "dst").agg((F.max("key") + 1).alias("next"))
    at = F.row_number().over(Window.partitionBy("src", "dst").orderBy("start_time", "key", "edge_ord"))
    new = edges.withColumn("at", at).join(last, ["src", "dst"], "left").withColumn("key", F.coalesce("next", F.lit(0)) + F.col("at") - 1).select(graph.edges.columns)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    more = origin.nodes.join(ends, "node", "left_semi").join(graph.nodes.select("node"), "node", "left_anti")
    more = more.withColumn("type", F.when(F.col("node") == "xx.xx.xx.xx->xx.xx.xx.xx", "socket").otherwise(F.col("type")))
    return ProvGraph(graph.nodes.unionByName(more.select(graph.nodes.columns)), graph.edges.unionByName(new))


def add_missing_truth(graph: ProvGraph, origin: ProvGraph, truth: DataFrame, window: float | None = 10_000) -> ProvGraph:
    """The graph with the original edges of ground-truth pairs that it lacks, compressed unless ``window`` is None."""
    from tracegrain.operators.metrics import missing_truth
    from tracegrain.operators.reduction import compress

    full = add_edges(graph, edges_to_add(missing_truth(graph, truth), origin), origin)
    return full if window is None else compress(full, window)


__all__ = ["EDGE_KEY", "add_edges", "add_missing_truth", "backward", "edges_to_add", "forward", "forward_onehop", "relax", "truth_events", "truth_of_cases"]
