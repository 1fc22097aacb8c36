"""Small graphs for tests."""

from pyspark.sql import functions as F

from tracegrain.model import ProvGraph, build


def graph(spark, events, types=None) -> ProvGraph:
    """From (src, dst, type, start[, end[, amount]]) in insertion order; names tell types unless given."""
    rows = [(i, e[0], e[1], e[2], float(e[3]), float(e[4] if len(e) > 4 else e[3]), e[5] if len(e) > 5 else 1) for i, e in enumerate(events)]
    raw = spark.createDataFrame(rows, "ins long, src string, dst string, type string, start_time double, end_time double, data_amount long")
    names = {n for e in events for n in e[:2]}
    kinds = types or {n: {"f": "file", "s": "socket"}.get(n[0], "process") for n in names}
    return build(raw, spark.createDataFrame(list(kinds.items()), "node string, type string"))


def ends(g: ProvGraph):
    return sorted((r.src, r.dst, r.start_time) for r in g.edges.collect())


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def truth(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def starts(g: ProvGraph):
    return [r.start_time for r in g.edges.orderBy("start_time", F.col("edge_ord")).collect()]
