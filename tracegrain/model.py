"""The provenance graph as two DataFrames.

``nodes``: node, node_ord, type. ``edges``: src, dst, key, edge_ord, type,
start_time, end_time, data_amount. ``edge_ord`` is a struct (source node's
order, first insertion of the pair, own insertion): its order is the order in
which an adjacency structure built edge by edge would list the edges, and it
needs no global rank.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ["src", "dst", "key"]
#: Insertions, and time in the unit of the events' times, that one window covers when the events of a pair are numbered.
INS_SLICE, TIME_SLICE = 1 << 20, 3_600_000


@dataclass(frozen=True)
class Poi:
    """The event of interest."""

    src: str
    dst: str
    key: int


@dataclass(frozen=True)
class ProvGraph:
    nodes: DataFrame
    edges: DataFrame

    def with_edges(self, edges: DataFrame) -> ProvGraph:
        """Other edges between the same nodes."""
        return replace(self, edges=edges)

    def edge_subgraph(self, edges: DataFrame) -> ProvGraph:
        """The given edges and their endpoints only."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        return ProvGraph(self.nodes.join(ends, "node", "left_semi"), edges)

    def node_subgraph(self, nodes: DataFrame) -> ProvGraph:
        """The given nodes and the edges between them."""
        kept = nodes.select("node").distinct()
        edges = self.edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return ProvGraph(self.nodes.join(kept, "node", "left_semi"), edges.select(self.edges.columns))

    def without_nodes(self, gone: DataFrame) -> ProvGraph:
        """All but the given nodes and the edges at them."""
        x = gone.select("node").distinct()
        edges = self.edges.join(x.withColumnRenamed("node", "src"), "src", "left_anti").join(x.withColumnRenamed("node", "dst"), "dst", "left_anti")
        return ProvGraph(self.nodes.join(x, "node", "left_anti"), edges.select(self.edges.columns))


def time_order() -> list[Column]:
    """The stable order in time that nearly every operator uses."""
    return [F.col("start_time"), F.col("edge_ord")]


def numbered(df: DataFrame, keys: list[str], cut: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number from 0 of each row among those with its ``keys``, by ``order``.

    ``cut`` is a slice number that never descends along ``order``: rows are
    numbered slice by slice and the counts of earlier slices added, so a key
    with very many rows is many tasks. Rows with a null key are left out.
    """
    part = "__slice"
    rows = df.withColumn(part, F.coalesce(cut.cast("long"), F.lit(-(1 << 63))))
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    return rows.join(base, [*keys, part]).withColumn(name, F.col("__base") + own - 1).drop(part, "__base")


def build(raw: DataFrame, node_types: DataFrame) -> ProvGraph:
    """A graph from events (ins, src, dst, type, start_time, end_time, data_amount).

    ``ins`` is the unique insertion order; ``node_types`` is (node, type).
    Times and amounts are cast here, once. A null endpoint is an error.
    """
    ends = raw.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (2 * F.col("ins")).alias("at")), F.struct(F.col("dst").alias("node"), (2 * F.col("ins") + 1).alias("at")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.min("at").alias("node_ord")).join(node_types.dropDuplicates(["node"]), "node", "left").select("node", "node_ord", "type")
    pairs = raw.groupBy("src", "dst").agg(F.min("ins").alias("pair_ord"))
    edges = (
        numbered(raw, ["src", "dst"], F.floor(F.col("ins") / INS_SLICE), [F.col("ins")], "key")
        .join(pairs, ["src", "dst"])
        .join(nodes.select(F.col("node").alias("src"), F.col("node_ord").alias("src_ord")), "src")
        .select("src", "dst", "key", F.struct("src_ord", "pair_ord", "ins").alias("edge_ord"), "type", F.col("start_time").cast("double"), F.col("end_time").cast("double"), F.col("data_amount").cast("long"))
    )
    return ProvGraph(nodes, edges)


def poi_row(graph: ProvGraph, poi: Poi) -> dict:
    """The event of interest; an error if a reduction removed it."""
    row = graph.edges.where((F.col("src") == poi.src) & (F.col("dst") == poi.dst) & (F.col("key") == poi.key)).first()
    if row is None:
        raise KeyError(f"the event of interest {poi} is not in the graph; a reduction may have removed it")
    return row.asDict()
