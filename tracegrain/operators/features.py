"""Rarity, edge features and edge weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.model import Poi, ProvGraph, poi_row
from tracegrain.plans.materialize import staged

FEATURES = ("fs", "ft", "fc", "idf")


def boundaries(low: float, high: float, n: int) -> list[float]:
    """Upper ends of the windows: the i-th is low + (high - low) / n * (1 + i (i + 1) / 2)."""
    step = (high - low) / n
    return [low + step * (1 + i * (i + 1) / 2) for i in range(n)]


def equal_boundaries(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) / n * (i + 1) for i in range(n)]


def _window(time: Column, ends: list[float]) -> Column:
    first = F.array_position(F.transform(F.array(*[F.lit(float(e)) for e in ends]), lambda e: time <= e), F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.lit(len(ends) - 1)).cast("int")


def time_buckets(graph: ProvGraph, n: int = 10, equal_width: bool = False) -> tuple[DataFrame, int]:
    """Edges with ``win``, the first window whose end is not before the edge's start, and how many windows count.

    If all edges start at once there is one window.
    """
    low, high = graph.edges.agg(F.min("start_time"), F.max("start_time")).first()
    if low is None:
        return graph.edges.withColumn("win", F.lit(0)), 0
    ends = (equal_boundaries if equal_width else boundaries)(low, high, n)
    if low == high:
        return graph.edges.withColumn("win", F.lit(0)), 1
    return graph.edges.withColumn("win", _window(F.col("start_time"), ends)), n


def rarity(graph: ProvGraph, n: int = 10, equal_width: bool = False) -> DataFrame:
    """(node, idf): ln(windows / (windows with the node + 1)); nodes without edges count none."""
    edges, windows = time_buckets(graph, n, equal_width)
    seen = edges.select(F.explode(F.array("src", "dst")).alias("node"), "win").groupBy("node").agg(F.count_distinct("win").alias("seen"))
    return graph.nodes.select("node").join(seen, "node", "left").select("node", F.log(F.lit(float(windows)) / (F.coalesce("seen", F.lit(0)) + 1)).alias("idf"))


def edge_features(graph: ProvGraph, poi: Poi, n: int | None = 10, equal_width: bool = False) -> DataFrame:
    """Edges with fs (size), ft (time), fc (topology) and, unless ``n`` is None, idf (rarity of the target)."""
    row = poi_row(graph, poi)
    size = 1 / (F.abs(F.col("data_amount") - int(row["data_amount"])) + 1e-4)
    time = F.log(1 + 1 / (F.abs(F.col("end_time") - float(row["end_time"])) + 1e-10))
    out = graph.edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("n_out"))
    into = graph.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    both = into.join(out, "dst", "left").select("dst", (F.coalesce("n_out", F.lit(0)) / F.col("n_in")).alias("fc"))
    if n is not None:
        both = both.join(rarity(graph, n, equal_width).withColumnRenamed("node", "dst"), "dst")
    return graph.edges.withColumn("fs", size).withColumn("ft", time).join(both, "dst").select(*graph.edges.columns, "fs", "ft", "fc", *(["idf"] if n is not None else []))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the rank from 0 by ``order``, without one task that sorts all.

    Ranges are sorted in parallel; the rows before each are added up.
    """
    part, at = "__part", "__at"
    sorted_rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    counts = sorted_rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    base = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return sorted_rows.join(F.broadcast(base), part).withColumn(name, F.col("base") + F.col(at)).drop(part, at, "base")


def normalised(edges: DataFrame) -> DataFrame:
    """``weight`` divided by the sum over the edges of the same source; null where that sum is 0."""
    sums = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    return edges.join(sums, "src").withColumn("weight", F.try_divide("weight", "all")).drop("all")


def edge_weights(features: DataFrame, columns: tuple[str, ...] = FEATURES, compat: bool = False) -> DataFrame:
    """Edges with ``weight``: the sum of their features, normalised by source.

    ``compat``: the r-th sum in time order becomes the weight of the r-th edge
    in adjacency order.
    """
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    base = [c for c in features.columns if c not in FEATURES]
    if not compat:
        return normalised(features.withColumn("weight", total).select(*base, "weight"))
    rows = staged(features.withColumn("weight", total).select(*base, "weight"), "feature-sums")
    by_time = ranked(rows.select("weight", "start_time", "edge_ord"), ["start_time", "edge_ord"], "r").select("r", "weight")
    by_place = ranked(rows.select(*base), ["edge_ord"], "r")
    return normalised(by_place.join(by_time, "r").drop("r"))


def scaled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Columns moved to 0..1 by their extremes; a constant column becomes 0."""
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    for c in columns:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        df = df.withColumn(f"s_{c}", (F.col(c) - low) / (high - low) if low is not None and high > low else F.lit(0.0))
    return df


def discriminant_weights(features: DataFrame, columns: tuple[str, ...] = FEATURES, restarts: int = 10) -> DataFrame:
    """Weights by projecting the features on the direction that best parts two clusters of edges.

    Clusters are the best of ``restarts`` k-means runs on scaled features; the
    direction is the linear discriminant of the clusters; features themselves are
    projected. If the larger cluster's sum exceeds the smaller's, the larger's
    projections change sign.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    names = [f"s_{c}" for c in columns]
    rows = staged(scaled(features, columns), "scaled")
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(rows)
    models = [KMeans(k=2, seed=s, featuresCol="v", predictionCol="cluster").fit(vectors) for s in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    labelled = best.transform(vectors).drop("v")
    d = len(names)
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(d)]
    groups = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(names)], *products).orderBy("cluster").collect()
    base = [c for c in features.columns if c not in FEATURES]
    if len(groups) < 2:
        return edge_weights(features, columns)
    within, means = np.zeros((d, d)), []
    for g in groups:
        mean = np.array([g[f"m{i}"] for i in range(d)]) / g["n"]
        means.append(mean)
        within += np.array([[g[f"p{i}_{j}"] for j in range(d)] for i in range(d)]) - g["n"] * np.outer(mean, mean)
    direction = np.linalg.pinv(within / max(sum(g["n"] for g in groups) - 2, 1)) @ (means[1] - means[0])
    minority = 0 if groups[0]["n"] < groups[1]["n"] else 1
    projection = sum((F.col(c) * float(w) for c, w in list(zip(columns, direction, strict=True))[1:]), F.col(columns[0]) * float(direction[0]))
    projected = staged(labelled.withColumn("weight", projection).select(*base, "weight", "cluster"), "projected")
    sums = {r["cluster"]: r["s"] for r in projected.groupBy("cluster").agg(F.sum("weight").alias("s")).collect()}
    if sums[1 - minority] > sums[minority]:
        projected = projected.withColumn("weight", F.when(F.col("cluster") == 1 - minority, -F.col("weight")).otherwise(F.col("weight")))
    return normalised(projected.drop("cluster"))
