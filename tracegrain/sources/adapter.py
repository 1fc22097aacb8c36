"""A provenance graph from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.model import Poi, ProvGraph, build


def event_edges(events: DataFrame) -> DataFrame:
    """(ins, src, dst, type, start_time, end_time, data_amount) by event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    process = F.concat(F.lit("proc_"), F.col("user_id").cast("string"))
    child = F.concat(F.lit("proc_"), ((F.col("user_id") * 7 + k) % 50 + 1).cast("string"))
    file = F.concat(F.lit("/data/f_"), k.cast("string"))
    socket = F.concat(F.lit("10.0.0."), (k % 16).cast("string"), F.lit(":80->10.0.1.1:443"))
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = events.select(
        F.col("event_id").alias("ins"),
        F.when(kind == "click", file).when(kind == "view", socket).otherwise(process).alias("src"),
        F.when(kind == "purchase", file).when(kind == "error", socket).when(kind == "signup", child).otherwise(process).alias("dst"),
        F.when(kind == "click", "read").when(kind == "view", "recvfrom").when(kind == "purchase", "write").when(kind == "error", "sendto").otherwise("clone").alias("type"),
        start.alias("start_time"),
        (start + F.col("event_id") % 5000).alias("end_time"),
        F.round(F.col("value") * 100).cast("long").alias("data_amount"),
    )
    return rows


def rich_edges(events: DataFrame) -> DataFrame:
    """As ``event_edges`` with names of many shapes: files that are only read, system paths, processes without a path or
    an underscore, masked sockets, and groups of users (by ``user_id % 7``) that share nothing; one of them has sockets."""
    k, user, kind = F.get_json_object("props", "$.k").cast("long"), F.col("user_id"), F.col("event_type")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    group = (user % 7).cast("string")

    def process(u):
        n, shape = u.cast("string"), u % 5
        return F.when(shape == 0, text("sshd_", n)).when(shape == 1, text("/usr/bin/python_", n)).when(shape == 2, text("C:\\Tools\\agent_", n)).when(shape == 3, text("plain", n)).otherwise(text("bash_", n))

    here = (k % 16).cast("string")
    socket = F.when(k % 3 == 0, text("null:", here, "->null: 0")).when(k % 3 == 1, text("10.0.0.", here, "->10.0.1.1")).otherwise(text("10.0.0.", here, ":80->10.0.1.1:443"))
    number = k.cast("string")
    read = F.when(k % 4 == 0, text("/etc/conf", group, "_", number)).when(k % 4 == 1, text("/usr/lib/l", group, "_", number)).when(k % 4 == 2, text("/data/g", group, "_", number)).otherwise(text("C:\\Users\\g", group, "_", number, ".txt"))
    write = F.when(k % 4 == 0, text("/tmp/out", group, "_", number)).when(k % 4 == 1, text("/var/log/l", group, "_", number)).when(k % 4 == 2, text("/data/g", group, "_", number)).otherwise(text("C:\\Users\\g", group, "_", number, ".txt"))
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    open_ = user % 7 == 0
    return events.select(
        F.col("event_id").alias("ins"),
        F.when(kind == "click", read).when((kind == "view") & open_, socket).otherwise(process(user)).alias("src"),
        F.when(kind == "purchase", write).when((kind == "error") & open_, socket).when(kind == "signup", process(user + 7)).otherwise(process(user)).alias("dst"),
        F.when(kind == "click", "read").when(kind == "view", "recvfrom").when(kind == "purchase", "write").when(kind == "error", "sendto").otherwise("clone").alias("type"),
        start.alias("start_time"),
        (start + F.col("event_id") % 5000).alias("end_time"),
        F.round(F.col("value") * 100).cast("long").alias("data_amount"),
    )


def rich_type(node):
    file = (node.startswith("/") & ~node.startswith("/usr/bin")) | node.endswith(".txt")
    return F.when(file, "file").when(node.contains("->"), "socket").otherwise("process")


def rich_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    raw = rich_edges(spark.read.parquet(f"{sf_dir}/events.parquet"))
    names = raw.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return build(raw, names.select("node", rich_type(F.col("node")).alias("type")))


def node_type(node):
    return F.when(node.startswith("/"), "file").when(node.contains("->"), "socket").otherwise("process")


def event_graph(spark: SparkSession, sf_dir: str) -> ProvGraph:
    raw = event_edges(spark.read.parquet(f"{sf_dir}/events.parquet"))
    names = raw.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return build(raw, names.select("node", node_type(F.col("node")).alias("type")))


def event_poi(graph: ProvGraph) -> Poi:
    """The last write to arrive."""
    row = graph.edges.where("type = 'write'").agg(F.max_by(F.struct("src", "dst", "key"), "edge_ord.ins").alias("e")).first()["e"]
    if row is None:
        raise KeyError("no write event")
    return Poi(row["src"], row["dst"], row["key"])


def event_truth(graph: ProvGraph) -> DataFrame:
    """Ground-truth pairs: each process's largest write (the first of equals)."""
    best = F.max_by(F.struct("src", "dst"), F.struct("data_amount", -F.col("edge_ord.ins")))
    return graph.edges.where("type = 'write'").groupBy("src").agg(best.alias("e")).select("e.*")
