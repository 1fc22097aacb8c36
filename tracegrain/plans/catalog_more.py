"""Queries on a graph with names of many shapes, on files, and on operators that the first catalogue leaves out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions import tokens
from tracegrain.model import EDGE_KEY, ProvGraph
from tracegrain.operators import embedding, filters, labels, metrics, propagation, ranking, reduction, sequences, traversal
from tracegrain.operators import features as feat
from tracegrain.plans import catalog
from tracegrain.plans import investigate as inv
from tracegrain.plans.catalog import BACK, BASE, DAY, EDGE, FOLD, READONLY, SYSTEM, WEIGHTS, _back, _edges, _graph, _with, query
from tracegrain.plans.materialize import shared_dir, staged
from tracegrain.sources import adapter, store

PROCESS = """CASE {0} % 5 WHEN 0 THEN 'sshd_' || {0} WHEN 1 THEN '/usr/bin/python_' || {0} WHEN 2 THEN 'C:\\Tools\\agent_' || {0} WHEN 3 THEN 'plain' || {0} ELSE 'bash_' || {0} END"""
RICH = f"""
ev AS (
  SELECT event_id AS ins, event_type, user_id % 7 = 0 AS open, {PROCESS.format("user_id")} AS p, {PROCESS.format("(user_id + 7)")} AS c,
    CASE k % 4 WHEN 0 THEN '/etc/conf' || g WHEN 1 THEN '/usr/lib/l' || g WHEN 2 THEN '/data/g' || g ELSE 'C:\\Users\\g' || g || '.txt' END AS f,
    CASE k % 4 WHEN 0 THEN '/tmp/out' || g WHEN 1 THEN '/var/log/l' || g WHEN 2 THEN '/data/g' || g ELSE 'C:\\Users\\g' || g || '.txt' END AS w,
    CASE k % 3 WHEN 0 THEN 'null:' || (k % 16) || '->null: 0' WHEN 1 THEN '10.0.0.' || (k % 16) || '->10.0.1.1' ELSE '10.0.0.' || (k % 16) || ':80->10.0.1.1:443' END AS s,
    epoch_us(ts) // 1000 AS t, CAST(round(value * 100) AS BIGINT) AS data_amount
  FROM (SELECT *, (user_id % 7) || '_' || k AS g FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
), raw AS (
  SELECT ins, CASE WHEN event_type = 'click' THEN f WHEN event_type = 'view' AND open THEN s ELSE p END AS src,
    CASE WHEN event_type = 'purchase' THEN w WHEN event_type = 'error' AND open THEN s WHEN event_type = 'signup' THEN c ELSE p END AS dst,
    CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'recvfrom' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'sendto' ELSE 'clone' END AS type,
    CAST(t AS DOUBLE) AS start_time, CAST(t + ins % 5000 AS DOUBLE) AS end_time, data_amount
  FROM ev
), nodes AS (
  SELECT node, min(a) AS node_ord, CASE WHEN (starts_with(node, '/') AND NOT starts_with(node, '/usr/bin')) OR ends_with(node, '.txt') THEN 'file' WHEN contains(node, '->') THEN 'socket' ELSE 'process' END AS type
  FROM (SELECT src AS node, 2 * ins AS a FROM raw UNION ALL SELECT dst, 2 * ins + 1 FROM raw) GROUP BY node
)""" + BASE[BASE.index(", edges AS (") :]


def _rich(spark: SparkSession, d: str) -> ProvGraph:
    g = adapter.rich_graph(spark, d)
    return ProvGraph(staged(g.nodes, "nodes"), staged(g.edges, "edges"))


def _sql(name: str) -> str:
    """The SQL of a query of the first catalogue, on the richer graph."""
    return catalog.ORACLES[name].replace(BASE, RICH)


@query("rich_edges", _sql("adapter_edges"))
def rich_edges(spark, d):
    return _edges(adapter.rich_graph(spark, d))


@query("rich_drop_readonly", _sql("drop_readonly"))
def rich_drop_readonly(spark, d):
    return _edges(filters.drop_readonly_files(_rich(spark, d)))


@query("rich_drop_system_paths", _with(RICH) + f" SELECT {EDGE} FROM edges WHERE src NOT IN (SELECT node FROM nodes WHERE type = 'file' AND ({SYSTEM.format('node')})) AND dst NOT IN (SELECT node FROM nodes WHERE type = 'file' AND ({SYSTEM.format('node')}))")
def rich_drop_system_paths(spark, d):
    return _edges(filters.drop_system_files(_rich(spark, d)))


@query("rich_merge_candidates", _sql("merge_candidates"))
def rich_merge_candidates(spark, d):
    return filters.merge_candidates(_rich(spark, d))


@query("rich_semantic_compress", _sql("semantic_compress"))
def rich_semantic_compress(spark, d):
    return _edges(reduction.semantic_compress(_rich(spark, d)))


@query("rich_compress", _sql("compress"))
def rich_compress(spark, d):
    return _edges(reduction.compress(_rich(spark, d), DAY))


@query("rich_dedup_rebuild", _sql("dedup_rebuild"))
def rich_dedup_rebuild(spark, d):
    return _edges(reduction.rebuild_without_redundant(_rich(spark, d), DAY))


@query("rich_back_graph", _sql("back_graph"))
def rich_back_graph(spark, d):
    g = _rich(spark, d)
    return _edges(traversal.backward(g, adapter.event_poi(g)))


@query("rich_root_entries", _sql("root_entries"))
def rich_root_entries(spark, d):
    g = _rich(spark, d)
    poi = adapter.event_poi(g)
    b = traversal.backward(g, poi)
    b = ProvGraph(staged(b.nodes, "nodes"), staged(b.edges, "edges"))
    weights = staged(feat.edge_weights(feat.edge_features(b, poi), compat=True), "weights")
    scored = propagation.propagate_rounds(b, weights, poi).withColumn("score", F.round("score", 8))
    return ranking.root_entries(b, scored)


@query("back_graph_or_equal", _with(BASE, BACK.replace("e.start_time < thr.t", "e.start_time <= thr.t").replace("e.start_time < top.t", "e.start_time <= top.t")) + f" SELECT {EDGE} FROM back")
def back_graph_or_equal(spark, d):
    g = _graph(spark, d)
    return _edges(traversal.backward(g, adapter.event_poi(g), or_equal=True))


RICH_TOK = """, tok AS (SELECT node, type, CASE
  WHEN type = 'process' AND NOT contains(node, '_') THEN CAST([] AS VARCHAR[])
  WHEN type = 'process' AND contains(node, chr(92)) THEN string_split(replace(node, '_', chr(92)), chr(92))
  WHEN type = 'process' AND contains(node, '/') THEN string_split(replace(node[2:], '_', '/'), '/')
  WHEN type = 'process' THEN string_split(node, '_')
  WHEN type = 'socket' AND contains(node, 'null') THEN string_split(replace(node, '->', ':'), ':')
  WHEN type = 'socket' THEN regexp_extract_all(node, '[0-9]+')
  WHEN contains(node, chr(92)) THEN string_split(node, chr(92))
  ELSE string_split(node[2:], '/') END AS t, CASE WHEN type = 'process' AND NOT contains(node, '_') THEN 3 ELSE 0 END AS flag FROM nodes)"""


@query("rich_node_tokens", _with(RICH, RICH_TOK) + " SELECT node, array_to_string(t, '|') AS tokens, flag FROM tok")
def rich_node_tokens(spark, d):
    return sequences.vocabulary_of_nodes(_rich(spark, d)).select("node", F.array_join("tokens", "|").alias("tokens"), "flag")


@query("rich_vocabulary", _with(RICH, RICH_TOK) + " SELECT word FROM (SELECT unnest(t) AS word FROM tok UNION SELECT type FROM edges) WHERE word <> ''")
def rich_vocabulary(spark, d):
    return sequences.vocabulary(_rich(spark, d))


def _in(words) -> str:
    return " OR ".join(f"contains(n, '{w}')" for w in words)


RICH_LAB = f""", lab AS (SELECT node, CASE type WHEN 'file' THEN CASE {" ".join(f"WHEN contains(n, '{p}') THEN '{label}'" for p, label in tokens.FILE_LABELS)} ELSE 'other_file' END
  WHEN 'process' THEN CASE WHEN {_in(tokens.SYSTEM_PROCESSES)} THEN 'system_process' WHEN {_in(tokens.PROGRAM_PROCESSES)} THEN 'program_process' WHEN {_in(tokens.USER_PROCESSES)} THEN 'user_process' ELSE 'lib_process' END
  ELSE 'ip_address' END AS label FROM (SELECT *, trim(lower(node)) AS n FROM nodes))"""


@query("rich_node_labels", _with(RICH, RICH_LAB) + " SELECT node, label FROM lab")
def rich_node_labels(spark, d):
    return labels.node_labels(_rich(spark, d))


STEPS = RICH_LAB + """, st AS (SELECT e.*, a.label || ' ' || e.type || ' ' || b.label AS step FROM edges e JOIN lab a ON a.node = e.src JOIN lab b ON b.node = e.dst
), few AS (SELECT node, CAST(1 AS BIGINT) << (row_number() OVER (ORDER BY node) - 1) AS bit FROM (SELECT DISTINCT src AS node FROM truth ORDER BY node LIMIT 4))"""


def _attackers(g: ProvGraph) -> DataFrame:
    return adapter.event_truth(g).select(F.col("src").alias("node")).distinct().orderBy("node").limit(4)


@query("rich_attack_sequences", _with(RICH, STEPS) + """, cb AS (SELECT a.bit + b.bit AS combo, a.node AS x, b.node AS y FROM few a JOIN few b ON a.bit < b.bit)
SELECT combo, ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM cb JOIN st ON src IN (x, y) OR dst IN (x, y) GROUP BY combo""")  # fmt: skip
def rich_attack_sequences(spark, d):
    g = _rich(spark, d)
    return labels.attack_sequences(g, _attackers(g), 2)


@query("rich_probe_sequences", _with(RICH, STEPS) + """, oth AS (SELECT DISTINCT dst AS other FROM truth
), pr AS (SELECT bit AS combo, node, other FROM few, oth WHERE other NOT IN (SELECT node FROM few))
SELECT combo, other, ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM pr JOIN st ON src IN (node, other) OR dst IN (node, other) GROUP BY combo, other""")  # fmt: skip
def rich_probe_sequences(spark, d):
    g = _rich(spark, d)
    return labels.probe_sequences(g, _attackers(g), adapter.event_truth(g).select(F.col("dst").alias("node")), 1)[1]


@query("truth_of_cases", _with(BASE) + ", cs AS (SELECT DISTINCT src AS c FROM truth) SELECT 'all' AS case, src, dst FROM truth UNION ALL SELECT 'half', src, dst FROM truth WHERE src < 'proc_3'")
def truth_of_cases(spark, d):
    truth = adapter.event_truth(_graph(spark, d)).select(F.col("src").alias("case"), "src", "dst")
    cases = truth.select("case").distinct()
    return traversal.truth_of_cases(truth, cases.select(F.lit("all").alias("large"), "case").union(cases.where("case < 'proc_3'").select(F.lit("half"), "case")))


ADDED = """
, miss AS (SELECT * FROM truth t WHERE NOT EXISTS (FROM back b WHERE b.src = t.src AND b.dst = t.dst) AND NOT EXISTS (FROM back b WHERE b.src = t.dst AND b.dst = t.src)
), added AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY start_time, key) - 1 AS key, type, start_time, end_time, data_amount, o FROM edges SEMI JOIN miss USING (src, dst)
), whole AS (SELECT src, dst, key, type, start_time, end_time, data_amount FROM back UNION ALL SELECT src, dst, key, type, start_time, end_time, data_amount FROM added)"""


@query("add_missing_truth_compressed", _with(BASE, BACK, ADDED, FOLD.replace("FROM edges", "FROM whole"), READONLY.format("kept")) + f" SELECT {EDGE} FROM kept WHERE src NOT IN (SELECT node FROM gone)")
def add_missing_truth_compressed(spark, d):
    g = _graph(spark, d)
    b = traversal.backward(g, adapter.event_poi(g))
    return _edges(traversal.add_missing_truth(ProvGraph(staged(b.nodes, "nodes"), staged(b.edges, "edges")), g, adapter.event_truth(g), DAY))


@query("missing_truth", _with(BASE, BACK, ADDED) + " SELECT src, dst FROM miss")
def missing_truth(spark, d):
    b, _, truth = _back(spark, d)
    return metrics.missing_truth(b, truth)


@query("edge_features_plain", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, round(fs, 6) AS fs, round(ft, 6) AS ft, round(fc, 6) AS fc FROM feats")
def edge_features_plain(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.edge_features(b, poi, None).select(*EDGE_KEY, *[F.round(c, 6).alias(c) for c in inv.BASELINE])


@query("edge_weights_plain", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, round((fs + ft + fc) / sum(fs + ft + fc) OVER (PARTITION BY src), 8) AS weight FROM feats")
def edge_weights_plain(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.edge_weights(feat.edge_features(b, poi, None), inv.BASELINE).select(*EDGE_KEY, F.round("weight", 8).alias("weight"))


@query("scaled_features", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS s_{c}" for c in feat.FEATURES) + " FROM feats")
def scaled_features(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.scaled(staged(feat.edge_features(b, poi), "features"), feat.FEATURES).select(*EDGE_KEY, *[F.round(f"s_{c}", 6).alias(f"s_{c}") for c in feat.FEATURES])


@query("time_buckets_equal", _with(BASE, BACK, WEIGHTS.replace("lo + w * (1 + i * (i + 1) / 2)", "lo + w * (i + 1)")) + " SELECT src, dst, key, CAST(win AS INTEGER) AS win FROM bucket")
def time_buckets_equal(spark, d):
    return feat.time_buckets(_back(spark, d)[0], equal_width=True)[0].select(*EDGE_KEY, "win")


# ---- files: what is written comes back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stored_graph", _with(BASE) + f" SELECT {EDGE} FROM edges")
def stored_graph(spark, d):
    path = _place(spark, "graph")
    store.save_graph(_graph(spark, d), path)
    return _edges(store.read_graph(spark, path))


@query("stored_nodes", _with(BASE) + " SELECT node, type FROM nodes")
def stored_nodes(spark, d):
    path = _place(spark, "graph")
    store.save_graph(_graph(spark, d), path)
    return store.read_graph(spark, path).nodes.select("node", "type")


def _files(spark, d, save, read):
    """Node rows written as two tables and read back from both paths at once."""
    nodes, path = _graph(spark, d).nodes.select("node", "type"), _place(spark, "files")
    for name, part in (("a", F.col("type") == "process"), ("b", F.col("type") != "process")):
        save(nodes.where(part), f"{path}/{name}")
    return read(f"{path}/a", f"{path}/b")


@query("stored_tables", _with(BASE) + " SELECT node, type FROM nodes")
def stored_tables(spark, d):
    return _files(spark, d, lambda df, p: store.save_table(df, p, 50), lambda *p: store.read_tables(spark, *p)).select("node", "type")


@query("stored_lines", _with(BASE) + " SELECT node AS value FROM nodes")
def stored_lines(spark, d):
    return _files(spark, d, lambda df, p: store.save_lines(df, p, "node"), lambda *p: store.read_lines(spark, *p))


@query("stored_map", _with(BASE, catalog.TOK) + " SELECT node AS key, array_to_string(t, '|') AS value FROM tok")
def stored_map(spark, d):
    path = _place(spark, "map")
    store.save_map(sequences.vocabulary_of_nodes(_graph(spark, d)), path, "node", "tokens")
    return store.read_map(spark, path).select("key", F.array_join("value", "|").alias("value"))


@query("stored_lists", _with(BASE, catalog.TOK) + " SELECT array_to_string(t, '|') AS value FROM tok")
def stored_lists(spark, d):
    path = _place(spark, "lists")
    store.save_lines(sequences.vocabulary_of_nodes(_graph(spark, d)).select(store.list_text("tokens").alias("value")), path)
    return store.read_lines(spark, path, schema="array<string>").select(F.array_join("value", "|").alias("value"))


@query("stored_json", _with(BASE) + " SELECT node, type FROM nodes")
def stored_json(spark, d):
    return _files(spark, d, store.save_json, lambda *p: store.read_json(spark, *p, schema="node string, type string")).select("node", "type")


@query("stored_document", _with(BASE) + " SELECT node, type FROM nodes")
def stored_document(spark, d):
    path = _place(spark, "document")
    store.save_document(_graph(spark, d).nodes.select("node", "type"), path)
    return store.read_json(spark, path, schema="node string, type string", one_document=True).select("node", "type")


@query("split_even", _with(BASE) + ", r AS (SELECT node, row_number() OVER (ORDER BY node_ord) - 1 AS pos, count(*) OVER () AS n FROM nodes) SELECT node, CAST(CASE WHEN pos < (n // 7 + 1) * (n % 7) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n // 7 + 1) * (n % 7)) // (n // 7) END + 1 AS INTEGER) AS part FROM r")
def split_even(spark, d):
    return store.split_even(_graph(spark, d).nodes.select("node", "node_ord"), 7, "node_ord").select("node", "part")


@query("chunk_index", _with(BASE) + ", r AS (SELECT node, node_ord, row_number() OVER (ORDER BY node_ord) - 1 AS pos FROM nodes) SELECT pos // 20 AS chunk, pos % 20 AS place, node_ord FROM r")
def chunk_index(spark, d):
    return store.save_chunks(_graph(spark, d).nodes, _place(spark, "chunks"), 20, "node_ord").select(F.col("chunk").cast("long").alias("chunk"), "place", "node_ord")


@query("chunk_by_size", _with(BASE) + """, r AS (SELECT node_ord, coalesce(sum(length(node)) OVER (ORDER BY node_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM nodes)
SELECT CAST(s // 200 AS BIGINT) AS chunk, row_number() OVER (PARTITION BY s // 200 ORDER BY node_ord) - 1 AS place, node_ord FROM r""")  # fmt: skip
def chunk_by_size(spark, d):
    nodes = _graph(spark, d).nodes.withColumn("size", F.length("node").cast("long"))
    return store.chunked(nodes, 200, "node_ord", size="size").select(F.col("chunk").cast("long").alias("chunk"), F.col("place").cast("long").alias("place"), "node_ord")


@query("train_test_sizes", _with(BASE) + " SELECT type AS file, count(*) - CAST(ceil(count(*) * 0.4) AS BIGINT) AS n_train, CAST(ceil(count(*) * 0.4) AS BIGINT) AS n_test FROM nodes GROUP BY type")
def train_test_sizes(spark, d):
    path = _place(spark, "parts")
    store.save_train_test(_graph(spark, d).nodes.select(F.col("type").alias("file"), "node"), path, 0.4)
    both = [spark.read.parquet(f"{path}/{x}").withColumn("x", F.lit(x)) for x in ("train", "test")]
    return both[0].union(both[1]).groupBy("file").agg(F.count_if(F.col("x") == "train").alias("n_train"), F.count_if(F.col("x") == "test").alias("n_test"))


# ---- samples and classifiers


def _label_rows(spark, d) -> DataFrame:
    g = _rich(spark, d)
    texts = labels.token_ids(labels.label_texts(labels.labelled_edges(g), "src", first=400))
    attack = adapter.event_truth(g).select("src").distinct().withColumn("y", F.lit(1))
    return staged(texts.join(attack, "src", "left").select("src", "ids", F.coalesce("y", F.lit(0)).alias("y")), "label-rows")


@query("rebalanced", _with(RICH) + """, y AS (SELECT DISTINCT src, src IN (SELECT src FROM truth) AS y FROM edges), n AS (SELECT count(*) FILTER (NOT y) AS n, count(*) FILTER (y) AS m FROM y)
SELECT CAST(0 AS INTEGER) AS y, CASE WHEN n > m THEN least(n, 9) ELSE n END AS n FROM n UNION ALL SELECT 1, CASE WHEN n > m THEN least(m, 3) ELSE m END FROM n""")  # fmt: skip
def rebalanced(spark, d):
    return labels.rebalance(_label_rows(spark, d).select("ids", "y"), ratio=1, normal=9, abnormal=3).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("label_classifier")
def label_classifier(spark, d):
    return embedding.train_and_evaluate(_label_rows(spark, d).select("ids", "y"))


@query("resumed", _with(BASE, BACK, WEIGHTS, catalog.PROPAGATE, catalog.RANK) + f" SELECT {EDGE} FROM back WHERE src IN (SELECT node FROM rk WHERE rank <= 3)")
def resumed(spark, d):
    """From stored scores on, with three seeds of each type."""
    b, scored, _ = catalog._rounded(spark, d)
    return _edges(inv.resume(b, scored, 3).graph)
