"""The registered queries on the graph of the ``events`` table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions.tokens import LABEL_IDS
from tracegrain.model import EDGE_KEY, ProvGraph
from tracegrain.operators import embedding, filters, labels, metrics, propagation, ranking, reduction, sequences, traversal
from tracegrain.operators import features as feat
from tracegrain.plans import investigate as inv
from tracegrain.plans.materialize import staged
from tracegrain.sources import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY, COLUMNS = 86_400_000, ["src", "dst", "key", "type", "start_time", "end_time", "data_amount"]

#: The graph, its event of interest and its ground truth. ``o`` orders edges as an adjacency structure lists them.
BASE = """
ev AS (
  SELECT event_id AS ins, event_type, 'proc_' || user_id AS p, 'proc_' || ((user_id * 7 + k) % 50 + 1) AS c, '/data/f_' || k AS f,
    '10.0.0.' || (k % 16) || ':80->10.0.1.1:443' AS s, epoch_us(ts) // 1000 AS t, CAST(round(value * 100) AS BIGINT) AS data_amount
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), raw AS (
  SELECT ins, CASE event_type WHEN 'click' THEN f WHEN 'view' THEN s ELSE p END AS src,
    CASE event_type WHEN 'purchase' THEN f WHEN 'error' THEN s WHEN 'signup' THEN c ELSE p END AS dst,
    CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'recvfrom' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'sendto' ELSE 'clone' END AS type,
    CAST(t AS DOUBLE) AS start_time, CAST(t + ins % 5000 AS DOUBLE) AS end_time, data_amount
  FROM ev
), nodes AS (
  SELECT node, min(a) AS node_ord, CASE WHEN starts_with(node, '/') THEN 'file' WHEN contains(node, '->') THEN 'socket' ELSE 'process' END AS type
  FROM (SELECT src AS node, 2 * ins AS a FROM raw UNION ALL SELECT dst, 2 * ins + 1 FROM raw) GROUP BY node
), edges AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.src, r.dst ORDER BY ins) - 1 AS key,
    row(n.node_ord, min(ins) OVER (PARTITION BY r.src, r.dst), ins) AS o
  FROM raw r JOIN nodes n ON n.node = r.src
), poi AS (SELECT * FROM edges WHERE type = 'write' ORDER BY ins DESC LIMIT 1
), truth AS (
  SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY data_amount DESC, ins) AS r FROM edges WHERE type = 'write') WHERE r = 1
)"""
BACK = """
, thr(node, t) AS (
  SELECT src, start_time FROM poi
  UNION SELECT e.src, e.start_time FROM edges e JOIN thr ON e.dst = thr.node AND e.start_time < thr.t
), top AS (SELECT node, max(t) AS t FROM thr GROUP BY node
), back AS (
  SELECT e.* FROM edges e LEFT JOIN top ON e.dst = top.node
  WHERE e.start_time < top.t OR (e.src, e.dst, e.key) IN (SELECT (src, dst, key) FROM poi)
), bnodes AS (SELECT * FROM nodes WHERE node IN (SELECT src FROM back UNION SELECT dst FROM back))"""
# features and weights of the backward graph, with 10 windows
WEIGHTS = """
, span AS (SELECT min(start_time) AS lo, (max(start_time) - min(start_time)) / 10 AS w FROM back
), ends AS (SELECT i, lo + w * (1 + i * (i + 1) / 2) AS b FROM span, range(10) t(i)
), bucket AS (SELECT e.*, coalesce((SELECT min(i) FROM ends WHERE e.start_time <= b), 9) AS win FROM back e
), seen AS (SELECT node, count(DISTINCT win) AS n FROM (SELECT src AS node, win FROM bucket UNION ALL SELECT dst, win FROM bucket) GROUP BY node
), idf AS (SELECT node, ln(10.0 / (n + 1)) AS idf FROM seen
), din AS (SELECT dst AS node, count(*) AS n FROM back GROUP BY dst), dout AS (SELECT src AS node, count(*) AS n FROM back GROUP BY src
), feats AS (
  SELECT e.*, 1 / (abs(e.data_amount - p.data_amount) + 1e-4) AS fs, ln(1 + 1 / (abs(e.end_time - p.end_time) + 1e-10)) AS ft,
    coalesce(o.n, 0) / din.n AS fc, idf.idf
  FROM back e, (SELECT data_amount, end_time FROM poi) p JOIN din ON din.node = e.dst LEFT JOIN dout o ON o.node = e.dst JOIN idf ON idf.node = e.dst
), sums AS (SELECT *, fs + ft + fc + idf AS s FROM feats
), compat AS (
  SELECT a.src, a.dst, a.key, b.s AS s FROM
  (SELECT *, row_number() OVER (ORDER BY o) AS r FROM sums) a JOIN (SELECT s, row_number() OVER (ORDER BY start_time, o) AS r FROM sums) b USING (r)
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts)


def _graph(spark: SparkSession, d: str) -> ProvGraph:
    """The whole graph, kept for this query."""
    g = adapter.event_graph(spark, d)
    return ProvGraph(staged(g.nodes, "nodes"), staged(g.edges, "edges"))


def _back(spark: SparkSession, d: str):
    g = _graph(spark, d)
    poi = adapter.event_poi(g)
    b = traversal.backward(g, poi)
    return ProvGraph(staged(b.nodes, "nodes"), staged(b.edges, "edges")), poi, adapter.event_truth(g)


def _edges(g: ProvGraph) -> DataFrame:
    return g.edges.select(*COLUMNS)


EDGE = "src, dst, key, type, start_time, end_time, data_amount"


@query("graph_stats", _with(BASE) + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges)) AS pairs")
def graph_stats(spark, d):
    return metrics.graph_stats(_graph(spark, d))


@query("adapter_edges", _with(BASE) + f" SELECT {EDGE} FROM edges")
def adapter_edges(spark, d):
    return _edges(adapter.event_graph(spark, d))


@query("degree", _with(BASE) + " SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS in_degree, (SELECT count(*) FROM edges WHERE src = node) AS out_degree FROM nodes")
def degree(spark, d):
    return metrics.degree(_graph(spark, d))


@query("back_graph", _with(BASE, BACK) + f" SELECT {EDGE} FROM back")
def back_graph(spark, d):
    g = _graph(spark, d)
    return _edges(traversal.backward(g, adapter.event_poi(g)))


@query("forward_onehop", _with(BASE) + f" SELECT {EDGE} FROM edges WHERE src IN (SELECT src FROM poi UNION SELECT dst FROM poi)")
def forward_onehop(spark, d):
    g = _graph(spark, d)
    poi = adapter.event_poi(g)
    return _edges(traversal.forward_onehop(g, g.nodes.where(F.col("node").isin(poi.src, poi.dst))))


@query(
    "forward_transitive",
    _with(BASE, """
, seed AS (SELECT node FROM nodes WHERE type = 'socket'
), thr(node, t) AS (
  SELECT node, CAST('-Infinity' AS DOUBLE) FROM seed
  UNION SELECT e.dst, e.start_time FROM edges e JOIN thr ON e.src = thr.node AND e.end_time >= thr.t
), low AS (SELECT node, min(t) AS t FROM thr GROUP BY node)""") + " SELECT src, dst, key, e.type, start_time, end_time, data_amount FROM edges e JOIN low ON e.src = low.node WHERE end_time >= t",
)
def forward_transitive(spark, d):
    g = _graph(spark, d)
    return _edges(traversal.forward(g, g.nodes.where("type = 'socket'")))


FOLD = f"""
, anchors AS (
  SELECT src, dst, type, unnest(list_reduce(list_transform(list_sort(list(DISTINCT start_time)), lambda t: [t]), lambda a, x: CASE WHEN x[1] - a[-1] >= {DAY} THEN a || x ELSE a END)) AS start_time
  FROM edges GROUP BY src, dst, type
), kept AS (SELECT * FROM edges SEMI JOIN anchors USING (src, dst, type, start_time))"""
READONLY = ", gone AS (SELECT node FROM nodes WHERE type = 'file' AND node NOT IN (SELECT dst FROM {0}))"


@query("dedup_redundant", _with(BASE, FOLD) + f" SELECT {EDGE} FROM kept")
def dedup_redundant(spark, d):
    return _edges(reduction.drop_redundant(_graph(spark, d), DAY))


@query(
    "dedup_rebuild",
    _with(BASE, FOLD, ", first AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY src, dst, type, start_time ORDER BY o) = 1)", READONLY.format("first"))
    + " SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY start_time, o) - 1 AS key, type, start_time, end_time, data_amount FROM first WHERE src NOT IN (SELECT node FROM gone)",
)
def dedup_rebuild(spark, d):
    return _edges(reduction.rebuild_without_redundant(_graph(spark, d), DAY))


@query("compress", _with(BASE, FOLD, READONLY.format("kept")) + f" SELECT {EDGE} FROM kept WHERE src NOT IN (SELECT node FROM gone)")
def compress(spark, d):
    return _edges(reduction.compress(_graph(spark, d), DAY))


@query("drop_readonly", _with(BASE, READONLY.format("edges")) + f" SELECT {EDGE} FROM edges WHERE src NOT IN (SELECT node FROM gone)")
def drop_readonly(spark, d):
    return _edges(filters.drop_readonly_files(_graph(spark, d)))


SYSTEM = " OR ".join(f"starts_with({{0}}, '{p}')" for p in filters.SYSTEM_PREFIXES)


@query("drop_system_paths", _with(BASE) + f" SELECT {EDGE} FROM edges WHERE NOT ({SYSTEM.format('src')}) AND NOT ({SYSTEM.format('dst')})")
def drop_system_paths(spark, d):
    return _edges(filters.drop_system_files(_graph(spark, d)))


@query("remove_events", _with(BASE) + f" SELECT {EDGE} FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM truth)")
def remove_events(spark, d):
    g = _graph(spark, d)
    return _edges(filters.remove_events(g, traversal.truth_events(g, adapter.event_truth(g))[0]))


@query("neighborhood", _with(BASE) + f" SELECT {EDGE} FROM edges WHERE src IN (SELECT src FROM poi UNION SELECT dst FROM poi) OR dst IN (SELECT src FROM poi UNION SELECT dst FROM poi)")
def neighborhood(spark, d):
    g = _graph(spark, d)
    poi = adapter.event_poi(g)
    return _edges(filters.neighborhood(g, g.nodes.where(F.col("node").isin(poi.src, poi.dst))))


@query(
    "single_type_nodes",
    _with(BASE, """
, per AS (SELECT src AS node, dst, count(*) AS n, min(type) AS lo, max(type) AS hi FROM edges WHERE dst IN (SELECT dst FROM truth) GROUP BY 1, 2
), one AS (SELECT node, max(n) = 1 AND min(lo) = max(hi) AS one_type FROM per GROUP BY node)""") + " SELECT node, coalesce(one_type, false) AS one_type FROM nodes LEFT JOIN one USING (node)",
)
def single_type_nodes(spark, d):
    g = _graph(spark, d)
    return filters.single_type_nodes(g, adapter.event_truth(g).select(F.col("dst").alias("node")))


@query(
    "merge_candidates",
    _with(BASE, """
, pr AS (SELECT DISTINCT src, dst FROM edges), i AS (SELECT dst AS node, count(*) AS n, min(src) AS x FROM pr GROUP BY 1), u AS (SELECT src AS node, count(*) AS n, min(dst) AS x FROM pr GROUP BY 1)""")
    + " SELECT node FROM i FULL JOIN u USING (node) WHERE i.n IS NULL OR u.n IS NULL OR (i.n = 1 AND u.n = 1 AND i.x = u.x)",
)
def merge_candidates(spark, d):
    return filters.merge_candidates(_graph(spark, d))


@query("first_per_source_type", _with(BASE) + f" SELECT {EDGE} FROM edges QUALIFY row_number() OVER (PARTITION BY src, type ORDER BY start_time, o) = 1")
def first_per_source_type(spark, d):
    return _edges(reduction.first_per_source_type(_graph(spark, d)))


@query(
    "semantic_compress",
    _with(BASE, """
, ranked AS (
  SELECT e.*, row_number() OVER (ORDER BY start_time, o) AS r, a.type AS st, b.type AS dt FROM edges e JOIN nodes a ON a.node = e.src JOIN nodes b ON b.node = e.dst
), sock AS (SELECT * FROM ranked WHERE type IN ('recvfrom', 'recvmsg', 'sendto', 'write', 'read', 'writev', 'readv') AND (st = 'socket' OR dt = 'socket')
), carry AS (SELECT * FROM ranked WHERE r NOT IN (SELECT r FROM sock) AND ((type IN ('write', 'writev') AND dt = 'file') OR (type IN ('read', 'readv') AND st = 'file') OR type IN ('execve', 'fork', 'clone'))
), first AS (SELECT node, min(r) AS r FROM (SELECT src AS node, r FROM sock UNION ALL SELECT dst, r FROM sock) GROUP BY node
), taint(node, r) AS (SELECT node, r FROM first UNION SELECT c.dst, c.r FROM carry c JOIN taint t ON c.src = t.node AND c.r > t.r
), hit AS (SELECT DISTINCT node FROM taint)""") + f" SELECT {EDGE} FROM edges WHERE src IN (SELECT node FROM hit) AND dst IN (SELECT node FROM hit)",
)
def semantic_compress(spark, d):
    return _edges(reduction.semantic_compress(_graph(spark, d)))


@query("truth_events", _with(BASE) + f" SELECT {EDGE} FROM edges SEMI JOIN truth USING (src, dst)")
def truth_events(spark, d):
    g = _graph(spark, d)
    return traversal.truth_events(g, adapter.event_truth(g))[0].select(*COLUMNS)


@query(
    "add_missing_truth",
    _with(BASE, BACK, """
, miss AS (SELECT * FROM truth t WHERE NOT EXISTS (FROM back b WHERE b.src = t.src AND b.dst = t.dst) AND NOT EXISTS (FROM back b WHERE b.src = t.dst AND b.dst = t.src)
), added AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY start_time, key) - 1 AS key, type, start_time, end_time, data_amount FROM edges SEMI JOIN miss USING (src, dst))""")
    + f" SELECT {EDGE} FROM back UNION ALL SELECT {EDGE} FROM added",
)
def add_missing_truth(spark, d):
    g = _graph(spark, d)
    back = traversal.backward(g, adapter.event_poi(g))
    return _edges(traversal.add_missing_truth(back, g, adapter.event_truth(g), None))


@query("gt_coverage", _with(BASE, BACK) + """, m AS (SELECT EXISTS (FROM back b WHERE b.src = t.src AND b.dst = t.dst) AS x, EXISTS (FROM back b WHERE b.src = t.dst AND b.dst = t.src) AS y FROM truth t)
SELECT count(*) FILTER (x) AS tp, count(*) FILTER (y) AS tp1, count(*) FILTER (x OR y) AS tp2, count(*) FILTER (NOT x AND NOT y) AS fn FROM m""")  # fmt: skip
def gt_coverage(spark, d):
    b, _, truth = _back(spark, d)
    return metrics.truth_coverage(b, truth)


@query("edge_confusion", _with(BASE, BACK) + """ SELECT (SELECT count(*) FROM truth ANTI JOIN back USING (src, dst)) AS fn,
(SELECT count(*) FROM back ANTI JOIN truth USING (src, dst)) AS fp, (SELECT count(*) FROM back SEMI JOIN truth USING (src, dst)) AS tp""")  # fmt: skip
def edge_confusion(spark, d):
    b, _, truth = _back(spark, d)
    return metrics.edge_confusion(b, truth)


@query("graph_report", _with(BASE, BACK) + """ SELECT (SELECT count(*) FROM bnodes) AS nodes, (SELECT count(*) FROM back) AS edges, count(*) FILTER (x) AS tp,
count(*) FILTER (NOT x AND NOT y) AS fn, (SELECT count(*) FROM back) - count(*) FILTER (x) AS fp
FROM (SELECT EXISTS (FROM back b WHERE b.src = t.src AND b.dst = t.dst) AS x, EXISTS (FROM back b WHERE b.src = t.dst AND b.dst = t.src) AS y FROM truth t)""")  # fmt: skip
def graph_report(spark, d):
    b, _, truth = _back(spark, d)
    return metrics.graph_report(b, truth)


@query("time_buckets", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, CAST(win AS INTEGER) AS win FROM bucket")
def time_buckets(spark, d):
    return feat.time_buckets(_back(spark, d)[0])[0].select(*EDGE_KEY, "win")


@query("node_rarity", _with(BASE, BACK, WEIGHTS) + " SELECT node, round(idf, 6) AS idf FROM idf")
def node_rarity(spark, d):
    return feat.rarity(_back(spark, d)[0]).select("node", F.round("idf", 6).alias("idf"))


@query("edge_features", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, round(fs, 6) AS fs, round(ft, 6) AS ft, round(fc, 6) AS fc, round(idf, 6) AS idf FROM feats")
def edge_features(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.edge_features(b, poi).select(*EDGE_KEY, *[F.round(c, 6).alias(c) for c in feat.FEATURES])


@query("edge_weights", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, round(s / sum(s) OVER (PARTITION BY src), 8) AS weight FROM sums")
def edge_weights(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.edge_weights(feat.edge_features(b, poi)).select(*EDGE_KEY, F.round("weight", 8).alias("weight"))


@query("edge_weights_compat", _with(BASE, BACK, WEIGHTS) + " SELECT src, dst, key, round(s / sum(s) OVER (PARTITION BY src), 8) AS weight FROM compat")
def edge_weights_compat(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.edge_weights(feat.edge_features(b, poi), compat=True).select(*EDGE_KEY, F.round("weight", 8).alias("weight"))


@query("edge_weights_clustering")
def edge_weights_clustering(spark, d):
    b, poi, _ = _back(spark, d)
    return feat.discriminant_weights(feat.edge_features(b, poi)).select(*EDGE_KEY, "weight")


ROUNDS = propagation.ROUNDS
PROPAGATE = f"""
, wt AS (SELECT src, dst, s / sum(s) OVER (PARTITION BY src) AS w FROM compat), pw AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM wt GROUP BY 1, 2
), pin AS (SELECT p.src, p.dst, coalesce((SELECT sum(w) FROM pw WHERE pw.src = p.src AND pw.dst IN (p.src, p.dst)), 0) AS v FROM poi p
), fixed AS MATERIALIZED (SELECT node, CASE WHEN node = dst THEN 1.0::DOUBLE WHEN node = src THEN v END AS v FROM bnodes, pin
), rounds(i, node, score) AS (
  SELECT 0, node, coalesce(v, 1.0::DOUBLE) FROM fixed
  UNION ALL
  SELECT n.i + 1, n.node, coalesce(any_value(f.v), sum(pw.w * s.score), 0)
  FROM rounds n JOIN fixed f USING (node) LEFT JOIN pw ON pw.src = n.node LEFT JOIN rounds s ON s.node = pw.dst
  WHERE n.i < {ROUNDS} GROUP BY n.i, n.node
), scored AS (SELECT b.node, b.type, b.node_ord, s.score FROM bnodes b JOIN rounds s USING (node) WHERE s.i = {ROUNDS})"""


_SCORED: dict = {}


def _scored(spark, d, name, make):
    """Scores of a backward graph, written once for all queries of an application that start from them."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _SCORED:
        b, poi, truth = _back(spark, d)
        _SCORED[key] = b, staged(make(b, poi), name), staged(truth, "truth")
    return _SCORED[key]


def _propagated(spark, d):
    weights = lambda b, poi: staged(feat.edge_weights(feat.edge_features(b, poi), compat=True), "weights")
    return _scored(spark, d, "round-scores", lambda b, poi: propagation.propagate_rounds(b, weights(b, poi), poi))


@query("propagate_k", _with(BASE, BACK, WEIGHTS, PROPAGATE) + " SELECT node, round(score, 8) AS score FROM scored")
def propagate_k(spark, d):
    return _propagated(spark, d)[1].select("node", F.round("score", 8).alias("score"))


RANK = ", rk AS (SELECT node, type, round(score, 8) AS score, row_number() OVER (PARTITION BY type ORDER BY round(score, 8) DESC, node_ord) AS rank FROM scored)"


def _rounded(spark, d):
    b, scored, truth = _propagated(spark, d)
    return b, scored.withColumn("score", F.round("score", 8)), truth


@query("rank_by_type", _with(BASE, BACK, WEIGHTS, PROPAGATE, RANK) + " SELECT node, type, score, CAST(rank AS INTEGER) AS rank FROM rk")
def rank_by_type(spark, d):
    return ranking.rank_by_type(_rounded(spark, d)[1])


@query("seeds_topn", _with(BASE, BACK, WEIGHTS, PROPAGATE, RANK) + " SELECT node, type, score, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY rank, CASE type WHEN 'file' THEN 1 WHEN 'socket' THEN 2 ELSE 3 END) AS INTEGER) AS position FROM rk WHERE rank <= 7")
def seeds_topn(spark, d):
    return ranking.seeds(ranking.rank_by_type(_rounded(spark, d)[1]))


@query("seed_sweep", _with(BASE, BACK, WEIGHTS, PROPAGATE, RANK) + """
, x AS (SELECT rk.rank, count(*) AS e, count(t.src) AS h, count(DISTINCT CASE WHEN t.src IS NOT NULL THEN e.src || '|' || e.dst END) AS c FROM back e JOIN rk ON rk.node = e.src LEFT JOIN truth t ON t.src = e.src AND t.dst = e.dst GROUP BY 1)
SELECT CAST(r.rank AS INTEGER) AS n, CAST(sum(coalesce(e, 0)) OVER w AS BIGINT) AS edges, CAST(sum(coalesce(h, 0)) OVER w AS BIGINT) AS tp,
  CAST(sum(coalesce(e, 0)) OVER w - sum(coalesce(h, 0)) OVER w AS BIGINT) AS fp, CAST((SELECT count(*) FROM truth) - sum(coalesce(c, 0)) OVER w AS BIGINT) AS fn
FROM (SELECT DISTINCT rank FROM rk) r LEFT JOIN x USING (rank) WINDOW w AS (ORDER BY r.rank)""")  # fmt: skip
def seed_sweep(spark, d):
    b, scored, truth = _rounded(spark, d)
    return inv.sweep(b, ranking.rank_by_type(scored), truth)


ENTRY = """, inc AS (SELECT src AS node, src <> dst AS leaves, start_time, o FROM {0} UNION ALL SELECT dst, false, start_time, o FROM {0}
), entry AS (SELECT node FROM (SELECT node, leaves, row_number() OVER (PARTITION BY node ORDER BY start_time, o) AS r FROM inc) WHERE r = 1 AND leaves)"""


@query("entry_nodes", _with(BASE, ENTRY.format("edges")) + " SELECT node FROM entry")
def entry_nodes(spark, d):
    return ranking.entry_nodes(_graph(spark, d))


@query("entry_ranking", _with(BASE, BACK, WEIGHTS, PROPAGATE, ENTRY.format("back")) + " SELECT node, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 8) DESC, node) AS INTEGER) AS rank FROM scored SEMI JOIN entry USING (node)")
def entry_ranking(spark, d):
    b, scored, _ = _rounded(spark, d)
    return ranking.rank_entries(b, scored)


@query("root_entries", _with(BASE, BACK, WEIGHTS, PROPAGATE) + " SELECT node, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY round(score, 8) DESC, node) AS INTEGER) AS rank FROM scored WHERE node NOT IN (SELECT dst FROM back WHERE src <> dst)")
def root_entries(spark, d):
    b, scored, _ = _rounded(spark, d)
    return ranking.root_entries(b, scored)


# The six queries above run simultaneous rounds to the end, as their SQL does. These run the sequential definition, whose
# updates see each other and which has no SQL: tests hold it against a plain version.
def _full(spark, d):
    return _scored(spark, d, "full-scores", lambda b, poi: inv.score(b, poi, compat=True).withColumn("score", F.round("score", 8)))


@query("propagate_full")
def propagate_full(spark, d):
    return _full(spark, d)[1].select("node", "score")


@query("rank_by_type_full")
def rank_by_type_full(spark, d):
    return ranking.rank_by_type(_full(spark, d)[1])


@query("seeds_topn_full")
def seeds_topn_full(spark, d):
    return ranking.seeds(ranking.rank_by_type(_full(spark, d)[1]))


@query("seed_sweep_full")
def seed_sweep_full(spark, d):
    b, scored, truth = _full(spark, d)
    return inv.sweep(b, ranking.rank_by_type(scored), truth)


@query("entry_ranking_full")
def entry_ranking_full(spark, d):
    b, scored, _ = _full(spark, d)
    return ranking.rank_entries(b, scored)


@query("root_entries_full")
def root_entries_full(spark, d):
    b, scored, _ = _full(spark, d)
    return ranking.root_entries(b, scored)


PEV = """, pe AS (SELECT n.node AS process, n.node_ord, e.* FROM nodes n JOIN edges e ON n.node = e.src OR n.node = e.dst WHERE n.type = 'process')"""
SES = PEV + """
, gaps AS (SELECT *, coalesce(CAST(start_time - lag(start_time) OVER (PARTITION BY process ORDER BY start_time, o) >= 3600000 AS BIGINT), 0) AS g FROM pe
), sn AS (SELECT *, CAST(sum(g) OVER (PARTITION BY process ORDER BY start_time, o) AS BIGINT) AS session_no FROM gaps
), ses AS (SELECT *, row_number() OVER (PARTITION BY process, session_no ORDER BY start_time, o) - 1 AS event_no FROM sn)"""
HOUR = 3_600_000


@query("process_events", _with(BASE, PEV) + " SELECT process, src, dst, key FROM pe")
def process_events(spark, d):
    return sequences.process_events(_graph(spark, d)).select("process", *EDGE_KEY)


@query("sessions", _with(BASE, SES) + " SELECT process, session_no, event_no, src, dst, key FROM ses")
def sessions(spark, d):
    return sequences.sessions(sequences.process_events(_graph(spark, d)), HOUR).select("process", "session_no", "event_no", *EDGE_KEY)


@query("session_lists", _with(BASE, SES) + " SELECT process, session_no, string_agg(src || ' ' || dst || ' ' || type, ';' ORDER BY event_no) AS events FROM ses GROUP BY 1, 2")
def session_lists(spark, d):
    found = sequences.session_lists(sequences.process_events(_graph(spark, d)), HOUR)
    return found.select("process", "session_no", F.array_join(F.transform("events", lambda x: F.concat_ws(" ", x["src"], x["dst"], x["type"])), ";").alias("events"))


# names of this graph: processes proc_N, files /data/f_N, sockets a.b.c.d:p->a.b.c.d:p
TOK = r""", tok AS (SELECT node, type, node_ord, CASE type WHEN 'process' THEN string_split(node, '_') WHEN 'file' THEN string_split(node[2:], '/') ELSE regexp_extract_all(node, '[0-9]+') END AS t FROM nodes)"""


@query("node_tokens", _with(BASE, TOK) + " SELECT node, array_to_string(t, ' ') AS tokens, 0 AS flag FROM tok")
def node_tokens(spark, d):
    return sequences.vocabulary_of_nodes(_graph(spark, d)).select("node", F.array_join("tokens", " ").alias("tokens"), "flag")


@query("vocabulary", _with(BASE, TOK) + " SELECT unnest(t) AS word FROM tok UNION SELECT type FROM edges")
def vocabulary(spark, d):
    return sequences.vocabulary(_graph(spark, d))


def _texts(spark, d, f, **how):
    g = _graph(spark, d)
    return f(sequences.process_events(g), staged(sequences.vocabulary_of_nodes(g), "vocabulary"), HOUR, **how)


# sessions of this graph stay below the limit of tokens: tests hold overflow against a plain version
PRE = TOK + """
, ws AS (SELECT s.process, s.node_ord, s.session_no, s.event_no, s.src, s.dst, s.key, array_to_string(a.t, ' ') || ' ' || s.type || ' ' || array_to_string(b.t, ' ') AS w FROM ses s JOIN tok a ON a.node = s.src JOIN tok b ON b.node = s.dst
), tx AS (SELECT *, string_agg(w, ' ') OVER (PARTITION BY process, session_no ORDER BY event_no) AS text FROM ws)"""


@query("event_texts", _with(BASE, SES, PRE) + " SELECT process, session_no, event_no, 0 AS piece_no, text FROM tx")
def event_texts(spark, d):
    return _texts(spark, d, sequences.event_texts).drop("node_ord")


@query("session_texts", _with(BASE, SES, PRE) + " SELECT process, session_no, event_no, 0 AS piece_no, text FROM tx QUALIFY row_number() OVER (PARTITION BY text ORDER BY node_ord, session_no, event_no) = 1")
def session_texts(spark, d):
    return _texts(spark, d, sequences.session_texts).drop("node_ord")


@query("event_text_map", _with(BASE, SES, PRE) + " SELECT src, dst, key, arg_max(text, node_ord) AS texts FROM tx GROUP BY 1, 2, 3")
def event_text_map(spark, d):
    return _texts(spark, d, sequences.event_text_map).select(*EDGE_KEY, F.array_join("texts", "|").alias("texts"))


@query("truth_sequences", _with(BASE, PEV) + """, atk AS (SELECT e.* FROM edges e SEMI JOIN truth USING (src, dst)), more AS (SELECT n.node AS process, a.src, a.dst, a.key FROM atk a JOIN nodes n ON n.type = 'process' AND n.node IN (a.src, a.dst))
SELECT process, src, dst, key, 'plain' AS side FROM pe WHERE process IN (SELECT process FROM more) UNION ALL SELECT process, src, dst, key, 'truth' FROM more
UNION ALL SELECT process, src, dst, key, 'truth' FROM pe WHERE process IN (SELECT process FROM more)""")  # fmt: skip
def truth_sequences(spark, d):
    g = _graph(spark, d)
    attack, _ = traversal.truth_events(g, adapter.event_truth(g))
    both, plain = sequences.truth_sequences(attack, sequences.process_events(g))
    return plain.select("process", *EDGE_KEY, F.lit("plain").alias("side")).union(both.select("process", *EDGE_KEY, F.lit("truth")))


LAB = """, lab AS (SELECT node, CASE type WHEN 'file' THEN 'other_file' WHEN 'process' THEN 'lib_process' ELSE 'ip_address' END AS label FROM nodes
), st AS (SELECT e.*, a.label || ' ' || e.type || ' ' || b.label AS step FROM edges e JOIN lab a ON a.node = e.src JOIN lab b ON b.node = e.dst
), few AS (SELECT unnest([src, dst]) AS node FROM poi
), own AS (SELECT * FROM st WHERE src IN (SELECT node FROM few) OR dst IN (SELECT node FROM few))"""


@query("node_labels", _with(BASE, LAB) + " SELECT node, label FROM lab")
def node_labels(spark, d):
    return labels.node_labels(_graph(spark, d))


def _few(g: ProvGraph) -> DataFrame:
    poi = adapter.event_poi(g)
    return g.nodes.where(F.col("node").isin(poi.src, poi.dst)).select("node")


@query("label_sequences", _with(BASE, LAB) + " SELECT CAST(3 AS BIGINT) AS combo, ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM own")
def label_sequences(spark, d):
    g = _graph(spark, d)
    return labels.attack_sequences(g, _few(g))


@query("plain_sequences", _with(BASE, LAB) + """, oth AS (SELECT DISTINCT node FROM (SELECT src AS node FROM own UNION ALL SELECT dst FROM own) WHERE node NOT IN (SELECT node FROM few)
), al AS (SELECT ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM own
), bth AS (SELECT node, step, start_time, o FROM oth, own UNION ALL SELECT node, step, start_time, o FROM oth JOIN own ON node IN (src, dst)
), tx AS (SELECT node, ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM bth GROUP BY node)
SELECT CAST(3 AS BIGINT) AS combo, node, text FROM tx WHERE text NOT IN (SELECT text FROM al)""")  # fmt: skip
def plain_sequences(spark, d):
    g = _graph(spark, d)
    return labels.plain_sequences(g, _few(g))


IDS = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL_IDS.items()) + " END"


@query("token_ids", _with(BASE, LAB) + f""", l AS (SELECT src, ' ' || string_agg(step, ' ' ORDER BY start_time, o) AS text FROM st GROUP BY src
), i AS (SELECT src, list_filter(list_transform(string_split(text, ' '), lambda w: {IDS}), lambda x: x IS NOT NULL) AS ids FROM l)
SELECT src, array_to_string((ids || list_transform(range(400), lambda x: 0))[1:400], ' ') AS ids FROM i""")  # fmt: skip
def token_ids(spark, d):
    texts = labels.label_texts(labels.labelled_edges(_graph(spark, d)), "src", first=400)  # a step has an id at least
    return labels.token_ids(texts, 400).select("src", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("similarity_matrix", _with(BASE, LAB) + """, l AS (SELECT src, list(type ORDER BY start_time, o) AS x FROM st GROUP BY src)
SELECT a.src AS a, b.src AS b, round(1 - CAST(greatest(len(a.x), len(b.x)) - len(list_filter(list_zip(a.x, b.x), lambda p: p[1] = p[2])) AS DOUBLE) / greatest(len(a.x), len(b.x)), 8) AS similarity FROM l a JOIN l b ON a.src <= b.src""")  # fmt: skip
def similarity_matrix(spark, d):
    g = _graph(spark, d)
    lists = g.edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "edge_ord", "type"))), lambda x: x["type"]).alias("ids"))
    return labels.similarity_matrix(staged(lists.withColumnRenamed("src", "id"), "lists")).select("a", "b", F.round("similarity", 8).alias("similarity"))


@query("text_embeddings")
def text_embeddings(spark, d):
    g = _graph(spark, d)
    texts = labels.label_texts(labels.labelled_edges(g), "src")
    return embedding.embed_texts(texts).select("src", "embedding")


@query("investigate")
def investigate(spark, d):
    b, poi, truth = _back(spark, d)
    return inv.report(inv.investigate(b, poi), truth)


@query("investigate_seeds")
def investigate_seeds(spark, d):
    b, poi, _ = _back(spark, d)
    return inv.investigate(b, poi).seeds


@query("baseline_entries")
def baseline_entries(spark, d):
    b, poi, truth = _back(spark, d)
    return inv.report(inv.baseline_entries(b, poi), truth)


@query("baseline_sweep")
def baseline_sweep(spark, d):
    b, poi, truth = _back(spark, d)
    found = inv.baseline_entries(b, poi)
    return inv.baseline_sweep(b, staged(found.scored, "scores"), truth)


