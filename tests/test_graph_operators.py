import math
import random

import pytest
from pyspark.sql import functions as F

from tests.graphs import ends, graph, nodes, starts, truth
from tracegrain.model import Poi
from tracegrain.operators import features, filters, metrics, propagation, ranking, reduction, traversal


def test_redundant_edges(spark):
    times = [0, 0, 4, 9, 10, 12, 20, 29, 30]
    g = graph(spark, [("a", "b", "read", t) for t in times])
    assert starts(reduction.drop_redundant(g, 10)) == [0, 0, 10, 20, 30]
    again = reduction.rebuild_without_redundant(g, 10)
    assert starts(again) == [0, 10, 20, 30]
    assert [r.key for r in again.edges.orderBy("start_time").collect()] == [0, 1, 2, 3]


def test_redundant_edges_are_those_of_the_pairwise_rule(spark):
    rng = random.Random(3)
    events = [(rng.choice("ab"), rng.choice("cd"), rng.choice(["read", "write"]), rng.randrange(60)) for _ in range(150)]
    alive = sorted(enumerate(events), key=lambda x: x[1][3])
    gone = set()
    for i, e in alive:
        if i not in gone:
            gone |= {j for j, o in alive if o[:3] == e[:3] and o[3] != e[3] and abs(o[3] - e[3]) < 7}
    want = sorted((e[0], e[1], float(e[3])) for i, e in enumerate(events) if i not in gone)
    small = reduction.drop_redundant(graph(spark, events), 7)
    assert ends(small) == want
    assert ends(reduction.drop_redundant(small, 7)) == want


def test_filters(spark):
    g = graph(spark, [("f1", "a", "read", 1), ("a", "f2", "write", 2), ("f2", "b", "read", 3)])
    assert ends(filters.drop_readonly_files(g)) == [("a", "f2", 2.0), ("f2", "b", 3.0)]
    assert ends(filters.neighborhood(g, nodes(spark, "b"))) == [("f2", "b", 3.0)]
    assert ends(filters.remove_events(g, g.edges.where("src = 'a'"))) == [("f1", "a", 1.0), ("f2", "b", 3.0)]
    types = {"/libfoo": "file", "/data/x": "file", "a": "process"}
    s = graph(spark, [("/libfoo", "a", "read", 1), ("/data/x", "a", "read", 2)], types)
    assert ends(filters.drop_system_files(s)) == [("/data/x", "a", 2.0)]
    one = {r.node: r.one_type for r in filters.single_type_nodes(g, nodes(spark, "a", "b")).collect()}
    assert one == {"f1": True, "f2": True, "a": False, "b": False}
    assert {r.node for r in filters.merge_candidates(g).collect()} == {"f1", "b"}


def test_first_per_source_and_type(spark):
    g = graph(spark, [("u", "v", "write", 1), ("u", "w", "write", 2), ("u", "v", "read", 3)])
    assert [t for *_, t in ends(reduction.first_per_source_type(g))] == [1.0, 3.0]


def test_backward(spark):
    g = graph(spark, [("a", "b", "x", 1), ("b", "c", "x", 5), ("x", "b", "x", 5), ("y", "a", "x", 1)])
    poi = Poi("b", "c", 0)
    assert ends(traversal.backward(g, poi)) == [("a", "b", 1.0), ("b", "c", 5.0)]
    assert len(ends(traversal.backward(g, poi, or_equal=True))) == 4
    with pytest.raises(KeyError):
        traversal.backward(g, Poi("b", "c", 7))


def test_forward(spark):
    g = graph(spark, [("a", "b", "x", 5, 5), ("b", "c", "x", 6, 6), ("b", "d", "x", 4, 4)])
    assert ends(traversal.forward_onehop(g, nodes(spark, "a"))) == [("a", "b", 5.0)]
    assert ends(traversal.forward(g, nodes(spark, "a"))) == [("a", "b", 5.0), ("b", "c", 6.0)]


def plain_backward(events, poi, equal):
    found, todo = {poi}, [poi]
    while todo:
        e = events[todo.pop()]
        for i, f in enumerate(events):
            if i not in found and f[1] == e[0] and (f[3] < e[3] or (equal and f[3] == e[3])):
                found.add(i)
                todo.append(i)
    return sorted((events[i][0], events[i][1], float(events[i][3])) for i in found)


def test_closures_are_those_of_single_steps(spark):
    rng = random.Random(5)
    events = [(rng.choice("abcdefgh"), rng.choice("abcdefgh"), "x", rng.randrange(20)) for _ in range(60)]
    g = graph(spark, events)
    last = max(range(60), key=lambda i: events[i][3])
    key = sum(e[:2] == events[last][:2] for e in events[:last])
    assert ends(traversal.backward(g, Poi(*events[last][:2], key))) == plain_backward(events, last, False)


def test_coverage(spark):
    g = graph(spark, [("u", "v", "x", 1)])
    assert tuple(metrics.truth_coverage(g, truth(spark, ("u", "v"), ("v", "u"), ("x", "y"))).first()) == (1, 1, 2, 1)
    g = graph(spark, [("u", "v", "x", 1), ("u", "v", "x", 2), ("u", "w", "x", 3)])
    assert tuple(metrics.edge_confusion(g, truth(spark, ("u", "v"), ("x", "y"))).first()) == (1, 1, 2)
    assert tuple(metrics.graph_stats(g).first()) == (3, 3, 2)


def test_windows_and_rarity(spark):
    assert features.boundaries(0, 100, 10) == [10, 20, 40, 70, 110, 160, 220, 290, 370, 460]
    g = graph(spark, [("a", "b", "x", t) for t in (0, 10, 40, 41, 100)])
    rows, n = features.time_buckets(g)
    assert [r.win for r in rows.orderBy("start_time").collect()] == [0, 0, 2, 3, 4]
    assert n == 10
    assert features.rarity(g).where("node = 'a'").first().idf == pytest.approx(math.log(10 / 5))


def test_features_and_weights(spark):
    g = graph(spark, [("a", "b", "x", 1, 1, 5), ("b", "c", "write", 2, 2, 9), ("a", "c", "x", 1.5, 1.5, 7)])
    rows = features.edge_features(g, Poi("b", "c", 0))
    own = rows.where("src = 'b'").first()
    assert own.fs == pytest.approx(10_000)
    assert own.ft == pytest.approx(math.log(1 + 1e10))
    for compat in (False, True):
        sums = features.edge_weights(rows, compat=compat).groupBy("src").agg(F.sum("weight").alias("s")).collect()
        assert all(r.s == pytest.approx(1) for r in sums)
    assert features.discriminant_weights(rows, restarts=2).count() == 3


def test_propagation(spark):
    g = graph(spark, [("a", "b", "x", 1), ("b", "c", "x", 2), ("a", "d", "x", 1), ("d", "b", "x", 1)])
    w = g.edges.withColumn("weight", F.when(F.col("src") == "a", 0.5).otherwise(1.0))
    found = {r.node: r.score for r in propagation.propagate(g, w, Poi("b", "c", 0)).collect()}
    assert found == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}
    half = w.withColumn("weight", F.when(F.col("src") == "d", 0.5).otherwise(F.col("weight")))
    for f in (propagation.propagate, propagation.propagate_rounds):
        found = {r.node: r.score for r in f(g, half, Poi("b", "c", 0)).collect()}
        assert (found["d"], found["a"]) == (pytest.approx(0.5), pytest.approx(0.75))


def test_ranking(spark):
    g = graph(spark, [("a", "b", "x", 1), ("b", "a", "x", 2), ("c", "c", "x", 0), ("c", "a", "x", 3)])
    assert [r.node for r in ranking.entry_nodes(g).collect()] == ["a"]
    rows = [(n, {"f": "file", "s": "socket", "p": "process"}[n[0]], i, 1.0 - i / 10) for i, n in enumerate(["f1", "f2", "s1", "p1", "p2"])]
    scored = spark.createDataFrame(rows, "node string, type string, node_ord long, score double")
    chosen = ranking.seeds(ranking.rank_by_type(scored), 2).orderBy("position")
    assert [r.node for r in chosen.collect()] == ["f1", "s1", "p1", "f2", "p2"]


def test_taint(spark):
    events = [("a", "f1", "write", 1), ("s1", "a", "recvfrom", 2), ("a", "f2", "write", 3), ("f2", "b", "read", 4), ("b", "c", "clone", 3.5), ("b", "d", "clone", 5)]
    assert [e[:2] for e in ends(reduction.semantic_compress(graph(spark, events)))] == [("a", "f2"), ("b", "d"), ("f2", "b"), ("s1", "a")]


def test_missing_truth_is_added(spark):
    origin = graph(spark, [("a", "b", "x", 1), ("a", "b", "x", 2), ("c", "d", "x", 3)])
    small = graph(spark, [("c", "d", "x", 3)])
    full = traversal.add_missing_truth(small, origin, truth(spark, ("a", "b")), None)
    assert ends(full) == [("a", "b", 1.0), ("a", "b", 2.0), ("c", "d", 3.0)]
    assert full.nodes.count() == 4
