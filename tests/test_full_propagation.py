"""The queries on the whole propagation, on a deep graph."""

import numpy as np
import pytest

from tests.graphs import graph, truth
from tracegrain.model import Poi
from tracegrain.operators import features
from tracegrain.plans import catalog


@pytest.fixture
def deep(spark, monkeypatch):
    names = [*"pqrtu", "f1", "f2", "s1", "v", "w", "z"]  # each to the next, then z to the event's file
    events = [(a, b, "x", 10 * i, 10 * i + 2, 5 * i) for i, (a, b) in enumerate(zip(names[:-1], names[1:], strict=True))]
    events += [("q", "f1", "write", 45, 46, 900), *[("z", "p", "x", -5 - i, -4, 100) for i in range(12)], ("s1", "z", "recvfrom", 72, 73, 3), ("z", "f9", "write", 200, 201, 100)]
    g, poi = graph(spark, events), Poi("z", "f9", 0)
    monkeypatch.setattr(catalog, "_SCORED", {})
    monkeypatch.setattr(catalog, "_back", lambda spark, d: (g, poi, truth(spark, ("z", "f9"), ("f1", "f2"))))
    return g, poi


def solved(g, poi):
    """Each score is the weighted sum of its successors' scores; the event's ends are fixed."""
    rows = features.edge_weights(features.edge_features(g, poi), compat=True).select("src", "dst", "weight").collect()
    names = sorted({n for r in rows for n in (r.src, r.dst)})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.src], at[r.dst]] += r.weight
    fixed = {poi.dst: 1.0, poi.src: m[at[poi.src], at[poi.dst]] + m[at[poi.src], at[poi.src]]}
    right = np.zeros(len(names))
    for n, v in fixed.items():
        m[at[n]], right[at[n]] = 0.0, v
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - m, right), strict=True))


def test_all_six_run_the_whole_propagation(spark, deep):
    want = solved(*deep)
    scores = {r.node: r.score for r in catalog.QUERIES["propagate_full"](spark, "").collect()}
    assert scores == pytest.approx(want, abs=1e-7)
    rounds = {r.node: r.score for r in catalog.QUERIES["propagate_k"](spark, "").collect()}
    assert rounds == pytest.approx(want, abs=1e-6)  # the same fixed point
    ranked = catalog.QUERIES["rank_by_type_full"](spark, "").collect()
    for kind in ("file", "socket", "process"):
        own = sorted((r for r in ranked if r.type == kind), key=lambda r: r.rank)
        assert [r.score for r in own] == sorted((scores[r.node] for r in own), reverse=True)
    seeds = catalog.QUERIES["seeds_topn_full"](spark, "").collect()
    assert {(r.node, r.rank) for r in seeds} == {(r.node, r.rank) for r in ranked if r.rank <= 7}
    sweep = {r.n: (r.edges, r.tp, r.fp, r.fn) for r in catalog.QUERIES["seed_sweep_full"](spark, "").collect()}
    rank, pairs, edges = {r.node: r.rank for r in ranked}, {("z", "f9"), ("f1", "f2")}, [(r.src, r.dst) for r in deep[0].edges.collect()]
    for n, got in sweep.items():
        inside = [e for e in edges if rank[e[0]] <= n]
        hits = [e for e in inside if e in pairs]
        assert got == (len(inside), len(hits), len(inside) - len(hits), len(pairs) - len(set(hits)))
    for name in ("entry_ranking_full", "root_entries_full"):
        assert all(r.score == scores[r.node] for r in catalog.QUERIES[name](spark, "").collect())
    assert not {n for n in catalog.ORACLES if n.endswith("_full")}
