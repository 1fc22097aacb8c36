"""The sequential propagation against its definition written out, and on a graph of very many repeated visits."""

import time
from collections import deque

import numpy as np
import pytest

from tests.graphs import graph
from tracegrain.model import Poi
from tracegrain.operators import features, propagation


def plain(n, pairs, source, target):
    after, before = {}, {}
    for s, d, w in pairs:
        after.setdefault(s, []).append((d, w))
        before.setdefault(d, []).append(s)
    value, queue, marked = {source: 1.0, target: 1.0}, deque([source]), {target}
    while queue:
        x = queue.popleft()
        marked.add(x)
        queue.extend(p for p in before.get(x, ()) if p not in marked)
        value[x] = sum(w * value[d] for d, w in after.get(x, ()) if d in value)
    for x in range(n):
        value.setdefault(x, 1.0)
    for _ in range(propagation.ROUNDS):
        change = 0.0
        for x in range(n):
            if x not in (source, target):
                new = sum(w * value[d] for d, w in after.get(x, ()))
                change += abs(new - value[x])
                value[x] = new
        if not change > propagation.TOLERANCE:
            break
    return [value[x] for x in range(n)]


def arrays(pairs):
    src, dst, w = zip(*pairs, strict=True)
    return np.array(src), np.array(dst), np.array(w, float)


@pytest.mark.parametrize("seed", range(40))
def test_random_graphs_as_defined(seed, monkeypatch):
    monkeypatch.setattr(propagation, "ROUNDS", (1, 3, 100)[seed % 3])  # few sweeps show the start
    r = np.random.default_rng(seed)
    n = int(r.integers(2, 70 if seed % 4 else 120))
    ends = {(int(a), int(b)) for a, b in r.integers(0, n, (int(r.integers(1, 4 * n)), 2))}
    if seed % 4 == 0:  # a chain: as many levels as nodes
        ends |= {(i + 1, i) for i in range(n - 1)}
    ends = [tuple(e) for e in r.permutation(sorted(ends)).tolist()]
    total = {s: r.uniform(0.8, 2) * sum(a == s for a, _ in ends) for s, _ in ends}
    lost = set(r.choice(n, 2).tolist()) if seed % 5 == 0 else set()  # null weights
    pairs = [(a, b, float("nan") if a in lost else 1 / total[a]) for a, b in ends]
    source, target = ends[0]
    want = plain(n, pairs, source, target)
    assert propagation.scores(n, *arrays(pairs), source, target) == pytest.approx(want, abs=1e-12, nan_ok=True)


def test_repeated_visits_cost_little():
    # event <- 100 files <- 1,000 processes each <- 20 hubs: two million repeated visits of hubs
    files, processes, hubs = range(2, 102), range(102, 1102), range(1102, 1122)
    ends = [(0, 1), *((f, 0) for f in files), *((p, f) for f in files for p in processes), *((h, p) for p in processes for h in hubs)]
    left = {s: 1 / sum(1 for _ in g) for s, g in ((0, [1]), *((f, [0]) for f in files), *((p, files) for p in processes), *((h, processes) for h in hubs))}
    began = time.monotonic()
    found = propagation.scores(1122, *arrays([(a, b, left[a]) for a, b in ends]), 0, 1)
    assert time.monotonic() - began < 30
    assert found == pytest.approx(np.ones(1122))


def test_names_meet_their_scores(spark):
    g = graph(spark, [("b", "f1", "write", 5), ("a", "b", "x", 1), ("f2", "b", "read", 2), ("a", "f2", "write", 0), ("z", "a", "x", -1), ("z", "z", "x", -2), ("b", "a", "x", 3)])
    weights = features.edge_weights(features.edge_features(g, Poi("b", "f1", 0)))
    nodes = [r.node for r in g.nodes.orderBy("node_ord").collect()]
    rows = propagation.pair_weights(weights).orderBy("pair_ord").collect()
    want = plain(len(nodes), [(nodes.index(r.src), nodes.index(r.dst), r.w) for r in rows], nodes.index("b"), nodes.index("f1"))
    found = propagation.propagate(g, weights, Poi("b", "f1", 0))
    assert found.columns == [*g.nodes.columns, "score"]
    assert {r.node: r.score for r in found.collect()} == pytest.approx(dict(zip(nodes, want, strict=True)))
