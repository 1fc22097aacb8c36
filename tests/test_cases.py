"""Runs over cases, the command line, samples and chunks."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.graphs import ends, graph, nodes
from tracegrain import __main__ as cli
from tracegrain.operators import embedding, labels, ranking, reduction
from tracegrain.plans.cases import Runner
from tracegrain.sources import store
from tracegrain.sources.config import Config

EVENTS = [("a", "f1", "write", 1, 2, 10), ("f1", "b", "read", 3, 4, 10), ("b", "s1", "sendto", 5, 6, 20), ("s1", "c", "recvfrom", 7, 8, 20), ("c", "f2", "write", 9, 10, 30), ("q", "f3", "write", 2, 3, 5)]
DATA = {"ground_truth": {"x": [["a", "f1"], ["q", "f3"]], "y": [["c", "f2"]]}, "poi_events": {"x": ["c", "f2", 0], "y": ["c", "f2", 0]}, "metadata": {"dot_file_names": ["x"]}}


@pytest.fixture
def runner(spark, tmp_path):
    g = graph(spark, EVENTS)
    for case in "xy":
        for kind in ("dot/back", "back_add", "origin", "complement"):
            store.save_graph(g, f"{tmp_path}/graph/{kind}/{case}")
        store.save_graph(graph(spark, EVENTS[:5]), f"{tmp_path}/graph/dot/back_compressed/{case}")
    (tmp_path / "c.json").write_text(json.dumps(DATA))
    return Runner(spark, Config.load(f"{tmp_path}/c.json"), str(tmp_path), f"{tmp_path}/out")


def test_cases_run_from_files_to_figures(spark, runner):
    row = runner.investigate("y", save=True)
    assert row["case"] == "y" and row["tp"] == 1 and row["fn"] == 0
    again = runner.resume("y", 7)
    assert {k: again[k] for k in ("nodes", "edges", "tp")} == {k: row[k] for k in ("nodes", "edges", "tp")}
    done = runner.complete("x")
    assert (done["nodes_before"], done["edges_before"], done["edges"], done["tp"], done["fn"]) == (6, 5, 6, 2, 0)
    assert len(ends(store.read_graph(spark, f"{runner.out}/dot/back_add/x"))) == 6
    assert runner.figures("origin", "x")["tp"] == 2 and runner.figures("origin", "y", ("x", "y"))["tp"] == 3
    assert [r["tp"] for r in runner.coverage("x", ("origin", "dot/back_compressed"))] == [2, 1]
    assert runner.baseline("y") is None
    base = runner.baseline("x", save=True)
    kept = runner.baseline_figures("x")
    assert {k: kept[k] for k in ("edges", "fn", "fp", "tp")} == {k: base[k] for k in ("edges", "fn", "fp", "tp")}
    assert all(r.tp + r.fp >= 0 for r in runner.baseline_sweep("x").collect())
    plain = {r.n: (r.edges, r.tp) for r in runner.sweep("origin", "x", clustering=False).collect()}
    far = {r.n: (r.edges, r.tp) for r in runner.sweep("origin", "x", clustering=False, transitive=True).collect()}
    assert plain.keys() == far.keys() and all(far[n][0] >= plain[n][0] for n in plain)
    assert {r.y for r in runner.samples("origin", "x", nodes(spark, "a", "b")).collect()} == {0, 1}


def test_command_line(runner, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("APT_POI_NAMES", raising=False)
    where = ["--config", f"{tmp_path}/c.json", "--data", runner.root, "--out", f"{tmp_path}/o"]
    assert cli.main([*where, "--poi", "y", "--log"]) == 0
    assert "y: {" in next((tmp_path / "o" / "logs").iterdir()).read_text()
    for extra, said in ((["--poi", "nobody"], "unknown or incomplete cases: nobody"),):
        with pytest.raises(SystemExit):
            cli.main([*where, *extra])
        assert said in capsys.readouterr().err
    for data, said in (({}, "no cases"), ({"ground_truth": {"z": []}}, "z"), ({"poi_events": {"z": ["a"]}}, "poi_events['z']"), ({"windows": {"z": 0}}, "windows['z']"), ([], "not a JSON object"), ({**DATA, "metadata": {"dot_file_names": [1]}}, "list of names")):
        (tmp_path / "d.json").write_text(json.dumps(data))
        with pytest.raises(SystemExit):
            cli.main(["--config", f"{tmp_path}/d.json"])
        assert said in capsys.readouterr().err
    monkeypatch.setenv("APT_WINDOWS_NUM", "4")
    monkeypatch.setenv("APT_POI_NAMES", "y, x")
    assert runner.config.windows_of("x") == 4 and runner.config.chosen([]) == ["y", "x"]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 300)), st.integers(1, 40), st.integers(1, 9))
def test_anchors_in_batches_of_any_size(times, window, size):
    t, want = np.array(sorted(times), float), []
    for x in t:
        if not want or x - want[-1] >= window:
            want.append(x)
    got, last = [], -np.inf
    for i in range(0, len(t), size):
        part = t[i : i + size]
        keep = part[reduction.anchors_of(part, window, last)]
        got += keep.tolist()
        last = keep[-1] if len(keep) else last
    assert got == want


def test_one_chatty_pair_is_read_once(spark):
    events = spark.range(300_000).selectExpr("'a' AS src", "'b' AS dst", "'x' AS type", "CAST(id AS DOUBLE) AS start_time")
    assert reduction._anchors(events, 10).count() == 30_000


def test_subsets_of_many_nodes(spark):
    names = nodes(spark, *[f"n{i:02}" for i in range(40)])
    got = labels.combinations(names, 2, 2).groupBy("combo").count().collect()
    assert len(got) == 780 and {r["count"] for r in got} == {2}
    with pytest.raises(ValueError, match="too many"):
        labels.combinations(names)
    assert labels.combinations(nodes(spark, "a", "b", "c")).groupBy("combo").count().count() == 4
    assert labels.combinations(nodes(spark, "a", "b"), 1).groupBy("combo").count().count() == 3
    assert labels.combinations(nodes(spark, "a").limit(0), 1).count() == 0
    assert labels.combinations(nodes(spark, "a"), 2, 5).count() == 0
    with pytest.raises(ValueError, match="combinations"):
        labels.combinations(nodes(spark, *[f"n{i}" for i in range(63)]), 1, 2)


def test_probes_of_bounded_subsets_of_many_nodes(spark):
    many = [f"p{i:02}" for i in range(30)]
    g = graph(spark, [(n, "f1", "write", i) for i, n in enumerate(many)])
    _, probes = labels.probe_sequences(g, nodes(spark, *many), nodes(spark, "f1", "p00"), 1)
    assert sorted((r.combo, r.other) for r in probes.collect()) == [(1 << i, "f1") for i in range(30)]


def test_folds_have_their_share_of_each_class(spark):
    rows = spark.createDataFrame([([i % 7, i], int(i < 18)) for i in range(60)], "ids array<int>, y int")
    found = embedding.cross_validate(rows).collect()
    assert [r.fold for r in found] == list(range(6))
    assert [r.tp + r.fn for r in found] == [3] * 6
    assert [r.fp + r.tn for r in found] == [7] * 6


def test_under_sampling_drops_alike_rows(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1, 2, 3, 5]), (2, [9, 9, 3, 4]), (3, [7, 7, 7, 7])], "id int, ids array<int>")
    kept = lambda n: {r.id for r in labels.under_sample(rows, n).collect()}
    assert kept(4) == {0, 1, 2, 3} and kept(3) == {0, 2, 3} and kept(2) == {0, 3}


def test_classifiers_tell_clear_classes_apart(spark):
    rows = spark.createDataFrame([([1 + i % 3, 2, 3, 1 + i % 5], 1) for i in range(60)] + [([11 + i % 3, 15, 16, 12 + i % 5], 0) for i in range(60)], "ids array<int>, y int")
    one = embedding.train_and_evaluate(rows).first()
    assert one.tp > 10 and one.tn > 10 and one.fp == one.fn == 0
    folds = embedding.cross_validate(rows, 3).collect()
    assert sum(r.tp + r.tn for r in folds) == 120 and len(folds) == 3


def test_a_model_is_set_up_on_the_executor(spark):
    def setup():
        return lambda texts: [np.array([len(t)], np.float32) for t in texts]

    rows = spark.createDataFrame([("p", 0, 1, "abc")], "process string, i int, j int, text string")
    assert [tuple(r) for r in embedding.embed_texts(rows, setup=setup).collect()] == [("p", 0, 1, "abc", [3.0])]


def test_ranks_break_ties_by_name(spark):
    g = graph(spark, [("b", "x", "t", 1), ("a", "x", "t", 1), ("c", "x", "t", 1)])
    scored = g.nodes.selectExpr("*", "CASE node WHEN 'c' THEN 2.0 ELSE 1.0 END AS score")
    assert [tuple(r) for r in ranking.rank_entries(g, scored).orderBy("rank").collect()] == [("c", 2.0, 1), ("a", 1.0, 2), ("b", 1.0, 3)]
