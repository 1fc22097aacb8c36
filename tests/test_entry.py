import json

import __spark_entry__ as entry
from tests.graphs import ends, graph
from tracegrain.plans import catalog
from tracegrain.sources import store
from tracegrain.sources.config import Config


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry_gives_a_report(spark):
    row = entry.entry(spark).first()
    assert row["edges"] > 0 and row["nodes"] > 0


def test_graphs_and_tables_come_back(spark, tmp_path):
    g = graph(spark, [("a", "b", "x", 1)])
    store.save_graph(g, f"{tmp_path}/g")
    assert ends(store.read_graph(spark, f"{tmp_path}/g")) == ends(g)
    rows = spark.createDataFrame([("k", ["a", "b"]), ("l", [])], "key string, value array<string>")
    store.save_map(rows, f"{tmp_path}/m")
    assert sorted(store.read_map(spark, f"{tmp_path}/m").collect()) == sorted(rows.collect())
    store.save_lines(rows.select(store.list_text("value").alias("value")), f"{tmp_path}/l")
    assert sorted(r.value for r in store.read_lines(spark, f"{tmp_path}/l", schema="array<string>").collect()) == [[], ["a", "b"]]
    parts = store.split_even(spark.range(10), 3, "id").groupBy("part").count().orderBy("part").collect()
    assert [tuple(r) for r in parts] == [(1, 4), (2, 3), (3, 3)]
    files = store.Files(spark)
    assert files.exists(f"{tmp_path}/m") and files.remove(f"{tmp_path}/m") == 1 and not files.exists(f"{tmp_path}/m")


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"ground_truth": {"c": [["a", "b"]]}, "poi_events": {"c": ["a", "b", 0]}, "windows": {"c": 3}, "metadata": {"dot_file_names": ["c"]}}))
    config = Config.load(str(tmp_path / "c.json"))
    config.check()
    assert config.windows == {"c": 3}
    assert config.graph_path("data", "c") == "data/graph/dot/back/c"
