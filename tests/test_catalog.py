"""Queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from tracegrain.plans import catalog, catalog_more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["back_graph", "forward_transitive", "dedup_redundant", "semantic_compress", "edge_weights_compat", "seed_sweep", "session_texts", "plain_sequences", "similarity_matrix", "propagate_k", *sorted(n for n in vars(catalog_more) if n in catalog.ORACLES)])
def test_query_and_sql_agree(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    both = [x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert both[0].equals(both[1])
    assert dict(both[0].dtypes) == dict(both[1].dtypes)
