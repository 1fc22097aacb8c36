import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import topk


@pytest.mark.parametrize(("n", "d", "spread"), [(400, 64, 100), (50, 7, 3), (3, 2, 1), (300, 40, 2**27)])
def test_blocks_match_brute_force(n, d, spread):
    rng = np.random.default_rng(n)
    m = rng.integers(-spread, spread + 1, (n, d)) * (np.arange(d) % 3 + 1)
    m[n // 2 :] = m[: n - n // 2]  # ties
    ids = rng.permutation(n).astype(np.int64)
    exact = m.astype(object) @ m.T.astype(object)
    for i, got, scores in topk.search_block(ids, m, ids, m, 5):
        rest = [j for j in range(n) if ids[j] != ids[i]]
        want = sorted(((-exact[i][j], ids[j]) for j in rest))[:5]
        assert [(-s, v) for s, v in zip(scores.tolist(), got.tolist(), strict=True)] == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], "x"), (1, [1.0, 0.5], "x"), (2, None, "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (6, [1.0], "x"), (50, [0.5, -0.001], "x"), (50, [0.5, -0.001], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    # 256 * -0.001 rounds down to -1; the repeated row is one query and two candidates
    assert [tuple(r) for r in got] == [(0, 1, 1, 81920), (0, 2, 50, 32640), (0, 3, 50, 32640), (50, 1, 0, 32640), (50, 2, 1, 32640)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_products_beyond_64_bits_are_an_error(spark):
    ids, m = np.arange(3), np.full((3, 64), 25_600_000_000)
    with pytest.raises(OverflowError):
        list(topk.search_block(ids, m, ids, m, 2))
    df = spark.createDataFrame([(i, [1e8] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="can leave 64 bits"):
        topk.top_k(df, F.lit(True)).collect()
