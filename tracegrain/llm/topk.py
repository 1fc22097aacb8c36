"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates are kept in a vertical layout (one contiguous run per dimension).
Scores accumulate one block of dimensions at a time; after each block a
Cauchy-Schwarz bound on the mass of the remaining dimensions removes the
candidates that can no longer reach the k-th best score, and the survivors are
compacted before the next block is read. The answer is exact.

Spark deals queries and candidates into blocks; each pair of blocks is one
group of bounded size, and the partial top-k lists meet in a per-query window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of queries and of candidates, and dimensions read at a time.
QUERY_BLOCK, CANDIDATE_BLOCK, DIM_BLOCK = 2048, 8192, 16
#: Queries whose first block of dimensions is multiplied in one go.
TILE = 64


def search_block(q_ids, q, c_ids, c, k: int, dim_block: int = DIM_BLOCK):
    """Top-k of one block of candidates for one block of queries.

    ``q`` and ``c`` are integer matrices of the same width. Yields
    ``(query index, candidate ids, scores)``, best first, ties to smaller ids.
    """
    nq, d = q.shape
    nc = len(c)
    if nq == 0 or nc == 0:
        return
    norms = [np.sqrt((m.astype(np.float64) ** 2).sum(1)).max() for m in (q, c)]
    if norms[0] * norms[1] >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("integer inner products of these vectors can leave 64 bits")
    top = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(c).max(initial=0), 1)) * max(d, 1)
    kind = np.float64 if top < 2.0**52 else np.int64  # both exact
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(0), kind="stable")  # heavy dimensions first
    vertical = np.ascontiguousarray(c[:, order].T).astype(kind)
    queries = np.ascontiguousarray(q[:, order]).astype(kind)
    cuts = list(range(0, d, dim_block)) or [0]
    slack = 1 + 1e-9

    def remaining(m):  # norms of what is left after each block
        sq = m.astype(np.float64) ** 2
        return [np.sqrt(sq[:, cut + dim_block :].sum(1)) * slack for cut in cuts]

    left_q, left_c = remaining(queries), remaining(vertical.T)
    rows = np.ascontiguousarray(c[:, order]).astype(kind)
    for at in range(0, nq, TILE):
        first = queries[at : at + TILE, :dim_block] @ vertical[:dim_block]
        for i in range(at, min(at + TILE, nq)):
            acc = first[i - at]
            alive = np.flatnonzero(c_ids != q_ids[i])
            if len(alive) == 0:
                continue
            acc = acc[alive]
            if len(alive) > k:  # exact scores of promising candidates give the first threshold
                seeds = alive[np.argpartition(acc, -min(4 * k, len(acc)))[-min(4 * k, len(acc)) :]]
                exact = rows[seeds] @ queries[i]
                floor = np.sort(exact)[-k]
                for b, cut in enumerate(cuts):
                    if b:
                        acc = acc + queries[i, cut : cut + dim_block] @ vertical[cut : cut + dim_block, alive]
                    rest = left_q[b][i] * left_c[b][alive]
                    keep = acc + rest + 1e-15 * (np.abs(acc) + rest) + 1e-6 >= floor  # whatever sums of floats lose
                    if not keep.all():
                        alive, acc = alive[keep], acc[keep]
            else:
                acc = rows[alive] @ queries[i]
            best = np.lexsort((c_ids[alive], -acc))[:k]
            yield i, c_ids[alive][best], acc[best].astype(np.int64)


def _kernel(k: int):
    def run(table: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": [], "qkey": []}
        flags = table.column("is_q").to_numpy()
        ids = table.column("id").to_numpy()
        keys = table.column("qkey").to_numpy()
        dim = table.column("dim")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = flat.reshape(len(ids), dim)
        qi = np.flatnonzero(flags)
        ci = np.flatnonzero(~flags)
        for i, vec_ids, scores in search_block(ids[qi], m[qi], ids[ci], m[ci], k):
            out["query_id"].append(np.full(len(vec_ids), ids[qi[i]]))
            out["qkey"].append(np.full(len(vec_ids), keys[qi[i]]))
            out["vec_id"].append(vec_ids)
            out["score"].append(scores)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` best candidates by integer inner product for each query row.

    Components become ``floor(scale * x)``. Every row but those with the
    query's own id is a candidate. Rows with a null id, a null vector, or a
    null or non-finite component take no part; vectors meet only vectors of the
    same length; an empty vector scores 0. A repeated candidate row counts each
    time; a repeated query row counts once. An empty table gives no rows.
    Returns query_id, rank (from 1), vec_id, score; ties go to smaller vec_id.
    """
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_q"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"), F.size("v").alias("dim"), "is_q")
    )
    n, nq = rows.agg(F.count(F.lit(1)), F.count_if("is_q")).first()
    n_c, n_q = -(-n // CANDIDATE_BLOCK) or 1, -(-(nq or 0) // QUERY_BLOCK) or 1
    queries = rows.where("is_q").dropDuplicates(["id", "v"]).select("id", "v", "dim", F.xxhash64("v").alias("qkey"))
    deal = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.select("id", "v", "dim", "qkey", F.lit(True).alias("is_q"), deal(n_q).alias("qb"), spread(n_c).alias("cb"))
    c = rows.select("id", "v", "dim", F.lit(0).cast("long").alias("qkey"), F.lit(False).alias("is_q"), spread(n_q).alias("qb"), deal(n_c).alias("cb"))
    found = q.unionByName(c).groupBy("qb", "cb", "dim").applyInArrow(_kernel(k), "query_id long, vec_id long, score long, qkey long")
    best = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", best.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
