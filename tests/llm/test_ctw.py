import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tracegrain.llm import ctw, queries


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


class Tree:
    """Context-tree weighting by the book: one recursive tree for each bit prefix."""

    def __init__(self, depth):
        self.depth, self.counts = depth, {}

    def learn(self, data):
        for at in range(self.depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | (data[at] >> (8 - k)), data[at] >> (7 - k) & 1
                for d in range(self.depth + 1):
                    self.counts.setdefault((node, data[at - d : at]), [0, 0])[bit] += 1
        self.children = {}
        for node, context in self.counts:
            if context:
                self.children.setdefault((node, context[1:]), []).append(context)

    def log_e(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_w(self, node, context):
        e = self.log_e((node, context))
        if len(context) == self.depth:
            return e
        return np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(self.log_w(node, c) for c in self.children.get((node, context), [])))

    def bit(self, node, past, bit):
        p = None
        for d in range(self.depth, -1, -1):
            context = past[len(past) - d :]
            pair = self.counts.get((node, context), (0, 0))
            kt = (pair[bit] + 0.5) / (sum(pair) + 1)
            w = 1.0 if p is None else math.exp(math.log(0.5) + self.log_e((node, context)) - self.log_w(node, context))
            p = kt if p is None else w * kt + (1 - w) * p
        return p

    def log10(self, data):
        total = 0.0
        for at in range(self.depth, len(data)):
            for k in range(8):
                total += math.log10(self.bit((1 << k) | (data[at] >> (8 - k)), data[at - self.depth : at], data[at] >> (7 - k) & 1))
        return total


@pytest.mark.parametrize("depth", [3, 4])
def test_scores_match_the_recursive_tree(spark, depth):
    texts = ["The cat sat", "the  hat\n sat", None, "", "é É zz", "a cat a cat a cat", "the cat sat"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = queries.fold(7) != 2
    got = {r.doc_id: r for r in ctw.score(df, train, depth=depth).collect()}
    bodies = {i: ctw.body(ctw.normal(t), depth) for i, t in rows}
    tree = Tree(depth)
    learned = [i for i, _ in rows if not held(i)]
    joined = Tree(depth)
    for i in learned:
        joined.learn(bodies[i])
    tree = joined
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    c = Counter(w for i in learned for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, _ in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words[i]), sum(w in c for w in words[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]))
        assert r.score == pytest.approx(tree.log10(bodies[i]), rel=1e-8)


def test_probabilities_add_up(monkeypatch):
    """Over all 256 bytes, whatever the context."""
    rng = np.random.default_rng(0)
    data = [ctw.body(bytes(rng.choice(list(b"ab c"), 50)), 4) for _ in range(5)]
    context = data[0][10:14]
    every = [context + bytes([b]) for b in range(256)]
    keys, _ = ctw.gram_keys(data, 4)
    asked, _ = ctw.gram_keys(every, 4)
    allkeys, inverse = np.unique(np.concatenate([keys, asked]), return_inverse=True)
    counts = np.bincount(inverse[: len(keys)], minlength=len(allkeys))
    near = allkeys >> 16
    low = pa.Table.from_batches(ctw._summary(4)([pa.record_batch({"near": near, "key": allkeys, "n": counts})])).to_pandas()
    low = low.groupby(["c2", "node"], as_index=False).sum()
    second = next(iter(ctw._second([pa.RecordBatch.from_pandas(low)]))).to_pandas()
    first = second.assign(c1=second.c2 // 256).groupby(["c1", "node"], as_index=False)[["n0", "n1", "log_w"]].sum()
    top = ctw.Top(*(first[c].to_numpy() for c in ("c1", "node", "n0", "n1", "log_w")))
    nodes = pd.DataFrame({"near": np.unique(near)}).assign(c2=lambda x: x.near // 256).merge(second, on="c2")
    nodes = pd.DataFrame({"near": nodes.near, "kind": 0, "key": nodes.node, "n0": nodes.n0, "n1": nodes.n1, "share": nodes.share})
    rows = pd.concat([nodes, pd.DataFrame({"near": near, "kind": 1, "key": allkeys, "n0": counts.astype(float), "n1": 0.0, "share": 0.0})]).sort_values(["near", "kind", "key"])
    found = {}
    for size in (1, 7, 10**6):  # however the rows are cut
        ctw_rows = [pa.RecordBatch.from_pandas(rows.iloc[i : i + size], preserve_index=False) for i in range(0, len(rows), size)]
        monkeypatch.setattr(ctw, "SOLVE_ROWS", size)
        v = pa.Table.from_batches(ctw._values(4, top)(ctw_rows))
        found[size] = dict(zip(v.column("key").to_pylist(), v.column("value").to_pylist(), strict=True))
    assert found[1] == pytest.approx(found[7])
    assert found[1] == pytest.approx(found[10**6])
    assert sum(10 ** found[7][x] for x in asked) == pytest.approx(1)


def test_long_texts_and_small_chunks(spark, monkeypatch):
    """Pieces, parts and chunks of any size give the same scores."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "cd", "é", "the", "x" * 50], 400)) for _ in range(12)] + ["", None, "  \n "]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, key int, chunk string").repartition(2)
    want = sorted(ctw.score(df, queries.fold(7) != 2).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in want] == [len((t or "").split()) + 1 for t in texts]
    rows = df.select("doc_id", (queries.fold(7) == 2).alias("held_out"), "text")
    for chunk, part, block in ((3000, 700, 90), (10**9, 500, 64)):
        for name, value in (("CHUNK", chunk), ("PART", part), ("BLOCK", block)):
            monkeypatch.setattr(ctw, name, value)
        packed = pa.Table.from_batches(run_in_process(ctw._pack(5, 1), [pa.RecordBatch.from_pandas(rows.toPandas(), preserve_index=False)]))
        stream = [r for r in packed.to_pylist() if r["kind"] <= ctw.TEXTS]
        assert (len({r["chunk"] for r in stream}) == 1) == (chunk == 10**9)
        grams = {}
        for r in packed.to_pylist():
            if r["kind"] == ctw.GRAM:
                grams[r["key"]] = grams.get(r["key"], 0) + r["n"]
        whole = [ctw.body(ctw.normal(t), 5) for i, t in enumerate(texts) if not held(i)]
        keys, n = np.unique(ctw.gram_keys(whole, 5)[0], return_counts=True)
        assert {k: c for k, c in grams.items() if c} == dict(zip(keys.tolist(), n.tolist(), strict=True))


def run_in_process(f, batches):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    before, ctw.TaskContext = ctw.TaskContext, Context
    try:
        return list(f(batches))
    finally:
        ctw.TaskContext = before


def test_scores_do_not_depend_on_pieces():
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["ab", "cd", "ef", "é"], 500))
    keys = np.unique(ctw.gram_keys([ctw.body(ctw.normal(text))])[0])
    words = np.unique(ctw.word_keys(ctw.entries(text)[0][1], True))
    parts = {ctw.OWN: [(words, np.ones(len(words)))], ctw.WORDS: [], ctw.GRAMS: [(keys, -1.0 - (keys % 97) / 100)]}
    got = []
    for block in (10**6, 50, 333):
        before, ctw.BLOCK = ctw.BLOCK, block
        try:
            chunk, blobs = ctw._Chunk(0, 5), []
            for i in range(3):
                blobs += list(chunk.add(i, False, text))
            blobs.append(chunk._texts())
            scorer = ctw._Scorer(5, 10, 5, parts)
            got.append([tuple(r.values()) for b in blobs for out in scorer(b.column(5)[0]) for r in out.to_pylist()])
        finally:
            ctw.BLOCK = before
    for x in got:
        assert [r[:5] for r in x] == [(i, False, 501, 501, 10) for i in range(3)]
        assert np.array([r[5:] for r in x]) == pytest.approx(np.array([r[5:] for r in got[0]]))


def test_no_rows_and_no_training(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    from pyspark.sql import functions as F

    assert ctw.score(df.limit(0), F.lit(True)).count() == 0
    r = ctw.score(df, F.lit(False)).first()
    assert r.train_tokens == 0 and r.score == pytest.approx(32 * math.log10(0.5))
    assert r.bits_per_byte == pytest.approx(8)


def test_a_very_long_text_is_counted_in_blocks(monkeypatch):
    """No array follows the length of a text: the largest block stays near ``BLOCK``."""
    seen, count = [], ctw.gram_keys

    def watched(bodies, depth):
        seen.append(sum(map(len, bodies)))
        return count(bodies, depth)

    monkeypatch.setattr(ctw, "gram_keys", watched)
    chunk, packed = ctw._Chunk(0, 5), 0
    for r in chunk.add(1, False, "some words of a text " * 400_000):
        packed += r.num_rows
    assert packed >= 3  # texts leave in parts, too
    list(chunk.close())
    assert sum(seen) > 8_000_000 and max(seen) < 2 * ctw.BLOCK + 1000
