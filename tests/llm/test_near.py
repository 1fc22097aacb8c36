"""MinHash, components and spot signatures against plain versions."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracegrain.llm import components, minhash, queries, spotsigs


def texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out += [" ".join(t)] * rng.choice([1, 1, 2])
    return [*out, "", None, " \n", "one two", "One  TWO", "three", "a b c d e"]


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = tuple((t or "").lower().split())
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} or ({w} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}


def test_groups_match_all_pairs(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, comp string, n int")
    assert found(df) == plain_components(rows)


@pytest.mark.parametrize(("rounds", "block"), [(0, 2048), (0, 3), (1, 5)])
def test_rows_that_hubs_leave_meet_in_blocks(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = list(enumerate(texts(9)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


def test_texts_alike_below_the_threshold_make_no_rows_of_pairs(spark):
    rng, passage = random.Random(5), [f"p{i}" for i in range(120)]
    rows = [(i, " ".join([*passage, *[f"x{rng.randrange(10**6)}" for _ in range(45)]])) for i in range(150)]
    rows += [(150, rows[0][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert len({c for _, c, _ in want.values()}) == 150
    assert found(df) == want


def test_blocks_pass_on_spanning_forests():
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(99)) for _ in range(300)]
    docs = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(40)] + [" ".join(rng.sample(base, 300)) for _ in range(10)]
    n = len(docs)
    sets = [minhash.shingles(minhash.word_hashes(t)[0]) for t in docs]
    marks = [(minhash.signature(s) & 255).astype(np.uint8).tobytes() for s in sets]
    side = {"bucket": [1] * n, "bx": [0] * n, "by": [0] * n, "node": range(n), "n": [len(s) for s in sets], "comp": range(n), "minor": [True] * n, "marks": marks, "text": docs}
    table = pa.concat_tables([pa.table({**side, "side": [s] * n}) for s in (0, 1)])
    links = minhash._linked(table).to_pylist()
    assert len(links) == 39  # 780 pairs are similar
    assert all(len(np.intersect1d(sets[x["a"]], sets[x["b"]])) * 4 >= 3 * len(np.union1d(sets[x["a"]], sets[x["b"]])) for x in links)
    rows = [minhash._survivors(table).to_pydict()["node"]]
    assert set(rows[0]) == set(range(40))


def test_no_ids_repeated_rows_and_no_rows(spark):
    long = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, long, 3), (None, "alone here", 4), (7, None, 5), (5, "another text", 6), (None, "", 7), (None, "", 8)], "doc_id long, text string, x int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (5, 5, True), (7, 7, True), (None, 5, False), (None, None, True), (None, None, True), (None, None, True)], key=str)
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted([long, "alone here", "another text", "", "", ""])
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_any_long_is_an_id(spark):
    text = " ".join(map(str, range(40)))
    ids = [-(1 << 63), (1 << 62) + 5, (1 << 62) + 9, (1 << 63) - 1]
    df = spark.createDataFrame([(ids[1], text), (ids[2], text + " end"), (ids[0], "other words"), (ids[3], "other  Words")], "doc_id long, text string")
    assert found(df) == {ids[0]: (1, ids[0], True), ids[1]: (36, ids[1], True), ids[2]: (37, ids[1], False), ids[3]: (1, ids[0], False)}


def test_a_very_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(f"Wort{i}\t" for i in range(5000)) + " " + "x" * 9000
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "PIECE", 100)
    pieces = minhash.word_hashes(text)
    assert whole[1] == pieces[1] and (whole[0] == pieces[0]).all() and len(whole[0]) == 5001


def test_groups_equal_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op7_minhash(spark, sf)
    want = con.execute(queries.OP7_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns].equals(want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 1600 / 2400) < 0.15


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.comp for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_fingerprints_and_edited_texts(spark, tmp_path):
    rows = list(enumerate([*texts()[:15], "", None, "été " * 3, "the cat and the dog in the house of a man " * 9, "!!"]))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op8_spotsigs(spark, str(tmp_path)).collect())
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for k, r in enumerate(got):
        text, after = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sets = [set(spotsigs.signatures(t).tolist()) for t in (text, edited, after)]
        near = [1.0 if not sets[0] | x else len(sets[0] & x) / len(sets[0] | x) for x in sets[1:]]
        near = [x if x >= queries.LEAST_LIKENESS else 0.0 for x in near]
        assert (r.near_edited, r.near_next) == tuple(near)
    same = {}
    for (_, t), r in zip(rows, got, strict=True):
        assert same.setdefault(t or "", r.fingerprint) == r.fingerprint


def test_texts_with_few_anchors_keep_half_their_signatures():
    words = [f"w{i}" for i in range(240)]
    cells = " | ".join(words)
    one_spot = " ".join([*words[:100], "the", *words[100:]])
    last_spot = " ".join([*words, "the", "x", "y", "z"])
    lists = " ".join(f"{w} und" if i % 40 == 0 else w for i, w in enumerate(words))
    only_anchors = " ".join(["of the and to in a is"] * 30 + ["x y z"])
    again = "Ating. " * 160
    other = " ".join(f"v{i} the" if i % 9 == 0 else f"v{i}" for i in range(240))
    for text in (cells, one_spot, last_spot, lists, only_anchors, again):
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        whole, half = spotsigs.signatures(text), spotsigs.signatures(edited)
        assert spotsigs.likeness(whole, half) > 0.2
    # an anchor more changes what is near it only
    assert spotsigs.likeness(spotsigs.signatures(cells), spotsigs.signatures(one_spot)) > 0.9


def test_no_stretch_is_without_signatures():
    rng = random.Random(2)
    reach = spotsigs.REACH * spotsigs.CHAIN + 1
    for share in (0.0, 0.01, 0.1, 0.5, 0.9, 1.0):
        words = [rng.choice(["the", "of", "und"]) if rng.random() < share else f"w{i}" for i in range(400)]
        base = set(spotsigs.signatures(" ".join(words)).tolist())
        for at in range(0, 400 - reach, 7):  # a stretch with other words has lost signatures
            new = [f"n{i}" for i in range(reach)]
            got = set(spotsigs.signatures(" ".join([*words[:at], *new, *words[at + reach :]])).tolist())
            assert len(got - base) >= 1
            assert len(got - base) <= 3 * reach
            assert base - got


def test_next_of_ties_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, None)], "doc_id long, text string")
    got = sorted((r.text, r.next_text) for r in spotsigs.with_next(df).collect())
    assert got == [("", "n"), ("a", "b"), ("b", ""), ("n", "a")]
    assert [tuple(r) for r in spotsigs.with_next(df.where("doc_id = 2")).collect()] == [(2, "", "")]
    assert spotsigs.with_next(df.limit(0)).count() == 0


def test_ranges_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 60)
    rng = random.Random(1)
    rows = [(rng.randrange(-(10**12), 10**12), f"text {i} " * rng.randrange(9), i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int, tail string").repartition(3)
    got = {r.doc_id: (r.text, r.next_text) for r in spotsigs.with_next(df).collect()}
    order = sorted(rows)
    assert got == {r[0]: (r[1], order[(k + 1) % 200][1]) for k, r in enumerate(order)}


def test_near_pairs_match_all_pairs(spark):
    rows = list(enumerate(texts(6)))
    pairs, member = spotsigs.near_pairs(spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string"))
    sets = {i: spotsigs.signatures(t) for i, t in rows}
    reps = {}
    for i, _ in rows:
        reps.setdefault(spotsigs.pack(sets[i]), i)
    want = {}
    for i in reps.values():
        for j in reps.values():
            if i < j and len(sets[i]) and len(sets[j]) and (x := spotsigs.likeness(sets[i], sets[j])) >= 0.75:
                want[i, j] = x
    assert {(r.a, r.b): r.likeness for r in pairs.collect()} == want
    assert {r.doc_id: r.rep for r in member.collect()} == {i: reps[spotsigs.pack(s)] for i, s in sets.items()}


def test_sets_exactly_at_the_threshold_are_compared(spark):
    a = np.arange(100, dtype=np.uint32)
    assert 100 * 0.55 > 55 and spotsigs.likeness(a[:55], a, 0.55) == 0.55
    assert all(spotsigs.likeness(a[:k], a, k / 100) == k / 100 for k in range(1, 101))
    words = [f"w{i}" for i in range(102)]  # 100 chains, of which 55
    rows = [(1, " ".join(words)), (2, " ".join(words[:57])), (3, " ".join(words[:56]))]
    sizes = [len(spotsigs.signatures(t)) for _, t in rows]
    assert sizes[1] / sizes[0] > sizes[2] / sizes[0]
    least = sizes[1] / sizes[0]
    pairs, _ = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), least=least)
    assert (1, 2) in {(r.a, r.b) for r in pairs.collect()} and (1, 3) not in {(r.a, r.b) for r in pairs.collect()}


def test_pruned_likeness_is_exact_above_the_threshold():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint32)) for _ in range(2))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pruned = spotsigs.likeness(a, b, 0.6)
        assert pruned == (exact if exact >= 0.6 else pruned)
        assert exact >= 0.6 or pruned in (0.0, exact)
        assert spotsigs.likeness(a, b) == exact
