import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrain.llm import packing


def one_by_one(items, capacities, opening):
    """Best-fit decreasing, a piece at a time: the first opened of the fullest bins that take it."""
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            bins.append(b := [opening[sum(c < x for c in capacities)], 0])
        b[0] -= x
        b[1] += x
    return sorted((used, min(c for c in capacities if c >= used)) for _, used in bins)


CAPACITIES = (10, 20, 40)
RULES = [(a, b, 40) for a in CAPACITIES for b in (20, 40)]


def histogram(items):
    return np.unique(np.array(items, np.int64), return_counts=True)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from(RULES))
def test_groups_pack_like_single_pieces(items, opening):
    plan = packing.pack(*histogram(items), CAPACITIES, opening)
    assert sorted((u, c) for _, m, u, c in plan.groups.tolist() for _ in range(m)) == one_by_one(items, CAPACITIES, opening)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_no_single_rule_is_cheaper(items):
    single = [packing.pack(*histogram(items), CAPACITIES, packing.uniform(CAPACITIES, c)).cost for c in (None, *CAPACITIES)]
    best = packing.best_plan(*histogram(items), CAPACITIES)
    every = [packing.pack(*histogram(items), CAPACITIES, r).cost for r in RULES]
    assert min(every) <= best.cost <= min(single)


def test_sizes_chosen_jointly_beat_every_single_rule():
    rng, won, sizes = np.random.default_rng(0), 0, (16, 24, 40)
    for _ in range(50):
        items = rng.integers(1, 41, 30).tolist()
        single = min(packing.pack(*histogram(items), sizes, packing.uniform(sizes, c), 4).cost for c in (None, *sizes))
        won += packing.best_plan(*histogram(items), sizes, 4).cost < single
    assert won > 0


def check(rows, lengths, capacities):
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.n_tokens
        assert {(r.bin_tokens, r.bin_capacity) for r in own} == {(at, min(c for c in capacities if c >= at))}
    assert {i: sum(r.n_tokens for r in d) for i, d in docs.items()} == lengths
    for d in docs.values():
        assert sorted(r.piece for r in d) == list(range(len(d)))


def test_every_token_has_one_place(spark):
    rng = np.random.default_rng(1)
    lengths = {i: int(n) for i, n in enumerate([*rng.integers(1, 3000, 300), *[77] * 200, 20_000, 8192])}
    df = spark.createDataFrame([(i, "w " * (n - 1), "x", 1) for i, n in lengths.items()], "doc_id long, text string, bin_id string, rank int")
    check(packing.best_fit(df).collect(), lengths, packing.CAPACITIES)


def test_nulls_ties_and_no_rows(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, ""), (1, ""), (2, "a b")], "doc_id long, text string")
    got = packing.best_fit(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 1, 3]
    assert {(r.bin_id, r.bin_capacity) for r in got} == {(0, 512)}
    assert sorted(r.bin_offset for r in got) == [0, 3, 4, 5, 6]
    assert packing.best_fit(df.limit(0)).count() == 0
