from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrain.llm import chat

ODD = st.text(st.sampled_from("\\#<>/:turn \nAé"), max_size=60)


def windows(turns, budget, history):
    w = chat.Windows(1, budget, history)
    out = [x for role, text in turns if (x := w.add(role, text))]
    return [*out, w.close()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), ODD), ODD), min_size=1, max_size=12), st.integers(1, 60), st.integers(0, 40))
def test_turns_come_back_once_and_in_order(turns, budget, history):
    rows = windows(turns, budget, history)
    back, said = [], []
    for r in rows:
        parsed = chat.parse(r["text"])
        back += parsed[r["n_repeated"] :]
        said += [chat.unescape(r["text"][s["start"] : s["stop"]]) for s in r["loss"]]
        new = len(parsed) - r["n_repeated"]
        assert new >= 1
        assert r["tokens"] == sum(chat.tokens(*t) for t in parsed)
        assert r["tokens"] <= budget or new == 1
        if r["window"] and turns[0][0] == "system":
            assert parsed[0] == turns[0]
    assert back == turns
    assert said == [text for role, text in turns if role == "assistant"]


def test_history_is_limited():
    rows = windows([("system", "s " * 10), *[("user", "u, " * 5), ("assistant", "a " * 10)] * 10], 80, 30)
    assert len(rows) > 3
    for r in rows[1:]:
        assert 1 <= r["n_repeated"] <= 3


def test_tokens_are_words_and_marks():
    assert chat.tokens("user", "") == chat.MARKS + 1
    assert chat.tokens("", "one, two!") == chat.MARKS + 4
    assert chat.tokens("", "abcdefghijklm") == chat.MARKS + 3


def test_a_turn_far_above_the_budget_is_a_window_of_its_own():
    long = "word " * 300_000
    rows = windows([("system", "be brief"), ("user", long), ("assistant", "yes"), ("user", "so?"), ("assistant", long)], 100, 20)
    assert [len(chat.parse(r["text"])) - r["n_repeated"] for r in rows] == [1, 1, 2, 1]
    assert rows[1]["tokens"] > 300_000 and rows[2]["tokens"] <= 100
    assert [chat.unescape(r["text"][x["start"] : x["stop"]]) for r in rows for x in r["loss"]] == ["yes", long]


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "hi", "x"), (None, 0, "user", "a", "x"), (2, None, "user", "b", "x"), (2, None, "user", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_windows(df)).collect()}
    assert got == {1: (2, 0), None: (1, 0), 2: (2, 0)}
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0


def test_digests_match_sql(spark):
    import duckdb

    from tracegrain.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: r for r in con.execute(queries.OP9_SQL).fetchall()}
    rows = queries.op9_chat(spark, sf).collect()
    assert len(rows) == len(want) and -7 in want
    for r in rows:
        assert tuple(r)[:5] == want[r.conv_id]
        assert r.formatted_chars > 0
