import random

from pyspark.sql import functions as F

from tests.graphs import graph, nodes
from tracegrain.functions.tokens import node_label, node_tokens, padded, positional_similarity
from tracegrain.model import numbered
from tracegrain.operators import embedding, labels, sequences


def test_tokens(spark):
    cases = [
        ("bash_8292", "process", ["bash", "8292"], 0), ("C:\\Program_7620", "process", ["C:", "Program", "7620"], 0), ("bash", "process", [], 3),
        ("a_b\\c", "process", ["a_b"], 1), ("/usr/a_b", "process", ["usr", "a", "b"], 0), ("10.1.2.3:80->4.5.6.7:90", "socket", "10 1 2 3 80 4 5 6 7 90".split(), 0),
        ("10.1.2.3:80->4.5.6.7", "socket", "10 1 2 3 80 4 5 6 7".split(), 0), ("null:5965->null: 0", "socket", ["null", "5965", "null", " 0"], 0),
        ("1.2:3->4.5.6.7:8", "socket", [], 3), ("x", "socket", [], 2), ("/usr/a.txt", "file", ["usr", "a.txt"], 0), ("plain", "file", [], 0), ("", "file", [], 0),
    ]
    df = spark.createDataFrame([(n, k) for n, k, *_ in cases], "n string, k string").withColumn("t", node_tokens(F.col("n"), F.col("k")))
    assert [(r.n, r.k, r.t.tokens, r.t.flag) for r in df.collect()] == cases


def test_labels(spark):
    df = spark.createDataFrame([(" /TMP/x", "file"), ("sshd_1", "process"), ("xyz", "process"), ("1.2.3.4", "socket")], "n string, k string")
    assert [r[0] for r in df.select(node_label(F.col("k"), F.col("n"))).collect()] == ["temp_file", "system_process", "lib_process", "ip_address"]
    row = spark.createDataFrame([([1, 2, 3], [1, 9])], "a array<int>, b array<int>").select(positional_similarity(F.col("a"), F.col("b")).alias("s"), padded(F.col("a"), 4).alias("p")).first()
    assert abs(row.s - 1 / 3) < 1e-12
    assert row.p == [1, 2, 3, 0]


def test_sessions_split_at_the_gap(spark):
    g = graph(spark, [("p_1", "f", "write", t) for t in (0, 9, 19, 29)])
    rows = sequences.sessions(sequences.process_events(g), 10).orderBy("start_time").collect()
    assert [(r.session_no, r.event_no) for r in rows] == [(0, 0), (0, 1), (1, 0), (2, 0)]


def test_slices_have_no_influence_on_sessions(spark):
    rng = random.Random(5)
    events = [(f"p_{rng.randrange(3)}", rng.choice(["f", "p_0"]), "write", rng.choice([0, 1, 2, 15, 16, 40, 41, 70, 200, 201]) + rng.choice([0, 0, 3, 7])) for _ in range(150)]
    found = sequences.process_events(graph(spark, events))
    rows = found.unionByName(found.withColumn("start_time", F.lit(None).cast("double")).where("key = 0"))
    plain = rows.collect()
    for gap in (0, 4, 13):
        want = {}
        for r in sorted(plain, key=lambda r: (r.process, r.start_time is not None, r.start_time or 0, r.edge_ord)):
            session, event, last = want[r.process][-1] if r.process in want else (0, -1, None)
            new = last is not None and r.start_time - last >= gap
            want.setdefault(r.process, []).append((session + new, 0 if new else event + 1, r.start_time))
        for width in (1, 10):
            got = {}
            for r in sequences.sessions(rows, gap, width).collect():
                got.setdefault(r.process, []).append((r.session_no, r.event_no, r.start_time))
            assert {p: sorted(x, key=lambda y: y[:2]) for p, x in got.items()} == want


def test_numbers_go_on_over_slices(spark):
    rows = [(k, i, i * 37 % 100) for k in "ab" for i in range(100)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, i int, o int")
    got = numbered(df, ["k"], F.floor(F.col("o") / 7), [F.col("o")], "n").collect()
    assert sorted((r.k, r.i, r.o, r.n) for r in got) == [(k, i, o, o) for k, i, o in rows[:-1]]


def plain_texts(events, tokens, gap, most):
    """Offered texts of one process by the rule, step by step."""
    out, text, held, last = [], "", [], None
    for u, v, kind, t in events:
        if last is not None and t - last >= gap:
            text, held = "", []
        last = t
        add = [*tokens[u], kind, *tokens[v]]
        if len(held) >= most or len(held) + len(add) > most:
            out += [text, "".join(" " + w for w in add)]
            text, held = out[-1], add
        else:
            text, held = (text + "".join(" " + w for w in add)).strip(), [*held, *add]
            out.append(text)
    return out


def test_texts_overflow(spark):
    rng = random.Random(2)
    events = [("p_1", rng.choice(["f:a", "f:b:c"]), "write", float(t)) for t in sorted(rng.sample(range(100), 25))]
    g = graph(spark, events, {"p_1": "process", "f:a": "file", "f:b:c": "file"})
    tokens = {"p_1": ["p", "1"], "f:a": ["f", "a"], "f:b:c": ["f", "b", "c"]}
    rows = sequences.event_texts(sequences.process_events(g), sequences.vocabulary_of_nodes(g), 8, 12)
    got = [r.text for r in rows.orderBy("session_no", "event_no", "piece_no").collect()]
    assert got == plain_texts(events, tokens, 8, 12)
    # a token that is empty leaves no blank at the end, and one that is long starts a text
    odd = {"p_1": ["p", ""], "f:a": [""], "f:b:c": ["x"] * 11}
    vocabulary = spark.createDataFrame(list(odd.items()), "node string, tokens array<string>")
    rows = sequences.event_texts(sequences.process_events(g), vocabulary, 8, 12)
    assert [r.text for r in rows.orderBy("session_no", "event_no", "piece_no").collect()] == plain_texts(events, odd, 8, 12)
    once = [r.text for r in sequences.session_texts(sequences.process_events(g), sequences.vocabulary_of_nodes(g), 8, 12).collect()]
    assert sorted(once) == sorted(set(got))


def test_label_sequences_and_classifier(spark):
    g = graph(spark, [("p1", "f1", "write", 1), ("p1", "f2", "write", 2), ("p2", "f1", "read", 3), ("p3", "p2", "clone", 4)])
    attack = nodes(spark, "p1", "p2", "f1")
    combos = labels.combinations(attack)
    assert combos.select("combo").distinct().count() == 4
    found = labels.attack_sequences(g, attack)
    assert found.count() == 4
    plain = labels.plain_sequences(g, attack)
    texts, probes = labels.probe_sequences(g, attack, nodes(spark, "p3"))
    assert texts.count() == 4 and probes.count() == 7
    rows = labels.training_rows(found, probes)
    model = embedding.train(rows)
    assert sum(embedding.evaluate(embedding.predict(model, rows)).first()) == 11
    vector = embedding.embed_texts(plain.union(plain.limit(0))).limit(1).collect()
    assert all(len(r.embedding) == 768 for r in vector)
