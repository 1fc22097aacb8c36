import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracegrain.llm import bpe, orc_tokens, queries

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", " ", "  a   b \n\n c\t d ", "x <|endoftext|> y<|startoftext|>z  ", "a\x1cb !\x1c x\x85y   z", "é ́a ΑΣ ΟΔΟΣ İ", "don't  'S we'LL 12 345,678", "　 中文  x \r\n\r\n"]


def test_byte_level_texts_encode_as_the_library_does():
    whole = Tokenizer.from_file(BYTE)
    encode = bpe.ByteEncoder(bpe.load_vocabulary(BYTE))
    assert encode.fast is not None

    def same(texts):
        for t, got in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)

    same([*ODD, "a" * 3000, " " * 3000, "\u00e9" * 500, "x1" * 800, "<|endoftext|>"])

    @settings(max_examples=1000, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0 'sa1.!<|>É́"), st.characters(max_codepoint=0xFF), st.characters(codec="utf-8")), max_size=40), max_size=4))
    def anything(texts):
        same(texts)

    anything()


def test_words_encode_as_whole_texts():
    whole = Tokenizer.from_file(WORD)
    encode = bpe.WordEncoder(bpe.load_vocabulary(WORD))

    def same(texts):
        words, counts = bpe.split(pa.array(texts, pa.string()))
        ids = encode(words.to_pylist())
        ends = np.cumsum([0, *counts])
        for t, x, y in zip(texts, ends[:-1], ends[1:], strict=True):
            assert [i for w in ids[x:y] for i in w] == whole.encode(t, add_special_tokens=False).ids, repr(t)

    same(ODD)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85 'sa1.!<|>É́"), st.characters(codec="utf-8")), max_size=30), max_size=4))
    def anything(texts):
        same(texts)

    anything()


def test_blocks_and_pieces_of_any_size(spark, monkeypatch):
    """Through the packing of chunks, the sorted words and the join by position, cut everywhere."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Wort", "x", "élan", "abc,def", "the"], n)) for n in (0, 1, 5, 300, 40, 0, 700)] + [None, "one"]
    vocabulary = bpe.load_vocabulary(WORD)
    whole = Tokenizer.from_file(WORD)
    for chunk, block, piece, most in ((10**9, 10**6, 10**6, 10**6), (200, 50, 64, 10**6), (10**9, 1, 333, 1)):
        for name, value in (("CHUNK", chunk), ("BLOCK", block), ("PIECE", piece), ("TABLE_WORDS", most)):
            monkeypatch.setattr(bpe, name, value)
        monkeypatch.setattr(bpe, "TaskContext", Context)
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
        rows = [r for b in bpe._pack(1, 5)([batch]) for r in b.to_pylist()]
        words = sorted((r for r in rows if r["kind"] == bpe.WORD), key=lambda r: r["seq"])
        lists = [(r["seq"], pa.decompress(r["words"], decompressed_size=r["n"], codec="zstd", asbytes=True).decode().split(" ")) for r in words]
        assert {w for _, x in lists for w in x} == {w for t in texts for w in (t or "").split()}
        assert len({(s, w) for s, x in lists for w in x}) == len({w for _, x in lists for w in x})  # a word has one bucket
        sent = [pa.record_batch({"chunk": [r["chunk"]], "seq": [r["seq"]], "n": [r["n"]], "words": pa.array([r["words"]], pa.binary()), "packed": pa.array([r["packed"]], pa.binary())}) for r in words]
        ids = [r for b in bpe._encode(Shared(vocabulary))(iter(sent)) for r in b.to_pylist()]
        stream = sorted([r for r in rows if r["kind"] == bpe.TEXTS] + ids, key=lambda r: (r["chunk"], r["kind"], r["seq"]))
        table = pa.Table.from_pylist(stream, pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("words", pa.binary()), ("packed", pa.binary())]))
        for tail in ([], [7]):
            got = {r["doc_id"]: r["ids"] for b in bpe._join(["doc_id", "ids"], tail)(table.to_batches()) for r in b.to_pylist()}
            assert got == {i: [*whole.encode(t or "", add_special_tokens=False).ids, *tail] for i, t in enumerate(texts)}


class Shared:
    def __init__(self, value):
        self.value = value


class Context:
    get = staticmethod(lambda: Context)
    partitionId = staticmethod(lambda: 0)


def test_tables_without_rows_and_clashing_columns(spark, tmp_path):
    vocabulary = bpe.load_vocabulary(WORD)
    df = spark.createDataFrame([(1, "one two", 5, "x"), (1, "one two", 6, None), (None, None, 7, "y")], "doc_id long, text string, n int, words string")
    got = sorted(bpe.encode(df, vocabulary, keep=("doc_id", "n", "words")).collect(), key=lambda r: r.n)
    assert [(r.doc_id, r.n, r.words) for r in got] == [(1, 5, "x"), (1, 6, None), (None, 7, "y")]
    assert got[0].ids == got[1].ids and len(got[0].ids) == 2 and got[2].ids == []
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
    df.limit(0).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_bpe(spark, str(tmp_path)).count() == queries.op6_orc_tokens(spark, str(tmp_path)).count() == 0


def test_each_word_is_encoded_once(monkeypatch):
    asked = []

    class Counting(bpe.WordEncoder):
        def __call__(self, words):
            asked.extend(words)
            return super().__call__(words)

    monkeypatch.setattr(bpe, "WordEncoder", Counting)
    rows = []
    for seq, chunk, words in ((0, 0, b"a b"), (0, 1, b"b c"), (1, 0, b"d"), (1, 1, b"d")):
        packed = [pa.array([x], pa.binary()) for x in (pa.compress(words, codec="zstd", asbytes=True), bpe._planes(np.ones(words.count(b" ") + 1)))]
        rows.append(pa.record_batch({"chunk": [chunk], "seq": [seq], "n": [len(words)], "words": packed[0], "packed": packed[1]}))
    assert len(list(bpe._encode(Shared(bpe.load_vocabulary(WORD)))(iter(rows)))) == 4
    assert asked == ["a", "b", "c", "d"]


def test_query_digests_match_the_library(spark, tmp_path):
    rows = [(i, t, None) for i, t in enumerate([*ODD, "long word " * 5000, None])]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(WORD)
    for r in queries.op5_bpe(spark, str(tmp_path)).collect():
        ids = whole.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole, start = Tokenizer.from_file(BYTE), 0
    for r in sorted(queries.op6_orc_tokens(spark, str(tmp_path)).collect()):
        ids = [*whole.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_ties_and_null_ids(spark, tmp_path):
    vocabulary = bpe.load_vocabulary(BYTE)
    rows = spark.createDataFrame([(None, "b"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    path = orc_tokens.write(rows, vocabulary, f"{tmp_path}/t", end_id=2)
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in orc_tokens.catalogue(spark, path).collect())
    assert got == [(0, 1, None), (1, 2, None), (3, 2, 1), (5, 2, 1)]
    none = orc_tokens.write(rows.limit(0), vocabulary, f"{tmp_path}/n")
    assert orc_tokens.catalogue(spark, none).count() == 0
    plan = orc_tokens.read(spark, path).where("doc_id = 1")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,1)" in plan
    back = bpe.decode(orc_tokens.read(spark, path), vocabulary).collect()
    assert sorted(r.decoded for r in back) == sorted(["b#", "#", "a#", "a#"])
