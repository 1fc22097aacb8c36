"""BPE encoding and decoding through a distinct-word table.

Where a vocabulary drops white space, a text's ids are those of its words, one
after the other, because no pre-token crosses white space. Texts are split once,
in chunks: a chunk numbers its distinct words, the most frequent first, and keeps
each text as numbers. The words of all chunks are dealt to buckets by a hash, so
that equal ones meet in packed lists; a bucket encodes each distinct word once,
and the ids go back to every chunk and number that asked. There they are joined
to the texts by position, as arrays. Ids are decoded by a join with the
id-to-piece table of the vocabulary.

Byte-level vocabularies encode white space with the words; ``ByteEncoder`` does
whole texts for those.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.pieces import cut, give_back
from tracegrain.plans.materialize import staged

#: Bytes of text in a chunk, in a block of texts, and in a piece of a longer text; documents handled at a time; level of compression.
CHUNK, BLOCK, PIECE, BLOCK_DOCS, LEVEL = 48 << 20, 2 << 20, 4 << 20, 500, 9
#: Most buckets of words, so that lists keep some hundred words; and words that a bucket's table holds before it starts anew.
BUCKETS, TABLE_WORDS = 4096, 400_000
#: Characters of texts that are encoded whole at a time.
BLOCK_CHARS = 1_000_000
#: Kinds of rows: ids of a chunk's words, its texts as word numbers, and its words.
IDS, TEXTS, WORD = range(3)
ROW = "chunk long, kind byte, seq int, n long, words binary, packed binary"

_ENCODERS: dict = {}


def load_vocabulary(path: str) -> str:
    """The tokenizer's JSON, read on the driver; tasks get its text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _tokenizer(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def _kept(kind: type, vocabulary: str):
    """One encoder of a kind, kept by a worker process between its tasks."""
    key = (kind, hash(vocabulary))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(vocabulary)
    return _ENCODERS[key]


# The split pattern of byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Ids of whole texts under a byte-level vocabulary.

    Texts of Latin-1 characters go through the vocabulary's ranks, which give
    the library's ids several times as fast; the others, and texts with the
    name of a special token, go to the library itself.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        self.tokenizer = _tokenizer(vocabulary)
        data = json.loads(vocabulary)
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before, model = data.get("pre_tokenizer") or {}, data["model"]
        simple = {k: before.get(k) for k in plain} == plain and not data.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
        hidden = [b for b in range(256) if b not in set(printed)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special} if simple else {}
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if simple else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [self._quick(t) for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _quick(self, text: str) -> bytes | None:
        if self.fast is None or any(x in text for x in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


class Pieces:
    """The id-to-piece table of a vocabulary, of fixed size."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.plain = self.tokenizer.decoder is None
        self.pieces = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.string())

    def join(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list: its pieces with blanks between them, or what the vocabulary's own decoder makes of them."""
        if not self.plain:
            return pa.array([self.tokenizer.decode(ids or [], skip_special_tokens=False) for ids in lists.to_pylist()], pa.string())
        ids, n = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        known = pc.is_in(ids, pa.array(np.flatnonzero(self.pieces.is_valid().to_numpy(zero_copy_only=False)), pa.int32()))
        if not pc.all(known).as_py() and len(ids):  # leave the others out
            mask = known.to_numpy(zero_copy_only=False)
            n = np.bincount(np.repeat(np.arange(len(n)), n)[mask], minlength=len(n))
            ids = ids.filter(known)
        ends = pa.array(np.cumsum([0, *n]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.pieces.take(ids)), " ")


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def id_lists(parts: list[bytes], tail: bytes = b"") -> pa.Array:
    """A list<int32> array from ids in bytes."""
    ends = np.cumsum([0, *((len(p) + len(tail)) // 4 for p in parts)])
    flat = np.frombuffer(tail.join([*parts, b""]) if tail else b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encoded(batches, vocabulary: str, tail: bytes) -> Iterator[tuple[list, pa.Array]]:
    """Kept columns and byte-level ids for Arrow batches whose last column is the text, in blocks."""
    encode_texts = _kept(ByteEncoder, vocabulary)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(at, BLOCK_DOCS)
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            for a, b in blocks(texts):
                kept = [part.column(i).slice(a, b - a) for i in range(part.num_columns - 1)]
                yield kept, id_lists(encode_texts(texts[a:b]), tail)


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs at ``at``, one after the other, and the size of each."""
    n = sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _zip(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(table)
    return sink.getvalue()


def _row(chunk: int, kind: int, seq: int, n: int, words: bytes | None, packed: bytes) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((chunk, kind, seq, n, words, packed), kinds, strict=True)], names=["chunk", "kind", "seq", "n", "words", "packed"])


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32, each byte by byte of as many as they need, compressed, after a line that tells their sizes."""
    head, parts = [], []
    for x in arrays:
        k = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T)
        parts.append(pa.Codec("zstd", LEVEL).compress(planes, asbytes=True))
        head.append(f"{len(x)},{k},{len(parts[-1])}")
    return b";".join(h.encode() for h in head) + b"\n" + b"".join(parts)


def _numbers(data: pa.Scalar) -> list[np.ndarray]:
    buffer = data.as_buffer()
    at = bytes(buffer.slice(0, min(200, buffer.size))).index(b"\n") + 1
    found = []
    for n, k, size in (map(int, h.split(b",")) for h in bytes(buffer.slice(0, at - 1)).split(b";")):
        planes = np.frombuffer(pa.decompress(buffer.slice(at, size), decompressed_size=k * n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        out = np.zeros((n, 4), np.uint8)
        out[:, :k] = planes.reshape(k, n).T
        found.append(out.view("<u4").ravel())
        at += size
    return found


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    real = np.not_equal(pc.binary_length(flat).to_numpy(zero_copy_only=False), 0)
    counts = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n)) if len(n) else np.zeros(0, np.int64)
    return flat.filter(pa.array(real)), counts


class _Chunk:
    """Rows of one chunk, once its texts have passed."""

    def __init__(self, chunk: int):
        self.chunk, self.size = chunk, 0
        self.index: dict[str, int] = {}
        self.blocks: list[tuple[pa.Table, np.ndarray]] = []

    def add(self, kept: pa.Table, last: list[bool], texts: pa.Array) -> None:
        words, counts = split(texts)
        codes = words.dictionary_encode()
        new = self.index
        local = np.array([new.setdefault(w, len(new)) for w in codes.dictionary.to_pylist()], np.uint32)
        numbers = local[codes.indices.to_numpy()] if len(words) else np.zeros(0, np.uint32)
        self.blocks.append((kept.append_column("__words", pa.array(counts, pa.int64())).append_column("__last", pa.array(last, pa.bool_())), numbers))

    def close(self, buckets: int):
        words, self.index = list(self.index), {}
        order = np.argsort(-sum((np.bincount(x, minlength=len(words)) for _, x in self.blocks), np.zeros(len(words), np.int64)), kind="stable")
        rank = np.zeros(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        for seq, (table, numbers) in enumerate(self.blocks):
            yield _row(self.chunk, TEXTS, seq, len(numbers), _planes(rank[numbers]), _zip(table))
        self.blocks = []
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[order] % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(words) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(by)).astype(int), strict=True):
            mine = by[a:b]
            joined = " ".join([words[i] for i in order[mine]]).encode("utf-8")
            packed = pa.Codec("zstd", LEVEL).compress(joined, asbytes=True)
            yield _row(self.chunk, WORD, int(bucket[mine[0]]), len(joined), packed, _planes(np.diff(mine, prepend=0)))


def _pack(parts: int, buckets: int):
    """The rows of chunks of about ``CHUNK`` bytes; the n-th chunk of task p has the number p + n * parts. The text comes last.

    seq is a block's place in the chunk, or the bucket of a list of words.
    """

    def blocks_of(b):
        text = b.column(b.num_columns - 1)
        text = text.fill_null("")
        kept = pa.Table.from_batches([b.select(range(b.num_columns - 1))])
        size = pc.binary_length(text).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(size):
            if size[at] > PIECE:  # a long text, piece by piece
                parts_of = [p.decode("utf-8") for p in cut(text[at].as_py().encode("utf-8"), PIECE)]
                for i, p in enumerate(parts_of):
                    yield kept.slice(at, 1), [i + 1 == len(parts_of)], pa.array([p], pa.string()), len(p)
                at += 1
                continue
            end, held = at, 0
            while end < len(size) and held < BLOCK and size[end] <= PIECE:
                held += int(size[end]) + 20
                end += 1
            yield kept.slice(at, end - at), [True] * (end - at), text.slice(at, end - at), held
            at = end

    def run(batches):
        number, chunk = TaskContext.get().partitionId(), None
        for b in batches:
            for kept, last, texts, size in blocks_of(b):
                chunk = chunk or _Chunk(number)
                chunk.add(kept, last, texts)
                chunk.size += size
                if chunk.size >= CHUNK and last[-1]:
                    yield from chunk.close(buckets)
                    chunk, number = None, number + parts
                    give_back()
        if chunk is not None:
            yield from chunk.close(buckets)
        chunk = None
        give_back()

    return run


class WordEncoder:
    """Ids of distinct words, by the library."""

    def __init__(self, vocabulary: str):
        self.tokenizer = _tokenizer(vocabulary)

    def __call__(self, words: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(words), 1000) for e in self.tokenizer.encode_batch_fast(words[at : at + 1000], add_special_tokens=False)]


def _encode(shared):
    """Lists of words, sorted by bucket (seq): the ids of each list. A bucket's table holds each distinct word it has met."""

    def run(batches):
        encode_words = _kept(WordEncoder, shared.value)
        bucket, table = None, {}
        for b in batches:
            for chunk, seq, n, packed, steps in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), b.column(4), strict=True):
                if seq != bucket or len(table) > TABLE_WORDS:
                    bucket, table = seq, {}
                words = pa.decompress(packed.as_buffer(), decompressed_size=n, codec="zstd", asbytes=True).decode("utf-8").split(" ")
                new = [w for w in words if w not in table]
                for w, ids in zip(new, encode_words(new), strict=True):
                    table[w] = np.array(ids, "<u4").tobytes()
                found = [table[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                yield _row(chunk, IDS, seq, len(words), _planes(_numbers(steps)[0], sizes, np.frombuffer(b"".join(found), "<u4")), b"")
        table = {}
        give_back()

    return run


def _join(names: list[str], tail: list[int]):
    """Rows sorted by chunk, kind and seq: ids of its words, then its texts, which get them by position."""

    def run(batches):
        chunk, parts, table, open_ids = None, [], None, np.zeros(0, np.int32)
        for b in batches:
            for c, kind, words, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if c != chunk:
                    chunk, parts, table = c, [], None
                    give_back()
                if kind == IDS:
                    steps, m, flat = _numbers(words)
                    parts.append((np.cumsum(steps, dtype=np.int64), m.astype(np.int64), flat.astype(np.int32)))
                    continue
                rows = pa.ipc.open_stream(packed.as_buffer()).read_all()
                if table is None:
                    local, m, flat = (np.concatenate([np.zeros(0, np.int32 if i == 2 else np.int64), *(p[i] for p in parts)]) for i in range(3))
                    starts, sizes = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
                    starts[local], sizes[local] = np.cumsum(m) - m, m
                    table, parts = (starts, sizes, flat), []
                ids, each = gather(*table, _numbers(words)[0])
                upto = np.append(0, np.cumsum(each))
                ends = upto[np.cumsum(rows.column("__words").to_numpy())] + len(open_ids)
                ids = np.concatenate([open_ids, ids])
                last = rows.column("__last").to_numpy()
                ends = ends[last]
                done = int(ends[-1]) if len(ends) else 0
                ids, open_ids = ids[:done], ids[done:]
                if tail:
                    ids = np.insert(ids, np.repeat(ends, len(tail)), np.tile(tail, len(ends)))
                    ends = ends + len(tail) * np.arange(1, len(ends) + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                kept = rows.filter(pa.array(last)).select(range(len(names) - 1)).combine_chunks()
                whole = pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in kept.columns), lists], names=names)
                for at in range(0, whole.num_rows, BLOCK_DOCS):
                    yield whole.slice(at, BLOCK_DOCS)
        table = None
        give_back()

    return run


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", keep_space: bool = False, end_id: int | None = None) -> DataFrame:
    """Columns ``keep`` and the token ids of each whole text.

    keep_space: the vocabulary encodes the white space before a word with it
    (byte-level); such texts are encoded whole, others through the distinct-word
    table. A null text counts as empty and gives no ids (only ``end_id``, where
    one is asked for). Rows are independent: ties, repeated rows and nulls in
    kept columns pass through; columns that aren't kept don't matter; a very long
    text is split in pieces; an empty table gives an empty table.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # a file of fixed size
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{ids_col}` array<int>"
    names = [*keep, ids_col]
    if keep_space:
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def run(batches):
            for kept, ids in encoded(batches, shared.value, tail):
                yield pa.RecordBatch.from_arrays([*kept, ids], names=names)

        return rows.mapInArrow(run, schema)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    parts, fewer = rows.rdd.getNumPartitions(), -(-size // CHUNK) or 1
    if parts > fewer:  # scan tasks below a chunk's size are joined, without a shuffle
        rows, parts = rows.coalesce(fewer), fewer
    buckets = int(min(BUCKETS, 2 * fewer + 1))
    chunks = staged(rows.mapInArrow(_pack(max(parts, 1), buckets), ROW), "word-chunks")
    number = (chunks.where(F.col("kind") == TEXTS).agg(F.max("chunk")).first()[0] or 0) + 1
    words = chunks.where(F.col("kind") == WORD).select("chunk", "seq", "n", "words", "packed").repartitionById(buckets, "seq").sortWithinPartitions("seq")
    columns = ["chunk", "kind", "words", "packed", "seq"]
    stream = chunks.where(F.col("kind") == TEXTS).select(*columns).union(words.mapInArrow(_encode(shared), ROW).select(*columns))
    dealt = stream.repartitionById(number, F.col("chunk").cast("int")).sortWithinPartitions("chunk", "kind", "seq")
    return dealt.mapInArrow(_join(names, [] if end_id is None else [end_id]), schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), text_col: str = "decoded") -> DataFrame:
    """Columns ``keep`` and the text of each list of ids, special tokens kept.

    The vocabulary's id-to-piece table is of fixed size and goes to every task.
    Null lists decode to the empty text; ids outside the vocabulary are left out.
    Only vocabularies without a decoder are joined here (pieces with blanks
    between them); others are handed to the library's own decoder.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        table = Pieces(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), table.join(part.column(len(keep)))], names=[*keep, text_col])

    rows = df.select(*keep, ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, `{text_col}` string")
