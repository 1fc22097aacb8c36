"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions. Every context of up to ``DEPTH`` preceding
bytes has a Krichevsky-Trofimov estimator for each decision, and context-tree
weighting mixes the estimates of all depths; the code length of a byte follows.

Texts are lower-cased (A-Z), words are each followed by a blank, and a text ends
with a line feed; before its start there are line feeds only. So the score is
the probability of the token sequence.

Texts are packed into compressed chunks once, in pieces, so a very long text is
never a block of its own. A chunk passes on its distinct n-grams (context and
byte) and words with their training counts; the corpus adds them up. Nodes with
three or more bytes of context are solved where the three nearest bytes are
equal: at most 256 ** (depth - 2) n-grams, whatever the corpus. Their sums give
the nodes with two bytes (256 ** 2 * 255 at most), and those the rest of the
tree, 256 * 255 nodes, the only part that reaches the driver and all tasks. Each
chunk gets back the values of its own n-grams and words as one sorted stream:
values first, then its texts.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.pieces import cut, give_back
from tracegrain.plans.materialize import dropped, staged

#: Bytes of context (at least 3), bytes of a chunk, bytes counted at a time, bytes packed at a time, counts merged at a time, and slots of a lookup table.
DEPTH, CHUNK, BLOCK, PART, MERGE, SLOT_BITS = 5, 64 << 20, 256 << 10, 2 << 20, 500_000, 20
#: N-grams solved at a time (more only where the three nearest bytes are equal), and values packed at a time.
SOLVE_ROWS, PACK_ROWS = 100_000, 500_000
#: Kinds of a chunk's rows, in the order of its stream: training counts of its own words, counts of words that others have too,
#: values of n-grams, texts; and what it passes on: words and n-grams.
OWN, WORDS, GRAMS, TEXTS, WORD, GRAM = range(6)
END = b"\n"
HALF = np.log(0.5)
LOG10 = np.log(10)


def normal(text: str | None) -> bytes:
    """Lower-cased words with single blanks between them."""
    return b" ".join((text or "").encode("utf-8").lower().split())


def body(norm: bytes, depth: int = DEPTH) -> bytes:
    """What is coded for a text, after the line feeds that stand for its past."""
    return END * depth + (norm + b" " if norm else b"") + END


def gram_keys(bodies: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram at each coded byte, nearest context byte first, and the text it is in."""
    a = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    owner = np.repeat(np.arange(len(bodies)), sizes)
    within = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(within >= depth)
    key = a[at].astype(np.int64)
    for d in range(1, depth + 1):
        key |= a[at - d].astype(np.int64) << (8 * (depth - d + 1))
    return key, owner[at]


def entries(text: str | None) -> list[tuple[bool, bytes]]:
    """What is coded for a text, in pieces: (is the last one, bytes)."""
    parts = [b" ".join([*words, b""]) for piece in cut((text or "").encode("utf-8").lower(), BLOCK) if (words := piece.split())]
    return [(False, p) for p in parts[:-1]] + [(True, (parts[-1] if parts else b"") + END)]


def word_keys(entry: bytes, last: bool) -> np.ndarray:
    """Hashes of the tokens in a piece: its words, then the end after the last piece."""
    tokens = entry.split()
    if last:
        tokens.append(END)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives to n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)


def mixed(log_e: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return np.logaddexp(HALF + log_e, HALF + log_children)


class Level:
    """The nodes of one depth that some n-grams pass: their counts, weighted probability and own share of it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, at: int, below: Level | None):
        context = keys >> (8 * (depth - at) + 8)
        byte = keys & 255
        bit = np.arange(8)[:, None]
        node = (1 << bit) | (byte >> (8 - bit))
        self.ones = (byte >> (7 - bit)) & 1
        self.nodes, self.of = np.unique(context * 256 + node, return_inverse=True)
        self.of = self.of.reshape(8, -1)
        n = len(self.nodes)
        weight = np.broadcast_to(counts, self.of.shape)
        self.n1 = np.bincount(self.of.ravel(), (weight * self.ones).ravel(), n)
        self.n0 = np.bincount(self.of.ravel(), weight.ravel(), n) - self.n1
        log_e = log_kt(self.n0, self.n1)
        if below is None:
            self.log_w, self.share = log_e, np.ones(n)
        else:
            up = np.searchsorted(self.nodes, ((below.nodes >> 16) << 8) | (below.nodes & 255))
            self.log_w = mixed(log_e, np.bincount(up, below.log_w, n))
            self.share = np.exp(np.minimum(HALF + log_e - self.log_w, 0))

    def kt(self) -> np.ndarray:
        """The estimate of the decision each n-gram takes, by bit."""
        n0, n1 = self.n0[self.of], self.n1[self.of]
        return (np.where(self.ones == 1, n1, n0) + 0.5) / (n0 + n1 + 1)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> list[Level]:
    """The levels from ``depth`` up to three bytes of context."""
    levels: list[Level] = []
    for at in range(depth, 2, -1):
        levels.append(Level(keys, counts, depth, at, levels[-1] if levels else None))
    return levels


class Top:
    """The nodes with at most one byte of context, from sums over those with two."""

    def __init__(self, c1: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, log_children: np.ndarray):
        self.n = np.zeros((2, 257, 256))  # row 256: no context
        children = np.zeros((257, 256))
        self.n[0, c1, node], self.n[1, c1, node], children[c1, node] = n0, n1, log_children
        self.n[:, 256] = self.n[:, :256].sum(1)
        log_e = log_kt(self.n[0], self.n[1])
        log_w = mixed(log_e, children)
        log_w[256] = mixed(log_e[256], log_w[:256].sum(0))
        self.share = np.exp(np.minimum(HALF + log_e - log_w, 0))

    def mix(self, c1: np.ndarray, byte: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Natural log of each byte's probability, given that of its decisions from two bytes of context on."""
        bit = np.arange(8)[:, None]
        node, ones = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
        for row in (np.broadcast_to(c1, node.shape), np.full(node.shape, 256)):
            n0, n1 = self.n[0][row, node], self.n[1][row, node]
            kt = (np.where(ones == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
            w = self.share[row, node]
            p = w * kt + (1 - w) * p
        return np.log(p).sum(0)


def _by_near(depth: int, kernel):
    """Runs ``kernel`` on about ``SOLVE_ROWS`` rows at a time; rows come sorted, those with equal three nearest bytes stay together."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            size += b.num_rows
            if size < SOLVE_ROWS:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = np.searchsorted(rows[0], rows[0][-1])  # the last group may go on
            if end:
                yield kernel(*(c[:end] for c in rows))
            held, size = [tuple(c[end:].copy() for c in rows)], size - end
        if size:
            yield kernel(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held = []
        give_back()

    return run


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _summary(depth: int):
    """(near, key, n), sorted: sums over the third byte for the nodes with two bytes of context, as far as the rows go."""

    def kernel(near, key, n):
        low = subtree(key, n.astype(np.float64), depth)[-1]
        node, of = np.unique((low.nodes >> 16 << 8) | (low.nodes & 255), return_inverse=True)
        add = lambda x: np.bincount(of, x, len(node))
        return _batch({"c2": node >> 8, "node": node & 255, "n0": add(low.n0), "n1": add(low.n1), "log_w": add(low.log_w)})

    return _by_near(depth, kernel)


SECOND = "c2 long, node long, n0 double, n1 double, log_w double, share double"


def _second(batches):
    """The nodes with two bytes of context, from sums over those with three."""
    for b in batches:
        c2, node, n0, n1, children = (c.to_numpy() for c in b.columns)
        log_e = log_kt(n0, n1)
        log_w = mixed(log_e, children)
        yield _batch({"c2": c2, "node": node, "n0": n0, "n1": n1, "log_w": log_w, "share": np.exp(np.minimum(HALF + log_e - log_w, 0))})


def _values(depth: int, top: Top):
    """(near, kind, key, n0, n1, share), sorted: nodes with two bytes of context (kind 0), then n-grams (1, counts in n0)."""

    def kernel(near, kind, key, n0, n1, share):
        second, gram = kind == 0, kind == 1
        at, own = np.unique((near[second] >> 8 << 8) | key[second], return_index=True)
        n0_2, n1_2, share_2 = (c[second][own] for c in (n0, n1, share))
        keys = key[gram]
        p = None
        for level in subtree(keys, n0[gram], depth):
            p = level.kt() if p is None else level.share[level.of] * level.kt() + (1 - level.share[level.of]) * p
        byte, bit = keys & 255, np.arange(8)[:, None]
        node, ones = (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1
        i = np.searchsorted(at, (keys >> (8 * depth - 8) << 8) | node)
        kt = (np.where(ones == 1, n1_2[i], n0_2[i]) + 0.5) / (n0_2[i] + n1_2[i] + 1)
        p = share_2[i] * kt + (1 - share_2[i]) * p
        return _batch({"key": keys, "value": top.mix(keys >> (8 * depth), byte, p) / LOG10})

    return _by_near(depth, kernel)


ROW = "chunk long, kind byte, seq int, key long, n long, packed binary"


def _row(chunk, kind, seq, n, packed) -> pa.RecordBatch:
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays([one(chunk, pa.int64()), one(kind, pa.int8()), one(seq, pa.int32()), one(None, pa.int64()), one(n, pa.int64()), one(packed, pa.binary())], names=["chunk", "kind", "seq", "key", "n", "packed"])


def _blob(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values, compressed."""
    return pa.compress(np.diff(keys, prepend=0).tobytes() + values.astype(np.float64).tobytes(), codec="zstd", asbytes=True)


def _unblob(n: int, blob) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob.as_buffer(), decompressed_size=16 * n, codec="zstd")
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.float64, n, 8 * n)


def _merged(parts: list) -> list:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return [(keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts)]


class _Chunk:
    """Rows of one chunk as its texts pass: packed texts, then its words and n-grams with training counts."""

    def __init__(self, chunk: int, depth: int):
        self.chunk, self.depth, self.seq, self.size = chunk, depth, 0, 0
        self.rows: list[tuple] = []
        self.held = 0
        self.block: dict[bool, tuple[list, list]] = {x: ([], []) for x in (True, False)}
        self.waiting = {True: 0, False: 0}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.found: dict[int, list] = {WORD: [none], GRAM: [none]}

    def add(self, doc_id, held_out: bool, text: str | None):
        tail = END * self.depth
        for last, entry in entries(text):
            self.rows.append((doc_id, held_out, last, entry))
            self.held += len(entry)
            words, grams = self.block[not held_out]
            words.append((entry, last))
            grams.append(tail + entry)
            tail = grams[-1][-self.depth :]
            self.waiting[not held_out] += len(entry) + 8
            if self.waiting[not held_out] >= BLOCK:
                self._count(not held_out)
            if self.held >= PART:
                yield self._texts()
        self.size += len(text or "") + 50

    def _count(self, learn: bool) -> None:
        words, grams = self.block[learn]
        if words:
            for kind, keys in ((WORD, np.concatenate([word_keys(*w) for w in words])), (GRAM, gram_keys(grams, self.depth)[0])):
                u, n = np.unique(keys, return_counts=True)
                self.found[kind].append((u, n if learn else np.zeros_like(n)))
                if sum(len(p[0]) for p in self.found[kind][1:]) >= MERGE:
                    self.found[kind] = _merged(self.found[kind])
        self.block[learn], self.waiting[learn] = ([], []), 0

    def _texts(self) -> pa.RecordBatch:
        ids, held, last, entry = zip(*self.rows, strict=True)
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "last": pa.array(last, pa.bool_()), "entry": pa.array(entry, pa.large_binary())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_table(table)
        self.rows, self.held, self.seq = [], 0, self.seq + 1
        return _row(self.chunk, TEXTS, self.seq, len(ids), sink.getvalue())

    def close(self):
        if self.rows:
            yield self._texts()
        for learn in (True, False):
            self._count(learn)
        for kind in (WORD, GRAM):
            u, n = _merged(self.found.pop(kind))[0]
            if kind == WORD:
                yield _row(self.chunk, OWN, 0, int((n > 0).sum()), _blob(u[n > 0], n[n > 0]))
            for i in range(0, len(u), 100_000):
                m = len(u[i : i + 100_000])
                nulls = [pa.nulls(m, t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.chunk)), pa.array(np.full(m, kind, np.int8)), nulls[0], pa.array(u[i : i + m]), pa.array(n[i : i + m]), nulls[1]], names=["chunk", "kind", "seq", "key", "n", "packed"])


def _pack(depth: int, parts: int):
    """The rows of chunks of about ``CHUNK`` bytes of text; the n-th chunk of task p has the number p + n * parts."""

    def run(batches):
        number = TaskContext.get().partitionId()
        chunk = None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if chunk is None:
                        chunk = _Chunk(number, depth)
                    yield from chunk.add(i, h, t.as_py())
                    if chunk.size >= CHUNK:
                        yield from chunk.close()
                        chunk, number = None, number + parts
            give_back()
        if chunk is not None:
            yield from chunk.close()
        chunk = None
        give_back()

    return run


def _packed(batches):
    """Keys and values of a task's rows (chunk, kind, key, value), packed by chunk and kind."""
    held: list[tuple] = []
    size = 0

    def flush():
        chunk, kind, key, value = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((key, kind, chunk))
        chunk, kind, key, value = chunk[order], kind[order], key[order], value[order]
        starts = np.flatnonzero(np.append(True, (np.diff(chunk) != 0) | (np.diff(kind) != 0)))
        for a, b in zip(starts, np.append(starts[1:], len(chunk)), strict=True):
            yield _row(int(chunk[a]), int(kind[a]), 0, int(b - a), _blob(key[a:b], value[a:b]))

    for b in batches:
        held.append(tuple(c.to_numpy() for c in b.columns))
        size += b.num_rows
        if size >= PACK_ROWS:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()
    held = []
    give_back()


class Lookup:
    """Values of int64 keys, 0 for others: a table of slots, and a sorted rest for keys that share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS)
        self.used = np.zeros(1 << SLOT_BITS, bool)
        at = self._slot(keys)
        self.keys[at], self.used[at] = keys, True
        won = self.keys[at] == keys
        self.values[at[won]] = values[won]
        lost = ~won
        order = np.argsort(keys[lost])
        self.rest, self.rest_values = keys[lost][order], values[lost][order]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        miss = np.flatnonzero((self.keys[at] != keys) | ~self.used[at])
        out[miss] = 0
        if len(self.rest) and len(miss):
            found = np.minimum(np.searchsorted(self.rest, keys[miss]), len(self.rest) - 1)
            out[miss] = np.where(self.rest[found] == keys[miss], self.rest_values[found], 0)
        return out


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


NAMES = [f.split()[0] for f in OUT.split(", ")]


class _Scorer:
    """Scores the texts of one chunk as they pass, after the values of its n-grams and words."""

    def __init__(self, depth: int, n: int, v: int, parts: dict[int, list]):
        self.depth, self.n, self.v = depth, n, v
        own, others, grams = (tuple(np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0)), *parts[k], strict=True)) for k in (OWN, WORDS, GRAMS))
        alone = ~np.isin(own[0], others[0])
        self.words, self.grams = Lookup(np.concatenate([others[0], own[0][alone]]), np.concatenate([others[1], own[1][alone]])), Lookup(*grams)
        self.tail, self.sums = END * depth, np.zeros(5)

    def __call__(self, blob):
        t = pa.ipc.open_stream(blob.as_buffer()).read_all()
        ids, held, last = t.column("doc_id").to_pylist(), t.column("held_out").to_pylist(), t.column("last").to_pylist()
        texts, at = t.column("entry"), 0
        while at < len(ids):
            bodies, size, end = [], 0, at
            while end < len(ids) and size < BLOCK:
                bodies.append(texts[end].as_py())
                size += len(bodies[-1]) + 8
                end += 1
            yield self._block(ids[at:end], held[at:end], last[at:end], bodies)
            at = end

    def _block(self, ids, held, last, bodies) -> pa.RecordBatch:
        m = len(bodies)
        each = [word_keys(b, z) for b, z in zip(bodies, last, strict=True)]
        sizes = np.fromiter(map(len, each), np.int64, m)
        owner = np.repeat(np.arange(m), sizes)
        c = self.words(np.concatenate(each))
        found = np.zeros((m, 5))
        found[:, 0], found[:, 1] = sizes, np.bincount(owner, c > 0, m)
        found[:, 2] = np.bincount(owner, np.log10((c + 1) / (self.n + self.v + 1)), m)
        coded = []
        for b, z in zip(bodies, last, strict=True):
            coded.append(self.tail + b)
            self.tail = END * self.depth if z else coded[-1][-self.depth :]
        keys, owner = gram_keys(coded, self.depth)
        found[:, 3], found[:, 4] = np.bincount(owner, self.grams(keys), m), np.bincount(owner, minlength=m)
        ends = np.flatnonzero(last)  # pieces of one text are added up
        run = np.cumsum(np.vstack([self.sums, found]), 0)
        upto = run[ends + 1]
        total = np.diff(np.vstack([np.zeros(5), upto]), axis=0)
        self.sums = run[-1] - (upto[-1] if len(ends) else 0)
        k = len(ends)
        columns = [pa.array([ids[i] for i in ends], pa.int64()), pa.array([held[i] for i in ends], pa.bool_()), pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1].astype(np.int64)), pa.array(np.full(k, self.n, np.int64)), pa.array(total[:, 2]), pa.array(total[:, 3]), pa.array(-total[:, 3] * np.log2(10) / total[:, 4])]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _score(depth: int, n: int, v: int):
    def run(batches):
        chunk, parts, scorer = None, {}, None
        for b in batches:
            for c, kind, m, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if c != chunk:
                    chunk, parts, scorer = c, {OWN: [], WORDS: [], GRAMS: []}, None
                    give_back()
                if kind != TEXTS:
                    parts[kind].append(_unblob(m, packed))
                    continue
                if scorer is None:
                    scorer, parts = _Scorer(depth, n, v, parts), {}
                yield from scorer(packed)
        scorer = None
        give_back()

    return run


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Scores of all texts under a context tree and a word model learned from the rows where ``train`` holds.

    Null texts are empty: one token, the end. Rows are scored one by one, so
    ties, repeated rows and null ids pass through (a null ``train`` is held
    out); further columns are left out, whatever their names. Very long texts
    are counted and scored in pieces. Without training rows each decision has
    probability 1/2. An empty table gives no rows. ``score`` and ``base_score``
    are log10 probabilities of the text and of its words alone;
    ``bits_per_byte`` is the code length.
    """
    if depth < 3:
        raise ValueError("depth is 3 or more")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (~F.coalesce(train, F.lit(False))).alias("held_out"), F.col(text_col).alias("text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    parts, fewer = rows.rdd.getNumPartitions(), -(-size // CHUNK) or 1
    if parts > fewer:  # scan tasks below a chunk's size are joined, without a shuffle
        rows, parts = rows.coalesce(fewer), fewer
    chunks = staged(rows.mapInArrow(_pack(depth, max(parts, 1)), ROW), "text-chunks")
    found = chunks.select("chunk", "kind", "key", "n")
    words, grams = found.where(F.col("kind") == WORD), found.where(F.col("kind") == GRAM)
    counts = staged(words.groupBy("key").agg(F.sum("n").alias("c")), "word-counts")
    n, v, number = *counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first(), (chunks.where(F.col("kind") == TEXTS).agg(F.max("chunk")).first()[0] or 0) + 1
    known = words.join(counts, "key").where("c <> n")  # a chunk knows its own counts
    near = F.shiftright("key", 8 * (depth - 2)).alias("near")  # the three nearest bytes of context
    sums = staged(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams").select(near, "key", "n")
    low = sums.repartition("near").sortWithinPartitions("near", "key").mapInArrow(_summary(depth), "c2 long, node long, n0 double, n1 double, log_w double")
    low = low.groupBy("c2", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_w")])
    second = staged(low.mapInArrow(_second, SECOND), "two-byte-nodes")  # 256 ** 2 * 255 rows at most
    first = second.groupBy(F.shiftright("c2", 8).alias("c1"), "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_w")]).toArrow()  # 256 * 255 rows at most
    top = Top(*(first.column(c).to_numpy() for c in ("c1", "node", "n0", "n1", "log_w")))
    nodes = sums.select("near", F.shiftright("near", 8).alias("c2")).distinct().join(second, "c2")
    nodes = nodes.select("near", F.lit(0).alias("kind"), F.col("node").alias("key"), "n0", "n1", "share")
    zero = F.lit(0.0)
    both = nodes.union(sums.select("near", F.lit(1), "key", F.col("n").cast("double"), zero, zero))
    values = both.repartition("near").sortWithinPartitions("near", "kind", "key").mapInArrow(_values(depth, top), "key long, value double")
    told = grams.select("chunk", "key").join(values, "key").select("chunk", F.lit(GRAMS).cast("byte").alias("kind"), "key", "value")
    told = told.union(known.select("chunk", F.lit(WORDS).cast("byte"), "key", F.col("c").cast("double")))
    back = staged(told.mapInArrow(_packed, ROW), "told", instead=(counts,))
    columns = ["chunk", "kind", "n", "packed", "seq"]
    stream = chunks.where(F.col("kind") <= TEXTS).select(*columns).union(back.select(*columns))
    dealt = stream.repartitionById(number, F.col("chunk").cast("int")).sortWithinPartitions("chunk", "kind", "seq")
    dropped(second)
    return dealt.mapInArrow(_score(depth, n, v), OUT)
