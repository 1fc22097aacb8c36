"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations make every coordinate of a signature: the first places a
shingle in a slot; the second, shifted circularly by k, ranks the slots for
coordinate k. A document's coordinates are one minimum over contiguous runs of
the second permutation.

Documents with the same words are one class, a node. Nodes that share a band
form a bucket. Buckets are not expanded into pairs. First, in each of a few
rounds, a bucket compares one hub with its members of other components; links
are confirmed on the full shingle sets, and components are merged. Then the
members that are left in several components are dealt to pairs of blocks. A
task that gets a pair of blocks compares the full sets there and passes on the
links that join components, a spanning forest: fewer rows than it has members.
So all rows are linear in a bucket, whatever its members have in common.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.components import components
from tracegrain.llm.pieces import cut
from tracegrain.plans.materialize import dropped, staged

SHINGLE, BANDS, ROWS, SLOTS, SEED = 5, 32, 4, 1 << 21, 71
#: Similarity as numerator over denominator: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Most rounds of hubs before blocks, and members that a task compares with one hub.
HUB_ROUNDS, HUB_SHARE = 3, 512
#: Members and shingles of a block; a longer document is a block of its own.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Coordinates, of 128, in which a pair must agree (in their low byte) to be compared in full: at similarity 0.75
#: fewer agree with a probability of 2.6e-8.
AGREEING = 68
#: Bytes of a text that are split into words at a time.
PIECE = 4 << 20
_PERMUTATIONS: dict = {}


def word_hashes(text: str | None) -> tuple[np.ndarray, bytes]:
    """Hashes of the words (A-Z lower-cased, ASCII white space between them), and a digest of all of them."""
    digest, found = xxhash.xxh3_128(), []
    for piece in cut((text or "").encode("utf-8").lower(), PIECE):
        tokens = piece.split()
        if tokens:
            found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)))
            digest.update(b" ".join([*tokens, b""]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), digest.digest()


def shingles(w: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words make one shingle, none make none."""
    if not len(w):
        return np.zeros(0, np.uint64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    if not _PERMUTATIONS:
        rng = np.random.default_rng(SEED)
        place, rank = rng.permutation(SLOTS).astype(np.int32), rng.permutation(SLOTS).astype(np.int32)
        k = BANDS * ROWS
        _PERMUTATIONS["place"] = place
        _PERMUTATIONS["rank"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:k]]), k)
    return _PERMUTATIONS["place"], _PERMUTATIONS["rank"]


def signature(h: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of hashes."""
    place, rank = _permutations()
    at = place[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
    return np.minimum.reduce([rank[at[i : i + 4096]].min(0) for i in range(0, len(at), 4096)])


def bands(coordinates: np.ndarray) -> np.ndarray:
    s = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + s[:, i]
    return ((key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


SIGNED = "doc_id long, own long, n long, key binary, bands array<long>, marks binary"


def _sign(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            n, key, found, marks, ends = [], [], [], [], [0]
            for text in b.column(2):
                w, digest = word_hashes(text.as_py())
                h = shingles(w)
                n.append(len(h))
                key.append(digest)
                coordinates = signature(h) if len(h) else None
                if len(h):
                    found.append(bands(coordinates))
                marks.append((coordinates & 255).astype(np.uint8).tobytes() if len(h) else b"")
                ends.append(ends[-1] + (BANDS if len(h) else 0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists, pa.array(marks, pa.binary())], names=["doc_id", "own", "n", "key", "bands", "marks"])


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(batches):
    """The pairs (hub, node) that can be similar by their sizes and signatures."""
    for b in batches:
        n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
        fit = DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)
        if b.num_rows:
            fit &= (_marks(b.column(4)) == _marks(b.column(5))).sum(1) >= AGREEING
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fit)), b.column(1).filter(pa.array(fit))], names=["hub", "node"])


def _compare(batches):
    """Rows come sorted by (hub, share, member): a hub's own row, then those compared with it."""
    hub, own = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            left, right = [], []
            hubs, members, nodes = (b.column(i).to_pylist() for i in range(3))
            for h, member, i, text in zip(hubs, members, nodes, b.column(3), strict=True):
                if not member:
                    if h != hub:
                        hub, own = h, shingles(word_hashes(text.as_py())[0])
                    continue
                h2 = shingles(word_hashes(text.as_py())[0])
                both = len(np.intersect1d(own, h2, assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (len(own) + len(h2) - both):
                    left.append(h)
                    right.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, node) whose full sets are similar enough, as (a, b).

    The members of a popular hub are dealt to several tasks, each with a copy of
    the hub's own text; a task holds one hub's set and one member's at a time.
    """
    share = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).cast("int").alias("shares"))
    members = pairs.join(share, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), F.lit(True).alias("member"), "node")
    hubs = share.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("member"), F.col("hub").alias("node"))
    rows = members.union(hubs).join(texts, "node").select("hub", "member", "node", "text", "share")
    dealt = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", "member")
    return dealt.mapInArrow(_compare, "a long, b long")


class Forest:
    """Components of a block's members, and the links that joined some."""

    def __init__(self, comp: np.ndarray):
        self.parent = np.unique(comp, return_inverse=True)[1].reshape(-1)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.parent[i], self.parent[j]
        if a != b:
            self.parent[self.parent == b] = a
            self.links.append((i, j))


def _candidates(t: dict, marks: np.ndarray, comp: np.ndarray, i: int, right: np.ndarray) -> np.ndarray:
    """Members of side 1 that ``i`` of side 0 can be similar to, most agreeing first; two minor members meet once."""
    js = right[comp[right] != comp[i]]
    js = js[~t["minor"][js] | (t["node"][js] > t["node"][i])]
    js = js[DENOMINATOR * np.minimum(t["n"][js], t["n"][i]) >= NUMERATOR * np.maximum(t["n"][js], t["n"][i])]
    agree = (marks[js] == marks[i]).sum(1)
    js, agree = js[agree >= AGREEING], agree[agree >= AGREEING]
    return js[np.argsort(-agree, kind="stable")]


PAIR = ("bucket", "bx", "by")


def by_blocks(kernel):
    """Runs ``kernel`` on each pair of blocks of a task; rows come sorted by pair, and one pair is held at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in PAIR]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, x])
                if held and key != last:
                    yield from kernel(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(b.slice(x, y - x))
                last = key
        if held:
            yield from kernel(pa.Table.from_batches(held)).to_batches()

    return run


def in_blocks(rows: DataFrame, kernel, schema: str) -> DataFrame:
    return rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(by_blocks(kernel), schema)


def _columns(table: pa.Table) -> dict:
    return {c: table.column(c).to_numpy() for c in ("bucket", "node", "n", "comp", "side", "minor")}


def _survivors(table: pa.Table) -> pa.Table:
    """Members of a pair of blocks with a candidate there."""
    t, marks = _columns(table), _marks(table.column("marks"))
    right, keep = np.flatnonzero(t["side"] == 1), np.zeros(table.num_rows, bool)
    for i in np.flatnonzero(t["side"] == 0):
        js = _candidates(t, marks, t["comp"], i, right)
        keep[js] = True
        keep[i] |= len(js) > 0
    return pa.table({"bucket": t["bucket"][keep], "node": t["node"][keep]})


def _linked(table: pa.Table) -> pa.Table:
    """A spanning forest of the links of a pair of blocks, on full sets."""
    t, marks = _columns(table), _marks(table.column("marks"))
    sets = [shingles(word_hashes(x.as_py())[0]) for x in table.column("text")]
    ends = np.cumsum([0, *map(len, sets)])
    known, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    del sets
    forest, mine, right = Forest(t["comp"]), np.zeros(len(known), bool), np.flatnonzero(t["side"] == 1)
    for i in np.flatnonzero(t["side"] == 0):
        js = _candidates(t, marks, forest.parent, i, right)
        mine[flat[ends[i] : ends[i + 1]]] = True
        while len(js):
            part, js = js[:64], js[64:]
            both = np.array([np.count_nonzero(mine[flat[ends[j] : ends[j + 1]]]) for j in part])
            for j in part[DENOMINATOR * both >= NUMERATOR * (t["n"][i] + t["n"][part] - both)]:
                forest.join(i, j)
            js = js[forest.parent[js] != forest.parent[i]]
        mine[flat[ends[i] : ends[i + 1]]] = False
    left, right = (np.array([t["node"][x[s]] for x in forest.links], np.int64) for s in (0, 1))
    return pa.table({"a": left, "b": right})


def unlike(rows: DataFrame) -> DataFrame:
    """Of buckets with the same members, the smallest only: the others have the same pairs."""
    same = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    one = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), *same).groupBy("m", "s0", "s1").agg(F.min("bucket").alias("bucket"))
    return rows.join(one.select("bucket"), "bucket", "left_semi")


def deal(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, comp) of buckets with several components, dealt to pairs of blocks.

    Members outside a bucket's largest component (minor) meet all members, so one
    large component costs a pass and not its square.
    """
    by_comp = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    bucket = by_comp.groupBy("bucket").agg(F.max_by("comp", "m").alias("major"), F.max("m").alias("m"), F.max_by("s", "m").alias("s"), F.sum("m").alias("all_m"), F.sum("s").alias("all_s")).where("all_m > m")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    sized = rows.join(bucket, "bucket").select("bucket", "node", "n", "comp", (F.col("comp") != F.col("major")).alias("minor"), blocks(F.col("all_m") - F.col("m"), F.col("all_s") - F.col("s")).alias("x"), blocks(F.col("all_m"), F.col("all_s")).alias("y"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("node"), F.col(c)).cast("int"))
    sides = F.array(F.struct(F.lit(0).alias("side"), own("x").alias("bx"), every("y").alias("by")), F.struct(F.lit(1).alias("side"), every("x").alias("bx"), own("y").alias("by")))
    placed = sized.withColumn("at", F.explode(F.filter(sides, lambda s: (s["side"] == 1) | F.col("minor"))))
    return placed.select("bucket", "node", "n", "comp", "minor", "at.side", F.explode("at.bx").alias("bx"), "at.by").withColumn("by", F.explode("by"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df``.

    Documents are linked if 100 * intersection >= 75 * union of their distinct
    5-word shingles (A-Z lower-cased, ASCII white space between words; fewer
    words make one shingle). A null text or one without words has no shingles
    and stays alone. Rows that repeat an id are documents of their own, linked by
    their own texts. Rows without an id are linked like others but can only
    stand for a group that has no id at all: there component_id is null, and
    kept is true for the rows of the smallest text hash. Any long is an id. A
    very long text is split into words piece by piece. An empty table gives no
    rows; further columns are left out.
    """
    signed, first = _groups(df, id_col, text_col)
    alone = F.col("first").isNull()
    unnamed = F.col("first.none") & F.col("doc_id").isNull() & (F.col("first.own") == F.col("own"))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False)) | unnamed
    rows = signed.select("doc_id", "own", "n", "key").join(first, "key", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, one of each group of near duplicates.

    The row of the smallest id stays, of a group without ids that of the
    smallest text hash; of rows that repeat both id and text, any one. Rows
    without words all stay. An empty table gives no rows.
    """
    name, own, at = "__tracegrain_id", "__tracegrain_own", "__tracegrain_at"
    stay = staged(_groups(df, id_col, text_col)[1].select(F.col("first.doc_id").alias(name), F.col("first.own").alias(own)).distinct(), "stay")
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = df.where(worded).withColumn(name, F.col(id_col).cast("long")).withColumn(own, _own(text_col))
    held = rows.alias("r").join(stay.alias("s"), F.col(f"r.{own}").eqNullSafe(F.col(f"s.{own}")) & F.col(f"r.{name}").eqNullSafe(F.col(f"s.{name}")), "left_semi")
    one = F.row_number().over(Window.partitionBy(own, name).orderBy(F.lit(0)))
    return held.withColumn(at, one).where(F.col(at) == 1).drop(name, own, at).union(df.where(~worded))


def _own(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text_col))


def _groups(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and for each class of equal words (key) the first row of its component: without id last, by id and text hash."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _own(text_col).alias("own"), F.col(text_col).alias("text"))
    signed = staged(rows.mapInArrow(_sign, SIGNED), "signatures")
    classes = signed.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own", "n", "bands", "marks")).alias("r"))
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "key", F.struct("r.none", "r.doc_id", "r.own").alias("first"), "r.n", "r.bands", "r.marks"), "classes")
    comp, links = _components(rows, nodes)
    firsts = nodes.select("key", "node", "first")
    if comp is not None:
        named = firsts.join(comp.withColumnRenamed("id", "node"), "node", "left").select("key", "first", F.coalesce("comp", "node").alias("comp"))
        low = named.groupBy("comp").agg(F.min("first").alias("first"))
        firsts = named.select("key", "comp").join(low, "comp")
    out = staged(firsts.select("key", "first"), "firsts", instead=(nodes, comp, *links))
    return signed, out


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; a row that repeats id and text counts once."""
    at = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.own").alias("p")
    found = rows.where(F.length("text") > 0).alias("r").join(at, F.col("r.own").eqNullSafe(F.col("p.own")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")))
    return found.groupBy("p.node").agg(F.min("r.text").alias("text"))


def _components(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(id, comp) of the linked nodes, None where no bucket has two; and the tables of links."""
    sketch = nodes.select("node", "n", "marks")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    opened = staged(members.join(several.select("bucket"), "bucket", "left_semi").select("bucket", "node", "n"), "buckets")
    links: list[DataFrame] = []
    comp, before = None, None
    for step in range(HUB_ROUNDS):
        placed = _placed(opened, comp)
        rank = F.xxhash64(F.lit(step), "node")
        hubs = placed.groupBy("bucket").agg(F.min_by("node", rank).alias("hub"), F.min_by("comp", rank).alias("hub_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        opened_now = staged(placed.join(hubs.select("bucket", "hub", "hub_comp"), "bucket"), "open-buckets", instead=(opened,))
        opened, n = opened_now, opened_now.count()
        if not n or before is not None and 10 * n > 9 * before:  # hubs leave little to blocks, or no longer help
            break
        before = n
        pairs = opened.where("comp <> hub_comp").select("hub", "node").distinct()
        near = pairs.join(sketch.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("marks").alias("hub_marks")), "hub").join(sketch, "node")
        near = staged(near.select("hub", "node", "hub_n", "n", "hub_marks", "marks").mapInArrow(_likely, "hub long, node long"), "hub-pairs")
        texts = staged(_texts(rows, nodes, near.select("node").union(near.select("hub"))), "texts")
        links.append(staged(confirm(near, texts), "near-links", instead=(near, texts)))
        comp = _merged(links, comp)
    placed = staged(_placed(unlike(opened), comp), "unlike-buckets", instead=(opened,))
    marks = sketch.select("node", "marks")
    left = in_blocks(deal(placed).join(marks, "node"), _survivors, "bucket long, node long").distinct()
    left = staged(left.join(placed, ["bucket", "node"]).select("bucket", "node", "n", "comp"), "survivors", instead=(placed,))
    left = staged(unlike(left), "block-members", instead=(left,))
    if not left.isEmpty():
        texts = staged(_texts(rows, nodes, left), "texts")
        full = deal(left).join(marks, "node").join(texts, "node")
        links.append(staged(in_blocks(full, _linked, "a long, b long"), "block-links", instead=(texts,)))
        comp = _merged(links, comp)
    dropped(left)
    return comp, links


def _placed(opened: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members with their component so far."""
    rows = opened.select("bucket", "node", "n")
    if comp is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comp.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))


def _merged(links: list[DataFrame], comp: DataFrame | None) -> DataFrame:
    found = components(reduce(DataFrame.union, links))
    dropped(comp)
    return found
