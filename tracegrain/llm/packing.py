"""Variable-capacity best-fit packing of documents into training sequences.

Token lengths are bounded integers, so the multiset of lengths is a histogram
with at most as many entries as the largest permitted length, however many
documents there are. The driver packs the histogram best-fit decreasing: all
bins in the same state are one group, so its work depends on the lengths and not
on the documents. A piece goes to the fullest bin that can take it, of equally
full ones to the first opened; otherwise a bin is opened at the size that the
opening rule names for pieces of its class (those with the same least size that
fits). The sizes of all classes are chosen jointly: from the cheapest rule that
is the same for all classes on, the size of one class after the other is changed
as long as the total cost falls, after downsizing every bin to its contents.

Documents find their bins by their rank among pieces of equal length. Ranks are
counted in salted parts, so a length that most documents share is not one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.plans.materialize import staged

#: Permitted sequence lengths, and what a sequence costs besides its length, in tokens.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 32
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    """Slices (length, first rank, pieces, first bin, pieces a bin, offset in the bin) and groups (first bin, bins, tokens, capacity)."""

    slices: np.ndarray
    groups: np.ndarray
    cost: int


def uniform(capacities: tuple[int, ...], size: int | None) -> tuple[int, ...]:
    """The rule that opens ``size`` wherever the piece fits it, and the least-cost size that fits elsewhere or for None."""
    return tuple(max(c, size or 0) for c in sorted(capacities))


def pack(lengths: np.ndarray, counts: np.ndarray, capacities: tuple[int, ...], opening: tuple[int, ...], overhead: int = OVERHEAD) -> Plan:
    """Best-fit decreasing of a histogram; ``opening``: the size of new bins for the pieces of each class, by ascending class."""
    sizes = sorted(capacities)
    cost = {c: c + overhead for c in sizes}
    open_bins: dict[int, list[list[int]]] = {}  # remaining -> heap of groups [first bin, bins, used]
    rooms: list[int] = []
    slices, bins, closed = [], 0, []

    def put(room: int, group: list[int]) -> None:
        if room == 0:
            closed.append(group)
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        heappush(open_bins[room], group)

    order = np.argsort(-lengths, kind="stable")
    for length, n in zip(lengths[order].tolist(), counts[order].tolist(), strict=True):
        rank = 0
        while rank < n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, m, used = heappop(open_bins[room])
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                size = opening[bisect_left(sizes, length)]
                room, used, first = size, 0, bins
                m = -(-(n - rank) // (size // length))
                bins += m
            each = room // length
            full = min(m, (n - rank) // each)
            if full:
                slices.append((length, rank, full * each, first, each, used))
                put(room - each * length, [first, full, used + each * length])
                rank += full * each
            if full < m:
                rest = [first + full, m - full, used]
                if rank < n:  # the last pieces share one bin
                    k = n - rank
                    slices.append((length, rank, k, rest[0], k, used))
                    put(room - k * length, [rest[0], 1, used + k * length])
                    rank = n
                    rest = [rest[0] + 1, rest[1] - 1, used]
                if rest[1]:
                    put(room, rest)
    groups = []
    for first, m, used in [*closed, *(g for gs in open_bins.values() for g in gs)]:
        groups.append((first, m, used, next(c for c in sizes if c >= used)))  # downsized to its contents
    groups = np.array(sorted(groups), np.int64).reshape(-1, 4)
    total = int(sum(m * cost[c] for _, m, _, c in groups.tolist()))
    return Plan(np.array(sorted(slices), np.int64).reshape(-1, 6), groups, total)


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """The cheapest plan that the joint choice of opening sizes finds: no single rule for all classes is cheaper."""
    sizes, tried = sorted(capacities), {}

    def plan(rule: tuple[int, ...]) -> Plan:
        if rule not in tried:
            tried[rule] = pack(lengths, counts, capacities, rule, overhead)
        return tried[rule]

    best = min((uniform(capacities, size) for size in (None, *sizes)), key=lambda r: plan(r).cost)
    better = True
    while better:  # the cost falls each time, so it ends
        better = False
        for k in reversed(range(len(sizes))):
            for size in sizes[k:]:
                rule = (*best[:k], size, *best[k + 1 :])
                if plan(rule).cost < plan(best).cost:
                    best, better = rule, True
    return plan(best)


def token_length(text_col: str = "text") -> Column:
    """Words, and one token for the end; a null text is empty."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)) + 1


def best_fit(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Where each piece of each document goes.

    doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_tokens and
    bin_capacity. Documents longer than the largest capacity are cut into pieces
    of that capacity and a rest; no token is dropped. A null or non-positive
    length counts as 1. Rows of null or repeated ids are documents of their own;
    equal lengths are ranked by id; further columns don't matter. A very long
    text is only counted. An empty table gives no rows.
    """
    spark = df.sparkSession
    most = max(capacities)
    size = F.greatest(F.coalesce(token_length() if length is None else length, F.lit(1)), F.lit(1)).cast("long")
    docs = df.select(F.col(id_col).alias("doc_id"), size.alias("len"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = docs.select("doc_id", "len", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", F.col("start").alias("piece_start"), F.least(F.col("len") - F.col("start"), F.lit(most)).alias("n_tokens"))
    pieces = staged(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    parts = pieces.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = parts.groupBy("n_tokens").agg(F.sum("n").alias("n")).toArrow()  # a row a length: at most the largest capacity
    plan = best_plan(histogram.column(0).to_numpy(), histogram.column(1).to_numpy(), capacities, overhead)
    ahead = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("within", within).join(base, ["n_tokens", "salt"]).select("doc_id", "piece", "piece_start", "n_tokens", (F.col("base") + F.col("within")).alias("rank"))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacities: see README

    def place(batches):
        s, g = shared.value.slices, shared.value.groups
        names = ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "bin_capacity"]
        starts = {int(x): (int(a), int(b)) for x, a, b in zip(*_runs(s[:, 0]), strict=True)} if len(s) else {}
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = np.zeros(len(n), np.int64)
            for x in np.unique(n):
                a, z = starts[int(x)]
                mine = n == x
                at[mine] = a + np.searchsorted(s[a:z, 1], rank[mine], side="right") - 1
            i = rank - s[at, 1]
            bin_id, offset = s[at, 3] + i // s[at, 4], s[at, 5] + i % s[at, 4] * n
            group = np.searchsorted(g[:, 0], bin_id, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(bin_id), pa.array(offset), pa.array(g[group, 2]), pa.array(g[group, 3])], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_tokens long, bin_capacity long")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))
