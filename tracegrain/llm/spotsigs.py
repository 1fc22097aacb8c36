"""Document fingerprints from spot signatures.

A common word (anchor) followed by a chain of content words is a signature, and
so is a chain of words where no anchor's chain reaches; the set of a text's
signatures, hashed and sorted, is its fingerprint. Two texts are
alike as their sets are (Jaccard). For pairs above a threshold, sets are
partitioned by length: sets whose lengths differ too much can't be similar, so
a set meets only its own and the next partition, on its rarest signatures, and
the comparison stops as soon as the threshold is out of reach.
"""

from __future__ import annotations

import base64
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.plans.materialize import staged

#: Content words of a chain, and how many content words apart they are.
CHAIN, DISTANCE = 3, 1
#: An anchor's chain may reach this many words for each word of a chain over adjacent words.
REACH = 4
# The most common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "the of and to in a is it that for was on are as with be by at this from or an not "
    "le la les de des du un une et en que qui est dans pour sur au par pas "
    "der die das und den von zu mit im dem auf ist ein eine nicht als "
    "el los las y del se con por para al lo como su es".split()
)
_WORD = re.compile(r"\w+")
STAND_IN = -(1 << 63)
#: Bounds give way by this much, so that sets which reach a threshold exactly are compared.
ROUNDING = 1e-9
#: Bytes of text in a range of ids, and the most ranges; beyond, ranges grow and stream by.
RANGE_BYTES, RANGES = 16 << 20, 20_000


def signatures(text: str | None, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit signatures.

    An anchor's chain counts if it ends at most ``REACH`` times a chain's length
    after it. Each word outside all of these starts a chain over adjacent words
    (the last words share the last one), so no stretch is without signatures
    and a word decides on those near it only. A signature's second, third, ...
    occurrence is a signature of its own, so repeats count. A text with fewer words than a
    chain is a single signature, and so is a non-empty text without words. The
    empty text has none.
    """
    if not text:
        return np.zeros(0, np.uint32)
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF], np.uint32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    anchor = np.fromiter(map(ANCHORS.__contains__, words), bool, len(words))
    span = (chain - 1) * distance

    def chains(sig, at, content):
        for i in range(chain):
            sig = (sig ^ (sig >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[content[at + i * distance]]
        return sig

    if len(words) > span:
        spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        at = np.searchsorted(content, spots, side="right")
        fits = at + span < len(content)
        spots, at = spots[fits], at[fits]
        near = content[at + span] - spots <= REACH * chain * distance
        spots, at = spots[near], at[near]
        ends = np.bincount(spots, minlength=len(words)) - np.bincount(content[at + span] + 1, minlength=len(words) + 1)[:-1]
        bare = np.unique(np.minimum(np.flatnonzero(np.cumsum(ends) == 0), len(words) - 1 - span))
        sig = np.concatenate([chains(h[spots], at, content), chains(np.full(len(bare), 7, np.uint64), bare, np.arange(len(words)))])
    else:
        sig = np.array([xxhash.xxh3_64_intdigest(" ".join(words))], np.uint64)
    sig = np.sort(sig)  # repeats are numbered: sets compare as multisets
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    times = np.arange(len(sig)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    sig = sig + times.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    sig = (sig ^ (sig >> np.uint64(33))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((sig >> np.uint64(32)).astype(np.uint32))


def pack(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode("ascii")


def unpack(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets, 1 for two empty ones; 0 as soon as ``least`` is out of reach."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 1.0
    if len(small) < least * len(large) - ROUNDING:
        return 0.0
    misses = len(small) - least / (1 + least) * (len(small) + len(large))  # more misses in the small set than this are too many
    both = missed = 0
    for i in range(0, len(small), 256):
        part = small[i : i + 256]
        at = np.searchsorted(large, part)
        hit = int((large[np.minimum(at, len(large) - 1)] == part).sum())
        both, missed = both + hit, missed + len(part) - hit
        if missed > misses + ROUNDING:
            return 0.0
    return both / (len(small) + len(large) - both)


def fingerprint(text):
    """A column: the fingerprint of each text; equal texts have equal ones, null and empty texts the empty one."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(signatures(t)) for t in texts], dtype=object)

    return of(text)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text: the text of the next document in ascending id, after the last the first.

    Rows are dealt to id ranges, as many as the bytes of the texts ask for, and
    stream by in order; the first row of each range is also sent to the range
    before it. Null ids come first and ties are ordered by text; null texts are
    empty; a single row is its own next. Very long texts pass one by one;
    further columns are left out. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(STAND_IN)).alias("id"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = int(min(RANGES, size // RANGE_BYTES + 1))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))  # as many as ranges

    @F.pandas_udf("int")
    def range_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = sorted((r.range, r.low) for r in ids.groupBy(range_of("id").alias("range")).agg(F.min("id").alias("low")).collect())
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}  # after the first range comes the last

    @F.pandas_udf("array<struct<range:int,tail:boolean>>")
    def places(i: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, i.to_numpy(np.int64), side="right")
        return pd.Series([[{"range": int(r), "tail": False}, *([{"range": before[x], "tail": True}] if x in before else [])] for r, x in zip(at, i, strict=True)])

    dealt = rows.withColumn("p", F.explode(places(F.coalesce("doc_id", F.lit(STAND_IN))))).select("p.range", "p.tail", "doc_id", "text")

    def pair(batches):
        held = None  # the row that waits for its next
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for r, tail, i, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if held is not None and held[0] == r:
                        out.append((held[1], held[2], text))
                        size += len(text)
                        held = None
                    if not tail:
                        held = (r, i, text)
                    if size > 1_000_000:
                        yield _triples(out)
                        out, size = [], 0
        if out:
            yield _triples(out)

    ordered = dealt.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return ordered.mapInArrow(pair, "doc_id long, text string, next_text string")


def _triples(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "text", "next_text"])


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints that are alike to ``least`` or more, and who has which fingerprint.

    Returns (a, b, likeness) between class representatives, and (doc_id, rep).
    Copies are one class, represented by its smallest id, and are not expanded.
    Sets without a signature are alike only to each other. Null ids take no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(text_col).alias("fp")).where("doc_id IS NOT NULL")
    rows = staged(rows, "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    member = rows.join(classes, "fp").select("doc_id", "rep")

    @F.pandas_udf("array<long>")
    def sigs(fp: pd.Series) -> pd.Series:
        return pd.Series([unpack(f).astype(np.int64) for f in fp])

    length = F.octet_length(F.unbase64("fp")) / 4
    sets = staged(classes.select("rep", "fp", length.cast("int").alias("n")).where("n > 0"), "signature-sets")
    known = sets.select(F.explode(sigs("fp")).alias("sig"), "rep", "n")
    rare = known.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    at = F.row_number().over(Window.partitionBy("rep").orderBy("f", "sig"))
    # signatures of one set alone are the rarest: they take their places, but can't be shared
    prefix = known.join(rare, "sig").withColumn("at", at).where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - ROUNDING) + 1) & (F.col("f") > 1))
    step = math.log(1 / least)
    level = F.floor(F.log(F.col("n").cast("double")) / step + ROUNDING).cast("int")
    short = prefix.select("sig", level.alias("level"), F.col("rep").alias("x"), F.col("n").alias("nx"))
    long = prefix.select("sig", F.explode(F.array(level, level - 1)).alias("level"), F.col("rep").alias("y"), F.col("n").alias("ny"))
    fit = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = short.join(long, ["sig", "level"]).where(fit & (F.col("nx") >= F.col("ny") * least - ROUNDING)).select("x", "y").distinct()

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(unpack(p), unpack(q), least) for p, q in zip(a, b, strict=True)], dtype=float)

    left, right = (sets.select(F.col("rep").alias(c), F.col("fp").alias(f"f{c}")) for c in ("x", "y"))
    found = pairs.join(left, "x").join(right, "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), like("fx", "fy").alias("likeness"))
    return found.where(F.col("likeness") >= least), member
