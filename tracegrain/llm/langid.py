"""Language identification with bit-sliced n-gram Bloom filters.

Every slot of one filter holds a word of bits, one bit a language. The bitwise
AND of an n-gram's slots returns all languages whose profile contains it. A
text's n-grams are looked up, hits are counted per language, each count is
corrected for the language's false-positive rate, and the largest decides.

A language's profile holds the n-grams that it uses at least as often as the
average language. The filter has a fixed number of slots, whatever the corpus:
more n-grams raise the false-positive rate, which the correction takes out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.plans.materialize import staged

#: Characters of an n-gram, slots (as a power of 2), hashes, and the least rate of an n-gram in a profile.
GRAMS, SLOT_BITS, HASHES, LEAST_RATE = (2, 3), 20, 4, 1e-6
#: Characters handled at a time, and distinct n-grams a task holds before it passes them on.
BLOCK_CHARS, TASK_GRAMS = 1_000_000, 2_000_000
#: Most languages; more distinct values are an error, as the column then holds something else.
LANGUAGES = 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams in the words of the texts, the text of each, and which texts have a letter.

    Words are runs of letters, in lower case, with a boundary on either side.
    """
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in codes])
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    letter = _letters()[c]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    c = np.where(letter, c, 0).astype(np.uint64)
    keys, owners = [], []
    for n in GRAMS:
        if len(c) < n:
            continue
        key, last = np.full(len(c) - n + 1, n, np.uint64), len(c) - n + 1
        inside, same = np.ones(last, bool), owner[:last] == owner[n - 1 :]
        for i in range(n):
            part = c[i : i + last]
            key = key * np.uint64(1_114_121) + part  # above every code point
            if 0 < i < n - 1:
                inside &= part > 0
        inside &= (c[:last] > 0) | (c[n - 1 :] > 0)
        inside &= same
        keys.append(key[inside])
        owners.append(owner[:last][inside])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *keys]), np.concatenate([np.zeros(0, np.int32), *owners]), has


def slots(keys: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    h = keys * _MIX[0]
    h ^= h >> np.uint64(29)
    return [((h * _MIX[i + 1]) >> np.uint64(64 - bits)).astype(np.int64) for i in range(hashes)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (words of 64 languages, slots)
    false_rate: np.ndarray
    bits: int = SLOT_BITS
    hashes: int = HASHES

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams that each language contains, by text; which texts have a letter."""
        keys, owner, has = grams(texts)
        at = slots(keys, self.bits, self.hashes)
        total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        out = np.zeros((len(texts), len(self.languages)))
        for w in range(len(self.table)):
            found = self.table[w][at[0]]
            for s in at[1:]:
                found &= self.table[w][s]
            for bit in range(min(64, len(self.languages) - 64 * w)):
                hit = (found >> np.uint64(bit)) & np.uint64(1)
                out[:, 64 * w + bit] = np.bincount(owner, weights=hit, minlength=len(texts)) / total
        return np.clip((out - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), has

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its share against the runner-up's, and its share of the n-grams."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        share, has = self.shares(texts)
        best = share.argmax(1)
        top = np.sort(share, 1)
        first = top[:, -1]
        second = top[:, -2] if share.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(first > 0, first / np.maximum(first + second, 1e-12), 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)], first.tolist()


def _runs(sizes: list[int], most: int):
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _count(batches):
    """(lang, key, n) of a task, merged before they leave it."""
    held: dict[str, list] = {}

    def merge(lang):
        parts = held[lang]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inverse = np.unique(keys, return_inverse=True)
        held[lang] = [(u, np.bincount(inverse, weights=counts).astype(np.int64))]

    def flush():
        for lang in sorted(held):
            merge(lang)
            u, n = held[lang][0]
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[i : i + 100_000])), pa.array(u[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["lang", "key", "n"])
        held.clear()

    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text or "")
        for lang, texts in by.items():
            for x, y in _runs([len(t) for t in texts], BLOCK_CHARS):
                held.setdefault(lang, []).append(np.unique(grams(texts[x:y])[0], return_counts=True))
                if len(held[lang]) >= 8:
                    merge(lang)
        if sum(len(p[0]) for parts in held.values() for p in parts) > TASK_GRAMS:
            yield from flush()
    yield from flush()


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = SLOT_BITS, hashes: int = HASHES) -> Model:
    """Learn the filter from all rows of ``df`` with a language.

    Rows without a language teach nothing; null texts are empty. Without any
    row the model knows no language and predicts ``und`` everywhere.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull())
    names = rows.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(names) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    counts = rows.mapInArrow(_count, "lang string, key long, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))
    counts = staged(counts, "language-grams")
    totals = sorted(((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()), key=lambda r: (-r[1], r[0]))
    seen = {r.lang for r in names}
    languages = [lang for lang, _ in totals] + sorted(seen - {lang for lang, _ in totals})
    words = max(1, -(-len(languages) // 64))
    if not totals:
        return Model(languages, np.zeros((words, 1 << bits), np.uint64), np.zeros(len(languages)), bits, hashes)
    size = F.create_map(*[F.lit(x) for lang, n in totals for x in (lang, float(n))])
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    rate = counts.select("key", place[F.col("lang")].alias("at"), (F.col("n") / size[F.col("lang")]).alias("rate"))
    many = len(languages)
    profile = (
        rate.groupBy("key")
        .agg(F.collect_list(F.struct("at", "rate")).alias("by"), F.sum("rate").alias("all"))  # a row a language at most
        .select("key", F.explode(F.filter("by", lambda x: (x["rate"] >= LEAST_RATE) & (x["rate"] * many >= F.col("all")))["at"]).alias("at"))
    )

    def place_bits(batches):
        for b in batches:
            keys, at = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            every = slots(keys, bits, hashes)
            mask = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every)), pa.array(np.tile((at // 64).astype(np.int32), hashes)), pa.array(np.tile(mask, hashes))], names=["slot", "word", "mask"])

    filled = profile.mapInArrow(place_bits, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros((words, 1 << bits), np.uint64)
    got = filled.toArrow()  # a row a slot at most: a fixed bound
    table[got.column("word").to_numpy(), got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.mean((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(many)])
    return Model(languages, table, fill**hashes, bits, hashes)


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())])


def predictor(spark, model: Model):
    """A column function: text to struct(lang_pred, score, share).

    Null texts and texts without a letter give ``und`` and 0. Otherwise the
    score is the winner's share against the runner-up's, 0.5 to 1 (0 if no
    n-gram is known); ties go to the language with more training n-grams. The
    share is that of the text's n-grams which the language's profile contains.
    """
    shared = spark.sparkContext.broadcast(model)  # as many slots for any corpus

    @F.pandas_udf(_RESULT)
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else "" for t in text]
        langs, scores, shares = [], [], []
        for a, b in _runs([len(t) for t in texts], BLOCK_CHARS):
            x, y, z = shared.value.predict(texts[a:b])
            langs += x
            scores += y
            shares += z
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float), "share": pd.Series(shares, dtype=float)})

    return predict
