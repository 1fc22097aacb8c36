"""Quality scores from random Fourier features.

Statistics of a document are standardised and mapped to random Fourier features,
which approximate a Gaussian kernel. Each partition sums its part of the normal
equations; the driver solves the ridge regression and calibrates its scores with
isotonic regression on labelled rows that the regression has not seen.

Learning uses a bounded sample of the labelled rows (``SAMPLE_ROWS``, those with
the smallest hash of the id); scoring covers every row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.plans.materialize import staged

#: Labelled rows to learn from, random features, ridge penalty, kernel width in units of sqrt(statistics), partitions of the sums.
SAMPLE_ROWS, FEATURES, RIDGE, WIDTH, PARTS, SEED = 50_000, 384, 1e-3, 0.7, 8, 20240
_CLASSES: list[np.ndarray] = []
NAMES = (
    "log_chars", "log_words", "letters", "digits", "spaces", "upper", "stops", "exclaims", "pipes", "marks", "symbols",
    "word_length", "word_spread", "distinct", "top_word", "repeats", "odd_words", "short_words", "line_repeats", "log_line",
)


def _classes() -> np.ndarray:
    """A class for each code point: 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 space, then marks by kind."""
    if not _CLASSES:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                t[c] = 2 if s.isupper() else 1
            elif s.isdigit():
                t[c] = 3
            elif s.isspace():
                t[c] = 4
        for kind, chars in ((5, ".,;:?"), (6, "!"), (7, "|"), (8, "'\"-()")):
            for s in chars:
                t[ord(s)] = kind
        _CLASSES.append(t)
    return _CLASSES[0]


def statistics(text: str | None) -> np.ndarray:
    """The statistics named in ``NAMES``; a null text is empty, and an empty one gives zeros."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=9)
    n, words = len(text), text.split()
    k, lines = max(len(words), 1), [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    letters = kinds[1] + kinds[2]
    plain = sum(map(str.isalpha, counts))  # distinct words without any mark
    ended = sum(w[:-1].isalpha() and w[-1] in ".,;:?" for w in counts if not w.isalpha() and len(w) > 1)
    out[:] = (
        np.log1p(n), np.log1p(len(words)), letters / n, kinds[3] / n, kinds[4] / n, kinds[2] / max(letters, 1), kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[0] / n,
        sizes.mean(), sizes.std(), len(counts) / k, max(counts.values(), default=0) / k, sum(map(str.__eq__, words, words[1:])) / k, 1 - (plain + ended) / max(len(counts), 1),
        (sizes <= 3).mean(), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots) if len(x) else np.zeros(0)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators); equal scores are one point."""
    if len(raw) == 0:
        return np.array([0.0]), np.array([0.5])
    u, inverse = np.unique(raw, return_inverse=True)
    w, y = np.bincount(inverse).astype(float), np.bincount(inverse, weights=label)
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for a, b, c in zip(w, y, u * w, strict=True):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x, strict=True)]
    m = np.array(blocks)
    return m[:, 2] / m[:, 0], np.clip(m[:, 1] / m[:, 0], 0, 1)


def _statistics(batches):
    for b in batches:
        rows = np.array([statistics(t) for t in b.column(2).to_pylist()]).reshape(-1, len(NAMES))
        flat = pa.array(rows.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["key", "y", "x"])


def _matrix(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.column("key").to_numpy(), b.column("y").to_numpy(), b.column("x").flatten().to_numpy().reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from the documents that ``labels`` marks 0 or 1.

    Rows with a null id or label teach nothing; repeated label rows count each
    time. Without labelled documents every score is 0.5.
    """
    named = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isin(0.0, 1.0))
    few = named.withColumn("key", F.xxhash64("__id")).orderBy("key", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    joined = texts.join(F.broadcast(few), "__id").select("key", "y", "__text")  # at most ``sample`` rows are sent
    rows = staged(joined.mapInArrow(_statistics, "key long, y double, x array<double>").repartition(PARTS, "key"), "quality-statistics")
    d = len(NAMES)
    parts = rows.select("x").mapInArrow(_moments, "n double, s binary, q binary").collect()
    n = sum(p.n for p in parts)
    total = lambda c: np.sum([np.frombuffer(getattr(p, c)) for p in parts], 0) if parts else np.zeros(d)
    mean = total("s") / max(n, 1)
    scale = np.sqrt(np.maximum(total("q") / max(n, 1) - mean**2, 0))
    rng = np.random.default_rng(SEED)
    model = Model(mean, np.where(scale > 1e-9, scale, 1), rng.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    if n == 0:
        return model
    size = FEATURES + 1

    def normal(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            key, y, x = _matrix(batch)
            use = key % 4 != 0  # the others calibrate
            f = model.features(x[use])
            a += f.T @ f
            b += f.T @ y[use]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    sums = rows.mapInArrow(normal, "a binary, b binary").collect()  # a row a partition: a fixed bound
    a = np.sum([np.frombuffer(s.a) for s in sums], 0).reshape(size, size)
    b = np.sum([np.frombuffer(s.b) for s in sums], 0)
    model.weights = np.linalg.solve(a + RIDGE * np.eye(size) * max(a[-1, -1], 1) / size, b)

    def held(batches):
        for batch in batches:
            key, y, x = _matrix(batch)
            use = key % 4 == 0
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x[use])), pa.array(y[use])], names=["raw", "y"])

    pairs = rows.mapInArrow(held, "raw double, y double").toArrow()  # part of the sample
    model.knots = isotonic(pairs.column("raw").to_numpy(), pairs.column("y").to_numpy())
    return model


def _moments(batches):
    n, s, q = 0, np.zeros(len(NAMES)), np.zeros(len(NAMES))
    for b in batches:
        x = b.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
        n, s, q = n + len(x), s + x.sum(0), q + (x**2).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tobytes()]), pa.array([q.tobytes()])], names=["n", "s", "q"])


def scorer(spark, model: Model):
    """A column function: text to score, 0 to 1; a null text scores as an empty one."""
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = [shared.value.score(np.array([statistics(t) for t in text[i : i + 1000]]).reshape(-1, len(NAMES))) for i in range(0, len(text), 1000)]
        return pd.Series(np.concatenate([np.zeros(0), *out]))

    return score
