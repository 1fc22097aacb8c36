"""Vectors of texts, and classifiers of label sequences behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 768


def hashing_embedder(width: int = WIDTH) -> Callable[[pd.Series], list[np.ndarray]]:
    """The mean of signed unit vectors that words hash to, start and end marks included; lower case, split at blanks."""
    import xxhash

    def embed(texts: pd.Series) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(width, np.float32)
            words = ["[CLS]", *[w for w in (text or "").lower().split(" ") if w], "[SEP]"]
            for w in words:
                h = xxhash.xxh3_64_intdigest(w)
                v[(h >> 1) % width] += 1 if h & 1 else -1
            out.append(v / len(words))
        return out

    return embed


def embed_texts(df: DataFrame, embedder: Callable[[pd.Series], list[np.ndarray]] | None = None, text_col: str = "text", out_col: str = "embedding", setup: Callable[[], Callable[[pd.Series], list[np.ndarray]]] | None = None) -> DataFrame:
    """``df``, its index columns with it, and a vector of each text.

    Any callable from texts to vectors fits. ``setup`` is called once a task and
    returns one: it loads a model, adds tokens and the like on the executor.
    """
    ready = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = setup() if setup else ready
        for texts in batches:
            yield pd.Series(list(model(texts)), dtype=object)

    return df.withColumn(out_col, run(text_col))


def train(rows: DataFrame, seed: int = 42):
    """A classifier of (ids, y): logistic regression on how often each id occurs."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="features", labelCol="y", predictionCol="predicted").fit(features(rows))


def features(rows: DataFrame, vocabulary: int = 19):
    from pyspark.ml.functions import array_to_vector

    counts = F.transform(F.sequence(F.lit(1), F.lit(vocabulary)), lambda i: F.size(F.filter("ids", lambda x: x == i)).cast("double"))
    return rows.withColumn("features", array_to_vector(counts))


def predict(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` of y = 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features(rows))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, F.col("p").alias("probability"))


def evaluate(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn with y = 1 as the positive class."""
    said, true = F.col("probability") >= least, F.col("y") == 1
    return scored.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def train_and_evaluate(rows: DataFrame, test: float = 0.4, seed: int = 42, least: float = 0.5) -> DataFrame:
    """One row (tp, fp, fn, tn): rows (ids, y) are rebalanced and split, a classifier learns from one part and is judged on the other."""
    from tracegrain.operators.labels import rebalance, split

    learn, held = split(rebalance(rows, seed=seed), test, seed)
    return evaluate(predict(train(learn, seed), held), least)


def cross_validate(rows: DataFrame, folds: int = 6, seed: int = 42, least: float = 0.5) -> DataFrame:
    """A row (fold, tp, fp, fn, tn) for each fold; folds with rows of one class only are not learned from.

    Rows of a class are dealt to the folds in turn, in the order of a seeded
    hash, so each fold has its share of each class.
    """
    from functools import reduce

    from tracegrain.operators.features import ranked

    hashed = rows.withColumn("__hash", F.xxhash64(F.lit(seed), *rows.columns))
    placed = ranked(hashed, ["y", "__hash"], "fold").withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int")).drop("__hash")
    found = []
    for k in range(folds):
        learn, held = placed.where(F.col("fold") != k).drop("fold"), placed.where(F.col("fold") == k).drop("fold")
        if learn.select("y").distinct().count() == 2:
            found.append(evaluate(predict(train(learn, seed), held), least).select(F.lit(k).alias("fold"), "tp", "fp", "fn", "tn"))
    return reduce(DataFrame.union, found) if found else evaluate(placed.select(F.lit(0.0).alias("probability"), "y")).select(F.lit(0).alias("fold"), "tp", "fp", "fn", "tn").limit(0)
