"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first three return rows of ``documents`` with all their columns; the
last returns where each piece of each document is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import langid, minhash, packing, quality
from tracegrain.plans.materialize import shared_dir

#: Least quality score, and least share of a text's n-grams that its language's profile contains: text in two learned
#: languages has about half, other languages, other scripts and gibberish far less.
LEAST_QUALITY, LEAST_SHARE = 0.3, 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score ``LEAST_QUALITY`` or more.

    Null and empty texts are scored as empty. Rows are judged one by one, so
    repeated rows and ties fare alike, and very long texts are read whole;
    further columns stay as they are. A table without rows gives none; without
    labels every score is 0.5 and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = quality.scorer(spark, quality.fit(docs, labels))
    return docs.where(score("text") >= LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the corpus names.

    Those without a letter go, and those of whose n-grams the best profile
    contains less than ``LEAST_SHARE``. Rows are judged one by one: repeated
    rows and ties fare alike, very long texts are read whole, further columns
    stay. A table without rows, or one that names no language, gives none.
    """
    predict = langid.predictor(spark, langid.fit(docs))
    own = "__tracegrain_language"
    found = docs.withColumn(own, predict("text"))
    return found.where((F.col(f"{own}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{own}.share") >= LEAST_SHARE)).drop(own)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id.

    Texts without words are in no group and stay; of rows that repeat id and
    text one stays; rows without id stand for a group only where no row has one.
    Further columns stay. A table without rows gives none.
    """
    return minhash.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of the permitted lengths.

    Each row is a document of its own, whatever its id; a null or empty text is
    one token; documents above the largest length are cut, with no token
    dropped. A table without rows gives none.
    """
    return packing.best_fit(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: The classifier and best-fit packing are beyond SQL; tests/llm holds all stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
