"""The registered queries of the llm operators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(mod: int, id_col: str = "doc_id"):
    """crc32 of the id's text, modulo ``mod``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import packing

    return packing.best_fit(read(spark, sf_dir, "documents"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import ctw

    return ctw.score(read(spark, sf_dir, "documents"), fold(7) != 2)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import langid

    docs = read(spark, sf_dir, "documents")
    predict = langid.predictor(spark, langid.fit(docs.where(fold(4) != 2)))
    found = docs.select("doc_id", (fold(4) == 2).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import minhash

    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m USING (doc_id)
"""


#: Below it a likeness is 0: sets whose lengths part them are not compared, and a comparison ends once it is out of reach.
LEAST_LIKENESS = 0.01


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pyarrow as pa

    from tracegrain.llm import spotsigs

    def compare(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out = []
                for text, after in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    half = len(text) // 2
                    edited = text[: len(text) - half] + after[:half]
                    sets = [spotsigs.signatures(t) for t in (text, edited, after)]
                    out.append((len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), spotsigs.pack(sets[0]), spotsigs.pack(sets[1]), spotsigs.likeness(sets[0], sets[1], LEAST_LIKENESS), spotsigs.likeness(sets[0], sets[2], LEAST_LIKENESS)))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    rows = spotsigs.with_next(read(spark, sf_dir, "documents"))
    return rows.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import chat

    said = r"\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_windows(turns.unionByName(own)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracegrain.llm import quality

    docs = read(spark, sf_dir, "documents")
    score = quality.scorer(spark, quality.fit(docs, read(spark, sf_dir, "labels").where(fold(5) != 0)))
    found = docs.select("doc_id", (fold(5) == 0).alias("held_out"), score("text").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from tracegrain.llm import bpe

    vocabulary = bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    ids = bpe.encode(read(spark, sf_dir, "documents"), vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)

    def digest(batches):  # decodes and digests in one go: the ids pass through Python once less
        pieces = bpe.Pieces(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, bpe.BLOCK_DOCS):
                b = whole.slice(at, bpe.BLOCK_DOCS)
                flat, n = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), np.asarray(b.column(1).value_lengths())
                ends = np.cumsum([0, *n])
                sha = [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                text = [hashlib.sha256(t.as_buffer()).hexdigest() for t in pieces.join(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tracegrain.llm import bpe, orc_tokens

    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    path = orc_tokens.write(read(spark, sf_dir, "documents"), vocabulary, end_id=2)
    return orc_tokens.catalogue(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM t GROUP BY conv_id
"""


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_ctw": op2_ctw, "op3_topk_search": op3_topk_search, "op4_language_id": op4_language_id, "op5_bpe": op5_bpe, "op6_orc_tokens": op6_orc_tokens, "op7_minhash": op7_minhash, "op8_spotsigs": op8_spotsigs, "op9_chat": op9_chat, "op10_quality": op10_quality, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3_SQL, "op7_minhash": OP7_SQL}
