import corpus_pipeline as pipeline
from tests.llm.test_near import plain_components


def test_stages_keep_clean_documents_and_their_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    seen = docs
    for name, stage in pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in seen.collect()}
        stage(spark, seen, sf).write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        assert seen.columns == docs.columns
        after = {r.doc_id for r in seen.collect()}
        if name == "quality":
            assert len(after & bad) <= 0.1 * len(bad) and good <= after
        elif name == "language":
            assert after == {i for i, t in before.items() if any(map(str.isalpha, t))}
        else:
            assert after == {i for i, (_, _, kept) in plain_components(before.items()).items() if kept}
    packed = pipeline.STAGES[3][1](spark, seen, sf).collect()
    assert {r.doc_id for r in packed} == after


def test_each_stage_on_tables_without_rows_and_with_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, p string, bucket int, comp string, n_tokens string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, "the house and the garden", "en", None, 3, "p", 1, None, "z")] * 2, schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        got = stage(spark, one, str(tmp_path))
        assert got.count() == (1 if name == "near_dedup" else 2)
        assert name == "packing" or got.columns == one.columns


def test_gibberish_and_other_scripts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = ["xq zzkw vbnq wrtpq lkjh gfdsq zxcvb mnbvq qwrtp", "Привет как дела сегодня мы идем", "今日はいい天気です", "123 456", None]
    seen = docs.union(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema))
    kept = {r.doc_id for r in pipeline.language_stage(spark, seen, "").collect()}
    assert not kept & {-1 - i for i in range(len(odd))}
    assert kept == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x y z " * 9, "en", "a", 54), (2, "x y z " * 9, "en", "a", 54), (3, "w " * 200_000, "en", "a", 400_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == [2, 3]
    assert sum(r.n_tokens for r in got) == 27 + 1 + 200_000 + 1
