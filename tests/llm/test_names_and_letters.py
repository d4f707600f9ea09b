import pytest

import corpus_pipeline
from lodestone.llm import exact_dedup, langid, packing, simhash, token_rollup
from lodestone.llm.common import free_name
from pyspark.sql import functions as F


def test_no_column_is_lost(spark):
    rows = [(1, "same words here", "a"), (1, "same words here", "b"), (2, "same words here", "c"), (3, "other text", "d")]
    names = ("__sha", "__key", "__score", "__predicted", "_gone_id", "_gone_sha", "_gone_key", "_sha", "_key", "_id", "_score", "score", "predicted")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), "mark"))
    for out in (exact_dedup.deduplicated(df), simhash.survivors(df), simhash.survivors(df, width=5, similar=True), corpus_pipeline.near(spark, df, ""), corpus_pipeline.exact(spark, df, "")):
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == [1, 3] and all(r[n] == n + r.mark for r in got for n in names)


def test_the_classifier_keeps_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(i, "good clear sentence here" if i % 2 else "zz@@ !! ##", "x", 1, 2) for i in range(40)], "doc_id bigint, text string, __score string, __predicted int, score int")
    out = corpus_pipeline.classify(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.count() > 0 and {r["__score"] for r in out.collect()} == {"x"}


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_a int, __A int")
    assert free_name(df, "_a") == "___a" and free_name(df, "b") == "b"


def test_kept_names_that_clash_are_refused(spark):
    df = spark.createDataFrame([(1, "a", 3, 4)], "doc_id int, text string, length int, n_tokens int")
    tokenizer = token_rollup.Tokenizer("/opt/tokenizers", "byte_bpe_50k")
    with pytest.raises(ValueError, match="length"):
        packing.pack(df, tokenizer, keep=("doc_id", "length"))
    with pytest.raises(ValueError, match="n_tokens"):
        token_rollup.count_tokens(df, tokenizer, ["doc_id", "n_tokens"])


@pytest.mark.parametrize("text, letter", [("½ ²", False), ("Ⅷ ①", False), ("12 _ %", False), ("", False), ("½a", True), ("ª", True), ("語", True), ("ʰ", True), ("٣", False), ("é", True)])
def test_letters_are_of_category_l(text, letter):
    assert langid.has_letter(text) is letter


def test_texts_of_numerals_are_undetermined(spark):
    rows = [(i, "das ist ein Satz und noch einer" if i % 2 else "this is a line and another one", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ①"), (3, None), (4, "das ist ein Satz")], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(asked, langid.train(docs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "de"
