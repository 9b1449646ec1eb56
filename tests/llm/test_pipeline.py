"""The pipeline's stages on odd rows, and what each keeps."""

import corpus_pipeline as p
from conftest import DATA
from pyspark.sql import functions as F
from test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run(spark):
    out = p.run(spark, DATA)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 50
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None


def test_near_duplicates_keep_the_least_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in p.stage_ngram_join(spark, docs, DATA).collect()}
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert kept == want


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the same words again and again", "en", "a", 5), (2, "the same words again and again", "en", "a", 5), (3, "the same words again and again", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for table in (docs, docs.where("false")):
        for name, stage in p.STAGES:
            out = stage(spark, table, DATA)
            out.count()
            assert name == p.STAGES[-1][0] or out.columns == docs.columns
    kept = p.stage_ngram_join(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2]


CLASHING = ["score", "lang_pred", "toxicity", "target", "words", "rounds", "shards", "size", "room", "bits", "_key", "_u", "_row", "_id", "_label", "label", "mark", "component_id", "n_shingles", "id", "cls", "_text", "ids", "a.b"]


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for name, stage in p.STAGES:
        rows = stage(spark, docs, DATA)
        assert name == p.STAGES[-1][0] or rows.columns == docs.columns
        for r in rows.collect():
            assert name == p.STAGES[-1][0] or [r[c] for c in CLASHING] == [f"mine {c}" for c in CLASHING]


def test_near_duplicates_with_one_id_and_several_texts(spark):
    one, two = "a b c d e f g h i j k l m n", "q r s t u v w x y z qq rr ss tt"
    rows = [(5, one, "en", "a", 1), (5, two, "en", "a", 1), (3, one, "en", "a", 1), (5, two, "en", "b", 1), (7, two, "en", "a", 1), (None, two, "en", "a", 1), (8, "", "en", "a", 1), (8, "", "en", "a", 1), (9, None, "en", "a", 1)]
    kept = [tuple(r) for r in p.stage_ngram_join(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()]
    assert sorted((r[0], r[1] or "") for r in kept) == [(3, one), (5, two), (8, ""), (9, "")]
    again = [tuple(r) for r in p.stage_ngram_join(spark, spark.createDataFrame(rows[::-1], SCHEMA), DATA).collect()]
    assert sorted(kept, key=repr) == sorted(again, key=repr)
