"""Fit samples where an id or a text holds a third of all rows, languages of long texts only, and columns that clash in another case."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import byte_cnn, licenses, nbsvm, resample, shared, toxicity

DOCS = "doc_id long, text string"


def text(rng, words, n=30):
    return " ".join(rng.choice(words) for _ in range(n))


def test_a_hot_id_and_a_hot_text_take_one_place_in_a_sample(spark, monkeypatch):
    rng = random.Random(1)
    hot = [(7, f"hot id {i} " + "x" * 200) for i in range(1_000)] + [(10_000 + i, "the hot text " * 20) for i in range(1_000)]
    docs = spark.createDataFrame(hot + [(100 + i, text(rng, ["a", "b", "c"])) for i in range(1_000)], DOCS)
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, bad int")
    monkeypatch.setattr(shared, "SAMPLE_BYTES", 24_000)
    sample = shared.labelled_sample(docs, labels, "bad", {0: 5_000, 1: 5_000}, 4, 2)
    found = [bytes(r.raw).decode() for r in sample.collect()]
    assert sum(t.startswith("hot id") for t in found) <= 1
    assert sum(t.startswith("the hot text") for t in found) <= 2  # once a label
    free = docs.where("doc_id between 100 and 9999").where(shared.fold("doc_id", 4) != 2).count()
    assert len(found) >= 0.95 * free


def test_each_language_is_learned_under_a_hot_id(spark):
    rng = random.Random(2)
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["ñandú", "árbol", "éste"], "zz": ["qwz", "kjx", "vvw"]}
    rows = [(5, text(rng, words["xx"]), "xx") for _ in range(1_500)] + [(20_000 + i, "same same same", "xx") for i in range(500)]
    rows += [(100 + i, text(rng, words["yy"]), "yy") for i in range(60)] + [(300 + i, text(rng, words["zz"], 500_000), "zz") for i in range(3)]
    rows += [(1_000 + i, text(rng, words["xx"]), "xx") for i in range(60)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string")
    model = byte_cnn.learn(docs)
    assert model["names"] == ["xx", "yy", "zz"]
    new = spark.createDataFrame([(i, text(rng, w), k) for i, (k, w) in enumerate(words.items())], f"{DOCS}, lang string")
    assert [r.lang_pred for r in byte_cnn.identified(new, model).orderBy("doc_id").collect()] == ["xx", "yy", "zz"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, text(rng, ["good", "fine", "day"] if i % 3 else ["awful", "foul", "vile"]), "en" if i % 2 else "fr", "s", 10) for i in range(240)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], f"{DOCS}, lang string, source string, n_chars long")
    for c in ("Lang_Pred", "LANG_SCORE", "TOXICITY", "Spans", "IDS", "N_Words", "Labels", "Score", "Class_Id", "Is_First", "_found"):
        docs = docs.withColumn(c, F.lit("clash"))
    where = tmp_path_factory.mktemp("clash")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, text(rng, ["bench", "mark", "item"], 12))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return docs, str(where)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_columns_that_clash_in_another_case(spark, clashing, name, stage):
    docs, where = clashing
    found = stage(spark, docs, where)
    assert found.columns == (corpus_pipeline.COLUMNS if name != "byte_bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert 0 < found.count() <= 241


def test_operators_take_columns_that_clash_in_another_case(spark, clashing):
    docs, where = clashing
    labels = spark.read.parquet(f"{where}/labels.parquet")
    assert nbsvm.scored(docs, nbsvm.learn(docs, labels), out="score").select("score").count() == 241
    assert toxicity.scored(docs, toxicity.learn(docs, labels), out="score").select("score").count() == 241
    assert licenses.scanned(docs).select("labels", "n_words").count() == 241
    assert resample.drawn(docs, spark.read.parquet(f"{where}/benchmark.parquet")).count() == 241
