from pyspark.sql import functions as F

from huetide.llm import language as lang
from tests.llm.cases import documents, empty


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lang.op9_string_kernel_language(spark, sf).join(docs, "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1
    assert got.count() == docs.count()


def test_awkward_texts(spark):
    english, german = "the cat and the other thing ", "und der die das nicht auch "
    texts = [english * 5, german * 5, english * 4, german * 4] * 3
    known = lang.train(documents(spark, texts, ["en", "de"] * 6))
    texts = [None, "", "12 !?", english, german * 20_000, "é", english]
    got = {r.doc_id: r for r in lang.identify(documents(spark, texts), known).collect()}
    assert [got[k].lang_pred for k in range(7)][:5] == ["und", "und", "und", "en", "de"]
    assert got[5].lang_pred in ("de", "en") and got[3].score == got[6].score and got[0].score == 0
    assert lang.identify(empty(spark), known).count() == 0


def test_nothing_to_learn_from(spark):
    model = lang.train(empty(spark))
    assert [r.lang_pred for r in lang.identify(documents(spark, ["the cat"]), model).collect()] == ["und"]


def test_many_languages_have_a_bound(spark, monkeypatch):
    """A column of junk: the most frequent languages are learned, each from a part of the sample."""
    monkeypatch.setattr(lang, "LANGUAGES", 5)
    monkeypatch.setattr(lang, "TOTAL", 15)
    seen = []
    fit = lang.fit
    monkeypatch.setattr(lang, "fit", lambda x, names: seen.append(names) or fit(x, names))
    fit_rows = [(k * 100 + j, f"{word} {j} " * 9, f"l{k}") for k, word in enumerate(("alpha", "bravo", "carol", "delta", "echos", "foxes", "golfs")) for j in range(10 - k)]
    df = spark.createDataFrame(fit_rows, "doc_id long, text string, lang string")
    model = lang.train(df)
    assert model[0] == ["l0", "l1", "l2", "l3", "l4"] and {n: seen[0].count(n) for n in model[0]} == {n: 3 for n in model[0]}
    got = {r.doc_id: r.lang_pred for r in lang.identify(df, model).collect()}
    assert got[0] == "l0" and got[400] == "l4"
