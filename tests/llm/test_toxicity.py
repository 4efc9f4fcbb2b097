import numpy as np
from pyspark.sql import functions as F

from huetide.llm import toxicity as t
from tests.llm.cases import documents, empty


def test_finds_labelled_toxic_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 2 == 1
    got = t.score(docs.where(held), t.train(docs.where(~held), labels.where(~held))).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    right = got.agg(F.avg((F.col("toxic").cast("int") == F.col("label")).cast("double")), F.avg(F.when(F.col("label") == 0, F.col("toxic").cast("double")))).first()
    assert right[0] > 0.95 and right[1] < 0.01


def test_later_links_use_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    n = 600
    a = rng.random(n) < 0.3
    rows = np.concatenate((np.flatnonzero(a), np.arange(n)))
    words = np.concatenate((np.full(a.sum(), 7), 100 + rng.integers(0, 5, n))).astype(np.uint64)
    chain = t.fit_chain(rows, words, np.column_stack((a, a)), rng.integers(0, t.FOLDS, n))
    assert chain[0].words.tolist() == [7] and chain[1].earlier[0] > 0.5


def test_awkward_texts(spark):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(40)] + [(41, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    texts = [("you idiot " if k % 2 else "a fine day ") + str(k) for k in range(40)]
    chain = t.train(documents(spark, texts), labels)
    texts = [None, "", "IDIOT", "a fine day", "word " * 100_000 + "idiot", "IDIOT"]
    got = [r.toxic for r in sorted(t.score(documents(spark, texts), chain).collect(), key=lambda r: r.doc_id)]
    assert got == [False, False, True, False, True, True]
    assert t.score(empty(spark), chain).count() == 0
    none = t.train(empty(spark), labels.where("false"))
    assert [r.toxic for r in t.score(documents(spark, ["idiot"]), none).collect()] == [False]
