import numpy as np
import pyarrow as pa

from huetide.llm import similar
from tests.conftest import SF
from tests.llm.cases import documents, empty
from tests.llm.test_decontaminate import LOWER
from tests.llm.test_repeats import split


def shingles(text):
    w = split((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[i]), ids[find(i)]) for i, d in enumerate(ids)}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, groups, copies, words):
    """Groups whose texts differ by more and more words, so many pairs stand at the threshold."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        base = [str(x) for x in rng.integers(0, 500, words)]
        for _ in range(copies):
            t = list(base)
            for at in rng.integers(0, words, rng.integers(0, max(2, words // 18))):
                t[at] = str(rng.integers(0, 500))
            texts.append(" ".join(t[: int(rng.integers(words * 3 // 4, words + 1))]))
    return texts


def test_components_like_brute_force(spark):
    line = "this line stands in very many of the texts here and there " * 2
    texts = [None, "", " \t", "one", "one", "one two three four", "a b c d e", "A b c d E", *near_copies(1, 8, 12, 60), *(line + t for t in near_copies(2, 6, 6, 14))]
    texts += [texts[20]] * 3 + ["z " * 5000, "z " * 9, "x y " * 30_000]
    ids = list(range(len(texts)))
    docs = documents(spark, texts)
    want = brute(ids, texts)
    assert len({c for _, c in want.values()}) < len(ids) - 20
    assert rows(similar.similar_documents(docs.repartition(5))[0]) == want
    assert rows(similar.similar_documents(docs.unionAll(docs).repartition(3))[0]) == want


def test_copies_over_many_partitions_and_one_line_everywhere(spark):
    line = "one line that stands in half of all texts and says nothing new to anyone at all today "
    texts = ["copy " * 3 + "of one text that is there four hundred times with some more words"] * 400
    texts += [line + " ".join(f"own{k}x{i}" for i in range(k % 7)) for k in range(200)] + near_copies(5, 3, 12, 50) + [None, ""]
    ids = list(range(len(texts)))
    docs = documents(spark, texts).repartition(60)
    nulls = docs.where("doc_id < 3").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "found", "n_words")
    got, pairs = similar.similar_documents(docs.unionAll(nulls))
    assert rows(got.where("doc_id is not null")) == brute(ids, texts)
    assert [r.component_id for r in got.where("doc_id is null").collect()] == [None] * 3
    assert pairs.count() < 2000  # copies aren't compared with one another


def test_more_ids_than_may_be_sent(spark, monkeypatch):
    monkeypatch.setattr(similar, "SEND", 5)
    texts = near_copies(3, 5, 8, 40)
    assert rows(similar.similar_documents(documents(spark, texts))[0]) == brute(list(range(len(texts))), texts)


def test_empty_table(spark):
    assert similar.similar_documents(empty(spark))[0].count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64)
        b = np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64)
        assert similar.least_difference(similar.sketch(a), similar.sketch(b)) <= len(np.setxor1d(a, b))
    got = similar.shingle_sets(pa.array(["a b c d e f", "a b c d e f a b c d e f", "a"]))
    assert [len(s) for s in got] == [2, 6, 1]


def test_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 40), (40, 60), (7, 7)]
    got = {r.vertex: r.component for r in similar.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 40, 40: 40, 60: 40}


def test_query_on_the_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert rows(similar.op8_jaccard_components(spark, SF)) == brute([r.doc_id for r in docs], [r.text for r in docs])
