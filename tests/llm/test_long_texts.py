"""Texts that are long in what an operator looks for end within seconds; kept columns may have any name."""

import time

import numpy as np
import pyarrow as pa
import pytest

from huetide.llm import decontaminate, language, licenses, pseudonyms, secrets, toxicity
from huetide.llm.keywords import Keywords
from tests.llm.cases import documents, empty


def test_a_long_item_found_whole(spark):
    rng = np.random.default_rng(1)
    item = " ".join(f"w{x}" for x in rng.integers(0, 3000, 5000))
    texts = ["before " + item + " after", " ".join(item.split()[100:130]), "the " * 3000, None]
    bench = spark.createDataFrame([(1, item), (2, "the " * 2000)], "item_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    assert time.monotonic() - began < 60
    assert [(got[k].n_hit, got[k].n_items, got[k].longest_match) for k in range(4)] == [(5000, 1, 5000), (30, 1, 30), (3000, 1, 2000), (0, 0, 0)]


def test_many_values_in_one_text():
    text = " ".join(f"mail{k}@example.org" for k in range(60_000))
    began = time.monotonic()
    new, spans = pseudonyms.replace(text, lambda kind, value: "x" if kind == "email" else None)
    assert len(spans) == 60_000 and time.monotonic() - began < 20


def test_a_long_run_of_token_beginnings():
    by_word = {w: rule for rule in secrets.RULES for w in rule[1]}
    raw = b"eyJhbGciOi" * 100_000
    began = time.monotonic()
    assert secrets.find(raw, Keywords(by_word), by_word) == [] and time.monotonic() - began < 20


def test_long_addresses():
    """Addresses of any length are permuted, in their form, back and forth, in time that grows with the length."""
    f, began = pseudonyms.Feistel(b"key"), time.monotonic()
    for s in ("a" * 1_000_000 + "@example.com", "x@" + "Host-9." * 100_000 + "org", "a1" * 33 + "@b.de"):
        new = pseudonyms.pseudonym(f, "email", s)
        assert new != s and len(new) == len(s) and pseudonyms.PATTERNS["email"].fullmatch(new)
        assert pseudonyms.pseudonym(f, "email", new, back=True) == s
        text, spans = pseudonyms.replace(f"to {s} now", lambda kind, value: pseudonyms.pseudonym(f, kind, value))
        assert text == f"to {new} now" and [x[0] for x in spans] == ["email"]
    one, two = (pseudonyms.pseudonym(f, "email", "q" * k + "@example.com") for k in (200, 201))
    assert one[64:150] != two[64:150]
    assert time.monotonic() - began < 60


def test_long_blanks_beside_license_words():
    """Every keyword and the beginning of every sentence, each before and after a long run of blanks."""
    scanner, blanks, began = licenses.Scanner(), b" " * 300_000, time.monotonic()
    for said in ("to convey to", "convey to", "to propagate", "installation information", "this software is provided as-is provided", "licence ouverte etalab", "a work that uses the library linked", "version 2 mit license licensed under the terms of the"):
        scanner.scan(blanks.join(said.encode().split()) + blanks)
        scanner.scan(said.encode() + blanks + said.encode())
    assert time.monotonic() - began < 60
    found = scanner.scan(b'to "convey" a work means any kind of propagation. to\n * convey a work means any kind of propagation')[1]
    assert [r[2].label for r in found] == ["gpl-3.0"] * 2


def test_a_day_has_one_pseudonym_in_every_way_of_writing():
    f = pseudonyms.Feistel(b"key")
    for year, month, day in ((2001, 2, 3), (1999, 11, 25), (2010, 10, 12), (1950, 3, 31)):
        forms = [f"{year}-{month:02d}-{day:02d}", f"{year}/{month}/{day}", f"{month:02d}/{day:02d}/{year}"] + ([f"{day}.{month}.{year}"] if day > 12 else [])
        days = {pseudonyms._date_parts(pseudonyms.pseudonym(f, "date", s))[0] for s in forms}
        assert len(days) == 1
        assert [pseudonyms.pseudonym(f, "date", pseudonyms.pseudonym(f, "date", s), back=True) for s in forms] == forms


def test_columns_of_any_name_are_carried(spark):
    """A kept column whose name an operator makes gives way; every other comes through, whatever internal names look like."""
    rows = [(1, "a text", "a", "b", "c", "d", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _state string, toxic string, found string, n_words string, lang_pred string")
    keep = tuple(docs.columns)
    bench = spark.createDataFrame([], "item_id long, text string")
    model = language.train(empty(spark))
    outs = [
        toxicity.score(docs, toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")), keep),
        decontaminate.decontaminate(docs, bench, keep=keep),
        pseudonyms.pseudonymise(docs, keep=keep),
        secrets.scan_secrets(docs, keep=keep),
        language.identify(docs, model, keep=keep),
        licenses.scan_licenses(docs, keep=keep),
    ]
    made = [("toxic", False), ("n_words", 2), ("text", "a text"), ("found", []), ("lang_pred", "und"), ("n_words", 2)]
    for out, (name, value) in zip(outs, made, strict=True):
        row = out.collect()[0].asDict()
        assert len(set(out.columns)) == len(out.columns) and row[name] == value and row["_state"] == "a" and row["doc_id"] == 1


def test_language_like_the_exact_kernel():
    """Predictions equal those of the presence kernel over real n-grams, with all training texts as landmarks."""
    rng = np.random.default_rng(3)
    words = {"en": "the and that with from have this", "de": "und der die nicht auch ein von", "fr": "les des une dans pour que avec"}
    made = [(name, " ".join(rng.choice(said.split(), 40))) for name, said in words.items() for _ in range(25)]
    train, test = made[::2], made[1::2]

    def grams(text):
        folded = language._FOLD[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes()
        return {folded[i : i + n] for n in range(1, 5) for i in range(len(folded) - n + 1)}

    def kernel(a, b):
        a, b = [grams(t) for _, t in a], [grams(t) for _, t in b]
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    names = sorted(words)
    y = np.where(np.array([n for n, _ in train])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(kernel(train, train) + language.RIDGE * len(train) / len(names) * np.eye(len(train)), y)
    exact = kernel(test, train) @ alpha

    def embedded(rows):
        raw = [t.encode() for _, t in rows]
        return language.vectors(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))

    got_names, matrix = language.fit(embedded(train), [n for n, _ in train])
    scores = embedded(test) @ matrix
    assert got_names == names and (scores.argmax(axis=1) == exact.argmax(axis=1)).all() and np.abs(scores - exact).max() < 0.2


def test_chain_like_a_plain_chain():
    """Each link equals ridge logistic regression, by gradient descent, on the words and the out-of-fold probabilities before it."""
    rng = np.random.default_rng(8)
    n = 400
    low = rng.random(n) < 0.4
    toxic = rng.random(n) < np.where(low, 0.7, 0.1)
    has = np.column_stack((low ^ (rng.random(n) < 0.1), toxic ^ (rng.random(n) < 0.1), rng.random(n) < 0.5))
    rows, words = np.nonzero(has)
    folds = rng.integers(0, toxicity.FOLDS, n)
    chain = toxicity.fit_chain(rows, (words + 50).astype(np.uint64), np.column_stack((low, toxic)), folds)

    def fit(columns, y, before):
        x = np.column_stack((columns, before, np.ones(len(y))))
        keep = np.array([*[toxicity.RIDGE] * (x.shape[1] - 1), 0.01])
        w = np.zeros(x.shape[1])
        for _ in range(20_000):
            w += 0.004 * (x.T @ (y - toxicity.sigmoid(x @ w)) - keep * w)
        return w

    before = np.zeros((n, 0))
    for link, y in zip(chain, (low, toxic), strict=True):
        own = (link.words - np.uint64(50)).astype(int)
        w = fit(has[:, own].astype(float), y.astype(float), before)
        assert np.allclose(w, [*link.weights, *link.earlier, link.bias], atol=0.02)
        out = np.zeros(n)
        for k in range(toxicity.FOLDS):
            in_fold = folds == k
            part_rows, part_words = np.nonzero(has[~in_fold])
            part = toxicity.fit_link(part_rows, part_words, np.array([50, 51, 52], dtype=np.uint64), y[~in_fold].astype(float), before[~in_fold])
            out[in_fold] = toxicity.sigmoid(part.logits(rows, (words + 50).astype(np.uint64), n, before))[in_fold]
        before = np.column_stack((before, out))


@pytest.mark.parametrize("size", [0, 3])
def test_vectors_of_whole_texts(size):
    texts = pa.array(["abc " * 3000] * size)
    got = language.vectors(*language.text_bytes(texts))
    assert got.shape == (size, language.GRAMS) and all(np.allclose(got[0], g) for g in got)
