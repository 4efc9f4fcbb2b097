import hashlib
from collections import Counter

import numpy as np

from huetide.llm import repeats, tokens
from tests.conftest import SF
from tests.llm.cases import documents, empty

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    out = text or ""
    for c in SPACE[1:]:
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def brute(texts, length=20):
    seen, out = set(), []
    for t in texts:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def rows(df):
    return [(r.n_words, r.n_removed, r.kept) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 4, 300).astype(np.uint64)
    for n in (1, 2, 5, 10, 13, 20):
        h = repeats.window_hashes(tokens.mix(words), n)
        assert len(h) == 300 - n + 1
        assert len(set(h.tolist())) == len({tuple(words[i : i + n]) for i in range(300 - n + 1)})


def some_texts():
    rng = np.random.default_rng(4)
    say = lambda n, k=3: " ".join(rng.choice(["a", "b", "É", "c,", "dd"][:k], n))
    line = say(25, 5)
    texts = [None, "", " \n", "a b"]
    for n in rng.integers(5, 120, 60):
        texts.append(say(int(n), 5) + "\n" + (line if n % 2 else "") + "\t" + say(int(n) // 4, 2))
    texts += [texts[10], texts[11] + " more", "x " * 400, "y " * 30_000 + line, texts[10], line, line]
    return texts


def test_like_brute_force(spark, monkeypatch):
    texts = some_texts()
    assert rows(repeats.deduplicate(documents(spark, texts).repartition(5))) == brute(texts)
    assert rows(repeats.deduplicate(documents(spark, texts).repartition(3), length=7)) == brute(texts, 7)


def test_representatives_are_the_first_least():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 9, 200).astype(np.uint64)
    for length in (2, 3, 7, 10, 20, 64):
        n = len(half) - (length - length // 2)
        room = rng.random(n + 5) < 0.7
        want = [i + int(np.argmin(half[i : i + length - length // 2 + 1])) for i in range(n) if room[i]]
        assert repeats.representatives(half, room, length).tolist() == want


def test_levels_go_on_until_nothing_repeats(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(str(x) for x in rng.integers(0, 10**9, n))
    shared = say(330)
    parts = [" ".join(shared.split()[:n]) for n in (8, 15, 40, 41, 85, 170, 299, 330)]
    texts = [say(int(rng.integers(0, 60))) + " " + p + " " + say(3) for p in parts] + [say(90), None, "", say(30) + " " + "z " * 100]
    texts += [" ".join([say(25)] * 2), shared]
    words, longest = [split(t) for t in texts], [0] * len(texts)
    for n in range(1, 334):
        places = [(tuple(w[j : j + n]), i) for i, w in enumerate(words) for j in range(len(w) - n + 1)]
        count = Counter(window for window, _ in places)
        for i in {i for window, i in places if count[window] > 1}:
            longest[i] = n
    texts.append(texts[5])
    docs = documents(spark, texts)
    for df in (docs.repartition(4), docs.unionAll(docs).repartition(3)):
        got = {r.doc_id: r.longest for r in repeats.levels(df).collect()}
        assert got.pop(len(longest)) is None
        for i, n in enumerate(longest):
            assert got.get(i, 0) <= n < 4 * max(got.get(i, 0), 5), (i, got.get(i), n)
    assert repeats.levels(empty(spark)).count() == 0


def test_repeated_rows_and_empty_table(spark):
    texts = some_texts()[:20]
    docs = documents(spark, texts)
    got = repeats.deduplicate(docs.unionAll(docs).repartition(3), keep=("doc_id", "source"))
    want = [x for x in brute(texts) for _ in range(2)]
    assert rows(got) == want and got.columns[:2] == ["doc_id", "source"]
    assert repeats.deduplicate(empty(spark)).count() == 0


def test_query_on_the_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(repeats.op4_substring_doubling(spark, SF).collect(), key=lambda r: r.doc_id)]
    assert got == [(n, m, hashlib.sha256(t.encode()).hexdigest()) for n, m, t in brute([r.text for r in docs])]
