import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from huetide.llm import periodic
from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents, empty


def brute(words):
    """Runs by trying every period at every place."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        a = 0
        while a + q < len(words):
            b = a
            while b + q < len(words) and words[b] == words[b + q]:
                b += 1
            if b > a and b - a + q >= max(6, 4 * q):
                out.setdefault((a, b - a + q), q)
            a = max(b, a) + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def repetitive(draw):
    """Pieces repeated, cut off, nested in repeats, over few words."""
    out = []
    for _ in range(draw(st.integers(0, 4))):
        piece = draw(st.lists(st.integers(0, 3), min_size=1, max_size=40))
        if draw(st.booleans()):
            piece = piece * draw(st.integers(1, 6))
        out += piece * draw(st.integers(1, 7)) + piece[: draw(st.integers(0, len(piece)))]
    return out


@settings(max_examples=300, deadline=None)
@given(repetitive())
def test_runs_like_brute_force(words):
    got = periodic.find_runs(np.array(words, dtype=np.int64), len(words))
    assert [(a, b - a, q) for a, b, q in got.tolist()] == brute(words)


def test_long_periods():
    rng = np.random.default_rng(3)
    for q in (15, 16, 17, 31, 32, 33, 63, 64, 100, 127, 128, 500, 511, 512, 513):
        block = rng.integers(0, 3, q)
        words = np.concatenate((rng.integers(3, 50, 77), np.resize(block, 4 * q + q // 3), rng.integers(3, 50, 300)))
        got = periodic.find_runs(words, len(words)).tolist()
        assert [77, 77 + 4 * q + q // 3, q] in got
        assert [(a, b - a, p) for a, b, p in got] == brute(words.tolist())
    assert not len(periodic.find_runs(np.resize(rng.integers(0, 1000, 100), 399), 399))  # one word short of four periods


def test_minimizers_find_every_long_period():
    """Without the direct scans: runs of periods from 16 on come from minimizers alone."""
    rng = np.random.default_rng(5)
    for q in range(16, 80):
        words = np.resize(rng.integers(0, 2, q), 4 * q)
        places, periods = periodic.minimizer_pairs(*_grams(words, q))
        smallest = min(p for p in range(1, q + 1) if (words[p:] == words[:-p]).all())
        assert smallest < 16 or q % smallest == 0 and smallest in periods


def _grams(words, q):
    w = 1 << (q.bit_length() - 1)
    return np.array([hash(tuple(words[i : i + 2 * w].tolist())) % 2**63 for i in range(len(words) - 2 * w + 1)], dtype=np.uint64), w


def test_query_like_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in periodic.op12_periodic_runs(spark, SF).collect()}
    assert set(rows) == set(texts)
    planted = 0
    for d, text in texts.items():
        words = plant(d, [w.decode() for w in (text or "").encode().split()])
        if len(words) > 3000:
            continue
        runs, r = brute(words), rows[d]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        planted += zlib.crc32(str(d).encode()) % 10 == 0 and bool(runs)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def test_awkward_texts(spark):
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "w " * 200_000, "x" * 500_000, ("ä\x1fb c " * 9), "a b " * 4]
    df = documents(spark, texts).union(documents(spark, texts).where("doc_id = 4").selectExpr("null", "text", *SCHEMA_REST))
    rows = periodic.periodic_runs(df, keep=("doc_id", "n_words", "found")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and {r.found for r in rows} == {"x"}
    assert [by[k].n_words for k in range(10)] == [0, 0, 0, 1, 6, 5, 200_000, 1, 9, 8]
    assert [len(by[k].runs) for k in range(10)] == [0, 0, 0, 0, 1, 0, 1, 0, 1, 1]
    assert by[6].collapsed == "w" and by[8].collapsed == "ä\x1fb c" and by[9].collapsed == "a b" and by[None].runs == by[4].runs
    assert by[0].strongest is None and by[0].collapsed == "" and tuple(by[9].strongest) == (0, 8, 2)
    assert periodic.periodic_runs(empty(spark)).count() == 0
    made = {r.doc_id: r.text for r in periodic.with_planted_runs(df).collect()}
    assert made[None] == texts[4] and all(made[k] == texts[k] for k in range(10) if zlib.crc32(str(k).encode()) % 10)


SCHEMA_REST = [c.split()[0] for c in SCHEMA.split(", ")][2:]
