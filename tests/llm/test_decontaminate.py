import hashlib
import re

import numpy as np

from huetide.llm import decontaminate as d
from tests.conftest import SF
from tests.llm.cases import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, window=10):
    windows = {}
    for k, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(k)
    sizes, out = {len(w) for w in windows}, []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit[i : i + n] = [1] * n
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit)))
    return out


def rows(df):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_like_brute_force_also_in_blocks(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "b", "É", "c1", "dd"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, say(int(n))) for k, n in enumerate(rng.integers(0, 16, 30))] + [(30, None), (31, ""), (32, "a b")]
    texts = [None, "", "..", *(say(int(n)) for n in rng.integers(0, 60, 30)), "x " * 20_000 + items[5][1], items[7][1], items[7][1]]
    texts += [" - ".join(t.upper().split()) for _, t in items if t]
    want = brute(texts, items)
    assert rows(d.decontaminate(documents(spark, texts), bench(spark, items))) == want
    assert rows(d.decontaminate(documents(spark, texts), bench(spark, items), block_bytes=200)) == want


def test_empty_tables(spark):
    assert d.decontaminate(empty(spark), bench(spark, [(1, "a")])).count() == 0
    assert rows(d.decontaminate(documents(spark, ["a b"]), bench(spark, []))) == brute(["a b"], [])


def test_query_on_the_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(d.op2_suffix_decontamination(spark, SF)) == brute([r.text for r in docs], items)
