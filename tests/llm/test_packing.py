import itertools
from collections import Counter, defaultdict

import numpy as np

from huetide.llm import packing
from tests.conftest import SF
from tests.llm.cases import documents, empty


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(rng.choice(40, rng.integers(1, 9), replace=False)) + 1
        counts, k = rng.integers(1, 9, len(sizes)), int(rng.integers(1, 5))

        def cost(bounds, sizes=sizes, counts=counts):
            return sum(int(c) * (min(b for b in bounds if b >= s) - int(s)) for s, c in zip(sizes, counts, strict=True))

        best = min(cost(b) for n in range(1, k + 1) for b in itertools.combinations(sizes.tolist(), min(n, len(sizes))) if b[-1] == sizes[-1])
        got = packing.boundaries(sizes, counts, k)
        assert len(got) <= k and cost(got) == best


def check(rows, lengths, max_tokens, budget):
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        if r.batch_id:
            batches[r.batch_id].append(r)
    assert Counter({k: sum(n for _, n in v) for k, v in pieces.items()}) == Counter(lengths)
    for v in pieces.values():
        at = 0
        for first, n in sorted(v):
            assert first == at and n <= max_tokens
            at += n
    for v in batches.values():
        assert len({r.bucket_tokens for r in v}) == 1 and len({r.slot for r in v}) == len(v)
        assert len(v) == 1 or len(v) * v[0].bucket_tokens <= budget
        assert all(r.n_tokens <= r.bucket_tokens for r in v)
    full = Counter(v[0].bucket_tokens for v in batches.values() if len(v) < budget // v[0].bucket_tokens)
    assert all(n == 1 for n in full.values())  # one batch a bucket isn't full


def test_query_packs_every_token(spark):
    texts = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(packing.op7_length_buckets(spark, SF).collect(), texts, packing.MAX_TOKENS, packing.BUDGET)


def test_awkward_texts(spark):
    texts = [None, "", " \t\n", "a", "a b c", "w " * 1000, "a b c", "x" * 100_000]
    rows = packing.pack(packing.token_counts(documents(spark, texts)), buckets=2, max_tokens=64, budget=128).collect()
    check(rows, {k: len((t or "").split()) for k, t in enumerate(texts)}, 64, 128)
    assert {r.doc_id for r in rows if r.batch_id is None} == {0, 1, 2}
    assert packing.pack(packing.token_counts(empty(spark))).count() == 0
