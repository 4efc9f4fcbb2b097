import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from huetide.llm import sharding
from tests.conftest import SF
from tests.llm.cases import SCHEMA, documents, empty


def check(rows, docs, shards, tolerance):
    """Whole, gapless, in key order, and every cut where the closest or a good enough boundary is."""
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    digest = {(d, zlib.crc32((t or "").encode())): md5((t or "").encode()).hexdigest()[:15] for d, t in docs}
    keys = [(digest[r.doc_id, r.text_crc32], r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    total, at, bounds = sum(r["size"] for r in rows), 0, [0]
    for r in ordered:
        bounds.append(at := at + r["size"])
    for k in range(1, shards):
        below = sum(r["size"] for r in rows if r.shard < k)
        miss = abs(below - k * total / shards)
        assert miss <= max(min(abs(b - k * total / shards) for b in bounds), tolerance * total / shards) + 1e-6


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(sharding.op13_histogram_shards(spark, SF).collect(), docs, sharding.SHARDS, sharding.TOLERANCE)


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_hot_text_and_hot_document(spark, tolerance):
    """A third of the rows have one text, a third one doc_id and text; both are cut inside, and only such cuts go on to later passes."""
    docs = [(k, "copied text") for k in range(-100, 200)] + [(7, "the same row")] * 300 + [(k, f"text {k}" * (k % 9)) for k in range(300)] + [(None, "copied text")] * 3
    df = spark.createDataFrame([(d, t, None, None, None, None, None) for d, t in docs], SCHEMA).repartition(5)
    passes = []
    check(sharding.shard(df, 24, tolerance, passes=passes).collect(), docs, 24, tolerance)
    assert passes[0] == 23 and passes == sorted(passes, reverse=True)
    sizes = Counter()
    for r in sharding.shard(df, 24, tolerance).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_awkward_rows(spark):
    texts = [None, "", " ", "x" * 300_000, "ä€😀", "a", "a"]
    check(sharding.shard(documents(spark, texts), 4, 0.0).collect(), list(enumerate(texts)), 4, 0.0)
    out = sharding.shard(documents(spark, texts).withColumn("shard", sharding.F.lit("x")), keep=("found", "shard", "doc_id"))
    assert out.columns == ["found", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {r.found for r in out.collect()} == {"x"}
    edges = [(-(1 << 63), "t"), ((1 << 63) - 1, "t"), (0, "t"), (-1, "t"), (None, "t")]
    rows = sharding.shard(spark.createDataFrame([(d, t, None, None, None, None, None) for d, t in edges], SCHEMA), 5, 0.0).collect()
    assert sorted(r.shard for r in rows) == [0, 1, 2, 3, 4] and {r.doc_id: r.shard for r in rows if r.doc_id is not None and r.doc_id > -9e18} == {-1: 2, 0: 3, (1 << 63) - 1: 4}
    none = sharding.shard(empty(spark))
    assert none.count() == 0 and "slot" in none.columns


def test_stays_in_the_jvm(spark):
    plan = sharding.op13_histogram_shards(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
