import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from huetide.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r") for i, v in rows], SCHEMA)


def recall(ids, matrix, got):
    hits = []
    for q, own in got.groupby("query_id"):
        own, score = own.sort_values("rank"), matrix @ matrix[ids == q][0]
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        at = dict(zip(ids, score, strict=True))
        assert np.allclose(own.score, [at[v] for v in own.vec_id], atol=1e-12)
        best = sorted((-s, v) for v, s in at.items() if v != q)[:20]
        hits.append(len(set(own.vec_id) & {v for _, v in best}) / 20)
    return np.mean(hits)


def test_recall_and_scores_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = data.toPandas()
    ids, matrix = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = neighbours.op6_hash_prefix_forest(spark, sf).toPandas()
    assert set(got.query_id) == set(ids[ids % 20 == 0])
    assert recall(ids, matrix, got) >= 0.9
    looked = neighbours.searched(data, F.col("vec_id") % 20 == 0).groupBy("query_id", F.col("looked")).count().toPandas()
    assert looked.looked.mean() < 0.3 * len(ids)  # far from a scan


@pytest.mark.parametrize("kind", ["clustered", "spread norms", "far from the origin"])
def test_recall_and_rows_looked_at(spark, kind):
    rng = np.random.default_rng(4)
    matrix = rng.standard_normal((8000, 32))
    if kind == "clustered":
        matrix = rng.standard_normal((40, 32))[rng.integers(0, 40, 8000)] + 0.3 * matrix
    elif kind == "spread norms":
        matrix *= np.exp(0.7 * rng.standard_normal(8000))[:, None]
    else:
        matrix += 3
    matrix = matrix.astype(np.float32).astype(float)
    rows = table(spark, [(i, v) for i, v in enumerate(matrix.tolist())])
    queries = F.col("vec_id") % 100 == 0
    assert recall(np.arange(8000), matrix, neighbours.nearest(rows, queries).toPandas()) >= 0.9
    seen = neighbours.searched(rows, queries).select("query_id", "looked", F.spark_partition_id()).distinct().groupBy("query_id").agg(F.sum("looked").alias("n")).toPandas()
    assert seen.n.mean() < 0.45 * 8000


def test_awkward_vectors(spark):
    one = [1.0, 0.0]
    rows = [(0, one), (1, None), (2, [0.0, 0.0]), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [math.inf, 1.0]), (7, one), (6, one), (8, [0.5, 0.5]), (6, one), (9, []), (None, one), (20, [-1.0, 0.0])]
    rows += [(40, [1.0] * 3), (41, [2.0] * 3), (6, [9.0, 0.0])]  # another length: a space of its own; a repeated id: its smallest vector
    got = sorted(tuple(r) for r in neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 0.5), (0, 4, 20, -1.0), (20, 1, 8, -0.5), (20, 2, 0, -1.0), (20, 3, 6, -1.0), (20, 4, 7, -1.0), (40, 1, 41, 6.0)]
    assert neighbours.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_extreme_finite_vectors(spark):
    """Norms that overflow or vanish when squared; products beyond the largest double keep their sign."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [-1e-200, 1e-200]), (4, [1e308, -1e308]), (5, [5e-324, 0.0]), (6, [1.0, 1.0]), (7, [-1e200, 1e-200]), (20, [1e-200, 1e-200]), (40, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]] == [1, 4, 40, 6, 2, 20, 5, 3, 7] and got[0][0][1] == math.inf and got[0][-1][1] == -math.inf
    assert got[20][:3] == [(40, 2e108), (1, 2.0), (0, 1.0)] and dict(got[20])[7] == -1.0
    assert dict(got[40])[4] == 0.0 and dict(got[40])[1] == math.inf
    bands = [r.b for r in df.select(neighbours.log_norm(F.col("embedding")).alias("b")).collect()]
    assert all(math.isfinite(b) for b in bands) and abs(bands[0] - math.log(1e200)) < 1e-9


def test_normal_vectors_in_bands():
    """Plain normal vectors of 64 components, whose norms differ by a tenth: the setting that ships, by band as the query cuts them."""
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((50_000, 64))
    asked = rng.choice(len(rows), 40, replace=False)
    score = rows[asked] @ rows.T
    score[np.arange(40), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    band = np.floor(np.log(np.sqrt((rows * rows).sum(axis=1))) / math.log(neighbours.BAND) + 0.5).astype(int)
    groups = neighbours.banded_together([(64, int(b), int(n)) for b, n in zip(*np.unique(band, return_counts=True), strict=True)])
    group, found, looked = np.array([groups[64, b] for b in band]), np.zeros(score.shape, dtype=bool), 0
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        for part in np.array_split(own, -(-len(own) // neighbours.SHARD_ROWS)):
            chosen = neighbours.Forest(rows[part]).candidates(rows[asked], max(21, neighbours.LEAST, math.ceil(neighbours.ENOUGH * len(part))))
            found[:, part] |= chosen
            looked += chosen.sum()
    assert np.take_along_axis(found, best, axis=1).mean() >= 0.9
    assert looked < 0.15 * score.size


def test_many_copies_and_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, rng.standard_normal(3).tolist()) for i in range(300, 400)]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") == 40, shard_rows=64, least=21).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [*range(20)]
