"""Approximate nearest neighbours: a hash-prefix forest over row shards.

Each tree turns a vector by a random matrix and writes its axes in order of
how far the turned vector points along them (with their signs): a string of
LEVELS symbols of an alphabet of 2 x AXES.  A shard keeps each tree's rows
sorted by string.  A query descends in every tree to the rows of the longest
prefix it shares, and all trees ascend together: a row counts the symbols it
shares with the query over all trees, and the rows of the highest counts are
candidates, level by level, until there are enough.  Candidates are scored
exactly.

Strings see angles, the measure is the inner product.  So rows are sharded by
norm first, and inside a shard one more component makes all rows equally long;
the narrower the band of norms, the less that component blurs angles.  Rows go to shards, queries in blocks to all
shards of their length; a task holds one shard and one block whatever the size
of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huetide.llm.frames import table

TREES, AXES, LEVELS, SEED = 80, 64, 3, 6
#: Candidates a query takes from a shard: a share of its rows, and a least number (shards may be small).
#: Independent normal components, the hardest case, need these for a recall of 0.9; clustered rows need far fewer.
ENOUGH, LEAST = 0.06, 384
SHARD_ROWS, BLOCK_QUERIES = 8192, 8192
#: Rows of norms within a factor BAND belong together, the closer ones of up to WIDEST while they are fewer than FEW.
BAND, WIDEST, FEW = 1.1, 2.0, 4096
#: Queries of a block that are looked up at once.
_STEP = 256
RESULT = "query_id long, vec_id long, score double, looked long"


def strings(vectors: np.ndarray, seed: int, trees: int = TREES) -> np.ndarray:
    """Trees x levels x vectors: the axes farthest along, as symbols."""
    out = np.empty((trees, LEVELS, len(vectors)), dtype=np.int16)
    random, at = np.random.default_rng(seed), np.arange(len(vectors))
    for t in range(trees):
        turned = vectors @ random.standard_normal((vectors.shape[1], AXES), dtype=np.float32)
        far = np.abs(turned)
        for level in range(LEVELS):
            axis = far.argmax(axis=1)
            out[t, level] = 2 * axis + (turned[at, axis] > 0)
            far[at, axis] = -1
    return out


class Forest:
    """Sorted strings of a shard's rows; rows are centred and made equally long."""

    def __init__(self, rows: np.ndarray, seed: int = SEED):
        self.n, self.seed = len(rows), seed
        rows = rows / (np.abs(rows).max(initial=0) or 1.0)
        centred = rows - rows.mean(axis=0)
        square = (centred * centred).sum(axis=1)
        most = math.sqrt(square.max()) or 1.0
        self.wide = np.hstack([centred, np.sqrt(np.maximum(most * most - square, 0))[:, None]]) / most
        symbols = strings(self.wide.astype(np.float32), seed).astype(np.int64)
        keys = np.zeros((len(symbols), self.n), dtype=np.int64)
        for level in range(LEVELS):
            keys = keys * (2 * AXES) + symbols[:, level]
        order = np.argsort(keys, axis=1, kind="stable")
        self.sorted, self.order = np.take_along_axis(keys, order, axis=1), order.astype(np.int32)

    def shared(self, queries: np.ndarray) -> np.ndarray:
        """Queries x rows: shared symbols of all trees' prefixes."""
        n = len(queries)
        queries = queries / np.maximum(np.abs(queries).max(axis=1, keepdims=True), 1e-320)
        size = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        symbols = strings(np.hstack([queries / np.maximum(size, 1e-300), np.zeros((n, 1))]).astype(np.float32), self.seed).astype(np.int64)
        cells, base = [], np.arange(n, dtype=np.int32) * np.int32(self.n)
        for t in range(len(symbols)):
            key = np.zeros(n, dtype=np.int64)
            for level in range(LEVELS):
                key, width = key * (2 * AXES) + symbols[t, level], (2 * AXES) ** (LEVELS - 1 - level)
                low = np.searchsorted(self.sorted[t], key * width)
                many = np.searchsorted(self.sorted[t], (key + 1) * width) - low
                ends = np.cumsum(many)
                place = np.arange(ends[-1]) + np.repeat(low - ends + many, many)
                cells.append(np.repeat(base, many) + self.order[t, place])
        return np.bincount(np.concatenate(cells), minlength=n * self.n).reshape(n, self.n)

    def candidates(self, queries: np.ndarray, enough: int) -> np.ndarray:
        """Queries x rows: whether a row is among those that share most with the query, ties included, ``enough`` or all at least."""
        if enough >= self.n:
            return np.ones((len(queries), self.n), dtype=bool)
        shared = self.shared(queries).astype(np.int16)
        return shared >= np.partition(shared, self.n - enough, axis=1)[:, self.n - enough, None]


def energy(vector: Column) -> Column:
    """Sum of squares; null with a null component."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def log_norm(vector: Column) -> Column:
    """The logarithm of a usable vector's norm: components are divided by the largest before they are squared, so that no norm is infinite or 0."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.log(most) + 0.5 * F.log(energy(F.transform(vector, lambda x: x / most)))


def inner(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products; where a term or a sum overflows, that of scaled vectors scaled back, which has the right sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (rows * vector).sum(axis=1)
        for k in np.flatnonzero(~np.isfinite(out)).tolist():
            a, b = np.abs(rows[k]).max(), np.abs(vector).max()
            out[k] = (rows[k] / a * (vector / b)).sum() * a * b
    return out


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    exact = vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)
    return F.when(energy(vector).between(1e-290, 1e300), True).otherwise(exact)  # the sum settles all but extremes


def banded_together(sizes: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """The group of each band (width, band, rows): neighbouring bands go together while they are few rows and not too far apart."""
    out: dict[tuple[int, int], int] = {}
    first, rows, of = 0, FEW, None
    for width, band, n in sorted(sizes):
        if width != of or rows >= FEW or (band - first + 1) * math.log(BAND) > math.log(WIDEST):
            first, rows, of = band, 0, width
        out[width, band] = first
        rows += n
    return out


def searched(rows: DataFrame, queries: Column, k: int = 20, enough: float = ENOUGH, least: int = LEAST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """RESULT of each query and shard: its k nearest candidates there, and how many rows were looked at."""
    spark = rows.sparkSession
    vectors = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    banded = lambda df: df.select("vec_id", "embedding", F.size("embedding").alias("width"), F.floor(log_norm(F.col("embedding")) / math.log(BAND) + 0.5).cast("int").alias("band"))
    sizes = banded(vectors).groupBy("width", "band").agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q")).collect()  # a row a band of norms
    if not any(r["q"] for r in sizes):
        return spark.createDataFrame([], RESULT)
    blocks = max(1, -(-sum(r["q"] for r in sizes) // BLOCK_QUERIES))
    vectors = banded(vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    groups = banded_together([(r["width"], r["band"], r["n"]) for r in sizes])
    rows_of: dict[tuple[int, int], int] = {}
    for r in sizes:
        at = (r["width"], groups[r["width"], r["band"]])
        rows_of[at] = rows_of.get(at, 0) + r["n"]
    shards = {at: -(-n // shard_rows) for at, n in rows_of.items()}
    plan = F.broadcast(spark.createDataFrame([(w, b, g, shards[w, g]) for (w, b), g in groups.items()], "width int, band int, group int, shards int"))
    every_shard = F.broadcast(spark.createDataFrame([(w, g, n) for (w, g), n in shards.items()], "width int, group int, shards int"))
    hashed = lambda many: F.pmod(F.xxhash64("vec_id"), many).cast("int")
    every = lambda many, name: F.explode(F.sequence(F.lit(0), many - 1)).alias(name)
    columns = ["vec_id", "embedding", "asks", "width", "group", "shard", "block"]
    row = vectors.join(plan, ["width", "band"]).select("*", F.lit(False).alias("asks"), hashed(F.col("shards")).alias("shard"), every(F.lit(blocks), "block"))
    ask = vectors.where(queries).drop("band").join(every_shard, "width").select("*", F.lit(True).alias("asks"), every(F.col("shards"), "shard"), hashed(F.lit(blocks)).alias("block"))

    def search(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy()
        ids = part.column("vec_id").to_numpy()
        matrix = part.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        by = np.argsort(ids[~asks])
        own, data = ids[~asks][by], matrix[~asks][by]
        asked, wanted = ids[asks], matrix[asks]
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        if len(own) and len(asked):
            forest = Forest(data)
            for lo in range(0, len(asked), _STEP):
                part_ids, part_rows = asked[lo : lo + _STEP], wanted[lo : lo + _STEP]
                chosen = forest.candidates(part_rows, max(k + 1, least, math.ceil(enough * len(own))))
                for at, (query, vector) in enumerate(zip(part_ids, part_rows, strict=True)):
                    r = np.flatnonzero(chosen[at] & (own != query))
                    score = inner(data[r], vector)
                    if len(r) > k:  # those below the k-th score go
                        near = score >= np.partition(score, len(r) - k)[len(r) - k]
                        best, looked, score = r[near], len(r), score[near]
                    else:
                        best, looked = r, len(r)
                    by = np.lexsort((best, -score))[:k]  # rows stand by id
                    for column, values in zip(out, (np.full(len(by), query), own[best[by]], score[by], np.full(len(by), looked)), strict=True):
                        column.append(values)
        kinds = (np.int64, np.int64, np.float64, np.int64)
        return pa.table({name: np.concatenate([*column, np.zeros(0, dtype=kind)]).astype(kind) for name, column, kind in zip(("query_id", "vec_id", "score", "looked"), out, kinds, strict=True)})

    return row.select(columns).unionByName(ask.select(columns)).groupBy("width", "group", "shard", "block").applyInArrow(search, RESULT)


def nearest(rows: DataFrame, queries: Column, k: int = 20, enough: float = ENOUGH, least: int = LEAST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows found for each row that ``queries`` selects, by inner product.

    ``rows`` has vec_id and embedding; returns query_id, rank, vec_id and
    score, the exact inner product in double precision.  Ties go to the
    smaller vec_id.  Vectors that are null, zero, or hold null or non-finite
    components take no part.  A row isn't its own neighbour; rows that repeat
    a vec_id count once, with the smallest of their vectors.  An inner product
    needs two vectors of one length, so a query is answered by those of its
    own.  Other input columns are ignored.  An empty table gives no rows.
    """
    found = searched(rows, queries, k, enough, least, shard_rows)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
