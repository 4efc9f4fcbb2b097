"""Packing into batches: optimal length buckets over the global histogram.

Dynamic programming over how many sequences have each length picks the bucket
boundaries that need the least padding.  Each bucket is then cut into batches
of a token budget.  Places in a bucket come from ranks inside small shards plus
the sizes of the shards before, so no bucket is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huetide.llm.frames import table, written

BUCKETS, MAX_TOKENS, BUDGET = 16, 8192, 65536
#: Rows of a bucket that one task ranks.
SHARD_ROWS = 4096
#: Tokens are runs outside ASCII white space; another tokenizer's counts may be given instead.
TOKEN = "[^\\x20\\x09-\\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds with the least total padding; ``lengths`` ascending and distinct."""
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    size, seen = [int(x) for x in lengths], [0, *np.cumsum(counts).tolist()]
    # cost without the constant sum of lengths: sequences up to i after cut j are padded to lengths[i - 1]
    best = [0, *(s * c for s, c in zip(size, seen[1:], strict=True))]
    cuts = []
    for _ in range(buckets - 1):
        # best[j] - seen[j] * length is a line for each cut j, falling faster for later ones: their lower envelope, from left to right
        cut, new, lines, at = [0] * (n + 1), best[:], [], 0
        for i in range(1, n + 1):
            j = i - 1
            while len(lines) - at > 1 and (best[j] - best[lines[-2]]) * (seen[lines[-1]] - seen[lines[-2]]) <= (best[lines[-1]] - best[lines[-2]]) * (seen[j] - seen[lines[-2]]):
                lines.pop()
            lines.append(j)
            while len(lines) - at > 1 and best[lines[at + 1]] - seen[lines[at + 1]] * size[i - 1] < best[lines[at]] - seen[lines[at]] * size[i - 1]:
                at += 1
            cut[i] = lines[at]
            new[i] = best[lines[at]] + size[i - 1] * (seen[i] - seen[lines[at]])
        cuts.append(cut)
        best = new
    out, i = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[i - 1]))
        i = cut[i]
        if not i:
            break
    if i:
        out.append(int(lengths[i - 1]))
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, max_tokens: int = MAX_TOKENS, budget: int = BUDGET) -> DataFrame:
    """Batches for sequences given as doc_id and n_tokens, one row per sequence.

    A document of more than ``max_tokens`` tokens becomes several sequences
    (``piece`` 0, 1, ...) that together are the whole.  Returns doc_id, piece,
    n_tokens, first_token, bucket_tokens (the length padded to), batch_id and
    slot; a batch's padded size is at most ``budget`` (one sequence at least).
    A document without tokens keeps one row with null bucket and batch.  Ties
    are ordered by doc_id and piece; repeated rows are separate sequences.
    Other input columns are ignored.
    """
    spark = lengths.sparkSession
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
    step = F.lit(max_tokens).cast("long")
    # read once; _salt, fixed by being written, deals out rows that repeat a doc_id or have none
    lengths = written(lengths.select("doc_id", n.alias("_n"), F.monotonically_increasing_id().alias("_salt")), "lengths")
    seqs = lengths.select("doc_id", "_n", "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_n") / step) - 1))).alias("piece"))
    seqs = seqs.select("doc_id", "piece", "_salt", (F.col("piece") * step).alias("first_token"), F.least(step, F.col("_n") - F.col("piece") * step).alias("n_tokens"))
    counted = seqs.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").collect()  # max_tokens rows at most
    size, count = np.array([r[0] for r in counted], dtype=np.int64), np.array([r[1] for r in counted], dtype=np.int64)
    bounds = boundaries(size, count, buckets)
    rows, lo = [], 0
    for k, bound in enumerate(bounds):
        hi = int(np.searchsorted(size, bound, "right"))
        shards = max(1, -(-int(count[lo:hi].sum()) // SHARD_ROWS))
        rows += [(int(s), k, bound, shards, max(1, budget // bound)) for s in size[lo:hi]]
        lo = hi
    plan = spark.createDataFrame(rows, "n_tokens long, _bucket int, bucket_tokens int, _shards long, _room long")
    placed = seqs.join(F.broadcast(plan), "n_tokens", "left").withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.col("_shards")))
    full = placed.where("_bucket is not null")
    before = Window.partitionBy("_bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("_bucket", "_shard").agg(F.count("*").alias("_rows")).select("_bucket", "_shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket", "_shard").orderBy("doc_id", "piece", "_salt"))
    place = F.col("_before") + F.col("_rank") - 1
    packed = full.withColumn("_rank", rank).join(offsets, ["_bucket", "_shard"]).select(
        "doc_id",
        "piece",
        "n_tokens",
        "first_token",
        "bucket_tokens",
        F.concat_ws("-", F.col("bucket_tokens").cast("string"), F.floor(place / F.col("_room")).cast("string")).alias("batch_id"),
        (place % F.col("_room")).cast("int").alias("slot"),
    )
    none = placed.where("_bucket is null").select("doc_id", "piece", "n_tokens", "first_token", "bucket_tokens", F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("int").alias("slot"))
    return packed.unionByName(none)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every whole text; null has none."""
    return docs.select("doc_id", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(token_counts(docs))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in training batches."""
    return pack_documents(table(spark, sf_dir, "documents"))
