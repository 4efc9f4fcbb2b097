"""The source registry, sampling, caches, evaluation and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry_violations(panel: DataFrame, checks: dict[str, Column], id_: str = "actor") -> DataFrame:
    """Rows (rule, id) that break a rule, and ids given twice."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    rows = panel.select(F.col(id_).cast("string").alias("id"), F.explode(broken).alias("rule"))
    twice = panel.groupBy(F.col(id_).cast("string").alias("id")).count().where("count > 1").select("id", F.lit("duplicate").alias("rule"))
    return rows.union(twice)


def host_allowed(host: Column, allowed: list[str]) -> Column:
    """The host is an allowed one or below one."""
    test = F.lit(False)
    for a in allowed:
        test = test | (host == a) | host.endswith(f".{a}")
    return test


def rotation(panel: DataFrame, date: str, k: int, mandatory: Column) -> DataFrame:
    """k sources of the discovery panel: mandatory first, then domains in turn, in each the smallest hash of date and id.

    More mandatory sources than k are an error, not a cut.
    """
    musts = panel.where(mandatory).count()
    if musts > k:
        raise ValueError(f"{musts} sources are mandatory, but only {k} are asked for")
    rows = panel.withColumns({"mandatory": mandatory, "h": F.sha2(F.concat_ws(":", F.lit(date), F.col("actor").cast("string")), 256)})
    # no more than k of a domain can be taken, so a group keeps k rows before it is sorted whole
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("domain", "mandatory").orderBy("h"))).where(F.col("turn") <= k)
    return ranked.withColumn("turn", F.when(F.col("mandatory"), 0).otherwise(F.col("turn"))).orderBy(F.desc("mandatory"), "turn", "domain", "h").limit(k)


def hash_sample(rows: DataFrame, date: str, n: int, id_: str) -> DataFrame:
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit("smoke"), F.lit(date), F.col(id_).cast("string")), 256)).limit(n)


def round_robin(rows: DataFrame, pool: str, order: list[str], n: int) -> DataFrame:
    """The first of each pool, then the second, ..., n in all, pools in their order.

    Ranks inside a pool; only each pool's first n rows can be taken.
    """
    place = F.row_number().over(Window.partitionBy(pool).orderBy(*order))
    return rows.withColumn("turn", place).where(F.col("turn") <= n).orderBy("turn", pool).limit(n)


def breakdown(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Sources by value of each dimension; a source's last value counts (rows have ``id`` and ``seq``)."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*dimensions), "seq").alias("x")).select("id", "x.*")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions]))
    return last.select(each.alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def statistics(panel: DataFrame) -> DataFrame:
    """Counts of the registry and whether it meets its contract."""
    s = panel.agg(F.count("*").alias("sources"), F.count_distinct("domain").alias("domains"), F.count_distinct("stage").alias("stages"), F.count_distinct("panel").alias("panels"), F.bool_and(F.col("sector").isNotNull()).alias("sectors_known"))
    return s.withColumn("ok", (F.col("sources") >= 30) & (F.col("domains") >= 10) & (F.col("stages") == 3) & (F.col("panels") == 2) & F.col("sectors_known"))


def resume_plan(wanted: DataFrame, captured: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a saved capture covers (same keys), and what is still to do."""
    valid = captured.select(*keys).distinct()
    return wanted.join(valid, keys, "left_semi"), wanted.join(valid, keys, "left_anti")


def cache_join(requests: DataFrame, cache: DataFrame, budget: int) -> DataFrame:
    """Each request by content key: cached, queued within the budget, or over it; equal keys are asked once."""
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    rows = requests.join(known, "key", "left")
    missing = rows.where("hit is null").groupBy("key").agg(F.min("id").alias("first"))
    queued = missing.orderBy("first").limit(budget).select("key", F.lit(True).alias("queued"))
    state = F.when(F.col("hit"), "cached").when(F.col("queued"), "queued").otherwise("over_budget")
    return rows.join(queued, "key", "left").withColumn("state", state)


def evaluation(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of ``accept`` on the test split; null where nothing was counted; missing predictions apart."""
    rows = labels.where("split = 'test'").select("id", "expected").join(predictions.select("id", "decision"), "id", "left")
    both = F.col("decision").isNotNull()
    n, right = F.count_if(both), F.count_if(both & (F.col("decision") == F.col("expected")))
    hit, said, true = (F.count_if(both & t) for t in ((F.col("decision") == "accept") & (F.col("expected") == "accept"), F.col("decision") == "accept", F.col("expected") == "accept"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return rows.agg(n.alias("evaluated"), right.alias("correct"), F.count_if(~both).alias("missing"), ratio(right, n).alias("accuracy"), ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"))


def label_errors(labels: DataFrame) -> DataFrame:
    """Ids labelled more than once, with how often: an evaluation over them is refused."""
    return labels.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def first_of_equal(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each composite key: the first in order."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("x")).select(*keys, order, "x.*")
