"""Structured Streaming jobs over the append-only event table.

Each job is a streaming DataFrame from ``stream``; ``drain`` runs one over
what has landed and returns its result table from a folder that the caller
names or that is made for it.  Drained again with the same folder, a job goes
on from its checkpoint: it reads new files alone, and results and state carry
on.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Events as files land in a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that batches have written; empty if none has."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drain(df: DataFrame, mode: str, path: str | None = None, runs: list[StreamingQuery] | None = None) -> DataFrame:
    """Runs a streaming query over all that has landed and returns its result table; ``runs``, if given, gets the query.

    ``append`` writes each row once, when it is final; ``complete`` writes the
    whole result table anew with each batch.
    """
    spark = df.sparkSession
    path = path or shared_path(spark)
    write = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        query = write.format("parquet").option("path", f"{path}/out").start()
    else:
        query = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()
    if runs is not None:
        runs.append(query)
    return landed(spark, f"{path}/out", df.schema)


def watermark_before(session: SparkSession, path: str, n: int, delay: str) -> Column | None:
    """The watermark of batch ``n``: the greatest time of the batches before, in whole milliseconds, less ``delay``; None before any."""
    most = session.read.schema("most timestamp").parquet(f"{path}/times/{n - 1}").first()["most"] if n else None
    return None if most is None else F.date_trunc("millisecond", F.lit(most).cast("timestamp")) - F.expr(f"interval {delay}")


def _write_times(batch: DataFrame, path: str, n: int) -> None:
    session = batch.sparkSession
    most = session.read.schema("most timestamp").parquet(f"{path}/times/{n - 1}").first()["most"] if n else None
    batch.agg(F.greatest(F.max("ts"), F.lit(most).cast("timestamp")).alias("most")).write.mode("overwrite").parquet(f"{path}/times/{n}")


def drain_late(events: DataFrame, closes: Column, delay: str, path: str | None = None) -> DataFrame:
    """The side table of events that a windowed job with the same ``delay`` drops, as all they would add to has closed.

    ``closes`` is when the (last) window of an event ends; an event is late if
    that isn't after the watermark of its batch.  A batch that runs again
    overwrites what it wrote.
    """
    spark = events.sparkSession
    path = path or shared_path(spark)

    def step(batch: DataFrame, n: int) -> None:
        mark = watermark_before(batch.sparkSession, path, n, delay)
        batch.where(F.lit(False) if mark is None else closes <= mark).write.mode("overwrite").parquet(f"{path}/late/batch={n}")
        _write_times(batch, path, n)

    events.writeStream.option("checkpointLocation", f"{path}/late-state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return landed(spark, f"{path}/late", events.schema)


def daily_prevalence(events: DataFrame) -> DataFrame:
    """Per day and actor the number of events and the largest value."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("w.start").cast("date").alias("day"), "user_id", "n", "most")


def sliding_baseline(events: DataFrame, length: str = "30 days", step: str = "1 day") -> DataFrame:
    """Counts over calendar windows that slide by a day (the batch scan counts valid days exactly)."""
    return events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("first_day"), "n")


def silence_sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """A source's runs of events without a pause of ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begins"), "n")


def closed_days(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """``daily_prevalence`` in append mode: a day is given out once, when the watermark has passed its end, and its state goes."""
    return daily_prevalence(events.withWatermark("ts", delay))


def closed_windows(events: DataFrame, length: str = "7 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    """``sliding_baseline`` in append mode."""
    return sliding_baseline(events.withWatermark("ts", delay), length, step)


def closed_sessions(events: DataFrame, gap: str = "12 hours", delay: str = "2 days") -> DataFrame:
    """``silence_sessions`` in append mode: a session is given out when the watermark has passed its gap."""
    return silence_sessions(events.withWatermark("ts", delay), gap)


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("late"))


def once(events: DataFrame, watermark: str = "60 days") -> DataFrame:
    """Each event id once, within the time that late copies may take."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def admission(events: DataFrame, target: str) -> DataFrame:
    """Events by their age on a day: future ones rejected, old ones kept as context; none dropped as late."""
    return events.select("event_id", _status(target).alias("status"))


def _status(target: str) -> Column:
    age = F.datediff(F.lit(target).cast("date"), F.col("ts").cast("date"))
    window = F.when(F.col("event_type").isin("view"), 45).when(F.col("event_type") == "click", 3).otherwise(2)
    return F.when(age < 0, "rejected_future").when(age > window, "context_only_stale").otherwise("eligible_current")


def drain_admission(events: DataFrame, target: str, delay: str = "2 days", path: str | None = None) -> dict[str, DataFrame]:
    """Admission over all that has landed, routed: a table of eligible events, one of context, one of rejected ones, and one of late ones.

    An event is late if it is not after the watermark of its batch; late ones
    are admitted by the same rules and listed besides, never dropped.  A batch
    that runs again overwrites what it wrote.
    """
    spark = events.sparkSession
    path = path or shared_path(spark)
    routes = {"eligible": "status like 'eligible%'", "context": "status like 'context%'", "rejected": "status like 'rejected%'", "late": "late"}
    schema = "event_id long, ts timestamp, status string, late boolean"

    def step(batch: DataFrame, n: int) -> None:
        mark = watermark_before(batch.sparkSession, path, n, delay)
        late = F.lit(False) if mark is None else F.coalesce(F.col("ts") <= mark, F.lit(False))
        rows = batch.select("event_id", "ts", _status(target).alias("status"), late.alias("late")).persist()
        try:
            for name, test in routes.items():
                rows.where(test).write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
            _write_times(rows, path, n)
        finally:
            rows.unpersist()

    events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return {name: landed(spark, f"{path}/{name}", schema) for name in routes}
