"""The evidence ledger as keyed streaming state.

Each source and region has one row of settled state, as of the watermark, and
the list of its events after the watermark, as a late one can still come
between them.  A batch sorts its events of a key in among those, gives out the
ledger's row, and settles what the watermark has passed: no batch reads what
earlier ones read, and state lasts no longer than the delay.  Keys are dealt
into buckets, so that a call of the worker serves many keys.  Given out rows
go to a log by batch; the ledger is the last row of each key, and the log is
merged into a table now and then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from huetide.streaming.jobs import landed, shared_path

#: What the state is held in; transformWithState needs a store with column families.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches after which the log is merged.
MERGE = 8
#: Groups that keys are dealt into: a task meets one group's events of a batch at a time.  A checkpoint holds for one number.
BUCKETS = 4096
#: Events after the watermark in one row of state.
PART = 4096

ROWS = "source_id long, region string, fingerprint string, first_seen timestamp, last_seen timestamp, last_changed timestamp, since timestamp, events long"
_KEY = ["source_id", "region"]
#: Events after the watermark, as state has them.
_OPEN = "ts array<long>, event_id array<long>, prints array<string>, dated array<boolean>"
#: What a key's state gives out; the key is its JSON, as workers take keys of one text for equal, but not null ones.
_MADE = "key string, fingerprint string, first_seen timestamp, last_seen timestamp, last_changed timestamp, since timestamp, events long"
_TIMES = ["first_seen", "last_seen", "last_changed", "since"]


def ledger_rows(events: DataFrame) -> DataFrame:
    """Events as the ledger holds them; those of odd weight carry a current date of their own."""
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select("event_id", "ts", F.col("user_id").alias("source_id"), F.col("event_type").alias("region"), F.concat(F.lit("f"), (number % 2).cast("string")).alias("fingerprint"), F.coalesce(number % 3 == 1, F.lit(False)).alias("dated"))


class Record:
    """A key's ledger row, by events in order.

    ``last_changed`` is the ledger's: it stays for an event without a date
    whose fingerprint is that before it (unchanged baseline), else it moves.
    ``since`` is when the run of the present fingerprint began, which the
    status of evidence takes for both first seen and last changed.
    """

    def __init__(self, fingerprint: str | None = None, first: int = 0, last: int = 0, changed: int = 0, since: int = 0, events: int = 0):
        self.fingerprint, self.first, self.last, self.changed, self.since, self.events = fingerprint, first, last, changed, since, events

    def values(self) -> tuple:
        return self.fingerprint, self.first, self.last, self.changed, self.since, self.events

    def after(self, ts: np.ndarray, prints: np.ndarray, dated: np.ndarray) -> Record:
        """The record after more events; times are microseconds, in order."""
        if not len(ts):
            return self
        new = np.empty(len(ts), dtype=bool)
        new[1:] = prints[1:] != prints[:-1]
        new[0] = not self.events or prints[0] != self.fingerprint
        at = lambda where, else_: int(ts[np.flatnonzero(where)[-1]]) if where.any() else else_
        return Record(prints[-1], self.first if self.events else int(ts[0]), int(ts[-1]), at(new | dated, self.changed), at(new, self.since), self.events + len(ts))


class Ledger(StatefulProcessor):
    """State of the sources and regions of one bucket, a row of a map for each; a batch touches those alone that it has events of.

    A row has the settled record and the first PART events after the watermark; more events stand in rows of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "key string", f"fingerprint string, first long, last long, changed long, since long, events long, parts int, {_OPEN}")
        self.more = handle.getMapState("more", "key string, part int", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [pd.DataFrame({"key": r["key"], "ts": r["ts"].astype("datetime64[us]").astype("int64"), "event_id": r["event_id"], "fingerprint": r["fingerprint"].astype(object), "dated": r["dated"].astype(bool)}) for r in rows]
        if not frames:
            return
        settled: dict[str, tuple] = {}
        if self.rows.exists():
            open_: list[list] = [[], [], [], [], []]
            for k in dict.fromkeys(k for f in frames for k in f["key"]):
                row = self.rows.getValue((k,))
                if row is None:
                    continue
                settled[k] = tuple(row[:7])
                for part in (row[7:], *(self.more.getValue((k, n)) for n in range(1, row[6]))):
                    open_[0] += [k] * len(part[0])
                    for held, more in zip(open_[1:], part, strict=True):
                        held += more
            frames.append(pd.DataFrame(dict(zip(frames[0].columns, open_, strict=True))).astype({"ts": "int64", "event_id": "int64", "dated": bool}))
        all_ = pd.concat(frames).sort_values(["key", "ts", "event_id"], kind="stable")
        names, ts, ids, prints, dated = (all_[c].to_numpy() for c in all_.columns)
        prints = np.where(pd.isna(prints), None, prints)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            k = names[lo]
            *record, parts = settled.get(k, (*Record().values(), 0))
            cut = lo + int(np.searchsorted(ts[lo:hi], mark, "right"))
            past = Record(*record).after(ts[lo:cut], prints[lo:cut], dated[lo:cut])
            left = [[x[n : min(n + PART, hi)].tolist() for x in (ts, ids, prints, dated)] for n in range(cut, hi, PART)] or [[[], [], [], []]]
            self.rows.updateValue((k,), (*past.values(), len(left), *left[0]))
            for n in range(1, len(left)):
                self.more.updateValue((k, n), tuple(left[n]))
            for n in range(len(left), parts):
                self.more.removeKey((k, n))
            out.append((k, *past.after(ts[cut:hi], prints[cut:hi], dated[cut:hi]).values()))
        made = pd.DataFrame(out, columns=["key", "fingerprint", *_TIMES, "events"])
        yield made.assign(**{c: pd.to_datetime(made[c], unit="us") for c in _TIMES})

    def close(self) -> None:
        pass


def _latest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*_KEY, "batch")]
    return rows.groupBy(*_KEY).agg(F.max_by(F.struct(*rest), "batch").alias("x"), F.max("batch").alias("batch")).select(*_KEY, "x.*", "batch")


def drain_ledger(rows: DataFrame, delay: str = "60 days", path: str | None = None, runs: list | None = None) -> DataFrame:
    """The ledger (ROWS) of each source and region after all that has landed, whatever the order within ``delay``.

    ``rows`` as from ``ledger_rows``.  An event that comes later than ``delay``
    after the greatest time of the batches before is left out; ``drain_late``
    lists such (``closes``: the event's time).  Null sources and regions are
    keys like others; a null fingerprint is one of its own; rows without a time
    take no part.
    """
    spark = rows.sparkSession
    path = path or shared_path(spark)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, STORE)
    try:
        keyed = rows.where("ts is not null").withWatermark("ts", delay).select(F.to_json(F.struct(*_KEY)).alias("key"), "event_id", "ts", "fingerprint", "dated")
        keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
        state = keyed.groupBy("bucket").transformWithStateInPandas(Ledger(), _MADE, "update", "eventTime")
        names = F.from_json("key", "source_id long, region string")
        state = state.select(*[names[c].alias(c) for c in _KEY], *state.columns[1:])
        write = state.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        query = write.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/log/batch={n}")).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    if runs is not None:
        runs.append(query)
    return merged(spark, path)


def merged(spark, path: str) -> DataFrame:
    """The ledger of a folder; merges the log if it has many batches."""
    schema = f"{ROWS}, batch long"
    log = landed(spark, f"{path}/log", schema)
    tables = landed(spark, f"{path}/merged", f"{schema}, upto long")
    upto = tables.agg(F.max("upto")).first()[0]  # read from the names of folders
    upto = -1 if upto is None else upto
    new = log.where(F.col("batch") > upto)
    last = new.agg(F.max("batch")).first()[0]
    all_ = _latest(tables.where(F.col("upto") == upto).drop("upto").unionByName(new))
    if last is not None and last - upto >= MERGE:
        all_.write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
        return merged(spark, path)
    return all_.drop("batch")
