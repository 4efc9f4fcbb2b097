import datetime as dt
import random
from collections import defaultdict, namedtuple

import pandas as pd
from pyspark.sql import functions as F

from huetide.streaming import jobs, ledger


def in_order(rows):
    """The ledger by one pass over events in order: (fingerprint, first seen, last seen, last changed, since, events)."""
    state = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        number = int(r.props) if r.props else None
        print_ = None if number is None else f"f{number % 2}"
        old = state.get((r.user_id, r.event_type))
        changed = old is None or old[0] != print_
        dated = number is not None and number % 3 == 1
        state[r.user_id, r.event_type] = (print_, old[1] if old else r.ts, r.ts, r.ts if changed or dated else old[3], r.ts if changed else old[4], (old[5] if old else 0) + 1)
    return state


def of(table):
    return {(r.source_id, r.region): (r.fingerprint, r.first_seen, r.last_seen, r.last_changed, r.since, r.events) for r in table.collect()}


def landed(spark, folder, parts, per_batch):
    """Shuffled events of one hot key and some small ones, in several files and batches."""
    hot = F.col("id") % 12 > 0
    events = spark.range(15_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 3)).alias("ts"), F.when(hot, 1).when(F.col("id") % 7 > 0, F.col("id") % 7).cast("long").alias("user_id"), F.when(hot, "view").otherwise("click").alias("event_type"),
        F.lit(0.0).alias("value"), F.when(F.col("id") > 14_000, "3").otherwise((F.floor(F.col("id") / 50)).cast("string")).alias("props"),
    )
    events.orderBy(F.xxhash64("event_id")).repartition(parts).write.parquet(folder)
    stream = spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return spark.read.parquet(folder).collect(), stream


def test_ledger_does_not_depend_on_arrival(spark, tmp_path):
    for name, parts, per_batch in (("one", 1, 1), ("many", 3, 1)):
        rows, stream = landed(spark, str(tmp_path / name), parts, per_batch)
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.user_id, r.event_type] += 1
        assert max(sizes.values()) > 10_000
        assert of(ledger.drain_ledger(ledger.ledger_rows(stream))) == in_order(rows)


DAY = dt.datetime(2024, 3, 1)


def event(k, hours, user=1, props="1", kind="view"):
    return (k, DAY + dt.timedelta(hours=hours), user, kind, float(k), props)


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, jobs.SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream_of(spark, folder):
    return spark.readStream.schema(jobs.SCHEMA).parquet(f"{folder}/*")


def test_ledger_goes_on_from_its_checkpoint(spark, tmp_path):
    """Each drain is a new query over the same folder; what an earlier one read is gone before the next one."""
    folder, path, rng = str(tmp_path / "in"), str(tmp_path / "ledger"), random.Random(4)
    rows, all_ = [], []
    for batch in range(ledger.MERGE + 2):
        new = [event(1000 * batch + k, 24 * batch + rng.uniform(-30, 24), rng.randint(1, 3), rng.choice(["1", "2", "3", "4", None]), rng.choice(["view", None])) for k in range(20)]
        feed(spark, folder, f"b{batch}", new)
        table = ledger.drain_ledger(ledger.ledger_rows(stream_of(spark, folder)), "60 hours", path)
        rows += [spark.createDataFrame(new, jobs.SCHEMA).collect()]
        all_ += rows[-1]
        if batch in (0, 1, ledger.MERGE + 1):
            assert of(table) == in_order(all_)
    assert spark.read.parquet(f"{path}/merged").count()  # the log was merged, and read again since
    runs = []
    assert of(ledger.drain_ledger(ledger.ledger_rows(stream_of(spark, folder)), "60 hours", path, runs)) == in_order(all_)
    assert not any(p.numInputRows for p in runs[0].recentProgress)


def test_ledger_settles_what_the_watermark_has_passed(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    early = [event(k, k / 10, props="1") for k in range(200)]  # 20 hours
    feed(spark, folder, "a", early)
    drain = lambda: ledger.drain_ledger(ledger.ledger_rows(stream_of(spark, folder)), "1 hour", path)
    assert of(drain())[1, "view"][-1] == 200
    feed(spark, folder, "b", [event(900, 100, props="2"), event(901, 3, props="2"), event(902, 19.5, props="2")])
    got = of(drain())[1, "view"]
    assert got[-1] == 202 and got[0] == "f0"  # hour 3 came too late, hour 19.5 didn't
    late = jobs.drain_late(stream_of(spark, folder), F.col("ts"), "1 hour", str(tmp_path / "late"))
    assert late.count() == 0  # one batch: nothing was before it
    feed(spark, folder, "c", [event(903, 98, props="4"), event(904, 99.5, props="4")])
    assert [r.event_id for r in jobs.drain_late(stream_of(spark, folder), F.col("ts"), "1 hour", str(tmp_path / "late")).collect()] == [903]
    assert of(drain())[1, "view"][-1] == 203


def test_days_close_and_their_state_goes(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "days")
    feed(spark, folder, "a", [event(k, k, user=k) for k in range(24)] + [event(100, 24 * 20)])
    sizes = []

    def drain():
        runs = []
        table = jobs.drain(jobs.closed_days(stream_of(spark, folder), "1 day"), "append", path, runs)
        sizes.append([p.stateOperators[0].numRowsTotal for p in runs[0].recentProgress if p.stateOperators])
        return {(str(r.day), r.user_id): (r.n, r.most) for r in table.collect()}

    first = drain()
    assert first == {("2024-03-01", k): (1, float(k)) for k in range(24)}
    assert max(sizes[0]) == 25 and sizes[0][-1] == 1  # what is given out is held no longer
    feed(spark, folder, "b", [event(200, 1, user=1), event(201, 24 * 19 + 1), event(202, 24 * 40)])
    assert drain() == first | {("2024-03-20", 1): (1, 201.0), ("2024-03-21", 1): (1, 100.0)}
    assert sizes[1][-1] == 1
    ends = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    assert jobs.drain_late(stream_of(spark, folder).where("event_id < 200"), ends, "1 day", str(tmp_path / "late")).count() == 0


def test_sessions_and_windows_close(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, "a", [event(k, h) for k, h in enumerate((0, 5, 16, 40, 41, 400))])
    runs = []
    sessions = jobs.drain(jobs.closed_sessions(stream_of(spark, folder), "12 hours", "1 day"), "append", str(tmp_path / "s"), runs)
    assert sorted((r.begins - DAY, r.n) for r in sessions.collect()) == [(dt.timedelta(0), 3), (dt.timedelta(hours=40), 2)]
    assert runs[0].recentProgress[-1].stateOperators[0].numRowsTotal == 1
    windows = jobs.drain(jobs.closed_windows(stream_of(spark, folder), "2 days", "1 day", "1 day"), "append", str(tmp_path / "w"))
    assert sorted((str(r.first_day), r.n) for r in windows.collect()) == [("2024-02-29", 3), ("2024-03-01", 5), ("2024-03-02", 2)]


def test_admission_lists_late_events(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, folder, "a", [event(1, 0), event(2, 24 * 10, kind="click")])
    routes = jobs.drain_admission(stream_of(spark, folder), "2024-03-05", "2 days", path)
    assert {k: t.count() for k, t in routes.items()} == {"eligible": 1, "context": 0, "rejected": 1, "late": 0}
    feed(spark, folder, "b", [event(3, 24, kind="click"), event(4, 24 * 9)])
    routes = jobs.drain_admission(stream_of(spark, folder), "2024-03-05", "2 days", path)
    assert {k: sorted(r.event_id for r in t.collect()) for k, t in routes.items()} == {"eligible": [1, 3], "context": [], "rejected": [2, 4], "late": [3]}


def test_nothing_has_landed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(jobs.SCHEMA).parquet(str(tmp_path / "in"))
    assert ledger.drain_ledger(ledger.ledger_rows(stream)).count() == 0
    assert jobs.drain(jobs.closed_days(stream), "append").count() == 0
    assert all(t.count() == 0 for t in jobs.drain_admission(stream, "2024-03-05").values())


class Held:
    """A map of state in memory."""

    def __init__(self):
        self.rows = {}

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


def test_ledger_takes_many_keys_in_one_call(monkeypatch):
    monkeypatch.setattr(ledger, "PART", 7)
    maps = {}
    made, rng = ledger.Ledger(), random.Random(6)
    made.init(type("Handle", (), {"getMapState": lambda _, name, *_s: maps.setdefault(name, Held())})())
    all_, last = [], {}
    for batch, hours in enumerate((0, 30, 60, 90)):
        new = [event(1000 * batch + k, hours + rng.uniform(0, 40), rng.choice((1, 1, 1, 2 + k % 40 + batch)), rng.choice(["1", "2", "4", None])) for k in range(200)]
        all_ += new
        rows = [(str(u), e, t, None if p is None else f"f{int(p) % 2}", p is not None and int(p) % 3 == 1) for e, t, u, _, _, p in new]
        frame = pd.DataFrame(rows, columns=["key", "event_id", "ts", "fingerprint", "dated"])
        mark = type("Mark", (), {"getCurrentWatermarkInMs": lambda _, h=hours: int((DAY + dt.timedelta(hours=h) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)})()
        (out,) = made.handleInputRows((0,), iter([frame[:90], frame[90:]]), mark)
        assert sorted(out["key"]) == sorted(set(frame["key"]))
        last |= {int(r.key): (None if pd.isna(r.fingerprint) else r.fingerprint, *(getattr(r, c).to_pydatetime() for c in ("first_seen", "last_seen", "last_changed", "since")), r.events) for r in out.itertuples()}
        parts = {k[0]: v[6] for k, v in maps["rows"].rows.items()}
        assert sorted(maps["more"].rows) == sorted((k, n) for k, p in parts.items() for n in range(1, p)) and parts["1"] > 5
    Event = namedtuple("Event", "event_id ts user_id event_type value props")
    assert {(k, "view"): v for k, v in last.items()} == in_order([Event(*e) for e in all_])
