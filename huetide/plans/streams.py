"""Streaming jobs and iterative clustering as queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huetide.operators import cluster as cl
from huetide.operators import palette
from huetide.plans.catalog import COLORS, long, query, r6, text
from huetide.plans.shapes import month_points
from huetide.sources.fixtures import Views
from huetide.streaming import jobs, ledger

T = TypeVar("T")


def events(v: Views) -> DataFrame:
    return jobs.stream(v.spark, v.sf_dir)


DELAY = "2 days"
#: What ``in_two_batches`` gives to jobs: events of the first and second batch, and the watermark after each.
_BATCHES = """marks AS (SELECT date_trunc('milliseconds', max(ts) FILTER (event_id % 10 <> 3)) - INTERVAL 2 DAY AS one, date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS two FROM events),
came AS (SELECT *, event_id % 10 = 3 AS second FROM events, marks)"""


def in_two_batches(v: Views, run: Callable[[DataFrame, str], T]) -> T:
    """What ``run`` gives for a stream that has nine events of ten in a first batch and, from the same checkpoint on, the others in a second one."""
    path = jobs.shared_path(v.spark)
    v.events.where("event_id % 10 <> 3").write.parquet(f"{path}/feed/first")
    stream = lambda: v.spark.readStream.schema(jobs.SCHEMA).parquet(f"{path}/feed/*")
    run(stream(), path)
    v.events.where("event_id % 10 = 3").write.parquet(f"{path}/feed/second")
    return run(stream(), path)


@query(
    "str03_closed_days",
    f"""WITH {_BATCHES} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n, round(max(value), 6) AS most FROM came
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= two AND NOT (second AND date_trunc('day', ts) + INTERVAL 1 DAY <= one) GROUP BY ALL""",
)
def closed_days(v: Views) -> DataFrame:
    out = in_two_batches(v, lambda e, path: jobs.drain(jobs.closed_days(e, DELAY), "append", path))
    return out.select(*text("day"), "user_id", "n", *r6("most"))


@query("str03_late_events", f"WITH {_BATCHES} SELECT event_id, user_id, event_type FROM came WHERE second AND date_trunc('day', ts) + INTERVAL 1 DAY <= one")
def late_events(v: Views) -> DataFrame:
    """What the closed days left out, row by row."""
    ends = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    return in_two_batches(v, lambda e, path: jobs.drain_late(e, ends, DELAY, path)).select("event_id", "user_id", "event_type")


@query(
    "str04_closed_windows",
    f"""WITH {_BATCHES} SELECT CAST(CAST(first_day AS DATE) AS VARCHAR) AS first_day, count(*) AS n
FROM (SELECT *, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS first_day FROM came)
WHERE first_day + INTERVAL 7 DAY <= two AND NOT (second AND first_day + INTERVAL 7 DAY <= one) GROUP BY ALL""",
)
def closed_windows(v: Views) -> DataFrame:
    return in_two_batches(v, lambda e, path: jobs.drain(jobs.closed_windows(e, delay=DELAY), "append", path)).select(*text("first_day"), "n")


#: Events of the first batch whose sessions are open at its end, and those of the second that aren't late.
_OPEN = """SELECT e.* EXCLUDE (fresh) FROM early e JOIN early_all a ON a.user_id = e.user_id AND a.s = e.s WHERE a.ends > e.one
UNION ALL SELECT *, 0 AS s FROM came WHERE second AND ts + INTERVAL 12 HOUR > one"""
_SESSIONS = """{to} AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT * EXCLUDE (s), CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM ({of}))),
{to}_all AS (SELECT user_id, s, min(ts) AS begins, max(ts) + INTERVAL 12 HOUR AS ends, count(*) AS n FROM {to} GROUP BY ALL)"""


@query(
    "str05_closed_sessions",
    f"""WITH {_BATCHES}, {_SESSIONS.format(to="early", of="SELECT *, 0 AS s FROM came WHERE NOT second")},
{_SESSIONS.format(to="rest", of=_OPEN)}
SELECT user_id, CAST(floor(epoch(begins)) AS BIGINT) AS begins, n FROM early_all, marks WHERE ends <= one
UNION ALL SELECT user_id, CAST(floor(epoch(begins)) AS BIGINT), n FROM rest_all, marks WHERE ends <= two""",
)
def closed_sessions(v: Views) -> DataFrame:
    out = in_two_batches(v, lambda e, path: jobs.drain(jobs.closed_sessions(e, delay=DELAY), "append", path))
    return out.select("user_id", F.unix_timestamp("begins").alias("begins"), "n")


@query("str03_daily_prevalence", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY ALL")
def daily(v: Views) -> DataFrame:
    return jobs.drain(jobs.daily_prevalence(events(v)), "complete").select(*text("day"), "user_id", "n", *r6("most"))


@query(
    "str04_sliding_baseline",
    "SELECT CAST(CAST(first_day AS DATE) AS VARCHAR) AS first_day, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 29 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS first_day FROM events) GROUP BY ALL",
)
def sliding(v: Views) -> DataFrame:
    return jobs.drain(jobs.sliding_baseline(events(v)), "complete").select(*text("first_day"), "n")


@query(
    "str05_silence_sessions",
    """SELECT user_id, min(ts) AS begins, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""".replace("min(ts) AS begins", "CAST(floor(epoch(min(ts))) AS BIGINT) AS begins"),
)
def sessions(v: Views) -> DataFrame:
    return jobs.drain(jobs.silence_sessions(events(v)), "complete").select("user_id", F.unix_timestamp("begins").alias("begins"), "n")


@query("str06_status_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS late FROM events GROUP BY event_type")
def statuses(v: Views) -> DataFrame:
    return jobs.drain(jobs.status_counts(events(v)), "complete")


@query("str07_exactly_once", "SELECT DISTINCT event_id, event_type FROM events")
def exactly_once(v: Views) -> DataFrame:
    twice = events(v).unionByName(events(v))
    return jobs.drain(jobs.once(twice).select("event_id", "event_type"), "append")


@query("str02_admission", "SELECT event_id, CASE WHEN DATE '2024-01-20' < CAST(ts AS DATE) THEN 'rejected_future' WHEN DATE '2024-01-20' - CAST(ts AS DATE) > CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 3 ELSE 2 END THEN 'context_only_stale' ELSE 'eligible_current' END AS status FROM events")
def admission(v: Views) -> DataFrame:
    return jobs.drain(jobs.admission(events(v), "2024-01-20"), "append")


@query(
    "str02_admission_routes",
    f"""WITH {_BATCHES}, aged AS (SELECT *, DATE '2024-01-20' - CAST(ts AS DATE) AS age, CASE WHEN event_type = 'view' THEN 45 WHEN event_type = 'click' THEN 3 ELSE 2 END AS span FROM came)
SELECT route, count(*) AS n FROM (SELECT CASE WHEN age < 0 THEN 'rejected' WHEN age > span THEN 'context' ELSE 'eligible' END AS route FROM aged UNION ALL SELECT 'late' FROM aged WHERE second AND ts <= one) GROUP BY route""",
)
def admission_routes(v: Views) -> DataFrame:
    """Rows of each route, late ones besides, from a stream of two batches."""
    routes = in_two_batches(v, lambda e, path: jobs.drain_admission(e, "2024-01-20", DELAY, path))
    rows = None
    for name, table in routes.items():
        own = table.select(F.lit(name).alias("route"))
        rows = own if rows is None else rows.unionAll(own)
    return rows.groupBy("route").agg(F.count("*").alias("n"))


@query(
    "str01_ledger_state",
    """SELECT source_id, region, max_by(fingerprint, (ts, event_id)) AS fingerprint, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen, CAST(floor(epoch(max(CASE WHEN changed THEN ts END))) AS BIGINT) AS last_changed, count(*) AS events FROM (
SELECT *, coalesce(lag(fingerprint) OVER (PARTITION BY source_id, region ORDER BY ts, event_id) <> fingerprint, true) AS changed FROM ledger_events) GROUP BY ALL""",
    views=("ledger_events",),
)
def ledger_state(v: Views) -> DataFrame:
    rows = ledger.drain_ledger(ledger.ledger_rows(events(v)))
    return rows.select("source_id", "region", "fingerprint", *[F.unix_timestamp(c).alias(n) for c, n in (("first_seen", "first_seen"), ("last_seen", "last_seen"), ("since", "last_changed"))], "events")


@query(
    "str01_ledger_forms",
    f"""WITH {_BATCHES}, rows_ AS (SELECT event_id, ts, user_id AS source_id, event_type AS region, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM came WHERE NOT (second AND ts <= one)),
said AS (SELECT *, coalesce(lag(k % 2) OVER (PARTITION BY source_id, region ORDER BY ts, event_id) <> k % 2, true) AS changed FROM rows_),
ended AS (SELECT source_id, region, max_by('f' || (k % 2), (ts, event_id)) AS fingerprint, min(ts) AS first_seen, max(ts) AS last_seen,
max(ts) FILTER (changed OR k % 3 = 1) AS last_changed, max(ts) FILTER (changed) AS since, count(*) AS events FROM said GROUP BY ALL)
SELECT source_id, region, fingerprint, {", ".join(f"CAST(floor(epoch({c})) AS BIGINT) AS {c}" for c in ("first_seen", "last_seen", "last_changed", "since"))}, events FROM ended""",
)
def ledger_forms(v: Views) -> DataFrame:
    """Both forms of the ledger, over two batches with a restart between: dated events move the ledger's last change, the status form keeps to runs of one fingerprint."""
    rows = in_two_batches(v, lambda e, path: ledger.drain_ledger(ledger.ledger_rows(e), DELAY, path))
    return rows.select("source_id", "region", "fingerprint", *[F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_seen", "last_changed", "since")], "events")


def clusters(v: Views, policy: str) -> DataFrame:
    return cl.complete_linkage(month_points(v), policy)


def misplaced(v: Views, policy: str) -> DataFrame:
    """Points that aren't where one pass in order puts them: all apart, or all together, would be wrong."""
    return cl.linkage_faults(month_points(v), policy)


@query("alg04_complete_linkage")
def linkage(v: Views) -> DataFrame:
    return clusters(v, "best").select(*text("day"), "id", "cluster")


@query("alg04_complete_linkage_violations", "SELECT CAST(0 AS BIGINT) AS violations")
def linkage_violations(v: Views) -> DataFrame:
    return misplaced(v, "best")


@query("alg05_first_fit_linkage")
def first_fit(v: Views) -> DataFrame:
    return clusters(v, "first").select(*text("day"), "id", "cluster")


@query("alg05_first_fit_linkage_violations", "SELECT CAST(0 AS BIGINT) AS violations")
def first_fit_violations(v: Views) -> DataFrame:
    return misplaced(v, "first")


def image_points(v: Views) -> DataFrame:
    return v.colors.select("image_id", "day", (F.col("image_id") * 64 + F.col("swatch_no")).alias("id"), F.coalesce("adjusted_share", "share").alias("strength"), "chroma", "ll", "la", "lb")


@query("alg03_swatch_merge")
def swatch_merge(v: Views) -> DataFrame:
    return cl.merge_swatches(image_points(v))


@query("alg03_swatch_merge_violations", "SELECT CAST(0 AS BIGINT) AS violations")
def swatch_merge_violations(v: Views) -> DataFrame:
    """Swatches that aren't where one pass in order puts them: all apart, or all together, would be wrong."""
    p = image_points(v)
    return cl.merge_faults(p, cl.merge_swatches(p))


@query(
    "alg03_merged_swatches",
    """SELECT image_id, cluster, row_number() OVER (PARTITION BY image_id ORDER BY round(0.5 * coalesce(adjusted_share, share) + 0.25 * salience + 0.15 * component_share + 0.10 * coverage, 9) DESC, r, g, b) AS swatch_no,
CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, n, swatches, round(share, 6) AS share, round(adjusted_share, 6) AS adjusted_share, round(salience, 6) AS salience, round(component_share, 6) AS component_share, round(coverage, 6) AS coverage, round(border_share, 6) AS border_share, structural FROM folded JOIN chosen USING (image_id, cluster)""",
    on=COLORS,
    extra=(
        ("given", """SELECT *, swatch_no % 3 AS cluster, 1 + image_id % 7 * swatch_no AS n FROM colors"""),
        ("cost", """SELECT a.image_id, a.cluster, a.swatch_no, a.r, a.g, a.b, round(sum(sqrt((a.ll - c.ll) ** 2 + (a.la - c.la) ** 2 + (a.lb - c.lb) ** 2) * greatest(1, c.n)), 9) AS cost FROM given a JOIN given c USING (image_id, cluster) GROUP BY ALL"""),
        ("chosen", """SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY image_id, cluster ORDER BY cost, swatch_no) = 1"""),
        ("folded", """SELECT image_id, cluster, CAST(sum(n) AS BIGINT) AS n, count(*) AS swatches, sum(share) AS share, CASE WHEN count(*) = 1 THEN max(adjusted_share) ELSE sum(coalesce(adjusted_share, share)) END AS adjusted_share, sum(salience) AS salience,
max(component_share) AS component_share, max(coverage) AS coverage, CASE WHEN count(*) = 1 THEN max(border_share) ELSE sum(border_share * share) / greatest(sum(share), 1e-9) END AS border_share,
CASE WHEN count(*) = 1 THEN bool_or(structural) ELSE coalesce(sum(n) FILTER (structural), 0) / greatest(1, sum(n)) >= 0.70 END AS structural FROM given GROUP BY ALL"""),
    ),
)
def merged_swatches(v: Views) -> DataFrame:
    """Given clusters of an image's swatches, each folded into one."""
    rows = v.colors.withColumns({"cluster": F.col("swatch_no") % 3, "n": 1 + F.col("image_id") % 7 * F.col("swatch_no")})
    out = palette.merged(rows)
    return out.select("image_id", "cluster", *long("swatch_no", "r", "g", "b", "n", "swatches"), *r6("share", "adjusted_share", "salience", "component_share", "coverage", "border_share"), "structural")


@query("alg01_palette_kmeans")
def palette_kmeans(v: Views) -> DataFrame:
    """Three colours of each actor and month."""
    rows = v.colors.where("current_eligible").select(F.xxhash64("day", "actor").alias("key"), (F.col("image_id") * 64 + F.col("swatch_no")).alias("id"), "ll", "la", "lb")
    return cl.kmeans(rows, 3)[1].select("key", *long("c"), "id", "n")
