"""Queries over the archive of days: cohorts, prevalence, leaders, recurrence, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huetide.operators import evidence as ev
from huetide.operators import history as hi
from huetide.operators import leaders as le
from huetide.plans.catalog import BEST, CAND, COLORS, long, query, r6, text
from huetide.plans.evidence import best, cand
from huetide.sources.fixtures import Views

BEFORE, COMPAT = "1998-01-01", "v2"
ASKED = (("grey", 0.6, 0.0, 0.0), ("ember", 0.55, 0.12, 0.08), ("moss", 0.7, -0.1, 0.08), ("ink", 0.4, 0.02, -0.12))
_VALUES = ", ".join(f"('{n}', {x}, {y}, {z})" for n, x, y, z in ASKED)

_DIST = "sqrt((ll - al) * (ll - al) + (la - aa) * (la - aa) + (lb - ab) * (lb - ab))"
DAYS = ("vdays", f"SELECT day FROM manifest WHERE day < DATE '{BEFORE}' AND eligible AND state <> 'blocked' AND compat = '{COMPAT}' AND day IN (SELECT day FROM swatches WHERE baseline_eligible) ORDER BY day DESC LIMIT 30")
ANCHORS = ("anchors", f"SELECT * FROM (VALUES {_VALUES}) t(anchor, al, aa, ab)")
PAST = (
    "past",
    f"""SELECT anchor, day, actor, max(CASE WHEN {_DIST} <= 0.045 THEN coalesce(adjusted_share, share) ELSE 0 END) AS share
FROM (SELECT c.* FROM colors c JOIN panel p ON p.actor = c.actor WHERE panel = 'benchmark' AND baseline_eligible AND day IN (SELECT day FROM vdays)), anchors GROUP BY ALL""",
)
NOW = (
    "now_",
    f"""SELECT anchor, actor, max(CASE WHEN {_DIST} <= 0.045 THEN coalesce(adjusted_share, share) ELSE 0 END) AS share
FROM (SELECT c.* FROM colors c JOIN panel p ON p.actor = c.actor WHERE panel = 'benchmark' AND baseline_eligible AND day = DATE '{BEFORE}'), anchors GROUP BY ALL""",
)
HIST = (
    "hist",
    "SELECT anchor, actor, count(*) AS days, count(*) FILTER (share > 0) AS present_days, count(*) FILTER (share > 0) / count(*) AS frequency, avg(share) AS mean_share, max_by(share, day) AS last_share FROM past GROUP BY ALL",
)
DAILY = (
    "daily",
    """SELECT anchor, day, sum(n) AS cohort, count(*) AS domains, avg(nr) AS now_rate, avg(pr) AS past_rate FROM (
 SELECT p.anchor, p.day, d.domain, avg(CASE WHEN n.share > 0 THEN 1.0 ELSE 0 END) AS nr, avg(CASE WHEN p.share > 0 THEN 1.0 ELSE 0 END) AS pr, count(*) AS n
 FROM past p JOIN now_ n USING (anchor, actor) JOIN panel d USING (actor) JOIN hist h USING (anchor, actor) WHERE h.days >= 5 GROUP BY ALL) GROUP BY ALL
HAVING sum(n) >= greatest(6, ceil((SELECT count(DISTINCT actor) FROM now_) * 0.5))""",
)
SUMMARY = (
    "summary_",
    """SELECT o.anchor, observed, count(day) AS comparable_days, avg(now_rate) AS now_rate, avg(past_rate) AS past_rate, 100 * (avg(now_rate) - avg(past_rate)) AS change_pp,
 avg(now_rate) / nullif(avg(past_rate), 0) AS lift, count(day) >= 5 AS valid
FROM (SELECT anchor, count(*) AS observed FROM now_ GROUP BY anchor) o LEFT JOIN daily USING (anchor) GROUP BY o.anchor, observed""",
)
ON = ((*COLORS[0], "manifest", "panel"), (*COLORS[1], DAYS, ANCHORS, PAST, NOW, HIST, DAILY, SUMMARY))


def benchmark(v: Views) -> DataFrame:
    return v.colors.where("baseline_eligible").join(F.broadcast(v.panel.where("panel = 'benchmark'").select("actor")), "actor")


def past(v: Views) -> DataFrame:
    return hi.actor_shares(hi.history(benchmark(v), v.manifest, BEFORE, COMPAT), hi.anchors(*ASKED), ["day"])


def now(v: Views) -> DataFrame:
    return hi.actor_shares(benchmark(v).where(F.col("day") == F.lit(BEFORE).cast("date")), hi.anchors(*ASKED), [])


def prevalence(v: Views) -> tuple[DataFrame, DataFrame]:
    return hi.paired_prevalence(now(v), past(v), v.panel.select("actor", "domain"))


@query("src01_history_scan", "SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT image_id) AS images, count(*) AS swatches FROM swatches WHERE baseline_eligible AND day IN (SELECT day FROM vdays) GROUP BY day", views=("swatches", "manifest"), extra=(DAYS,))
def history_scan(v: Views) -> DataFrame:
    return hi.history(v.swatches, v.manifest, BEFORE, COMPAT).groupBy("day").agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("swatches")).select(*text("day"), "images", "swatches")


@query(
    "win03_last_periods",
    f"""SELECT CAST(day AS VARCHAR) AS day, place FROM (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS place FROM manifest WHERE day < DATE '{BEFORE}' AND eligible AND state <> 'blocked' AND compat = '{COMPAT}') WHERE place <= 30""",
    views=("manifest",),
)
def last_periods(v: Views) -> DataFrame:
    days = hi.valid_days(v.manifest, BEFORE, COMPAT)
    return days.select(*text("day"), *[F.dense_rank().over(Window.orderBy(F.desc("day"))).cast("long").alias("place")])  # 30 rows


@query("agg01_best_share", "SELECT anchor, CAST(day AS VARCHAR) AS day, actor, round(share, 6) AS share FROM past", on=ON)
def best_share(v: Views) -> DataFrame:
    return past(v).select("anchor", *text("day"), "actor", *r6("share"))


@query("agg02_actor_history", "SELECT anchor, actor, days, present_days, round(frequency, 6) AS frequency, round(mean_share, 6) AS mean_share FROM hist", on=ON)
def actor_history(v: Views) -> DataFrame:
    return hi.color_history(past(v)).select("anchor", "actor", "days", "present_days", *r6("frequency", "mean_share"))


@query("win05_last_share", "SELECT anchor, actor, round(last_share, 6) AS last_share FROM hist", on=ON)
def last_share(v: Views) -> DataFrame:
    return hi.color_history(past(v)).select("anchor", "actor", *r6("last_share"))


@query("jn02_paired_cohort", "SELECT anchor, CAST(day AS VARCHAR) AS day, CAST(cohort AS BIGINT) AS cohort, domains FROM daily", on=ON)
def paired_cohort(v: Views) -> DataFrame:
    return prevalence(v)[0].select("anchor", *text("day"), "cohort", "domains")


@query(
    "agg03_paired_prevalence",
    "SELECT anchor, observed, comparable_days, valid, round(now_rate, 6) AS now_rate, round(past_rate, 6) AS past_rate, round(change_pp, 6) AS change_pp, round(lift, 6) AS lift FROM summary_",
    on=ON,
)
def paired(v: Views) -> DataFrame:
    return prevalence(v)[1].select("anchor", "observed", "comparable_days", "valid", *r6("now_rate", "past_rate", "change_pp", "lift"))


@query(
    "set01_cohort_intersection",
    "SELECT actor FROM hist WHERE days >= 5 AND anchor = 'grey' INTERSECT SELECT actor FROM now_",
    on=ON,
)
def cohort_intersection(v: Views) -> DataFrame:
    return hi.color_history(past(v)).where("days >= 5 and anchor = 'grey'").select("actor").intersect(now(v).select("actor"))


# of each actor behind a candidate: the twelve months before in which it was seen, and those in which it had the family
RATIOS = (
    "ratios",
    """SELECT day, family, avg(CASE WHEN present = 0 THEN 1.0 ELSE 0.0 END) AS new_ratio, avg(CASE WHEN present / seen >= 0.70 THEN 1.0 ELSE 0.0 END) AS identity_ratio FROM (
 SELECT b.day, b.family, b.actor, count(DISTINCT s.day) AS seen, count(DISTINCT CASE WHEN s.family = b.family THEN s.day END) AS present
 FROM best b JOIN best s ON s.actor = b.actor AND s.day < b.day AND s.day >= b.day - INTERVAL 12 MONTH GROUP BY ALL) WHERE seen >= 5 GROUP BY day, family""",
)
# a candidate is a family of a month; its change is that of the family's share of benchmark actors over the twelve months before
MONTHS = (
    "months",
    """SELECT c.*, y.prior_rate, y.days, rate - prior_rate AS delta, y.days >= 5 AS valid, coalesce(r.new_ratio, 0) AS new_ratio, coalesce(r.identity_ratio, 0) AS identity_ratio FROM (
 SELECT c.*, s.n, c.benchmark_count / s.n AS rate FROM cand c JOIN (SELECT day, count(DISTINCT actor) AS n FROM best WHERE panel = 'benchmark' GROUP BY day) s USING (day)) c
 JOIN (SELECT a.day, a.family, avg(coalesce(b.benchmark_count, 0) / s.n) AS prior_rate, count(*) AS days FROM cand a
  JOIN (SELECT day, count(DISTINCT actor) AS n FROM best WHERE panel = 'benchmark' GROUP BY day) s ON s.day < a.day AND s.day >= a.day - INTERVAL 12 MONTH
  LEFT JOIN cand b ON b.day = s.day AND b.family = a.family GROUP BY a.day, a.family) y USING (day, family) LEFT JOIN ratios r USING (day, family)""",
)
SCORED = (
    "scored",
    """SELECT *, CASE WHEN days < 7 THEN 'calibration' WHEN NOT valid THEN 'observed' WHEN delta * 100 <= -5 THEN 'cooling' WHEN delta * 100 < 5 THEN CASE WHEN identity_ratio >= 0.7 THEN 'identity' ELSE 'stable' END
 WHEN delta * 100 >= 20 AND emergence_score >= 75 THEN 'surging' WHEN domain_count >= 4 AND stage_count >= 2 THEN 'spreading' ELSE 'rising' END AS trend FROM (
SELECT *, 100 * (0.25 * novelty + 0.25 * least(1, domain_count / 7) + 0.20 * least(1, stage_count / 3) + 0.15 * velocity + 0.10 * small_large + 0.05 * evidence_quality) AS emergence_score FROM (
SELECT *, CASE WHEN valid THEN least(1, greatest(0, delta) * 2 + 0.5 * new_ratio) ELSE 0 END AS novelty, CASE WHEN valid THEN least(1, greatest(0, delta) * 4) ELSE 0 END AS velocity FROM months))""",
)
DIAMETER = (
    "diam",
    """SELECT a.day, a.family, max(sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb - b.lb) * (a.lb - b.lb))) AS diameter
FROM best a JOIN best b ON a.day = b.day AND a.family = b.family GROUP BY ALL""",
)
GATED = (
    "gated",
    """SELECT s.*, diameter, top_source_weight <= 0.25 AND top_domain_weight <= 0.45 AND top_platform_weight <= 0.40 AS concentrated_ok,
 family NOT IN ('Black', 'Charcoal', 'Gray', 'Light Gray', 'White') OR (days >= 14 AND velocity >= 0.7 AND source_count >= 10 AND domain_count >= 6 AND top_source_weight <= 0.2) AS neutral_ok,
 diameter <= 0.05 AND mean_component >= 0.006 AS integrity_ok,
 source_count >= 4 AND domain_count >= 3 AND family NOT IN ('Black', 'Charcoal', 'Gray', 'Light Gray', 'White') AND diameter <= 0.05 AND mean_component >= 0.006 AS runner_ok,
 round(emergence_score, 6) AS score FROM scored s JOIN diam USING (day, family)""",
)
SCORE_ON = (CAND[0], (*CAND[1], RATIOS, MONTHS, SCORED))
GATE_ON = (CAND[0], (*CAND[1], RATIOS, MONTHS, SCORED, DIAMETER, GATED))
# leaders that pass: enough support; colours of a family are wide, so integrity is reported and not asked here
EMERGING = "score >= 55 AND source_count >= 6 AND domain_count >= 4 AND concentrated_ok AND neutral_ok"


def scored(v: Views) -> DataFrame:
    """Candidates with their scores, kept: gates, ties and audits read them."""
    return v.kept("scored", lambda: _scored(v))


def _scored(v: Views) -> DataFrame:
    rows, c = best(v), cand(v)
    seen = rows.where("panel = 'benchmark'").groupBy("day").agg(F.count_distinct("actor").alias("n"))  # a row a month
    before = seen.select(F.col("day").alias("pday"), F.col("n").alias("pn"))
    prior = c.select("day", "family", F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.add_months("day", -k))).alias("pday")).join(F.broadcast(before), "pday")
    past_rows = c.select(F.col("day").alias("pday"), "family", F.col("benchmark_count").alias("pc"))
    prior = prior.join(past_rows, ["pday", "family"], "left").groupBy("day", "family").agg(F.avg(F.coalesce(F.col("pc"), F.lit(0)) / F.col("pn")).alias("prior_rate"), F.count("*").alias("days"))
    out = c.join(F.broadcast(seen), "day").join(prior, ["day", "family"]).withColumns({"delta": F.col("benchmark_count") / F.col("n") - F.col("prior_rate"), "valid": F.col("days") >= 5})
    out = out.join(hi.new_ratio(rows.select("day", "family", "actor"), known_actors(rows), ["day", "family"]), ["day", "family"], "left")
    out = out.withColumns(le.emergence(F.col("valid"), F.col("delta"), F.col("new_ratio")))
    return out.withColumn("trend", le.trend_state(F.col("days"), F.col("valid"), F.col("delta"), F.col("identity_ratio")))


def known_actors(rows: DataFrame) -> DataFrame:
    """For each actor and family of a month, in the twelve months before: days seen, present_days with the family, and their ratio, frequency."""
    earlier = F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.add_months("day", -k))).alias("_day")
    asked = rows.select("day", "family", "actor", earlier)
    seen = rows.select(F.col("day").alias("_day"), "actor").distinct()
    had = rows.select(F.col("day").alias("_day"), "actor", "family").distinct().withColumn("_had", F.lit(1))
    both = asked.join(seen, ["_day", "actor"]).join(had, ["_day", "actor", "family"], "left")
    return both.groupBy("day", "family", "actor").agg(F.count("*").alias("days"), F.count("_had").alias("present_days")).withColumn("frequency", F.col("present_days") / F.col("days"))


def gated(v: Views) -> DataFrame:
    return v.kept("gated", lambda: _gated(v))


def _gated(v: Views) -> DataFrame:
    wide = ev.medoid_and_diameter(best(v), ["day", "family"]).select("day", "family", "diameter")
    out = scored(v).join(wide, ["day", "family"])
    gates = {"concentrated_ok": le.concentration_ok(), "neutral_ok": le.neutral_ok(F.col("days")), "integrity_ok": le.integrity_ok(), "runner_ok": le.runner_ok(), "score": F.round("emergence_score", 6)}
    return out.withColumns(gates)


@query("agg07_emergence_score", "SELECT CAST(day AS VARCHAR) AS day, family, round(novelty, 6) AS novelty, round(velocity, 6) AS velocity, round(emergence_score, 6) AS emergence_score FROM scored", on=SCORE_ON)
def emergence(v: Views) -> DataFrame:
    return scored(v).select(*text("day"), "family", *r6("novelty", "velocity", "emergence_score"))


@query("prj17_trend_state", "SELECT trend, count(*) AS n FROM scored GROUP BY trend", on=SCORE_ON)
def trend(v: Views) -> DataFrame:
    return scored(v).groupBy("trend").agg(F.count("*").alias("n"))


@query("prj19_leader_gates", "SELECT CAST(day AS VARCHAR) AS day, family, concentrated_ok, neutral_ok, integrity_ok, runner_ok FROM gated", on=GATE_ON)
def gates(v: Views) -> DataFrame:
    return gated(v).select(*text("day"), "family", "concentrated_ok", "neutral_ok", "integrity_ok", "runner_ok")


@query("win02_score_margin", f"SELECT CAST(day AS VARCHAR) AS day, family, round(coalesce(score - lead(score) OVER (PARTITION BY day ORDER BY score DESC, family), 100), 6) AS margin FROM gated WHERE {EMERGING}", on=GATE_ON)
def margin(v: Views) -> DataFrame:
    return le.margins(gated(v).where(EMERGING), ["day"]).select(*text("day"), "family", *r6("margin"))


def _first(column: str, name: str) -> str:
    return f"SELECT CAST(day AS VARCHAR) AS day, '{name}' AS kind, family, round({column}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round({column}, 9) DESC, round(emergence_score, 9) DESC, source_count DESC, family) AS rn FROM scored) WHERE rn = 1"


@query("top02_leader_pick", " UNION ALL ".join(_first(c, n) for c, n in (("usage_score", "usage"), ("undercurrent_score", "undercurrent"), ("mainstream_score", "mainstream"))), on=SCORE_ON)
def leader_pick(v: Views) -> DataFrame:
    rows = scored(v).withColumn("_e", F.round("emergence_score", 9))
    pick = lambda c, n: le.first_of(rows, ["day"], c, ["_e", "source_count"]).select(*text("day"), F.lit(n).alias("kind"), "family", *r6("score"))
    return pick("usage_score", "usage").union(pick("undercurrent_score", "undercurrent")).union(pick("mainstream_score", "mainstream"))


TIES = (
    "ties_",
    f"""SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, family) AS place FROM (
SELECT *, first_value(score) OVER w AS top, first_value(uncertainty) OVER w AS u, row_number() OVER w AS rn FROM gated WHERE {EMERGING} WINDOW w AS (PARTITION BY day ORDER BY score DESC, family))
WHERE rn = 1 OR (top - score <= 2.5 AND abs(top - score) <= 10 * (u + uncertainty))""",
)


@query("top03_bounded_ties", "SELECT CAST(day AS VARCHAR) AS day, family, score, place FROM ties_ WHERE place <= 2", on=GATE_ON, extra=(TIES,))
def bounded_ties(v: Views) -> DataFrame:
    return le.ties(gated(v).where(EMERGING), ["day"]).select(*text("day"), "family", "score", *long("place"))


RUNNERS = """SELECT CAST(day AS VARCHAR) AS day, family, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, source_count DESC, family) AS place FROM gated g
WHERE source_count >= 4 AND domain_count >= 3 AND family NOT IN ('Black', 'Charcoal', 'Gray', 'Light Gray', 'White') AND NOT EXISTS (SELECT 1 FROM ties_ t WHERE t.place <= 2 AND t.day = g.day AND t.family = g.family)) WHERE place <= 3"""


@query("top04_runners_up", RUNNERS, on=GATE_ON, extra=(TIES,))
def runners(v: Views) -> DataFrame:
    rows = gated(v)
    others = rows.where("source_count >= 4 and domain_count >= 3 and chromatic").join(le.ties(rows.where(EMERGING), ["day"]).select("day", "family"), ["day", "family"], "left_anti")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), F.desc("source_count"), "family"))
    return others.withColumn("place", place).where("place <= 3").select(*text("day"), "family", *long("place"))


# days of the archive: winners are each month's first two families by usage score
WINNERS = (
    "winners",
    """SELECT w.day, w.family, w.source_count, m.state, b.hex, b.ll, b.la, b.lb FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(usage_score, 9) DESC, source_count DESC, family) AS rn FROM cand) w
JOIN manifest m USING (day) JOIN (SELECT day, family, hex, ll, la, lb, row_number() OVER (PARTITION BY day, family ORDER BY confidence DESC, component_share DESC, share DESC, actor) AS p FROM best) b ON b.day = w.day AND b.family = w.family AND p = 1
WHERE w.rn <= 1 + month(w.day) % 2""",
)
WIN_ON = ((*CAND[0], "manifest"), (*CAND[1], WINNERS))


def winners(v: Views) -> DataFrame:
    rows = best(v)
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(F.round("usage_score", 9)), F.desc("source_count"), "family"))
    top = ev.candidates(rows, ["day", "family"]).withColumn("rn", place).where(F.col("rn") <= 1 + F.month("day") % 2)
    shown = ev.evidence_order(rows, ["day", "family"]).where("place = 1").select("day", "family", "hex", "ll", "la", "lb")
    return top.select("day", "family", "source_count").join(F.broadcast(v.manifest.select("day", "state")), "day").join(shown, ["day", "family"])


TODAY = "1998-06-01"
RECUR = f"""SELECT now.hex, coalesce(d.days, 0) + 1 AS days, round(coalesce(d.part, 0) + 1.0 / today, 6) AS day_share, actors, domains FROM
(SELECT hex, ll, la, lb, count(*) OVER () AS today FROM winners WHERE day = DATE '{TODAY}') now
LEFT JOIN (SELECT nh, count(*) AS days, sum(1.0 / n) AS part FROM (SELECT DISTINCT nh, day, n FROM matched) GROUP BY nh) d ON d.nh = now.hex
LEFT JOIN (SELECT nh, count(DISTINCT actor) AS actors, count(DISTINCT domain) AS domains FROM (
 SELECT nh, b.actor, b.domain FROM matched m JOIN best b ON b.day = m.day AND b.family = m.family UNION ALL
 SELECT w.hex, b.actor, b.domain FROM winners w JOIN best b USING (day, family) WHERE w.day = DATE '{TODAY}') GROUP BY nh) u ON u.nh = now.hex"""
MATCHED = (
    "matched",
    f"""SELECT p.day, p.family, p.n, c.hex AS nh FROM (SELECT *, count(*) OVER (PARTITION BY day) AS n FROM winners WHERE state = 'ready') p JOIN winners c ON c.day = DATE '{TODAY}' AND year(p.day) = year(c.day) AND p.day < c.day
WHERE sqrt((p.ll - c.ll) * (p.ll - c.ll) + (p.la - c.la) * (p.la - c.la) + (p.lb - c.lb) * (p.lb - c.lb)) <= 0.055""",
)


def winner_actors(v: Views, w: DataFrame) -> DataFrame:
    return w.select("day", "family", "hex").join(best(v).select("day", "family", "actor", "domain"), ["day", "family"]).select("day", "hex", "actor", "domain")


@query("agg16_recurrence", RECUR, on=WIN_ON, extra=(MATCHED,))
def recur(v: Views) -> DataFrame:
    w = winners(v)
    return hi.recurrence(w, winner_actors(v, w), TODAY).select("hex", *long("days"), *r6("day_share"), "actors", "domains")


@query(
    "set02_union_over_history",
    "SELECT CAST(w.day AS VARCHAR) AS day, count(DISTINCT b.actor) AS actors, count(DISTINCT b.domain) AS domains FROM winners w JOIN winners o ON year(o.day) = year(w.day) AND o.day <= w.day JOIN best b ON b.day = o.day AND b.family = o.family GROUP BY w.day",
    on=WIN_ON,
)
def union_over_history(v: Views) -> DataFrame:
    w = winners(v)
    a = winner_actors(v, w).select("day", "actor", "domain").distinct()
    days = w.select(F.col("day").alias("of")).distinct()
    rows = a.withColumn("_y", F.year("day")).join(F.broadcast(days.withColumn("_y", F.year("of"))), "_y").where("day <= of")  # a row a month
    return rows.select("of", "actor", "domain").distinct().groupBy(F.col("of").cast("string").alias("day")).agg(F.count_distinct("actor").alias("actors"), F.count_distinct("domain").alias("domains"))


@query(
    "agg17_color_trail",
    f"""SELECT anchor, CAST(day AS VARCHAR) AS day, count(DISTINCT CASE WHEN hit THEN actor END) AS matching, count(DISTINCT actor) AS observed, count(DISTINCT CASE WHEN hit THEN image_id END) AS evidence
FROM (SELECT *, {_DIST} <= 0.045 AND coalesce(adjusted_share, share) > 0 AS hit FROM colors, anchors WHERE baseline_eligible AND day <= DATE '{BEFORE}') GROUP BY anchor, day""",
    on=COLORS,
    extra=(ANCHORS,),
)
def color_trail(v: Views) -> DataFrame:
    return hi.trail(v.colors, hi.anchors(*ASKED), BEFORE).select("anchor", *text("day"), "matching", "observed", "evidence")


@query(
    "agg14_annual_families",
    """SELECT CAST(year(w.day) AS BIGINT) AS year, family, count(*) AS appearances, round(sum(1.0 / n), 6) AS day_share, max(a.actors) AS actors FROM (SELECT *, count(*) OVER (PARTITION BY day) AS n FROM winners WHERE state = 'ready') w
JOIN (SELECT year(w.day) AS y, family, count(DISTINCT b.actor) AS actors FROM winners w JOIN best b USING (day, family) WHERE w.state = 'ready' GROUP BY ALL) a ON a.y = year(w.day) AND a.family = w.family GROUP BY year(w.day), w.family""".replace("family, count(*)", "w.family, count(*)", 1),
    on=WIN_ON,
)
def annual_families(v: Views) -> DataFrame:
    w = winners(v).where("state = 'ready'").withColumns({"n": F.count("*").over(Window.partitionBy("day")), "year": F.year("day").cast("long")})
    a = w.select("day", "family", "year").join(best(v).select("day", "family", "actor"), ["day", "family"]).groupBy("year", "family").agg(F.count_distinct("actor").alias("actors"))
    return w.groupBy("year", "family").agg(F.count("*").alias("appearances"), F.round(F.sum(1.0 / F.col("n")), 6).alias("day_share")).join(a, ["year", "family"])


@query(
    "agg21_audited_score",
    """SELECT CAST(day AS VARCHAR) AS day, family, sources, domains, round(audited_score, 6) AS audited_score, eligible FROM audited""",
    on=(BEST[0], (*BEST[1], AUDITED := (
        "audited",
        """SELECT *, sources >= 6 AND domains >= 4 AND family NOT IN ('Black', 'Charcoal', 'Gray', 'Light Gray', 'White') AS eligible FROM (SELECT day, family, count(*) AS sources, count(DISTINCT domain) AS domains,
 40 * least(count(*) / 15, 1) + 25 * least(count(DISTINCT domain) / 8, 1) + 15 * least(count(DISTINCT stage) / 3, 1) + 8 * least(count(DISTINCT scale) / 4, 1) + 5 * least(count(DISTINCT panel) / 2, 1)
 + 7 * avg(least(1, (share / 0.18 + component_share / 0.08) / 2)) AS audited_score FROM best GROUP BY day, family)""",
    ))),
)
def audited(v: Views) -> DataFrame:
    return audited_rows(v).select(*text("day"), "family", "sources", "domains", *r6("audited_score"), "eligible")


def audited_rows(v: Views) -> DataFrame:
    rows = best(v).groupBy("day", "family").agg(*[c.alias(n) for n, c in le.audited_score().items()])
    return rows.withColumn("eligible", (F.col("sources") >= 6) & (F.col("domains") >= 4) & F.col("chromatic"))


AUDIT_ON = (BEST[0], (*BEST[1], AUDITED))


@query(
    "top05_audited_tie",
    """SELECT CAST(d.day AS VARCHAR) AS day, first_ AS "first", second_ AS "second", round(delta, 6) AS delta, coalesce(delta <= 2.5, false) AS is_tie FROM (SELECT DISTINCT day FROM audited) d LEFT JOIN (
SELECT day, max(CASE WHEN p = 1 THEN family END) AS first_, max(CASE WHEN p = 2 THEN family END) AS second_, max(CASE WHEN p = 1 THEN audited_score END) - max(CASE WHEN p = 2 THEN audited_score END) AS delta
FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(audited_score, 9) DESC, sources DESC, family) AS p FROM audited WHERE eligible) WHERE p <= 2 GROUP BY day) t USING (day)""",
    on=AUDIT_ON,
)
def audited_tie(v: Views) -> DataFrame:
    return le.audited_tie(audited_rows(v).withColumn("audited_score", F.round("audited_score", 9)), ["day"]).select(*text("day"), "first", "second", *r6("delta"), "is_tie")


@query(
    "top07_audited_order",
    "SELECT CAST(day AS VARCHAR) AS day, family, row_number() OVER (PARTITION BY day ORDER BY eligible DESC, round(audited_score, 9) DESC, sources DESC, family) AS place FROM audited",
    on=AUDIT_ON,
)
def audited_order(v: Views) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("eligible"), F.desc(F.round("audited_score", 9)), F.desc("sources"), "family"))
    return audited_rows(v).select(*text("day"), "family", place.cast("long").alias("place"))


@query(
    "jn13_audit_agreement",
    """SELECT CAST(day AS VARCHAR) AS day, w.family, a.family AS audited, sqrt((w.ll - x.ll) * (w.ll - x.ll) + (w.la - x.la) * (w.la - x.la) + (w.lb - x.lb) * (w.lb - x.lb)) > 0.055 AS mismatch FROM winners w
JOIN (SELECT day, family, row_number() OVER (PARTITION BY day ORDER BY eligible DESC, round(audited_score, 9) DESC, sources DESC, family) AS p FROM audited) a USING (day)
JOIN (SELECT day, family, ll, la, lb, row_number() OVER (PARTITION BY day, family ORDER BY confidence DESC, component_share DESC, share DESC, actor) AS p FROM best) x ON x.day = a.day AND x.family = a.family AND x.p = 1 WHERE a.p = 1""".replace("CAST(day AS", "CAST(w.day AS", 1),
    on=(WIN_ON[0], (*WIN_ON[1], AUDITED)),
)
def agreement(v: Views) -> DataFrame:
    from huetide.functions.color import distance

    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("eligible"), F.desc(F.round("audited_score", 9)), F.desc("sources"), "family"))
    top = audited_rows(v).withColumn("p", place).where("p = 1").select("day", F.col("family").alias("audited"))
    shown = ev.evidence_order(best(v), ["day", "family"]).where("place = 1").select("day", F.col("family").alias("audited"), F.col("ll").alias("xl"), F.col("la").alias("xa"), F.col("lb").alias("xb"))
    rows = winners(v).join(top.join(shown, ["day", "audited"]), "day")
    return rows.select(*text("day"), "family", "audited", (distance(("ll", "la", "lb"), ("xl", "xa", "xb")) > 0.055).alias("mismatch"))


@query(
    "prj18_publication_state",
    """SELECT CAST(day AS VARCHAR) AS day, CASE WHEN blocked <> '' THEN 'blocked' WHEN winners = 0 THEN CASE WHEN baseline_days < 7 THEN 'review_only' ELSE 'baseline_only' END WHEN review <> '' THEN 'review_only' ELSE 'ready' END AS state,
 CASE WHEN blocked <> '' THEN blocked ELSE review END AS reasons FROM (SELECT *, array_to_string(list_filter([CASE WHEN evidence < greatest(12, ceil(active * 0.30)) THEN 'evidence' END, CASE WHEN domains < 4 THEN 'domains' END, CASE WHEN stages < 2 THEN 'stages' END], lambda x: x IS NOT NULL), '; ') AS blocked,
 array_to_string(list_filter([CASE WHEN evidence < greatest(24, ceil(active * 0.55)) THEN 'coverage' END, CASE WHEN domains < 7 THEN 'domains' END, CASE WHEN stages < 3 THEN 'stages' END, CASE WHEN baseline_days < 7 THEN 'warming' END,
  CASE WHEN winners = 0 AND baseline_days >= 7 THEN 'no candidate' END, CASE WHEN winners = 0 AND baseline_days < 7 THEN 'calibration' END, CASE WHEN winners = 1 AND margin < 3 THEN 'close' END], lambda x: x IS NOT NULL), '; ') AS review
FROM (SELECT e.*, coalesce(w.winners, 0) AS winners, coalesce(w.margin, 100) AS margin, row_number() OVER (ORDER BY e.day) - 1 AS baseline_days FROM (SELECT day, 40 AS active, count(DISTINCT actor) AS evidence, count(DISTINCT domain) AS domains, count(DISTINCT stage) AS stages FROM best GROUP BY day) e
LEFT JOIN (SELECT t.day, count(*) AS winners, min(m.margin) AS margin FROM ties_ t JOIN (SELECT day, family, coalesce(score - lead(score) OVER (PARTITION BY day ORDER BY score DESC, family), 100) AS margin FROM gated WHERE """ + EMERGING + """) m USING (day, family) WHERE place <= 2 GROUP BY t.day) w USING (day)))""",
    on=GATE_ON,
    extra=(TIES,),
)
def publication(v: Views) -> DataFrame:
    rows, passed = best(v), gated(v).where(EMERGING)
    day = rows.groupBy("day").agg(F.lit(40).alias("active"), F.count_distinct("actor").alias("evidence"), F.count_distinct("domain").alias("domains"), F.count_distinct("stage").alias("stages"))
    won = le.ties(passed, ["day"]).select("day", "family").join(le.margins(passed, ["day"]).select("day", "family", "margin"), ["day", "family"]).groupBy("day").agg(F.count("*").alias("winners"), F.min("margin").alias("margin"))
    day = day.withColumn("baseline_days", F.row_number().over(Window.orderBy("day")) - 1)  # a row a month
    day = day.join(won, "day", "left").withColumns({"winners": F.coalesce("winners", F.lit(0)), "margin": F.coalesce("margin", F.lit(100.0))})
    return day.withColumns(le.publication_state()).select(*text("day"), "state", "reasons")
