"""Queries over the ledger, dates, regimes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huetide.operators import ledger as lg
from huetide.operators import regime as rg
from huetide.plans.catalog import BEST, COLORS, long, query, r6, text
from huetide.plans.evidence import best
from huetide.sources.fixtures import Views

DAY = "2024-01-20"
FIRST = (
    "first_images",
    """SELECT * EXCLUDE (p), coalesce(adjusted_share, share) AS weight FROM (SELECT *, dense_rank() OVER (PARTITION BY day, actor ORDER BY confidence DESC, image_id) AS p FROM colors WHERE baseline_eligible) WHERE p = 1 AND swatch_no <= 5""",
)
IMAGE = (
    "image_",
    """SELECT a.day, a.actor, a.image_id, neutral_share, size, monochrome, contrast FROM (SELECT day, actor, image_id, sum(CASE WHEN neutral THEN weight ELSE 0 END) / CASE WHEN sum(weight) = 0 THEN 1 ELSE sum(weight) END AS neutral_share, count(*) AS size,
 CASE WHEN coalesce(max(CASE WHEN NOT neutral THEN hue END) - min(CASE WHEN NOT neutral THEN hue END), 0) < 25 THEN 1.0 ELSE 0.0 END AS monochrome FROM first_images GROUP BY ALL) a
LEFT JOIN (SELECT x.image_id, max(sqrt((x.ll - y.ll) * (x.ll - y.ll) + (x.la - y.la) * (x.la - y.la) + (x.lb - y.lb) * (x.lb - y.lb))) AS contrast FROM first_images x JOIN first_images y ON x.image_id = y.image_id AND x.swatch_no < y.swatch_no GROUP BY x.image_id) c USING (image_id)""",
)
REGIME = (
    "regime_rows",
    """SELECT *, CASE WHEN neutral_share >= 0.68 AND median_chroma < 0.06 THEN 'neutral minimalism' WHEN median_chroma < 0.075 AND contrast < 0.20 THEN 'soft muted palettes'
 WHEN median_chroma < 0.11 AND contrast < 0.28 THEN 'pastel and softened color' WHEN median_chroma >= 0.16 AND contrast >= 0.30 THEN 'high-chroma maximalism' WHEN median_chroma >= 0.13 THEN 'saturated accents'
 WHEN contrast >= 0.32 THEN 'high-contrast mixed palettes' ELSE 'grounded mid-chroma color' END AS regime FROM
 (SELECT day, avg(neutral_share) AS neutral_share, avg(contrast) AS contrast, avg(size) AS palette_size, avg(monochrome) AS monochrome_share FROM image_ GROUP BY day) a
 JOIN (SELECT day, median(chroma) AS median_chroma, avg(ll) AS mean_lightness FROM (SELECT day, chroma, ll, unnest(range(greatest(1, CAST(trunc(weight * 10) AS INT)))) FROM first_images) GROUP BY day) b USING (day)
 JOIN (SELECT day, w / CASE WHEN w + c = 0 THEN 1 ELSE w + c END AS warm_share, m / CASE WHEN m + e = 0 THEN 1 ELSE m + e END AS muted_share FROM (SELECT day, sum(CASE WHEN NOT neutral AND (hue < 135 OR hue >= 315) THEN weight ELSE 0 END) AS w,
  sum(CASE WHEN NOT neutral AND hue >= 135 AND hue < 315 THEN weight ELSE 0 END) AS c, sum(CASE WHEN NOT neutral AND chroma < 0.1 THEN weight ELSE 0 END) AS m, sum(CASE WHEN NOT neutral AND chroma >= 0.18 THEN weight ELSE 0 END) AS e FROM first_images GROUP BY day)) d USING (day)""",
)
REGIME_ON = (COLORS[0], (*COLORS[1], FIRST, IMAGE, REGIME))
MEASURES = ["neutral_share", "contrast", "palette_size", "monochrome_share", "median_chroma", "mean_lightness", "warm_share", "muted_share"]


def regimes(v: Views) -> DataFrame:
    return rg.regimes(v.colors.where("baseline_eligible"))


@query("agg08_palette_regime", f"SELECT CAST(day AS VARCHAR) AS day, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM regime_rows", on=REGIME_ON)
def palette_regime(v: Views) -> DataFrame:
    return regimes(v).select(*text("day"), *r6(*MEASURES))


@query("prj16_regime_label", "SELECT regime, count(*) AS days FROM regime_rows GROUP BY regime", on=REGIME_ON)
def regime_label(v: Views) -> DataFrame:
    return regimes(v).groupBy("regime").agg(F.count("*").alias("days"))


@query(
    "agg15_period_summary",
    """SELECT CAST(y AS BIGINT) AS year, regime, round(mean_chroma, 6) AS mean_chroma, round(mean_neutral, 6) AS mean_neutral, CAST(highest AS VARCHAR) AS highest_chroma_day FROM
 (SELECT y, regime FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, regime) AS p FROM (SELECT year(day) AS y, regime, count(*) AS n FROM regime_rows GROUP BY 1, 2)) WHERE p = 1)
 JOIN (SELECT year(day) AS y, avg(median_chroma) AS mean_chroma, avg(neutral_share) AS mean_neutral, max_by(day, median_chroma) AS highest FROM regime_rows GROUP BY ALL) USING (y)""",
    on=REGIME_ON,
)
def period_summary(v: Views) -> DataFrame:
    return rg.monthly(regimes(v)).select(*long("year"), "regime", *r6("mean_chroma", "mean_neutral"), *text("highest_chroma_day"))


@query(
    "agg09_colour_pairs",
    """SELECT CAST(day AS VARCHAR) AS day, "first", "second", round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(score, 9) DESC, "first", "second") AS place FROM (
SELECT x.day, least(x.hex, y.hex) AS "first", greatest(x.hex, y.hex) AS "second", sum(least(x.weight, y.weight) * x.confidence) AS score FROM chromatic x JOIN chromatic y ON x.image_id = y.image_id AND x.place < y.place GROUP BY ALL)) WHERE place <= 10""",
    on=(COLORS[0], (*COLORS[1], FIRST, ("chromatic", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY swatch_no) AS place FROM first_images WHERE NOT neutral) WHERE place <= 4"))),
)
def colour_pairs(v: Views) -> DataFrame:
    return rg.pairs(v.colors.where("baseline_eligible")).select(*text("day"), "first", "second", *r6("score"), *long("place"))


@query(
    "jn05_asof_ledger",
    f"""SELECT source_id, region, fingerprint, CAST(day AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY source_id, region ORDER BY day DESC, event_id DESC) AS p FROM ledger_events WHERE day < DATE '{DAY}') WHERE p = 1""",
    views=("ledger_events",),
)
def asof(v: Views) -> DataFrame:
    return lg.as_of(v.ledger_events, ["source_id", "region"], F.lit(DAY).cast("date")).select("source_id", "region", "fingerprint", *text("day"))


@query(
    "jn06_region_source_fallback",
    f"""SELECT e.event_id, coalesce(r.fingerprint, s.fingerprint) AS prior, CASE WHEN r.fingerprint IS NOT NULL THEN 'region' WHEN s.fingerprint IS NOT NULL THEN 'source' ELSE 'none' END AS level
FROM (SELECT * FROM ledger_events WHERE day = DATE '{DAY}') e
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, region ORDER BY day DESC, event_id DESC) AS p FROM ledger_events WHERE day < DATE '{DAY}') WHERE p = 1) r ON r.source_id = e.source_id AND r.region = e.region
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day DESC, event_id DESC) AS p FROM ledger_events WHERE day < DATE '{DAY}') WHERE p = 1) s ON s.source_id = e.source_id""",
    views=("ledger_events",),
)
def fallback(v: Views) -> DataFrame:
    day = F.lit(DAY).cast("date")
    return lg.with_prior(v.ledger_events.where(F.col("day") == day), v.ledger_events, day).select("event_id", F.col("prior.fingerprint").alias("prior"), "level")


CHANGES = (
    "changes",
    """SELECT *, min(day) OVER w AS first_seen, last_value(CASE WHEN changed THEN day END IGNORE NULLS) OVER w AS last_changed FROM (
SELECT *, coalesce(lag(fingerprint) OVER (PARTITION BY source_id, region ORDER BY ts, event_id) <> fingerprint, true) AS changed FROM ledger_events)
WINDOW w AS (PARTITION BY source_id, region ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)


@query("win04_seen_changed", "SELECT event_id, changed, CAST(first_seen AS VARCHAR) AS first_seen, CAST(day AS VARCHAR) AS last_seen, CAST(last_changed AS VARCHAR) AS last_changed FROM changes", views=("ledger_events",), extra=(CHANGES,))
def seen_changed(v: Views) -> DataFrame:
    return lg.changes(v.ledger_events).select("event_id", "changed", *text("first_seen", "last_seen", "last_changed"))


@query(
    "agg19_source_health",
    """SELECT status, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN status LIKE '%timeout%' OR status LIKE '%budget%' THEN source_id END) AS timed_out FROM (
SELECT user_id AS source_id, CASE WHEN value > 90 THEN event_type || '_timeout' ELSE event_type END AS status FROM events) GROUP BY status""",
)
def source_health(v: Views) -> DataFrame:
    status = F.when(F.col("value") > 90, F.concat("event_type", F.lit("_timeout"))).otherwise(F.col("event_type"))
    return lg.health(v.events.select(F.col("user_id").alias("source_id"), status.alias("status")))


DATES = (
    "dates_",
    """SELECT page_id, dated_url, html, list_sort(list_distinct(list_filter([try_cast(replace(m[1], '/', '-') AS DATE)], lambda d: d IS NOT NULL))) AS urls
FROM (SELECT *, [regexp_extract(dated_url, '(20[0-9]{2}/[0-9]{2}/[0-9]{2})', 1)] AS m FROM page_dates)""",
)


@query("prj08_url_dates", "SELECT page_id, array_to_string(list_transform(urls, lambda d: CAST(d AS VARCHAR)), ',') AS dates FROM dates_", views=("page_dates",), extra=(DATES,))
def url_dates(v: Views) -> DataFrame:
    return v.page_dates.select("page_id", F.array_join(F.transform(lg.url_dates(F.col("dated_url")), lambda d: d.cast("string")), ",").alias("dates"))


#: Words of an overlay at the end of some pages, past whatever a prefix would show.
_SPLICED = "CASE WHEN page_id % 10 = 9 THEN '<p>Please SIGN IN</p>' ELSE '' END"
RECORDS = (
    "records",
    f"""SELECT page_id, urls, html || {_SPLICED} AS html, CASE page_id % 6 WHEN 0 THEN 'newly-listed' WHEN 1 THEN 'catalog' WHEN 2 THEN 'exhibition-opening' WHEN 3 THEN 'campaign' WHEN 4 THEN 'marketplace-list' ELSE 'campaign' END AS event,
 CASE WHEN page_id % 7 = 0 THEN 'art' ELSE 'retail' END AS domain, CASE WHEN page_id % 5 = 0 THEN 'creation' ELSE 'distribution' END AS stage,
 CASE WHEN page_id % 3 = 0 THEN 'discovery' ELSE 'benchmark' END AS panel, CASE WHEN page_id % 11 = 0 THEN 'independent' ELSE 'institutional' END AS scale,
 CASE WHEN page_id % 4 = 0 THEN '' ELSE 'f' || CAST(page_id % 2 AS VARCHAR) END AS prior, 'f' || CAST(page_id % 8 // 4 AS VARCHAR) AS fingerprint FROM (SELECT * EXCLUDE (urls), CASE WHEN page_id % 2 = 0 THEN urls ELSE [] END AS urls FROM dates_)""",
)
_WEAK = "(panel = 'discovery' OR scale IN ('grassroots', 'independent') OR stage = 'creation' OR event IN ('newly-listed', 'exhibition-opening', 'new-arrival', 'launch') OR domain = 'art')"
STATUS_SQL = f"""SELECT page_id, CASE WHEN len(list_filter(urls, lambda d: d > DATE '2024-02-15')) > 0 THEN 'rejected_future'
 WHEN regexp_matches(lower(html), '{'|'.join(lg.OVERLAY_TERMS)}') THEN 'rejected_overlay'
 WHEN event = 'catalog' AND (len(urls) = 0 OR len(list_filter(urls, lambda d: DATE '2024-02-15' - d BETWEEN 0 AND 2)) = 0) THEN 'context_only_historical'
 WHEN len(urls) = 0 AND {_WEAK} THEN 'context_only_undated' WHEN len(urls) = 0 AND prior <> '' AND prior = fingerprint THEN 'baseline_only_unchanged'
 WHEN len(urls) = 0 AND prior <> '' THEN 'eligible_changed_today' WHEN len(urls) = 0 THEN 'calibration_only_undated'
 WHEN DATE '2024-02-15' - list_max(urls) > span AND {_WEAK} THEN 'context_only_stale' WHEN DATE '2024-02-15' - list_max(urls) > span THEN 'baseline_only_stale' ELSE 'eligible_current' END AS status
FROM (SELECT *, CASE WHEN event LIKE '%exhibit%' THEN 45 WHEN event LIKE '%list%' THEN 3 ELSE 2 END AS span FROM records)"""


def record_rows(v: Views) -> DataFrame:
    k = F.col("page_id")
    event = F.element_at(F.array(*map(F.lit, ("newly-listed", "catalog", "exhibition-opening", "campaign", "marketplace-list", "campaign"))), (k % 6 + 1).cast("int"))
    return v.page_dates.select(
        "page_id", F.when(k % 2 == 0, lg.url_dates(F.col("dated_url"))).otherwise(F.array().cast("array<date>")).alias("dates"), F.concat("html", F.expr(_SPLICED)).alias("about"), event.alias("event"),
        F.when(k % 7 == 0, "art").otherwise("retail").alias("domain"), F.when(k % 5 == 0, "creation").otherwise("distribution").alias("stage"), F.when(k % 3 == 0, "discovery").otherwise("benchmark").alias("panel"),
        F.when(k % 11 == 0, "independent").otherwise("institutional").alias("scale"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("f"), (k % 2).cast("string"))).alias("prior"), F.concat(F.lit("f"), F.floor(k % 8 / 4).cast("string")).alias("fingerprint"),
    )


def status_rows(v: Views) -> DataFrame:
    return record_rows(v).withColumn("status", lg.temporal_status(F.lit("2024-02-15").cast("date"), F.col("dates"), F.col("about"), F.col("prior"), F.col("fingerprint")))


STATUS = ("status_", STATUS_SQL)
STATUS_ON = (("page_dates",), (DATES, RECORDS, STATUS))


@query("prj07_temporal_status", "SELECT page_id, status FROM status_", on=STATUS_ON)
def temporal_status(v: Views) -> DataFrame:
    return status_rows(v).select("page_id", "status")


@query(
    "prj07_temporal_record",
    """SELECT s.page_id, s.status, CASE s.status WHEN 'rejected_future' THEN 'dated later: ' || array_to_string(list_transform(list_filter(urls, lambda d: d > DATE '2024-02-15'), lambda d: CAST(d AS VARCHAR)), ', ')
 WHEN 'rejected_overlay' THEN 'text of an overlay' WHEN 'context_only_historical' THEN CASE WHEN len(urls) = 0 THEN 'historical and undated' ELSE 'historical, no date of these days' END WHEN 'context_only_undated' THEN 'needs a date'
 WHEN 'baseline_only_unchanged' THEN 'undated, fingerprint unchanged' WHEN 'eligible_changed_today' THEN 'undated, fingerprint changed' WHEN 'calibration_only_undated' THEN 'undated, seen for the first time' WHEN 'eligible_current' THEN 'within ' || span || ' days'
 ELSE CAST(DATE '2024-02-15' - list_max(list_filter(urls, lambda d: d <= DATE '2024-02-15')) AS VARCHAR) || ' days old, ' || span || ' allowed' END AS reasons,
 CASE WHEN prior <> '' AND prior = fingerprint THEN '2024-01-' || lpad(CAST(1 + s.page_id % 20 AS VARCHAR), 2, '0') ELSE '2024-02-15' END AS first_seen, '2024-02-15' AS last_seen,
 CASE WHEN prior <> '' AND prior = fingerprint THEN '2024-02-' || lpad(CAST(1 + s.page_id % 9 AS VARCHAR), 2, '0') ELSE '2024-02-15' END AS last_changed, CASE s.page_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'region' ELSE 'source' END AS level
FROM status_ s JOIN (SELECT *, CASE WHEN event LIKE '%exhibit%' THEN 45 WHEN event LIKE '%list%' THEN 3 ELSE 2 END AS span FROM records) r ON r.page_id = s.page_id""",
    on=STATUS_ON,
)
def temporal_record(v: Views) -> DataFrame:
    """Records against a ledger of sources with regions: some have their region in it, some their source alone, some neither."""
    k = F.col("page_id")
    dates = [F.date_add(F.lit(day).cast("date"), (k % n).cast("int")) for day, n in (("2024-01-01", 20), ("2024-02-01", 9))]
    kept = F.struct(F.concat(F.lit("f"), (k % 2).cast("string")).alias("fingerprint"), dates[0].alias("first_seen"), dates[1].alias("last_changed"))
    other = F.struct(F.lit("zz").alias("fingerprint"), dates[0].alias("first_seen"), dates[0].alias("last_changed"))
    own = k % 4 == 1
    nested = v.page_dates.where(k % 4 > 0).select(
        k.alias("source_id"), F.when(own, other).otherwise(kept).alias("s"), F.create_map(F.lit("elsewhere"), other, F.lit("top"), F.when(own, kept)).alias("regions")
    ).select("source_id", "s.*", "regions")
    rows = record_rows(v).drop("prior").select("*", k.alias("source_id"), F.lit("top").alias("region"))
    out = lg.temporal_records(rows, lg.flat_ledger(nested), F.lit("2024-02-15").cast("date"))
    return out.select("page_id", "status", F.array_join("reasons", "; ").alias("reasons"), *text("first_seen", "last_seen", "last_changed"), "level")


@query(
    "agg19_health_lists",
    """SELECT 'timed_out' AS list, CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM events WHERE value > 90 GROUP BY user_id
UNION ALL SELECT 'captured', event_type, count(DISTINCT user_id) FROM events WHERE event_id % 5 > 0 GROUP BY event_type""",
)
def health_lists(v: Views) -> DataFrame:
    """Sources that timed out, and sources that gave regions by domain (event types as domains)."""
    status = F.when(F.col("value") > 90, "page_timeout").otherwise("complete")
    late, gave = lg.health_lists(v.events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("domain"), status.alias("status"), (F.col("event_id") % 5).alias("regions")))
    return late.select(F.lit("timed_out").alias("list"), F.col("source_id").cast("string").alias("name"), F.col("times").alias("n")).unionAll(gave.select(F.lit("captured"), "domain", "sources"))


@query(
    "prj10_admission_overrides",
    """SELECT page_id, admitted, admitted LIKE 'eligible_%' OR admitted LIKE 'baseline_only_%' OR admitted LIKE 'calibration_only_%' AS baseline_ok, admitted LIKE 'eligible_%' AS current_ok FROM (
SELECT page_id, CASE WHEN s2 = 'eligible_changed_today' AND page_id % 5 = 1 THEN 'baseline_only_unchanged' ELSE s2 END AS admitted FROM (
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'context_only_stale' WHEN page_id % 9 = 0 AND status NOT LIKE 'rejected_%' THEN CASE WHEN page_id % 2 = 0 THEN 'eligible_observed_attention' ELSE 'context_only_unverified_snapshot' END ELSE status END AS s2 FROM status_))""",
    on=STATUS_ON,
)
def overrides(v: Views) -> DataFrame:
    k = F.col("page_id")
    rows = status_rows(v).withColumn("admitted", lg.admission(F.col("status"), k % 9 == 0, k % 2 == 0, k % 13 == 0, k % 5 == 1))
    ok = F.col("admitted").startswith("eligible_")
    return rows.select("page_id", "admitted", (ok | F.col("admitted").startswith("baseline_only_") | F.col("admitted").startswith("calibration_only_")).alias("baseline_ok"), ok.alias("current_ok"))


@query("prj09_date_parse", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def date_parse(v: Views) -> DataFrame:
    """Order dates written in four formats, read again."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(d, "dd MMM yyyy HH:mm:ss")).otherwise(F.concat(F.lit("Tue, "), F.date_format(d, "d MMM yyyy HH:mm:ss")))
    return v.orders.select("o_orderkey", lg.parse_date(said).cast("string").alias("day"))


@query(
    "jn07_inherited_metadata",
    """SELECT c.c_custkey AS id, coalesce(CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 3 = 1 AND FALSE THEN '' ELSE CASE WHEN c.c_custkey % 3 = 1 THEN NULL ELSE c.c_mktsegment END END,
 CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE n.first_name END) AS segment FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
LEFT JOIN (SELECT 'n' || CAST(s_nationkey AS VARCHAR) AS name, min_by(s_name, s_suppkey) AS first_name FROM supplier GROUP BY ALL) n ON n.name = 'n' || CAST(c.c_nationkey AS VARCHAR)""",
)
def inherited(v: Views) -> DataFrame:
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, "").otherwise(F.col("c_mktsegment"))
    records = v.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"), own.alias("segment"))
    index = v.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_name").alias("segment"))
    return lg.inherit(records, index, ["segment"]).select("id", "segment")


# Fixed word list: first parts of a colour's name by family.
PREFIXES = {
    "Red": ["Signal", "After-Hours", "Poster Ink", "Emergency Exit"], "Red-Orange": ["Kiln", "Transit Map", "Festival Wristband", "Late Checkout"],
    "Orange": ["Airport Signage", "Studio Ceramic", "Launch Day", "Apricot Vinyl"], "Amber": ["Gallery Light", "Archive Label", "Cinema Lobby", "Honeyed Glass"],
    "Yellow": ["Highlighter", "Morning Edition", "Soft Launch", "Sunlit Receipt"], "Yellow-Green": ["New Growth", "Digital Moss", "Gallery Exit", "Signal Garden"],
    "Chartreuse": ["Underground Flyer", "Electric Herb", "Night Market", "Acid Tennis"], "Green": ["Open Studio", "Transit Garden", "Independent Press", "Soft Hardware"],
    "Teal": ["Public Pool", "New Interface", "Sea Glass", "Night Train"], "Cyan": ["Prototype", "Cold Screen", "Festival Laser", "Open Water"],
    "Blue": ["Cloud Migration", "Museum Wall", "Quarterly Deck", "Platform"], "Indigo": ["Late-Night App", "Ink Wash", "Deep Link", "Stage Curtain"],
    "Violet": ["Private Beta", "Creator Economy", "Gallery Dusk", "Limited Edition"], "Magenta": ["Pop-Up", "New Wave", "Beauty Counter", "Digital Bloom"],
    "Rose": ["Editorial", "Soft Power", "Archive Blush", "Studio Dust"],
}
NEUTRALS = ("Black", "Charcoal", "Gray", "Light Gray", "White")
_NAMES = ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in PREFIXES.items())
_LIST = f"coalesce(list_extract(map_extract(MAP {{{_NAMES}}}, family), 1), ['Cultural Signal'])"


@query(
    "prj15_creative_names",
    f"""SELECT CAST(day AS VARCHAR) AS day, family, actor, CASE WHEN family IN ('Black', 'Charcoal', 'Gray', 'Light Gray', 'White') THEN family ELSE upper(
 list_extract({_LIST}, CAST(('0x' || substr(sha256(CAST(day AS VARCHAR) || ':' || hex || ':' || CAST(domain AS VARCHAR)), 1, 2))::INT % len({_LIST}) + 1 AS BIGINT)) || ' ' || family) END AS name FROM best""",
    on=BEST,
)
def creative_names(v: Views) -> DataFrame:
    options = F.coalesce(F.create_map(*[x for k, names in PREFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])[F.col("family")], F.array(F.lit("Cultural Signal")))
    first = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("day").cast("string"), "hex", F.col("domain").cast("string")), 256), 1, 2), 16, 10).cast("int")
    name = F.upper(F.concat_ws(" ", F.element_at(options, first % F.size(options) + 1), "family"))
    return best(v).select(*text("day"), "family", "actor", F.when(F.col("family").isin(*NEUTRALS), F.col("family")).otherwise(name).alias("name"))
