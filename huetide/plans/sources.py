"""Queries over the registry, pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huetide.functions import color, urls
from huetide.operators import pages as pg
from huetide.operators import panel as pn
from huetide.plans.catalog import long, query, r6, text
from huetide.sources.fixtures import Views

DATE = "2024-05-01"


@query(
    "src03_registry_validation",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, 'segment' AS rule FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 'balance' FROM customer WHERE NOT c_acctbal >= 0""",
)
def registry_validation(v: Views) -> DataFrame:
    checks = {"segment": F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"), "balance": F.col("c_acctbal") >= 0, "name": F.col("c_name") != ""}
    return pn.registry_violations(v.customer, checks, "c_custkey")


@query("agg22_registry_statistics", "SELECT *, sources >= 30 AND domains >= 10 AND stages = 3 AND panels = 2 AND sectors_known AS ok FROM (SELECT count(*) AS sources, count(DISTINCT domain) AS domains, count(DISTINCT stage) AS stages, count(DISTINCT panel) AS panels, bool_and(sector IS NOT NULL) AS sectors_known FROM registry)", views=("registry",))
def registry_statistics(v: Views) -> DataFrame:
    return pn.statistics(v.registry)


#: Sources that every rotation takes.
MANDATORY = (3, 19, 43)
ROTATION = f"""SELECT actor, domain, mandatory FROM (SELECT *, CASE WHEN mandatory THEN 0 ELSE row_number() OVER (PARTITION BY domain, mandatory ORDER BY h) END AS turn FROM (SELECT *, actor IN {MANDATORY} AS mandatory, sha256('{DATE}:' || CAST(actor AS VARCHAR)) AS h FROM registry WHERE panel = 'discovery')) ORDER BY mandatory DESC, turn, domain, h LIMIT 10"""


@query("win07_domain_rotation", ROTATION, views=("registry",))
def domain_rotation(v: Views) -> DataFrame:
    return pn.rotation(v.registry.where("panel = 'discovery'"), DATE, 10, F.col("actor").isin(*MANDATORY)).select("actor", "domain", "mandatory")


@query("top06_hash_sample", f"SELECT c_custkey FROM customer ORDER BY sha256('smoke:{DATE}:' || CAST(c_custkey AS VARCHAR)) LIMIT 25")
def hash_sample(v: Views) -> DataFrame:
    return pn.hash_sample(v.customer.select("c_custkey"), DATE, 25, "c_custkey")


@query("set05_panel_partition", f"SELECT p.actor, CASE WHEN p.panel = 'benchmark' THEN 'active' WHEN s.actor IS NOT NULL THEN 'selected' ELSE 'skipped' END AS status FROM registry p LEFT JOIN (SELECT actor FROM ({ROTATION})) s ON s.actor = p.actor", views=("registry",))
def panel_partition(v: Views) -> DataFrame:
    chosen = pn.rotation(v.registry.where("panel = 'discovery'"), DATE, 10, F.col("actor").isin(*MANDATORY)).select("actor", F.lit(True).alias("chosen"))
    status = F.when(F.col("panel") == "benchmark", "active").when(F.col("chosen"), "selected").otherwise("skipped")
    return v.registry.join(F.broadcast(chosen), "actor", "left").select("actor", status.alias("status"))


@query("win06_round_robin", "SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations) ORDER BY rn, role LIMIT 60")
def round_robin(v: Views) -> DataFrame:
    rows = v.conversations.select("role", "conv_id", F.col("turn").alias("t"))
    return pn.round_robin(rows, "role", ["conv_id", "t"], 60).select("role", "conv_id", F.col("t").alias("turn"))


DIMS = ["domain", "stage", "scale", "panel", "sector"]
_LAST = "(SELECT actor, max_by(domain, seq) AS domain, max_by(stage, seq) AS stage, max_by(scale, seq) AS scale, max_by(panel, seq) AS panel, max_by(sector, seq) AS sector FROM (SELECT p.*, i.image_id AS seq FROM images i JOIN panel p ON p.actor = i.actor) GROUP BY actor)"


@query("agg10_breakdown", "SELECT dimension, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM {_LAST}" for d in DIMS) + ") GROUP BY ALL", views=("images", "panel"))
def breakdown(v: Views) -> DataFrame:
    rows = v.images.join(F.broadcast(v.panel), "actor").select(F.col("actor").alias("id"), F.col("image_id").alias("seq"), *DIMS)
    return pn.breakdown(rows, DIMS)


@query("jn10_resume_plan", "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.source = d.source AND sha256(c.text) = sha256(d.text)) THEN 'skip' ELSE 'do' END AS plan FROM documents d")
def resume_plan(v: Views) -> DataFrame:
    rows = v.documents.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    skip, do = pn.resume_plan(rows, rows.where("doc_id % 3 = 0"), ["source", "digest"])
    return skip.select("doc_id", F.lit("skip").alias("plan")).union(do.select("doc_id", F.lit("do")))


@query(
    "jn11_annotation_cache",
    """SELECT id, CASE WHEN hit THEN 'cached' WHEN key IN (SELECT key FROM (SELECT key, min(id) AS f FROM req WHERE NOT hit GROUP BY key ORDER BY f LIMIT 100)) THEN 'queued' ELSE 'over_budget' END AS state FROM req""",
    extra=(("keys", "SELECT doc_id AS id, sha256(text || '|model|v1') AS key FROM documents"), ("req", "SELECT *, key IN (SELECT key FROM keys WHERE id % 4 = 0) AS hit FROM keys")),
)
def annotation_cache(v: Views) -> DataFrame:
    rows = v.documents.select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("|", "text", F.lit("model"), F.lit("v1")).cast("binary"), 256).alias("key"))
    return pn.cache_join(rows, rows.where("id % 4 = 0"), 100).select("id", "state")


@query("jn12_prediction_label", "SELECT l.doc_id, expected, decision FROM reviews l LEFT JOIN (SELECT doc_id, decision FROM reviews WHERE doc_id % 5 <> 0) p USING (doc_id) WHERE split = 'test'".replace("expected, decision", "expected, p.decision"), views=("reviews",))
def prediction_label(v: Views) -> DataFrame:
    said = v.reviews.where("doc_id % 5 <> 0").select("doc_id", "decision")
    return v.reviews.where("split = 'test'").select("doc_id", "expected").join(said, "doc_id", "left")


@query(
    "agg20_classifier_metrics",
    """SELECT count(p.decision) AS evaluated, count(*) FILTER (p.decision = expected) AS correct, count(*) FILTER (p.decision IS NULL) AS missing, round(count(*) FILTER (p.decision = expected) / nullif(count(p.decision), 0), 6) AS accuracy,
 round(count(*) FILTER (p.decision = 'accept' AND expected = 'accept') / nullif(count(*) FILTER (p.decision = 'accept'), 0), 6) AS "precision", round(count(*) FILTER (p.decision = 'accept' AND expected = 'accept') / nullif(count(*) FILTER (p.decision IS NOT NULL AND expected = 'accept'), 0), 6) AS recall
FROM reviews l LEFT JOIN (SELECT doc_id, decision FROM reviews WHERE doc_id % 5 <> 0) p USING (doc_id) WHERE split = 'test'""",
    views=("reviews",),
)
def classifier_metrics(v: Views) -> DataFrame:
    labels = v.reviews.select(F.col("doc_id").alias("id"), "expected", "split")
    said = v.reviews.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), "decision")
    return pn.evaluation(labels, said).select("evaluated", "correct", "missing", *r6("accuracy", "precision", "recall"))


@query("set03_required_keys", "SELECT n_nationkey AS key FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500")
def required_keys(v: Views) -> DataFrame:
    return v.nation.select(F.col("n_nationkey").alias("key")).subtract(v.supplier.where("s_acctbal > 9500").select("s_nationkey"))


@query("set04_record_distinct", "SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY source, text")
def record_distinct(v: Views) -> DataFrame:
    rows = v.documents.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_id", "lang")
    return pn.first_of_equal(rows, ["source", "digest"], "doc_id").select("source", "digest", "doc_id")


@query("set06_error_scopes", "SELECT array_to_string(list_sort(list(DISTINCT message)), '; ') AS messages, count(*) AS n FROM (SELECT 'share out of range' AS message FROM swatches WHERE share > 0.9 UNION ALL SELECT 'component above share' FROM swatches WHERE component_share > share UNION ALL SELECT 'negative component' FROM swatches WHERE component_share < 0)", views=("swatches",))
def error_scopes(v: Views) -> DataFrame:
    found = [v.swatches.where(test).select(F.lit(name).alias("message")) for test, name in (("share > 0.9", "share out of range"), ("component_share > share", "component above share"), ("component_share < 0", "negative component"))]
    rows = found[0].union(found[1]).union(found[2])
    counts = rows.groupBy("message").count()  # a row a message
    return counts.agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("messages"), F.sum("count").alias("n"))


@query("src07_release_window", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'incomplete_release_date' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN 'kept' ELSE 'outside_requested_window' END AS status FROM orders) GROUP BY status")
def release_window(v: Views) -> DataFrame:
    """Dates as written, some without a day; only whole ones inside the window stay."""
    said = F.when(F.col("o_orderkey") % 10 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = F.try_to_date(said, "yyyy-MM-dd")
    status = F.when(day.isNull(), "incomplete_release_date").when(day.between("1996-01-01", "1996-12-31"), "kept").otherwise("outside_requested_window")
    return v.orders.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "alg10_page_dates",
    """SELECT page_id, CASE WHEN i <> '' AND try_cast(i AS DATE) IS NOT NULL THEN 'itemprop' WHEN t <> '' AND try_cast(t AS DATE) IS NOT NULL THEN 'time' END AS method,
 CASE WHEN coalesce(try_cast(nullif(i, '') AS DATE), try_cast(nullif(t, '') AS DATE)) IS NULL THEN 'missing' ELSE 'explicit' END AS status, CAST(coalesce(try_cast(nullif(i, '') AS DATE), try_cast(nullif(t, '') AS DATE)) AS VARCHAR) AS published_at
FROM (SELECT page_id, regexp_extract(html, 'itemprop="datePublished" content="([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS i, regexp_extract(html, '<time datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS t FROM page_dates)""",
    views=("page_dates",),
)
def page_dates(v: Views) -> DataFrame:
    return pg.date_evidence(v.page_dates).select("page_id", "method", "status", *text("published_at"))


@query(
    "alg11_ranked_lists",
    """SELECT page_id, CAST(r AS BIGINT) AS rank, links[r] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS r FROM (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1) AS links FROM pages) WHERE len(links) >= 3 AND len(list_distinct(links)) = len(links))""",
)
def ranked_lists(v: Views) -> DataFrame:
    return pg.ranked_links(v.pages).select("page_id", *long("rank"), "link")


@query(
    "scl02_url_forms",
    """SELECT page_id, lower(regexp_extract(base, '^[A-Za-z]+://[^/]*')) || substr(base, len(regexp_extract(base, '^[A-Za-z]+://[^/]*')) + 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical, lower(regexp_extract(plain, '^[A-Za-z]+://[^/]*')) || substr(plain, len(regexp_extract(plain, '^[A-Za-z]+://[^/]*')) + 1) AS normalized, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host FROM (
SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS plain, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') AS base, list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT regexp_matches(lower(p), '^(fbclid|gclid)(=|$)'))) AS kept FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'HTTP' || replace(substr(url, 5), 'example', 'Example') ELSE url END AS url FROM pages))""",
)
def url_forms(v: Views) -> DataFrame:
    """Addresses, some with capitals in scheme and host."""
    pages = v.pages.selectExpr("page_id", "CASE WHEN page_id % 3 = 0 THEN 'HTTP' || replace(substr(url, 5), 'example', 'Example') ELSE url END AS url")
    url = F.col("url")
    return pages.select("page_id", urls.canonical_url(url).alias("canonical"), urls.normalized_url(url).alias("normalized"), urls.host(url).alias("host"))


@query(
    "prj20_chart_snapshots",
    "SELECT conv_id, count(*) >= 3 AND min(turn + 1) >= 1 AND max(turn + 1) <= 200 AND count(DISTINCT turn) = count(*) AND count(DISTINCT text) = count(*) AS valid FROM conversations GROUP BY conv_id",
)
def chart_snapshots(v: Views) -> DataFrame:
    rows = v.conversations.groupBy("conv_id").agg(F.collect_list(F.struct((F.col("turn") + 1).alias("rank"), F.sha2(F.col("text").cast("binary"), 256).alias("item"))).alias("rows"))  # a conversation's turns
    return rows.select("conv_id", pg.snapshot_valid(F.col("rows")).alias("valid"))


@query("prj14_actor_identity", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'p' || CAST(l_suppkey % 5 AS VARCHAR) || ':c' || CAST(l_partkey % 50 AS VARCHAR) ELSE 'publisher:s' || CAST(l_suppkey AS VARCHAR) END WHEN l_partkey % 2 = 0 THEN 'c' || CAST(l_partkey % 50 AS VARCHAR) ELSE 's' || CAST(l_suppkey AS VARCHAR) END AS actor FROM lineitem")
def actor_identity(v: Views) -> DataFrame:
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    part = F.col("l_partkey")
    item = F.col("l_linenumber") % 2 == 0
    creator = F.when(item | (part % 2 == 0), named("c", part % 50)).otherwise("")
    actor = pg.identity(item, named("p", F.col("l_suppkey") % 5), named("s", F.col("l_suppkey")), creator, part % 3 == 0)
    return v.lineitem.select("l_orderkey", "l_linenumber", actor.alias("actor"))


@query("scl01_strings", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, printf('#%02X%02X%02X', p_partkey % 16 * 17, p_partkey // 16 % 16 * 17, p_partkey // 256 % 16 * 17) AS hex FROM part")
def strings(v: Views) -> DataFrame:
    from huetide.operators.ledger import slug

    k = F.col("p_partkey")
    short = F.format_string(" #%x%x%x", k % 16, F.floor(k / 16) % 16, F.floor(k / 256) % 16)
    return v.part.select("p_partkey", slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), color.normalize_hex(short).alias("hex"))


@query("scl04_local_date", "SELECT event_id, CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day FROM events")
def local_date(v: Views) -> DataFrame:
    return v.events.select("event_id", F.from_utc_timestamp("ts", "-05:00").cast("date").cast("string").alias("local_day"))


@query("scl05_contrast", "SELECT hex, round((greatest(lum, 0.2) + 0.05) / (least(lum, 0.2) + 0.05), 6) AS ratio FROM (SELECT DISTINCT hex, 0.2126 * lr + 0.7152 * lg + 0.0722 * lbl AS lum FROM colors)", on=(("swatches",), color.sql_colors()))
def contrast(v: Views) -> DataFrame:
    rows = v.swatches.select("r", "g", "b").distinct()
    return rows.select(color.hex_of("r", "g", "b").alias("hex"), F.round(color.contrast(color.luminance("r", "g", "b"), F.lit(0.2)), 6).alias("ratio"))


@query("scl06_arrays", "SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS most, round(list_min(embedding)::DOUBLE, 6) AS least, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_sum(list_transform(embedding[1:4], lambda x: CAST(x > 0 AS INT))) = 4 AS first_all FROM embeddings")
def arrays(v: Views) -> DataFrame:
    e = F.col("embedding")
    return v.embeddings.select("vec_id", F.round(F.array_max(e).cast("double"), 6).alias("most"), F.round(F.array_min(e).cast("double"), 6).alias("least"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.forall(F.slice(e, 1, 4), lambda x: x > 0).alias("first_all"))


@query("scl07_json_lookup", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.key'), ''), json_extract_string(props, '$.k')) AS value FROM events")
def json_lookup(v: Views) -> DataFrame:
    return v.events.select("event_id", urls.first_known(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).alias("value"))


@query(
    "prj14_item_identity",
    """SELECT page_id, CASE WHEN item THEN CASE WHEN known THEN 'shop:c' || page_id % 40 ELSE 'publisher:s' || page_id % 9 END ELSE CASE WHEN page_id % 3 = 0 THEN 'owner' || page_id % 4 ELSE 's' || page_id % 9 END END AS actor_id,
 CASE WHEN item AND known THEN CASE WHEN page_id % 10 = 0 THEN 'Source' ELSE 'C' END ELSE 'Source' END AS actor_name, NOT item OR known AS identity_verified, CASE WHEN NOT item OR known THEN 'source_metadata' ELSE 'conservative_publisher_group' END AS identity_basis,
 CASE WHEN page_id % 4 = 0 THEN 'i' || page_id WHEN page_id % 4 = 1 THEN 'https://e.org/Item?a=1&b=' || page_id ELSE 'r' || page_id END AS item_id,
 substr(sha256(CASE WHEN page_id % 4 = 0 THEN 'i' || page_id WHEN page_id % 4 = 1 THEN 'https://e.org/Item?a=1&b=' || page_id ELSE 'r' || page_id END), 1, 20) AS item_key
FROM (SELECT page_id, page_id % 2 = 0 AS item, page_id % 5 < 3 AND page_id % 7 > 0 AS known FROM pages)""",
)
def item_identity(v: Views) -> DataFrame:
    """Pages as observations of item adapters and other sources."""
    k = F.col("page_id")
    named = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    mine = lambda p: F.concat(F.lit(p), k.cast("string"))
    rows = v.pages.select(
        "page_id", (k % 2 == 0).alias("item_adapter"), F.lit("shop").alias("platform"), named("s", 9).alias("source_id"), F.lit("Source").alias("source_name"), F.when(k % 3 == 0, named("owner", 4)).otherwise("").alias("source_creator"),
        F.when(k % 4 == 1, F.concat(F.lit("HTTPS://E.org/Item?utm_x=1&b="), k.cast("string"), F.lit("&a=1#f"))).alias("page_url"), mine("r").alias("region_id"), F.when(k % 4 == 0, mine("i")).alias("item_id"),
        F.when(k % 7 == 0, "  ").otherwise(named("c", 40)).alias("meta_creator"), F.when(k % 10 == 0, "").otherwise("C").alias("meta_name"), F.when(k % 5 < 3, True).alias("meta_verified"),
    )
    return pg.item_identity(rows).select("page_id", "actor_id", "actor_name", "identity_verified", "identity_basis", "item_id", "item_key")


@query(
    "scl03_fingerprints",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'c' || page_id WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'q' || page_id WHEN 3 THEN sha256(html)
 ELSE sha256('{"hex": "#A\\"1", "region": "", "source": "s' || page_id % 9 || '", "url": "' || url || '"}') END AS fingerprint FROM pages""",
)
def fingerprints(v: Views) -> DataFrame:
    """Records with one of several fingerprint fields, with bytes alone, or with neither."""
    k = F.col("page_id")
    mine = lambda p: F.concat(F.lit(p), k.cast("string"))
    fields = F.map_filter(F.create_map(F.lit("phash"), F.when(k % 5 < 2, mine("p")), F.lit("content_hash"), F.when(k % 5 == 0, mine("c")).when(k % 5 == 1, ""), F.lit("sha256"), F.when(k % 5 == 2, mine("q"))), lambda _, x: x.isNotNull())
    content = F.when(k % 5 == 3, F.encode("html", "UTF-8"))
    made = urls.fingerprint(fields, content, F.concat(F.lit("s"), (k % 9).cast("string")), F.col("url"), F.lit('#A"1'), F.lit(None).cast("string"))
    return v.pages.select("page_id", made.alias("fingerprint"))
