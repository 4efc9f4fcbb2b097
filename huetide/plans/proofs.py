"""Queries over records, landed files, registry rules, pixels and proofs, made from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions import sql as functions
from huetide.functions import urls
from huetide.functions.color import sql_colors
from huetide.operators import evidence as ev
from huetide.operators import ledger as lg
from huetide.operators import pages as pg
from huetide.operators import palette
from huetide.operators import panel as pn
from huetide.plans.catalog import long, query, r6, text
from huetide.sources import files
from huetide.sources.fixtures import Views
from huetide.streaming import jobs


@query(
    "prj08_record_dates",
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 3 END, try_cast(concat('20', lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 14 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + o_custkey % 31 AS VARCHAR), 2, '0')) AS DATE)],
 lambda d: d IS NOT NULL))), ',') AS dates FROM orders""",
)
def record_dates(v: Views) -> DataFrame:
    """Orders as records: fields that date them or only seem to, and a dated address."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    fields = F.create_map(
        F.lit("published_on"), F.when(k % 3 == 0, "soon").otherwise(day.cast("string")),
        F.lit("Release_Date"), F.when(k % 2 == 0, F.date_format(F.date_add(day, 3), "d MMM yyyy HH:mm:ss")).otherwise(""),
        F.lit("observed_at"), F.lit("2001-01-01"), F.lit("first_seen"), F.lit("2001-01-02"), F.lit("title"), F.lit("2001-01-03"),
    )
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    url = F.concat(F.lit("https://e.org/20"), two(k % 30), F.lit("/"), two(1 + k % 14), F.lit("/"), two(1 + F.col("o_custkey") % 31), F.lit("/x"))
    return v.orders.select("o_orderkey", F.array_join(F.transform(lg.record_dates(fields, url), lambda d: d.cast("string")), ",").alias("dates"))


@query("prj09_epoch_dates", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def epoch_dates(v: Views) -> DataFrame:
    """Event times as numbers, seconds or milliseconds, read as days (of UTC)."""
    seconds = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    number = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    return v.events.select("event_id", lg.epoch_date(number).cast("string").alias("day"))


@query("jn12_label_errors", "SELECT doc_id AS id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 7 = 0) GROUP BY doc_id HAVING count(*) > 1")
def label_errors(v: Views) -> DataFrame:
    rows = v.labels.select(F.col("doc_id").alias("id"))
    return pn.label_errors(rows.unionAll(rows.where("id % 7 = 0")))


@query("scl03_region_keys", "SELECT page_id, sha256(concat_ws('|', lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)), CAST(page_id % 5 AS VARCHAR))) AS region FROM pages")
def region_keys(v: Views) -> DataFrame:
    return v.pages.select("page_id", urls.region_key(urls.host(F.col("url")), (F.col("page_id") % 5).cast("string")).alias("region"))


@query(
    "scl07_json_aliases",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 AND lang <> 'en' THEN lang END AS value FROM documents",
)
def json_aliases(v: Views) -> DataFrame:
    """Fields under several names in any case; empty texts, lists and objects count as absent."""
    k = F.col("doc_id") % 3
    value = F.when(F.col("lang") == "en", "[]").otherwise(F.col("lang"))
    body = F.when(k == 0, F.to_json(F.struct(F.col("source").alias("SourceName")))).when(k == 1, F.to_json(F.struct(F.lit("").alias("source_name"), value.alias("Publisher")))).otherwise(F.to_json(F.struct(F.lit("{}").alias("publisher"))))
    return v.documents.select("doc_id", urls.json_alias(body, "source_name", "sourcename", "publisher").alias("value"))


@query("src02_json_documents", "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source")
def json_documents(v: Views) -> DataFrame:
    """A JSON file a source in folders of their own, read back from a list that names the folders twice."""
    path = jobs.shared_path(v.spark)
    per = v.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    per.withColumn("folder", F.xxhash64("source")).repartition("folder").write.partitionBy("folder").json(f"{path}/good")
    rows = files.json_documents(v.spark, f"{path}/good", f"{path}/good")
    said = lambda name, kind: F.try_variant_get("document", f"$.{name}", kind).alias(name)
    return rows.select(said("source", "string"), said("n", "long"), said("first", "long"))


_ENTRY = "doc_id % 4 <> 3"


@query(
    "src05_atom_feed",
    f"""SELECT 'Item ' || doc_id AS title, 'https://e.org/i/' || doc_id AS link, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02T00:00:00Z' ELSE '2024-01-03T00:00:00Z' END AS published, 'https://e.org/p/' || doc_id || '.png' AS image_url
FROM documents WHERE {_ENTRY}""",
)
def atom_feed(v: Views) -> DataFrame:
    """Documents as entries of Atom files: enclosed images, images in the content, entries without any."""
    path, k = jobs.shared_path(v.spark), F.col("doc_id").cast("string")
    image = F.concat(F.lit("https://e.org/p/"), k, F.lit(".png"))
    enclosed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('<link rel="enclosure" type="image/png" href="'), image, F.lit('"/>'))).otherwise("")
    content = F.when(F.col("doc_id") % 4 == 3, "none").otherwise(F.concat(F.lit('&lt;img alt="x" src="'), image, F.lit('"&gt;')))
    dated = F.when(F.col("doc_id") % 2 == 0, "<published>2024-01-02T00:00:00Z</published><updated>2024-01-09T00:00:00Z</updated>").otherwise("<updated>2024-01-03T00:00:00Z</updated>")
    entry = F.concat(F.lit("<entry><title>Item "), k, F.lit('</title><link href="https://e.org/i/'), k, F.lit('"/>'), enclosed, dated, F.lit('<content type="html">'), content, F.lit("</content></entry>"))

    def feed(batches):  # a file's entries between its root's tags
        yield pa.RecordBatch.from_pydict({"value": ["<feed>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</feed>"]})

    v.documents.select(entry.alias("value")).mapInArrow(feed, "value string").write.text(path)
    return files.atom_items(v.spark, path, 2**31 - 1).select("title", "link", "published", "image_url")


@query("src09_archive_days", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) * CASE WHEN day(ts) <= 3 THEN 2 ELSE 1 END AS n FROM events GROUP BY CAST(ts AS DATE), event_type, day(ts)")
def archive_days(v: Views) -> DataFrame:
    """Days written to the archive; the first three of a month are written again and replace what was there."""
    path = jobs.shared_path(v.spark)
    days = v.events.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))
    files.archive(days, path)
    files.archive(days.where(F.dayofmonth("date") <= 3).withColumn("n", F.col("n") * 2), path)
    return v.spark.read.schema("event_type string, n long, date date").parquet(path).select(*text("date"), "event_type", "n")


def _payloads() -> dict[str, F.Column]:
    title, k = F.col("p_name"), F.col("p_partkey")
    url, image = F.concat(F.lit("u/"), "p_brand"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("i/"), "p_type"))
    when = F.when(k % 5 == 0, "2024-01").otherwise("2024-01-09")
    public = (k % 2 == 0).cast("string")
    s = lambda **columns: F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
    one = lambda name, c: F.struct(c.alias(name))
    return {
        "museum_a": s(title=title, objectURL=url, primaryImageSmall=image, isPublicDomain=public),
        "museum_b": s(title=title, api_link=url, image_id=image, is_public_domain=public),
        "museum_c": s(title=title, url=url, images=one("web", one("url", image))),
        "search": s(trackName=title, trackViewUrl=url, releaseDate=when, artworkUrl100=F.concat(F.lit("i/100x100/"), "p_type")),
        "releases": s(title=title, id=url, **{"first-release-date": when}),
        "crafts": s(title=title, url=url, creation_timestamp=when, images=F.array(one("url_fullxfull", image)), user_id=(k % 7).cast("string")),
        "launches": s(name=title, url=url, createdAt=when, thumbnail=one("url", image)),
    }


_PAYLOADS = " UNION ALL ".join(
    f"SELECT '{name}' AS provider, p_partkey AS id, p_name AS title, 'u/' || p_brand AS url, {when} AS published_at, {image} AS image_url, {creator} AS creator_id FROM part WHERE {test}"
    for name, when, image, creator, test in (
        ("museum_a", "''", "'i/' || p_type", "''", "p_partkey % 2 = 0 AND p_partkey % 3 <> 0"),
        ("museum_b", "''", "'i/' || p_type", "''", "p_partkey % 2 = 0 AND p_partkey % 3 <> 0"),
        ("museum_c", "''", "'i/' || p_type", "''", "p_partkey % 3 <> 0"),
        ("search", "CASE WHEN p_partkey % 5 = 0 THEN '2024-01' ELSE '2024-01-09' END", "'i/600x600/' || p_type", "''", "TRUE"),
        ("releases", "'2024-01-09'", "'u/' || p_brand", "''", "p_partkey % 5 <> 0"),
        ("crafts", "CASE WHEN p_partkey % 5 = 0 THEN '2024-01' ELSE '2024-01-09' END", "'i/' || p_type", "CAST(p_partkey % 7 AS VARCHAR)", "p_partkey % 3 <> 0"),
        ("launches", "CASE WHEN p_partkey % 5 = 0 THEN '2024-01' ELSE '2024-01-09' END", "'i/' || p_type", "''", "p_partkey % 3 <> 0"),
    )
)


@query("src06_all_providers", _PAYLOADS)
def all_providers(v: Views) -> DataFrame:
    """Parts as the payloads of every other provider, with images and dates that their rules refuse."""
    out = None
    for name, body in _payloads().items():
        rows = files.payload_items(v.part.select(F.col("p_partkey").alias("id"), body.alias("payload")), name).select(F.lit(name).alias("provider"), "id", "title", "url", "published_at", "image_url", "creator_id")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "src03_registry_rules",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, rule FROM (SELECT *, unnest(list_filter([CASE WHEN s_suppkey % 17 = 0 THEN 'required' END, CASE WHEN s_nationkey % 6 = 5 THEN 'stage' END,
 CASE WHEN s_suppkey % 4 = 3 THEN 'host' END, CASE WHEN s_suppkey % 10 = 0 THEN 'mark' END], lambda x: x IS NOT NULL)) AS rule FROM supplier)
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'duplicate' FROM supplier WHERE s_suppkey % 13 = 0""",
)
def registry_rules(v: Views) -> DataFrame:
    """Suppliers as a registry: required name, stage of a list, host equal to or below an allowed one, an approved mark with a path, ids given once."""
    k = F.col("s_suppkey")
    rows = v.supplier.select(
        k.alias("actor"),
        F.when(k % 17 == 0, " ").otherwise(F.col("s_name")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("creation", "distribution", "attention", "creation", "distribution", "gossip"))), (F.col("s_nationkey") % 6 + 1).cast("int")).alias("stage"),
        F.when(k % 4 == 0, "example.org").when(k % 4 == 1, "shop.example.org").when(k % 4 == 2, "www.e.net").otherwise("badexample.org").alias("host"),
        (k % 5 == 0).alias("approved"),
        F.when(k % 10 == 0, "").otherwise("marks/a.svg").alias("path"),
    )
    checks = {
        "required": F.trim("name") != "",
        "stage": F.col("stage").isin("creation", "distribution", "attention"),
        "host": pn.host_allowed(F.col("host"), ["example.org", "e.net"]),
        "mark": ~F.col("approved") | (F.col("path") != ""),
    }
    twice = pn.registry_violations(rows.unionAll(rows.where("actor % 13 = 0")), {}).select("id", "rule")
    return pn.registry_violations(rows, checks).select("id", "rule").unionAll(twice)


def _weight(x: Column) -> Column:
    return F.floor(F.abs(x.cast("double")) * 100000)


def images(v: Views) -> DataFrame:
    """Each vector's 64 values as the eight by eight pixels of an image of four channels, as Spark's image source gives files; some stand apart from two clear columns."""
    byte = lambda x: F.lpad(F.hex(x % 256), 2, "0")

    def pixel(x: Column, k: Column) -> Column:
        m = _weight(x)
        alpha = F.when((F.col("vec_id") % 4 == 0) & (k % 8).isin(0, 7), 0).when(m % 11 == 0, 20).otherwise(255)
        return F.concat(byte(m), byte(F.floor(m / 7)), byte(F.floor(m / 49)), byte(alpha))

    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    tasks = max(v.spark.sparkContext.defaultParallelism, int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = v.embeddings.repartition(tasks, "vec_id")  # a vector is a few bytes of its file and an image's worth of work
    return rows.select(F.col("vec_id").alias("image_id"), F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(4).alias("nChannels"), data.alias("data")).alias("image"))


BYTES = (
    "bytes",
    """SELECT *, m // 49 % 256 AS r, m // 7 % 256 AS g, m % 256 AS b, CASE WHEN image_id % 4 = 0 AND x IN (0, 7) THEN 0 WHEN m % 11 = 0 THEN 20 ELSE 255 END AS alpha FROM (
SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, CAST(floor(abs(CAST(embedding[p + 1] AS DOUBLE)) * 100000) AS BIGINT) AS m FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings))""",
)
PIXELS = (
    "pixels",
    "SELECT image_id, y - top AS y, x - lft AS x, r, g, b FROM (SELECT *, min(y) FILTER (alpha > 0) OVER w AS top, min(x) FILTER (alpha > 0) OVER w AS lft FROM bytes WINDOW w AS (PARTITION BY image_id)) WHERE alpha >= 32",
)


@query("src08_pixel_table", "SELECT image_id, y, x, r, g, b FROM pixels", extra=(BYTES, PIXELS))
def pixel_table(v: Views) -> DataFrame:
    return files.pixels(images(v)).select("image_id", *long("y", "x", "r", "g", "b"))


@query(
    "jn09_colour_truth_scopes",
    """SELECT 'pixel_absent' AS scope, CAST(c.id AS VARCHAR) AS id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM pixels p WHERE p.image_id = c.image_id AND p.r = c.r AND p.g = c.g AND p.b = c.b)
UNION ALL SELECT 'candidate_colour_unclaimed', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT 'representative_missing', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 4 = 1""",
    extra=(BYTES, PIXELS, ("claims", "SELECT image_id AS id, image_id, r, (g + CASE WHEN image_id % 5 = 0 THEN 1 ELSE 0 END) % 256 AS g, b FROM bytes WHERE y = 0 AND x = 0")),
)
def colour_truth_scopes(v: Views) -> DataFrame:
    """Each vector claims its image's first pixel, which may be clear, some with another green; candidates with foreign colours or representatives."""
    k, m = F.col("vec_id"), _weight(F.get("embedding", F.lit(0)))
    r, b = F.floor(m / 49) % 256, m % 256
    green = (F.floor(m / 7) + (k % 5 == 0).cast("long")) % 256
    claims = v.embeddings.select(k.alias("id"), k.alias("candidate"), k.alias("image_id"), r.alias("r"), green.alias("g"), b.alias("b"))
    candidates = v.embeddings.select(k.alias("candidate"), r.alias("r"), F.when(k % 3 == 0, (green + 7) % 256).otherwise(green).alias("g"), b.alias("b"), F.when(k % 4 == 1, -k).otherwise(k).alias("representative"))
    return ev.colour_truth(claims, files.pixels(images(v)), candidates)


@query("alg01_image_palette")
def image_palette(v: Views) -> DataFrame:
    """The palette of each vector's image, near colours merged."""
    out = palette.palettes(images(v))
    return out.select("image_id", *long("swatch_no"), *long("r", "g", "b", "n", "swatches"), *r6("share", "adjusted_share", "salience", "component_share", "coverage", "border_share"), "structural")


@query(
    "alg01_image_palette_faults",
    """SELECT 'images' AS what, count(DISTINCT image_id) AS n FROM pixels UNION ALL SELECT 'pixels', count(*) FROM pixels
UNION ALL SELECT unnest(['foreign_colours', 'one_colour_twice', 'out_of_rank']), 0""",
    extra=(BYTES, PIXELS),
)
def image_palette_faults(v: Views) -> DataFrame:
    """What must hold of palettes: every image with pixels has one, its colours are pixels of it and different, they share out all its pixels and are ranked."""
    rows = v.kept("palette_rows", lambda: palette.palettes(images(v)).withColumn("rank", ev.palette_rank()))
    seen = files.pixels(images(v)).select("image_id", *long("r", "g", "b")).distinct()
    foreign = rows.select("image_id", *long("r", "g", "b")).join(seen, ["image_id", "r", "g", "b"], "left_anti")
    after = F.lag("rank").over(Window.partitionBy("image_id").orderBy("swatch_no"))  # a palette's rows
    counts = {
        "images": rows.select("image_id").distinct().agg(F.count("*").alias("n")),
        "pixels": rows.agg(F.sum("n").alias("n")),
        "foreign_colours": foreign.agg(F.count("*").alias("n")),
        "one_colour_twice": rows.groupBy("image_id", "r", "g", "b").count().where("count > 1").agg(F.count("*").alias("n")),
        "out_of_rank": rows.withColumn("after", after).agg(F.count_if(F.col("after") < F.col("rank") - 1e-6).alias("n")),
    }
    out = None
    for what, n in counts.items():
        row = n.select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.unionAll(row)
    return out


_CARD = """CASE page_id % 6 WHEN 0 THEN '<p>Opens January 5, 2024</p>' WHEN 1 THEN '<p>March 3 – April 7, 2024</p>' WHEN 2 THEN '<p>3 Feb 2024 and 4 Feb 2024</p>' WHEN 3 THEN '<p>Dec 9, 2023 - Jan 2, 2022</p>' WHEN 4 THEN '<p>soon</p>' ELSE '<p>May 1st, 2024</p>' END"""


@query(
    "alg10_visible_dates",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'multiple_items' WHEN page_id % 6 IN (0, 1, 5) THEN 'explicit' WHEN page_id % 6 IN (2, 3) THEN 'ambiguous' ELSE 'missing' END AS status,
 CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 6 = 1 THEN 'visible_event_range' WHEN page_id % 6 IN (0, 5) THEN 'visible_full_date' END AS method,
 CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 6 = 0 THEN '2024-01-05' WHEN page_id % 6 = 1 THEN '2024-03-03' WHEN page_id % 6 = 5 THEN '2024-05-01' END AS published_at,
 CASE WHEN page_id % 7 <> 0 AND page_id % 6 = 1 THEN '2024-04-07' END AS event_end FROM pages""",
)
def visible_dates(v: Views) -> DataFrame:
    """Pages as cards with a date written in their text."""
    k = F.col("page_id")
    links = F.when(k % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    cards = v.pages.select("page_id", F.concat("html", F.expr(_CARD)).alias("html"), links.alias("links"), (k % 6).isin(1, 3).alias("exhibition"))
    return pg.visible_evidence(cards).select("page_id", "status", "method", *text("published_at", "event_end"))


#: Markup put into pages: cards, or (from 2 to 7 and 11) into the page itself: its head, its article or its end.
_CASES = {
    0: '<article><a href="/work/one"><img></a><time datetime="{day}">x</time></article>',
    1: '<article><a href="/work/one"></a><time datetime="{day}">x</time></article><article><a href="/work/two"></a></article>',
    2: "<time class='entry updated' datetime='{day}'>{day}</time><span itemprop=\"dateModified\" content=\"{day}\">x</span>",
    3: '<footer><time datetime="{day}">x</time></footer>',
    4: "<meta content='{day}T09:20:00Z' property='article:published_time'>",
    5: '<script type="application/ld+json">{{"@type": "Article", "url": "{url}/other", "datePublished": "{day}"}}</script>',
    6: '<script type="application/ld+json">{{"@graph": [{{"@type": "Person"}}, {{"@type": ["NewsArticle"], "mainEntityOfPage": {{"@id": "{url}"}}, "datePublished": "{day}"}}]}}</script>',
    7: '<script type="application/ld+json">{{"@type": "Product", "url": "{url}", "datePublished": "{day}"}}</script>',
    8: "<article>Apr 23\u2013Nov 1, 2026 at the hall</article>",
    9: "<article>Dec 1\u2013Jan 5, 2026 at the hall</article>",
    10: "<div><meta content={day} itemprop=startDate><b itemprop='endDate'>2024-03-05</b></div>",
    11: '<i itemprop="datePublished" content="{day}"></i><i content="2024-02-02T10:00" itemprop="datePublished"></i>',
    12: '<p>Seen on <b>9th Sept.</b> 2024, 1880\u20131950, <span class="modified">June 1, 2024</span></p>',
}


@query(
    "alg10_dated_items",
    """SELECT page_id, CASE WHEN k IN (0, 4, 6, 8, 10, 12) THEN 'explicit' WHEN k = 1 THEN 'multiple_items' WHEN k = 9 OR k = 11 AND one THEN 'ambiguous' ELSE 'missing' END AS date_status,
 CASE WHEN k = 8 THEN 'exhibition' WHEN k IN (0, 4, 6, 10, 12) THEN 'publication' ELSE 'undated' END AS kind, CASE WHEN k BETWEEN 2 AND 7 OR k = 11 THEN 'detail' ELSE 'card' END AS scope,
 CASE WHEN k IN (0, 4, 6, 10) THEN '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') WHEN k = 8 THEN '2026-04-23' WHEN k = 12 THEN '2024-09-09' END AS published_at, CASE k WHEN 8 THEN '2026-11-01' WHEN 10 THEN '2024-03-05' END AS event_end,
 CASE WHEN k IN (0, 4, 6, 8, 9, 10, 12) OR k = 11 AND one THEN CASE k WHEN 0 THEN 'time:datetime' WHEN 4 THEN 'publication_meta' WHEN 6 THEN 'jsonld:datePublished' WHEN 10 THEN 'itemprop:endDate,itemprop:startDate' WHEN 11 THEN 'itemprop:datePublished' WHEN 12 THEN 'visible_full_date' ELSE 'visible_event_range' END ELSE '' END AS methods
FROM (SELECT page_id, page_id % 13 AS k, len(regexp_extract_all(html, '<article>')) = 1 AS one FROM pages)""",
)
def dated_items(v: Views) -> DataFrame:
    """Pages with a date marked up in thirteen ways, some of which date the item, and cards of listings."""
    k, url = F.col("page_id") % 13, F.col("url")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"))
    plain = urls.normalized_url(url)

    def filled(text: str) -> Column:
        out = F.lit(text.replace("{{", "{").replace("}}", "}") if "{{" in text else text)
        return F.replace(F.replace(out, F.lit("{day}"), day), F.lit("{url}"), plain)

    made = None
    for n, said in _CASES.items():
        case = filled(said)
        page = F.concat("html", case) if n == 3 else F.concat(case, F.col("html")) if n in (4, 5, 6, 7) else F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), case)) if n in (2, 11) else case
        made = F.when(k == n, page) if made is None else made.when(k == n, page)
    pages = v.pages.select("page_id", "url", made.alias("html"), F.when(k.isin(8, 9), "newly_exhibited").otherwise("").alias("event_type"), (k.between(2, 7) | (k == 11)).alias("detail"))
    return pg.dated_items(pages).select("page_id", "date_status", "kind", "scope", *text("published_at", "event_end"), F.array_join("methods", ",").alias("methods"))


@query(
    "prj20_snapshot_proof",
    """SELECT conv_id, coalesce(conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND conv_id % 6 <> 4 AND count(*) >= 3 AND min(turn + 1) >= 1 AND max(turn + 1) <= 200 AND count(DISTINCT turn) = count(*) AND bool_and(conv_id % 8 <> 3 OR turn <> 0), FALSE) AS "current"
FROM conversations GROUP BY conv_id""",
)
def snapshot_proof(v: Views) -> DataFrame:
    """Conversations as chart snapshots: pages not opted in, proofs of other times or days, bad digests, items at other hosts."""
    k = F.col("conv_id")
    host = F.when((k % 8 == 3) & (F.col("turn") == 0), "https://elsewhere.org").otherwise("https://e.org")
    item = F.struct((F.col("turn") + 1).alias("rank"), F.concat(host, F.lit("/item/"), F.col("turn").cast("string")).alias("url"))
    rows = v.conversations.groupBy("conv_id").agg(F.collect_list(item).alias("items"))  # a conversation's turns
    at = F.when(k % 7 == 0, "2024-05-02T03:59:00Z").otherwise("2024-05-02T04:01:00Z")
    page = F.when(k % 5 == 0, "https://e.org/other").otherwise("HTTPS://E.org/chart/?week=1")
    proof = rows.select("conv_id", "items", page.alias("page_url"), page.alias("source_url"), at.alias("captured_at"), F.when(k % 11 == 0, "2024-05-02T05:00:00Z").otherwise(at).alias("observed_at"), F.when(k % 6 == 4, "abc").otherwise(F.sha2(k.cast("string").cast("binary"), 256)).alias("digest"))
    return pg.snapshot_current(proof, ["https://E.ORG/chart?all"], ["/item/"], "2024-05-02", "America/New_York").select("conv_id", "current")


_PARTS = (("swatches", "SELECT *, p_partkey % 256 AS r, p_size AS g, 7 AS b FROM part"), *sql_colors()[:3])


@query(
    "udx01_sql_functions",
    "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, hex, round(sqrt(power(p_size / 100.0, 2) + 0.25), 6) AS distance, round(ll, 6) AS l, round(la, 6) AS a, round(lb, 6) AS b, CAST(bit_count(xor(p_partkey, CAST(p_size AS BIGINT))) AS BIGINT) AS bits FROM lab_",
    extra=_PARTS,
)
def sql_functions(v: Views) -> DataFrame:
    """The SQL functions of this library, from SQL."""
    functions.register(v.spark)
    return v.spark.sql(
        """SELECT p_partkey, slug(p_name) AS slug, hex, round(colour_distance(0D, 0D, 0D, p_size / 100D, 0.5D, 0D), 6) AS distance, round(lab.l, 6) AS l, round(lab.a, 6) AS a, round(lab.b, 6) AS b,
        CAST(hash_distance(lower(hex(p_partkey)), lower(hex(p_size))) AS BIGINT) AS bits FROM (SELECT *, hex_to_oklab(hex) AS lab FROM (SELECT *, hex_of(p_partkey % 256, p_size, 7) AS hex FROM {part}))""",
        part=v.part,
    )


_NEAR = "sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb - b.lb) * (a.lb - b.lb))"


@query(
    "udx04_sql_neighbours",
    f"SELECT a.hex AS a, b.hex AS b, round({_NEAR}, 6) AS distance FROM (SELECT DISTINCT hex, ll, la, lb FROM lab_) a JOIN (SELECT DISTINCT hex, ll, la, lb FROM lab_) b ON a.hex < b.hex AND {_NEAR} <= 0.02",
    extra=_PARTS,
)
def sql_neighbours(v: Views) -> DataFrame:
    """Near colours of parts from SQL alone: the table function gives a point's 27 cells, which meet points at home in them."""
    functions.register(v.spark)
    colours = v.spark.sql("SELECT hex, hex_to_oklab(hex) AS p FROM (SELECT DISTINCT hex_of(p_partkey % 256, p_size, 7) AS hex FROM {part})", part=v.part)
    return v.spark.sql(
        """SELECT a, b, round(distance, 6) AS distance FROM (SELECT a.hex AS a, b.hex AS b, colour_distance(a.p.l, a.p.a, a.p.b, b.p.l, b.p.a, b.p.b) AS distance
        FROM (SELECT c.hex, c.p, n.cx, n.cy, n.cz FROM {colours} c, LATERAL explode_neighbours(c.p.l, c.p.a, c.p.b, 0.02D) n) a
        JOIN {colours} b ON CAST(floor(b.p.l / 0.02D) AS BIGINT) = a.cx AND CAST(floor(b.p.a / 0.02D) AS BIGINT) = a.cy AND CAST(floor(b.p.b / 0.02D) AS BIGINT) = a.cz AND a.hex < b.hex) WHERE distance <= 0.02D""",
        colours=colours,
    )
