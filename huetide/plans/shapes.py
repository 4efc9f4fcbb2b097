"""Queries over grids, boxes, hashes and colour distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions.color import distance
from huetide.operators import evidence as ev
from huetide.operators import graph as g
from huetide.plans.catalog import BEST, COLORS, POINTS, long, query, r6, text
from huetide.plans.evidence import best, points
from huetide.sources.fixtures import Views

MASK = ("cells", "SELECT image_id, y, x FROM patches WHERE v > 0.05")
LABELS = (
    "labels_",
    """SELECT a, min(b) AS component FROM (WITH RECURSIVE reach(image_id, a, b, y, x) AS (SELECT image_id, image_id * 4096 + y * 64 + x, image_id * 4096 + y * 64 + x, y, x FROM cells
 UNION SELECT c.image_id, r.a, c.image_id * 4096 + c.y * 64 + c.x, c.y, c.x FROM reach r JOIN cells c ON c.image_id = r.image_id AND abs(c.y - r.y) + abs(c.x - r.x) = 1) SELECT a, b FROM reach) GROUP BY a""",
)


def mask(v: Views) -> DataFrame:
    return v.patches.where("v > 0.05").select(*long("image_id", "y", "x"))


@query("alg02_components", "SELECT a // 4096 AS image_id, component, count(*) AS cells FROM labels_ GROUP BY ALL", views=("patches",), extra=(MASK, LABELS))
def mask_components(v: Views) -> DataFrame:
    return g.mask_components(mask(v)).groupBy("image_id", "component").agg(F.count("*").alias("cells"))


@query(
    "agg23_mask_geometry",
    """SELECT image_id, round(max(n) / 64, 6) AS component_share, CAST(sum(n) AS BIGINT) AS cells, round(any_value(coverage), 6) AS coverage, round(any_value(border), 6) AS border_share FROM (SELECT a // 4096 AS image_id, component, count(*) AS n FROM labels_ GROUP BY ALL)
JOIN (SELECT image_id, count(*) FILTER (n >= 3) / 16 AS coverage FROM (SELECT image_id, y // 2 AS r, x // 2 AS c, count(*) AS n FROM cells GROUP BY ALL) GROUP BY image_id) USING (image_id)
JOIN (SELECT image_id, count(*) FILTER (y IN (0, 7) OR x IN (0, 7)) / 28 AS border FROM cells GROUP BY image_id) USING (image_id) GROUP BY image_id""",
    views=("patches",),
    extra=(MASK, LABELS),
)
def mask_geometry(v: Views) -> DataFrame:
    return g.geometry(mask(v), 8).select("image_id", *r6("component_share", "coverage", "border_share"), "cells")


#: Grey of a patch: noise, one tone, near-white, or a faint noise, by image.
GREY = "CASE image_id % 5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.99 WHEN 3 THEN 0.5 + CAST(v AS DOUBLE) / 50 ELSE greatest(0.0, least(1.0, 0.5 + 2 * CAST(v AS DOUBLE))) END"
METRICS = (
    "metrics",
    f"""SELECT image_id, 0.0 - sum(n / 64 * log2(n / 64)) / 6 AS entropy, sum(white) / 64 AS near_white, sum(black) / 64 AS near_black, any_value(spread) AS spread, any_value(edge_density) AS edge_density FROM (SELECT image_id, least(floor({GREY} * 64), 63) AS bin, count(*) AS n, count(*) FILTER ({GREY} > 0.97) AS white, count(*) FILTER ({GREY} < 0.03) AS black
FROM patches GROUP BY ALL) JOIN (SELECT image_id, stddev_pop({GREY}) AS spread FROM patches GROUP BY image_id) USING (image_id)
JOIN (SELECT a.image_id, count(*) FILTER (n = 9 AND 9 * g - box > 0.12 + 1e-9) / 64 AS edge_density FROM (SELECT a.image_id, a.y, a.x, any_value(a.g) AS g, count(*) AS n, sum(b.g) AS box FROM (SELECT image_id, y, x, {GREY} AS g FROM patches) a
 JOIN (SELECT image_id, y, x, {GREY} AS g FROM patches) b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) a GROUP BY a.image_id) USING (image_id) GROUP BY image_id""",
)


def metrics(v: Views) -> DataFrame:
    return g.image_metrics(v.patches, F.expr(GREY))


@query("agg13_image_metrics", "SELECT image_id, round(entropy, 6) AS entropy, round(edge_density, 6) AS edge_density, round(near_white, 6) AS near_white, round(near_black, 6) AS near_black, round(spread, 6) AS spread FROM metrics", views=("patches",), extra=(METRICS,))
def image_metrics(v: Views) -> DataFrame:
    return metrics(v).select("image_id", *r6("entropy", "edge_density", "near_white", "near_black", "spread"))


@query(
    "prj12_image_rejection",
    """SELECT image_id, CASE WHEN w < 280 OR h < 180 THEN 'region_too_small' WHEN h / w < 0.10 OR w / h < 0.10 THEN 'loading_strip_or_sliver' WHEN near_white > 0.985 OR near_black > 0.985 THEN 'nearly_blank_region'
 WHEN entropy < 0.06 AND edge_density < 0.015 THEN 'low_information_placeholder' WHEN spread < 0.008 AND edge_density < 0.01 THEN 'flat_placeholder' ELSE '' END AS reason FROM (SELECT *, 240 + image_id % 9 * 1000 AS w, 179 + image_id % 11 * 40 AS h FROM metrics)""",
    views=("patches",),
    extra=(METRICS,),
)
def image_rejection(v: Views) -> DataFrame:
    k = F.col("image_id")
    return metrics(v).select("image_id", g.rejection(240 + k % 9 * 1000, 179 + k % 11 * 40).alias("reason"))


HASH = (
    "hashes",
    "SELECT image_id, CAST(sum(CASE WHEN v > l THEN CAST(1 AS BIGINT) << CAST(55 - (y * 7 + x - 1) AS INT) ELSE 0 END) AS BIGINT) AS dhash FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS l FROM patches) WHERE x > 0 GROUP BY image_id",
)


@query("alg09_difference_hash", "SELECT * FROM hashes", views=("patches",), extra=(HASH,))
def difference_hash(v: Views) -> DataFrame:
    return g.difference_hash(v.patches)


def hash_conflicts(v: Views) -> DataFrame:
    """Pairs of hashes within 16 bits."""
    return g.hash_pairs(g.difference_hash(v.patches).withColumnRenamed("image_id", "id"), [], 16)


@query("scl03_hash_distance", "SELECT a.image_id AS a, b.image_id AS b, CAST(bit_count(xor(a.dhash, b.dhash)) AS BIGINT) AS bits FROM hashes a JOIN hashes b ON a.image_id < b.image_id WHERE bit_count(xor(a.dhash, b.dhash)) <= 16", views=("patches",), extra=(HASH,))
def hash_distance(v: Views) -> DataFrame:
    h = g.difference_hash(v.patches)
    pairs = hash_conflicts(v).join(h.select(F.col("image_id").alias("a"), F.col("dhash").alias("ha")), "a").join(h.select(F.col("image_id").alias("b"), F.col("dhash").alias("hb")), "b")
    return pairs.select("a", "b", g.hamming(F.col("ha"), F.col("hb")).cast("long").alias("bits"))


#: What the SQL says of a suppression: no kept conflict, no rejected row without a kept better one.
NO_FAULTS = "SELECT CAST(0 AS BIGINT) AS kept_conflicts, CAST(0 AS BIGINT) AS unwitnessed"


def ranked_images(v: Views) -> DataFrame:
    hashes = g.difference_hash(v.patches).select(F.col("image_id").alias("id"), F.col("dhash").alias("p"))
    return v.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("rank")).join(hashes, "id", "left")


def same_hash():
    """Whether hashes p and q are one, as in ``hash_conflicts``."""
    return g.hamming(F.col("p"), F.col("q")) <= 16


@query("alg08_hash_suppression")
def hash_suppression(v: Views) -> DataFrame:
    return g.suppress_near(ranked_images(v), [], same_hash()).select(F.col("id").alias("image_id"))


@query("alg08_hash_suppression_violations", NO_FAULTS)
def hash_violations(v: Views) -> DataFrame:
    return g.suppression_faults_near(ranked_images(v), [], same_hash())


def box_conflicts(v: Views) -> DataFrame:
    """Pairs of boxes of a page that overlap by 0.80 or 0.90, as rounded: a grid of 1100 x 700, so boxes that touch share a cell."""
    box = v.boxes.select("page", F.col("box_id").alias("id"), F.struct("x", "y", "w", "h").alias("box"))
    return g.box_pairs(box, ["page"], (1100, 700), least=(0.80, 0.90), places=6)


_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


@query(
    "scl08_box_overlap",
    f"SELECT * FROM (SELECT a.box_id AS a, b.box_id AS b, round({_OVER} / (a.w * a.h + b.w * b.h - {_OVER}), 6) AS iou, round({_OVER} / least(a.w * a.h, b.w * b.h), 6) AS inside FROM boxes a JOIN boxes b ON a.page = b.page AND a.box_id < b.box_id) WHERE iou >= 0.80 OR inside >= 0.90",
    views=("boxes",),
)
def box_overlap(v: Views) -> DataFrame:
    return box_conflicts(v)


_TEXT = "(length(text) / greatest(1.0, w * h / 1000.0))"
#: Phrases of overlays.
WORDS = ["cookie", "privacy preferences", "privacy notice", "accept all", "reject all", "manage consent", "verification", "verify you are human", "press and hold", "access denied", "enable javascript", "sign in", "log in",
         "subscribe", "newsletter", "special offer", "limited time offer", "choose your location", "select your region"]
_OVERLAY = f"(length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) < 1800 AND regexp_matches(regexp_replace(lower(text), '\\s+', ' ', 'g'), '{'|'.join(WORDS)}'))"


def overlay(column: str = "text"):
    plain = F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))
    return (F.length(plain) < 1800) & plain.rlike("|".join(WORDS))


@query(
    "prj11_overlay_text",
    f"""SELECT 'documents' AS kind, doc_id AS id FROM documents WHERE {_OVERLAY} UNION ALL SELECT 'pages', page_id FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages) WHERE {_OVERLAY}
UNION ALL SELECT 'spliced', doc_id FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 < 2 THEN ' Press  AND hold' ELSE '' END AS text FROM documents) WHERE {_OVERLAY}""",
)
def overlay_text(v: Views) -> DataFrame:
    """Documents, pages, and documents with a phrase spliced into some."""
    pages = v.pages.select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    spliced = v.documents.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 5 < 2, " Press  AND hold").otherwise("")).alias("text"))
    found = lambda rows, kind, id_: rows.where(overlay()).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"))
    return found(v.documents, "documents", "doc_id").unionAll(found(pages, "pages", "page_id")).unionAll(found(spliced, "spliced", "doc_id"))


BOX = (
    "scored_boxes",
    f"SELECT *, w * h / 1296000.0 AS area_ratio, 0.35 + least(w * h / 1296000.0, 0.6) * 0.45 + least(image_ratio, 1.0) * 0.30 - least({_TEXT} / 18, 0.25) - CASE WHEN {_OVERLAY} THEN 0.8 ELSE 0 END AS confidence FROM boxes WHERE w >= 280 AND h >= 180",
)


def scored_boxes(v: Views) -> DataFrame:
    area = F.col("w") * F.col("h") / 1296000.0
    density = F.length("text") / F.greatest(F.lit(1.0), F.col("w") * F.col("h") / 1000.0)
    confidence = 0.35 + F.least(area, F.lit(0.6)) * 0.45 + F.least(F.col("image_ratio"), F.lit(1.0)) * 0.30 - F.least(density / 18, F.lit(0.25)) - F.when(overlay(), 0.8).otherwise(0.0)
    return v.boxes.where("w >= 280 and h >= 180").withColumns({"area_ratio": area, "confidence": confidence}).where(F.col("area_ratio").between(0.04, 1.25) & (F.col("confidence") >= 0.5))


@query("prj13_region_confidence", "SELECT box_id, round(area_ratio, 6) AS area_ratio, round(least(1, confidence), 6) AS confidence FROM scored_boxes WHERE area_ratio BETWEEN 0.04 AND 1.25 AND confidence >= 0.5", views=("boxes",), extra=(BOX,))
def region_confidence(v: Views) -> DataFrame:
    return scored_boxes(v).select("box_id", *r6("area_ratio"), F.round(F.least(F.lit(1.0), "confidence"), 6).alias("confidence"))


def same_box():
    """Whether boxes p and q of a page are one, as in ``box_conflicts`` but for its rounding."""
    iou, inside = g.overlap("p", "q")
    return (iou >= 0.80) | (inside >= 0.90)


def ranked_boxes(v: Views) -> DataFrame:
    return scored_boxes(v).select(F.col("box_id").alias("id"), (-F.round("confidence", 9)).alias("rank"), "page", F.struct("x", "y", "w", "h").alias("p"))


@query("alg08_box_suppression")
def box_suppression(v: Views) -> DataFrame:
    return g.suppress_near(ranked_boxes(v), ["page"], same_box()).select(F.col("id").alias("box_id"))


@query("alg08_box_suppression_violations", NO_FAULTS)
def box_violations(v: Views) -> DataFrame:
    return g.suppression_faults_near(ranked_boxes(v), ["page"], same_box())


#: Regions: boxes on a coarser raster, with the hash of one of 17 pictures, a bit of it changed in one of 13 ways.
_COARSE = ", ".join(f"{c} - {c} % {step} AS {c}" for c, step in (("x", 550), ("y", 450), ("w", 140), ("h", 90)))
_BIT = "(box_id // 20 % 17) * 4222124650659841"
REGIONS = ("regions", f"SELECT page, box_id, {_COARSE}, xor({_BIT}, CAST(1 AS BIGINT) << CAST(box_id % 13 AS INT)) AS dhash FROM boxes")


def regions(v: Views) -> DataFrame:
    rows = v.boxes.selectExpr("page", "box_id AS id", *_COARSE.split(", "), f"({_BIT.replace('//', 'div')}) ^ shiftleft(1L, CAST(box_id % 13 AS INT)) AS dhash", "struct(-image_ratio AS r, box_id AS i) AS rank")
    return rows.select("page", "id", F.struct("x", "y", "w", "h").alias("box"), "dhash", "rank").withColumn("p", F.struct("box", "dhash"))


@query(
    "alg08_region_conflicts",
    f"SELECT a.box_id AS a, b.box_id AS b FROM regions a JOIN regions b ON a.page = b.page AND a.box_id < b.box_id WHERE {_OVER} / (a.w * a.h + b.w * b.h - {_OVER}) >= 0.82 OR bit_count(xor(a.dhash, b.dhash)) <= 8",
    views=("boxes",),
    extra=(REGIONS,),
)
def region_conflicts(v: Views) -> DataFrame:
    """Regions of a page that show the same, by overlap or by hash."""
    return g.region_conflicts(regions(v), ["page"])


@query("alg08_region_suppression")
def region_suppression(v: Views) -> DataFrame:
    return g.suppress_near(regions(v), ["page"], g.same_region()).select(F.col("id").alias("box_id"))


@query("alg08_region_suppression_violations", NO_FAULTS)
def region_violations(v: Views) -> DataFrame:
    return g.suppression_faults_near(regions(v), ["page"], g.same_region())


@query(
    "alg08_image_conflicts",
    "SELECT a.image_id AS a, b.image_id AS b FROM hashes a JOIN hashes b ON a.image_id < b.image_id WHERE bit_count(xor(a.dhash, b.dhash)) <= 6 UNION SELECT m, image_id FROM (SELECT image_id, min(image_id) OVER (PARTITION BY image_id // 3) AS m FROM hashes) WHERE m < image_id",
    views=("patches",),
    extra=(HASH,),
)
def image_conflicts(v: Views) -> DataFrame:
    """Images that are one, by nearly equal hashes or equal content (given: three in a row have one)."""
    rows = g.difference_hash(v.patches).select(F.col("image_id").alias("id"), "dhash", F.floor(F.col("image_id") / 3).alias("content"))
    return g.image_conflicts(rows)


# colours: pairs within a limit
MONTH = "1995-06-01"
_D = "sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb - b.lb) * (a.lb - b.lb))"


def month_points(v: Views) -> DataFrame:
    return points(v).where("current_eligible").select("day", "actor", "hex", "family", "strength", "chroma", "ll", "la", "lb", (F.col("image_id") * 64 + F.col("swatch_no")).alias("id"))


@query(
    "jn03_colour_distance_join",
    f"SELECT CAST(a.day AS VARCHAR) AS day, count(*) AS pairs, round(avg({_D}), 6) AS mean_distance FROM points a JOIN points b ON a.day = b.day AND a.image_id * 64 + a.swatch_no < b.image_id * 64 + b.swatch_no AND a.current_eligible AND b.current_eligible AND {_D} <= 0.045 GROUP BY a.day",
    on=POINTS,
)
def colour_distance(v: Views) -> DataFrame:
    return g.pair_statistics(month_points(v), ["day"], "hex", 0.045).select(*text("day"), "pairs", *r6("mean_distance"))


def distinct_colours(v: Views) -> DataFrame:
    """Each month's candidate colours: best rows by hex with their votes; ids are ranks by votes."""
    rows = best(v).groupBy("day", "hex").agg(F.count("*").alias("votes"), F.first("ll").alias("ll"), F.first("la").alias("la"), F.first("lb").alias("lb"))
    return rows.select("day", "hex", "votes", "ll", "la", "lb", F.xxhash64("day", "hex").alias("id"))


def ranked_colours(v: Views) -> tuple[DataFrame, DataFrame]:
    rows = g.settled(distinct_colours(v).withColumn("rank", F.struct(-F.col("votes"), F.col("hex"))))
    return rows, g.near_pairs(rows, ["day"], 0.04).where("distance < 0.04")


@query("alg08_colour_suppression_violations", NO_FAULTS)
def colour_violations(v: Views) -> DataFrame:
    return g.suppression_faults(*ranked_colours(v))


def kept_colours(v: Views) -> DataFrame:
    return g.suppress(*ranked_colours(v))


@query("alg08_colour_suppression")
def colour_suppression(v: Views) -> DataFrame:
    return kept_colours(v).select(*text("day"), "hex", "votes")


@query(
    "alg12_proof_mask",
    "SELECT image_id, round(count(*) FILTER (sqrt((ll - 0.6) * (ll - 0.6) + la * la + lb * lb) <= 0.035) / count(*), 6) AS coverage FROM colors GROUP BY image_id",
    on=COLORS,
)
def proof_mask(v: Views) -> DataFrame:
    match = distance(("ll", "la", "lb"), (F.lit(0.6), F.lit(0.0), F.lit(0.0))) <= 0.035
    return v.colors.groupBy("image_id").agg(F.round(F.count_if(match) / F.count("*"), 6).alias("coverage"))


@query(
    "jn04_nearest_representative",
    """SELECT CAST(label AS BIGINT) AS label, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS p FROM (
SELECT e.label, e.vec_id, sqrt(sum((e.v - c.m) * (e.v - c.m))) AS d FROM (SELECT label, vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e
JOIN (SELECT label, k, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ALL) c ON c.label = e.label AND c.k = e.k GROUP BY ALL)) WHERE p = 1""",
)
def nearest_representative(v: Views) -> DataFrame:
    rows = v.embeddings.select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    means = rows.select("key", F.posexplode("vector").alias("k", "x")).groupBy("key", "k").agg(F.avg("x").alias("m")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
    return g.nearest_members(rows, means).select(F.col("key").alias("label"), F.col("id").alias("vec_id"), *r6("distance"))


@query(
    "jn08_admitted_evidence",
    """SELECT c.image_id, c.swatch_no FROM colors c WHERE c.current_eligible AND NOT EXISTS (SELECT 1 FROM colors a WHERE a.image_id = c.image_id AND a.hex = c.hex AND NOT a.structural AND (coalesce(a.adjusted_share, a.share) >= 0.055 OR a.salience >= 0.025) AND (a.component_share >= 0.006 OR a.coverage >= 0.125)
 AND a.share >= CASE WHEN a.chroma < 0.075 THEN 0.04 ELSE 0.02 END AND a.component_share >= CASE WHEN a.chroma < 0.075 THEN 0.01 ELSE 0.005 END)""",
    on=COLORS,
)
def admitted_evidence(v: Views) -> DataFrame:
    ok = v.colors.where(ev.substantial()).select("image_id", "hex")
    return v.colors.where("current_eligible").join(ok, ["image_id", "hex"], "left_anti").select("image_id", "swatch_no")


@query(
    "jn09_colour_truth",
    "SELECT 'best' AS kind, count(*) AS claims, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = b.image_id AND (l.l_partkey * 37) % 256 = CAST('0x' || substr(b.hex, 2, 2) AS INT))) AS absent FROM best b",
    on=BEST,
)
def colour_truth(v: Views) -> DataFrame:
    """Claimed colours whose red channel no pixel of their image has."""
    claims = best(v).select("image_id", "swatch_no", F.conv(F.substring("hex", 2, 2), 16, 10).cast("long").alias("red"))
    pixels = v.lineitem.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 37 % 256).alias("red"), F.lit(True).alias("seen")).distinct()
    return claims.join(pixels, ["image_id", "red"], "left").agg(F.count("*").alias("claims"), F.count_if(F.col("seen").isNull()).alias("absent")).select(F.lit("best").alias("kind"), "claims", "absent")
