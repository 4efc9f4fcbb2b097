"""Queries over swatches and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huetide.functions import color
from huetide.operators import evidence as ev
from huetide.plans.catalog import BEST, CAND, COLORS, POINTS, long, query, r6, text
from huetide.sources.fixtures import Views

BY = ["day", "family"]
KEY = "image_id, swatch_no"


def points(v: Views) -> DataFrame:
    return ev.admitted(v.colors, v.panel)


#: The registry's kinds of domains and platforms.
KINDS = {"domain": range(12), "platform": range(8)}


def best(v: Views) -> DataFrame:
    # kept in memory: a row an actor, family and month, which one query reads several times
    return v.kept("best", lambda: ev.best_per_actor(points(v).where("current_eligible"), BY))


def cand(v: Views) -> DataFrame:
    # kept likewise: a row a family and month, which scores, gates and ties read
    return v.kept("cand", lambda: ev.swatch_summary(best(v), BY, KINDS))


@query(
    "prj01_colour_dimension",
    """SELECT DISTINCT hex, round(ll, 6) AS ll, round(la, 6) AS la, round(lb, 6) AS lb, round(chroma, 6) AS chroma, round(hue, 4) AS hue, neutral, family,
 hue < 135 OR hue >= 315 AS warm, round(0.2126 * lr + 0.7152 * lg + 0.0722 * lbl, 6) AS luminance,
 CASE WHEN (greatest(0.2126 * lr + 0.7152 * lg + 0.0722 * lbl, 0.0056054) + 0.05) / (least(0.2126 * lr + 0.7152 * lg + 0.0722 * lbl, 0.0056054) + 0.05)
  >= 1.05 / (0.2126 * lr + 0.7152 * lg + 0.0722 * lbl + 0.05) THEN '#111111' ELSE '#FFFFFF' END AS text_color FROM colors""",
    on=COLORS,
)
def colour_dimension(v: Views) -> DataFrame:
    d = color.dimension(v.palette).withColumn("luminance", color.luminance("r", "g", "b"))
    return d.select("hex", *r6("ll", "la", "lb", "chroma"), F.round("hue", 4).alias("hue"), "neutral", "family", color.is_warm("hue").alias("warm"), color.readable_text(F.col("luminance")).alias("text_color"), *r6("luminance"))


@query("prj02_swatch_eligibility", f"SELECT {KEY} FROM colors WHERE NOT structural AND (coalesce(adjusted_share, share) >= 0.055 OR salience >= 0.025) AND (component_share >= 0.006 OR coverage >= 0.125)", on=COLORS)
def swatch_eligibility(v: Views) -> DataFrame:
    return v.colors.where(ev.eligible()).select("image_id", "swatch_no")


@query(
    "prj03_substance_admission",
    """SELECT image_id, swatch_no FROM colors WHERE NOT structural AND (coalesce(adjusted_share, share) >= 0.055 OR salience >= 0.025) AND (component_share >= 0.006 OR coverage >= 0.125)
AND share >= CASE WHEN chroma < 0.075 THEN 0.04 ELSE 0.02 END AND component_share >= CASE WHEN chroma < 0.075 THEN 0.01 ELSE 0.005 END""",
    on=COLORS,
)
def substance_admission(v: Views) -> DataFrame:
    return v.colors.where(ev.substantial()).select("image_id", "swatch_no")


@query(
    "prj04_swatch_strength",
    """SELECT image_id, swatch_no, round(greatest(0.001, (0.45 * coalesce(adjusted_share, share) + 0.25 * salience + 0.20 * component_share + 0.10 * coverage) * confidence), 6) AS strength,
round(0.50 * coalesce(adjusted_share, share) + 0.25 * salience + 0.15 * component_share + 0.10 * coverage, 6) AS palette_rank FROM swatches""",
    views=("swatches",),
)
def swatch_strength(v: Views) -> DataFrame:
    return v.swatches.select("image_id", "swatch_no", F.round(ev.strength(), 6).alias("strength"), F.round(ev.palette_rank(), 6).alias("palette_rank"))


@query(
    "prj05_structural_background",
    """SELECT image_id, swatch_no, structural, round(CASE WHEN structural THEN share * 0.12 ELSE share END, 6) AS adjusted FROM colors""",
    on=COLORS,
)
def structural_background(v: Views) -> DataFrame:
    return v.colors.select("image_id", "swatch_no", "structural", F.round(F.when(F.col("structural"), F.col("share") * 0.12).otherwise(F.col("share")), 6).alias("adjusted"))


@query(
    "prj06_semantic_status",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN adjusted_share IS NULL OR component_share IS NULL THEN 'unverified_region_substance'
 WHEN adjusted_share < CASE WHEN chroma < 0.075 THEN 0.04 ELSE 0.02 END THEN 'incidental_low_share'
 WHEN component_share < CASE WHEN chroma < 0.075 THEN 0.01 ELSE 0.005 END THEN 'incidental_fragmented' ELSE 'eligible' END AS status FROM colors) GROUP BY status""",
    on=COLORS,
)
def semantic_status(v: Views) -> DataFrame:
    return v.colors.groupBy(ev.semantic_status().alias("status")).agg(F.count("*").alias("n"))


@query(
    "win08_salience_normalisation",
    """SELECT image_id, swatch_no, round(CASE WHEN sum(salience) OVER w = 0 THEN 1 ELSE salience / sum(salience) OVER w END, 6) AS salience_share
FROM swatches WINDOW w AS (PARTITION BY image_id)""",
    views=("swatches",),
)
def salience_normalisation(v: Views) -> DataFrame:
    return ev.normalised(v.swatches).select("image_id", "swatch_no", *r6("salience_share"))


@query(
    "jn01_observation_registry",
    """SELECT p.domain, p.stage, p.scale, p.panel, count(*) AS images, count(DISTINCT i.actor) AS actors, round(avg(confidence), 6) AS confidence
FROM images i JOIN panel p ON p.actor = i.actor GROUP BY ALL""",
    views=("images", "panel"),
)
def observation_registry(v: Views) -> DataFrame:
    rows = v.images.join(F.broadcast(v.panel), "actor")  # 40 actors at most, by its grouping
    return rows.groupBy("domain", "stage", "scale", "panel").agg(F.count("*").alias("images"), F.count_distinct("actor").alias("actors"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("win01_best_per_actor", "SELECT CAST(day AS VARCHAR) AS day, family, actor, image_id, swatch_no, round(strength, 6) AS strength FROM best", on=BEST)
def best_rows(v: Views) -> DataFrame:
    return best(v).select(*text("day"), "family", "actor", "image_id", "swatch_no", *r6("strength"))


COUNTS = ["source_count", "domain_count", "sector_count", "stage_count", "scale_count", "benchmark_count", "discovery_count"]


@query(
    "agg04_evidence_rollup",
    f"SELECT CAST(day AS VARCHAR) AS day, family, {', '.join(COUNTS)}, round(evidence_quality, 6) AS evidence_quality, round(top_domain_weight, 6) AS top_domain_weight, round(top_platform_weight, 6) AS top_platform_weight FROM cand",
    on=CAND,
)
def rollup(v: Views) -> DataFrame:
    return cand(v).select(*text("day"), "family", *COUNTS, *r6("evidence_quality", "top_domain_weight", "top_platform_weight"))


@query("agg05_usage_score", "SELECT CAST(day AS VARCHAR) AS day, family, round(usage_score, 6) AS usage_score FROM cand", on=CAND)
def usage(v: Views) -> DataFrame:
    return cand(v).select(*text("day"), "family", *r6("usage_score"))


@query(
    "agg06_undercurrent_mainstream",
    "SELECT CAST(day AS VARCHAR) AS day, family, round(undercurrent_score, 6) AS undercurrent_score, round(mainstream_score, 6) AS mainstream_score, round(small_large, 6) AS small_large FROM cand",
    on=CAND,
)
def under_main(v: Views) -> DataFrame:
    return cand(v).select(*text("day"), "family", *r6("undercurrent_score", "mainstream_score", "small_large"))


@query(
    "agg11_signal_map",
    """SELECT dimension, value, actors, round(actors / total, 6) AS part, place FROM (SELECT *, sum(actors) OVER (PARTITION BY dimension) AS total,
 row_number() OVER (PARTITION BY dimension ORDER BY actors DESC, value) AS place FROM (
 SELECT dimension, value, count(DISTINCT actor) AS actors FROM (
  SELECT actor, 'domain' AS dimension, CAST(domain AS VARCHAR) AS value FROM best UNION ALL SELECT actor, 'sector', CAST(sector AS VARCHAR) FROM best
  UNION ALL SELECT actor, 'stage', CAST(stage AS VARCHAR) FROM best UNION ALL SELECT actor, 'scale', scale FROM best UNION ALL SELECT actor, 'panel', panel FROM best) GROUP BY ALL)) WHERE place <= 6""",
    on=BEST,
)
def signal_map(v: Views) -> DataFrame:
    return ev.signal_map(best(v), ["domain", "sector", "stage", "scale", "panel"]).select("dimension", "value", "actors", *r6("part"), *long("place"))


@query(
    "agg18_coverage_counters",
    """SELECT CAST(day AS VARCHAR) AS day, panel, count(DISTINCT domain) AS domains, count(DISTINCT sector) AS sectors, count(DISTINCT stage) AS stages, count(DISTINCT actor) AS sources
FROM points GROUP BY day, panel""",
    on=POINTS,
)
def coverage(v: Views) -> DataFrame:
    return points(v).groupBy("day", "panel").agg(*[F.count_distinct(c).alias(n) for c, n in (("domain", "domains"), ("sector", "sectors"), ("stage", "stages"), ("actor", "sources"))]).select(*text("day"), "panel", "domains", "sectors", "stages", "sources")


@query(
    "agg12_stage_diagnostics",
    """SELECT CAST(s.stage AS BIGINT) AS stage, count(DISTINCT i.actor) AS attempted, count(DISTINCT CASE WHEN c.image_id IS NOT NULL THEN i.actor END) AS captured,
 count(DISTINCT CASE WHEN i.baseline_eligible AND c.image_id IS NOT NULL THEN i.actor END) AS admitted,
 count(DISTINCT CASE WHEN i.current_eligible AND c.image_id IS NOT NULL THEN i.actor END) AS current_sources,
 array_to_string(list_sort(list(DISTINCT CAST(CASE WHEN c.image_id IS NULL THEN i.actor END AS VARCHAR)) FILTER (c.image_id IS NULL AND i.actor IS NOT NULL)), ',') AS uncaptured
FROM (SELECT unnest([0, 1, 2, 3]) AS stage) s LEFT JOIN panel p ON p.stage = s.stage LEFT JOIN images i ON i.actor = p.actor
LEFT JOIN (SELECT DISTINCT l_orderkey AS image_id FROM lineitem) c ON c.image_id = i.image_id GROUP BY s.stage""",
    views=("images", "panel"),
)
def stage_diagnostics(v: Views) -> DataFrame:
    # every stage has a row, also one without sources (3)
    stages = v.spark.range(4).select(F.col("id").alias("stage"))
    images = v.images.join(v.lineitem.select(F.col("l_orderkey").alias("image_id"), F.lit(True).alias("has")).distinct(), "image_id", "left")
    rows = stages.join(F.broadcast(v.panel), "stage", "left").join(images, "actor", "left")
    many = lambda test: F.count_distinct(F.when(test, F.col("actor")))
    lost = F.collect_set(F.when(F.col("has").isNull() & F.col("image_id").isNotNull(), F.col("actor").cast("string")))  # actors of the registry
    return rows.groupBy("stage").agg(
        many(F.col("image_id").isNotNull()).alias("attempted"), many(F.col("has")).alias("captured"), many(F.col("has") & F.col("baseline_eligible")).alias("admitted"), many(F.col("has") & F.col("current_eligible")).alias("current_sources"),
        F.array_join(F.array_sort(lost), ",").alias("_lost"),
    ).select(*long("stage"), "attempted", "captured", "admitted", "current_sources", F.when(F.col("_lost") != "", F.col("_lost")).alias("uncaptured"))


@query(
    "top01_evidence_order",
    "SELECT CAST(day AS VARCHAR) AS day, family, actor, row_number() OVER (PARTITION BY day, family ORDER BY confidence DESC, component_share DESC, share DESC, actor) AS place FROM best",
    on=BEST,
)
def evidence_order(v: Views) -> DataFrame:
    return ev.evidence_order(best(v), BY).select(*text("day"), "family", "actor", *long("place"))


PAIRS = (
    "sums",
    """SELECT a.day, a.family, a.actor, a.hex, sum(sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb - b.lb) * (a.lb - b.lb))) AS total,
 max(sqrt((a.ll - b.ll) * (a.ll - b.ll) + (a.la - b.la) * (a.la - b.la) + (a.lb - b.lb) * (a.lb - b.lb))) AS far
FROM best a JOIN best b ON a.day = b.day AND a.family = b.family GROUP BY ALL""",
)


@query(
    "alg06_medoid",
    """SELECT CAST(day AS VARCHAR) AS day, family, actor AS medoid_actor, hex AS medoid_hex FROM (SELECT *, row_number() OVER (PARTITION BY day, family ORDER BY round(total, 9), actor) AS rn FROM sums) WHERE rn = 1""",
    on=BEST,
    extra=(PAIRS,),
)
def medoid(v: Views) -> DataFrame:
    return ev.medoid_and_diameter(best(v), BY).select(*text("day"), "family", "medoid_actor", "medoid_hex")


@query("alg07_cluster_diameter", "SELECT CAST(day AS VARCHAR) AS day, family, round(max(far), 6) AS diameter, count(*) AS members FROM sums GROUP BY day, family", on=BEST, extra=(PAIRS,))
def diameter(v: Views) -> DataFrame:
    return ev.medoid_and_diameter(best(v), BY).select(*text("day"), "family", *r6("diameter"), "members")


@query(
    "entry_monthly_leaders",
    """SELECT CAST(day AS VARCHAR) AS day, family, source_count, domain_count, round(usage_score, 6) AS usage_score FROM (
SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(usage_score, 9) DESC, source_count DESC, family) AS rn FROM cand) WHERE rn = 1""",
    on=CAND,
)
def monthly_leaders(v: Views) -> DataFrame:
    top = F.min_by(F.struct("family", "source_count", "domain_count", "usage_score"), F.struct(-F.round("usage_score", 9), -F.col("source_count"), "family"))
    return cand(v).groupBy("day").agg(top.alias("top")).select(*text("day"), "top.*").withColumn("usage_score", F.round("usage_score", 6))
