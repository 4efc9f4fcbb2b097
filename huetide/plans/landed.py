"""Queries over landed payloads derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huetide.plans.catalog import query, text
from huetide.sources import files
from huetide.sources.fixtures import Views


@query("src06_payload_items", "SELECT p_partkey AS id, p_name AS title, 'u/' || p_brand AS url, CAST(p_size AS VARCHAR) AS published_at, 'i/' || p_type AS image_url, CAST(p_partkey % 7 AS VARCHAR) AS creator_id FROM part WHERE p_partkey % 3 <> 0")
def payload_items(v: Views) -> DataFrame:
    """Parts as an auction provider's payloads; some without an image."""
    k = F.col("p_partkey")
    body = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("u/"), "p_brand").alias("itemWebUrl"), F.col("p_size").cast("string").alias("itemCreationDate"),
                    F.struct(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("i/"), "p_type")).alias("imageUrl")).alias("image"), F.struct((k % 7).cast("string").alias("username")).alias("seller"))
    return files.payload_items(v.part.select(k.alias("id"), F.to_json(body).alias("payload")), "auctions")


@query("src04_submissions", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 5 <> 0) WHERE place <= 12")
def submissions(v: Views) -> DataFrame:
    k = F.col("doc_id")
    approved = F.when(k % 4 == 0, "YES").when(k % 4 == 1, " true").otherwise("no")
    rows = v.documents.select("source", k.alias("line"), approved.alias("approved"), F.when(k % 5 == 0, "").otherwise("i").alias("image_url"))
    return files.submissions(rows, 12).select("source", F.col("line").alias("doc_id"))


@query("src10_public_feed", "SELECT CAST(day AS VARCHAR) AS day, CASE WHEN month(day) % 2 = 0 THEN '[private]' ELSE 'https://e.org/' END AS path FROM manifest WHERE state = 'ready'", views=("manifest",))
def public_feed(v: Views) -> DataFrame:
    rows = v.manifest.withColumn("path", F.when(F.month("day") % 2 == 0, "/srv/day").otherwise("https://e.org/"))
    return files.public_feed(rows, ["path"], "day").select(*text("day"), "path")
