"""The tables that operators run on, as views over the star-schema tables.

One SQL text a view serves Spark and, as a common table expression, the SQL
that checks a query; where the dialects differ there are two.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str | tuple[str, str]] = {
    # every customer is a source of the registry; sources are grouped into 40 actors, each with what its first source has
    "registry": """
SELECT c_custkey AS actor, c_name AS actor_name, c_nationkey % 12 AS domain, c_nationkey AS sector,
       c_custkey % 3 AS stage, c_mktsegment AS scale, c_custkey % 8 AS platform,
       CASE WHEN c_custkey % 5 < 3 THEN 'benchmark' ELSE 'discovery' END AS panel
FROM {customer}""",
    "panel": """
SELECT k AS actor, min_by(actor_name, actor) AS actor_name, min_by(domain, actor) AS domain, min_by(sector, actor) AS sector,
       min_by(stage, actor) AS stage, min_by(scale, actor) AS scale, min_by(platform, actor) AS platform, min_by(panel, actor) AS panel
FROM (SELECT *, actor % 40 AS k FROM {registry}) r GROUP BY k""",
    "images": """
SELECT o_orderkey AS image_id, o_custkey % 40 AS actor,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(o_orderdate AS DATE) AS captured_on,
       0.5 + CAST(o_orderkey % 50 AS DOUBLE) / 100 AS confidence,
       o_orderstatus <> 'P' AS baseline_eligible, o_orderstatus = 'F' AS current_eligible
FROM {orders}""",
    "swatches": """
SELECT i.image_id, i.actor, i.day, i.captured_on, i.confidence, i.baseline_eligible, i.current_eligible, b.swatch_no,
       b.r0 AS r, CASE WHEN grey THEN b.r0 ELSE b.g0 END AS g, CASE WHEN grey THEN b.r0 ELSE b.b0 END AS b,
       b.share, CASE WHEN b.l_linenumber = 7 THEN NULL ELSE b.share * (1 - b.l_discount) END AS adjusted_share,
       b.salience, b.share * (1 - 5 * b.l_discount) AS component_share,
       CAST(b.l_linenumber AS DOUBLE) / 8 AS coverage, b.l_tax * 10 AS border_share
FROM (
  SELECT l_orderkey AS image_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS BIGINT) AS swatch_no,
         (l_partkey * 37) % 256 AS r0,
         (CAST(floor(l_partkey / 3) AS BIGINT) * 101 + 17) % 256 AS g0,
         (CAST(floor(l_partkey / 11) AS BIGINT) * 197 + 89) % 256 AS b0,
         l_partkey % 5 = 0 AS grey,
         l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS share,
         l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS salience,
         l_discount, l_tax, l_linenumber
  FROM {lineitem}) b JOIN {images} i ON i.image_id = b.image_id""",
    "palette": """
SELECT DISTINCT r0 AS r, CASE WHEN grey THEN r0 ELSE g0 END AS g, CASE WHEN grey THEN r0 ELSE b0 END AS b
FROM (SELECT (l_partkey * 37) % 256 AS r0, (CAST(floor(l_partkey / 3) AS BIGINT) * 101 + 17) % 256 AS g0,
             (CAST(floor(l_partkey / 11) AS BIGINT) * 197 + 89) % 256 AS b0, l_partkey % 5 = 0 AS grey
      FROM (SELECT DISTINCT l_partkey FROM {lineitem}) p)""",
    "ledger_events": """
SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS source_id, event_type AS region,
       concat('f', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS STRING)) AS fingerprint, value
FROM {events}""",
    "boxes": """
SELECT doc_id AS box_id, source AS page, (doc_id * 37) % 1100 AS x, (doc_id * 53) % 900 AS y,
       280 + (doc_id * 71) % 800 AS w, 180 + (doc_id * 29) % 700 AS h,
       CAST(doc_id % 11 AS DOUBLE) / 10 AS image_ratio, text
FROM {documents}""",
    "page_dates": """
SELECT page_id, url,
       concat('https://feed.example.org/2024/', lpad(CAST(1 + page_id % 3 AS STRING), 2, '0'), '/',
              lpad(CAST(1 + page_id % 31 AS STRING), 2, '0'), '/item') AS dated_url,
       CASE WHEN page_id % 4 = 0 THEN concat(html, '<article><time datetime="2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'), '">x</time></article>')
            WHEN page_id % 4 = 1 THEN concat(html, '<meta itemprop="datePublished" content="2024-02-', lpad(CAST(1 + page_id % 31 AS STRING), 2, '0'), '">')
            ELSE html END AS html
FROM {pages}""",
    "reviews": """
SELECT d.doc_id,
       CASE WHEN d.n_chars >= 400 AND d.source <> 'src0' THEN 'accept' WHEN d.n_chars < 100 THEN 'reject' ELSE 'review' END AS decision,
       CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 1 THEN 'accept' ELSE 'review' END AS expected,
       CASE WHEN d.doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "patches": (
        "SELECT vec_id AS image_id, pos DIV 8 AS y, pos % 8 AS x, v FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, v",
        "SELECT vec_id AS image_id, pos // 8 AS y, pos % 8 AS x, embedding[pos + 1] AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings)",
    ),
    # days of the archive with what their manifest says
    "manifest": """
SELECT day, CASE WHEN month(day) = 2 THEN 'blocked' WHEN month(day) = 3 THEN 'review_only' ELSE 'ready' END AS state,
       month(day) <> 5 AS eligible, CASE WHEN year(day) < 1993 THEN 'v1' ELSE 'v2' END AS compat
FROM (SELECT DISTINCT day FROM {images}) d""",
}


def _sql(name: str, spark: bool) -> str:
    text = VIEWS[name]
    return text if isinstance(text, str) else text[0 if spark else 1]


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def with_views(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """A WITH clause of views (and of those they need) and of extra expressions, for the checking SQL."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needs(_sql(name, False)):
            if n in VIEWS:
                add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    made = [(n, re.sub(r"\{(\w+)\}", r"\1", _sql(n, False))) for n in order] + list(extra)
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in made) + "\n"


class Views:
    """Tables and views over one directory, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = _sql(name, True)
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})
        return self._made[name]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small derived table, built once for a query and persisted."""
        if name not in self._made:
            self._made[name] = build().persist()
        return self._made[name]

    @cached_property
    def colors(self) -> DataFrame:
        """Swatches with hex, OKLab and OKLCH columns, family and neutral flag, worked out once a distinct colour.

        The dimension is broadcast if a count says that it is small, so that swatches need no shuffle by colour.
        """
        from huetide.functions import color

        return color.with_color(self.swatches, color.small(self.kept("dimension", lambda: color.dimension(self.palette))))
