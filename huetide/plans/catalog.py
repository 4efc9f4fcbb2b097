"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.functions.color import sql_colors
from huetide.sources.fixtures import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COLORS = (("swatches",), sql_colors())
_POINT = (
    "points",
    """SELECT c.*, p.domain, p.sector, p.stage, p.scale, p.platform, p.panel,
  greatest(0.001, (0.45 * coalesce(adjusted_share, share) + 0.25 * salience + 0.20 * component_share + 0.10 * coverage) * confidence) AS strength
FROM colors c JOIN panel p ON p.actor = c.actor
WHERE NOT structural AND (coalesce(adjusted_share, share) >= 0.055 OR salience >= 0.025) AND (component_share >= 0.006 OR coverage >= 0.125)""",
)
POINTS = (("swatches", "panel"), (*sql_colors(), _POINT))
_BEST = (
    "best",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY day, family, actor ORDER BY strength DESC, image_id, swatch_no) AS rn
FROM points WHERE current_eligible) WHERE rn = 1""",
)
BEST = (POINTS[0], (*POINTS[1], _BEST))
_CAND = (
    "cand",
    """SELECT s.*, d.top_domain_weight, p.top_platform_weight, 1.0 / source_count AS top_source_weight, 1.0 / sqrt(source_count) AS uncertainty
FROM (SELECT day, family, count(*) AS source_count, count(DISTINCT domain) AS domain_count, count(DISTINCT sector) AS sector_count,
    count(DISTINCT stage) AS stage_count, count(DISTINCT scale) AS scale_count,
    count(*) FILTER (panel = 'benchmark') AS benchmark_count, count(*) FILTER (panel = 'discovery') AS discovery_count,
    avg(confidence) AS evidence_quality,
    100 * (0.35 * least(1, count(*) / 10) + 0.25 * least(1, count(DISTINCT domain) / 7) + 0.15 * least(1, count(DISTINCT stage) / 3)
      + 0.10 * CASE WHEN count(DISTINCT panel) >= 2 THEN 1 ELSE 0.65 END + 0.08 * avg(least(share, 0.35) / 0.35)
      + 0.07 * avg(least(component_share, 0.20) / 0.20)) AS usage_score,
    100 * (0.70 * avg(CASE WHEN panel = 'discovery' OR scale IN ('HOUSEHOLD', 'MACHINERY') THEN 1.0 ELSE 0.0 END)
      + 0.30 * least(1, count(DISTINCT domain) / 4)) AS undercurrent_score,
    100 * (0.75 * avg(CASE WHEN panel = 'benchmark' OR scale IN ('AUTOMOBILE', 'BUILDING') THEN 1.0 ELSE 0.0 END)
      + 0.25 * least(1, count(*) / 12)) AS mainstream_score,
    least(1, (max(CASE WHEN scale IN ('HOUSEHOLD', 'MACHINERY') THEN 1.0 ELSE 0.0 END) + max(CASE WHEN scale IN ('AUTOMOBILE', 'BUILDING') THEN 1.0 ELSE 0.0 END)
      + 0.5 * max(CASE WHEN scale = 'FURNITURE' THEN 1.0 ELSE 0.0 END)) / 2) AS small_large,
    avg(component_share) AS mean_component
  FROM best GROUP BY day, family) s
JOIN (SELECT day, family, max(n) / sum(n) AS top_domain_weight FROM (SELECT day, family, domain, count(*) AS n FROM best GROUP BY ALL) GROUP BY ALL) d USING (day, family)
JOIN (SELECT day, family, max(n) / sum(n) AS top_platform_weight FROM (SELECT day, family, platform, count(*) AS n FROM best GROUP BY ALL) GROUP BY ALL) p USING (day, family)""",
)
CAND = (BEST[0], (*BEST[1], _CAND))


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), on: tuple[tuple[str, ...], tuple[tuple[str, str], ...]] | None = None, extra: tuple[tuple[str, str], ...] = ()):
    """Registers a function of Views under ``name``; ``sql`` may use ``views`` and the expressions ``on``."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            needed, more = on or ((), ())
            head = with_views(*needed, *views, extra=(*more, *extra)) if needed or views or more or extra else ""
            ORACLES[name] = head + sql
        return f

    return register


def r6(*names: str) -> list[Column]:
    """Columns rounded to six places, so that engines agree in the last digits.

    A number is scaled, rounded to a whole one and scaled back, as the checking
    SQL does; ``round(x, 6)`` here goes by the digits that x is written with, so
    the two differ where a product of shares ends on a five.
    """
    return [(F.round(F.col(n).cast("double") * 1e6) / 1e6).alias(n) for n in names]


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def text(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]
