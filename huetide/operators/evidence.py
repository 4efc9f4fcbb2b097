"""Admission of swatches and the roll-up of evidence into candidates.

A candidate is a group of swatches named by ``by`` columns: a cluster from
``cluster.complete_linkage``, or simply day and family.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions.color import MUTED, NEUTRAL_FAMILIES, distance

SMALL, LARGE, MIDDLE = ("HOUSEHOLD", "MACHINERY"), ("AUTOMOBILE", "BUILDING"), "FURNITURE"
TARGET_DOMAINS = 7


def share() -> Column:
    """The adjusted share; the plain one only where that is unknown, not where it is 0."""
    return F.coalesce("adjusted_share", "share")


def eligible() -> Column:
    """No structural background; large or salient enough; one connected patch or spread over the image."""
    return ~F.col("structural") & ((share() >= 0.055) | (F.col("salience") >= 0.025)) & ((F.col("component_share") >= 0.006) | (F.col("coverage") >= 0.125))


def substantial() -> Column:
    """Eligible, with higher minima for muted colours."""
    muted = F.col("chroma") < MUTED
    enough = F.when(muted, (F.col("share") >= 0.04) & (F.col("component_share") >= 0.01)).otherwise((F.col("share") >= 0.02) & (F.col("component_share") >= 0.005))
    return eligible() & enough


def strength() -> Column:
    return F.greatest(F.lit(0.001), (0.45 * share() + 0.25 * F.col("salience") + 0.20 * F.col("component_share") + 0.10 * F.col("coverage")) * F.col("confidence"))


def palette_rank() -> Column:
    return 0.50 * share() + 0.25 * F.col("salience") + 0.15 * F.col("component_share") + 0.10 * F.col("coverage")


def semantic_status() -> Column:
    muted = F.col("chroma") < MUTED
    total, part = F.col("adjusted_share"), F.col("component_share")
    return (
        F.when(total.isNull() | part.isNull(), "unverified_region_substance")
        .when(total < F.when(muted, 0.04).otherwise(0.02), "incidental_low_share")
        .when(part < F.when(muted, 0.01).otherwise(0.005), "incidental_fragmented")
        .otherwise("eligible")
    )


def normalised(swatches: DataFrame) -> DataFrame:
    """Salience as a share of its image's total (1 for a total of 0)."""
    total = F.sum("salience").over(Window.partitionBy("image_id"))
    return swatches.withColumn("salience_share", F.when(total == 0, 1.0).otherwise(F.col("salience") / total))


def best_per_actor(points: DataFrame, by: list[str]) -> DataFrame:
    """Each actor's strongest row in each group; of equals the first by image and swatch number.

    A struct maximum: partial aggregation keeps one row a key and task.
    """
    rest = [c for c in points.columns if c not in (*by, "actor")]
    best = F.max(F.struct("strength", -F.col("image_id"), -F.col("swatch_no"), F.struct(*rest).alias("row")))
    return points.groupBy(*by, "actor").agg(best.alias("top")).select(*by, "actor", "top.row.*")


def admitted(colors: DataFrame, panel: DataFrame) -> DataFrame:
    """Eligible swatches of registered actors with their classification and strength."""
    return colors.where(eligible()).join(F.broadcast(panel.drop("actor_name")), "actor").withColumn("strength", strength())


def usage_scores() -> dict[str, Column]:
    """Aggregates over a candidate's evidence rows, one per actor."""
    n, domains, stages = F.count("*"), F.count_distinct("domain"), F.count_distinct("stage")
    small = F.col("scale").isin(*SMALL)
    large = F.col("scale").isin(*LARGE)
    one = lambda test: F.max(F.when(test, 1.0).otherwise(0.0))
    mean = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return {
        "source_count": n,
        "domain_count": domains,
        "sector_count": F.count_distinct("sector"),
        "stage_count": stages,
        "scale_count": F.count_distinct("scale"),
        "benchmark_count": F.count_if(F.col("panel") == "benchmark"),
        "discovery_count": F.count_if(F.col("panel") == "discovery"),
        "evidence_quality": F.avg("confidence"),
        "usage_score": 100
        * (
            0.35 * F.least(F.lit(1.0), n / 10)
            + 0.25 * F.least(F.lit(1.0), domains / TARGET_DOMAINS)
            + 0.15 * F.least(F.lit(1.0), stages / 3)
            + 0.10 * F.when(F.count_distinct("panel") >= 2, 1.0).otherwise(0.65)
            + 0.08 * F.avg(F.least(F.col("share"), F.lit(0.35)) / 0.35)
            + 0.07 * F.avg(F.least(F.col("component_share"), F.lit(0.20)) / 0.20)
        ),
        "undercurrent_score": 100 * (0.70 * mean((F.col("panel") == "discovery") | small) + 0.30 * F.least(F.lit(1.0), domains / 4)),
        "mainstream_score": 100 * (0.75 * mean((F.col("panel") == "benchmark") | large) + 0.25 * F.least(F.lit(1.0), n / 12)),
        "small_large": F.least(F.lit(1.0), (one(small) + one(large) + 0.5 * one(F.col("scale") == MIDDLE)) / 2),
        "mean_component": F.avg("component_share"),
        # as an aggregate: a filter on the family itself would be pushed down and expand its whole expression
        "chromatic": F.bool_and(not_neutral()),
    }


def candidates(best: DataFrame, by: list[str]) -> DataFrame:
    """Counts, scores and concentration of each group of evidence rows.

    The largest domain's and platform's weights come from counts per value,
    so nothing is gathered; both counts and scores are partial aggregates.
    """
    scores = best.groupBy(*by).agg(*[c.alias(n) for n, c in usage_scores().items()])
    weight = lambda column: best.groupBy(*by, column).count().groupBy(*by).agg((F.max("count") / F.sum("count")).alias(f"top_{column}_weight"))
    out = scores.join(weight("domain"), by).join(weight("platform"), by)
    return out.withColumns({"top_source_weight": 1.0 / F.col("source_count"), "uncertainty": 1.0 / F.sqrt("source_count")})


def swatch_summary(best: DataFrame, by: list[str], kinds: dict[str, Iterable]) -> DataFrame:
    """``candidates`` in one aggregation: the weights of the largest domain and platform are the greatest of counts by kind.

    ``kinds`` has, for each of these columns, the registry's values: a bounded
    list.  A row with another value or none counts in no kind.
    """
    weight = lambda c, values: (F.greatest(F.lit(0).cast("long"), F.count_if(F.col(c).isNull()), *[F.count_if(F.col(c) == v) for v in values]) / F.count("*")).alias(f"top_{c}_weight")
    out = best.groupBy(*by).agg(*[c.alias(n) for n, c in usage_scores().items()], *[weight(c, values) for c, values in kinds.items()])
    return out.withColumns({"top_source_weight": 1.0 / F.col("source_count"), "uncertainty": 1.0 / F.sqrt("source_count")})


def evidence_order(best: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("confidence"), F.desc("component_share"), F.desc("share"), "actor")
    return best.withColumn("place", F.row_number().over(order))


def medoid_and_diameter(best: DataFrame, by: list[str]) -> DataFrame:
    """The member with the least total distance (the first by actor of equals), and the largest distance, of each group.

    Pairs are made inside a group; a group has one row an actor, so its size
    is bounded by the registry.
    """
    keep = [*by, "actor", "hex", "ll", "la", "lb"]
    other = best.select(*by, *[F.col(c).alias(f"o_{c}") for c in keep[len(by) :]])
    d = distance(("ll", "la", "lb"), ("o_ll", "o_la", "o_lb"))
    sums = best.select(*keep).join(other, by).groupBy(*by, "actor", "hex").agg(F.sum(d).alias("total"), F.max(d).alias("far"))
    # sums of the same distances in another order differ in the last digits: those are ties
    return sums.groupBy(*by).agg(
        F.min_by("actor", F.struct(F.round("total", 9), "actor")).alias("medoid_actor"),
        F.min_by("hex", F.struct(F.round("total", 9), "actor")).alias("medoid_hex"),
        F.max("far").alias("diameter"),
        F.count("*").alias("members"),
    )


def signal_map(best: DataFrame, dimensions: list[str], top: int = 6) -> DataFrame:
    """Distinct actors by value of each dimension, the first ``top`` values of each with their share of all."""
    sets = best.select("actor", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x"))
    counts = sets.select("actor", "x.*").groupBy("dimension", "value").agg(F.count_distinct("actor").alias("actors"))
    total = F.sum("actors").over(Window.partitionBy("dimension"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("actors"), "value"))
    return counts.select("dimension", "value", "actors", (F.col("actors") / total).alias("part"), place.alias("place")).where(F.col("place") <= top)


def not_neutral(column: str = "family") -> Column:
    return ~F.col(column).isin(*NEUTRAL_FAMILIES)


def colour_truth(claims: DataFrame, pixels: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is wrong with claimed colours: rows scope and id.

    ``claims`` has id, candidate, image_id, r, g, b; every one must be among
    the distinct pixels of its image.  ``candidates`` has candidate, r, g, b and
    representative; its colour must be one of its claims' colours and its
    representative one of their ids.
    """
    seen = pixels.select("image_id", "r", "g", "b").distinct()
    absent = claims.join(seen, ["image_id", "r", "g", "b"], "left_anti").select(F.lit("pixel_absent").alias("scope"), F.col("id").cast("string").alias("id"))
    unclaimed = candidates.join(claims.select("candidate", "r", "g", "b").distinct(), ["candidate", "r", "g", "b"], "left_anti").select(F.lit("candidate_colour_unclaimed"), F.col("candidate").cast("string"))
    nobody = candidates.join(claims.select("candidate", F.col("id").alias("representative")).distinct(), ["candidate", "representative"], "left_anti").select(F.lit("representative_missing"), F.col("candidate").cast("string"))
    return absent.unionAll(unclaimed).unionAll(nobody)
