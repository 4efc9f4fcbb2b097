"""Scores over time, trend states, gates, leaders and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.operators.evidence import not_neutral

WEIGHTS = {"novelty": 0.25, "cross_domain": 0.25, "cross_stage": 0.20, "velocity": 0.15, "small_large": 0.10, "quality": 0.05}
CALIBRATION_DAYS, CHANGE, TIE, TIES = 7, 5.0, 2.5, 2
EMERGING = ("new", "rising", "spreading", "surging")


def emergence(valid: Column, delta: Column, new: Column) -> dict[str, Column]:
    """novelty, velocity and score from a paired change (as a fraction) and the candidate's breadth."""
    up = F.greatest(F.lit(0.0), F.coalesce(delta, F.lit(0.0)))
    novelty = F.when(valid, F.least(F.lit(1.0), up * 2 + 0.5 * F.coalesce(new, F.lit(0.0)))).otherwise(0.0)
    velocity = F.when(valid, F.least(F.lit(1.0), up * 4)).otherwise(0.0)
    breadth = {"cross_domain": F.least(F.lit(1.0), F.col("domain_count") / 7), "cross_stage": F.least(F.lit(1.0), F.col("stage_count") / 3), "small_large": F.col("small_large"), "quality": F.col("evidence_quality")}
    parts = {"novelty": novelty, "velocity": velocity, **breadth}
    score = sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0)) * 100
    return {"novelty": novelty, "velocity": velocity, "emergence_score": score}


def trend_state(history_days: Column, valid: Column, delta: Column, identity: Column) -> Column:
    change = F.coalesce(delta, F.lit(0.0)) * 100
    return (
        F.when(history_days < CALIBRATION_DAYS, "calibration")
        .when(~valid, "observed")
        .when(change <= -CHANGE, "cooling")
        .when(change < CHANGE, F.when(F.coalesce(identity, F.lit(0.0)) >= 0.7, "identity").otherwise("stable"))
        .when((change >= 20) & (F.col("emergence_score") >= 75), "surging")
        .when((F.col("domain_count") >= 4) & (F.col("stage_count") >= 2), "spreading")
        .otherwise("rising")
    )


def concentration_ok() -> Column:
    return (F.col("top_source_weight") <= 0.25) & (F.col("top_domain_weight") <= 0.45) & (F.col("top_platform_weight") <= 0.40)


def neutral_ok(history_days: Column) -> Column:
    gate = (history_days >= 14) & (F.col("velocity") >= 0.70) & (F.col("source_count") >= 10) & (F.col("domain_count") >= 6) & (F.col("top_source_weight") <= 0.20)
    return F.col("chromatic") | gate


def integrity_ok() -> Column:
    return (F.col("diameter") <= 0.050) & (F.col("mean_component") >= 0.006)


def runner_ok() -> Column:
    return (F.col("source_count") >= 4) & (F.col("domain_count") >= 3) & F.col("chromatic") & integrity_ok()


def ties(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The top row and the next that are within 2.5 points and whose intervals overlap, TIES in all; a row that isn't is passed over."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "family")
    first = lambda c: F.first(c).over(order)
    rows = rows.withColumns({"_top": first(score), "_u": first("uncertainty"), "_place": F.row_number().over(order)})
    gap = F.col("_top") - F.col(score)
    near = (gap <= TIE) & (F.abs(gap) <= 10 * (F.col("_u") + F.col("uncertainty")))
    rows = rows.where((F.col("_place") == 1) | near).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= TIES).drop("_top", "_u", "_place")


def margins(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Each row's distance to the next score of its group; 100 for the last."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "family")
    return rows.withColumn("margin", F.coalesce(F.col(score) - F.lead(score).over(order), F.lit(100.0)))


def first_of(rows: DataFrame, by: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row with the highest score of each group; of equals the first by ``tie`` columns (descending numbers, then family)."""
    keys = F.struct(-F.round(score, 9), *[-F.col(c) for c in tie], F.col("family"))
    return rows.groupBy(*by).agg(F.min_by(F.struct("family", F.col(score).alias("score")), keys).alias("x")).select(*by, "x.*")


def publication_state() -> dict[str, Column]:
    """State of a day and its reasons, from active, evidence, domains, stages, baseline_days, winners and margin."""
    c = F.col
    block = F.array_compact(F.array(
        F.when(c("evidence") < F.greatest(F.lit(12), F.ceil(c("active") * 0.30)), "evidence"), F.when(c("domains") < 4, "domains"), F.when(c("stages") < 2, "stages")
    ))
    warming = c("baseline_days") < CALIBRATION_DAYS
    review = F.array_compact(F.array(
        F.when(c("evidence") < F.greatest(F.lit(24), F.ceil(c("active") * 0.55)), "coverage"), F.when(c("domains") < 7, "domains"), F.when(c("stages") < 3, "stages"), F.when(warming, "warming"),
        F.when((c("winners") == 0) & ~warming, "no candidate"), F.when((c("winners") == 0) & warming, "calibration"), F.when((c("winners") == 1) & (c("margin") < 3.0), "close"),
    ))
    state = (
        F.when(F.size(block) > 0, "blocked")
        .when(c("winners") == 0, F.when(warming, "review_only").otherwise("baseline_only"))
        .when(F.size(review) > 0, "review_only")
        .otherwise("ready")
    )
    return {"state": state, "reasons": F.array_join(F.when(F.size(block) > 0, block).otherwise(review), "; ")}


def audited_score() -> dict[str, Column]:
    """Aggregates of a cluster's findings, one per source; unknown values don't count as kinds."""
    kinds = lambda c: F.count_distinct(F.when(F.col(c).cast("string") != "unknown", F.col(c)))
    part = lambda n, most: F.least(n / most, F.lit(1.0))
    n, domains, stages, scales, panels = F.count("*"), kinds("domain"), kinds("stage"), kinds("scale"), kinds("panel")
    substance = F.avg(F.least(F.lit(1.0), (F.col("share") / 0.18 + F.col("component_share") / 0.08) / 2))
    return {"sources": n, "domains": domains, "chromatic": F.bool_and(not_neutral()), "audited_score": 40 * part(n, 15) + 25 * part(domains, 8) + 15 * part(stages, 3) + 8 * part(scales, 4) + 5 * part(panels, 2) + 7 * substance}


def audited_tie(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the two best eligible rows, whether they tie, and why not where fewer than two are eligible."""
    order = Window.partitionBy(*by).orderBy(F.desc("audited_score"), F.desc("sources"), "family")
    top = ranked.where("eligible").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= 2)
    of = lambda k, c: F.max(F.when(F.col("_place") == k, F.col(c)))
    pair = top.groupBy(*by).agg(of(1, "family").alias("first"), of(2, "family").alias("second"), (of(1, "audited_score") - of(2, "audited_score")).alias("delta"))
    out = ranked.select(*by).distinct().join(pair, by, "left")
    return out.withColumn("is_tie", F.coalesce(F.col("delta") <= TIE, F.lit(False)))
