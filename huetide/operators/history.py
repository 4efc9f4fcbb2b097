"""Compatible history, paired cohorts and prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions.color import distance
from huetide.operators.evidence import share

MATCH, RECUR = 0.045, 0.055
PERIODS, SOURCE_DAYS, COMPARABLE, COHORT, COVERAGE = 30, 5, 5, 6, 0.5


def valid_days(manifest: DataFrame, before: str, compat: str, limit: int = PERIODS) -> DataFrame:
    """The last ``limit`` days before a date that are eligible, not blocked and of the same version.

    The limit counts what is left after all filters.  One row a day of the
    archive, so the sort is small whatever the archive holds.
    """
    days = manifest.where((F.col("day") < F.lit(before).cast("date")) & F.col("eligible") & (F.col("state") != "blocked") & (F.col("compat") == compat))
    return days.select("day").distinct().orderBy(F.desc("day")).limit(limit)


def history(rows: DataFrame, manifest: DataFrame, before: str, compat: str, limit: int = PERIODS) -> DataFrame:
    """Eligible rows of the valid days; days left without rows don't count towards the limit."""
    own = rows.where("baseline_eligible")
    present = manifest.join(own.select("day").distinct(), "day", "left_semi")
    return own.join(F.broadcast(valid_days(present, before, compat, limit)), "day", "left_semi")  # at most ``limit`` days


def anchors(*rows: tuple[str, float, float, float]) -> Column:
    """Fixed colours as an array of structs to explode: a bounded set asked of every row."""
    return F.array(*[F.struct(F.lit(n).alias("anchor"), F.lit(x).alias("al"), F.lit(y).alias("aa"), F.lit(z).alias("ab")) for n, x, y, z in rows])


def actor_shares(colors: DataFrame, asked: Column, by: list[str], threshold: float = MATCH) -> DataFrame:
    """For each anchor, ``by`` group and actor the best matching share; 0 where the actor was observed without a match."""
    match = distance(("ll", "la", "lb"), ("al", "aa", "ab")) <= threshold
    rows = colors.select(*by, "actor", "ll", "la", "lb", share().alias("_share"), F.explode(asked).alias("x")).select("*", "x.*")
    return rows.groupBy("anchor", *by, "actor").agg(F.max(F.when(match, F.col("_share")).otherwise(0.0)).alias("share"))


def color_history(shares: DataFrame) -> DataFrame:
    """Days, days present, frequency, mean and last share of each anchor and actor."""
    present = F.count_if(F.col("share") > 0)
    return shares.groupBy("anchor", "actor").agg(
        F.count("*").alias("days"), present.alias("present_days"), (present / F.count("*")).alias("frequency"), F.avg("share").alias("mean_share"), F.max_by("share", "day").alias("last_share")
    )


def paired_prevalence(now: DataFrame, past: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prevalence on the same actors now and then: per past day, and per anchor.

    ``now`` has anchor, actor, share; ``past`` also day; both of the benchmark
    panel.  Actors count if they have SOURCE_DAYS past days; a day counts if
    enough of them were seen; a day's rate is the plain mean over domains of
    the rate inside a domain.  Missing actors are unknown, not 0: inner joins.
    """
    days = past.groupBy("anchor", "actor").agg(F.count("*").alias("_days"))
    stable = now.join(days.where(F.col("_days") >= SOURCE_DAYS), ["anchor", "actor"]).select("anchor", "actor", F.col("share").alias("now_share"))
    total = now.groupBy("anchor").agg(F.count("*").alias("observed"))
    pairs = past.join(stable, ["anchor", "actor"]).join(F.broadcast(domains), "actor")  # one row an actor of the registry
    rate = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    inside = pairs.groupBy("anchor", "day", "domain").agg(rate("now_share").alias("now_rate"), rate("share").alias("past_rate"), F.count("*").alias("n"))
    daily = inside.groupBy("anchor", "day").agg(F.sum("n").alias("cohort"), F.count("*").alias("domains"), F.avg("now_rate").alias("now_rate"), F.avg("past_rate").alias("past_rate"))
    daily = daily.join(F.broadcast(total), "anchor").where(F.col("cohort") >= F.greatest(F.lit(COHORT), F.ceil(F.col("observed") * COVERAGE)))
    change = F.avg("now_rate") - F.avg("past_rate")
    summary = total.join(
        daily.groupBy("anchor").agg(
            F.count("*").alias("comparable_days"), F.avg("now_rate").alias("now_rate"), F.avg("past_rate").alias("past_rate"), (100 * change).alias("change_pp"), (F.avg("now_rate") / F.nullif(F.avg("past_rate"), F.lit(0.0))).alias("lift")
        ),
        "anchor",
        "left",
    )
    days = F.coalesce("comparable_days", F.lit(0).cast("long"))
    return daily, summary.withColumns({"comparable_days": days, "valid": days >= COMPARABLE})


def recurrence(winners: DataFrame, actors: DataFrame, today: str) -> DataFrame:
    """How often today's winners were winners earlier in the same year, with day shares and the union of actors and domains.

    ``winners``: day, hex, ll, la, lb, state; ``actors``: day, hex, actor,
    domain.  The join is on the year; a day has a few winners.
    """
    day = F.lit(today).cast("date")
    ready = winners.where("state = 'ready'").withColumn("_n", F.count("*").over(Window.partitionBy("day")))
    current = winners.where(F.col("day") == day).select(F.col("hex").alias("now_hex"), F.col("ll").alias("al"), F.col("la").alias("aa"), F.col("lb").alias("ab"), F.year("day").alias("_year"), F.count("*").over(Window.partitionBy("day")).alias("_today"))
    prior = ready.where(F.col("day") < day).withColumn("_year", F.year("day"))
    matched = prior.join(F.broadcast(current), "_year").where(distance(("ll", "la", "lb"), ("al", "aa", "ab")) <= RECUR)
    days = matched.select("now_hex", "day", "_n").distinct().groupBy("now_hex").agg(F.count("*").alias("_days"), F.sum(1.0 / F.col("_n")).alias("_share"))
    seen = matched.select("now_hex", "day", "hex").join(actors, ["day", "hex"]).select("now_hex", "actor", "domain")
    own = current.join(actors.where(F.col("day") == day), F.col("now_hex") == F.col("hex")).select("now_hex", "actor", "domain")
    union = seen.union(own).groupBy("now_hex").agg(F.count_distinct("actor").alias("actors"), F.count_distinct("domain").alias("domains"))
    out = current.select("now_hex", "_today").join(days, "now_hex", "left").join(union, "now_hex", "left")
    return out.select(F.col("now_hex").alias("hex"), (F.coalesce("_days", F.lit(0)) + 1).alias("days"), (F.coalesce("_share", F.lit(0.0)) + 1.0 / F.col("_today")).alias("day_share"), "actors", "domains")


def trail(colors: DataFrame, asked: Column, through: str) -> DataFrame:
    """Per anchor and day up to a date: actors that match, actors observed, and the matching images."""
    rows = colors.where(F.col("baseline_eligible") & (F.col("day") <= F.lit(through).cast("date")))
    match = distance(("ll", "la", "lb"), ("al", "aa", "ab")) <= MATCH
    rows = rows.select("day", "actor", "image_id", "ll", "la", "lb", share().alias("_share"), F.explode(asked).alias("x")).select("*", "x.*")
    hit = match & (F.col("_share") > 0)
    return rows.groupBy("anchor", "day").agg(F.count_distinct(F.when(hit, F.col("actor"))).alias("matching"), F.count_distinct("actor").alias("observed"), F.count_distinct(F.when(hit, F.col("image_id"))).alias("evidence"))


def new_ratio(best: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Among each group's actors with enough days in ``known``: the share never present before, and of identity actors."""
    rows = best.join(known.where(F.col("days") >= SOURCE_DAYS), [*by, "actor"])
    return rows.groupBy(*by).agg(F.avg(F.when(F.col("present_days") == 0, 1.0).otherwise(0.0)).alias("new_ratio"), F.avg(F.when(F.col("frequency") >= 0.70, 1.0).otherwise(0.0)).alias("identity_ratio"))
