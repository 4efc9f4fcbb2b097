"""The palette regime of a day, colour pairs, and monthly summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions.color import distance, is_warm
from huetide.operators.evidence import share


def first_images(colors: DataFrame, swatches: int = 5) -> DataFrame:
    """A row a day and actor: its most confident image (of equals the first), confidence, and ``swatches``, the image's first ones in order.

    Two aggregations of one scan: an image's few swatches are gathered, then
    one image is kept.
    """
    fields = F.struct("swatch_no", "hex", "ll", "la", "lb", "chroma", "hue", "neutral", share().alias("weight"))
    first = F.collect_list(F.when(F.col("swatch_no") <= swatches, fields))
    images = colors.groupBy("day", "actor", "image_id").agg(F.max("confidence").alias("confidence"), F.array_sort(first).alias("swatches"))
    best = F.max_by(F.struct("image_id", "confidence", "swatches"), F.struct("confidence", -F.col("image_id"))).alias("best")
    return images.groupBy("day", "actor").agg(best).select("day", "actor", "best.*").where(F.size("swatches") > 0)


def _pairs(items: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of every item of an array with each later one."""
    return F.flatten(F.transform(items, lambda x, k: F.transform(F.slice(items, k + 2, F.size(items)), lambda y: make(x, y))))


def contrast(swatches: Column) -> Column:
    """The largest distance between two of an image's swatches; null for one alone."""
    return F.array_max(_pairs(swatches, lambda x, y: distance((x["ll"], x["la"], x["lb"]), (y["ll"], y["la"], y["lb"]))))


def regime_label(neutral: Column, chroma: Column, contrast: Column) -> Column:
    return (
        F.when((neutral >= 0.68) & (chroma < 0.06), "neutral minimalism")
        .when((chroma < 0.075) & (contrast < 0.20), "soft muted palettes")
        .when((chroma < 0.11) & (contrast < 0.28), "pastel and softened color")
        .when((chroma >= 0.16) & (contrast >= 0.30), "high-chroma maximalism")
        .when(chroma >= 0.13, "saturated accents")
        .when(contrast >= 0.32, "high-contrast mixed palettes")
        .otherwise("grounded mid-chroma color")
    )


def regimes(colors: DataFrame) -> DataFrame:
    """One row a day: means over images, and median chroma and mean lightness over values that count as often as tenths of their weight.

    What belongs to an image stands at its first swatch's row, so that one
    aggregation a day has all.
    """
    rows = first_images(colors)
    total = lambda test: F.aggregate(F.filter("swatches", test), F.lit(0.0), lambda a, s: a + s["weight"])
    hues = F.transform(F.filter("swatches", lambda s: ~s["neutral"]), lambda s: s["hue"])
    all_ = total(lambda s: F.lit(True))
    image = {
        "neutral_share": total(lambda s: s["neutral"]) / F.when(all_ == 0, 1.0).otherwise(all_),
        "palette_size": F.size("swatches"),
        "monochrome_share": F.when(F.coalesce(F.array_max(hues) - F.array_min(hues), F.lit(0.0)) < 25, 1.0).otherwise(0.0),
        "contrast": contrast(F.col("swatches")),
    }
    each = rows.withColumns(image).select("day", *image, F.posexplode("swatches").alias("place", "s"))
    each = each.select("day", *[F.when(F.col("place") == 0, F.col(c)).alias(c) for c in image], "s.*")
    times = F.greatest(F.lit(1), (F.col("weight") * 10).cast("int"))
    part = lambda test: F.sum(F.when(~F.col("neutral") & test, F.col("weight")).otherwise(0.0))
    warm, cool, muted, electric = part(is_warm("hue")), part(~is_warm("hue")), part(F.col("chroma") < 0.10), part(F.col("chroma") >= 0.18)
    safe = lambda x: F.when(x == 0, 1.0).otherwise(x)
    out = each.groupBy("day").agg(
        *[F.avg(c).alias(c) for c in image],
        F.percentile("chroma", F.lit(0.5), times).alias("median_chroma"), (F.sum(F.col("ll") * times) / F.sum(times)).alias("mean_lightness"),
        (warm / safe(warm + cool)).alias("warm_share"), (muted / safe(muted + electric)).alias("muted_share"),
    )
    return out.withColumn("regime", regime_label(F.col("neutral_share"), F.col("median_chroma"), F.coalesce("contrast", F.lit(0.0))))


def pairs(colors: DataFrame, top: int = 10) -> DataFrame:
    """The day's strongest unordered pairs among the first four chromatic swatches of each actor's image."""
    four = F.slice(F.filter("swatches", lambda s: ~s["neutral"]), 1, 4)
    rows = first_images(colors).select("day", "confidence", four.alias("four"))
    made = _pairs(F.col("four"), lambda x, y: F.struct(F.least(x["hex"], y["hex"]).alias("first"), F.greatest(x["hex"], y["hex"]).alias("second"), F.least(x["weight"], y["weight"]).alias("weight")))
    both = rows.select("day", "confidence", F.explode(made).alias("x"))
    scored = both.groupBy("day", "x.first", "x.second").agg(F.sum(F.col("x.weight") * F.col("confidence")).alias("score"))
    order = Window.partitionBy("day").orderBy(F.desc(F.round("score", 9)), "first", "second")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def monthly(regime_rows: DataFrame) -> DataFrame:
    """The most frequent regime (the first by name of equals), mean chroma and mean neutral share of each year."""
    counts = regime_rows.groupBy(F.year("day").alias("year"), "regime").count()
    mode = counts.groupBy("year").agg(F.min_by("regime", F.struct(-F.col("count"), "regime")).alias("regime"))
    means = regime_rows.groupBy(F.year("day").alias("year")).agg(F.avg("median_chroma").alias("mean_chroma"), F.avg("neutral_share").alias("mean_neutral"), F.max_by("day", "median_chroma").alias("highest_chroma_day"))
    return mode.join(means, "year")
