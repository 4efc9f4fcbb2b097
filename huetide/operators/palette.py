"""The palette of an image: its colours clustered, measured on the image, and near ones merged.

A task works image by image.  Clustering runs over an image's distinct colours,
weighted by how often they stand, which is clustering over all its pixels;
every colour of a palette is one that the image has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huetide.functions import color
from huetide.operators.cluster import merge_swatches
from huetide.operators.evidence import palette_rank
from huetide.sources.files import each_image

COLOURS, ROUNDS = 7, 18
#: Cells of the longer side on which a colour's patches are told apart; a cell belongs to a colour that covers a quarter of it.
GRID, COVERED = 88, 0.25
MEASURES = "label int, r int, g int, b int, n long, share double, edge_share double, component_share double, coverage double, border_share double"


def oklab(rgb: np.ndarray) -> np.ndarray:
    """OKLab of rows of channels from 0 to 255."""
    c = rgb.astype(float) / 255.0
    light = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    return np.cbrt(light @ np.array(color.TO_CONE).T) @ np.array(color.TO_LAB).T


def kmeans(points: np.ndarray, weight: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of weighted points: from the point nearest the mean, each next centre is the point farthest from those before (the first of equals)."""
    away = lambda centre: ((points - centre) ** 2).sum(axis=1)
    centres = [points[int(away(np.average(points, axis=0, weights=weight)).argmin())]]
    least = away(centres[0])
    while len(centres) < k and least.max() > 0:
        centres.append(points[int(least.argmax())])
        least = np.minimum(least, away(centres[-1]))
    centres, labels = np.array(centres), None
    for _ in range(rounds):
        new = np.stack([away(c) for c in centres], axis=1).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        total = np.bincount(labels, weight, len(centres))
        for axis in range(3):
            moved = np.bincount(labels, weight * points[:, axis], len(centres))
            centres[:, axis] = np.where(total > 0, moved / np.maximum(total, 1), centres[:, axis])
    return centres, labels


def largest_patch(cells: np.ndarray) -> int:
    """Cells of the largest patch of True that hangs together by sides: runs of each row are joined with those they touch above."""
    root: list[int] = []
    size: list[int] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    rim = np.zeros((cells.shape[0], cells.shape[1] + 2), dtype=bool)
    rim[:, 1:-1] = cells
    y, x = np.nonzero(rim[:, 1:] != rim[:, :-1])  # where runs begin and end, by turns
    above: list[tuple[int, int, int]] = []
    own: list[tuple[int, int, int]] = []
    at = -1
    for row, a, b in zip(y[::2].tolist(), x[::2].tolist(), x[1::2].tolist(), strict=True):
        if row != at:
            above, own, at = own if row == at + 1 else [], [], row
        k = len(root)
        root.append(k)
        size.append(b - a)
        for c, d, other in above:
            if c < b and a < d and (top := find(other)) != find(k):
                size[top] += size[find(k)]
                root[find(k)] = top
        own.append((a, b, k))
    return max((size[k] for k in range(len(root)) if root[k] == k), default=0)


def edges(rgb: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How much each pixel's grey differs from its eight neighbours', 0 to 1; nothing on the outermost ones.  What isn't seen counts as white."""
    grey = (rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) >> 16  # fixed values: weights of the channels
    grey[~seen] = 255
    out = np.zeros(grey.shape)
    if min(grey.shape) > 2:
        around = sum(grey[1 + dy : grey.shape[0] - 1 + dy, 1 + dx : grey.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * grey[1:-1, 1:-1] - around, 0, 255) / 255
    return out


def measure(rgb: np.ndarray, seen: np.ndarray, k: int = COLOURS) -> list[tuple]:
    """MEASURES of each colour of a decoded image."""
    if not seen.any():
        return []
    packed, back, count = np.unique(rgb[seen].astype(np.int64) @ np.array([65536, 256, 1]), return_inverse=True, return_counts=True)
    colours = np.stack((packed >> 16, packed >> 8 & 255, packed & 255), axis=1)
    points = oklab(colours)
    centres, labels = kmeans(points, count, k)
    pixel = labels[back]
    h, w = seen.shape
    n = len(centres)
    map_ = np.full((h, w), n)
    map_[seen] = pixel
    total = np.bincount(pixel, minlength=n)
    drawn = edges(rgb, seen)[seen]
    drawn_by = np.bincount(pixel, drawn, n) / (drawn.sum() or 1.0)
    border = np.zeros((h, w), dtype=bool)
    border[[0, -1]] = True
    border[:, [0, -1]] = True
    border_by = np.bincount(map_[border], minlength=n + 1)[:n]
    # four by four cells: a colour is in one if it has 2 % of what can be seen there, and three pixels
    quarter = np.searchsorted([round(j * h / 4) for j in range(1, 4)], np.arange(h), "right")[:, None] * 4 + np.searchsorted([round(j * w / 4) for j in range(1, 4)], np.arange(w), "right")
    in_cell = np.bincount((quarter * (n + 1) + map_).ravel(), minlength=16 * (n + 1)).reshape(16, n + 1)[:, :n]
    there = in_cell.sum(axis=1)
    present = (in_cell >= np.maximum(3, (there * 0.02).astype(np.int64))[:, None]) & (there > 0)[:, None]
    scale = min(1.0, GRID / max(h, w))
    rows, columns = max(1, round(h * scale)), max(1, round(w * scale))
    cell = (np.arange(h) * rows // h)[:, None] * columns + np.arange(w) * columns // w
    full = np.bincount(cell.ravel(), minlength=rows * columns)
    on = np.bincount((map_ * (rows * columns) + cell).ravel(), minlength=(n + 1) * rows * columns).reshape(n + 1, rows, columns)
    out = []
    for j in range(n):
        if not total[j]:
            continue
        shown = colours[int(((points - centres[j]) ** 2).sum(axis=1).argmin())]
        patch = largest_patch(on[j] >= np.maximum(1, COVERED * full.reshape(rows, columns)))
        cells = int((there > 0).sum())
        out.append((j, *shown.tolist(), int(total[j]), total[j] / total.sum(), float(drawn_by[j]), patch / (rows * columns), int(present[:, j].sum()) / cells, border_by[j] / max(1, border_by.sum())))
    return out


def background() -> Column:
    """A neutral colour that fills much of the image and of its border, without many edges unless it is nearly all of it."""
    loose = (F.col("share") >= 0.18) & (F.col("border_share") >= 0.42) & (F.col("edge_share") <= F.greatest(F.lit(0.08), 0.72 * F.col("share")))
    return F.col("neutral") & (((F.col("share") >= 0.30) & (F.col("border_share") >= 0.70)) | loose)


def image_palettes(images: DataFrame, colours: int = COLOURS, alpha: int = 32) -> DataFrame:
    """The palette of each image (rows image_id and image, as Spark's image source gives it): at most ``colours`` rows an image, by rank.

    Besides the measures: hex, OKLab, chroma, hue, family and neutral of the
    colour, structural, adjusted_share, salience (a share of the image's) and
    swatch_no.  Images that can't be read or seen have no palette; image_id is
    taken to be distinct.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEASURES.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in MEASURES.split(", ")]
        for row, image in each_image(batches, alpha):
            found = measure(image[0], image[1], colours) if image else []
            if found:
                ids = row.column("image_id").take(pa.array([0] * len(found)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True))], names=["image_id", *names])

    kind = images.schema["image_id"].dataType.simpleString()
    rows = images.select("image_id", "image").mapInArrow(work, f"image_id {kind}, {MEASURES}")
    ll, la, lb = color.oklab("r", "g", "b")
    rows = rows.withColumns({"hex": color.hex_of("r", "g", "b"), "ll": ll, "la": la, "lb": lb})
    rows = rows.withColumns({"chroma": color.chroma("la", "lb"), "hue": color.hue("la", "lb")})
    rows = rows.withColumns({"family": color.family("ll", "chroma", "hue"), "neutral": F.col("chroma") < color.NEUTRAL})
    rows = rows.withColumn("structural", background()).withColumn("adjusted_share", F.col("share") * F.when(F.col("structural"), 0.12).otherwise(1.0))
    raw = 0.40 * F.col("adjusted_share") + 0.25 * F.col("edge_share") + 0.20 * F.col("component_share") + 0.15 * F.col("coverage")
    one = Window.partitionBy("image_id")  # a palette's rows
    rows = rows.withColumn("raw", raw).withColumn("salience", F.col("raw") / F.greatest(F.sum("raw").over(one), F.lit(1e-12))).drop("raw")
    return rows.withColumn("swatch_no", F.row_number().over(one.orderBy(F.desc(palette_rank()), "label")))


def merged(swatches: DataFrame) -> DataFrame:
    """One row for each image and ``cluster`` of near swatches, with swatch_no by rank: the swatch nearest to the others stands for all.

    Takes image_id, cluster, swatch_no, r, g, b, ll, la, lb, n, share,
    adjusted_share, salience, component_share, coverage, border_share and
    structural.  The swatch that stays has the least distance to the others,
    each weighted by its pixels (the lower number of equals).  Shares, salience
    and pixels are summed, a null adjusted share counting as the share; patch
    and coverage are the largest; the border share is weighted by share; the
    whole is background if 70 % of its pixels are.  A swatch alone stays as it is.
    """
    weight = lambda s: F.greatest(F.lit(1).cast("long"), s["n"])
    away = lambda x, y: color.distance((x["ll"], x["la"], x["lb"]), (y["ll"], y["la"], y["lb"]))
    own = ["r", "g", "b", "ll", "la", "lb", "n"]
    all_ = F.collect_list(F.struct("swatch_no", *own)).alias("all")  # a palette's rows at most
    share = F.sum("share")
    rows = swatches.groupBy("image_id", "cluster").agg(
        all_, F.count("*").alias("swatches"), F.sum("n").alias("pixels"), share.alias("share"),
        F.when(F.count("*") == 1, F.max("adjusted_share")).otherwise(F.sum(F.coalesce("adjusted_share", "share"))).alias("adjusted_share"),
        F.sum("salience").alias("salience"), F.max("component_share").alias("component_share"), F.max("coverage").alias("coverage"),
        F.when(F.count("*") == 1, F.max("border_share")).otherwise(F.sum(F.col("border_share") * F.col("share")) / F.greatest(share, F.lit(1e-9))).alias("border_share"),
        F.when(F.count("*") == 1, F.bool_or("structural")).otherwise(F.coalesce(F.sum(F.when(F.col("structural"), F.col("n"))), F.lit(0)) / F.greatest(F.lit(1), F.sum("n")) >= 0.70).alias("structural"),
    )
    cost = lambda x: F.round(F.aggregate("all", F.lit(0.0), lambda a, y: a + away(x, y) * weight(y)), 9)
    best = F.array_min(F.transform("all", lambda x: F.struct(cost(x).alias("cost"), x["swatch_no"].alias("swatch_no"), *[x[c].alias(c) for c in own if c != "n"])))
    rows = rows.withColumn("best", best).select("image_id", "cluster", *[F.col(f"best.{c}").alias(c) for c in own if c != "n"], F.col("pixels").alias("n"), "swatches", *[c for c in rows.columns if c not in ("image_id", "cluster", "all", "swatches", "pixels")])
    return rows.withColumn("swatch_no", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.round(palette_rank(), 9)), "r", "g", "b")))


def palettes(images: DataFrame, colours: int = COLOURS) -> DataFrame:
    """Palettes of images with near colours merged."""
    rows = image_palettes(images, colours)
    rows = rows.withColumn("id", F.col("image_id") * 64 + F.col("swatch_no"))
    clusters = merge_swatches(rows.select("image_id", "id", palette_rank().alias("strength"), "ll", "la", "lb"))
    return merged(rows.join(clusters, "id"))
