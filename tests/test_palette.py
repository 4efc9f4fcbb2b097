import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from huetide.operators import cluster, palette
from huetide.operators import evidence as ev
from huetide.plans import proofs
from huetide.sources import files
from huetide.sources.fixtures import Views


def image(rgb, alpha=None):
    """A row as Spark's image source gives it."""
    rgb = np.asarray(rgb, dtype=np.uint8)
    h, w, _ = rgb.shape
    channels = [rgb[..., 2], rgb[..., 1], rgb[..., 0]] + ([] if alpha is None else [np.asarray(alpha, dtype=np.uint8)])
    return h, w, len(channels), np.stack(channels, axis=2).tobytes()


SCHEMA = "image_id long, image struct<height: int, width: int, nChannels: int, data: binary>"


def frame(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def test_pixels_of_the_visible_box(spark):
    rng = np.random.default_rng(1)
    rgb, alpha = rng.integers(0, 256, (9, 7, 3)), np.zeros((9, 7), dtype=int)
    alpha[2:6, 3:5] = rng.choice([10, 31, 32, 255], (4, 2))
    alpha[2, 3] = alpha[5, 4] = 1
    rows = files.pixels(frame(spark, image(rgb, alpha), image(rgb), (1, 2, 1, b"\x05\x07"), (2, 2, 3, b"short"), (2, 2, 4, bytes(16)), (0, 0, 3, b""), (2, 2, 3, None), None)).collect()
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in rows}
    assert len(rows) == len(got)
    assert {k[1:]: v for k, v in got.items() if k[0] == 0} == {(y - 2, x - 3): tuple(rgb[y, x]) for y in range(9) for x in range(7) if alpha[y, x] >= 32}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {(y, x): tuple(rgb[y, x]) for y in range(9) for x in range(7)}
    assert {k: v for k, v in got.items() if k[0] > 1} == {(2, 0, 0): (5, 5, 5), (2, 0, 1): (7, 7, 7)}


def test_pixels_take_time_as_their_number(spark):
    rng = np.random.default_rng(2)
    for side in (64, 256, 1024):
        df = frame(spark, image(rng.integers(0, 256, (side, side, 3))))
        began = time.monotonic()
        assert files.pixels(df).count() == side * side
        assert time.monotonic() - began < 20
    one = image(rng.integers(0, 256, (1024, 1024, 3)))
    began = time.monotonic()
    rgb, seen, _, _ = files.decode(*one)
    assert time.monotonic() - began < 1 and (rgb.shape, seen.all()) == ((1024, 1024, 3), True)


def slow_kmeans(points, k):
    """Over all pixels, one by one."""
    mean = sum(points) / len(points)
    centres = [min(points, key=lambda p: ((p - mean) ** 2).sum())]
    while len(centres) < k:
        far = max(points, key=lambda p: min(((p - c) ** 2).sum() for c in centres))
        if min(((far - c) ** 2).sum() for c in centres) == 0:
            break
        centres.append(far)
    labels = None
    for _ in range(18):
        new = [min(range(len(centres)), key=lambda j: ((p - centres[j]) ** 2).sum()) for p in points]
        if new == labels:
            break
        labels = new
        for j in range(len(centres)):
            own = [p for p, x in zip(points, labels, strict=True) if x == j]
            if own:
                centres[j] = sum(own) / len(own)
    return centres, labels


def test_clusters_like_those_of_all_pixels():
    rng = np.random.default_rng(3)
    colours = rng.integers(0, 256, (40, 3))
    rgb = np.unique(colours, axis=0)[rng.integers(0, 40, 900) % len(np.unique(colours, axis=0))].reshape(30, 30, 3)
    flat = rgb.reshape(-1, 3)
    unique, back, count = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    got, own = palette.kmeans(palette.oklab(unique), count, 7)
    order = np.argsort(back.ravel(), kind="stable")
    want, said = slow_kmeans(list(palette.oklab(flat[order])), 7)
    assert np.allclose(got, want, atol=1e-9) and (own[back.ravel()[order]] == said).all()


def flood(cells):
    best, seen = 0, np.zeros_like(cells)
    for start in zip(*np.nonzero(cells), strict=True):
        todo, n = [start], 0
        while todo:
            y, x = todo.pop()
            if 0 <= y < cells.shape[0] and 0 <= x < cells.shape[1] and cells[y, x] and not seen[y, x]:
                seen[y, x], n = True, n + 1
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        best = max(best, n)
    return best


def test_largest_patch_like_flooding():
    rng = np.random.default_rng(4)
    for _ in range(300):
        cells = rng.random(rng.integers(1, 14, 2)) < rng.random()
        assert palette.largest_patch(cells) == flood(cells)
    ring = np.ones((9, 9), dtype=bool)
    ring[1:-1, 1:-1] = False
    ring[4, 4] = True
    assert palette.largest_patch(ring) == 32 and palette.largest_patch(np.zeros((3, 3), dtype=bool)) == 0


def test_images_of_a_small_file_are_dealt_over_tasks(spark):
    rows = proofs.images(Views(spark, "/root/testdata/sf0.001"))
    each = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(each) >= 4 and max(r["count"] for r in each) < rows.count() / 2


def painted(h, w, ground, *boxes):
    rgb = np.empty((h, w, 3), dtype=np.uint8)
    rgb[:] = ground
    for y0, x0, y1, x1, colour in boxes:
        rgb[y0:y1, x0:x1] = colour
    return rgb


@pytest.fixture(scope="module")
def painted_palettes(spark):
    buttons = [(25 + 110 * r, 25 + 150 * c, 36 + 110 * r, 44 + 150 * c, (0, 168, 255)) for r in range(5) for c in range(5)]
    clear = np.zeros((400, 600), dtype=int)
    clear[100:300, 200:400] = 255
    rows = [
        image(painted(400, 600, (244, 244, 244), (40, 40, 360, 300, (228, 55, 46)), (40, 300, 360, 560, (18, 91, 194)))),
        image(painted(400, 600, (9, 9, 9), (100, 200, 300, 400, (228, 55, 46))), clear),
        image(painted(400, 600, (255, 255, 255), (80, 120, 320, 480, (23, 167, 104)))),
        image(painted(600, 800, (255, 255, 255), *buttons)),
        image(np.random.default_rng(5).integers(0, 256, (300, 300, 3))),
        image(painted(5, 5, (1, 2, 3)), np.zeros((5, 5), dtype=int)),
    ]
    out = {}
    for r in palette.palettes(frame(spark, *rows)).withColumn("eligible", ev.eligible()).orderBy("image_id", "swatch_no").collect():
        out.setdefault(r.image_id, []).append(r)
    return rows, out


def test_colours_are_pixels_of_their_image(painted_palettes):
    rows, out = painted_palettes
    assert set(out) == {0, 1, 2, 3, 4}  # nothing can be seen of the last one
    for k, own in out.items():
        rgb, seen, _, _ = files.decode(*rows[k])
        there = {tuple(p) for p in rgb[seen].tolist()}
        assert all((r.r, r.g, r.b) in there for r in own) and sum(r.n for r in own) == seen.sum()
        assert abs(sum(r.share for r in own) - 1) < 1e-9 and abs(sum(r.salience for r in own) - 1) < 1e-9
        assert [r.swatch_no for r in own] == list(range(1, len(own) + 1)) and len(own) <= 7
    assert {(r.r, r.g, r.b) for r in out[0]} == {(244, 244, 244), (228, 55, 46), (18, 91, 194)}


def test_clear_ground_gives_no_colour(painted_palettes):
    assert [(r.r, r.g, r.b, r.share, r.border_share, r.coverage) for r in painted_palettes[1][1]] == [(228, 55, 46, 1.0, 1.0, 1.0)]


def test_white_border_is_background(painted_palettes):
    white, green = (next(r for r in painted_palettes[1][2] if r.r == v) for v in (255, 23))
    assert white.structural and not white.eligible and not green.structural and green.eligible
    assert abs(white.adjusted_share - 0.12 * white.share) < 1e-12 and white.border_share == 1.0


def test_small_scattered_colour_is_not_eligible(painted_palettes):
    blue = next(r for r in painted_palettes[1][3] if r.b == 255 and r.r == 0)
    assert blue.n == 25 * 11 * 19 and blue.component_share < 0.006 and not blue.structural


def test_pass_over_merges(spark):
    """The faults see what one pass in order gives; all apart and all together fail."""
    rows = [(1, 64, 0.9, 0.5, 0.0, 0.0), (1, 65, 0.8, 0.51, 0.0, 0.0), (1, 66, 0.7, 0.525, 0.0, 0.0), (1, 67, 0.6, 0.9, 0.0, 0.0), (2, 128, 0.9, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "image_id long, id long, strength double, ll double, la double, lb double")
    right = cluster.merge_swatches(df)
    assert {r.id: r.cluster for r in right.collect()} == {64: 64, 65: 64, 66: 66, 67: 67, 128: 128}
    wrong = lambda c: cluster.merge_faults(df, df.select("id", c.alias("cluster"))).first()[0]
    assert cluster.merge_faults(df, right).first()[0] == 0 and wrong(F.col("id")) > 0 and wrong(F.col("image_id") * 64) > 0
