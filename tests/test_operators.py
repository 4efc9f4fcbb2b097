import math

import pytest
from pyspark.sql import functions as F

from huetide.functions import color, urls
from huetide.operators import cluster, graph, leaders, ledger, pages

PURE = {"#FF0000": "Red", "#FF7F00": "Orange", "#FFFF00": "Yellow", "#7FFF00": "Chartreuse", "#00FF00": "Green", "#00FFFF": "Cyan", "#0000FF": "Blue", "#8000FF": "Violet", "#FF00FF": "Magenta"}


def colors(spark, hexes):
    rows = spark.createDataFrame([(k, h, float(len(hexes) - k)) for k, h in enumerate(hexes)], "id long, hex string, strength double")
    r, g, b = color.rgb_of("hex")
    return color.with_color(rows.select("id", "strength", F.lit("2024-01-01").cast("date").alias("day"), r.alias("r"), g.alias("g"), b.alias("b")))


def test_pure_hues_have_their_names(spark):
    got = {r.hex: r.family for r in colors(spark, list(PURE)).collect()}
    assert got == PURE


def test_hex_forms_and_inverse(spark):
    rows = spark.createDataFrame([("#abc",), ("0B5BC0",), (" #12345g",), (None,)], "h string").select(color.normalize_hex("h").alias("h"))
    assert [r.h for r in rows.collect()] == ["#AABBCC", "#0B5BC0", None, None]
    back = colors(spark, ["#0B5BC0", "#FFFFFF", "#102030"])
    r, g, b = color.rgb_from_oklab("ll", "la", "lb")
    assert all((x.r, x.g, x.b) == (x.r2, x.g2, x.b2) for x in back.select("r", "g", "b", r.alias("r2"), g.alias("g2"), b.alias("b2")).collect())


def test_three_blues_are_never_one_cluster(spark):
    rows = colors(spark, ["#0B5BC0", "#0E62BF", "#156FBE"])
    for policy in ("best", "first"):
        sizes = cluster.complete_linkage(rows, policy).groupBy("cluster").count().collect()
        assert max(r["count"] for r in sizes) < 3


def sequential(points, policy):
    clusters = []
    for p in sorted(points, key=lambda p: (-p.strength, p.id)):
        choice, least = None, math.inf
        for c in clusters:
            d = [math.dist((p.ll, p.la, p.lb), (m.ll, m.la, m.lb)) for m in c]
            if policy == "first":
                if all(m.chroma < 0.075 for m in c) == (p.chroma < 0.075) and max(d) <= (0.032 if p.chroma < 0.075 else 0.045):
                    choice = c
                    break
            elif max(d) <= (0.032 if p.chroma < 0.075 or any(m.chroma < 0.075 for m in c) else 0.045) and sum(d) / len(d) < least:
                choice, least = c, sum(d) / len(d)
        if choice is None:
            clusters.append([p])
        else:
            choice.append(p)
    return {p.id: c[0].id for c in clusters for p in c}


@pytest.mark.parametrize("policy", ["best", "first"])
def test_components_apart_equal_the_sequential_pass(spark, policy):
    hexes = [f"#{(k * 37) % 90 + 100:02X}{(k * 53) % 60 + 90:02X}{(k * 71) % 80 + 80:02X}" for k in range(120)]
    rows = colors(spark, hexes)
    got = {r.id: r.cluster for r in cluster.complete_linkage(rows, policy).collect()}
    assert got == sequential(rows.collect(), policy)


@pytest.mark.parametrize("policy", ["best", "first"])
def test_linkage_in_rounds_equals_the_sequential_pass(spark, policy):
    hexes = [f"#{(k * 37) % 40 + 100:02X}{(k * 53) % 30 + 90:02X}{(k * 71) % 50 + 80:02X}" for k in range(150)]
    rows = colors(spark, hexes)
    got = {r.id: r.cluster for r in cluster.complete_linkage(rows, policy, 40).collect()}
    assert got == sequential(rows.collect(), policy)


def test_suppression_equals_the_sequential_pass(spark):
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if (a * 7 + b * 13) % 9 == 0]
    rank = {k: (k * 17) % 11 for k in range(60)}
    kept = []
    for k in sorted(rank, key=lambda k: (rank[k], k)):
        if not any((min(k, o), max(k, o)) in set(pairs) for o in kept):
            kept.append(k)
    rows = spark.createDataFrame(list(rank.items()), "id long, rank long")
    got = graph.suppress(rows, spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.id for r in got.collect()) == sorted(kept)


def test_ties_pass_over_what_does_not_qualify(spark):
    rows = spark.createDataFrame([("d", "a", 72.0, 0.3), ("d", "b", 70.4, 0.3), ("d", "c", 60.0, 0.3), ("e", "x", 80.0, 0.4), ("e", "y", 70.0, 0.4)], "day string, family string, score double, uncertainty double")
    got = {(r.day, r.family) for r in leaders.ties(rows, ["day"]).collect()}
    assert got == {("d", "a"), ("d", "b"), ("e", "x")}
    margin = {(r.day, r.family): r.margin for r in leaders.margins(rows, ["day"]).collect()}
    assert margin["e", "x"] == 10.0 and margin["e", "y"] == 100.0


def test_publication_states(spark):
    rows = spark.createDataFrame([(1, 40, 6, 6, 3, 10, 1, 9.0), (2, 40, 30, 8, 3, 2, 0, 100.0), (3, 40, 30, 8, 3, 14, 0, 100.0), (4, 40, 30, 8, 3, 14, 1, 9.0)], "id int, active int, evidence int, domains int, stages int, baseline_days int, winners int, margin double")
    got = [r.state for r in rows.withColumns(leaders.publication_state()).orderBy("id").collect()]
    assert got == ["blocked", "review_only", "baseline_only", "ready"]


def test_dates_and_urls(spark):
    row = spark.createDataFrame([("HTTPS://Ex.org/a?utm_x=1&b=2&a=1&fbclid=q#f", "https://e.org/2024/02/31/x-20240105/2024-3-4")], "u string, d string")
    got = row.select(urls.canonical_url(F.col("u")).alias("c"), ledger.url_dates(F.col("d")).alias("d")).first()
    assert got.c == "https://ex.org/a?a=1&b=2" and [str(d) for d in got.d] == ["2024-01-05", "2024-03-04"]
    html = '<meta itemprop="datePublished" content="2024-02-30"><time datetime="2024-01-02"></time><time datetime="2024-01-03"></time>'
    page = pages.date_evidence(spark.createDataFrame([(1, html), (2, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.method, r.status) for r in page] == [("time", "ambiguous"), (None, "missing")]


def test_overlay_terms_are_found_anywhere_in_a_page(spark):
    from types import SimpleNamespace

    from huetide.plans import dated

    html = ["x" * 5000, "x" * 5000 + " " + ledger.OVERLAY_TERMS[0].upper(), ledger.OVERLAY_TERMS[-1] + "x" * 60_000]
    rows = spark.createDataFrame([(k, "https://e.org/", h) for k, h in enumerate(html)], "page_id long, dated_url string, html string")
    got = {r.page_id: r.status for r in dated.status_rows(SimpleNamespace(page_dates=rows)).select("page_id", "status").collect()}
    assert got[0] != "rejected_overlay" and got[1] == got[2] == "rejected_overlay"


def test_suppression_faults_are_counted(spark):
    rows = spark.createDataFrame([(k, k) for k in range(5)], "id long, rank long")
    pairs = spark.createDataFrame([(0, 1), (2, 1), (3, 4)], "a long, b long")
    kept = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    count = lambda *k: tuple(graph.suppression_faults(rows, pairs, *k).first())
    assert count() == count(kept(0, 2, 3)) == (0, 0)
    assert count(kept(0, 1, 2, 3)) == (2, 0)
    assert count(kept(0, 3)) == (0, 1)
    assert count(kept(0, 2, 4)) == (0, 1)


def test_region_conflicts_like_all_pairs(spark):
    import random

    rng = random.Random(6)
    rows = [(k, k % 3, None if k % 17 == 0 else [rng.choice((0, 10, 900)), rng.choice((0, 700)), rng.choice((300, 310, 1200)), rng.choice((200, 210))], None if k % 13 == 0 else rng.choice((0, 2**56 - 1, 2**40)) ^ (1 << rng.randrange(56)) ^ (1 << rng.randrange(56))) for k in range(60)]
    df = spark.createDataFrame([(k, p, b and tuple(b), h) for k, p, b, h in rows], "id long, page long, box struct<x: long, y: long, w: long, h: long>, dhash long")

    def same(a, b):
        if a[2] and b[2]:
            (x, y, w, h), (s, t, u, v) = a[2], b[2]
            inside = max(0, min(x + w, s + u) - max(x, s)) * max(0, min(y + h, t + v) - max(y, t))
            if inside / (w * h + u * v - inside) >= 0.82:
                return True
        return a[3] is not None and b[3] is not None and (a[3] ^ b[3]).bit_count() <= 8

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and same(a, b)}
    got = [(r.a, r.b) for r in graph.region_conflicts(df, ["page"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    images = df.selectExpr("id", "dhash", "CASE WHEN id % 4 > 0 THEN id % 11 END AS content")
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] is not None and b[3] is not None and (a[3] ^ b[3]).bit_count() <= 6}
    first = {}
    for k in range(60):
        if k % 4:
            first.setdefault(k % 11, k)
    near |= {(first[k % 11], k) for k in range(60) if k % 4 and first[k % 11] < k}
    assert {(r.a, r.b) for r in graph.image_conflicts(images).collect()} == near


def test_swatch_summary_like_candidates(spark):
    from huetide.operators import evidence

    rows = [(k % 4, f"a{k}", k % 5 if k % 7 else None, k % 3, k % 2, ("HOUSEHOLD", "BUILDING", "FURNITURE")[k % 3], k % 3 if k % 5 else None, ("benchmark", "discovery")[k % 2], 0.5 + k / 200, 0.01 * k, 0.005 * k, "Red") for k in range(60)]
    df = spark.createDataFrame(rows, "day int, actor string, domain int, sector int, stage int, scale string, platform int, panel string, confidence double, share double, component_share double, family string")
    one, two = (d.orderBy("day").collect() for d in (evidence.candidates(df, ["day"]), evidence.swatch_summary(df, ["day"], {"domain": range(5), "platform": range(3)})))
    assert [{c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in one] == [{c: round(v, 9) if isinstance(v, float) else v for c, v in r.asDict().items()} for r in two]
    plan = evidence.swatch_summary(df, ["day"], {"domain": range(5), "platform": range(3)})._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_near_colours_counted_by_colour(spark):
    rows = [(k % 2, k, f"c{k % 6}", 0.01 * (k % 6), 0.0, 0.0) for k in range(50)]
    df = spark.createDataFrame(rows, "day int, id long, hex string, ll double, la double, lb double")
    got = {r.day: (r.pairs, round(r.mean_distance, 9)) for r in graph.pair_statistics(df, ["day"], "hex", 0.025).collect()}
    for day in (0, 1):
        near = [abs(a[3] - b[3]) for a in rows for b in rows if a[0] == b[0] == day and a[1] < b[1] and abs(a[3] - b[3]) <= 0.025]
        assert got[day] == (len(near), round(sum(near) / len(near), 9))


def test_sql_functions_of_colours_and_hashes(spark):
    from huetide.functions import color, sql

    sql.register(spark)
    said = ["#E4372E", "0f8", " ##ABCDEF", "12345", "", None]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    hexes = color.normalize_hex("t")
    want = df.select(*[F.round(c, 9) for c in color.oklab(*color.rgb_of(hexes))]).collect()
    got = df.selectExpr("hex_to_oklab(t) AS p").selectExpr("round(p.l, 9)", "round(p.a, 9)", "round(p.b, 9)").collect()
    assert [tuple(r) for r in got] == [tuple(r) if t and len(t.strip().strip("#")) in (3, 6) else (None,) * 3 for r, t in zip(want, said, strict=True)]
    pairs = [("ff", "0", 8), ("0123456789abcdef0123", "123456789abcdef0122", 1), ("", "", None), ("a", None, None), ("f" * 80, "0", 320)]
    assert [r[0] for r in spark.createDataFrame([p[:2] for p in pairs], "a string, b string").selectExpr("hash_distance(a, b)").collect()] == [p[2] for p in pairs]


@pytest.mark.parametrize("leaders", [3, 256])
def test_suppression_without_pairs_equals_that_of_pairs(spark, leaders):
    rows = [(k, None if k == 50 else k * 17 % 11, None if k == 51 else k % 2, (k * 7 % 100, k * 13 % 100, 60 + k % 5 * 10, 60 + k % 7 * 10)) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, rank long, page long, box struct<x: long, y: long, w: long, h: long>")
    pairs = graph.box_pairs(df, ["page"], (40, 40), 7).where("iou >= 0.5")
    made = [(r.a, r.b) for r in pairs.collect()]
    assert len(made) == len(set(made))
    want = sorted(r.id for r in graph.suppress(df, pairs).collect())
    near, p = graph.overlap("p", "q")[0] >= 0.5, df.withColumnRenamed("box", "p")
    kept = graph.suppress_near(p, ["page"], near, leaders)
    assert sorted(r.id for r in kept.collect()) == want and 0 < len(want) < 150
    count = lambda *k: tuple(graph.suppression_faults_near(p, ["page"], near, *k).first())
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id long")
    for given in (kept, ids(*range(150)), ids(*want[::2])):
        assert count(given) == tuple(graph.suppression_faults(df, pairs, given).first())


def test_pairs_of_boxes_and_hashes_need_no_shuffle_of_pairs(spark):
    df = spark.range(300).selectExpr("id", "id % 2 AS page", "struct(id % 3 AS x, id % 5 AS y, 900L AS w, 900L AS h) AS box", "1L << CAST(id % 4 AS INT) AS dhash")
    for pairs in (graph.box_pairs(df, ["page"], (100, 100), 16), graph.hash_pairs(df, ["page"], 8, 56, 16), graph.region_conflicts(df, ["page"])):
        made = [(r.a, r.b) for r in pairs.collect()]
        assert len(made) == len(set(made)) == 2 * 150 * 149 // 2
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not plan.lstrip().startswith(("Aggregate", "Distinct", "Deduplicate"))


def test_rounding_goes_like_the_checking_sql(spark):
    import duckdb

    from huetide.plans.catalog import r6

    said = [k / 32 * (1 - 5 * d / 100) for k in range(1, 33) for d in range(11)] + [-0.5046875, 0.0, 1e9 + 0.1]
    got = [r.x for r in spark.createDataFrame([(x,) for x in said], "x double").select(*r6("x")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in said]


@pytest.mark.parametrize("policy", ["best", "first"])
@pytest.mark.parametrize("round_points", [60, 1000])
def test_linkage_goes_by_distinct_colours(spark, monkeypatch, policy, round_points):
    hexes = [f"#{k * 37 % 5 * 6 + 100:02X}{k * 53 % 3 * 7 + 90:02X}{k * 71 % 4 * 5 + 80:02X}" for k in range(400)]
    rows = colors(spark, hexes).withColumn("strength", F.col("id") * 31 % 97 + 1.0)
    made = []

    def seen(points, *rest):
        made.append(points.count())
        return graph.near_pairs(points, *rest)

    monkeypatch.setattr(cluster, "near_pairs", seen)
    got = {r.id: r.cluster for r in cluster.complete_linkage(rows, policy, round_points).collect()}
    assert got == sequential(rows.collect(), policy) and made == [len(set(hexes))] * (round_points < 400)


def test_swatches_are_not_shuffled_by_colour(spark):
    from huetide.sources.fixtures import Views
    from tests.conftest import SF

    plan = Views(spark, SF).colors._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_patches_of_masks_are_labelled_an_image_at_a_time(spark):
    spiral = ["########", ".......#", "######.#", "#....#.#", "#.##.#.#", "#.#..#.#", "#.####.#", "#......#"]
    masks = {5: spiral, 7: ["#" * 64] + ["#" + "." * 62 + "#"] * 62 + ["#" * 64], 8: ["#.#", ".#.", "#.."], 9: ["..", ".#"]}
    cells = {(k, y, x) for k, rows in masks.items() for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"}
    want, left = {}, set(cells)
    for first in sorted(cells):
        todo = [first] if first in left else []
        while todo:
            k, y, x = cell = todo.pop()
            if cell in left:
                left.discard(cell)
                want[cell] = first[0] * 4096 + first[1] * 64 + first[2]
                todo += [(k, y + 1, x), (k, y - 1, x), (k, y, x + 1), (k, y, x - 1)]
    df = spark.createDataFrame(sorted(cells) + [(None, 1, 1), (5, None, 1)], "image_id long, y long, x long")
    got = graph.mask_components(df)
    assert {(r.image_id, r.y, r.x): r.component for r in got.collect()} == want
    assert got.columns == ["image_id", "y", "x", "component"]
    assert "Join" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("leaders", [3, 256])
def test_suppression_by_hash_makes_no_pairs_of_all(spark, leaders):
    rows = [(k, None if k == 50 else k * 17 % 11, None if k == 51 else (k * 2654435761 % 2**20) if k % 3 else 5) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, rank long, dhash long")
    pairs = graph.hash_pairs(df.where("dhash is not null"), [], 5, 20)
    want = sorted(r.id for r in graph.suppress(df, pairs).collect())
    near, p = graph.hamming(F.col("p"), F.col("q")) <= 5, df.withColumnRenamed("dhash", "p")
    kept = graph.suppress_near(p, [], near, leaders)
    assert sorted(r.id for r in kept.collect()) == want and 0 < len(want) < 150
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id long")
    for given in (kept, ids(*range(150)), ids(*want[::2])):
        assert tuple(graph.suppression_faults_near(p, [], near, given).first()) == tuple(graph.suppression_faults(df, pairs, given).first())
    first = graph.suppress_near(p, [], near, leaders)._jdf.queryExecution().toString()
    assert "Window" not in first  # no task sorts all rows


def slow_kmeans(points, k, rounds):
    """(labels, shown) of one group's points (id, l, a, b), all of them in every round."""
    d = lambda p, c: round(math.dist(p[1:], c), 9)
    mean = lambda of: tuple(sum(p[j] for p in of) / len(of) for j in (1, 2, 3))
    centres = [min(points, key=lambda p: (d(p, mean(points)), p[0]))[1:]]
    while len(centres) < k and (far := [p for p in points if min(math.dist(p[1:], c) for c in centres) > 0]):
        centres.append(max(far, key=lambda p: (min(d(p, c) for c in centres), -p[0]))[1:])
    centres, labels = dict(enumerate(centres)), None
    for _ in range(rounds):
        new = {p[0]: min(centres, key=lambda c: (d(p, centres[c]), c)) for p in points}
        if new == labels:
            break
        labels = new
        centres = {c: mean([p for p in points if labels[p[0]] == c]) for c in set(labels.values())}
    members = {c: [p for p in points if labels[p[0]] == c] for c in centres}
    return labels, {(c, min(own, key=lambda p: (d(p, centres[c]), p[0]))[0], len(own)) for c, own in members.items()}


@pytest.mark.parametrize("rounds, few", [(1, 200_000), (18, 200_000), (18, 0)])
def test_kmeans_of_groups_goes_by_distinct_colours(spark, monkeypatch, rounds, few):
    grid = [(k, 7 + k % 3, k * 37 % 11 / 16, k * 53 % 5 / 16, k * k % 7 / 16) for k in range(600)]
    single = [(1000 + k, 20, 0.5, 0.25, 0.125) for k in range(3)] + [(2000 + k, 21, k % 2 / 4, 0.0, 0.0) for k in range(5)]
    rows = spark.createDataFrame([(key, id_, *lab) for id_, key, *lab in grid + single], "key long, id long, ll double, la double, lb double")
    stored = []

    def seen(df):
        out = graph.settled(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(cluster, "settled", seen)
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", few, raising=False)
    labels, shown = cluster.kmeans(rows, 3, rounds)
    labels, shown = labels.collect(), shown.collect()
    for key in (7, 8, 9, 20, 21):
        want = slow_kmeans([(id_, *lab) for id_, k, *lab in grid + single if k == key], 3, rounds)
        assert ({r.id: r.c for r in labels if r.key == key}, {(r.c, r.id, r.n) for r in shown if r.key == key}) == want
    colours = rows.select("key", "ll", "la", "lb").distinct().count()
    assert sum(stored) <= colours + 15 * len(stored) and colours < rows.count()  # colours once, then centres alone


def test_linkage_works_its_points_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = colors(spark, ["#0B5BC0", "#0E62BF", "#156FBE", "#0B5BC0"]).withColumn("chroma", F.udf(seen, "double")("chroma"))
    assert cluster.complete_linkage(rows, "first").count() == 4 and made.value == 4


def test_most_pairs_of_a_page_are_made_in_more_than_one_task(spark):
    few = "struct(id % 7 * 10 AS x, id % 5 * 10 AS y, 900L + id % 3 AS w, 900L AS h) AS box"
    df = spark.range(900).selectExpr("id", "id % 3 AS page", few, "CASE WHEN id % 4 > 0 THEN shiftleft(3L, CAST(id % 40 AS INT)) END AS dhash")
    boxes = {r.id: (r.page, r.box.x, r.box.y, r.box.w, r.box.h, r.dhash) for r in df.collect()}

    def over(a, b):
        (_, x, y, w, h, _), (_, s, t, u, v, _) = boxes[a], boxes[b]
        inside = max(0, min(x + w, s + u) - max(x, s)) * max(0, min(y + h, t + v) - max(y, t))
        return inside / (w * h + u * v - inside)

    two = [(a, b) for a in boxes for b in boxes if a < b and boxes[a][0] == boxes[b][0]]
    alike = lambda a, b: None not in (boxes[a][5], boxes[b][5]) and (boxes[a][5] ^ boxes[b][5]).bit_count() <= 2
    for step in ((100, 100), (2000, 2000)):  # a page met as a whole, and by cells
        near = graph.box_pairs(df, ["page"], step, 64, (0.95, 2.0))
        assert sorted((r.a, r.b, r.iou) for r in near.collect()) == [(a, b, over(a, b)) for a, b in two if over(a, b) >= 0.95]
    same = graph.region_conflicts(df, ["page"], 0.95, 2, block=64)
    assert sorted((r.a, r.b) for r in same.collect()) == [(a, b) for a, b in two if over(a, b) >= 0.95 or alike(a, b)]
    assert sum(len(p) > 0 for p in same.rdd.glom().collect()) > 1


def test_box_overlap_is_held_against_its_limits_as_rounded(spark):
    from types import SimpleNamespace

    from huetide.plans import shapes

    rows = [(k, "p", 500_001 * k, 0, 4_499_999, 9) for k in range(2)]  # 3,999,998 of 5,000,000, which is 0.8 to six places
    boxes = spark.createDataFrame(rows, "box_id long, page string, x long, y long, w long, h long")
    assert [(r.a, r.b, r.iou, r.inside) for r in shapes.box_overlap(SimpleNamespace(boxes=boxes)).collect()] == [(0, 1, 0.8, 0.888889)]


@pytest.mark.parametrize("policy", ["best", "first"])
def test_linkage_faults_are_counted(spark, monkeypatch, policy):
    hexes = [f"#{k * 37 % 40 + 100:02X}{k * 53 % 30 + 90:02X}{k * 71 % 50 + 80:02X}" for k in range(150)]
    rows = colors(spark, hexes)
    points = sorted(rows.collect(), key=lambda p: (-p.strength, p.id))
    right = sequential(points, policy)

    def slow(given):
        """Points not put where the pass puts them, those before being where they are said to be."""
        wrong, clusters = 0, {}
        for p in points:
            fits = []
            for k, c in clusters.items():
                d = [math.dist((p.ll, p.la, p.lb), (m.ll, m.la, m.lb)) for m in c]
                grey, kind = p.chroma < 0.075, all(m.chroma < 0.075 for m in c)
                if max(d) <= (0.032 if grey or (policy == "best" and any(m.chroma < 0.075 for m in c)) else 0.045) and (policy == "best" or kind == grey):
                    fits.append((sum(d) / len(d) if policy == "best" else len(fits), k))
            put = min(fits)[1] if fits else p.id
            wrong += given[p.id] != put
            clusters.setdefault(given[p.id], []).append(p)
        return wrong

    apart = {k: k for k in right}
    together = {k: points[0].id for k in right}
    moved = right | {points[-1].id: next(c for c in right.values() if c != right[points[-1].id])}
    count = lambda given, n: cluster.linkage_faults(rows, policy, given and spark.createDataFrame(list(given.items()), "id long, cluster long"), n).first()[0]
    assert count(None, 1000) == slow(right) == 0
    monkeypatch.setattr(cluster, "STEP", 40)
    monkeypatch.setattr(cluster, "_regions", lambda colours: colours.select("colour", F.lit(0).cast("long").alias("component")))
    for given in (right, apart, together, moved):
        assert count(given, 60) == slow(given) and (slow(given) > 0) == (given != right)
    assert count({k: c for k, c in right.items() if k != points[-1].id}, 1000) == 1
