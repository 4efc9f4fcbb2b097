import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from huetide.functions import urls
from huetide.operators import ledger, pages
from huetide.sources import files

DAY = dt.date(2026, 9, 16)
ROW = "id long, source_id string, region string, dates array<date>, about string, event string, domain string, stage string, panel string, scale string, fingerprint string"


def record(k, dates=(), source="s", region="top", fingerprint="f1", about="x", event="campaign", domain="retail", stage="distribution", panel="benchmark", scale="institutional"):
    return (k, source, region, [dt.date.fromisoformat(d) for d in dates], about, event, domain, stage, panel, scale, fingerprint)


def test_records_against_a_nested_ledger(spark):
    seen, changed = dt.date(2026, 1, 2), dt.date(2026, 3, 4)
    nested = spark.createDataFrame(
        [("s", "f0", seen, seen, {"top": ("f1", seen, changed), "none": None, "blank": (None, seen, seen), "undated": ("f1", None, None)}), ("t", "f1", changed, changed, {})],
        "source_id string, fingerprint string, first_seen date, last_changed date, regions map<string, struct<fingerprint: string, first_seen: date, last_changed: date>>",
    )
    rows = [
        record(0), record(1, fingerprint="f2"), record(2, source="t"), record(3, source="nobody"), record(4, region="none"), record(5, region="blank"), record(6, region="undated"),
        record(7, ["2026-09-18", "2026-09-17", "2026-09-01"]), record(8, about="please Sign In"), record(9, event="archive"), record(10, ["2026-09-01"], event="archive"), record(11, panel="discovery"),
        record(12, ["2026-09-10"]), record(13, ["2026-09-10"], domain="art"), record(14, ["2026-09-10"], event="exhibition-opening"), record(15, ["2026-09-13"], event="newly-listed"), record(16, ["2026-09-14", "2026-01-01"]),
    ]
    out = ledger.temporal_records(spark.createDataFrame(rows, ROW), ledger.flat_ledger(nested), F.lit(DAY)).orderBy("id").collect()
    got = {r.id: (r.status, "; ".join(r.reasons), r.first_seen, r.last_changed, r.level) for r in out}
    assert len(out) == len(rows) and {r.last_seen for r in out} == {DAY} and all(len(r.reasons) == 1 for r in out)
    assert got[0] == ("baseline_only_unchanged", "undated, fingerprint unchanged", seen, changed, "region")
    assert got[1] == ("eligible_changed_today", "undated, fingerprint changed", DAY, DAY, "region")
    assert got[2] == ("baseline_only_unchanged", "undated, fingerprint unchanged", changed, changed, "source")
    assert got[3] == ("calibration_only_undated", "undated, seen for the first time", DAY, DAY, "none")
    assert got[4][0] == "eligible_changed_today" and got[4][4] == "source"  # the region is null: the source's f0
    assert got[5] == ("calibration_only_undated", "undated, seen for the first time", DAY, DAY, "region")
    assert got[6][2:] == (DAY, DAY, "region")
    assert {k: got[k][:2] for k in range(7, 17)} == {
        7: ("rejected_future", "dated later: 2026-09-18, 2026-09-17"), 8: ("rejected_overlay", "text of an overlay"), 9: ("context_only_historical", "historical and undated"),
        10: ("context_only_historical", "historical, no date of these days"), 11: ("context_only_undated", "needs a date"), 12: ("baseline_only_stale", "6 days old, 2 allowed"), 13: ("context_only_stale", "6 days old, 2 allowed"),
        14: ("eligible_current", "within 45 days"), 15: ("eligible_current", "within 3 days"), 16: ("eligible_current", "within 2 days"),
    }
    none = ledger.temporal_records(spark.createDataFrame(rows, ROW), ledger.flat_ledger(nested.where("false")), F.lit(DAY))
    assert {r.level for r in none.collect()} == {"none"}


def test_fingerprints(spark):
    said = [({"phash": "p", "content_hash": "c"}, None), ({"phash": "p", "content_hash": ""}, b"x"), ({}, b"bytes"), ({"other": "x"}, None), (None, None)]
    df = spark.createDataFrame([(m, None if c is None else bytearray(c)) for m, c in said], "m map<string, string>, c binary")
    got = [r[0] for r in df.select(urls.fingerprint(F.col("m"), F.col("c"), F.lit("a \"b\"\n"), F.lit("https://e.org/ä"), F.lit("#FFF"), F.lit(None).cast("string"))).collect()]
    named = hashlib.sha256(json.dumps({"source": 'a "b"\n', "url": "https://e.org/ä", "hex": "#FFF", "region": ""}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert got == ["c", "p", hashlib.sha256(b"bytes").hexdigest(), named, named]


def test_who_votes(spark):
    schema = "item_adapter boolean, platform string, source_id string, source_name string, source_creator string, page_url string, region_id string, item_id string, meta_creator string, meta_name string, meta_verified boolean"
    rows = [
        (True, "shop", "s", "S", None, "https://E.org/a?utm_q=1", "r", None, " c ", None, True),
        (True, None, "s", "S", "x", None, "r", "", "c", "N", True),
        (True, "shop", "s", "S", None, None, None, None, "c", "N", False),
        (True, "shop", "s", "S", None, None, "r", "i", None, "N", True),
        (False, "shop", "s", "S", None, None, "r", "i", "c", "N", None),
        (False, "shop", "s", "S", "x", None, "r", "i", "c", "N", None),
    ]
    got = [(r.actor_id, r.actor_name, r.creator_id, r.identity_verified, r.item_id) for r in pages.item_identity(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [("shop:c", "S", "shop:c", True, "https://e.org/a"), ("s:c", "N", "s:c", True, "r"), ("publisher:s", "S", "", False, ""), ("publisher:s", "S", "", False, "i"), ("s", "S", "s", True, "i"), ("x", "S", "x", True, "i")]


def test_a_feed_is_one_document(spark, tmp_path):
    path = f"{tmp_path}/feed.json"
    rows = spark.range(5000).select(F.date_add(F.lit(DAY), -F.col("id").cast("int")).cast("string").alias("date"), F.when(F.col("id") % 2 == 0, 'a "b"\n').alias("name")).repartition(7)
    files.write_document(rows, path, [F.desc("date")])
    said = json.loads((tmp_path / "feed.json").read_text())
    assert [r["date"] for r in said] == [str(DAY - dt.timedelta(k)) for k in range(5000)] and said[0]["name"] == 'a "b"\n' and said[1]["name"] is None
    files.write_document(rows.where("false"), path, [F.desc("date")])  # in place of the old one
    assert json.loads((tmp_path / "feed.json").read_text()) == [] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["feed.json"]


def test_health_lists(spark):
    rows = [("a", "d", "timeout", 0), ("a", "d", "budget_spent", 2), ("b", "d", "complete", 3), ("c", None, "complete", 1), ("a", "d", "complete", None)]
    late, gave = ledger.health_lists(spark.createDataFrame(rows, "source_id string, domain string, status string, regions long"))
    assert [tuple(r) for r in late.collect()] == [("a", 2)] and {tuple(r) for r in gave.collect()} == {("d", 2, 5), (None, 1, 1)}
