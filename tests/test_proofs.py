import pytest
from pyspark.sql import functions as F

from huetide.functions import sql as functions
from huetide.functions import urls
from huetide.operators import ledger, pages, panel
from huetide.sources import files
from huetide.streaming import jobs


def test_more_mandatory_sources_than_asked_for_is_an_error(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(6)], "actor long, domain long")
    assert panel.rotation(rows, "2024-01-01", 4, F.col("actor") < 2).count() == 4
    with pytest.raises(ValueError, match="mandatory"):
        panel.rotation(rows, "2024-01-01", 2, F.col("actor") < 3)


def test_inherits_the_first_value_that_is_not_empty(spark):
    index = spark.createDataFrame([(1, "n", ""), (2, "n", "second"), (3, "n", "third")], "id long, name string, kind string")
    records = spark.createDataFrame([(9, "n", None), (2, "n", " "), (9, "x", None), (9, "n", "own")], "id long, name string, kind string")
    assert [r.kind for r in ledger.inherit(records, index, ["kind"]).orderBy(F.coalesce("kind", F.lit("zz"))).collect()] == ["own", "second", "second", None]


def test_dates_in_urls_and_fields(spark):
    texts = ["https://e.org/2024/01/05/x", "https://e.org/20240229-a", "https://e.org/2023-02-29", "https://e.org/2024_1/7?d=2024-13-01", "https://e.org/120240105", "x"]
    row = spark.createDataFrame([(t,) for t in texts], "u string").select(F.transform(ledger.url_dates(F.col("u")), lambda d: d.cast("string")).alias("d"))
    assert [r.d for r in row.collect()] == [["2024-01-05"], ["2024-02-29"], [], ["2024-01-07"], [], []]


def test_written_dates(spark):
    said = {"January 5th, 2024": "2024-01-05", "5 Sept. 2024": "2024-09-05", "June 31, 2024": None, "Dec 9 2023": "2023-12-09", "may 1, 2024": "2024-05-01"}
    got = spark.createDataFrame([(t,) for t in said], "t string").select(pages.written_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == list(said.values())


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
 <entry><title>one</title><link href="https://e.org/1"/><link rel="enclosure" type="image/png" href="i1"/><updated>u1</updated>
  <content type="html">&lt;img src="i9"&gt;</content></entry>
 <entry><title>two</title><link rel="alternate" href="https://e.org/2"/><published>p2</published><summary>&lt;img src="i1"&gt; &lt;img src="i2"&gt;</summary></entry>
 <entry><title>three</title><link href="https://e.org/3"/></entry></feed>"""
    )
    got = files.atom_items(spark, str(tmp_path), 10).collect()
    assert [(r.title, r.link, r.published, r.image_url) for r in got] == [("one", "https://e.org/1", "u1", "i1"), ("two", "https://e.org/2", "p2", "i2")]


def test_pixels_of_image_files(spark, tmp_path):
    data = bytes([1, 2, 3, 255, 4, 5, 6, 31])
    image = spark.createDataFrame([(7, 1, 2, 4, data), (8, 1, 1, 3, bytes([9, 8, 7]))], "image_id long, height int, width int, nChannels int, data binary").select("image_id", F.struct("height", "width", "nChannels", "data").alias("image"))
    assert sorted(tuple(r) for r in files.pixels(image).collect()) == [(7, 0, 0, 3, 2, 1), (8, 0, 0, 7, 8, 9)]


def test_aliases_and_sql_functions(spark):
    rows = spark.createDataFrame([('{"Name": "", "TITLE": "t"}',), ('{"name": "[]"}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in rows.select(urls.json_alias(F.col("j"), "name", "title")).collect()] == ["t", None, None, None]
    functions.register(spark)
    assert spark.sql("SELECT slug(' A--b ') AS s, hex_of(255, 0, 16) AS h, url_host('https://E.org/x') AS u").first().asDict() == {"s": "a-b", "h": "#FF0010", "u": "e.org"}


def test_admission_over_several_batches(spark, tmp_path):
    """Every event is routed once, late ones are listed besides, and nothing depends on how many batches there are."""
    seconds = [k * 3600 for k in range(480)]
    for n, part in enumerate((seconds[:200], seconds[200:], seconds[:10])):
        rows = [(n * 1000 + k, s + 1_704_000_000, 1, "view" if k % 2 else "error", 0.0, "{}") for k, s in enumerate(part)]
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("s"))
        df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once = jobs.drain_admission(spark.readStream.schema(jobs.SCHEMA).parquet(str(tmp_path / "in")), "2024-01-10")
    stream = spark.readStream.schema(jobs.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    many = jobs.drain_admission(stream, "2024-01-10")
    for name in ("eligible", "context", "rejected"):
        assert sorted(r.event_id for r in many[name].collect()) == sorted(r.event_id for r in once[name].collect())
    assert sum(many[n].count() for n in ("eligible", "context", "rejected")) == 490
    assert {r.event_id for r in many["late"].collect()} >= {2000, 2009} and once["late"].count() == 0
