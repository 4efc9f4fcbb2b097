from pyspark.sql import functions as F

from huetide.sources import files


def test_json_documents_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text('{"x": 1}')
    (tmp_path / "a/2.json").write_text("{broken")
    (tmp_path / "3.json").write_text("[1, 2]")
    assert files.json_documents(spark, str(tmp_path), str(tmp_path / "a")).count() == 2


def test_submission_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("approved,title,image_url\nyes,a,i1\nno,b,i2\nTRUE,c,\n1,d,i3\ntrue,e,i4\n")
    assert [r.title for r in files.submission_file(spark, str(tmp_path / "s.csv"), 2).orderBy("line").collect()] == ["a", "d"]


def test_feed_items(spark, tmp_path):
    items = '<item><title>a</title><link>l</link><pubDate>d</pubDate><enclosure url="i1"/></item><item><title>b</title><updated>u</updated><description>&lt;img src="i1"&gt;&lt;img src="i2"&gt;</description></item><item><title>c</title></item>'
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    got = files.feed_items(spark, str(tmp_path / "f.xml"), 10).orderBy("line").collect()
    assert [(r.title, r.published, r.image_url) for r in got] == [("a", "d", "i1"), ("b", "u", "i2")]


def test_archive_replaces_only_the_days_written(spark, tmp_path):
    out = str(tmp_path / "archive")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, n int")
    files.archive(rows, out)
    files.archive(rows.where("n = 2").withColumn("n", F.lit(5)), out)
    assert sorted((str(r.date), r.n) for r in spark.read.parquet(out).collect()) == [("2024-01-01", 1), ("2024-01-02", 5)]
