"""Landed files and payloads as rows, and the archive's sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Provider: how title, url, published_at, image and creator are read from its payload, and what must hold.
PROVIDERS: dict[str, dict[str, str]] = {
    "museum_a": {"title": "title", "url": "objectURL", "image_url": "primaryImageSmall", "keep": "isPublicDomain = 'true' and image_url <> ''"},
    "museum_b": {"title": "title", "url": "api_link", "image_url": "image_id", "keep": "is_public_domain = 'true' and image_url <> ''"},
    "museum_c": {"title": "title", "url": "url", "image_url": "images.web.url", "keep": "image_url <> ''"},
    "search": {"title": "collectionName|trackName", "url": "collectionViewUrl|trackViewUrl", "published_at": "releaseDate", "image_url": "artworkUrl100", "keep": "image_url <> ''"},
    "releases": {"title": "title", "url": "id", "published_at": "first-release-date", "image_url": "id", "keep": "published_at rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"},
    "crafts": {"title": "title", "url": "url", "published_at": "creation_timestamp", "image_url": "images[0].url_570xN|images[0].url_fullxfull", "creator_id": "shop_id|user_id", "keep": "image_url <> ''"},
    "auctions": {"title": "title", "url": "itemWebUrl", "published_at": "itemCreationDate", "image_url": "image.imageUrl", "creator_id": "seller.username", "keep": "image_url <> ''"},
    "launches": {"title": "name", "url": "url", "published_at": "createdAt", "image_url": "thumbnail.url", "keep": "image_url <> ''"},
}


def _at(payload: Column, paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(payload, f"$.{p}" if "-" not in p else f"$['{p}']") for p in paths.split("|")])


def payload_items(payloads: DataFrame, provider: str) -> DataFrame:
    """Common item rows from a provider's landed payloads (columns id, payload); what fails its rule goes."""
    rule = PROVIDERS[provider]
    p = F.col("payload")
    fields = {name: _at(p, rule[name]) if name in rule else F.lit("") for name in ("title", "url", "published_at", "image_url", "creator_id")}
    if provider == "search":
        fields["image_url"] = F.regexp_replace(fields["image_url"], "100x100", "600x600")
    flags = {n: F.get_json_object(p, f"$.{n}") for n in ("isPublicDomain", "is_public_domain")}
    return payloads.withColumns(fields | flags).where(rule["keep"]).select("id", "title", "url", "published_at", "image_url", "creator_id")


def json_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """All JSON documents under several folders, each file once; unparsable ones are skipped.  Columns file and document (variant of text)."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(list(folders))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("document"))
    return rows.where("document is not null").dropDuplicates(["file"])


def submissions(rows: DataFrame, most: int) -> DataFrame:
    """Approved submissions with an image: true, yes or 1 in any case; the first ``most`` of each source by line."""
    ok = rows.where(F.lower(F.trim("approved")).isin("true", "yes", "1") & (F.coalesce("image_url", F.lit("")) != ""))
    place = F.row_number().over(Window.partitionBy("source").orderBy("line"))
    return ok.withColumn("place", place).where(F.col("place") <= most)


def submission_file(spark: SparkSession, path: str, most: int, source: str = "inbox") -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return submissions(rows.select("*", F.lit(source).alias("source"), F.monotonically_increasing_id().alias("line")), most)


def feed_items(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Items of RSS files: title, link, published, first image not seen in an earlier item; ``most`` of them by place."""
    schema = "title string, link string, pubDate string, updated string, description string, enclosure struct<_url:string,_VALUE:string>"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumn("line", F.monotonically_increasing_id())
    images = F.when(F.col("enclosure._url").isNotNull(), F.array("enclosure._url")).otherwise(F.array().cast("array<string>"))
    return _first_images(rows.select("line", "title", "link", F.coalesce("pubDate", "updated").alias("published"), images.alias("images"), F.col("description").alias("body")), most)


def atom_items(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Entries of Atom files, as ``feed_items`` gives those of RSS: the entry's address, when it was published (or updated), and its content's first new image."""
    schema = "title string, link array<struct<_href:string,_rel:string,_type:string>>, published string, updated string, summary string, content string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("charset", "UTF-8").schema(schema).load(path).withColumn("line", F.monotonically_increasing_id())
    enclosed = F.transform(F.filter("link", lambda x: (x["_rel"] == "enclosure") & x["_type"].startswith("image/")), lambda x: x["_href"])
    own = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    made = rows.select("line", "title", own.alias("link"), F.coalesce("published", "updated").alias("published"), F.coalesce(enclosed, F.array().cast("array<string>")).alias("images"), F.coalesce("content", "summary").alias("body"))
    return _first_images(made, most)


def _first_images(rows: DataFrame, most: int) -> DataFrame:
    """Items with the first of their images (enclosed ones, then those in the body) that no earlier item has; ``most`` by place."""
    inline = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r'<img[^>]*src="([^"]+)"'), F.lit(1))
    each = rows.select("line", "title", "link", "published", F.posexplode(F.concat("images", inline)).alias("pos", "image_url"))
    once = each.groupBy("image_url").agg(F.min_by(F.struct("line", "title", "link", "published", "pos"), F.struct("line", "pos")).alias("x")).select("image_url", "x.*")
    first = once.groupBy("line").agg(F.min_by(F.struct("title", "link", "published", "image_url"), "pos").alias("x")).select("line", "x.*")
    return first.orderBy("line").limit(most)


def archive(df: DataFrame, path: str) -> None:
    """Writes days as partitions; a day is replaced only by a write of that day that succeeds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def decode(height: int, width: int, channels: int, data: bytes | None, alpha: int = 32) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """Red, green and blue of the box that holds all that isn't fully transparent, which of its pixels can be seen, and the box's first row and column.

    Bytes stand as blue, green, red and, with four channels, alpha, row by row;
    one channel is grey.  A pixel with less than ``alpha`` isn't seen.  None for
    an image without bytes, with too few for its size, or fully transparent.
    """
    size = (height or 0) * (width or 0) * (channels or 0)
    if not size or data is None or len(data) < size or channels not in (1, 3, 4):
        return None
    raw = np.frombuffer(data, dtype=np.uint8, count=size).reshape(height, width, channels)
    rgb = np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]
    if channels < 4:
        return rgb, np.ones((height, width), dtype=bool), 0, 0
    through = raw[:, :, 3] > 0
    rows, columns = np.flatnonzero(through.any(axis=1)), np.flatnonzero(through.any(axis=0))
    if not len(rows):
        return None
    box = slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
    return rgb[box], raw[:, :, 3][box] >= alpha, int(rows[0]), int(columns[0])


def each_image(batches: Iterator[pa.RecordBatch], alpha: int) -> Iterator[tuple[pa.RecordBatch, tuple | None]]:
    """One-row batches and their decoded image."""
    for batch in batches:
        image = batch.column("image")
        parts = [image.field(c) for c in ("height", "width", "nChannels", "data")]
        for k in range(batch.num_rows):
            said = [p[k].as_py() for p in parts[:3]] if image[k].is_valid else [0, 0, 0]
            data = parts[3][k]
            yield batch.slice(k, 1), decode(*said, data.as_buffer() if data.is_valid else None, alpha)


#: Pixels in a row of batches that a task gives out at once.
_PIXELS = 1 << 18


def pixels(images: DataFrame, alpha: int = 32) -> DataFrame:
    """image_id, y, x, r, g, b of the pixels that can be seen, from rows image_id and image (as Spark's image source gives it).

    One pass over each image's bytes.  y and x count from the first row and
    column of the box that holds all that isn't fully transparent.  Images
    that ``decode`` can't read have no pixels; repeated rows are given each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, image in each_image(batches, alpha):
            if image is None:
                continue
            rgb, seen, _, _ = image
            at = np.flatnonzero(seen)
            for lo in range(0, len(at), _PIXELS):
                part = at[lo : lo + _PIXELS]
                y, x = np.divmod(part, seen.shape[1])
                colour = rgb[y, x].astype(np.int32)
                ids = row.column("image_id").take(pa.array(np.zeros(len(part), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array(c.astype(np.int32)) for c in (y, x, *colour.T)], names=["image_id", "y", "x", "r", "g", "b"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "image").mapInArrow(work, f"image_id {kind}, y int, x int, r int, g int, b int")


def write_document(rows: DataFrame, path: str, order: list[Column]) -> None:
    """``rows`` as one JSON array in a file, in order; the file is replaced by a rename, so a reader sees the old one or the new one whole.

    For a feed of days: rows are sorted over all tasks, and one task then
    writes their text in that order, a row at a time.
    """
    spark = rows.sparkSession
    names = rows.columns
    placed = rows.orderBy(*order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("said"), F.monotonically_increasing_id().alias("at"))
    end = spark.range(1).select(F.lit(None).cast("string"), F.lit((1 << 63) - 1).cast("long"))
    one = placed.unionAll(end).repartition(1).sortWithinPartitions("at").select("said")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            out = []
            for line in batch.column("said").to_pylist():  # the last row has none
                out.append(("[]" if mark == "[" else "]") if line is None else mark + line)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    made = f"{path}.{uuid.uuid4().hex}"
    one.mapInArrow(joined, "value string").write.text(made)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    folder, target = hadoop.Path(made), hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    choice = spark.sparkContext._gateway.new_array(rename, 1)
    choice[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(part, fs.makeQualified(target), choice)
    fs.delete(folder, True)


def public_feed(days: DataFrame, private: list[str], order: str = "date") -> DataFrame:
    """Ready days with private paths masked, newest first (by date)."""
    masked = {c: F.when(F.col(c).rlike("^(/|file:|[A-Za-z]:\\\\)"), "[private]").otherwise(F.col(c)) for c in private}
    return days.where("state = 'ready'").withColumns(masked).orderBy(F.desc(order))
