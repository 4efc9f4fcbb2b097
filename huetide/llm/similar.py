"""N-gram Jaccard join by pivots, and the components of its links.

Jaccard distance is a metric, but distances between texts stand close to 1, so
pivots drawn from the corpus can't part it: to almost all texts they are
equally far.  So the pivots that a text may be near are found first: in a fixed
order of shingles, two sets with a similarity of 3/4 have their first common
shingle within the first quarter of either, so a set is entered in the region
of each of those shingles and no link crosses regions.  The smaller set of a
link has it within its first seventh; a region without such an entry is empty.
Inside, every region has pivots; a set goes to the pivot it shares most
regions with (its Voronoi cell), and its exact distance to it links it or not.
Regions that still hold several components are joined again, with other
pivots, then without those pairs that lie in one component, or that sizes,
ranks, count sketches or the triangle inequality over a common pivot rule out;
what is left is compared exactly.

Common shingles come last in the order, so that a passage that many texts
share makes no region unless they have little else.  Equal sets are one node,
known by 128 bits; the document with the smallest id stands for it, and it
alone is entered in regions, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import table, written
from huetide.llm.repeats import window_hashes
from huetide.llm.tokens import SPACED, Words, chunks, mix

WORDS = 5
#: Links have 100 x common >= PERCENT x united; PERCENT 75 is a distance of 1/4.
PERCENT = 75
#: The order's common shingles: in COMMON texts of a sample of SAMPLE, at most MOST of them.
SAMPLE, COMMON, MOST = 4000, 4, 200_000
#: Document ids up to this number are sent to all executors (8 bytes each); more are joined by shuffling.
SEND = 500_000
#: Rows a task of a small step takes, and tasks such a step has at least.
TASK_ROWS, TASKS = 200_000, 12
LINKED = f"100 * common >= {PERCENT} * united"
#: Whether sizes and ranks of two entries of a region allow a link.
NEAR = "4 * least({0}n, {1}n) >= 3 * greatest({0}n, {1}n) and 7 * least({0}n - {0}at, {1}n - {1}at) >= 3 * ({0}n + {1}n)"
_U = np.uint64


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending hashes of each text's distinct shingles; of the whole sequence where words are fewer."""
    words = Words(texts, SPACED, lower=True)
    hashes, at = words.hashes(), words.offsets.tolist()
    grams, out = window_hashes(hashes, WORDS), []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo : hi - WORDS + 1]))
        else:
            out.append(mix(window_hashes(hashes[lo:hi], hi - lo) + _U(hi - lo)) if hi > lo else hashes[:0])
    return out


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n can hold the first one common with a similar set."""
    return n - -(-n * percent // 100) + 1 if n else 0


def ordered_prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order: rare ones by hash, then common ones by hash."""
    n = prefix_size(len(shingles))
    if len(common) and len(shingles):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate((shingles[~last], shingles[last]))
    return shingles[:n]


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of about n / 4 classes, modulo 256: classes differ no more than the sets do."""
    classes = 16
    while classes * 4 < len(shingles):
        classes *= 2
    return np.bincount((shingles & _U(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of the sets has."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(axis=0, dtype=np.uint8)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(axis=0, dtype=np.uint8)
    d = x - y
    return int(np.minimum(d, -d).astype(np.int64).sum())


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a whole set."""
    one = mix(shingles + _U(len(shingles)))
    sums = np.array([one.sum(dtype=np.uint64), mix(one ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64)
    return tuple(mix(sums).view(np.int64).tolist())


def _sets(sent):
    """doc_id, and of its set: 128 bits (hi, lo), size n, sketch, and the first shingles in the order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = shingle_sets(batch.column("text"))
                names = [_identity(s) if len(s) else (None, None) for s in sets]
                first = [ordered_prefix(s, common) for s in sets]
                ends = np.cumsum([0, *(len(p) for p in first)]).astype(np.int32)
                flat = np.concatenate(first) if first else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([h for h, _ in names], pa.int64()),
                        pa.array([w for _, w in names], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                    ],
                    names=["doc_id", "hi", "lo", "n", "sketch", "prefix"],
                )

    return emit


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in no more tasks than they need."""
    return df.coalesce(max(TASKS, -(-rows // TASK_ROWS)))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many texts of a bounded sample have, ascending; any list is right, a telling one makes small regions."""
    share = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(share)) == 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                got = shingle_sets(batch.column("text"))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["shingle"])

    rows = sample.select("text").mapInArrow(sets, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in rows.orderBy(F.desc("count"), "shingle").limit(MOST).select("shingle").collect()], dtype=np.int64).view(np.uint64))


def possible(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) that their count sketches don't rule out."""
    known = sets.select("doc", "n", "sketch")
    of = lambda side: known.toDF(side, f"n{side}", f"s{side}")
    both = sized(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb"), rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
            near = [7 * least_difference(x, y) <= n + m for n, m, x, y in zip(*columns, strict=True)]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(keep, "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents with the exact sizes of their sets' intersection (common) and union (united)."""
    rows = pairs.count()
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = F.broadcast(ids) if 2 * rows <= SEND else ids
    texts = docs.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    side = lambda s: texts.toDF(s, f"t{s}").hint("shuffle_merge")
    both = sized(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb"), 64 * rows)  # texts are wide

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "ta"):
                common, united = [], []
                for x, y in zip(shingle_sets(batch.column("ta")), shingle_sets(batch.column("tb")), strict=True):
                    common.append(len(np.intersect1d(x, y, assume_unique=True)))
                    united.append(len(x) + len(y) - common[-1])
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(united, pa.int64())], names=["a", "b", "common", "united"])

    return both.mapInArrow(compare, "a long, b long, common long, united long")


def components(edges: DataFrame) -> DataFrame:
    """v and its component's smallest vertex, for all vertices of edges (u, v): large and small stars in turn until nothing changes.

    Each round is written to the shared folder; the driver sees counts alone.
    A vertex with many neighbours is a key of partial minima and of joins
    that adaptive execution splits, never a group in one task.
    """
    edges, before = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges"), None
    rows = edges.count()
    while rows:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sized(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        edges = written(sized(sized(small, 2 * rows).distinct(), rows), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def _first(rank: Column, *columns: str) -> list[Column]:
    """Columns of the row with the smallest (rank, hash of doc), by aggregates of fixed size."""
    key = F.shiftleft(rank.cast("long"), 32) + F.pmod(F.xxhash64("doc"), F.lit(1 << 31))
    return [F.min_by(c, key).alias("pivot" if c == "doc" else f"pivot_{c}") for c in columns]


def _to_pivots(entries: DataFrame, pivots: DataFrame, keys: list[str]) -> DataFrame:
    """A pair (a, b) for each set that may be linked with pivots of its regions: with the one it meets most often."""
    met = entries.join(pivots, keys).where("doc <> pivot and " + NEAR.format("", "pivot_")).select("doc", "pivot")
    counts = met.repartition("doc").groupBy("doc", "pivot").count()
    most = F.max_by("pivot", F.shiftleft("count", 31) + F.pmod(F.xxhash64("pivot"), F.lit(1 << 31)))
    return counts.groupBy(F.col("doc").alias("a")).agg(most.alias("b"))


def _open(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries of regions with several components, with comp, and minor where that isn't the region's largest."""
    own = entries.select("shingle", "doc", "n", "at").join(comps, F.col("doc") == F.col("vertex"), "left")
    own = own.select("shingle", "doc", "n", "at", F.coalesce("component", "doc").alias("comp"))
    counts = own.groupBy("shingle", "comp").count()
    main = counts.groupBy("shingle").agg(F.max_by("comp", F.shiftleft("count", 31) + F.pmod(F.xxhash64("comp"), F.lit(1 << 31))).alias("main"), F.count("*").alias("comps"))
    return written(own.join(main.where("comps > 1").drop("comps"), "shingle").select(*own.columns, (F.col("comp") != F.col("main")).alias("minor")), "open")


def _rest(entries: DataFrame, distance: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components in a region that nothing rules out; none twice."""
    entries = entries.join(distance, "doc", "left")
    named = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("doc", "n", "at", "comp", "to", "d", "minor")]
    x, y = entries.where("minor").select("shingle", *named("x")), entries.select("shingle", *named("y"))
    apart = "xcomp <> ycomp and (not yminor or xdoc < ydoc) and not (coalesce(xto = yto, false) and abs(xd - yd) > 0.2500001) and " + NEAR.format("x", "y")
    return x.join(y, "shingle").where(apart).select(F.least("xdoc", "ydoc").alias("a"), F.greatest("xdoc", "ydoc").alias("b")).distinct()


def similar_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per input row (doc_id, n_shingles, component_id), and the compared pairs (a, b, common, united) of documents.

    component_id is the smallest doc_id that links reach.  Texts without words
    (null, empty, white space) have no shingles and are linked with nothing.
    Equal texts are linked.  A doc_id names one text: repeated rows get the
    same result each.  A row with null doc_id is linked with
    nothing and has a null component.  Other input columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(known))
    base = written(docs.mapInArrow(_sets(sent), "doc_id long, hi long, lo long, n long, sketch binary, prefix array<long>"), "base")
    sets = base.where("lo is not null and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"), F.first("n").cast("int").alias("n"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    sets = written(sets, "sets")
    many = sets.count()

    # regions with several sets, one of them with the shingle in its first seventh
    postings = sets.select("doc", "n", F.posexplode("prefix").alias("at", "shingle"))
    regions = postings.groupBy("shingle").agg(F.count("*").alias("rows"), F.max((7 * F.col("at") <= F.col("n")).cast("int")).alias("core"))
    shared = written(postings.join(regions.where("rows > 1 and core = 1").select("shingle"), "shingle"), "shared")
    # a pivot for each class of sizes; the fewest shingles before the region's: the fewest of its own, so it stands in the middle
    classed = shared.withColumn("class", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    pivots = classed.groupBy("shingle", "class").agg(*_first(F.col("at"), "doc", "n", "at"))
    first = written(compared(written(possible(_to_pivots(classed, pivots, ["shingle", "class"]), sets, many), "cells"), docs), "first")
    comps = components(first.where(LINKED).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # regions with several components: to other pivots of the main one, while that joins many; then all that is left, exactly
    distance = first.select(F.col("a").alias("doc"), F.col("b").alias("to"), (1 - F.col("common") / F.col("united")).alias("d"))
    checked, entries, before, turn = first, shared, None, 0
    while True:
        entries = _open(entries, comps)
        minors = entries.where("minor").agg(F.approx_count_distinct("doc")).first()[0]
        if not minors:
            break
        last, turn = before is not None and 2 * minors > before, turn + 1
        if last:
            pairs = _rest(entries, distance)
        else:
            main = entries.where("not minor").groupBy("shingle").agg(*_first(F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(1 << 20)), "doc", "n", "at"))
            pairs = _to_pivots(entries.where("minor"), main, ["shingle"])
        more = written(compared(written(possible(pairs, sets, many), "pairs"), docs), "checked")
        checked, before = checked.unionByName(more), minors
        links = more.where(LINKED).select(F.col("a").alias("u"), F.col("b").alias("v"))
        comps = components(comps.select(F.col("vertex").alias("u"), F.col("component").alias("v")).unionByName(links))
        if last:
            break
    # a document's component: of the document that stands for its set
    stands = sets.select("hi", "lo", "doc").join(comps, F.col("doc") == F.col("vertex"), "left").select("hi", "lo", F.coalesce("component", "doc").alias("component"))
    rows = base.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("hi", F.xxhash64("doc_id")).alias("hi"), F.coalesce("lo", F.xxhash64("doc_id", F.lit(1))).alias("lo"))  # without words: spread by id
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(stands, ["hi", "lo"], "left").select("doc_id", "n_shingles", component.alias("component_id")), checked


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return similar_documents(table(spark, sf_dir, "documents"))[0]
