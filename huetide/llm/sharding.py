"""Sharding by histogram sort.

Rows are ordered by a key, and shards are stretches of that order with nearly
equal bytes.  The cuts between them come from histograms: every pass counts the
exact bytes and rows below 4096 candidate boundaries inside the stretch of keys
that still holds a cut, and the next pass looks between the two boundaries
around it.  A cut is settled when a boundary is within the tolerance of its
share; rows are then exchanged once, by their shard and key.

The key is the text's digest, then doc_id, then the row itself: equal texts
stand together, and one text, or one document, that holds a third of all rows
is cut inside all the same.  Everything is column expressions; the driver gets
bin counts only, at most 4096 a cut and pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, written

SHARDS = 24
#: A cut may miss its share of the bytes by this part of a shard; where no boundary is so close, the closest is taken.
TOLERANCE = 0.001
#: Bits that one pass tells apart.
STEP = 12
#: Rows of the exchange that a task sorts, about.
TASK_ROWS = 1 << 20

#: The parts of the key, first to last: column, its width in bits.  All are signed longs; the digest has no sign.
KEY = (("_digest", 60), ("_doc", 64), ("_row", 64))
#: What each pass looks at: column, bits cut off at the right, bits looked at.
LEVELS = [(name, max(0, width - STEP * (k + 1)), min(STEP, width - STEP * k)) for name, width in KEY for k in range(-(-width // STEP))]

MADE = "size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


class _Stretch:
    """Rows whose first key parts are ``fixed`` and whose next one, without its lower bits, is ``prefix`` (None: any)."""

    def __init__(self, fixed: tuple[int, ...] = (), prefix: int | None = None):
        self.fixed, self.prefix = fixed, prefix

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Stretch) and (self.fixed, self.prefix) == (other.fixed, other.prefix)

    def __hash__(self) -> int:
        return hash((self.fixed, self.prefix))

    def holds(self, level: int) -> Column:
        """Whether a row lies in it; ``level`` is the pass that looks inside."""
        name, shift, bits = LEVELS[level]
        inside = F.lit(True)
        for (column, _), value in zip(KEY, self.fixed, strict=False):
            inside &= F.col(column) == value
        return inside if self.prefix is None else inside & (F.shiftright(name, shift + bits) == self.prefix)

    def value(self, level: int, bin_: int) -> int:
        """What a bin's rows have in common: their key part without the bits that ``level`` doesn't look at."""
        name, _, bits = LEVELS[level]
        lowest = 0 if name != "_doc" and name != "_row" else -(1 << bits - 1)  # a first look at a signed part
        return bin_ + lowest if self.prefix is None else (self.prefix << bits) + bin_

    def inner(self, level: int, bin_: int) -> _Stretch:
        value = self.value(level, bin_)
        return _Stretch((*self.fixed, value)) if LEVELS[level][1] == 0 else _Stretch(self.fixed, value)

    def right_of(self, level: int, edge: int) -> Column:
        """Whether a row comes at or after the lower boundary of bin ``edge``."""
        name, shift, _ = LEVELS[level]
        last = self.value(level, edge) - 1
        after = F.lit(True) if last < -(1 << 63) else F.shiftright(name, shift) > F.lit(last).cast("long")
        for (column, _), value in reversed(list(zip(KEY, self.fixed, strict=False))):
            after = (F.col(column) > value) | (F.col(column) == value) & after
        return after


def _bin(level: int) -> Column:
    name, shift, bits = LEVELS[level]
    signed = name in ("_doc", "_row") and (level == 0 or LEVELS[level - 1][0] != name)
    part = F.shiftright(name, shift)
    return part + (1 << bits - 1) if signed else part.bitwiseAND((1 << bits) - 1)


def cuts(keyed: DataFrame, shards: int, tolerance: float, passes: list[int] | None = None) -> list[tuple[_Stretch, int, int]]:
    """The ``shards`` - 1 boundaries, each as (stretch, pass, bin): rows from that bin of the stretch on are above it.

    ``keyed`` has _digest, _doc, _row and size.  ``passes``, if given, gets how
    many cuts were open before each pass.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    below = {_Stretch(): 0}  # exact bytes before each open stretch
    open_ = {k: _Stretch() for k in range(1, shards)} if total else {}
    found = {k: (_Stretch(), 0, 0) for k in range(1, shards)}
    level = 0
    while open_:
        if passes is not None:
            passes.append(len(open_))
        stretches = list(dict.fromkeys(open_.values()))
        which = F.coalesce(*[F.when(s.holds(level), F.lit(k)) for k, s in enumerate(stretches)])
        counted = keyed.select(which.alias("stretch"), _bin(level).alias("bin"), "size").where("stretch is not null").groupBy("stretch", "bin").agg(F.sum("size").alias("bytes")).collect()
        bins: dict[_Stretch, list[tuple[int, int]]] = {s: [] for s in stretches}
        for r in sorted(counted):
            bins[stretches[r.stretch]].append((r.bin, r.bytes))
        left, before = {}, {}
        for k, s in open_.items():
            # with whole numbers: a boundary with b bytes below misses the share by |b * shards - k * total| / shards
            at, want = below[s], k * total
            for bin_, size in bins[s]:
                if (at + size) * shards >= want:
                    break
                at += size
            low, high = want - at * shards, (at + size) * shards - want
            found[k] = (s, level, bin_) if low <= high else (s, level, bin_ + 1)
            if min(low, high) > tolerance * total and level + 1 < len(LEVELS):
                left[k] = s.inner(level, bin_)
                before[left[k]] = at
        open_, below, level = left, before, level + 1
    return [found[k] for k in range(1, shards)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, keep: Iterable[str] = ("doc_id",), passes: list[int] | None = None) -> DataFrame:
    """Every row with its shard and its place in it, under the law ``bytes``: shards have nearly equal sizes.

    Returns the columns of ``keep`` and size (UTF-8 bytes of the text plus 8),
    text_crc32, law, shard (0 to ``shards`` - 1), slot (0, 1, ... in each shard,
    in key order) and grown_shard (null: bytes move when shards are added).
    Null and empty texts have no bytes and a checksum of 0.  Repeated rows and
    rows with null doc_id (before all others of their text) are rows like any;
    which of two equal rows comes first means nothing.  A kept column with the
    name of a made one gives way to it; other columns are dropped.  A row of
    more than a shard's share may leave shards beside it empty.  An empty table
    gives no rows.
    """
    carry, _ = kept(docs, list(keep), MADE)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"_in_{k}" for k in range(len(carry))]
    keyed = docs.select(
        *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long").alias("_digest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_doc"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keyed = written(keyed, "keys")  # fixes _row, and reads the texts once
    order = ["_shard", "_digest", "_doc", "_row"]
    above = [s.right_of(level, edge).cast("int") for s, level, edge in cuts(keyed, shards, tolerance, passes)]
    dealt = keyed.withColumn("_shard", sum(above, F.lit(0)))
    tasks = max(shards, -(-keyed.count() // TASK_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = written(dealt, "dealt")
    # a place holds its task in the upper bits and counts up in it, so rows before a task's part of a shard give the slots
    parts = dealt.groupBy("_shard", F.shiftright("_place", 33).alias("_task")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_shard", "_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), "_first")
    placed = dealt.withColumn("_task", F.shiftright("_place", 33)).join(F.broadcast(parts), ["_shard", "_task"])  # one row a task and shard
    return placed.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
