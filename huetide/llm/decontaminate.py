"""Benchmark decontamination with suffix arrays over the training text.

Each task turns slices of its documents into shards: the words of a slice as
one sequence with a suffix array over it.  Every suffix of every benchmark
item is looked up by binary search, one word deeper at a time to the depth of
a window, which gives all its places; suffixes that follow one another at
places that follow one another make up the longest verbatim match.  Benchmark items reach the tasks by
broadcast in blocks of a fixed size, so a benchmark of any size works; the
documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, with_text
from huetide.llm.tokens import ALNUM, Words, chunks, mix, spans_of

WINDOW = 10
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 8 << 20
#: Bytes of document text in one shard.
SHARD_BYTES = 1 << 20
RESULT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, "
    "hit_spans array<struct<start:long,end:long>>, hit_items array<string>"
)
_U = np.uint64


class Suffixes:
    """A suffix array over words, sorted to a depth of words.

    Words are ordered by 16 bits of their hash, four to a 64-bit key, so
    equal prefixes stand together at any depth; a caller checks what it finds
    against the whole hashes.
    """

    def __init__(self, words: np.ndarray, depth: int):
        self.keys = four(words)
        n = len(words)
        self.order = np.argsort(self.keys, kind="stable")
        done, self.padded = 4, np.concatenate((self.keys, np.zeros(depth + 8, dtype=np.uint64)))
        if n < 2:
            return
        at, group = np.arange(n), self.keys[self.order]
        while done <= depth:
            # group tells apart what differs so far; only ties are sorted on
            edge = np.concatenate(([True], group[1:] != group[:-1]))
            group = np.cumsum(edge) - 1
            tied = np.bincount(group)[group] > 1
            at, group = at[tied], group[tied]
            if not len(at):
                return
            follow = self.padded[self.order[at] + done]
            by = np.lexsort((follow, group))
            self.order[at] = self.order[at][by]
            follow = follow[by]
            edge = np.concatenate(([True], (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])))
            group = np.cumsum(edge)
            done += 4

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range of suffixes whose word at ``depth`` is ``word``."""
        block, shift = depth // 4 * 4, _U(48 - 16 * (depth % 4))

        def first(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
            a, b = a.copy(), b.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = self.order[np.where(open_, mid, 0)] + block
                less = ((self.padded[at] >> shift) & _U(0xFFFF)) < least
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            return a

        start = first(lo, hi, word)
        return start, first(start, hi, word + _U(1))


def four(words: np.ndarray) -> np.ndarray:
    """16 bits of each of the four words from each place on; 0 after the end."""
    short = np.concatenate((words & _U(0xFFFF), np.zeros(3, dtype=np.uint64)))
    n = len(words)
    return short[:n] << _U(48) | short[1 : n + 1] << _U(32) | short[2 : n + 2] << _U(16) | short[3 : n + 3]


class Tests:
    """The suffixes of a block of benchmark items, by window: suffixes with equal windows are looked up once."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.hashes, self.ids = words.hashes(), np.array(ids, dtype=object)
        item, length = words.texts(), words.counts
        left = np.repeat(words.offsets[1:], length) - np.arange(len(words))
        need = np.minimum(length, window)[item]
        at = np.flatnonzero(left >= need)
        name = np.zeros(len(at), dtype=np.uint64)
        for k in range(window):
            on = need[at] > k
            name[on] = mix(name[on] + self.hashes[at[on] + k] + _U(k))
        self.depth = int(need.max(initial=0))
        self.at, self.item = at, item[at]
        _, self.first, self.window = np.unique(name, return_index=True, return_inverse=True)
        self.start, self.need = at[self.first], need[at[self.first]]
        # suffixes by window, and windows of each item once
        self.by = np.argsort(self.window, kind="stable")
        self.bounds = np.searchsorted(self.window[self.by], np.arange(len(self.first) + 1))


def search(shard: np.ndarray, tests: Tests) -> Iterator[tuple[int, np.ndarray]]:
    """Each window of the tests that stands in the shard, with its places, ascending."""
    suffixes = Suffixes(shard, tests.depth)
    alive = np.arange(len(tests.start))
    lo, hi = np.zeros(len(alive), dtype=np.int64), np.full(len(alive), len(shard), dtype=np.int64)
    for depth in range(tests.depth):
        lo, hi = suffixes.narrow(lo, hi, depth, tests.hashes[tests.start[alive] + depth] & _U(0xFFFF))
        on = lo < hi
        alive, lo, hi = alive[on], lo[on], hi[on]
        done = tests.need[alive] == depth + 1
        for w, a, b in zip(alive[done].tolist(), lo[done].tolist(), hi[done].tolist(), strict=True):
            place = np.sort(suffixes.order[a:b])
            for k in range(depth + 1):  # 16 bits led here; the whole hashes decide
                place = place[shard[place + k] == tests.hashes[tests.start[w] + k]]
            if len(place):
                yield w, place
        alive, lo, hi = alive[~done], lo[~done], hi[~done]
        if not len(alive):
            return


def longest_matches(found: dict[int, np.ndarray], tests: Tests) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and the words that match from a suffix of a test up to the end of the window there, suffix by suffix."""
    hit = np.zeros(len(tests.first), dtype=bool)
    hit[list(found)] = True
    before, places, sizes = -2, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for k in np.flatnonzero(hit[tests.window]).tolist():
        w = int(tests.window[k])
        own, size = found[w], np.full(len(found[w]), tests.need[w])
        if k == before + 1 and tests.item[k] == tests.item[before] and len(places):
            at = np.minimum(np.searchsorted(places, own - 1), len(places) - 1)
            size = np.where(places[at] == own - 1, sizes[at] + 1, size)
        before, places, sizes = k, own, size
        yield own, size


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Mark the document words that stand in any window of benchmark words.

    One row per input row (repeated rows stay), with ``keep`` and RESULT.
    A null or empty text has no words and no hits; a benchmark row with null
    item_id or text takes no part; items with equal words all count.  An
    empty benchmark hits nothing.  Other input columns are ignored; a kept
    one that has a name of RESULT gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    state = "_state_of_marks"
    empty = F.lit(None).cast("struct<n_words:bigint,bits:binary,items:array<string>,longest:bigint>")
    out, source = with_text(docs, carry)
    out = out.withColumn(state, empty)
    if parts > 1:
        items = items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    for k in range(parts):
        rows = (items.where(F.col("_block") == k) if parts > 1 else items).select("item_id", "text").collect()  # one block: about block_bytes
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        mark = _marker(sent, window, source, state)
        if k + 1 < parts:
            out = out.mapInArrow(mark, out.schema)
    finish = _finisher(carry, state, schema)
    return out.mapInArrow(lambda batches: finish(mark(batches)), schema)  # one worker a task marks and finishes


def _marker(sent, window: int, source: str, state: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(*sent.value, window)
        for whole in batches:
            for batch in chunks(whole, source, SHARD_BYTES):
                words = Words(batch.column(source), ALNUM, lower=True)
                n, texts = batch.num_rows, words.texts()
                before = batch.column(state).to_pylist()
                hit, longest = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(n, dtype=np.int64)
                pairs: dict[int, set[int]] = {}
                if len(words) and len(tests.hashes):
                    # one 0, no word's hash, after each text's last word keeps matches inside texts
                    at = np.arange(len(words)) + texts
                    shard = np.zeros(len(words) + n, dtype=np.uint64)
                    shard[at] = words.hashes()
                    word = np.zeros(len(shard), dtype=np.int64)
                    word[at] = np.arange(len(words))
                    windows = dict(search(shard, tests))
                    for w, place in windows.items():
                        first, need = word[place], tests.need[w]
                        hit[first] += 1
                        np.add.at(hit, first + need, -1)
                        of = np.unique(tests.item[tests.by[tests.bounds[w] : tests.bounds[w + 1]]])
                        for t in np.unique(texts[first]).tolist():
                            pairs.setdefault(t, set()).update(of.tolist())
                    for place, size in longest_matches(windows, tests):
                        np.maximum.at(longest, texts[word[place]], size)
                hit = np.cumsum(hit)[:-1] > 0
                found = {t: {tests.ids[i] for i in items} for t, items in pairs.items()}
                rows = []
                for t in range(n):
                    own, old = hit[words.offsets[t] : words.offsets[t + 1]], before[t]
                    if old and old["bits"]:
                        own = own | np.unpackbits(np.frombuffer(old["bits"], dtype=np.uint8), count=len(own)).astype(bool)
                    names = found.get(t, set()) | set(old["items"] if old else ())
                    rows.append({"n_words": len(own), "bits": np.packbits(own).tobytes() if own.any() else None, "items": sorted(names), "longest": max(int(longest[t]), old["longest"] if old else 0)})
                yield batch.set_column(batch.schema.get_field_index(state), state, pa.array(rows, batch.schema.field(state).type))

    return mark


def _finisher(carry: list[str], state: str, schema):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            made: dict[str, list] = {f.name: [] for f in kinds if f.name not in carry}
            for row in batch.column(state).to_pylist():
                hit = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=row["n_words"]).astype(bool) if row["bits"] else np.zeros(0, dtype=bool)
                made["n_words"].append(row["n_words"])
                made["n_hit"].append(int(hit.sum()))
                made["n_items"].append(len(row["items"]))
                made["items_sha256"].append(hashlib.sha256(",".join(row["items"]).encode()).hexdigest())
                made["contaminated"].append(bool(hit.any()))
                made["longest_match"].append(row["longest"])
                made["hit_spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(*spans_of(hit), strict=True)])
                made["hit_items"].append(row["items"])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(v, kinds.field(k).type) for k, v in made.items()], names=[*carry, *made])

    return finish


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
