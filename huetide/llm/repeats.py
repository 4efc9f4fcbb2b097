"""Substring deduplication by level-wise doubling.

A word window that repeats has repeated halves.  At half the wanted length the
smallest-hashed sub-window of each window stands for it (equal windows choose
equal ones), so a sixth of the positions is counted.  Only windows whose
half-length representative repeats are extended to the full length and
compared there.  ``deduplicate`` needs no longer level than the one it removes;
``levels`` goes on doubling until nothing repeats.

What repeats inside one slice of texts is settled in its task.  Of each window
a slice sends its first place alone, so a passage in a third of all documents
sends a row a slice, not a row a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, written
from huetide.llm.tokens import SPACED, Words, chunks, join, mix, spans_of

LENGTH = 20
#: Bytes of text in a slice.
SLICE_BYTES = 4 << 20
RESULT = "n_words long, n_removed long, kept string, removed_spans array<struct<start:long,end:long>>"
_U = np.uint64


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on, by doubling; shorter than ``words`` by length - 1."""
    out, size = None, 0
    power, width = words, 1
    while True:
        if length & width:
            n = len(power) - size
            out = power if out is None else join(out[: max(n, 0)], power[size:])
            size += width
        if size == length:
            return out[: max(0, len(words) - length + 1)]
        power, width = join(power[:-width], power[width:]) if len(power) > width else power[:0], 2 * width


def representatives(half: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """For each window that has room, the place of its sub-window of half length with the smallest hash (the first of equals)."""
    span, n = length - length // 2 + 1, len(half) - (length - length // 2)
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    place, width = np.arange(len(half)), 1
    while width < span:  # the least of ``width`` from each place on; the last step overlaps, which a minimum allows
        shift = min(width, span - width)
        left, right = place[:-shift], place[shift:]
        place, width = np.where(half[right] < half[left], right, left), width + shift
    return place[room[:n]]


def _of(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of a hash and whom it belongs to."""
    return mix(x + owner.astype(np.int64).view(np.uint64) * _U(0xA0761D6478BD642F))


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair, and of every place the number of its pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    back = np.empty(len(a), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sorted(batch: pa.RecordBatch, listed: bool) -> pa.RecordBatch:
    """The rows that take part, by doc_id."""
    batch = batch.filter(batch.column("anchors" if listed else "doc_id").is_valid())
    return batch.take(pa.array(np.argsort(batch.column("doc_id").to_numpy(), kind="stable")))


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of all rows, and the row of each."""
    lists = batch.column("anchors")
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())


def _anchors(length: int, extend: bool = False):
    """Rows key, check, anchor, doc_id, sure for each text: the windows of half the length that represent one of ``length``.

    Without ``extend`` all of them, and anchor 0 for the whole word sequence,
    which ``check``, a hash from other word hashes, tells from any other;
    with it, those whose own representative is among the text's ``anchors``,
    the survivors of the level before.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                batch = _sorted(batch, extend)
                ids, words = batch.column("doc_id").to_numpy(), Words(batch.column("text"), SPACED, lower=False)
                hashes, owner = words.hashes(), words.texts()
                half = window_hashes(hashes, length // 2)
                place = np.unique(representatives(half, words.room(length), length))
                if extend:
                    room, size = words.room(length // 2), length // 2
                    quarter, own = window_hashes(hashes, size // 2), np.zeros(len(words), dtype=np.int64)
                    own[room] = representatives(quarter, room, size)
                    place = place[np.isin(_of(quarter[own[place]] | _U(1), owner[place]), _of(*_listed(batch)))]
                names, owners = half[place] | _U(1), owner[place]
                _, once = np.unique(_of(names, owners), return_index=True)
                # a repeated row of a doc_id is no other place
                _, places = np.unique(_of(_of(names, ids[owners]), place - words.offsets[owners]), return_index=True)
                again, count = np.unique(names[places], return_counts=True)
                names, docs = names[once], ids[owners[once]]
                marks = again[count > 1]
                sure = np.isin(names, marks)
                speaks, whole_names, copies, checks = (np.zeros(0, dtype=x) for x in (np.int64, np.uint64, np.int64, np.uint64))
                if not extend:  # whole sequences: even keys; the first text of each in this slice speaks for it
                    sequence, check = (np.zeros(batch.num_rows, dtype=np.uint64) for _ in range(2))
                    place_of = (np.arange(len(hashes)) - words.offsets[owner]).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
                    np.add.at(sequence, owner, mix(hashes + place_of))
                    np.add.at(check, owner, mix(words.hashes(1) + place_of))
                    sequence &= ~_U(1)
                    texts = np.flatnonzero(words.counts >= length)
                    first, back = _alike(sequence[texts], check[texts])
                    speaks, whole_names, checks = ids[texts[first]], sequence[texts[first]], check[texts[first]]
                    later = ids[texts] > speaks[back]  # a repeated row is no copy of itself
                    later[first] = False
                    copies = texts[later]
                n, m, w, c = len(docs), len(marks), len(speaks), len(copies)
                key = [np.where(sure, _of(names, docs), names), marks, whole_names] + ([] if extend else [_of(sequence[copies], ids[copies])])
                doc = np.concatenate([docs, np.zeros(m, dtype=np.int64), speaks, ids[copies]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(np.concatenate(key)),
                        _signed(np.concatenate([np.zeros(n + m, dtype=np.uint64), checks, np.zeros(c, dtype=np.uint64)])),
                        _signed(np.concatenate([names, marks, np.zeros(w + c, dtype=np.uint64)])),
                        pa.array(doc, mask=np.repeat([False, True, False], [n, m, w + c])),
                        pa.array(np.concatenate([sure, np.repeat([False, True], [m + w, c])])),
                    ],
                    names=["key", "check", "anchor", "doc_id", "sure"],
                )

    return emit


def _windows(length: int):
    """Rows key, check, doc_id, start, length, sure: windows whose representative repeats; sure rows are runs settled in the slice.

    Two hashes, from two hashes of each word, tell windows apart.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", SLICE_BYTES):
                batch = _sorted(batch, True)
                ids, words = batch.column("doc_id").to_numpy(), Words(batch.column("text"), SPACED, lower=False)
                hashes, owner = words.hashes(), words.texts()
                half, full, room = window_hashes(hashes, length // 2), window_hashes(hashes, length), words.room(length)
                flat, text = _listed(batch)
                start = np.flatnonzero(room[: len(full)])
                rep = representatives(half, room, length)
                copy = np.zeros(len(ids), dtype=bool)
                copy[text[flat == 0]] = True
                on = np.isin(_of(half[rep] | _U(1), owner[rep]), _of(flat, text)) & ~copy[owner[start]]
                start = start[on]
                other = window_hashes(words.hashes(1), length)[start]
                first, back = _alike(full[start], other)
                keys, checks = full[start][first], other[first]
                # later than the first here: removed, whatever other slices hold; the same doc_id and place is a repeated row
                doc, place = ids[owner[start]], start - words.offsets[owner[start]]
                later = (doc != doc[first][back]) | (place != place[first][back])
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(covered, start[later], 1)
                np.add.at(covered, start[later] + length, -1)
                a, b = _split(*spans_of(np.cumsum(covered)[:-1] > 0), words.offsets)
                said = ids[owner[a]] if len(a) else np.zeros(0, dtype=np.int64)
                key = np.concatenate([keys, _of(a.astype(np.uint64), said)])
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(key),
                        _signed(np.concatenate([checks, np.zeros(len(a), dtype=np.uint64)])),
                        pa.array(np.concatenate([doc[first], said]).astype(np.int64)),
                        pa.array(np.concatenate([place[first], a - words.offsets[owner[a]] if len(a) else a]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(len(first), length), b - a]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(len(first), dtype=bool), np.ones(len(a), dtype=bool)])),
                    ],
                    names=["key", "check", "doc_id", "start", "length", "sure"],
                )

    return emit


def _split(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut where texts begin."""
    inside = np.zeros(int(offsets[-1]) + 1, dtype=np.int64)
    inside[starts] += 1
    inside[ends] -= 1
    cuts = offsets[np.cumsum(inside)[offsets] > 0]
    return np.union1d(starts, cuts).astype(np.int64), np.union1d(ends, np.setdiff1d(cuts, starts)).astype(np.int64)


def _survivors(sent: DataFrame) -> DataFrame:
    """doc_id and anchors: its representatives that stand in another place too; 0 for a text that an earlier one equals."""
    by_key = Window.partitionBy("key", "check")
    sent = sent.withColumns({"least": F.min("doc_id").over(by_key), "most": F.max("doc_id").over(by_key), "told": F.bool_or(F.col("doc_id").isNull()).over(by_key)})
    again = F.when(F.col("anchor") == 0, F.col("least") < F.col("doc_id")).otherwise(F.col("told") | (F.col("least") < F.col("most")))
    return sent.where(F.col("doc_id").isNotNull() & (F.col("sure") | again)).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_SENT = "key long, check long, anchor long, doc_id long, sure boolean"


def levels(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and longest: how long the windows of a document are that stand in another place too, in doubling steps.

    Representatives of ``length // 2`` words are counted; those that repeat,
    and only they, are extended to ``length`` words, those that repeat there
    to twice that, until no document has a survivor.  Each level is a written
    table, and only its documents' texts are read for the next.

    ``longest`` is the last level at which a document has a survivor: a window
    of so many words repeats, and none of four times as many does outside
    exact copies.  Documents without one aren't returned.  Of an exact copy of an earlier text,
    ``longest`` is null (all of it repeats), and later levels leave it out.
    Rows with null doc_id, null text or no words take no part; repeated rows
    of a doc_id count once.
    """
    rows, by_doc = _rows(docs), F.array_contains("anchors", 0)
    marks = written(_survivors(rows.mapInArrow(_anchors(length), _SENT)), "repeats")
    out = marks.select("doc_id", F.when(~by_doc, length // 2).cast("long").alias("longest"), by_doc.alias("copy"))
    size, marks = length, marks.where(~by_doc)
    while not marks.isEmpty():
        sent = rows.join(marks, "doc_id").mapInArrow(_anchors(2 * size, extend=True), _SENT)
        marks = written(_survivors(sent), "repeats")
        out = out.unionByName(marks.select("doc_id", F.lit(size).cast("long").alias("longest"), F.lit(False).alias("copy")))
        size *= 2
    return out.groupBy("doc_id").agg(F.when(~F.bool_or("copy"), F.max("longest")).alias("longest"))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and spans (array of start, length in words; length 0: the whole text) that an earlier equal window covers."""
    rows, by_key = _rows(docs), Window.partitionBy("key", "check")
    marks = _survivors(rows.mapInArrow(_anchors(length), _SENT))
    full = rows.join(marks, "doc_id", "left").mapInArrow(_windows(length), "key long, check long, doc_id long, start int, length int, sure boolean")
    full = full.withColumn("least", F.min(F.struct("doc_id", "start")).over(by_key))
    later = full.where(F.col("sure") | (F.col("least") < F.struct("doc_id", "start"))).select("doc_id", "start", "length")
    whole = marks.where(F.array_contains("anchors", 0)).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("length"))
    return later.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def deduplicate(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts without the words of windows that occur earlier: in a smaller doc_id, or before in the same text.

    One row per input row, with ``keep`` and RESULT; ``kept`` is the remaining
    words joined by one space, spans count words.  doc_id names a document:
    repeated rows get the document's result each, and don't count as copies
    of themselves.  A row with null doc_id takes no part and keeps its words.
    Null and empty texts have no words.  Other input columns are ignored; a
    kept one that has a name of RESULT gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)
    rows = _rows(docs)
    extra = [c for c in carry if c != "doc_id"]
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in extra]) if extra else rows
    joined = left.join(repeated(rows, length), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), SPACED, lower=False)
                data, spans = words.data.tobytes(), batch.column("spans").to_pylist()
                kept_texts, removed, found = [], [], []
                for i in range(batch.num_rows):
                    lo, hi = words.offsets[i], words.offsets[i + 1]
                    gone = np.zeros(hi - lo, dtype=bool)
                    for s in spans[i] or ():
                        gone[s["start"] : s["start"] + s["length"] if s["length"] else None] = True
                    stay = np.flatnonzero(~gone) + lo
                    kept_texts.append(b" ".join([data[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
                    removed.append(int(gone.sum()))
                    found.append([{"start": int(a), "end": int(b)} for a, b in zip(*spans_of(gone), strict=True)])
                made = {"n_words": pa.array(words.counts), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept_texts, pa.binary()).cast(pa.string()), "removed_spans": pa.array(found, kind)}
                yield pa.RecordBatch.from_arrays([batch.column(c if c == "doc_id" else f"_keep_{c}") for c in carry] + list(made.values()), names=[*carry, *made])

    return joined.mapInArrow(cut, schema)


def op4_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its earlier-seen windows of 20 words."""
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
