"""Periodic runs of words, by minimizers at several scales.

A run is a maximal stretch of words with a smallest period q that is at least
four periods (and six words) long.  Periods under ``LEAST`` are found by
comparing the words with themselves, so many words on.  For longer ones there
is one scale for each doubling: with periods from w to 2w, grams of 2w words
are hashed, and of every w grams in a row the ones with the least hash are
kept.  Windows a period apart inside a run hold the same grams, so their
minimizers are a period apart; as a gram is longer than the period, the same
gram doesn't recur sooner.  Neighbouring equal minimizers are therefore the
seeds, which are extended to both sides by comparing the words themselves.

The words of many texts are worked on at once, with a mark of its own between
two texts, which equals nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, with_text
from huetide.llm.tokens import chunks, mix, spans_of

#: A run has so many periods and so many words at least.
PERIODS, WORDS = 4, 6
#: Periods from here on are found by minimizers; a power of two.
LEAST = 16

MADE = "n_words long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"
_RUN = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

_U = np.uint64


def _slid(x: np.ndarray, w: int, least: np.ufunc) -> np.ndarray:
    """``least`` over every ``w`` values in a row; ``w`` is a power of two."""
    step = 1
    while step < w:
        x = least(x[:-step], x[step:])
        step *= 2
    return x


def minimizer_pairs(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places m and distances q, w <= q < 2w, of neighbouring equal minimizers of windows of ``w`` grams."""
    if len(grams) < w:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = _slid(grams, w, np.minimum)
    # a gram is a minimizer if it is the least of some window, that is, of the one with the greatest least
    edge = np.zeros(w - 1, dtype=np.uint64)
    places = np.flatnonzero(_slid(np.concatenate((edge, low, edge)), w, np.maximum) == grams)
    hashes = grams[places]
    order = np.argsort(hashes, kind="stable")
    places, hashes = places[order], hashes[order]
    distance = np.diff(places)
    good = (hashes[1:] == hashes[:-1]) & (distance >= w) & (distance < 2 * w)
    return places[:-1][good], distance[good]


def _reach(words: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words are equal to those ``q`` on, by comparing ever longer pieces."""
    end, step = at, 64
    while end + q < len(words):
        there = words[end + q : end + q + step]
        differs = np.flatnonzero(words[end : end + len(there)] != there)
        if len(differs):
            end += int(differs[0])
            break
        end, step = end + len(there), step * 2
    start, step = at, 64
    while start > 0:
        lo = max(0, start - step)
        differs = np.flatnonzero(words[lo:start] != words[lo + q : start + q])
        if len(differs):
            start = lo + int(differs[-1]) + 1
            break
        start, step = lo, step * 2
    return start, end + q


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs in a sequence of word numbers, by start; no text in it is longer than ``longest`` words."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, min(LEAST, longest // PERIODS + 1)):
        a, b = spans_of(words[q:] == words[:-q])
        a, b = (x[b - a >= max(WORDS, PERIODS * q) - q] for x in (a, b))
        found.append(np.stack((a, b + q, np.full(len(a), q)), axis=1))
    grams, size, w = mix(words.astype(np.uint64) + _U(0x9E3779B97F4A7C15)), 1, LEAST
    while PERIODS * w <= longest:
        while size < 2 * w:
            grams = mix(grams[:-size] * _U(0xD6E8FEB86659FD93) + (grams[size:] ^ _U(0xA0761D6478BD642F)))
            size *= 2
        places, periods = minimizer_pairs(grams, w)
        order = np.lexsort((places, periods))
        last, until = 0, -1
        for at, q in zip(places[order].tolist(), periods[order].tolist(), strict=True):
            if q == last and at < until:
                continue
            start, end = _reach(words, at, q)
            last, until = q, end - q
            if end - start >= PERIODS * q:
                found.append(np.array([[start, end, q]]))
        w *= 2
    runs = np.concatenate(found)
    # a multiple of a run's period has the same stretch: the smallest stays
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) with the most periods, fractions counted exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _worked(texts: pa.Array) -> list[pa.Array]:
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(counts + 1)))  # a mark ends each text
    words = np.empty(begins[-1], dtype=np.int64)
    for k, w in enumerate(split):
        words[begins[k] : begins[k + 1] - 1] = list(map(number.__getitem__, w))
        words[begins[k + 1] - 1] = -1 - k
    runs = find_runs(words, int(counts.max(initial=0)))
    cut = np.searchsorted(runs[:, 0], begins)
    listed, strong, out = [], [], []
    for k, w in enumerate(split):
        own = runs[cut[k] : cut[k + 1]] - [begins[k], begins[k], 0]
        mine = [(a, b - a, q) for a, b, q in own.tolist()]
        stays = np.ones(len(w), dtype=bool)
        for a, n, q in mine:
            stays[a + q : a + n] = False
        listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
        best = strongest(mine)
        strong.append(best and dict(zip(("start", "length", "period"), best, strict=True)))
        out.append(b" ".join(compress(w, stays.tolist()) if mine else w))
    return [pa.array(counts), pa.array(listed, pa.list_(_RUN)), pa.array(strong, _RUN), pa.array(out, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """All runs of each whole text, the strongest of them, and the text with each run cut to its first period.

    Words are runs outside ASCII white space.  Returns the columns of ``keep``
    and n_words, runs (start, length, period in words, by start and period),
    strongest (null without runs) and collapsed (kept words, one space between
    two).  Runs may overlap; a word goes if any run holds it after its first
    period.  Null and empty texts have no words, no runs and an empty collapsed
    text.  Repeated rows are worked on alike; doc_id may be null.  A kept
    column with the name of a made one gives way to it; other columns are
    dropped.  An empty table gives no rows.  A task holds the words of one text,
    or of about a megabyte of texts.
    """
    carry, schema = kept(docs, list(keep), MADE)
    sent, name = with_text(docs, carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, name):
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + _worked(batch.column(name)), names=schema.names)

    return sent.mapInArrow(work, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's input: in one text of ten, by the checksum of its doc_id, the words from some place on repeat a stretch of the text.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words, texts
    with h % 10 = 0 keep their words before a = g % n and have word
    a + (i - a) % p at each place i from a on, with p = 1 + (n - a) div (3 + g % 8).
    Other texts, those without words and rows with null doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))))

    # the words are a lambda's variable, so that they are found once a text
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(made, F.lit(0))).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, with runs planted in a tenth of them, as counts, the strongest run and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    out = periodic_runs(with_planted_runs(docs))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = F.col("strongest")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
