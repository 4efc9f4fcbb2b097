"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the words of
a text and their beginnings (so inflected forms count together); each later model also sees the probabilities of the categories before
it.  In training those are out-of-fold predictions, so a later model learns
how reliable they are on texts that the earlier models haven't seen.  The
models are fitted on a bounded sample of labelled texts; scoring is one pass
over all texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, written
from huetide.llm.tokens import ALNUM, Words, chunks, mix

#: Bounds of what reaches the driver: training texts, and the features of theirs that are tied most closely to a category.
TRAIN, POOL = 6000, 512
FOLDS, RIDGE, ROUNDS = 3, 1.0, 60
#: Words in fewer training texts, or tied more loosely to a category (chi square), are no features.
LEAST_TEXTS, LEAST_TIE = 5, 15.0
#: Features of a link, those tied most closely; bytes of the word beginnings.
MOST_FEATURES, BEGINNINGS = 256, (4, 6)
THRESHOLD = 0.25

#: The chain's categories in order, each with what the label table says of it.  Low quality comes first: its probability helps to tell toxic texts.
CATEGORIES = {"low_quality": "coalesce(quality, 1) = 0", "toxic": "toxic > 0"}
CHAIN = list(CATEGORIES)
RESULT = ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean"


@dataclass
class Link:
    """One model of the chain: word hashes (ascending), their weights, weights of earlier probabilities, bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, words: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        """For ``n`` texts given as pairs of text number and word hash, each pair once."""
        out = np.full(n, self.bias) + before @ self.earlier
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            same = self.words[at] == words
            out += np.bincount(rows[same], weights=self.weights[at[same]], minlength=n)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(rows: np.ndarray, code: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Codes below ``most`` that are tied to y, the closest MOST_FEATURES of them."""
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        return np.zeros(0, dtype=np.int64)
    has = np.bincount(code, minlength=most).astype(float)
    both = np.bincount(code, weights=y[rows], minlength=most)
    expected = has * positive / n
    tie = (both - expected) ** 2 / np.maximum(expected * (1 - positive / n) * (1 - has / n), 1e-9)
    good = np.flatnonzero((has >= LEAST_TEXTS) & (tie >= LEAST_TIE))
    return np.sort(good[np.lexsort((good, -tie[good]))[:MOST_FEATURES]])


def fit_link(rows: np.ndarray, code: np.ndarray, names: np.ndarray, y: np.ndarray, before: np.ndarray) -> Link:
    """Ridge logistic regression by Newton steps on the selected features and the earlier probabilities.

    A category that no text has is never predicted.
    """
    if not y.any():
        return Link(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(before.shape[1]), -40.0)
    chosen = features(rows, code, y, len(names))
    v, place = len(chosen), np.full(len(names) + 1, -1)
    place[chosen] = np.arange(v)
    at = place[code]
    x = np.zeros((len(y), v + before.shape[1] + 1))
    x[rows[at >= 0], at[at >= 0]] = 1
    x[:, v:-1] = before
    x[:, -1] = 1
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    keep[-1] = 0.01
    for _ in range(ROUNDS):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return Link(names[chosen], w[:v], w[v:-1], float(w[-1]))


def fit_chain(rows: np.ndarray, words: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Link]:
    """A link a category, in order; ``labels`` is texts x categories."""
    n = len(labels)
    names, code, many = np.unique(words, return_inverse=True, return_counts=True)
    often = (many >= LEAST_TEXTS)[code]
    rows, code = rows[often], code[often]
    before, links = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(n)
        for fold in range(FOLDS):
            own = folds == fold
            if own.any() and not own.all():
                use, number = ~own[rows], np.cumsum(~own) - 1
                link = fit_link(number[rows[use]], code[use], names, y[~own], before[~own])
                out[own] = sigmoid(link.logits(rows, names[code], n, before))[own]
        links.append(fit_link(rows, code, names, y, before))
        before = np.column_stack((before, out))
    return links


def feature_hashes(words: Words) -> list[np.ndarray]:
    """Hashes of the words, and of their beginnings where words are longer (0 where not)."""
    size, out = words.ends - words.starts, [words.hashes()]
    for length in BEGINNINGS:
        long = size > length
        value = np.full(len(words), length, dtype=np.uint64)
        for k in range(length):
            value[long] = value[long] << np.uint64(8) | words.data[words.starts[long] + k]
        out.append(np.where(long, mix(mix(value) + np.uint64(length)), np.uint64(0)))
    return out


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text number and feature hash, each once, by text."""
    words = Words(texts, ALNUM, lower=True)
    got = feature_hashes(words)
    ends, rows, out = words.offsets, [], []
    for i in range(len(texts)):
        own = np.unique(np.concatenate([g[ends[i] : ends[i + 1]] for g in got]))
        out.append(own[own != 0])
        rows.append(len(out[-1]))
    return np.repeat(np.arange(len(texts)), rows), np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def train(docs: DataFrame, labels: DataFrame) -> list[Link]:
    """The chain from labelled texts: TRAIN of them at most, chosen by a hash of their ids.

    A document labelled more than once is in a category if any of its labels
    says so; of repeated rows of a doc_id the smallest text counts.  Spark
    counts in how many texts of each category a feature stands; the driver
    gets the POOL features tied most closely to each category, and which text
    has which of them.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(*[F.max(F.expr(said).cast("int")).alias(c) for c, said in CATEGORIES.items()])
    order = F.xxhash64("doc_id", F.lit(17))
    rows = known.count()
    share = min(1.0, 1.2 * TRAIN / max(rows, 1))
    chosen = known.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(order).limit(TRAIN)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *CHAIN).agg(F.min("text").alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                row, word = distinct_features(batch.column("text"))
                row, word = np.append(row, np.arange(batch.num_rows)), np.append(word, np.zeros(batch.num_rows, dtype=np.uint64))  # 0: the text itself
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", *CHAIN)), pa.array(word.view(np.int64))], names=["doc_id", *CHAIN, "word"])

    pairs = written(sample.mapInArrow(words_of, ", ".join(["doc_id long", *(f"{c} int" for c in CHAIN), "word long"])), "features")
    said = pairs.where("word = 0").select("doc_id", *CHAIN).orderBy("doc_id").collect()  # TRAIN rows at most
    n = len(said)
    counts = pairs.where("word <> 0").groupBy("word").agg(F.count("*").alias("has"), *[F.sum(c).alias(c) for c in CHAIN]).where(F.col("has") >= LEAST_TEXTS)
    pool: set[int] = set()
    for c in CHAIN:
        positive = sum(r[c] for r in said)
        if 0 < positive < n:
            expected = F.col("has") * (positive / n)
            tie = (F.col(c) - expected) ** 2 / F.greatest(expected * (1 - positive / n) * (1 - F.col("has") / n), F.lit(1e-9))
            pool |= {r[0] for r in counts.select("word", tie.alias("tie")).orderBy(F.desc("tie"), "word").limit(POOL).collect()}
    listed = docs.sparkSession.createDataFrame([(w,) for w in sorted(pool)], "word long")
    got = pairs.join(F.broadcast(listed), "word").select("doc_id", "word").toArrow()  # TRAIN x POOL x categories at most
    ids = np.array([r["doc_id"] for r in said], dtype=np.int64)
    row = np.searchsorted(ids, got.column("doc_id").to_numpy()).astype(np.int64)
    word = got.column("word").to_numpy().astype(np.int64).view(np.uint64)
    folds = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLDS for r in said], dtype=np.int64)
    return fit_chain(row, word, np.array([[r[c] > 0 for c in CHAIN] for r in said], dtype=bool).reshape(n, len(CHAIN)), folds)


def score(docs: DataFrame, chain: list[Link], keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Probabilities of the chain's categories for every whole text, and whether it is toxic.

    One row per input row (repeated rows stay), with ``keep`` and RESULT.
    Null and empty texts have no words, so they get the chain's bias, and
    are never toxic.  A chain fitted on no texts finds nothing toxic.
    Other input columns are ignored; a kept one that has a name of RESULT
    gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most MOST_FEATURES a link

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = sent.value
        every = np.unique(np.concatenate([link.words for link in links])) if links else np.zeros(0, dtype=np.uint64)
        for whole in batches:
            for batch in chunks(whole, "_text"):
                words = Words(batch.column("_text"), ALNUM, lower=True)
                n, size, pairs = batch.num_rows, max(len(every), 1), []
                for hashes in feature_hashes(words) if len(every) else []:
                    at = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
                    on = every[at] == hashes
                    pairs.append(words.texts()[on] * size + at[on])
                each = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)  # a feature of a text once
                row, word = each // size, every[each % size] if len(every) else np.zeros(0, dtype=np.uint64)
                before = np.zeros((n, 0))
                for link in links:
                    before = np.column_stack((before, sigmoid(link.logits(row, word, n, before))))
                toxic = (before[:, -1] > threshold) & (words.counts > 0)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(p) for p in before.T] + [pa.array(toxic)], names=[*carry, *(f"p_{c}" for c in CHAIN), "toxic"])

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(work, schema)


def op1_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the chain trained on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
