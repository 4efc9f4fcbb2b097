"""Language identification with string kernels.

The kernel of two texts is the cosine of their sets of byte n-grams, of
lengths 1 to 4 blended, averaged over the pieces of long texts.  Nystrom
landmarks stand for the training texts and kernel ridge regression, one
language against the rest, is solved over them.  As the kernel is a product of
presence vectors, landmarks times coefficients is one matrix from n-grams to
languages; a task scores its texts as products of a batch of presence vectors
with it.  n-grams are hashed to GRAMS slots; tests hold the predictions against
the exact kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table, with_text
from huetide.llm.tokens import LOWER, chunks, text_bytes

#: Training texts and landmarks a language (bounds of what reaches the driver: a vector of GRAMS half floats a text), and bytes of a piece of text.
TRAIN, LANDMARKS, PIECE = 200, 48, 2048
GRAMS = 1 << 14
#: Training texts in all, and languages that are learned: those with the most texts.
TOTAL, LANGUAGES = 4096, 512
RIDGE = 1e-3
RESULT = "lang_pred string, score double, margin double"
_FOLD = LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 0x20
_BATCH = 64


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of the hashed n-grams present in each piece ``at[i]:at[i + 1]`` of the bytes."""
    out = np.zeros((len(at) - 1, GRAMS), dtype=np.float32)
    text = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    flat, code = out.reshape(-1), np.zeros(len(text), dtype=np.uint32)
    for n in range(1, 5):
        if len(text) < n:
            break
        m = len(text) - n + 1
        code = code[:m] * np.uint32(0x01000193) + text[n - 1 :] + np.uint32(n)
        inside = row[:m] == row[n - 1 :]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)  # 14 bits: GRAMS
        flat[(row[:m] * GRAMS + slot)[inside]] = 1
    out /= np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))
    return out


def pieces(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pieces of about PIECE bytes that together are the texts, and the text of each."""
    counts = np.maximum(1, -(-np.diff(at) // PIECE))
    owner = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = at[:-1][owner] + np.diff(at)[owner] * k // counts[owner]
    return np.append(starts, at[-1]), owner


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A vector a text: the mean of its pieces' presence vectors, weighted by length."""
    bounds, owner = pieces(at)
    out = np.zeros((len(at) - 1, GRAMS), dtype=np.float32)
    for lo in range(0, len(owner), _BATCH):
        part = bounds[lo : lo + _BATCH + 1]
        np.add.at(out, owner[lo : lo + _BATCH], np.diff(part)[:, None] * presence(data[part[0] : part[-1]], part - part[0]))
    return out / np.maximum(np.diff(at), 1)[:, None]


def fit(x: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix from n-gram presence to one score a language (+1 it is, -1 it isn't), from vectors of texts."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((GRAMS, 0), dtype=np.float32)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = (1 / np.array([langs.count(n) for n in names]))[[names.index(n) for n in langs]]
    marks = np.concatenate([[i for i, n in enumerate(langs) if n == name][:LANDMARKS] for name in names]).astype(int)
    k_mm = x[marks].astype(float) @ x[marks].T.astype(float)
    k_nm = x.astype(float) @ x[marks].T.astype(float)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])  # to the Nystrom features
    phi = k_nm @ root
    left = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(left, (phi * weight[:, None]).T @ y)
    return names, (x[marks].T.astype(float) @ (root @ solved)).astype(np.float32)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model from a sample of at most TRAIN whole texts a language, chosen by a hash of their ids.

    Of more than LANGUAGES languages those with the most texts are learned (of
    equals the first by name), and of more than TOTAL / TRAIN ones each has an
    equal part of TOTAL texts, so that what reaches the driver has a bound.
    """
    rows = labelled.where("text is not null and lang is not null and text rlike '[\\\\p{L}]'")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit(np.zeros((0, GRAMS)), [])
    each = min(TRAIN, TOTAL // len(counts))
    order = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, 1.3 * max(each, 40) / n) * (1 << 20)) + 1)])
    sample = rows.where(order < share[F.col("lang")]).select("lang", order.alias("o"), "doc_id", F.col("text").cast("string").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    chosen = sample.select("lang", "o", "doc_id", F.xxhash64("text").alias("h")).withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "o", "doc_id", "h")
    chosen = chosen.dropDuplicates(["doc_id"]).select("doc_id", "lang", "o")  # TOTAL at most
    sample = sample.join(F.broadcast(chosen), ["doc_id", "lang", "o"]).dropDuplicates(["doc_id"])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                made = vectors(*text_bytes(batch.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array([v.tobytes() for v in made], pa.binary())], names=["lang", "doc_id", "vector"])

    got = sorted(sample.select("lang", "doc_id", "text").mapInArrow(embed, "lang string, doc_id long, vector binary").collect(), key=lambda r: (r["lang"], r["doc_id"]))
    return fit(np.stack([np.frombuffer(r["vector"], dtype=np.float16).astype(np.float32) for r in got]), [r["lang"] for r in got])


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The language of every whole text: mean score of its pieces, weighted by length, best language first.

    One row per input row (repeated rows stay), with ``keep`` and RESULT.
    Null texts and texts without any letter, and all texts if no language was
    learned, are ``und`` with score 0; equal scores go to the first language
    by name.  margin is how far the best score is above the second (above 0.5,
    no answer, if one language alone was learned); a text of n-grams that no
    language has stands near 0.  Other input columns are ignored; a kept one that has a name of
    RESULT gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)
    rows, source = with_text(docs, carry)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS x languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for whole in batches:
            for batch in chunks(whole, source):
                data, at = text_bytes(batch.column(source))
                bounds, owner = pieces(at)
                total = np.zeros((batch.num_rows, max(1, len(names))))
                for lo in range(0, len(owner), _BATCH):
                    part = bounds[lo : lo + _BATCH + 1]
                    got = presence(data[part[0] : part[-1]], part - part[0]) @ matrix if names else 0
                    np.add.at(total, owner[lo : lo + _BATCH], np.diff(part)[:, None] * got)
                total /= np.maximum(np.diff(at), 1)[:, None]
                ascii_letter = np.concatenate(([0], np.cumsum((_FOLD[data] != 0x20) & (data < 128))))
                sure = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
                best = total.argmax(axis=1)
                lang, score = [], np.clip((total.max(axis=1) + 1) / 2, 0, 1)
                margin = (total.max(axis=1) - (np.partition(total, -2, axis=1)[:, -2] if total.shape[1] > 1 else 0)) / 2
                for i in range(batch.num_rows):
                    known = names and (sure[i] or has_letter(data[at[i] : at[i + 1]].tobytes()))
                    lang.append(names[best[i]] if known else "und")
                    score[i], margin[i] = (score[i], margin[i]) if known else (0, 0)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], names=[*carry, "lang_pred", "score", "margin"])

    return rows.mapInArrow(work, schema)


def held_out() -> F.Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; ids whose CRC-32 leaves 1 by 3 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train_on_documents(docs.select("doc_id", "text", "lang"))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
