"""Operator 13: language of a text by a string kernel.

Two texts are as alike as the number of character n-grams (1 to ``LONGEST``, a blended spectrum) that both hold, each
counted once, over the geometric mean of their own numbers. The n-grams are those of the lower-cased runs of letters, a
space between runs, and stand for one of ``2**BITS`` buckets.

* Nyström: ``landmarks`` texts of the sample span the feature space; with K the kernel between them and K = U diag(s) U',
  a text x becomes k(x) U diag(s)^(-1/2), where k(x) is its kernel with every landmark.
* One-versus-rest kernel ridge regression on these features, every language weighing the same.
* k(x) is itself a product of the presence row of x and the presence rows of the landmarks. So landmarks, eigenvectors
  and coefficients multiply to one matrix with a row for each bucket and a column for each language, and a batch of texts
  is scored by one matrix product with it: the same numbers without the detour over the landmarks.

Training reads at most ``most`` rows with a language outside the held-out fold: one for each distinct text, drawn by the
hash of the text, the languages in turn, so that neither a large group of copies nor a common language crowds out others.

Edge cases: a missing text, or one without a letter, is ``und`` with score 0; without anything to learn from every text is.
Rows without lang are not learned from. Equal texts get equal answers; ties go to the language that sorts first. Whole
texts count, however long. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import fold, materialize, mix

PARTS, HELD = 4, 2
BITS, LONGEST = 16, 4
WIDTH = 1 << BITS
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
ODD = np.uint64(0x9E3779B97F4A7C15)


def spectrum(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a text, repeats included; none for a text without a letter."""
    # Letters, without runs of signs that are numbers only (the pattern takes those for letters too).
    runs = [run for run in LETTERS.findall((text or "").lower()) if not run.isnumeric() or any(map(str.isalpha, run))]
    if not runs:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {' '.join(runs)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, hashed = [], np.zeros(len(points), np.uint64)
    for size in range(1, LONGEST + 1):
        hashed = hashed[: len(points) - size + 1] * ODD + points[size - 1 :] + np.uint64(size)
        found.append(mix(hashed) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64)


class Presence:
    """Presence rows of a batch of texts: 1 in the buckets of a text, in one matrix that is used again and again."""

    def __init__(self, most: int = 64):
        self.most, self.matrix = most, np.zeros((most, WIDTH), np.float32)

    def __call__(self, buckets: list[np.ndarray]) -> np.ndarray:
        rows = self.matrix[: len(buckets)]
        rows[:] = 0
        for row, found in zip(rows, buckets, strict=True):
            row[found] = 1
        return rows


def kernel(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the rows' own; rows of nothing are like nothing."""
    own, theirs = rows.sum(1, dtype=np.float64), others.sum(1, dtype=np.float64)
    return (rows @ others.T) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(theirs, 1))


def train(packed: np.ndarray, names: list[str], landmarks: int = 256, ridge: float = 1e-3) -> dict:
    """``packed`` has the presence of each sample row as bits; ``names`` their languages."""
    kept = packed.any(1) if len(packed) else np.zeros(0, bool)
    packed, names = packed[kept], [name for name, one in zip(names, kept, strict=True) if one]
    known = sorted(set(names))
    if not known:
        return {"languages": [], "weights": np.zeros((WIDTH, 0), np.float32), "offset": np.zeros(0)}
    marks = np.unpackbits(packed[:landmarks], axis=1).astype(np.float32)
    like = np.concatenate([kernel(np.unpackbits(packed[at : at + 256], axis=1).astype(np.float32), marks) for at in range(0, len(packed), 256)])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    strong = values > 1e-6 * values[-1]
    project = vectors[:, strong] / np.sqrt(values[strong])
    features = like @ project
    number = np.array([known.index(name) for name in names])
    share = (1.0 / np.bincount(number))[number] / len(known)  # every language weighs the same
    target = np.where(number[:, None] == np.arange(len(known)), 1.0, -1.0)
    middle, level = share @ features, share @ target
    centred = features - middle
    inner = (centred * share[:, None]).T @ centred + ridge * np.eye(centred.shape[1])
    coefficients = np.linalg.solve(inner, (centred * share[:, None]).T @ (target - level))
    scaled = marks / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return {"languages": known, "weights": (scaled.T @ (project @ coefficients)).astype(np.float32), "offset": level - middle @ coefficients}


def sample(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows (lang, text): distinct texts by their hash, the languages in turn."""
    hashed = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("doc_id", PARTS) != HELD)
    hashed = hashed.select(F.col("lang").alias("_lang"), F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_id"))
    texts = materialize(hashed.groupBy("_lang", "_hash").agg(F.min("_id").alias("_id")), "texts")
    # The smallest hashes are wanted: of a large language only those below a quantile that holds four times as many are ranked.
    sizes = texts.groupBy("_lang").agg(F.count(F.lit(1)).alias("_count"))
    low = F.col("_hash") / float(1 << 64) + 0.5 <= 4.0 * most / F.col("_count")
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    drawn = texts.join(sizes, "_lang").where(low).select("_lang", "_hash", "_id")
    drawn = drawn.withColumn("_turn", turn).where(F.col("_turn") <= most).orderBy("_turn", "_lang").limit(most)
    named = docs.select(F.col("lang").alias("_lang"), F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_id"), "text")
    met = named.join(F.broadcast(drawn), (named._lang == drawn._lang) & (named._hash == drawn._hash) & named._id.eqNullSafe(drawn._id))
    return met.select(drawn._turn.alias("turn"), drawn._lang.alias("lang"), drawn._hash.alias("hash"), "text")


def fit(docs: DataFrame, most: int = 3000, landmarks: int = 256) -> dict:
    """Train on at most ``most`` rows; the driver gets ``2**BITS`` bits of each, never a text."""

    def encode(batches):
        for batch in batches:
            bits = np.zeros(WIDTH, np.uint8)
            packed = []
            for text in batch.column("text").to_pylist():
                bits[:] = 0
                bits[spectrum(text)] = 1
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("lang"), batch.column("hash"), pa.array(packed, pa.binary())], names)

    names = ["turn", "lang", "hash", "bits"]
    rows = sample(docs, most).mapInArrow(encode, "turn int, lang string, hash long, bits binary").toArrow()
    # A text that stands in the table several times under one id and language is one row.
    drawn = {(turn, lang): bits for turn, lang, bits in zip(*(rows.column(name).to_pylist() for name in ("turn", "lang", "bits")), strict=True)}
    order = sorted(drawn)
    packed = np.frombuffer(b"".join(drawn[one] for one in order), np.uint8).reshape(len(order), WIDTH // 8)
    return train(packed, [lang for _, lang in order], landmarks)


def predictor(model: dict):
    """(language, score) of the texts of a batch, inside a task."""
    known, weights, offset, presence = model["languages"], model["weights"], model["offset"], Presence()

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        answers = []
        for start in range(0, len(texts), presence.most):
            buckets = [spectrum(text) for text in texts[start : start + presence.most]]
            rows = presence(buckets)
            outputs = (rows @ weights) / np.sqrt(np.maximum(rows.sum(1), 1))[:, None] + offset
            for found, output in zip(buckets, outputs, strict=True):
                if not len(found) or not known:
                    answers.append((UNKNOWN, 0.0))
                    continue
                best = int(np.argmax(output))
                answers.append((known[best], float(1.0 / np.exp(np.clip(4.0 * (output - output[best]), -60, 0)).sum())))
        return answers

    return predict


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, held_out, lang_pred and score, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each bucket and language

    def work(batches):
        predict = predictor(shared.value)
        for batch in batches:
            answers = predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([name for name, _ in answers], pa.string()), pa.array([score for _, score in answers], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "lang_pred", "score")
