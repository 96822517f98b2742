"""Operator 2: toxicity by logistic regression on words and letter runs, with a counterfactual penalty.

Every sentence of a labelled text that mentions a group is written again with the mention swapped for another
group of its kind. The loss adds ``penalty * (score(sentence) - score(swapped))**2`` (scores as log odds) for each
such pair, so that the model can't learn that a group itself is toxic. Training reads at most ``most`` labelled
rows of the training folds; the model has a fixed size (2**20 weights).

Edge cases: missing and empty texts get the score of the bias. Without labels of both classes the score is the
smoothed share of label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import Lookup, fold, labelled_sample
from fleetscope.llm.features import WIDTH, all_pieces, list_rows, pieces, plain, sigmoid, sparse

PARTS, HELD = 5, 0

# Mentions of groups, by kind; a mention is swapped for the next one of its row.
GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
SWAP = {term: row[(at + 1) % len(row)] for row in GROUPS for at, term in enumerate(row)}
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def swapped(sentence: str) -> str | None:
    """The sentence with every mention swapped; None without a mention."""
    words = sentence.split()
    found = [(at, SWAP[word]) for at, word in enumerate(map(plain, words)) if word in SWAP]
    for at, other in found:
        words[at] = other
    return " ".join(words) if found else None


def counterfactuals(text: str | None) -> list[tuple[str, str]]:
    pairs = []
    if text:
        for sentence in SENTENCE.findall(text):
            other = swapped(sentence)
            if other is not None:
                pairs.append((sentence, other))
    return pairs


def distinct_use(row, column, labels, least: int) -> np.ndarray:
    """By bucket: the log odds ratio of its use in the classes, in standard errors; 0 below ``least`` rows."""
    toxic = np.bincount(column[labels[row] == 1], minlength=WIDTH)
    clean = np.bincount(column[labels[row] == 0], minlength=WIDTH)
    some, none = (labels == 1).sum(), (labels == 0).sum()
    odds = np.log((toxic + 0.5) / (some - toxic + 0.5)) - np.log((clean + 0.5) / (none - clean + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) + 1 / (some - toxic + 0.5) + 1 / (none - clean + 0.5))
    return np.where(toxic + clean >= least, np.abs(odds) / error, 0.0)


def train(rows, labels, pairs, penalty=1.0, ridge=1e-4, least=3, certain=4.0, steps=250) -> dict:
    """``pairs``: buckets of sentences and of their swapped forms. Buckets that don't tell the classes apart
    by ``certain`` standard errors get no weight."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        return {"weights": np.zeros(WIDTH, np.float32), "bias": float(np.log(share / (1 - share)))}
    row, column = sparse(rows)
    telling = distinct_use(row, column, labels, least)[column] >= certain
    row, column = row[telling], column[telling]
    used, column = np.unique(column, return_inverse=True)
    place = np.full(WIDTH, -1, np.int64)
    place[used] = np.arange(len(used))
    sides = []
    for side in (0, 1):
        at, bucket = sparse([pair[side] for pair in pairs])
        sides.append((at[place[bucket] >= 0], place[bucket][place[bucket] >= 0]))
    count, apart = len(rows), len(pairs)
    weights, bias = np.zeros(len(used)), float(np.log(labels.mean() / (1 - labels.mean())))
    speed, speed_bias = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        wrong = (sigmoid(np.bincount(row, weights[column], count) + bias) - labels) / count
        slope = np.bincount(column, wrong[row], len(used)) + ridge * weights
        if apart:
            gap = np.bincount(sides[0][0], weights[sides[0][1]], apart) - np.bincount(sides[1][0], weights[sides[1][1]], apart)
            gap *= 2 * penalty / apart
            slope += np.bincount(sides[0][1], gap[sides[0][0]], len(used)) - np.bincount(sides[1][1], gap[sides[1][0]], len(used))
        speed, speed_bias = speed + slope**2, speed_bias + wrong.sum() ** 2
        weights = weights - 0.5 * slope / np.sqrt(speed)
        bias -= 0.5 * wrong.sum() / speed_bias**0.5
    whole = np.zeros(WIDTH, np.float32)
    whole[used] = weights
    return {"weights": whole, "bias": float(bias)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000, penalty: float = 1.0) -> dict:
    """Train on at most ``most`` labelled rows outside the held-out fold."""
    kind = pa.list_(pa.int32())

    def encode(batches):
        of_word = Lookup(pieces)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [counterfactuals(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("label"),
                    pa.array([all_pieces(text, of_word) for text in texts], kind),
                    pa.array([[all_pieces(one, of_word) for one, _ in found] for found in pairs], pa.list_(kind)),
                    pa.array([[all_pieces(other, of_word) for _, other in found] for found in pairs], pa.list_(kind)),
                ],
                ["id", "label", "found", "said", "swapped"],
            )

    sample = labelled_sample(docs, labels, label, PARTS, HELD, most)
    got = sample.mapInArrow(encode, "id long, label int, found array<int>, said array<array<int>>, swapped array<array<int>>").toArrow().sort_by("id")
    sides = [list_rows(pa.chunked_array([chunk.flatten() for chunk in got.column(name).chunks], kind)) for name in ("said", "swapped")]
    pairs = list(zip(*sides, strict=True))
    return train(list_rows(got.column("found")), got.column("label").to_numpy().astype(np.float64), pairs, penalty)


def toxicity_scores(docs: DataFrame, model: dict, at_least: float = 0.5) -> DataFrame:
    """``doc_id`` with held_out, score and predicted, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 weights

    def work(batches):
        weights, bias = shared.value["weights"].astype(np.float64), shared.value["bias"]
        active = frozenset(np.flatnonzero(weights).tolist())
        of_word = Lookup(lambda word: tuple(active & pieces(word)))  # empty for most words
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                found = all_pieces(text, of_word)
                scores.append(float(sigmoid(weights[found].sum() + bias)) if found else float(sigmoid(bias)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
