"""Operator 8: naive Bayes support vectors score the quality of documents.

Indicators of hashed n-grams are scaled by the log ratio of their class counts; a linear hinge-loss model on the
scaled, unit-length rows is fitted by dual coordinate descent. Margins of rows left out of that fit give the
logistic curve that turns a margin into a probability. Training reads at most ``most`` labelled rows of the
training folds; the model has a fixed size (2**20 weights), whatever the corpus.

Edge cases: missing and empty texts have no n-gram, so their score is the curve at margin 0 plus bias. With
labels of one class only, or none, the score is the smoothed share of label 1. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import fold, labelled_sample, tidy
from fleetscope.llm.features import WIDTH, NGrams, keep_frequent, list_rows, sigmoid, sparse

PARTS, HELD = 4, 2


def count_ratios(row, column, labels, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of a bucket's share in class 1 to its share in class 0."""
    good = np.bincount(column[labels[row] == 1], minlength=WIDTH) + smooth
    bad = np.bincount(column[labels[row] == 0], minlength=WIDTH) + smooth
    return np.log((good / ((labels == 1).sum() + 2 * smooth)) / (bad / ((labels == 0).sum() + 2 * smooth)))


def dual_descent(rows, values, signs, cost=1.0, rounds=12, seed=0) -> tuple[np.ndarray, float]:
    """Minimise ``|w|^2/2 + cost * sum(hinge)`` over ``w`` by the dual variables in ``[0, cost]``, one at a time."""
    weights, bias = np.zeros(WIDTH), 0.0
    dual = np.zeros(len(rows))
    squares = np.array([float(value @ value) + 1.0 for value in values])  # the bias is a constant indicator
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for at in random.permutation(len(rows)):
            slope = signs[at] * (weights[rows[at]] @ values[at] + bias) - 1.0
            fresh = min(max(dual[at] - slope / squares[at], 0.0), cost)
            change = (fresh - dual[at]) * signs[at]
            if change:
                weights[rows[at]] += change * values[at]
                bias += change
                moved = max(moved, abs(change))
                dual[at] = fresh
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins, labels, rounds=50) -> tuple[float, float]:
    """Slope and offset of a probability, by Newton steps on smoothed targets."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1.0) / (good + 2.0), 1.0 / (bad + 2.0))
    line = np.array([1.0, np.log((good + 1.0) / (bad + 1.0))])
    design = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(rounds):
        chance = sigmoid(design @ line)
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (chance - target))
        line = line - np.clip(step, -2.0, 2.0)
        if abs(step).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def train(rows: list[np.ndarray], labels: np.ndarray, apart: np.ndarray, least: int = 3) -> dict:
    """``apart`` marks the rows kept out of the fit, for the curve."""
    constant = {"ratio": np.zeros(WIDTH, np.float32), "weights": np.zeros(WIDTH, np.float32), "bias": 0.0}
    fit = ~apart
    if len(set(labels[fit])) < 2:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        return constant | {"slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    row, column = sparse([rows[at] for at in np.flatnonzero(fit)])
    often = keep_frequent(row, column, least)
    ratio = np.zeros(WIDTH)
    known = np.unique(column[often])
    ratio[known] = count_ratios(row[often], column[often], labels[fit])[known]

    def scaled(at):
        value = ratio[rows[at]]
        return value / (np.sqrt(value @ value) or 1.0)

    values = [scaled(at) for at in range(len(rows))]
    picked = np.flatnonzero(fit)
    weights, bias = dual_descent([rows[at] for at in picked], [values[at] for at in picked], np.where(labels[picked] == 1, 1.0, -1.0))
    rest = np.flatnonzero(apart)
    if len(set(labels[rest])) < 2:
        rest = picked
    margins = np.array([weights[rows[at]] @ values[at] + bias for at in rest])
    slope, offset = logistic_curve(margins, labels[rest])
    return {"ratio": ratio.astype(np.float32), "weights": weights.astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000) -> dict:
    """Train on at most ``most`` labelled rows outside the held-out fold; bucket numbers alone reach the driver."""

    def encode(batches):
        ngrams = NGrams(2, 3)
        for batch in batches:
            found = [ngrams(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.list_(pa.int32())), batch.column("label")], ["id", "found", "label"])

    sample = labelled_sample(docs, labels, label, PARTS, HELD, most)
    got = sample.mapInArrow(tidy(encode), "id long, found array<int>, label int").toArrow().sort_by("id")
    ids, label = got.column("id").to_numpy(), got.column("label").to_numpy()
    return train(list_rows(got.column("found")), label.astype(np.int64), (ids // 3) % 5 == 0)


def scorer(known: dict):
    """Score of a text, inside a task."""
    ngrams, ratio, product = NGrams(2, 3), known["ratio"], known["ratio"] * known["weights"]
    squares = ratio * ratio

    def score(text: str | None) -> float:
        found = ngrams(text)
        length = float(squares[found].sum(dtype=np.float64))
        margin = float(product[found].sum(dtype=np.float64)) / (length**0.5 or 1.0) + known["bias"]
        return float(sigmoid(known["slope"] * margin + known["offset"]))

    return score


def quality_scores(docs: DataFrame, model: dict, at_least: float = 0.7) -> DataFrame:
    """``doc_id`` with held_out, score and predicted, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 ratios and weights

    def work(batches):
        score = scorer(shared.value)
        for batch in batches:
            scores = [score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, at_least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is high enough, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def work(batches):
        score = scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(text) >= at_least for text in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(work), docs.schema)
