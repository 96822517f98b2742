"""Operator 1: lines are labelled content or boilerplate by Viterbi decoding of a linear-chain CRF.

The chain has two states. A line is described by a few yes/no observations, so a line is one small integer and
the emission scores of all possible lines are one table. The weights are trained by maximum likelihood on a
bounded sample of labelled documents: the lines of a document take its quality label.

Edge cases: a missing text counts as the empty one; it has no words and fails the base rules. Lines without a
word belong to the chain but carry no weight in the content share. On a tie of two paths a line is content.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import labelled_sample

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
DIGITS = b"0123456789"
FEATURES = 14
MARKS = re.compile(rb"[!?#*$%&]{2,}")
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_content_words long"
)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside runs of ``size`` words that occur at least twice in the text."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))
    runs = np.zeros(len(ids) - size + 1, np.int64)
    for at in range(size):  # renumber after each word, so numbers never overflow
        runs = runs * len(numbers) + ids[at : at + len(runs)]
        if at + 1 < size and len(numbers) > 2_000_000:
            runs = np.unique(runs, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for at in range(size):
        covered[at : at + len(runs)] |= twice
    return int(covered.sum())


def line_code(line: bytes, words: list[bytes], seen: bool) -> int:
    """The observations of a line as bits."""
    count, length = len(words), max(len(line), 1)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    digits = len(line) - len(line.translate(None, DIGITS))
    distinct = len(set(words))
    upper = line.isupper()
    bits = (
        count == 0,
        0 < count < 4,
        4 <= count < 12,
        count >= 40,
        line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"'),
        symbols * 50 > length,
        symbols * 10 > length,
        digits * 5 > length,
        upper and count > 2,
        seen and count > 0,
        count > 5 and distinct * 2 < count,
        count > 5 and distinct * 5 < count * 4,
        b"|" in line or b"\t" in line,
        len(MARKS.findall(line)) * 8 > count > 0,
    )
    return sum(1 << at for at, bit in enumerate(bits) if bit)


def read_lines(data: bytes) -> tuple[list[int], list[int], int]:
    """Code and number of words of every line, and how many lines with a word repeat an earlier one."""
    codes, weights, repeated, earlier = [], [], 0, set()
    for line in data.split(b"\n"):
        words = line.split()
        seen = line in earlier
        if words:
            repeated += seen
            earlier.add(line)
        codes.append(line_code(line, words, seen))
        weights.append(len(words))
    return codes, weights, repeated


def emissions(weights: np.ndarray) -> np.ndarray:
    """Score of being content minus score of being boilerplate, for every possible code."""
    codes = np.arange(1 << FEATURES)
    bits = (codes[:, None] >> np.arange(FEATURES)) & 1
    return bits @ weights[:FEATURES] + weights[FEATURES]


def viterbi(scores: list[float], stay: tuple[float, float], first: float = 0.0) -> list[bool]:
    """Best path; ``scores`` favour content, ``stay`` are the gains of staying boilerplate and staying content."""
    back: list[tuple[bool, bool]] = []
    junk, content = 0.0, first + scores[0]
    for score in scores[1:]:
        to_junk = (junk + stay[0], content)
        to_content = (junk, content + stay[1])
        back.append((to_junk[1] >= to_junk[0], to_content[1] >= to_content[0]))
        junk, content = max(to_junk), max(to_content) + score
    state = content >= junk
    path = [state]
    for from_junk, from_content in reversed(back):
        state = from_content if state else from_junk
        path.append(state)
    path.reverse()
    return path


def train(sequences: list[list[int]], labels: list[int], chunk: int = 64, rounds: int = 150) -> dict:
    """Weights by gradient ascent on the likelihood; long documents are cut into runs of ``chunk`` lines."""
    runs = [(codes[at : at + chunk], label) for codes, label in zip(sequences, labels, strict=True) for at in range(0, len(codes), chunk)]
    if not runs or len({label for _, label in runs}) < 2:
        return {"weights": np.append(np.zeros(FEATURES), 1.0), "stay": (0.0, 0.0)}
    length = np.array([len(codes) for codes, _ in runs])
    label = np.array([label for _, label in runs])
    codes = np.zeros((len(runs), chunk), np.int64)
    for row, (values, _) in enumerate(runs):
        codes[row, : len(values)] = values
    inside = np.arange(chunk) < length[:, None]
    share = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())  # both labels weigh the same
    share = (share / length)[:, None] * inside
    bits = ((codes[..., None] >> np.arange(FEATURES)) & 1).astype(np.float32)
    weights, stay = np.zeros(FEATURES + 1), np.zeros(2)
    speed_w, speed_s = np.full(FEATURES + 1, 1e-8), np.full(2, 1e-8)
    for _ in range(rounds):
        score = bits @ weights[:FEATURES] + weights[FEATURES]
        emit = np.stack([np.zeros_like(score), score], -1)
        step = np.array([[stay[0], 0.0], [0.0, stay[1]]])
        forward, backward = np.zeros((chunk, len(runs), 2)), np.zeros((chunk, len(runs), 2))
        forward[0] = emit[:, 0]
        for at in range(1, chunk):
            moved = np.logaddexp.reduce(forward[at - 1][:, :, None] + step, axis=1) + emit[:, at]
            forward[at] = np.where(inside[:, at, None], moved, forward[at - 1])
        for at in range(chunk - 2, -1, -1):
            moved = np.logaddexp.reduce(step + (emit[:, at + 1] + backward[at + 1])[:, None, :], axis=2)
            backward[at] = np.where(inside[:, at + 1, None], moved, 0.0)
        total = np.logaddexp.reduce(forward[-1], axis=1)
        chance = np.exp(forward[:, :, 1].T + backward[:, :, 1].T - total[:, None])
        wrong = (label[:, None] - chance) * share
        slope_w = np.append(np.einsum("nt,ntf->f", wrong, bits), wrong.sum()) - 1e-4 * weights
        slope_s = np.zeros(2)
        both = share[:, 1:].T
        for state in (0, 1):
            pair = np.exp(forward[:-1, :, state] + stay[state] + emit[:, 1:, state].T + backward[1:, :, state] - total)
            slope_s[state] = (((label == state) - pair) * both).sum() - 1e-2 * stay[state]
        speed_w, speed_s = speed_w + slope_w**2, speed_s + slope_s**2
        weights, stay = weights + 0.5 * slope_w / np.sqrt(speed_w), stay + 0.5 * slope_s / np.sqrt(speed_s)
    return {"weights": weights, "stay": (float(stay[0]), float(stay[1]))}


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000) -> dict:
    """Train on at most ``most`` labelled documents; only the codes of their lines reach the driver."""

    def encode(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            codes = [read_lines((text or "").encode())[0] for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(codes, pa.list_(pa.int32())), batch.column("label")], ["id", "codes", "label"])

    sample = labelled_sample(docs, labels, "quality", 1, 1, most)
    rows = sample.mapInArrow(encode, "id long, codes array<int>, label int").collect()
    rows.sort(key=lambda row: (row.id, row.codes))
    return train([row.codes for row in rows], [row.label for row in rows])


def describe(text: str | None, table: np.ndarray, stay: tuple[float, float], share: float) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    count = len(words)
    codes, weights, repeated = read_lines(data)
    repeats = repeat_words(words)
    failed = count < 50 or 100 * repeats > 50 * count
    path = viterbi(table[codes].tolist(), stay)
    content = sum(weight for weight, state in zip(weights, path, strict=True) if state)
    return (
        count,
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        repeated,
        repeats,
        failed,
        not failed and content >= share * count,
        len(codes),
        content,
    )


def line_quality(docs: DataFrame, model: dict, share: float = 0.5) -> DataFrame:
    """One row per document: base counts, base verdict, and ``kept`` by the share of words in content lines."""
    table, stay = emissions(model["weights"]), model["stay"]
    names = [part.split()[0] for part in SCHEMA.split(", ")][1:]
    kinds = [pa.bool_() if name in ("base_failed", "kept") else pa.int64() for name in names]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [describe(text, table, stay, share) for text in part.column("text").to_pylist()]
                columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
