"""Operators 11, 12 and 13 against brute force, on small tables with every odd case, and held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from fleetscope.llm import bloom, collocations, filter_audit, string_kernel

DOCS = "doc_id long, text string, lang string"


# Filter interaction


def failures(rows):
    """(part, set of filters) of every row, from the conditions as they are worded."""
    made = []
    for doc_id, text, lang in rows:
        text = text or ""
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(tokens) < 200:
            failed.add("A")
        if 100 * len(set(tokens)) < 50 * len(tokens):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if doc_id is not None and any(other is not None and other < doc_id and (same or "") == text for other, same, _ in rows):
            failed.add("E")
        made.append((lang or "", failed))
    return made


def naive_audit(rows, labels):
    good = {doc_id for doc_id, quality, _ in labels if quality == 1 and doc_id is not None}
    toxic = {doc_id for doc_id, _, mark in labels if mark == 1 and doc_id is not None}
    parts = defaultdict(list)
    for (doc_id, _, _), (part, failed) in zip(rows, failures(rows), strict=True):
        parts[part].append((doc_id, failed))
    out = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(members)
            for step, letter in enumerate(order, 1):
                removed = [one for one in left if letter in one[1]]
                left = [one for one in left if letter not in one[1]]
                failing = sum(letter in failed for _, failed in members)
                alone = sum(failed == {letter} for _, failed in members)
                lost = [sum(doc_id in marked for doc_id, _ in removed) for marked in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), alone, *lost]
                shapley[letter] += len(removed)
        for (name, order, step), values in out.items():
            if name == part:
                values.append(shapley[order[step - 1]])
    return {key: tuple(values) for key, values in out.items()}


def audit_rows():
    draw = random.Random(3)
    long_text = words(draw, 260, "abcdefgh")
    texts = [long_text, long_text, "", None, None, "short", "short", "A #1", words(draw, 220, "ab"), long_text.upper(), "x " * 300, "1|2 " * 210, "É" * 90 + "ABC", "É" * 97 + "ABC"]
    rows = [(at, text, draw.choice(["en", "de", None, ""])) for at, text in enumerate(texts)]
    rows += [(3, None, "en"), (7, "A #1", "en"), (7, "another", "fr"), (None, "short", "en"), (None, "alone", None), (None, long_text, "de")]
    rows += [(100 + at, words(draw, draw.choice([150, 240]), draw.choice(["ab", "abcdefg", "ABCdefg", "ab$"])), draw.choice(["en", "de"])) for at in range(60)]
    draw.shuffle(rows)
    return rows


def test_audit_like_every_order_by_hand(spark):
    rows = audit_rows()
    draw = random.Random(4)
    labels = [(doc_id, draw.choice([0, 1, None]), draw.choice([0, 1])) for doc_id, _, _ in rows if draw.random() < 0.7]
    labels += [(3, 1, 1), (3, 1, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*row, 1, 2) for row in rows], DOCS + ", mask int, documents int").repartition(4)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(row)[:3]: tuple(row)[3:] for row in got.collect()}
    assert found == naive_audit(rows, labels)


def test_potentials_are_those_of_the_definition(spark):
    draw = random.Random(5)
    worth = [0] + [draw.randint(0, 1000) for _ in range(31)]
    got = spark.range(1).select(filter_audit.potentials(F.array(*[F.lit(one).cast("long") for one in worth])).alias("p")).first().p
    potential = {0: 0.0}
    for coalition in range(1, 32):
        inside = [at for at in range(5) if coalition >> at & 1]
        potential[coalition] = (worth[coalition] + sum(potential[coalition ^ 1 << at] for at in inside)) / len(inside)
        assert got[coalition] == pytest.approx(math.factorial(len(inside)) * potential[coalition])
    # The shares of all filters are all that the whole coalition removes.
    assert sum(got[31] - 5 * got[31 ^ 1 << at] for at in range(5)) == 120 * worth[31]


def test_audit_of_edges_and_nothing(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(edge_docs, labels)
    assert {tuple(row)[:3]: tuple(row)[3:] for row in got.collect()} == naive_audit([(*row, "en") for row in edge_rows], [])
    assert filter_audit.audit(no_docs, labels).count() == 0


# Collocations


def naive_collocations(rows, longest=3, least=10, first=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(sign) + 32) if "A" <= sign <= "Z" else sign for sign in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            tokens = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(tokens)
            for size in range(1, longest + 1):
                for at in range(len(tokens) - size + 1):
                    counts[lang][tuple(tokens[at : at + size])] += 1
    out = []
    for lang, seen in counts.items():
        often = {phrase: n for phrase, n in seen.items() if n >= least and len(phrase) > 1}
        dropped = set()
        for phrase, n in often.items():
            for size in range(2, len(phrase)):
                for at in range(len(phrase) - size + 1):
                    if 100 * n >= 50 * seen[phrase[at : at + size]]:
                        dropped.add(phrase[at : at + size])
        ranked = []
        for phrase, a in often.items():
            if phrase in dropped:
                continue
            score, _, left, right = min((1_000_000 * a * a // (seen[phrase[:k]] * seen[phrase[k:]]), k, seen[phrase[:k]], seen[phrase[k:]]) for k in range(1, len(phrase)))
            ranked.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed=6):
    draw = random.Random(seed)
    vocabulary = ["new", "york", "Times", "é中", "a-b", "x\x0bq", "’s", "ß", "of", "the", "the"]
    rows = []
    for _ in range(160):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " the new york times "]) for _ in range(draw.randint(0, 30)))
        rows.append((text, draw.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("New York " * 3000, "en"), *[("copied text of the copy", "fr")] * 50]


@pytest.mark.parametrize(("bits", "longest", "least"), [(64, 3, 10), (7, 3, 10), (3, 2, 12), (64, 4, 5)])
def test_collocations_like_counting_every_phrase(spark, monkeypatch, bits, longest, least):
    monkeypatch.setattr(collocations, "RUN_GRAMS", 500)
    monkeypatch.setattr(collocations, "RUN_BYTES", 300)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], "text string, lang string, n int, size int, key int").repartition(3)
    got = collocations.collocations(docs, longest, least, first=40, bits=bits, bucket_bytes=5000)
    assert sorted(map(tuple, got.collect())) == naive_collocations(rows, longest, least, 40)


def test_collocations_of_edges_and_nothing(spark, edge_docs, edge_rows, no_docs):
    got = collocations.collocations(edge_docs, least=3)
    assert sorted(map(tuple, got.collect())) == naive_collocations([(text, "en") for _, text in edge_rows], least=3)
    assert collocations.collocations(no_docs).count() == 0


def test_fingerprints_are_polynomials_of_their_values():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1 << 64, 40, np.uint64)
    starts = np.array([0, 3, 5, 39, 7])
    ends = np.array([40, 3, 9, 40, 30])
    powers = collocations.Powers(collocations.BASES[0])
    got = collocations.fingerprints(values, starts, ends, powers)
    for start, end, one in zip(starts.tolist(), ends.tolist(), got, strict=True):
        assert int(one) == sum(int(values[at]) * pow(collocations.BASES[0], at - start, 1 << 64) for at in range(start, end)) % (1 << 64)


def test_scores_past_64_bits_are_exact(spark):
    big = 9 * 10**13 + 7
    rows = [("en", 1, "a", big + 12), ("en", 1, "b", big + 5), ("en", 2, "a b", big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long"), 3).first()
    assert got.score == 1_000_000 * big * big // ((big + 12) * (big + 5))


def test_bloom_filter_lets_all_its_keys_through(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS key").repartition(3)
    table = bloom.build(rows, collocations.column_keys("key"))
    keys = np.array([row.key for row in rows.collect()]).view(np.uint64)
    assert bloom.passes(table, keys).all()
    others = np.random.default_rng(2).integers(0, 1 << 64, 100_000, np.uint64)
    assert bloom.passes(table, others).mean() < 0.02
    assert not bloom.passes(bloom.build(rows.limit(0), collocations.column_keys("key")), others).any()


# Language


def test_kernel_counts_shared_ngrams_once():
    def ngrams(text):
        runs = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
        return {runs[at : at + size] for size in range(1, 5) for at in range(len(runs) - size + 1)}

    one, other = "Der Hund, der 12 Hunde sah.", "Die Hündin sah den Hund"
    rows = string_kernel.Presence()([string_kernel.spectrum(one), string_kernel.spectrum(other)])
    got = string_kernel.kernel(rows, rows)[0, 1]
    assert got == pytest.approx(len(ngrams(one) & ngrams(other)) / math.sqrt(len(ngrams(one)) * len(ngrams(other))), rel=0.02)


def test_folded_matrix_scores_like_landmarks():
    """The one product over buckets gives what kernel values with all landmarks and their coefficients give."""
    draw = random.Random(8)
    texts = [words(draw, 40, letters) for letters in ("abcde", "efghi") for _ in range(30)]
    names = ["one"] * 30 + ["two"] * 30
    order = list(range(60))
    draw.shuffle(order)
    rows = np.zeros((60, string_kernel.WIDTH), np.float32)
    for row, at in zip(rows, order, strict=True):
        row[string_kernel.spectrum(texts[at])] = 1
    model = string_kernel.train(np.packbits(rows.astype(np.uint8), axis=1), [names[at] for at in order], landmarks=60)
    # With every row a landmark, Nyström is exact: kernel ridge regression in its dual form, here with equal shares.
    like = string_kernel.kernel(rows, rows)
    target = np.array([[1.0, -1.0] if names[at] == "one" else [-1.0, 1.0] for at in order])
    centre = np.eye(60) - 1 / 60
    dual = np.linalg.solve(centre @ like @ centre + 60 * 1e-3 * np.eye(60), centre @ target)
    exact = (like - like.mean(0)) @ centre @ dual + target.mean(0)
    got = (rows @ model["weights"]) / np.sqrt(rows.sum(1))[:, None] + model["offset"]
    assert np.abs(got - exact).max() < 1e-3


def test_languages_of_held_out_rows(spark):
    draw = random.Random(7)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "hijkl"}
    rows = [(at, words(draw, 30, letters[lang]), lang) for at, lang in enumerate(draw.choices(list(letters), [9, 3, 1], k=400))]
    rows += [(1000 + at, rows[0][1], rows[0][2]) for at in range(400)]  # a large group of copies
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = string_kernel.fit(docs, most=200)
    got = string_kernel.languages(docs, model).collect()
    want = {doc_id: lang for doc_id, _, lang in rows}
    held = [row for row in got if row.held_out]
    assert len(held) > 100 and all(row.lang_pred == want[row.doc_id] and 0.0 < row.score <= 1.0 for row in held)
    # Neither lang nor id is an input: the held-out rows may say what they like.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert string_kernel.fit(other, most=200)["languages"] == ["aa", "bb", "cc"]


def test_languages_on_edges(spark, edge_docs, edge_rows, no_docs):
    model = string_kernel.fit(edge_docs)
    got = string_kernel.languages(edge_docs, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = Counter((doc_id, "en" if any(map(str.isalpha, text or "")) else "und") for doc_id, text in edge_rows)
    assert Counter((row.doc_id, row.lang_pred) for row in got.collect()) == want
    assert string_kernel.languages(no_docs, string_kernel.fit(no_docs)).count() == 0
    untaught = string_kernel.fit(edge_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {row.lang_pred for row in string_kernel.languages(edge_docs, untaught).collect()} == {"und"}
    numbers = spark.createDataFrame([(1, "12 ² ½ _"), (2, "一"), (3, "Ⅷ")], "doc_id long, text string")
    assert {row.doc_id: row.lang_pred for row in string_kernel.languages(numbers, model).collect()} == {1: "und", 2: "en", 3: "und"}
