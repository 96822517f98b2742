"""Operators 1, 2, 8 and 9 against brute force, planted cases and held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import words

from fleetscope.llm import line_crf, nb_svm, pii, toxicity
from fleetscope.llm.common import fold
from fleetscope.llm.features import NGrams


def naive_repeats(tokens):
    seen, covered = {}, set()
    for at in range(len(tokens) - 2):
        seen.setdefault(tuple(tokens[at : at + 3]), []).append(at)
    for places in seen.values():
        if len(places) > 1:
            covered.update(place + step for place in places for step in range(3))
    return len(covered)


def test_repeat_words_like_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        tokens = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 20))]
        assert line_crf.repeat_words(tokens) == naive_repeats(tokens)


def test_viterbi_finds_the_best_of_all_paths():
    draw = random.Random(2)
    for _ in range(200):
        scores = [draw.uniform(-2, 2) for _ in range(draw.randint(1, 7))]
        stay, first = (draw.uniform(-1, 1), draw.uniform(-1, 1)), draw.uniform(-1, 1)

        def value(path, scores=scores, stay=stay, first=first):
            total = first * path[0] + sum(score for score, state in zip(scores, path, strict=True) if state)
            return total + sum(stay[one] for one, other in itertools.pairwise(path) if one == other)

        best = max(itertools.product([False, True], repeat=len(scores)), key=value)
        assert value(line_crf.viterbi(scores, stay, first)) == pytest.approx(value(best))


def test_crf_learns_and_keeps_clean_texts(spark):
    clean = ["The quick fox jumps over that lazy dog near this old river bank.\n" * 1 + " ".join(f"word{at}{n}" for n in range(70)) + "." for at in range(30)]
    junk = ["\n".join(f"ITEM{n} | {at} | ##" for n in range(40)) for at in range(30)]
    rows = [(at, text) for at, text in enumerate(clean + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(at, int(at < 30)) for at in range(60)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels)
    assert model["weights"].any()
    kept = {row.doc_id: row.kept for row in line_crf.line_quality(docs, model).collect()}
    assert kept == {at: at < 30 for at in range(60)}


def test_line_quality_on_edges(spark, edge_rows, edge_docs, no_docs):
    model = line_crf.train([], [])
    got = line_crf.line_quality(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    want = []
    for doc_id, text in edge_rows:
        text = text or ""
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        repeats = naive_repeats(tokens)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        failed = len(tokens) < 50 or 100 * repeats > 50 * len(tokens)
        want.append((doc_id, len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed))
    assert sorted(map(str, want)) == sorted(str(tuple(row)[:7]) for row in got)
    assert all(row.kept == (not row.base_failed) for row in got)  # without training every line is content
    assert line_crf.line_quality(no_docs, model).count() == 0


def labelled(spark, rows, name):
    docs = spark.createDataFrame([(at, text) for at, (text, _) in enumerate(rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(at, label) for at, (_, label) in enumerate(rows)], f"doc_id long, {name} int")


def held_out_accuracy(scored, labels, name):
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    return sum(row.predicted == row[name] for row in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    draw = random.Random(3)
    good = [(words(draw, 60).capitalize() + ".", 1) for _ in range(150)]
    bad = [(" ".join([draw.choice(["Buy", "Now"])] * 10) + " " + words(draw, 8).upper() + "!!", 0) for _ in range(150)]
    rows = good + bad
    draw.shuffle(rows)
    docs, labels = labelled(spark, rows, "quality")
    scored = nb_svm.quality_scores(docs, nb_svm.fit(docs, labels))
    assert held_out_accuracy(scored, labels, "quality") > 0.95
    assert {row.held_out for row in scored.select("held_out").distinct().collect()} == {True, False}


def test_held_out_labels_are_not_learnt(spark):
    rows = [(f"text number {at}", at % 2) for at in range(200)]
    docs, labels = labelled(spark, rows, "quality")
    held = labels.where(fold("doc_id", 4) == 2).selectExpr("doc_id", "1 - quality AS quality")
    changed = labels.where(fold("doc_id", 4) != 2).unionByName(held)
    one, other = nb_svm.fit(docs, labels), nb_svm.fit(docs, changed)
    assert np.array_equal(one["weights"], other["weights"])


def test_swapped_mentions_don_t_change_the_score(spark):
    draw = random.Random(4)
    toxic = [(f"{words(draw, 20)}. muslims are scum and idiots. {words(draw, 20)}", 1) for _ in range(120)]
    clean = [(f"{words(draw, 20)}. {draw.choice(['christians', 'hindus'])} met today. {words(draw, 20)}", 0) for _ in range(240)]
    docs, labels = labelled(spark, toxic + clean, "toxic")
    neutral = spark.createDataFrame([(1, "muslims met today."), (2, "christians met today."), (3, "christians are scum and idiots.")], "doc_id long, text string")

    def gap(penalty):
        got = {row.doc_id: row for row in toxicity.toxicity_scores(neutral, toxicity.fit(docs, labels, penalty=penalty)).collect()}
        return abs(got[1].score - got[2].score), got

    free, _ = gap(0.0)
    held, got = gap(10.0)
    assert held < free / 4
    assert (got[1].predicted, got[2].predicted, got[3].predicted) == (0, 0, 1)
    assert held_out_accuracy(toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)), labels, "toxic") > 0.95


def test_mentions_are_swapped_within_their_kind():
    assert toxicity.swapped("The Muslims left.") == "The jews left."
    assert toxicity.swapped("Nobody left.") is None
    assert len(toxicity.counterfactuals("Women ran. Men sat! None.")) == 2


def test_classifiers_on_edges(spark, edge_rows, edge_docs, no_docs):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int, lang string")
    clashing = spark.createDataFrame([(1, 1, 1, "x"), (1, 0, 0, "x"), (None, 1, 1, "x"), (5, None, None, "x")], nothing.schema)
    for labels in (nothing, clashing):
        for docs in (edge_docs, no_docs):
            good = nb_svm.quality_scores(docs, nb_svm.fit(docs, labels))
            toxic = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
            for scored in (good, toxic):
                got = scored.collect()
                assert len(got) == (len(edge_rows) if docs is edge_docs else 0)
                assert all(0 <= row.score <= 1 for row in got)
    model = nb_svm.fit(edge_docs, nothing)
    assert nb_svm.keep_good(edge_docs, model, 0.0).columns == edge_docs.columns
    assert nb_svm.keep_good(edge_docs, model, 0.0).count() == len(edge_rows)


def test_ngrams_of_a_text_don_t_depend_on_earlier_texts():
    draw = random.Random(6)
    texts = [words(draw, 50) for _ in range(20)]
    shared = NGrams(2, 3)
    assert all(np.array_equal(shared(text), NGrams(2, 3)(text)) for text in texts)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    text = text or ""
    count = lambda found: len(re.findall("[0-9]", found[0]))
    spans = [(found.start(), 0, found.end()) for found in EMAIL.finditer(text)]
    spans += [(found.start(), 1, found.end()) for found in IP.finditer(text) if all(int(part) < 256 for part in found[0].split("."))]
    spans += [(found.start(), 2, found.end()) for found in CARD.finditer(text) if 12 <= count(found) <= 19 and pii.luhn(re.sub("[^0-9]", "", found[0]))]
    spans += [(found.start(), 3, found.end()) for found in PHONE.finditer(text) if 9 <= count(found) <= 15]
    return sorted(spans)


def test_base_kinds_like_the_patterns():
    draw, automaton = random.Random(7), pii.anchors()
    for _ in range(30_000):
        text = "".join(draw.choice("ab123456789012..--  @@+()é%") for _ in range(draw.randint(1, 40)))
        assert [span for span in pii.find_spans(text, automaton) if span[1] < 4] == base_spans(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_added_kinds_are_checked():
    automaton = pii.anchors()
    text = "IBAN: GB82 WEST 1234 5698 7654 32, IBAN GB82 WEST 1234 5698 7654 33, account no. 12345678, ftp://me:pw@host.example/x, api_key=abcd1234efgh"
    found = [(pii.KINDS[kind], text[start:end]) for start, kind, end in pii.find_spans(text, automaton) if kind > 3]
    assert found == [
        ("iban", "GB82 WEST 1234 5698 7654 32"),
        ("account", "12345678"),
        ("login", "ftp://me:pw@host.example"),
        ("secret", "abcd1234efgh"),
    ]


def test_personal_data_on_edges(edge_rows, edge_docs, no_docs):
    got = pii.personal_spans(edge_docs).collect()
    numbers = {kind: at for at, kind in enumerate(pii.KINDS)}
    seen = sorted(str((row.doc_id, [(span.start, numbers[span.kind], span.end) for span in row.spans if numbers[span.kind] < 4])) for row in got)
    assert seen == sorted(str((doc_id, base_spans(text))) for doc_id, text in edge_rows)
    assert pii.personal_spans(no_docs).count() == 0 == pii.redact(no_docs).count()
    clean = pii.redact(edge_docs)
    assert clean.columns == edge_docs.columns
    texts = [row.text for row in clean.where("doc_id = 7").collect()]
    assert texts == ["mail [EMAIL] [PHONE]"]
    assert clean.where("text IS NULL").count() == sum(text is None for _, text in edge_rows)


def test_overlapping_spans_become_one():
    assert pii.redact_text("x 12345 y", [(2, 2, 5), (4, 3, 7)]) == "x [CARD] y"
