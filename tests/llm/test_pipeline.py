"""The pipeline against its operators run one by one on a small table."""

import random

import public_tokenizers
import pytest
import tiktoken
from conftest import words
from test_archives import brute_hits
from test_jaccard import brute_force

import corpus_pipeline
from fleetscope.llm import pii
from fleetscope.llm.pretokens import load_ranks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    root = tmp_path_factory.mktemp("pipeline")
    item = words(draw, 30, "mnop")
    docs, labels = [], []
    for at in range(120):
        good = at % 3 > 0
        text = words(draw, 80).capitalize() + "." if good else " ".join(["Buy!!", "NOW##"] * 30)
        docs.append((at, text))
        labels.append((at, int(good), 0))
    docs += [(200, docs[1][1]), (201, docs[2][1] + " more"), (202, f"{words(draw, 20).capitalize()}. {item}"), (203, f"{docs[4][1]} Write to joe@mail.example today."), (204, None)]
    spark.createDataFrame([(at, text, "en", "s", len(text or "")) for at, text in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), dict(docs), item


def test_stages(spark, folder):
    root, texts, item = folder
    docs = corpus_pipeline.table(spark, root, "documents")
    columns, seen = docs.columns, [{row.doc_id: row.text for row in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, root), name)
        if name != "byte_bpe":
            assert docs.columns == columns
            seen.append({row.doc_id: row.text for row in docs.collect()})
    start, good, single, clean, safe = seen
    assert set(good) <= set(start) and all(at % 3 for at in good if at < 120) and len(good) >= 80
    assert set(single) == {row[2] for row in brute_force(list(good.items()))}
    assert set(clean) == {at for at, text in single.items() if not (hit := brute_hits(text, [(1, item)]))[1] or 20 * len(hit[1]) < hit[0]}
    automaton = pii.anchors()
    assert safe == {at: text and pii.redact_text(text, pii.find_spans(text, automaton)) for at, text in clean.items()}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    assert {row.doc_id: row.n_tokens for row in docs.collect()} == {at: len(coder.encode_ordinary(text or "")) for at, text in safe.items()}
    assert 202 not in safe and 200 not in safe


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 70


def test_odd_rows_and_columns(spark, folder, tmp_path):
    root, texts, item = folder
    rows = [(at, text, at * 3, [f"i{at}"], "mine", "spans") for at, text in texts.items()]
    # A repeated row, an unrelated text and a near copy under an id in use, no text, no id.
    rows += [rows[1], (1, texts[7], 5, None, None, None), (2, texts[8] + " more", 6, None, None, None), (300, "", 0, [], "", ""), (None, texts[10], 1, [], "x", "y"), (None, None, None, None, None, None)]
    names = "doc_id long, text string, n_words long, items array<string>, decoded string, Spans string"
    docs = spark.createDataFrame(rows, names)
    for name in ("labels", "benchmark"):
        corpus_pipeline.table(spark, root, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = {(row.doc_id, row.n_words, row.decoded, row.Spans) for row in docs.collect()}
    kept = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        assert {(row.doc_id, row.n_words, row.decoded, row.Spans) for row in kept.collect()} <= given
    ids = [row.doc_id for row in kept.collect()]
    # The rows of 1 and 2 with the texts of 7 and 8 stand for those classes, since theirs are the smaller ids.
    assert ids.count(1) == ids.count(2) == 2 and not {7, 8, 200, 201, 202} & set(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(ids) and all(row.n_tokens == 0 for row in out if row.doc_id == 300)


def test_no_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        rows = corpus_pipeline.table(spark, folder[0], name)
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
