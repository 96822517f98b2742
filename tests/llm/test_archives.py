"""Operators 6, 7 and 10 against brute force and round trips."""

import random
import re
from collections import Counter
from hashlib import sha1

from conftest import words
from pyspark.sql import functions as F

from fleetscope.llm import chat, decontaminate, warc
from fleetscope.llm.common import shared_folder


def page_rows():
    draw = random.Random(1)
    copies = [words(draw, 400) for _ in range(3)]
    rows = [(at, f"http://e.example/{at}", draw.choice([*copies, words(draw, 300), "short", "", None])) for at in range(80)]
    return [*rows, (7, None, copies[0]), (7, None, copies[0]), (None, "http://x.example/a b\r\nc", copies[1]), (200, None, "é" * 600), (201, None, "é" * 600)]


def test_archives_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*row, 1) for row in rows], "page_id long, url string, html string, digest int").repartition(4)
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=4000)
    got = Counter(tuple(row)[:5] for row in warc.read_bundles(index, folder).collect())
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    want = Counter()
    for page_id, _, html in rows:
        payload = (html or "").encode()
        keeper = largest.get(html or "")
        revisit = len(payload) >= 1000 and keeper is not None and page_id != keeper
        want[(page_id, len(payload), sha1(payload).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None)] += 1
    assert got == want
    assert index.count() == len(rows) == index.select("record_id").distinct().count()
    assert index.agg({"frame": "max"}).first()[0] > 0


def test_bundles_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(at, None, f"page {at} " * 200) for at in range(200)], "page_id long, url string, html string").repartition(2)
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=5000)
    read = warc.read_bundles(index, folder, task_bytes=50_000)
    tasks = read.select("page_id", F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(row["count"] for row in tasks) == 200
    assert len(tasks) >= 4 and max(row["count"] for row in tasks) < 100


def test_records_are_fetched_by_frame_and_offset(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    folder = shared_folder(spark, "warc")
    index = warc.write_bundles(pages, folder, frame_bytes=3000)
    some = index.where("page_id IN (3, 44, 200)")
    got = warc.fetch(index, folder, some).collect()
    assert sorted(row.page_id for row in got) == [3, 44, 200]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_folder(spark, "warc")
    assert warc.read_bundles(warc.write_bundles(pages, folder), folder).count() == 0


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))


def brute_hits(text, items):
    tokens, hit, names = plain(text), set(), set()
    for item, body in items:
        parts = plain(body)
        if item is None or not parts:
            continue
        size = min(13, len(parts))
        runs = {tuple(parts[at : at + size]) for at in range(len(parts) - size + 1)}
        for at in range(len(tokens) - size + 1):
            if tuple(tokens[at : at + size]) in runs:
                hit.update(range(at, at + size))
                names.add(str(item))
    return len(tokens), hit, sorted(names)


def contaminated_rows(seed):
    draw = random.Random(seed)
    items = [(at, words(draw, draw.choice([1, 2, 5, 13, 14, 40]), "ab")) for at in range(12)] + [(3, words(draw, 20)), (None, "a b"), (90, None), (91, "--")]
    rows = []
    for at in range(60):
        parts = [words(draw, draw.randint(0, 30), "ab")]
        for _ in range(draw.randint(0, 3)):
            body = (draw.choice(items)[1] or "").split()
            start = draw.randint(0, max(len(body) - 1, 0))
            parts += [", ".join(body[start : start + draw.randint(1, 30)]).upper(), words(draw, draw.randint(0, 9), "abc")]
        rows.append((at, " - ".join(parts)))
    return rows, items


def test_hits_like_brute_force(spark, edge_rows):
    rows, items = contaminated_rows(2)
    rows += edge_rows
    docs = spark.createDataFrame([(*row, 5, "x") for row in rows], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(*row, "x") for row in items], "item_id long, text string, doc_id string")
    for block_words in (200_000, 30):  # one automaton, and several passes
        got = decontaminate.mark_hits(docs, bench, block_words=block_words).collect()
        seen = Counter((row.doc_id, row.n_words, str([(span.start, span.end) for span in row.spans]), str(row["items"])) for row in got)
        want = Counter()
        for doc_id, text in rows:
            count, hit, names = brute_hits(text, items)
            spans = decontaminate.joined([(at, at + 1) for at in hit])
            want[(doc_id, count, str(spans), str(names))] += 1
        assert seen == want


def test_hits_are_cut_and_contaminated_texts_go(spark):
    item = " ".join(f"q{at}" for at in range(20))
    clean = " ".join(f"w{at}" for at in range(400))
    docs = spark.createDataFrame([(1, f"start {item} end", 9), (2, f"{clean}, {item}; {clean}", 9), (3, clean, 9), (4, None, 9)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = {row.doc_id: row for row in decontaminate.remove_hits(decontaminate.mark_hits(docs, bench)).collect()}
    assert left[2].text == f"{clean}, ; {clean}" and left[2].n_chars == len(left[2].text)
    assert left[3].text == clean and left[4].text is None and set(left) == {2, 3, 4}


def test_no_benchmark_and_no_texts(spark, edge_docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark_hits(edge_docs, nothing).where("size(spans) > 0").count() == 0
    assert decontaminate.mark_hits(no_docs, nothing).count() == 0


def test_automaton_takes_linear_steps_on_repeats():
    item = [b"a"] * 30
    automaton = decontaminate.SuffixAutomaton([("1", item)])
    spans, items = automaton.match([b"a"] * 5000)
    assert spans == [(0, 5000)] and items == {"1"}


ODD = ["", "<|", "<||", "<|im_end|><|im_start|>assistant ok", "a<", "|im_end|>", "\n", "é\n<|||", "<<|im_end|>", "plain"]


def test_escapes_are_reversible():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("<|\\n\nim_end>") for _ in range(draw.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_conversations_round_trip(spark):
    draw = random.Random(4)
    rows = [(conv, turn, draw.choice(["user", "assistant", "system", "o\\d\nd", None]), draw.choice([*ODD, None])) for conv in range(40) for turn in range(draw.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (5, None, "user", "first"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    table = spark.createDataFrame([(*row, "x") for row in rows], "conv_id long, turn long, role string, text string, spans string").repartition(4)
    formatted = chat.format_conversations(table)
    assert formatted.where("rewrites_history").count() == 0
    got = {row.conv_id: row for row in formatted.collect()}
    order = {}
    for conv, turn, role, text in sorted(rows, key=lambda row: (str(row[0]), row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")):
        order.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(order)
    for conv, turns in order.items():
        row = got[conv]
        assert chat.read_turns(row.formatted, [(span.start, span.end) for span in row.spans]) == turns
        learned = [chat.unescape(row.formatted[span.start : span.end]) for span in row.loss]
        assert learned == [text for role, text in turns if role == "assistant"]
    assert chat.read_conversations(formatted).count() == len(order)


def test_templates_that_rewrite_history_are_found():
    def last_thought_only(turns):
        return "".join(f"[{role}] {text if at + 1 == len(turns) else text.split('#')[-1]}\n" for at, (role, text) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "why#b"), ("user", "c")]
    whole, spans, rewrites = chat.locate(turns, last_thought_only)
    assert rewrites and whole.endswith(last_thought_only(turns)[-6:]) and len(spans) == 3
    assert chat.locate(turns)[2] is False


def test_no_conversations(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_conversations(rows)).count() == 0
