"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The normalised words of all items, each followed by a separator of its own, form one suffix automaton. The words of a
text stream through it; after each word the automaton knows the longest run of words that ends there and stands in an
item. A run of ``window`` words, or a whole shorter item, is a hit: its words are contaminated. Texts are compared with
all items at once, in time linear in the text.

The benchmark is a stated query set: its words are counted first, and items are dealt into blocks of about
``block_words`` words. Each block has its own automaton of bounded size, broadcast, and texts pass all blocks in turn.

Between two blocks the texts found so far are written to the shared folder and the automaton is given up, so one automaton at
a time is held by the driver and the executors.

Edge cases: missing texts have no words. Items without id or without words are no items; rows that repeat an item id
count as one item with several texts. Without items nothing is hit. Repeated documents get equal rows; a benchmark
of any size works, with one more pass over the texts for each block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.common import materialize

WINDOW = 13
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


class SuffixAutomaton:
    """All runs of words of the items; ``vocabulary`` numbers the words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        items = sorted((item, words) for item, words in items if words)
        self.window, self.vocabulary = window, {}
        self.nexts, self.links, self.lengths = [{}], [-1], [0]
        last = 0
        for at, (_, words) in enumerate(items):
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
            last = self._extend(last, -1 - at)
        self.least = min([window, *(len(words) for _, words in items)])
        self._name_windows(items)

    def _extend(self, last: int, word: int) -> int:
        state = len(self.nexts)
        self.nexts.append({})
        self.links.append(0)
        self.lengths.append(self.lengths[last] + 1)
        at = last
        while at >= 0 and word not in self.nexts[at]:
            self.nexts[at][word] = state
            at = self.links[at]
        if at >= 0:
            target = self.nexts[at][word]
            if self.lengths[target] == self.lengths[at] + 1:
                self.links[state] = target
            else:
                twin = len(self.nexts)
                self.nexts.append(dict(self.nexts[target]))
                self.links.append(self.links[target])
                self.lengths.append(self.lengths[at] + 1)
                while at >= 0 and self.nexts[at].get(word) == target:
                    self.nexts[at][word] = twin
                    at = self.links[at]
                self.links[target] = self.links[state] = twin
        return state

    def _name_windows(self, items) -> None:
        """By state: the state of its last ``window`` words; the items of that window; whole short items it ends with."""
        order = sorted(range(1, len(self.nexts)), key=self.lengths.__getitem__)
        self.window_state = [-1] * len(self.nexts)
        for state in order:
            link = self.links[state]
            if self.lengths[state] >= self.window:
                self.window_state[state] = state if self.lengths[link] < self.window else self.window_state[link]
        self.window_items: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str]]] = {}
        for item, words in items:
            state = 0
            for count, word in enumerate(words, 1):
                state, length = self._step(state, count - 1, self.vocabulary[word])
                if length >= self.window:
                    self.window_items.setdefault(self.window_state[state], set()).add(item)
            if len(words) < self.window:
                whole.setdefault(state, set()).add((len(words), item))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.nexts)
        for state in order:
            ends = self.short[self.links[state]]
            self.short[state] = tuple(sorted({*ends, *whole[state]})) if state in whole else ends

    def _step(self, state: int, length: int, word: int) -> tuple[int, int]:
        nexts, links = self.nexts, self.links
        while state and word not in nexts[state]:
            state = links[state]
            length = self.lengths[state]
        to = nexts[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word numbers, joined where they touch, and the items of their windows."""
        spans: list[list[int]] = []
        items: set[str] = set()
        windows: set[int] = set()
        nexts, links, lengths, window, least = self.nexts, self.links, self.lengths, self.window, self.least
        root = nexts[0]
        state = length = 0
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = length = 0
                continue
            if not state:
                state = root[word]
                length = 1
            else:
                while word not in nexts[state]:
                    state = links[state]
                    length = lengths[state]
                state = nexts[state][word]
                length += 1
            if length < least:
                continue
            reach = 0
            if length >= window:
                reach = window
                windows.add(self.window_state[state])
            for size, item in self.short[state]:
                if size <= length:
                    reach = max(reach, size)
                    items.add(item)
            if reach:
                start, end = at + 1 - reach, at + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end])
        for state in windows:
            items |= self.window_items[state]
        return [(start, end) for start, end in spans], items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    made: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if made and made[-1][1] >= start:
            made[-1] = (made[-1][0], max(end, made[-1][1]))
        else:
            made.append((start, end))
    return made


def item_blocks(benchmark: DataFrame, window: int, block_words: int):
    """An automaton for each block of items. Words are counted before anything is read to the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total")).first().total
    count = max(1, math.ceil(total / (4 * block_words)))  # a word and its gap have four characters or more, short ones apart
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block).collect()
        yield SuffixAutomaton([(row.item, normal_words(row.text)) for row in rows], window)


def mark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """``docs`` (without columns of these names) and n_words, hit ``spans`` of words, and ``items`` sorted as strings."""
    docs = docs.drop("n_words", "spans", "items")
    place, names = docs.columns.index("text"), docs.columns
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(FOUND).fields])
    marked = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast(schema["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"))
    shared = None
    for automaton in item_blocks(benchmark, window, block_words):
        if shared:
            marked = materialize(marked, "hits")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        marked = marked.mapInArrow(_matcher(shared, place, names), schema)
    return marked


def _matcher(shared, place: int, names: list[str]):
    def work(batches):
        automaton = shared.value
        for batch in batches:
            counts, hits, found = [], [], []
            texts, spans, items = (batch.column(at).to_pylist() for at in (place, len(names) + 1, len(names) + 2))
            for text, before, known in zip(texts, spans, items, strict=True):
                words = normal_words(text)
                here, fresh = automaton.match(words)
                if before:
                    here = joined([*here, *((span["start"], span["end"]) for span in before)])
                counts.append(len(words))
                hits.append([{"start": start, "end": end} for start, end in here])
                found.append(sorted(fresh.union(known)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(hits, SPAN), pa.array(found, pa.list_(pa.string()))],
                [*names, "n_words", "spans", "items"],
            )

    return work


def hit_words():
    """Words inside hit spans, as a column over ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


def is_contaminated(share: int = 20):
    return (hit_words() > 0) & (share * hit_words() >= F.col("n_words"))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    places = [found.span() for found in WORD_BYTES.finditer(data)]
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*parts, data[at:]]).decode()


def remove_hits(marked: DataFrame, share: int = 20) -> DataFrame:
    """Drop contaminated rows, cut the hit spans out of the others, and drop the columns of ``mark_hits``."""
    rest = marked.where(~is_contaminated(share)).drop("n_words", "items")
    names = [name for name in rest.columns if name != "spans"]
    place, hits = rest.columns.index("text"), rest.columns.index("spans")

    def work(batches):
        for batch in batches:
            texts = [
                cut_text(text, [(span["start"], span["end"]) for span in spans]) if spans else text
                for text, spans in zip(batch.column(place).to_pylist(), batch.column(hits).to_pylist(), strict=True)
            ]
            changed = batch.set_column(place, batch.schema.names[place], pa.array(texts, batch.column(place).type))
            yield changed.select(names)

    kept = rest.drop("spans")
    changed = rest.mapInArrow(work, kept.schema)
    if "n_chars" not in names:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``mark_hits`` and ``remove_hits`` in one; columns of ``docs`` that bear the names they work with stay as they are."""
    used = StructType.fromDDL(FOUND).fieldNames()
    own = {name: f"_own_{name}" for name in docs.columns if name.lower() in used}
    kept = remove_hits(mark_hits(docs.withColumnsRenamed(own), benchmark, window), share)
    return kept.withColumnsRenamed({set_aside: name for name, set_aside in own.items()})
