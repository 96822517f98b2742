"""Operator 12: phrases whose words occur together more often than apart, by Rabin-Karp fingerprints.

1. A task turns the bytes of its texts into words and pieces with numpy. One prefix polynomial over the bytes gives every
   word's fingerprint, one over the words' fingerprints that of every n-gram, by a subtraction and a product each.
2. Level by level (words, pairs, triples ...) a task sorts the fingerprints of some million n-grams and keeps of each its
   count, the smallest pointer to an occurrence (digest of the text, byte in it) and a check value from a second
   polynomial. These rows, packed by ranges of fingerprints, are all that is shuffled: a phrase that every row holds is one
   row for each run of a task. An n-gram is counted only if both n-grams inside it are frequent, by a Bloom filter of the
   level before; what passes it by mistake is counted and turns out rare.
3. Fingerprints whose check values differ stand for several phrases. Those are counted again by their text; all others are
   read at their pointer, and only there: no rare n-gram ever becomes a text. Texts that meet a pointer are found by a
   Bloom filter of the pointers, then by a join.
4. Cuts, scores and the phrases inside longer ones are joins of the frequent phrases. Scores are whole numbers of decimals
   with 38 digits.

Edge cases: a missing or empty text has no words, a missing lang counts as ``und``. Repeated rows count every time. Words
keep all bytes but blanks and tabs, so any other sign belongs to them; a run of blanks separates like one. Counts are exact
up to 10**14 of a language. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm import bloom
from fleetscope.llm.common import bounded_batches, materialize, mix, worker_cache

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that powers have inverses modulo 2**64
BLANK, APART = 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = APART
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
RUN_BYTES, RUN_GRAMS = 500_000, 1_000_000
WITHIN = np.uint64(0xFFFFFF)  # a pointer has 40 bits of the text's digest and 24 of the byte; later bytes share the last


class Powers:
    """Powers of a base and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def __call__(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                factors = np.full(count, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up[:count], self.down[:count]


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial of ``values[start:end]`` for every pair, from one prefix polynomial."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def cuts(kinds: np.ndarray, offsets: np.ndarray, size: int):
    """Ranges of about ``size`` bytes that part no piece."""
    start = 0
    while start < len(kinds):
        end = min(start + size, len(kinds))
        if end < len(kinds):
            next_text = int(offsets[np.searchsorted(offsets, end)])
            marks = np.flatnonzero(kinds[end:next_text] == APART)
            end = end + int(marks[0]) if len(marks) else next_text
        yield start, end
        start = end


class Words:
    """The words of a range of a batch: places, texts, pieces and fingerprints (main and check)."""

    def __init__(self, data, kinds, offsets, start, end, powers):
        self.data, kind = data[start:end], kinds[start:end]
        first_byte = np.zeros(end - start + 1, bool)
        here = offsets[(offsets >= start) & (offsets < end)] - start
        first_byte[here] = first_byte[-1] = True
        inside = np.append(kind == 0, False)
        before = np.append(False, inside[:-1])
        self.starts = np.flatnonzero(inside & (first_byte | ~before))
        self.ends = np.flatnonzero(before & (first_byte | ~inside))
        self.text = np.searchsorted(offsets, self.starts + start, "right") - 1
        self.piece = np.cumsum(kind == APART, dtype=np.int64)[self.starts] + self.text
        self.byte = self.starts + start - offsets[self.text]
        values = self.data.astype(np.uint64) + np.uint64(1)
        self.hashes = [mix(fingerprints(values, self.starts, self.ends, power)) for power in powers]

    def grams(self, size: int, salts: np.ndarray, powers, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, fingerprints and check values of all runs of ``size`` words inside a piece."""
        count = max(len(self.starts) - size + 1, 0)
        first = np.flatnonzero(self.piece[:count] == self.piece[len(self.piece) - count :])
        keys, check = (
            mix(fingerprints(hashed, first, first + size, power) + salts[self.text[first]]) for hashed, power in zip(self.hashes, powers, strict=True)
        )
        cut = np.uint64(64 - bits)
        return first, (keys >> cut) << cut, check.astype(np.uint32) | np.uint32(1)

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.data[start:end].tobytes() for start, end in zip(self.starts[at : at + size], self.ends[at : at + size], strict=True)).decode()


def runs_of_words(batch: pa.RecordBatch, powers):
    """(words, lang of each text, salt and digest of each text) for every range of a batch with ``lang`` and ``text``."""
    texts = batch.column("text").cast(pa.large_string()).fill_null("")
    _, ends, raw = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    langs = batch.column("lang").to_pylist()
    salt_of = {lang: xxhash.xxh3_64_intdigest(lang) for lang in set(langs)}
    salts = np.fromiter(map(salt_of.__getitem__, langs), np.uint64, len(langs))
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(langs))
    kinds, data = KINDS[data], LOWER[data]
    for start, end in cuts(kinds, offsets, RUN_BYTES):
        words = Words(data, kinds, offsets, start, end, powers)
        if len(words.starts):
            yield words, langs, salts, digests


def pointers(words: Words, first: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return (digests[words.text[first]] & ~WITHIN) | np.minimum(words.byte[first].astype(np.uint64), WITHIN)


def table_powers():
    return worker_cache("collocation powers", lambda: [Powers(base) for base in BASES])


def folded(keys, counts, checks, high, places):
    """Rows of equal key as one: key, count, smallest and largest check value, smallest pointer."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (
        keys[begins], np.add.reduceat(counts[order], begins), np.minimum.reduceat(checks[order], begins), np.maximum.reduceat(high[order], begins),
        np.minimum.reduceat(places[order], begins),
    )


FIELDS = (("key", "<u8"), ("n", "<u4"), ("check", "<u4"), ("at", "<u8"))


def count_level(docs: DataFrame, size: int, known: np.ndarray | None, buckets: int, least: int, bits: int) -> DataFrame:
    """Frequent fingerprints of ``size`` words: lang, key, n, check (0: several phrases) and at; and a row without key for
    each lang and bucket with all that was counted there. ``known`` filters the n-grams of one word less."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def grams(batches):
        powers, held, rows, passed = table_powers(), {}, 0, shared.value
        for batch in batches:
            for words, langs, salts, digests in runs_of_words(batch, powers):
                first, keys, checks = words.grams(size, salts, powers, bits)
                if passed is not None:
                    inner, inner_keys, _ = words.grams(size - 1, salts, powers, bits)
                    may = np.zeros(len(words.starts) + 1, bool)
                    may[inner] = bloom.passes(passed, inner_keys)
                    kept = may[first] & may[first + 1]
                    first, keys, checks = first[kept], keys[kept], checks[kept]
                places = pointers(words, first, digests)
                numbers = {lang: at for at, lang in enumerate(dict.fromkeys(langs))}
                of_text = np.fromiter(map(numbers.__getitem__, langs), np.int64, len(langs))
                lang_of = of_text[words.text[first]]
                for lang, at in numbers.items():
                    mine = lang_of == at
                    if mine.any():
                        held.setdefault(lang, []).append((keys[mine], checks[mine], places[mine]))
                rows += len(first)
                if rows >= RUN_GRAMS:
                    yield packed(held)
                    held, rows = {}, 0
        if held:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        packer, made = zstandard.ZstdCompressor(level=1), []
        for lang, parts in held.items():
            keys, checks, places = (np.concatenate(part) for part in zip(*parts, strict=True))
            keys, counts, low, high, places = folded(keys, np.ones(len(keys), np.uint32), checks, checks, places)
            low[low != high] = 0
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                steps = np.diff(keys[start:end], prepend=np.uint64(0))
                columns = (steps, counts[start:end].astype(np.uint32), low[start:end], places[start:end])
                made.append((lang, int(bucket[start]), end - start, packer.compress(b"".join(column.tobytes() for column in columns))))
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([row[0] for row in made], pa.string()),
                "bucket": pa.array([row[1] for row in made], pa.int32()),
                "entries": pa.array([row[2] for row in made], pa.int32()),
                "data": pa.array([row[3] for row in made], pa.binary()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        parts = []
        for count, data in zip(table.column("entries").to_pylist(), table.column("data").to_pylist(), strict=True):
            raw, columns, at = zstandard.ZstdDecompressor().decompress(data), [], 0
            for _, kind in FIELDS:
                columns.append(np.frombuffer(raw, kind, count, at))
                at += columns[-1].nbytes
            columns[0] = np.cumsum(columns[0], dtype=np.uint64)
            parts.append(columns)
        keys, counts, checks, places = (np.concatenate(part) for part in zip(*parts, strict=True))
        keys, counts, low, high, places = folded(keys, counts.astype(np.int64), checks, checks, places)
        often = counts >= least
        rows = int(often.sum())
        return pa.Table.from_pydict(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * (rows + 1), pa.string()),
                "key": pa.array([*keys[often].view(np.int64).tolist(), None], pa.int64()),
                "n": pa.array(np.append(counts[often], counts.sum())),
                "check": pa.array(np.append(np.where(low == high, low, 0)[often], 0).astype(np.int64)),
                "at": pa.array(np.append(places[often].view(np.int64), 0)),
            }
        )

    entries = docs.mapInArrow(grams, "lang string, bucket int, entries int, data binary")
    return entries.groupBy("lang", "bucket").applyInArrow(total, "lang string, key long, n long, check long, at long")


def column_keys(name: str):
    """The 64-bit numbers of a column of a batch, for a Bloom filter."""
    return lambda batch: batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def pointer_keys(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix(keys + places * np.uint64(BASES[0]))


def phrases_at(docs: DataFrame, frequent: DataFrame, sizes: int, bits: int, most_bits: int) -> DataFrame:
    """lang, size, key and phrase of the frequent fingerprints, read at their pointers."""
    wanted = bloom.build(
        frequent.select("key", "at"), lambda batch: pointer_keys(column_keys("key")(batch), column_keys("at")(batch)), most_bits
    )
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def read(batches):
        powers, names = table_powers(), ["lang", "size", "key", "check", "phrase"]
        for batch in batches:
            found = {}
            for words, langs, salts, digests in runs_of_words(batch, powers):
                for size in range(1, sizes + 1):
                    first, keys, checks = words.grams(size, salts, powers, bits)
                    met = np.flatnonzero(bloom.passes(shared.value, pointer_keys(keys, pointers(words, first, digests))))
                    for at in met.tolist():
                        one = (langs[words.text[first[at]]], size, int(keys[at : at + 1].view(np.int64)[0]), int(checks[at]))
                        if one not in found:
                            found[one] = words.phrase(int(first[at]), size)
            columns = [*map(list, zip(*found, strict=True))] if found else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], pa.array(list(found.values()), pa.string())], names)

    met = docs.mapInArrow(read, "lang string, size int, key long, check long, phrase string").dropDuplicates(["lang", "size", "key", "check"])
    return frequent.join(met, ["lang", "size", "key", "check"]).select("lang", "size", "phrase", "n")


def recounted(docs: DataFrame, mixed: DataFrame, sizes: int, least: int, bits: int, most_bits: int) -> DataFrame:
    """Phrases whose fingerprint stands for several, counted by their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(mixed.select("key"), column_keys("key"), most_bits))

    def read(batches):
        powers, names = table_powers(), ["lang", "size", "key", "phrase", "n"]
        for batch in batches:
            counts: dict = {}
            for words, langs, salts, _ in runs_of_words(batch, powers):
                for size in range(1, sizes + 1):
                    first, keys, _ = words.grams(size, salts, powers, bits)
                    for at in np.flatnonzero(bloom.passes(shared.value, keys)).tolist():
                        word = int(first[at])
                        one = (langs[words.text[word]], size, int(keys[at : at + 1].view(np.int64)[0]), words.phrase(word, size))
                        counts[one] = counts.get(one, 0) + 1
            columns = [*map(list, zip(*counts, strict=True))] if counts else [[]] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*[pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], pa.array(list(counts.values()), pa.int64())], names)

    read_again = docs.mapInArrow(read, "lang string, size int, key long, phrase string, n long").join(mixed.select("lang", "size", "key"), ["lang", "size", "key"], "left_semi")
    return read_again.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 64, most_bits: int = 30, bucket_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, size, phrase and n of everything up to ``longest`` words that occurs ``least`` times, and
    lang and n of all words. ``bits`` of a fingerprint are used; fewer make collisions, not other results."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(volume / bucket_bytes))
    levels, known, totals = [], None, None
    for size in range(1, longest + 1):
        level = materialize(count_level(texts, size, known, buckets, least, bits).withColumn("size", F.lit(size)), f"grams{size}")
        if totals is None:
            totals = level.where("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        level = level.where("key IS NOT NULL")
        levels.append(level)
        if size < longest:
            known = bloom.build(level.select("key"), column_keys("key"), most_bits)
    frequent = reduce(DataFrame.unionByName, levels)
    found = phrases_at(texts, frequent.where("check <> 0"), longest, bits, most_bits)
    mixed = frequent.where("check = 0")
    if not mixed.isEmpty():
        found = found.unionByName(recounted(texts, mixed, longest, least, bits, most_bits))
    return materialize(found, "phrases"), totals


def scored(phrases: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, size, a, l, r and score by the lowest-scoring cut of every phrase of two words or more."""
    words = F.split("phrase", " ")
    whole = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = whole.select("*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, longest), " ").alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        halves = halves.join(phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])

    def exact(name: str):
        return F.col(name).cast("decimal(14,0)")

    top = F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))
    halves = halves.select("*", top.alias("top"), (exact("l") * exact("r")).alias("bottom")).withColumn("score", F.expr("top div bottom"))
    best = halves.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def mostly_inside(phrases: DataFrame, share: int = 50) -> DataFrame:
    """lang and phrase of those that a longer phrase holds in at least ``share`` percent of their occurrences."""
    words = F.split("phrase", " ")
    longer = phrases.where("size > 2").select("lang", F.col("n").alias("longer"), "size", words.alias("words"))
    sized = longer.select("lang", "longer", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    starts = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("start"))
    inner = starts.select("lang", "longer", F.array_join(F.slice("words", F.col("start"), F.col("inner")), " ").alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, first: int = 2000, **options) -> DataFrame:
    """The ``first`` phrases of every language: lang, rank, phrase, a, l, r, n and score."""
    phrases, totals = frequent_phrases(docs, longest, least, **options)
    kept = scored(phrases, longest).join(mostly_inside(phrases), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # First in parts of a language, then among the firsts of its parts: no task sees all phrases of a language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    heads = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = heads.where(F.col("rank") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
