"""Operator 9: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, pairs of digits, dots between digits, plus signs before
digits, schemes and cue words. From an anchor a small parser finds both ends of the candidate and checks it.

Base kinds (leftmost, not overlapping within a kind; a match that fails its check is dropped and not tried again):
email, ip, card, phone. Added kinds: ``login`` (address with a user part before the host), ``iban`` (after its cue,
checked modulo 97), ``account`` (number after a cue word) and ``secret`` (value given to a key or password cue).

Edge cases: a missing text counts as the empty one and has no span. Texts of any length are read whole; the work is
linear in the text, as an anchor inside an earlier candidate of its kind is skipped. Spans are code points.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER = re.compile(r"://[^\s/?#@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: (?:number|no|nr)\.?)?[ :#]{1,3}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
SECRET = re.compile(r"[ ]?[=:][ ]?[\"']?([A-Za-z0-9_./+-]{8,})")

# Cue words, in the letter cases that are looked for.
CUES = {
    "iban": ("iban", "Iban", "IBAN"),
    "account": ("account", "Account", "acct", "Acct", "Konto", "konto", "cuenta", "Cuenta", "compte", "Compte"),
    "secret": ("api_key", "apikey", "API_KEY", "api-key", "secret", "SECRET", "password", "Password", "PASSWORD", "token", "TOKEN"),
}


def anchors() -> ahocorasick.Automaton:
    """Anchor -> kinds it may begin, and how far its first character lies before its end."""
    found: dict[str, list[str]] = {"@": ["email"], "://": ["login"]}
    for one in DIGITS:
        found.setdefault(f"+{one}", []).append("phone")
        for other in DIGITS:
            found.setdefault(f"{one}.{other}", []).append("ip")
            for between in ("", " ", "-"):
                found.setdefault(f"{one}{between}{other}", []).append("card")
    for kind, words in CUES.items():
        for word in words:
            found.setdefault(word, []).append(kind)
    automaton = ahocorasick.Automaton()
    for anchor, kinds in found.items():
        automaton.add_word(anchor, (kinds[0], len(anchor)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for digit in digits[-2::-2]:
        total += sum(divmod(2 * int(digit), 10))
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    compact = value.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(letter, 36)) for letter in compact[4:] + compact[:4])) % 97 == 1


def digits_of(value: str) -> str:
    return "".join(letter for letter in value if letter in DIGITS)


def find_spans(text: str | None, automaton) -> list[tuple[int, int, int]]:
    """Spans as (start, number of the kind, end), in that order."""
    spans: list[tuple[int, int, int]] = []
    if not text:
        return spans
    done = dict.fromkeys(KINDS, 0)  # no candidate of the kind begins before this
    for last, (kind, width) in automaton.iter(text):
        at = last + 1 - width
        if kind in CUES:
            match = {"iban": IBAN, "account": ACCOUNT, "secret": SECRET}[kind].match(text, last + 1)
            if match and match.start(1) >= done[kind] and (kind != "iban" or iban_valid(match[1])):
                spans.append((match.start(1), KINDS.index(kind), match.end(1)))
                done[kind] = match.end(1)
            continue
        if at < done[kind]:
            continue
        if kind == "email":
            match = DOMAIN.match(text, at)
            if match:
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    spans.append((start, 0, match.end()))
                    done["email"] = match.end()
        elif kind == "login":
            match = USER.match(text, at)
            if match:
                start = at
                while start > done["login"] and text[start - 1].isalnum():
                    start -= 1
                spans.append((start, KINDS.index("login"), match.end()))
                done["login"] = match.end()
        elif kind == "ip":
            start = at
            while start > done["ip"] and text[start - 1] in DIGITS:
                start -= 1
            match = QUAD.match(text, start)
            if match:
                if all(len(bare := part.lstrip("0")) <= 3 and int(bare or 0) <= 255 for part in match[0].split(".")):
                    spans.append((start, 1, match.end()))
                done["ip"] = match.end()
            else:
                done["ip"] = last  # its last digit may begin the next candidate
        elif kind == "card":
            match = NUMBER.match(text, at)
            digits = digits_of(match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((at, 2, match.end()))
            done["card"] = match.end()
        else:
            match = DIAL.match(text, at)
            if match:
                if 9 <= len(digits_of(match[0])) <= 15:
                    spans.append((at, 3, match.end()))
                done["phone"] = match.end()
    spans.sort()
    return spans


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind; overlapping spans become one, named after the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SPANS = "array<struct<start: long, kind: string, end: long>>"


def personal_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its ``spans`` in order of start and kind, a row for each row of ``docs``."""

    def work(batches):
        automaton = anchors()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            rows = [
                [{"start": start, "kind": KINDS[number], "end": end} for start, number, end in find_spans(text, automaton)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where there is one, counted again."""
    place = docs.columns.index("text")

    def work(batches):
        automaton = anchors()
        for batch in batches:
            texts = [None if text is None else redact_text(text, find_spans(text, automaton)) for text in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.names[place], pa.array(texts, batch.column(place).type))

    changed = docs.mapInArrow(work, docs.schema)
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
