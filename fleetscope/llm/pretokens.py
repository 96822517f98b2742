"""Texts cut into segments that can be tokenized alone, and rank files, for the token operators."""

from __future__ import annotations

import base64
import re

import regex

# Fixed value: the pre-token pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A blank after a character that no engine takes for white space always begins a new pre-token, whatever follows.
BLANK_AFTER_SPACE = re.compile(r"\s ")
ASCII_PAIRS = [letter + " " for letter in map(chr, range(128)) if letter.isspace()]
SEGMENT = regex.compile(r"\s*\S+|\s+")


def split_text(text: str) -> tuple[list[str], list[str]]:
    """Segments, and further segments without the single blank that they begin with.

    Their concatenation, blanks put back, is the text; none shares a pre-token with its neighbour.
    """
    if not text:
        return [], []
    if text[0] == " " or (any(pair in text for pair in ASCII_PAIRS) if text.isascii() else BLANK_AFTER_SPACE.search(text)):
        return SEGMENT.findall(text), []
    pieces = text.split(" ")
    return pieces[:1], pieces[1:]


def segments(text: str) -> list[str]:
    first, rest = split_text(text)
    return [*first, *[" " + piece for piece in rest]]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
