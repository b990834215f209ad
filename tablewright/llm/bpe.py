"""Byte-level BPE inside a task: ranks from a file, the pattern's pre-tokens, remembered units."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
import tiktoken

PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
#: Bound on the units an encoder remembers, and on their length.
UNITS, UNIT_CHARS = 100_000, 60
#: Longer units are split by pattern here, one pre-token at a time.
LONG_UNIT = 5_000

#: A space between two characters that are no white space always begins a pre-token.
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")


def units(text: str) -> list[str]:
    """Cut a text where a pre-token surely begins; the space at each cut is left out."""
    if text[:1] == " " or text[-1:] == " " or _TWO_SPACES.search(text):
        return _SAFE_CUT.split(text)
    return text.split(" ")


class _Remembered(dict):
    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        found = self.encode(unit)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = found
        return found


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The raw bytes of each id."""
    found = ranks(path)
    out = [b""] * (max(found.values()) + 1)
    for piece, i in found.items():
        out[i] = piece
    return out


class Encoder:
    """Ids as little-endian 32-bit unsigned integers in bytes."""

    def __init__(self, path: str):
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
        self._first = _Remembered(self._unit)
        self._rest = _Remembered(lambda unit: self._unit(" " + unit))

    def _unit(self, text: str) -> bytes:
        if len(text) <= LONG_UNIT:
            ids = self._encoding.encode_ordinary(text)
        else:
            ids = [i for m in PRE_TOKEN.finditer(text) for i in self._encoding._encode_single_piece(m.group())]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = units(text)
        return self._first[first] + b"".join(map(self._rest.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def boundaries(text: str, whole: bool) -> list[int]:
    """Where pre-tokens begin or end, as far as the text decides them.

    Of a text that goes on (not ``whole``) the last two characters are left out: a match that ends before them has
    seen all it looks at, which is one character after a run and two after an apostrophe.
    """
    ends = [0, *(m.end() for m in PRE_TOKEN.finditer(text))]
    return ends if whole else [e for e in ends if e <= len(text) - 2]
