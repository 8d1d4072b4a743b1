"""Counts of a text that the quality operators share. Words are split at ASCII white space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant spreads the bits of a sum


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` neighbouring words."""
    count = len(hashes) - size + 1
    out = hashes[:count].copy()
    for step in range(1, size):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += hashes[step : step + count]
    return out


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    upper: int
    top_word: int
    letters: int
    hashes: np.ndarray


def measure(text: bytes | None) -> Measures:
    """All counts of one text; NULL counts as empty."""
    text = text or b""
    words = text.split()
    hashes = word_hashes(words)
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(codes[0x80:0xC0].sum())
    repeated = 0
    if len(words) >= 3:
        _, place, counts = np.unique(shingle_hashes(hashes, 3), return_inverse=True, return_counts=True)
        twice = counts[place] > 1
        inside = np.zeros(len(words), bool)
        for step in range(3):
            inside[step : step + len(twice)] |= twice
        repeated = int(inside.sum())
    top = int(np.unique(hashes, return_counts=True)[1].max()) if words else 0
    upper = int(codes[65:91].sum())
    return Measures(
        len(words), points - int(codes[_SPACES].sum()), int(codes[_SYMBOLS].sum()), again, repeated,
        upper, top, upper + int(codes[97:123].sum()), hashes,
    )
