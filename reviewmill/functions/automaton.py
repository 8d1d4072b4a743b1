"""Keywords of several lists found in one pass over the text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Lists = tuple[tuple[str, ...], ...]


@lru_cache(maxsize=8)
def build(lists: Lists) -> ahocorasick.Automaton:
    """Every word carries the numbers of the lists it is in."""
    owners: dict[str, list[int]] = {}
    for number, words in enumerate(lists):
        for word in words:
            owners.setdefault(word, []).append(number)
    automaton = ahocorasick.Automaton()
    for word, numbers in owners.items():
        automaton.add_word(word, (word, tuple(dict.fromkeys(numbers))))
    automaton.make_automaton()
    return automaton


def leftmost_longest(hits: Iterable[tuple[int, int, str]]) -> list[str]:
    """Distinct words in the order of their first hit. A hit is (start, -length, word); hits do not overlap."""
    found: dict[str, None] = {}
    free = 0
    for start, negative, word in sorted(hits):
        if start >= free:
            found[word] = None
            free = start - negative
    return list(found)


def hits_per_list(text: str | None, lists: Lists) -> list[list[str]]:
    found: list[list[tuple[int, int, str]]] = [[] for _ in lists]
    for end, (word, numbers) in build(lists).iter(text or ""):
        for number in numbers:
            found[number].append((end - len(word) + 1, -len(word), word))
    return [leftmost_longest(hits) for hits in found]


def find_keywords(text: Column, lists: dict[str, list[str]]) -> Column:
    """Struct with one array per list: distinct lower-cased hits in first-hit order, the longest word at each place.

    Each list is matched as if it stood alone; NULL text and empty lists have no hits.
    """
    names = list(lists)
    words: Lists = tuple(tuple(lists[name]) for name in names)
    schema = ", ".join(f"`{name}` array<string>" for name in names)

    @F.arrow_udf(schema)
    def scan(column: pa.Array) -> pa.Array:
        rows = [hits_per_list(value, words) for value in column.to_pylist()]
        arrays = [pa.array([row[i] for row in rows], pa.list_(pa.string())) for i in range(len(names))]
        return pa.StructArray.from_arrays(arrays, names)

    return scan(F.lower(text))
