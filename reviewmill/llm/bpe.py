"""BPE encoding and decoding with a given tokenizer file; long texts are encoded in parallel pieces.

A text above ``long_chars`` is cut into pieces that become rows of their own. A cut at white space is
free, because no token crosses it. A run without white space is normalised and pre-split, and a single
word of more than ``leaf_chars`` is halved again and again; the halves are encoded independently and
joined up the tree. At a join a window of tokens around it is encoded again, and grows until both
of its sides agree: a token sequence is what the whole word encodes to exactly when every pair of
neighbours, encoded together, stays that pair.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import put_columns, with_schema

LONG_CHARS = 32_768
LEAF_CHARS = 8_192
KNOWN_WORDS = 200_000  # distinct words a task remembers
WORD_END = "</w>"
#: kinds of piece: text ends at white space; words are pre-split; an open part is followed by more of its word
TEXT, WORDS, OPEN, CLOSED, SPECIAL = range(5)
_ROW, _SEQ, _KIND, _PIECE = "__bpe_row", "__bpe_seq", "__bpe_kind", "__bpe_piece"
#: Latin letters beyond ASCII that are one code point in NFC and lower-case to one of the same range
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
#: the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for U+0100 onwards
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """The library's tokenizer, and the same merges without word ends for parts of a word."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        inner = json.loads(definition)
        inner["model"]["end_of_word_suffix"] = None
        self.ends = json.loads(definition)["model"].get("end_of_word_suffix") or ""
        self.open = Tokenizer.from_str(json.dumps(inner))
        specials = {t["content"]: t["id"] for t in inner["added_tokens"]}
        self.special_ids = specials
        longest = sorted(specials, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest))) if longest else None

        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}
        self.pattern = self._word_pattern(inner)
        self.joins = inner.get("decoder") is None  # then decoding puts a space between tokens
        self.names = {i: name for name, i in self.whole.get_vocab(with_added_tokens=True).items()}

    @staticmethod
    def _word_pattern(definition: dict) -> re.Pattern | None:
        """The pre-split pattern for plain Latin words, if the definition has the shape read here:
        white space separates, then NFC, lower case, one split pattern, and the byte alphabet."""
        try:
            steps = definition["normalizer"]["normalizers"]
            split, level = definition["pre_tokenizer"]["pretokenizers"]
            fits = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"]["Regex"] == "\\s+"
            fits = fits and split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]
            pattern = split["pattern"]["Regex"]
        except (KeyError, TypeError, ValueError):
            return None
        letters = f"a-zA-Z{_LATIN}"
        return re.compile(pattern.replace("\\p{L}", letters).replace("\\p{N}", "0-9"), re.ASCII) if fits else None

    def encode(self, text: str) -> list[int]:
        return _unpack(self.encode_many([text])[0][0])

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(packed ids, decoded text) of every text. No token crosses white space, so every distinct word
        between white space is encoded once and kept."""
        if self.pattern is None:
            found = [self.whole.encode(t, add_special_tokens=False).ids for t in texts]
            return [(_pack(ids), self.whole.decode(ids, skip_special_tokens=False)) for ids in found]
        split = [t.encode("utf-8").split() for t in texts]
        if len(self.known) > KNOWN_WORDS:  # bounds memory; frequent words come back at once
            self.known.clear()
        known = self.known
        for words in split:
            for word in words:
                if word not in known:
                    known[word] = self._word(word.decode("utf-8"))
        out = []
        for words in split:
            pairs = [known[w] for w in words]
            packed = b"".join([p for p, _ in pairs])
            plain = " ".join([d for _, d in pairs if d]) if self.joins else self.decode(_unpack(packed))
            out.append((packed, plain))
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        if not _PLAIN.fullmatch(word) or (self.specials and self.specials.search(word)):
            ids = self.whole.encode(word, add_special_tokens=False).ids
            return _pack(ids), " ".join([self.names[i] for i in ids])
        pieces = self.pattern.findall(word.lower())
        if len(pieces) == 1:
            return self._piece(pieces[0])
        pairs = [self._piece(piece) for piece in pieces]
        return b"".join([p for p, _ in pairs]), " ".join([d for _, d in pairs])

    def _piece(self, piece: str) -> tuple[bytes, str]:
        found = self.parts.get(piece)
        if found is None:
            if len(self.parts) > KNOWN_WORDS:
                self.parts.clear()
            mapped = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(_BYTE_ALPHABET)
            tokens = self.whole.model.tokenize(mapped)
            found = self.parts[piece] = (_pack([t.id for t in tokens]), " ".join([t.value for t in tokens]))
        return found

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)

    def part(self, mapped: str, closed: bool) -> list[int]:
        """Ids of a part of one word, given in the byte alphabet; a closed part ends the word."""
        return [t.id for t in (self.whole if closed else self.open).model.tokenize(mapped)]

    def spelled(self, ids: list[int]) -> tuple[str, bool]:
        """The characters of neighbouring tokens of one word, and whether they end it."""
        joined = "".join(map(self.whole.id_to_token, ids))
        closed = bool(self.ends) and joined.endswith(self.ends)
        return (joined[: -len(self.ends)] if closed else joined), closed

    def agree(self, a: int, b: int) -> bool:
        return self.part(*self.spelled([a, b])) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two parts of one word."""
        width = 1
        while True:
            again = self.part(*self.spelled(left[-width:] + right[:width]))
            fits_left = width >= len(left) or self.agree(left[-width - 1], again[0])
            fits_right = width >= len(right) or self.agree(again[-1], right[width])
            if fits_left and fits_right:
                return left[:-width] + again + right[width:]
            width *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def pieces(self, text: str, leaf: int) -> Iterator[tuple[int, str]]:
        """(kind, content) in order; their ids, joined, are those of the text."""
        at = 0
        while at < len(text):
            stop = min(at + leaf, len(text))
            if stop < len(text):
                space = max(text.rfind(c, at + 1, stop + 1) for c in " \t\n\r\x0b\x0c")
                if space < 0:
                    found = _SPACE.search(text, stop)
                    stop = found.start() if found else len(text)
                    yield from self._unsplit(text[at:stop], leaf)
                    at = stop
                    continue
                stop = space
            yield TEXT, text[at:stop]
            at = stop

    def _unsplit(self, run: str, leaf: int) -> Iterator[tuple[int, str]]:
        at = 0
        for found in [*(self.specials.finditer(run) if self.specials else ()), None]:
            plain = run[at : found.start() if found else len(run)]
            if plain:
                shape = self.whole.normalizer.normalize_str(plain) if self.whole.normalizer else plain
                yield from self._words(self.whole.pre_tokenizer.pre_tokenize_str(shape), leaf)
            if found:
                yield SPECIAL, found.group()
                at = found.end()

    def _words(self, words: list, leaf: int) -> Iterator[tuple[int, str]]:
        short: list[str] = []
        size = 0
        for word, _ in words:
            if len(word) <= leaf:
                short.append(word)
                size += len(word)
            if short and (len(word) > leaf or size >= leaf):
                yield WORDS, "\n".join(short)
                short, size = [], 0
            if len(word) > leaf:
                yield from self._halves(word, leaf, True)
        if short:
            yield WORDS, "\n".join(short)

    def _halves(self, word: str, leaf: int, closed: bool) -> Iterator[tuple[int, str]]:
        if len(word) <= leaf:
            yield (CLOSED if closed else OPEN), word
        else:
            middle = len(word) // 2
            yield from self._halves(word[:middle], leaf, False)
            yield from self._halves(word[middle:], leaf, closed)

    def encode_piece(self, kind: int, piece: str) -> list[int]:
        if kind == TEXT:
            return self.encode(piece)
        if kind == SPECIAL:
            return [self.special_ids[piece]]
        if kind == WORDS:
            return [i for word in piece.split("\n") for i in self.part(word, True)]
        return self.part(piece, kind == CLOSED)

    def assemble(self, kinds: list[int], parts: list[list[int]]) -> list[int]:
        """Ids of a text from those of its pieces in order."""
        out: list[int] = []
        word: list[list[int]] = []
        for kind, ids in zip(kinds, parts):
            if kind in (OPEN, CLOSED):
                word.append(ids)
                if kind == CLOSED:
                    out += self.tree(word)
                    word = []
            else:
                out += ids
        return out


@lru_cache(maxsize=2)
def _codec(definition: str) -> Codec:
    return Codec(definition)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def encode(
    df: DataFrame,
    text: str = "text",
    file: str | None = None,
    long_chars: int = LONG_CHARS,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """All rows and columns of ``df`` with ``packed_ids`` (32-bit little-endian) and ``decoded``.

    NULL and empty texts have no ids and decode to the empty string. Repeated rows stay repeated. The
    two new columns replace input columns of the same name. An empty table gives an empty one.
    """
    context = df.sparkSession.sparkContext
    with open(file or default_file(), encoding="utf-8") as source:
        shared = context.broadcast(source.read())  # a vocabulary file, about 2 MB whatever the corpus
    df = df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = with_schema(df, packed_ids="binary", decoded="string")
    rows = 256  # an Arrow batch is worked off in slices, so that few ids are held at a time

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = codec.encode_many(batch.column(text).to_pylist())
                yield put_columns(
                    batch, {"packed_ids": pa.array([p for p, _ in found], pa.binary()), "decoded": pa.array([d for _, d in found], pa.string())}
                )

    is_long = F.length(text) > long_chars
    direct = df.filter(~is_long).mapInArrow(short, out)

    # Long texts: one row per piece, dealt out evenly, then one group per text. The text itself travels
    # with its first piece, because a pre-split piece is not the text any more.
    tall = df.filter(is_long).withColumn(_ROW, F.monotonically_increasing_id())
    shape = with_schema(tall, **{_SEQ: "int", _KIND: "int", _PIECE: "string"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                whole = one.column(text)[0].as_py()
                found = list(codec.pieces(whole, leaf_chars))
                repeat = one.take(pa.array([0] * len(found)))
                yield put_columns(
                    repeat.set_column(repeat.schema.get_field_index(text), text, pa.array([whole] + [None] * (len(found) - 1), pa.string())),
                    {
                        _SEQ: pa.array(range(len(found)), pa.int32()),
                        _KIND: pa.array([k for k, _ in found], pa.int32()),
                        _PIECE: pa.array([p for _, p in found], pa.string()),
                    },
                )

    coded = tall.mapInArrow(cut, shape).repartition(_ROW, _SEQ)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            pairs = zip(batch.column(_KIND).to_pylist(), batch.column(_PIECE).to_pylist())
            packed = pa.array([_pack(codec.encode_piece(*p)) for p in pairs], pa.binary())
            yield put_columns(batch.drop_columns([_PIECE]), {"packed_ids": packed})

    encoded = coded.mapInArrow(leaves, with_schema(coded.drop(_PIECE), packed_ids="binary"))

    def gather(table: pa.Table) -> pa.Table:
        codec = _codec(shared.value)
        table = table.sort_by(_SEQ).combine_chunks()
        parts = [_unpack(p) for p in table.column("packed_ids").to_pylist()]
        ids = codec.assemble(table.column(_KIND).to_pylist(), parts)
        made = {"packed_ids": pa.array([_pack(ids)], pa.binary()), "decoded": pa.array([codec.decode(ids)], pa.string())}
        return pa.table({n: made[n] if n in made else table.column(n).slice(0, 1) for n in out.names})

    return direct.unionByName(encoded.groupBy(_ROW).applyInArrow(gather, out))
