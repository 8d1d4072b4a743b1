"""Text cleaning and text measures as column expressions.

The cleaning steps do not commute, so their order is fixed: decode entities, remove URLs, drop
unprintable characters, NFKC, collapse white space, remove emoji. ASCII rows without an ampersand
stay in native expressions, which agree with the Unicode-exact steps there. All other rows go
through one Arrow UDF; ASCII rows reach it as NULL and cost no Python work. The counts that features
need of a text are one Arrow UDF as well.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import EMOJI_ONLY_RANGES, EMOJI_RANGES

# Workers get the UDFs by value, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space as Python's str methods see it: Unicode White_Space plus U+001C..U+001F. The classes
# are shaped for speed: frequent characters are decided by the first one or two ranges.
_ODD_SPACE = (
    r"[\x00-\x1f\x7f-\xa0\x{1680}-\x{3000}&&[\x09-\x0d\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
_SPACE = f"(?: |{_ODD_SPACE})"
_COMMON = r"[\x21-\x7e\xa1-\x{167f}\x{3001}-\x{10ffff}]"
_RARE = (
    r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}]"
)
_VISIBLE = f"(?:{_COMMON}|{_RARE})"
_TOKEN = f"(?:{_COMMON}++|{_RARE})+"

_ASCII_URL = r"http[^\s\x0b\x1c-\x1f]+|www\.[^\s\x0b\x1c-\x1f]+"
_ASCII_UNPRINTABLE = r"[\x00-\x08\x0b-\x1f\x7f]"
_ASCII_LOOSE_SPACE = r"[ \n\t]*[\n\t][ \n\t]*| {2,}"


def _emoji_class(mode: str) -> str:
    ranges = {"legacy": EMOJI_RANGES, "emoji_only": EMOJI_ONLY_RANGES}[mode]
    return "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges)


def is_ascii(col: Column) -> Column:
    """Bytes equal characters: no decoding, no scan with a pattern."""
    return F.octet_length(col) == F.length(col)


class _DropUnprintable(dict):
    """Translation table filled on demand: unprintable code points map to nothing."""

    def __missing__(self, code: int):
        char = chr(code)
        keep = char.isprintable() or char in "\n\t"
        self[code] = code if keep else None
        return self[code]


_PRINTABLE = _DropUnprintable()
_PY_URL = re.compile(r"(?:http|www\.)\S+")


def _exact(step):
    """Arrow UDF applying ``step`` to the non-null values of a string column."""

    def apply(values: pd.Series) -> pd.Series:
        return values.map(step, na_action="ignore")

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, T.StringType())


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _exact_cleaner(mode: str):
    emoji = re.compile(f"[{_emoji_class(mode)}]+")  # its code points are all above Latin-1

    def steps(text: str) -> str:
        """A step is skipped where a cheap look shows that it would change nothing."""
        text = html.unescape(text)
        if "http" in text or "www." in text:
            text = _PY_URL.sub("", text)
        if not text.replace("\n", "").replace("\t", "").isprintable():
            text = text.translate(_PRINTABLE)
        text = " ".join(unicodedata.normalize("NFKC", text).split())
        return text if _is_latin(text) else emoji.sub("", text)

    return _exact(steps)


_clean_udfs = {mode: _exact_cleaner(mode) for mode in ("legacy", "emoji_only")}
_unescape_udf = _exact(html.unescape)
_url_udf = _exact(lambda text: _PY_URL.sub("", text))
_printable_udf = _exact(lambda text: text.translate(_PRINTABLE))
_nfkc_udf = _exact(lambda text: unicodedata.normalize("NFKC", text))


def _split_paths(col: Column, simple: Column, native: Column, exact_udf) -> Column:
    """Native expression for simple rows, the UDF for the rest."""
    return F.coalesce(exact_udf(F.when(~simple, col)), F.when(simple, native))


def _ascii_urls(col: Column) -> Column:
    suspect = col.contains("http") | col.contains("www.")
    return F.when(suspect, F.regexp_replace(col, _ASCII_URL, "")).otherwise(col)


def html_unescape(col: Column) -> Column:
    """Decode HTML entities, single pass."""
    return _split_paths(col, ~col.contains("&"), col, _unescape_udf)


def strip_urls(col: Column) -> Column:
    """Remove ``http…`` and ``www.…`` up to the next white space."""
    return _split_paths(col, is_ascii(col), _ascii_urls(col), _url_udf)


def strip_nonprintable(col: Column) -> Column:
    """Drop unprintable characters except newline and tab."""
    native = F.regexp_replace(col, _ASCII_UNPRINTABLE, "")
    return _split_paths(col, is_ascii(col), native, _printable_udf)


def nfkc_normalize(col: Column) -> Column:
    """Unicode NFKC; ASCII is already normal."""
    return _split_paths(col, is_ascii(col), col, _nfkc_udf)


def _has_odd_space(col: Column) -> Column:
    """Any white space other than the blank; cleaned text has none."""
    return col.rlike(_ODD_SPACE)


def collapse_whitespace(col: Column) -> Column:
    """Every run of white space becomes one blank; none at either end."""
    blanks = F.regexp_replace(col, " {2,}", " ")
    return F.trim(F.when(_has_odd_space(col), F.regexp_replace(col, _SPACE + "+", " ")).otherwise(blanks))


def strip_emoji(col: Column, mode: str = "legacy") -> Column:
    """Remove emoji runs. ``legacy`` also deletes CJK and Hangul; ``emoji_only`` does not."""
    stripped = F.regexp_replace(col, f"[{_emoji_class(mode)}]+", "")
    return F.when(is_ascii(col), col).otherwise(stripped)


def clean_text(col: Column, emoji: str = "legacy") -> Column:
    """All cleaning steps in their binding order; NULL stays NULL."""
    printable = F.regexp_replace(_ascii_urls(col), _ASCII_UNPRINTABLE, "")
    native = F.trim(F.regexp_replace(printable, _ASCII_LOOSE_SPACE, " "))
    return _split_paths(col, is_ascii(col) & ~col.contains("&"), native, _clean_udfs[emoji])


def has_text(col: Column) -> Column:
    """True when at least one character is not white space."""
    return col.rlike(_VISIBLE)


def strip_space(col: Column) -> Column:
    """Python-style strip: Unicode white space removed at both ends."""
    return F.regexp_replace(col, rf"^{_SPACE}+|{_SPACE}+\z", "")


def content_len(col: Column) -> Column:
    return F.length(col)


def word_count(col: Column) -> Column:
    """Tokens between white space; splitting at blanks is enough when there is nothing else."""
    tokens = F.size(F.filter(F.split(col, " "), lambda token: token != ""))
    return F.when(_has_odd_space(col), F.regexp_count(col, F.lit(_TOKEN))).when(col.isNotNull(), tokens)


def avg_word_len(col: Column, words: Column | None = None) -> Column:
    """Mean token length; 0.0 when there is no token."""
    words = word_count(col) if words is None else words
    odd = F.when(_has_odd_space(col), F.regexp_count(col, F.lit(_ODD_SPACE))).otherwise(0)
    letters = F.length(F.replace(col, F.lit(" "), F.lit(""))) - odd
    return F.when(words > 0, letters / words).when(words == 0, F.lit(0.0))


def punct_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit("[!?.,;:]"))


def upper_ratio(col: Column) -> Column:
    upper = F.regexp_count(col, F.lit(r"\p{IsUppercase}"))
    return upper / F.greatest(F.length(col), F.lit(1))


_COUNTS = ("words", "letters", "punct", "upper")
_BYTES = (b" ", b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", bytes(range(128)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?.,;:")
_KINDS = np.array([[code in kind for code in range(256)] for kind in _BYTES], np.int64)


def _beyond_ascii(data: bytes) -> str:
    """The characters of a UTF-8 text that are not ASCII."""
    return "" if data.isascii() else data.translate(None, _BYTES[2]).decode("utf-8", "replace")


def _counts(data: bytes) -> tuple[int, int, int, int]:
    """Tokens between white space, their characters, punctuation and upper-case letters of a UTF-8 text."""
    blanks, odd, ascii_, upper, punct = (_KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist()
    others = _beyond_ascii(data) if ascii_ < len(data) else ""
    seen = "".join(others.split())
    if odd or len(seen) < len(others) or b"  " in data or data[:1] == b" " or data[-1:] == b" ":
        words = len(data.decode("utf-8", "replace").split())
    else:
        words = blanks + 1 if data else 0
    return words, ascii_ - blanks - odd + len(seen), punct, upper + sum(map(str.isupper, others))


def _count_all(values: pa.Array) -> pa.Array:
    rows = [(None,) * 4 if data is None else _counts(data) for data in values.to_pylist()]
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_COUNTS))


_count_udf = F.arrow_udf(_count_all, T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS]))


def text_counts(col: Column) -> Column:
    """``words``, ``letters`` in them, ``punct`` and ``upper`` of a text in one pass, as the single counts above; NULL fields for NULL."""
    return _count_udf(col.cast("binary"))
