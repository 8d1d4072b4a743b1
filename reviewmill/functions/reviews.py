"""Scalar rules about scores, votes, dates, versions and keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.constants import ENGAGEMENT_CAP, SKEW_HIGH, SKEW_SYMMETRIC, WORDS_PER_PUNCT_CAP


def label_sentiment(score: Column, names=("negative", "neutral", "positive")) -> Column:
    """<= 2 negative, exactly 3 neutral, anything else positive, NULL stays NULL."""
    negative, neutral, positive = names
    return (
        F.when(score.isNull(), None)
        .when(score <= 2, negative)
        .when(score == 3, neutral)
        .otherwise(positive)
    )


def row_key() -> Column:
    """A key for every cleaned review: its id, else a digest of user and text, which identify it then."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    digest = F.md5(F.concat(part("user"), F.lit("|"), part("content")).cast("binary"))
    return F.coalesce(F.col("review_id"), F.concat(F.lit("key-"), digest))


def month_end(ts: Column) -> Column:
    """Midnight of the last day of the month, the bucket key of every monthly table."""
    return F.last_day(ts).cast("timestamp_ntz")


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed periods of 24 hours, not calendar days."""
    return F.timestamp_diff("DAY", start, end)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def major_version(version: Column) -> Column:
    """First version-like integer, else the first digits anywhere, else NULL."""
    tagged = F.regexp_extract(version, r"(?i)\bv?(\d+)(?:\.\d+)?", 1)
    digits = F.regexp_extract(version, r"(\d+)", 1)
    found = F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(digits, F.lit("")))
    return found.try_cast("bigint")


def versions_label(versions: Column) -> Column:
    """``v30, v31`` or an em dash when the month has no release."""
    named = F.transform(versions, lambda v: F.concat(F.lit("v"), v.cast("string")))
    return F.coalesce(F.array_join(named, ", "), F.lit("—"))


def histogram_bar(pct: Column) -> Column:
    """One block per full two percent."""
    return F.repeat(F.lit("█"), F.floor(pct / 2).cast("int"))


def keyword_pattern(keywords: list[str], whole_word: bool = False) -> str:
    """Prefix tree of the keywords as a pattern that takes the longest keyword at each place.

    Words share their beginnings, so a character that starts no keyword is rejected at once.
    """

    def branch(words: list[str]) -> str:
        ends = "" in words
        tails: dict[str, list[str]] = {}
        for word in words:
            if word:
                tails.setdefault(word[0], []).append(word[1:])
        options = [re.escape(char) + branch(rest) for char, rest in sorted(tails.items())]
        if not options:
            return ""
        body = options[0] if len(options) == 1 and not ends else f"(?:{'|'.join(options)})"
        return body + "?" if ends else body

    edge = r"\b" if whole_word else ""
    first = "".join(sorted({re.escape(word[0]) for word in keywords}))
    return f"(?=[{first}]){edge}({branch(sorted(set(keywords)))}){edge}"


def extract_keywords(col: Column, keywords: list[str], whole_word: bool = False) -> Column:
    """Distinct lower-cased hits in first-hit order; empty for NULL text."""
    pattern = F.lit(keyword_pattern(keywords, whole_word))
    hits = F.regexp_extract_all(F.lower(col), pattern, F.lit(1))
    return F.coalesce(F.array_distinct(hits), F.array().cast("array<string>"))


def score_group(score: Column) -> Column:
    """``low`` up to 2, ``high`` for 5, NULL in between."""
    return F.when(score <= 2, "low").when(score == 5, "high")


def words_per_punct(words: Column, punct: Column) -> Column:
    return F.least(words / (punct + 1), F.lit(WORDS_PER_PUNCT_CAP))


def engagement_per_word(votes: Column, words: Column) -> Column:
    return F.least(votes / (words + 1), F.lit(ENGAGEMENT_CAP))


def skew_label(skew: Column) -> Column:
    size = F.abs(skew)
    return (
        F.when(size < SKEW_SYMMETRIC, "fairly symmetrical")
        .when(size < SKEW_HIGH, "moderately skewed")
        .otherwise("highly skewed")
    )


def skew_scaler(skew: Column) -> Column:
    return F.when(F.abs(skew) < SKEW_HIGH, "standard").otherwise("minmax")


def seeded_hash(seed: int, *keys: Column) -> Column:
    """First 52 bits of md5(seed|key|…) as a double: uniform, portable and repeatable."""
    parts = [F.coalesce(key.cast("string"), F.lit("")) for key in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
