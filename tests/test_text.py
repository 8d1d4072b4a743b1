"""Text functions against the plain Python meaning of every step."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewmill.constants import EMOJI_RANGES, EMOTIONAL_KEYWORDS, FUNCTIONAL_KEYWORDS
from reviewmill.functions import automaton, casts, reviews, text
from reviewmill.operators import keywords
from reviewmill.operators.features import text_features

EMOJI = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in EMOJI_RANGES) + "]+")
CASES = [
    None, "", "   ", "\t\n", "plain text", "a b", "ｈｔｔｐ://x y", "&nbsp;a&#39;b&lt", "see http://x.y/z　after",
    "www.a.b c", "x &amp;amp; y", "a & b &c; &copy", "日本語", "한국어", "العربية", "ไทย", "★ star", "good 😀", "😀😀 ok 🤣",
    "\U0001fae0 new", "é é ﬁ ²", "line\r\nbreak\x0bvt\x1cfs\x85nel", "tab\tand  spaces ", "​zero‍width", "İI ſs",
    "http", "http ", "https://a.b/c?d=e&f=g h", "two  blanks\n\n three", " sep ", "mixed　wide space",
    *[f"x{chr(i)}y" for i in range(0, 256)],
]


def expected_clean(value):
    if value is None:
        return None
    value = re.sub(r"http\S+|www\.\S+", "", html.unescape(value))
    value = "".join(c for c in value if c.isprintable() or c in "\n\t")
    value = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip()
    return EMOJI.sub("", value)


def run(make, fn, values=CASES):
    df = make([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["r"] for r in df.select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()]


def test_clean_text_matches_python_on_every_case(make):
    got = run(make, text.clean_text)
    wrong = [(v, g, expected_clean(v)) for v, g in zip(CASES, got) if g != expected_clean(v)]
    assert wrong == []


def test_single_steps_match_python(make):
    steps = {
        text.html_unescape: html.unescape,
        text.strip_urls: lambda v: re.sub(r"http\S+|www\.\S+", "", v),
        text.strip_nonprintable: lambda v: "".join(c for c in v if c.isprintable() or c in "\n\t"),
        text.nfkc_normalize: lambda v: unicodedata.normalize("NFKC", v),
        text.strip_space: str.strip,
        text.strip_emoji: lambda v: EMOJI.sub("", v),
        text.word_count: lambda v: len(v.split()),
    }
    for fn, python in steps.items():
        got = run(make, fn)
        assert got == [None if v is None else python(v) for v in CASES], fn.__name__


def test_collapse_whitespace_trims_and_joins(make):
    got = run(make, text.collapse_whitespace)
    assert got == [None if v is None else " ".join(v.split()) for v in CASES]


def test_emoji_modes(make):
    values = ["日本語 ★ 한국어", "good 😀"]
    assert run(make, text.strip_emoji, values) == [" ★ " if not EMOJI.search("★") else "  ", "good "]
    assert run(make, lambda c: text.strip_emoji(c, "emoji_only"), values) == ["日本語 ★ 한국어", "good "]


def test_measures(make):
    values = ["", "Hello, World!", "a  b\tc", "ÄÖ ü", "trailing "]
    assert run(make, text.avg_word_len, values) == pytest.approx([0.0, 6.0, 1.0, 1.5, 8.0])
    assert run(make, text.punct_count, values) == [0, 2, 0, 0, 0]
    assert run(make, text.upper_ratio, values) == pytest.approx([0.0, 2 / 13, 0.0, 0.5, 0.0])
    assert run(make, lambda c: text.has_text(c), ["", " 　", "\x1c", "x", None]) == [False, False, False, True, None]


def test_numbers(make):
    values = ["4", " 5 ", "x", "1e2", "0x10", "1_0", "5d", "", "-.5", "3.", "inf", None]
    got = run(make, casts.to_number, values)
    assert got == [4.0, 5.0, None, 100.0, None, None, None, None, -0.5, 3.0, float("inf"), None]


def test_null_tokens(make):
    values = ["NA", "null", "None", "n/a", "nan", "", "ok", "Nan"]
    assert run(make, casts.tokens_to_null, values) == [None] * 6 + ["ok", "Nan"]
    assert run(make, lambda c: casts.tokens_to_null(c, ["ok"]), values)[6] is None


def test_datetimes(make):
    values = ["2024-02-29 23:00:01", "2024-01-05", "01/02/2024", "2024", "soon", None]
    got = [None if v is None else str(v) for v in run(make, casts.to_datetime, values)]
    assert got == ["2024-02-29 23:00:01", "2024-01-05 00:00:00", "2024-01-02 00:00:00", None, None, None]


def test_versions(make):
    assert run(make, reviews.major_version, ["v33.1.4", "33", "abc12", "x", None, "beta V7", "1-2"]) == [
        33, 33, 12, None, None, 7, 1,
    ]


def test_sentiment(make):
    df = make([(i, v) for i, v in enumerate([None, 0.0, 2.0, 2.5, 3.0, 3.5, 5.0])], "i int, s double")
    got = [r[0] for r in df.orderBy("i").select(reviews.label_sentiment(F.col("s"))).collect()]
    assert got == [None, "negative", "negative", "positive", "neutral", "positive", "positive"]


def first_hits(value, words):
    pattern = re.compile("|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))))
    return list(dict.fromkeys(pattern.findall((value or "").lower())))


def test_keywords_match_longest_first_alternation(make):
    rng = random.Random(5)
    words = EMOTIONAL_KEYWORDS + FUNCTIONAL_KEYWORDS
    values = ["Bug bug Crashed quit", None, "", "flag storage laggy annoyed problems effects"]
    values += ["".join(rng.choice([*words, " ", "s", "ed", "x"]) for _ in range(12)) for _ in range(200)]
    for group in (EMOTIONAL_KEYWORDS, FUNCTIONAL_KEYWORDS):
        got = run(make, lambda c: reviews.extract_keywords(c, group), values)
        assert got == [first_hits(v, group) for v in values]
    assert run(make, lambda c: reviews.extract_keywords(c, EMOTIONAL_KEYWORDS), values)[0] == ["bug", "crashed"]
    assert run(make, lambda c: reviews.extract_keywords(c, FUNCTIONAL_KEYWORDS), values)[0] == ["ui"]


def test_automaton_equals_the_pattern_of_each_list(make):
    rng = random.Random(7)
    lists = {"one": ["aab", "a", "ab", "abab", "ba"], "two": ["he", "she", "hers", "ab", "é😀", "bc"], "none": []}
    values = [None, "", "ABAB shers", "é😀" * 3]
    values += ["".join(rng.choice("aabbhesrcé😀 ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    got = run(make, lambda c: automaton.find_keywords(c, lists), values)
    for name, words in lists.items():
        assert [row[name] for row in got] == [first_hits(v, words) if words else [] for v in values]
    long = "x" * 300_000 + "crash" + "lag" * 50_000
    assert automaton.hits_per_list(long, (("crash", "lag", "laggy"),)) == [["crash", "lag"]]


def test_keywords_take_one_pass_in_one_worker_call(make):
    df = make([(1.0, "Bug in the UI")], "score double, content string")
    plan = keywords.keyword_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_whole_word_keywords(make):
    got = run(make, lambda c: reviews.extract_keywords(c, FUNCTIONAL_KEYWORDS, True), ["quit the ui", "quit"])
    assert got == [["ui"], []]


def test_elapsed_days_are_not_calendar_days(spark):
    row = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-02 01:00:00' b, timestamp_ntz'2024-02-29 10:00:00' c"
    ).select(
        reviews.whole_days(F.col("a"), F.col("b")).alias("d"),
        reviews.month_end(F.col("c")).cast("string").alias("m"),
        reviews.day_of_week(F.lit("2024-01-06").cast("date")).alias("w"),
    ).first()
    assert (row["d"], row["m"], row["w"]) == (0, "2024-02-29 00:00:00", 5)


def test_text_features_count_in_one_pass(spark):
    chars = [" ", "  ", "\n", "\t", "a", "B", "É", "ß", "Ⅷ", "\xa0", "　", "\x1c", "\x85", "中", "!", ".", ";", "😀", "​", "İ"]
    draw = random.Random(3)
    rows = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 20))) for _ in range(500)] + [None, "", " ", "plain words here"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, content string")
    counted = text_features(df)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and plan.count("ArrowEvalPython") == 1
    for row in counted.collect():
        value = row["content"]
        if value is None:
            assert row["content_len_words"] is None and row["upper_ratio"] is None and row["avg_word_len"] is None
            continue
        words = value.split()
        assert row["content_len_words"] == len(words) and row["content_len_chars"] == len(value)
        assert row["punct_count"] == sum(c in "!?.,;:" for c in value)
        assert row["upper_ratio"] == sum(c.isupper() for c in value) / max(1, len(value))
        assert row["avg_word_len"] == (sum(map(len, words)) / len(words) if words else 0.0)
