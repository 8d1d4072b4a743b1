"""Emotional and functional keywords in low and high rated reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.constants import (
    CONTENT_CANDIDATES,
    EMOTIONAL_KEYWORDS,
    FUNCTIONAL_KEYWORDS,
    SCORE_CANDIDATES,
    SUMMARY_KEYWORDS,
    TOP_KEYWORDS,
)
from reviewmill.functions.automaton import find_keywords
from reviewmill.functions.casts import to_number
from reviewmill.functions.reviews import extract_keywords, score_group
from reviewmill.operators.harmonize import resolve_column

GROUPS = ("low", "high")
CATEGORIES = ("Emotional", "Functional")


def annotate_keywords(df: DataFrame, whole_word: bool = False) -> DataFrame:
    """Low and high reviews with their keyword hits. Rows without text stay, with no hits."""
    score = resolve_column(df, SCORE_CANDIDATES)
    content = resolve_column(df, CONTENT_CANDIDATES)
    kind = df.schema[score].dataType
    number = F.col(score) if isinstance(kind, T.NumericType) else to_number(F.col(score), kind)
    picked = df.filter((number <= 2) | (number == 5)).withColumn("score_group", score_group(number))
    lists = {"em_matches": EMOTIONAL_KEYWORDS, "fn_matches": FUNCTIONAL_KEYWORDS}
    if whole_word:  # word edges are a matter for patterns
        matched = picked.withColumns({name: extract_keywords(F.col(content), words, True) for name, words in lists.items()})
    else:
        hits = picked.withColumn("_keyword_hits", find_keywords(F.col(content), lists))
        matched = hits.withColumns({name: F.col(f"_keyword_hits.{name}") for name in lists}).drop("_keyword_hits")
    return matched.withColumns(
        {"has_em": F.size("em_matches") > 0, "has_fn": F.size("fn_matches") > 0}
    )


def keyword_counts(df: DataFrame) -> DataFrame:
    """score_group, category, keyword, n: everything the reports need, from one pass over the text.

    Every report below takes these counts as ``counts``, so that several reports share the pass: write them as a stage.

    A row with an empty keyword counts the reviews with any hit in the category; a row with an empty
    category counts all reviews of the group.
    """

    return count_keywords(annotate_keywords(df))


def count_keywords(annotated: DataFrame) -> DataFrame:
    """The counts of :func:`keyword_counts` from rows that :func:`annotate_keywords` has marked."""

    def entries(category: str, words: str) -> Column:
        any_hit = F.when(F.size(words) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.transform(
            F.concat(any_hit, F.col(words)),
            lambda word: F.struct(F.lit(category).alias("category"), word.alias("keyword")),
        )

    everything = F.array(F.struct(F.lit("").alias("category"), F.lit("").alias("keyword")))
    tagged = F.concat(everything, *[entries(c, w) for c, w in zip(CATEGORIES, ("em_matches", "fn_matches"))])
    rows = annotated.select("score_group", F.inline(tagged))
    return rows.groupBy("score_group", "category", "keyword").agg(F.count(F.lit(1)).alias("n"))


def _counts(df: DataFrame, counts: DataFrame | None) -> DataFrame:
    return keyword_counts(df) if counts is None else counts


def _marker(category: str) -> Column:
    hit = (F.col("category") == category) & (F.col("keyword") == "")
    return F.coalesce(F.max(F.when(hit, F.col("n"))), F.lit(0).cast("bigint"))


def keyword_group_stats(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    grouped = _counts(df, counts).groupBy("score_group").agg(
        _marker("").alias("n"), *[_marker(c).alias(name) for c, name in zip(CATEGORIES, ("em_count", "fn_count"))]
    )
    return grouped.withColumns(
        {"em_prop": F.col("em_count") / F.col("n"), "fn_prop": F.col("fn_count") / F.col("n")}
    )


def keyword_document_frequency(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Reviews containing each keyword, per group and category."""
    return _counts(df, counts).filter(F.col("keyword") != "")


def _ranked(counts: DataFrame) -> DataFrame:
    """Keywords by document frequency; the marker rows sort before all of them and get rank 0."""
    order = Window.partitionBy("score_group", "category").orderBy(
        (F.col("keyword") == "").desc(), F.col("n").desc(), "keyword"
    )
    return counts.withColumn("rank", F.row_number().over(order) - 1)


def top_keywords(df: DataFrame, n: int = TOP_KEYWORDS, counts: DataFrame | None = None) -> DataFrame:
    ranked = _ranked(_counts(df, counts))
    return ranked.filter((F.col("rank") > 0) & (F.col("rank") <= n))


def keyword_summary(df: DataFrame, k: int = SUMMARY_KEYWORDS, counts: DataFrame | None = None) -> DataFrame:
    """Four rows: group, category, top keywords joined, proportion; 0 for an empty group."""
    rows = []
    for group in GROUPS:
        here = F.col("score_group") == group
        total = F.max(F.when(here & (F.col("category") == ""), F.col("n")))
        for category in CATEGORIES:
            inside = here & (F.col("category") == category)
            hits = F.max(F.when(inside & (F.col("rank") == 0), F.col("n")))
            best = F.collect_list(
                F.when(inside & F.col("rank").between(1, k), F.struct("rank", "keyword"))
            )
            rows.append(
                F.struct(
                    F.lit(group).alias("score_group"),
                    F.lit(category).alias("category"),
                    F.array_join(F.transform(F.array_sort(best), lambda e: e["keyword"]), ", ").alias("top_keywords"),
                    F.bround(F.coalesce(hits / total, F.lit(0.0)) * 100, 2).alias("prop_pct"),
                )
            )
    return _ranked(_counts(df, counts)).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def keyword_proportions(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """group, category, prop_pct: the four bars of the comparison chart."""
    return keyword_summary(df, counts=counts).drop("top_keywords")
