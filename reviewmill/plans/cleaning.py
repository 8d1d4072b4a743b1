"""From review sources to the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.casts import to_datetime, to_number
from reviewmill.functions.reviews import row_key
from reviewmill.functions.text import clean_text, has_text
from reviewmill.operators.dedup import newest_without_text
from reviewmill.operators.filters import drop_blank_content
from reviewmill.operators.harmonize import (
    fill_anonymous_user,
    harmonize_columns,
    project_final_columns,
    union_sources,
)
from reviewmill.operators.ordering import WIDE_ROWS, parts_of
from reviewmill.operators.quality import cap_at_quantile, flag_very_long
from reviewmill.session import write_stage


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Harmonize every source, union them with all copies, and fill anonymous users."""
    frames = [harmonize_columns(df, name) for name, df in sources.items()]
    return fill_anonymous_user(union_sources(*frames))


def clean_rows(df: DataFrame) -> DataFrame:
    """Row-wise part: drop blank text, clean it, cast. Rows may be empty afterwards."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    votes = F.coalesce(to_number(F.col("thumbs_up"), kinds["thumbs_up"]), F.lit(0.0))
    return drop_blank_content(df).withColumns(
        {
            "content": clean_text(F.col("content")),
            "score": to_number(F.col("score"), kinds["score"]),
            "thumbs_up": votes.cast("bigint"),
            "created_at": to_datetime(F.col("created_at"), kinds["created_at"]),
        }
    )


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Cleaned rows, written once, with a number of their own, their key, and length and digest of the text."""
    text = F.col("content")
    keyed = rows.withColumns(
        {
            "content_len": F.length(text), "_digest": F.md5(text.cast("binary")), "_text": text.isNotNull() & has_text(text),
            "row_key": row_key(), "_row": F.monotonically_increasing_id(),
        }
    )
    return write_stage(keyed, "clean-rows")


def unique_facts(keyed: DataFrame) -> DataFrame:
    """All but the text of the cleaned reviews: rows that cleaning emptied are dropped, the others deduplicated, votes
    capped, long texts flagged. ``keyed`` comes from :func:`keyed_rows`; ``_row`` leads back to it."""
    stage = write_stage(newest_without_text(keyed.filter("_text")).drop("_text", "_digest"), "unique-rows")
    return flag_very_long(cap_at_quantile(stage, "thumbs_up", "thumbs_up_capped"))


def with_text(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``facts`` with the columns of ``texts`` that ``_row`` leads to: rows of ``facts`` are hashed, texts stream past them unsorted."""
    parts = parts_of(facts, WIDE_ROWS)
    return texts.repartition(parts, "_row").join(facts.repartition(parts, "_row").hint("shuffle_hash"), "_row")


def finish_cleaning(rows: DataFrame) -> DataFrame:
    """Drop rows that cleaning emptied, deduplicate, cap votes, flag long texts, project.

    The cleaned rows are written, so that everything but the last join reads narrow columns and no text is cleaned again.
    """
    keyed = keyed_rows(rows)
    return project_final_columns(with_text(unique_facts(keyed), keyed.select("_row", "content")))


def clean_reviews(df: DataFrame) -> DataFrame:
    """The cleaned eleven-column table of a merged one."""
    return finish_cleaning(clean_rows(df))
