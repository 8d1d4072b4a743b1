"""Personal data: fixed patterns, and terms that reveal whose data they stand by.

The patterns give the protected entities. A term near an entity discloses it as far as the two occur
together more often than apart: their pointwise mutual information, held against the information of
the entity itself. An entity that occurs once has no second context of its own, so the same test is held for
its domain and for its kind. Terms above the threshold are added as spans. Only DataFrame functions are used.

Matches come from ``regexp_extract_all`` and their places from the lengths of what ``split`` leaves between
them. The patterns are written so that a long run without a match is passed over once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.session import write_stage

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (pattern, cheap test that no match can do without); the order is that of the result
PATTERNS = {
    # a match starts where its run of characters does, or where the last match ended
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+", "."),
    # digits with single separators, whole: 13 to 19 of them
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
REACH = 80  # code points around an entity that count as near it
MIN_CONTEXTS = 2  # different contexts in which a term stands near an entity
DISCLOSURE = 0.8  # share of the entity's information that a term may give away
TERM = r"[\p{L}]{3,}"
SPAN = "array<struct<kind:string,start:int,stop:int>>"


def places(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value) of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("value")))
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        stop = start + F.length(step["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), step["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["seen"], F.array(one)).alias("seen"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("seen")), add, lambda s: s["seen"])


def _luhn(digits: Column) -> Column:
    numbers = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10),
    )
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p).between(1, 3), p).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """Array of (kind, start, stop, value), by kind and then place."""
    def of(kind: str, pattern: str, sign: str) -> Column:
        possible = F.contains(text, F.lit(sign)) if sign else text.rlike("[0-9](?:[ -]?[0-9]){12}")
        good = F.filter(places(text, pattern), lambda p: _holds(kind, p["value"]))
        named = F.transform(
            good, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["stop"].alias("stop"), p["value"].alias("value"))
        )
        return F.when(possible, named).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>"))

    return F.concat(*[of(kind, *rest) for kind, rest in PATTERNS.items()])


def _groups(kind: Column, value: Column) -> Column:
    """What an entity is counted under: itself, its domain (mail host, network, issuer, block of numbers) and its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    domain = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(digits.substr(F.lit(1), F.length(digits) - 4))
    )
    return F.array(F.concat_ws(":", kind, value), F.concat_ws(" in ", kind, domain), kind)


def _term_counts(df: DataFrame, text: str) -> DataFrame:
    """Documents that hold each term; partial counts are combined before the shuffle."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))


def find_private(
    df: DataFrame, text: str = "text", reach: int = REACH, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE
) -> DataFrame:
    """All rows and columns of ``df`` but ``text``, with ``spans``: (kind, start, stop) in code points.

    Kinds are email, ip, card, phone, then term; spans are sorted by kind in that order and by start. A
    term is disclosing if it stands near the entity in ``min_contexts`` different contexts and their mutual
    information reaches ``disclosure`` times that of the entity: it is marked wherever it is near that
    entity. The same holds for all entities of one domain and of one kind together, so an entity that occurs
    once has its terms as well. NULL and empty texts have no spans. Repeated rows keep their own spans, and copies of a
    context count once. An empty table gives an empty one. ``spans`` replaces a column of that name.
    """
    kept = [c for c in df.columns if c not in (text, "spans")]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)], body.alias("_text"))
    found = rows.withColumn("_found", entities(F.col("_text")))
    near = F.transform(
        "_found",
        lambda e: F.struct(
            _groups(e["kind"], e["value"]).alias("entities"),
            F.greatest(e["start"] - reach, F.lit(0)).alias("start"),
            e["start"].alias("gap"),
            e["stop"].alias("gap_stop"),
            F.substring(F.col("_text"), F.greatest(e["start"] - reach, F.lit(0)) + 1, e["stop"] + reach - F.greatest(e["start"] - reach, F.lit(0))).alias("context"),
        ),
    )
    spans = F.transform("_found", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["stop"].alias("stop")))
    # the row number is fixed by the write; the text is not kept, only what stands near entities
    marked = write_stage(
        found.select(*[f"_in{i}" for i in range(len(kept))], F.monotonically_increasing_id().alias("_row"), spans.alias("_spans"), near.alias("_near")),
        "entities",
    )
    around = marked.filter(F.size("_near") > 0).select("_row", F.explode("_near").alias("n")).select("_row", "n.*")
    # the entity itself is blanked, so that its own letters are no terms
    blank = F.overlay(
        "context", F.rpad(F.lit(""), F.col("gap_stop") - F.col("gap"), F.lit(" ")), F.col("gap") - F.col("start") + 1
    )
    mentions = around.select(
        "_row", "entities", "start", F.xxhash64("context").alias("context"), F.explode(places(blank, TERM)).alias("w")
    ).select(
        "_row", F.explode("entities").alias("entity"), "context", F.lower("w.value").alias("term"),
        (F.col("start") + F.col("w.start")).alias("start"), (F.col("start") + F.col("w.stop")).alias("stop"),
    )
    pairs = (
        mentions.groupBy("entity", "term")
        .agg(F.count_distinct("context").alias("contexts"), F.count_distinct("_row").alias("together"))
        .filter(F.col("contexts") >= min_contexts)
    )
    holders = around.select("_row", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count_distinct("_row").alias("with_entity"))
    total = marked.agg(F.count(F.lit(1)).cast("double")).scalar()
    information = F.log(total / F.col("with_entity"))
    mutual = F.log(F.col("together") * total / (F.col("with_term") * F.col("with_entity")))
    telling = (
        pairs.join(holders, "entity")
        .join(_term_counts(rows, "_text"), "term")
        .filter((information > 0) & (mutual >= disclosure * information))
        .select("entity", "term")
    )
    added = (
        mentions.join(telling, ["entity", "term"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "stop"))).alias("_terms"))
    )
    full = marked.join(added, "_row", "left")
    return full.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)],
        F.concat("_spans", F.coalesce("_terms", F.array().cast(SPAN))).cast(SPAN).alias("spans"),
    )


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind; a span that starts inside another is removed with it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        plain = F.when(s["start"] >= state["at"], F.concat(text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], plain).alias("out"))

    done = F.aggregate(ordered, begin, add)
    return F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))
