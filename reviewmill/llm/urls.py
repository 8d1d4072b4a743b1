"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models (orders 0 to 2, interpolated by the number of distinct continuations)
are counted from the URLs the rules accept and reject. Their log-likelihood difference per character
is one lookup per character in a table of fixed size, so URLs are judged without a join or a shuffle.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-~"  # digits read as 0, anything else as ~
SIZE = len(ALPHABET)
BINS = 1000  # of the calibration histogram
BIN_WIDTH = 0.01
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made).otherwise(found)
    return found


def trigrams(url: Column) -> Column:
    """Numbers of all character trigrams of what follows ``://``, with two start marks before it."""
    plain = F.regexp_replace(F.translate(F.coalesce(_rest(url), F.lit("")), *_LOWER), "[0-9]", "0")
    marked = F.concat(F.lit("~~"), F.regexp_replace(plain, "[^a-z0./-]", "~"))
    codes = F.transform(F.split(marked, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    count = F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, count - 2), F.slice(codes, 2, count - 2), lambda a, b: a * SIZE + b)
    return F.zip_with(pairs, F.slice(codes, 3, count - 2), lambda ab, c: ab * SIZE + c)


def _model(counts: DataFrame, count: str) -> DataFrame:
    """Log-probability of the last character of every trigram; ``counts`` has all SIZE ** 3 of them."""
    first, context = F.floor(F.col("gram") / SIZE**2), F.floor(F.col("gram") / SIZE)
    middle, last = context % SIZE, F.col("gram") % SIZE
    n3 = F.col(count)

    def total(*keys: Column) -> Column:
        return F.sum(n3).over(W.partitionBy(*keys))

    rows = counts.select("gram", n3.alias(count), first.alias("a"), middle.alias("b"), last.alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    sums = rows.select(
        "*", total(a, b).alias("n_ab"), total(b, c).alias("n_bc"), total(b).alias("n_b"), total(c).alias("n_c"),
        total(F.lit(0)).alias("n"), F.sum((n3 > 0).cast("int")).over(W.partitionBy(a, b)).alias("t_ab"),
    )
    one = F.when(F.row_number().over(W.partitionBy(b, c).orderBy(a)) == 1, F.col("n_bc") > 0).otherwise(F.lit(False))
    seen = sums.withColumn("_new", one.cast("int")).withColumn("t_b", F.sum("_new").over(W.partitionBy(b)))
    p0 = (F.col("n_c") + 1) / (F.col("n") + SIZE)
    p1 = F.when(F.col("n_b") > 0, (F.col("n_bc") + F.col("t_b") * p0) / (F.col("n_b") + F.col("t_b"))).otherwise(p0)
    p2 = F.when(F.col("n_ab") > 0, (n3 + F.col("t_ab") * p1) / (F.col("n_ab") + F.col("t_ab"))).otherwise(p1)
    return seen.select("gram", F.log(p2).alias(f"log_{count}"))


def ratio_table(judged: DataFrame) -> DataFrame:
    """One row: array of log-likelihood differences (accepted minus rejected) by trigram number.

    ``judged`` has ``grams`` and ``verdict``. The table has SIZE ** 3 entries whatever the input.
    """
    counts = (
        judged.select("verdict", F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count_if(F.col("verdict") == "allow").alias("accepted"), F.count_if(F.col("verdict") == "block").alias("rejected"))
    )
    every = judged.sparkSession.range(SIZE**3).select(F.col("id").alias("gram"))
    filled = every.join(counts, "gram", "left").fillna(0)
    both = _model(filled, "accepted").join(_model(filled, "rejected"), "gram")
    entry = F.struct("gram", (F.col("log_accepted") - F.col("log_rejected")).alias("value"))
    listed = both.agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return listed.select(F.transform("entries", lambda e: e["value"]).alias("ratios"))


def score(grams: Column, ratios: Column) -> Column:
    """Length-normalised log-likelihood difference; NULL for a URL with nothing after its scheme."""
    total = F.aggregate(F.transform(grams, lambda g: F.get(ratios, g)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(grams) > 0, total / F.size(grams))


def calibrate(scored: DataFrame) -> float:
    """Threshold with the least balanced error on URLs that the rules decide.

    Errors are counted in a histogram of fixed size. Without URLs of both verdicts it is 0.
    """
    place = F.least(F.greatest(F.floor(F.col("score") / BIN_WIDTH), F.lit(-BINS)), F.lit(BINS))
    rows = (
        scored.filter(F.col("verdict").isNotNull() & F.col("score").isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
        .orderBy("bin")
        .collect()  # at most 2 * BINS + 1 rows
    )
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, cut, lost, caught = 2.0, 0.0, 0, 0
    for row in rows:
        error = lost / good + (bad - caught) / bad
        if error < best:
            best, cut = error, row["bin"] * BIN_WIDTH
        lost, caught = lost + row["good"], caught + row["bad"]
    return cut


def filter_urls(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """All rows and columns of ``df`` with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    ``verdict`` is allow or block: the longest fitting rule's; else allow if ``score`` reaches the
    calibrated threshold. A NULL URL or one without ``://`` has an empty host and path, fits no rule and
    is blocked, as there is nothing to fetch. Repeated rows stay repeated and count as often as they
    occur. The new columns replace input columns of the same name. An empty table gives an empty one.
    """
    address = F.col(f"`{url}`").cast("string")
    made = ("host", "path", "rule", "score", "verdict")
    # under neutral names, so that no column added on the way can clash
    named = {c: f"in_{i}" for i, c in enumerate(df.columns) if c not in made}
    carried = [F.col(f"`{c}`").alias(n) for c, n in named.items()]
    kept = [F.col(n).alias(c) for c, n in named.items()]

    def judged(*columns: Column) -> DataFrame:
        parts = df.select(*columns, address.alias("_url"), host_of(address).alias("host"), path_of(address).alias("path"))
        return parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_grams", trigrams(F.col("_url")))

    ruled = judged().select(F.col("_rule.verdict").alias("verdict"), F.col("_grams").alias("grams"))
    known = ruled.filter(F.col("verdict").isNotNull())
    ratios = ratio_table(known).first()["ratios"]  # SIZE ** 3 numbers
    held = df.sparkSession.createDataFrame([(ratios,)], "ratios array<double>").scalar()
    cut = calibrate(known.withColumn("_ratios", held).select("verdict", score(F.col("grams"), F.col("_ratios")).alias("score")))
    scored = judged(*carried).withColumn("_ratios", held).withColumn("score", score(F.col("_grams"), F.col("_ratios")))
    by_model = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(
        *kept, "host", "path", F.col("_rule.rule").alias("rule"), "score",
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"),
    )
