"""Secrets: long tokens, and a random forest that removes the false positives among them.

Candidates are unbroken runs of token characters. Their features are length, changes between character classes,
the share of characters in words of a dictionary, signs of a path, and the words around. The forest learns from
labelled findings: by default those that an assignment to a telling name marks as secret, and those
that hold no digit, or stand after a word that names a public value, as harmless. Only DataFrame functions
and the JVM's forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.batches import hash_sample
from reviewmill.llm.privacy import places
from reviewmill.session import write_stage

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
SECRET_NAMES = "token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
PUBLIC_NAMES = "fingerprint|checksum|commit|digest|sha1|sha256|md5|license|version|isbn|uuid"
REACH = 48
DICTIONARY_WORDS = 2000  # most frequent words of the corpus
TRAIN_ROWS = 20_000  # bound of the labelled findings the forest is fitted on
FEATURES = [
    "n_chars", "changes", "digit_share", "upper_share", "distinct_share", "hex", "dictionary_share",
    "slashes", "in_path", "assigned", "quoted", "secret_word", "public_word", "words_before",
]


def dictionary(df: DataFrame, text: str, words: int = DICTIONARY_WORDS) -> DataFrame:
    """One row: the most frequent words of at least three letters, a table of bounded size."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{3,}"), F.lit(0))
    counts = df.select(F.explode(found).alias("word")).groupBy("word").count()
    return counts.orderBy(F.desc("count"), "word").limit(words).agg(F.collect_list("word").alias("words"))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per candidate: ``row``, ``start``, ``stop``, ``value`` and what stands around it."""
    body = F.col(text)
    found = F.when(body.rlike("[A-Za-z0-9+/_-]{20}"), places(body, CANDIDATE))
    rows = df.select("row", body, F.explode(found).alias("c"))
    start = F.greatest(F.col("c.start") - REACH, F.lit(0))
    return rows.select(
        "row", F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.col("c.value").alias("value"),
        F.substring(body, start + 1, F.col("c.start") - start).alias("before"),
        F.substring(body, F.col("c.stop") + 1, F.lit(REACH)).alias("after"),
    )


def features(found: DataFrame, words: Column) -> DataFrame:
    """``found`` with the columns of FEATURES, all doubles."""
    value, before = F.col("value"), F.col("before")
    size = F.length(value)
    shape = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", "U" * 26 + "l" * 26 + "d" * 10 + "ooooo")
    # a change of class is a place where the class differs from the one before: count runs by collapsing them
    runs = F.length(F.regexp_replace(shape, r"(.)\1+", "$1"))
    known = F.filter(F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.array_contains(F.col("_words"), w))
    covered = F.aggregate(F.transform(known, F.length), F.lit(0), lambda a, x: a + x)
    lowered = F.lower(before)

    def flag(test: Column) -> Column:
        return test.cast("double")

    made = {
        "n_chars": size, "changes": (runs - 1) / size,
        "digit_share": F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        "upper_share": F.length(F.regexp_replace(value, "[^A-Z]", "")) / size,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "dictionary_share": covered / size,
        "slashes": F.length(F.regexp_replace(value, "[^/]", "")) / size, "in_path": flag(before.rlike(r"[/.\\]$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(before.rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "secret_word": flag(lowered.rlike(SECRET_NAMES)), "public_word": flag(lowered.rlike(PUBLIC_NAMES)),
        "words_before": F.size(F.split(before, r"\s+")),
    }
    return found.withColumn("_words", words).withColumns({n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in made.items()}).drop("_words")


def default_labels() -> Column:
    """1 for an assigned secret, 0 for a run without digits or after a public name, else NULL."""
    before = F.lower(F.col("before"))
    secret = before.rlike(rf"(?:{SECRET_NAMES})\w*[\"']?\s*[:=]\s*[\"']?$") & (F.col("digit_share") > 0)
    harmless = (F.col("digit_share") == 0) | before.rlike(rf"(?:{PUBLIC_NAMES})\W*$")
    return F.when(secret, 1.0).when(harmless, 0.0)


def find_secrets(df: DataFrame, text: str = "text", labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per candidate: the columns of ``df`` but ``text``, ``start``, ``stop``, ``value``, ``probability``, ``secret``.

    ``labels`` may give (``value``, ``label``) findings judged by hand; without it ``default_labels`` holds. The forest
    is fitted on up to ``train_rows`` distinct labelled findings, chosen by a hash and weighted by their copies. If labelled findings are all of one
    kind, or there are none, nothing can be learnt and the default label, or else the presence of a digit, decides.
    NULL and empty texts have no candidates; repeated rows have their findings each; new columns replace
    input columns of the same name. An empty table gives an empty one.
    """
    made = ("start", "stop", "value", "probability", "secret")
    kept = [c for c in df.columns if c != text and c not in made]
    named = df.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("_")).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    words = dictionary(named, "text").scalar()
    found = write_stage(features(candidates(named, "text"), words), "candidates")
    label = default_labels()
    if labels is not None:
        given = labels.groupBy(F.col("value").cast("string").alias("value")).agg(F.max(F.col("label").cast("double")).alias("label"))
        known = found.join(given, "value", "left")
        label = F.col("label")
    else:
        known = found.withColumn("label", label)
    # half of train_rows of each label at most, so that the rarer one is seen
    # copies share a hash, so they are one row of the sample, with their number as weight
    known = known.filter(F.col("label").isNotNull()).groupBy("label", "value", "before", "start", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    sample = [hash_sample(known.filter(F.col("label") == v), train_rows // 2, "value", "before", "start") for v in (0.0, 1.0)]
    sample = write_stage(sample[0].unionByName(sample[1]).select("label", "n", *FEATURES), "findings")
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").agg(F.sum("n").alias("count")).collect()}
    outer = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)]
    if len(seen) < 2:
        guess = F.coalesce(default_labels(), (F.col("digit_share") > 0).cast("double"))
        return found.select(*outer, "start", "stop", "value", guess.alias("probability"), (guess >= 0.5).alias("secret"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    weight = F.when(F.col("label") == 1, F.lit(seen[0.0] / seen[1.0])).otherwise(F.lit(1.0)) * F.col("n")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", weightCol="_weight", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction", numTrees=20, maxDepth=6, seed=7,
    )
    model = forest.fit(gather.transform(sample.withColumn("_weight", weight)).coalesce(1))
    scored = model.transform(gather.transform(found))
    probability = vector_to_array("_probability")[1]
    return scored.select(*outer, "start", "stop", "value", probability.alias("probability"), (probability >= 0.5).alias("secret"))
