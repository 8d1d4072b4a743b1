"""Queries of the text corpus operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import bpe, collocations, decontaminate, lines, lmscore, minhash, mixing, privacy, quality, repair, secret_scan, urls, weak
from reviewmill.llm.batches import doc_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A-Z only, as the operators lower-case
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op5_decontaminate",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hits AS (
  SELECT s.doc_id, s.p, s.size, win.item_id
  FROM (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM spots, sizes WHERE p + size - 1 <= len(w)) s
  JOIN win USING (win, size)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op5_decontaminate(spark, sf_dir):
    """Words, hit words and items found per document, by binary search in suffix arrays."""
    found = decontaminate.find_matches(doc_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_bpe")
def op9_bpe(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    coded = bpe.encode(doc_text(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        (F.length("packed_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op1_minhash",
    rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x),
low AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
""",
)
def op1_minhash(spark, sf_dir):
    """Shingle count, component and whether it is the one that stays, per document."""
    return minhash.near_duplicates(doc_text(table(spark, sf_dir, "documents")))


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    """Counts, base rules and the classifier's verdict per document."""
    return quality.judge(doc_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")).drop("text")


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    """Host, path, rule and verdict per page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "score", "verdict")


@query("op7_pii")
def op7_pii(spark, sf_dir):
    """Counts and digests of the spans of personal data, and all spans with disclosing terms."""
    found = privacy.find_private(doc_text(table(spark, sf_dir, "documents")))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in privacy.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    """Unigram and network log-probabilities of every document."""
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    """Soft label, probability of good quality, and verdict per document."""
    return weak.classify(doc_text(table(spark, sf_dir, "documents")), labels=table(spark, sf_dir, "labels")).drop("text")


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Every candidate with its place, probability and verdict."""
    return secret_scan.find_secrets(doc_text(table(spark, sf_dir, "documents")))


@query("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    """Lines of every document, and which of them repeat an earlier one."""
    docs = doc_text(table(spark, sf_dir, "documents"))
    gone = lines.repeated_lines(docs)
    body = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", F.xxhash64(body).alias("version"),
        F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.version") == F.col("g.version"))
    return sized.alias("d").join(gone.alias("g"), same, "left").select(
        "d.doc_id", "d.n_lines", F.coalesce(F.size("g.places"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("g.places").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )


@query(
    "op12_mix_sources",
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(s) OVER () AS n, row_number() OVER (ORDER BY s / w, rank) AS place,
         coalesce(sum(s) OVER (ORDER BY s / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
         sum(w) OVER (ORDER BY s / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u
  FROM s),
level AS (SELECT 3 * n - 4 * c AS height, 2 * u AS width FROM o WHERE 4 * s * u >= (3 * n - 4 * c) * w ORDER BY place LIMIT 1),
t AS (
  SELECT source, rank, CAST(s AS BIGINT) AS source_size,
         CASE WHEN 2 * s * width < w * height THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * height AS DOUBLE) / CAST(width AS DOUBLE) END AS target,
         CAST('0x' || substr(md5('12:' || coalesce('s' || source, 'n')), 1, 13) AS BIGINT) AS start
  FROM o, level),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 4503599627370496.0) AS HUGEINT) ELSE 0 END AS e FROM t),
p AS (
  SELECT doc_id, size, source_size, target, e, start,
         row_number() OVER (PARTITION BY rank ORDER BY size, substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12), doc_id) AS k
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(((k * e + start) // 4503599627370496 - ((k - 1) * e + start) // 4503599627370496) * size AS BIGINT) AS taken
FROM p
""",
)
def op12_mix_sources(spark, sf_dir):
    """Size of every document, its source's size and target, and how many of its words the mix takes."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(
    "op13_repair_conversations",
    r"""
WITH RECURSIVE k0 AS (SELECT unnest(range(256)) AS i),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM k0),
keyed AS (
  SELECT *, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes
  FROM conversations),
cased AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(bytes, lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
  FROM keyed, crc_table),
alive AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM cased, range(2) r(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM alive),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
                 WHEN regexp_matches(text, '[^.!? 	-
][ 	-
]*\z') THEN 't' ELSE '-' END AS fault,
         left(role, 1) AS i, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS j
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n
  FROM faulty GROUP BY conv_id),
-- cheapest way to each state: nothing yet (e), system (s), user (u), assistant (a) was last; c cost, x edits, y text
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS p, {'c': CAST(0 AS BIGINT), 'x': '', 'y': ''} AS e, {'c': CAST(99999 AS BIGINT), 'x': '', 'y': ''} AS s,
         {'c': CAST(99999 AS BIGINT), 'x': '', 'y': ''} AS u, {'c': CAST(99999 AS BIGINT), 'x': '', 'y': ''} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, p,
         list_min([{'c': e.c + d, 'x': e.x || 'D', 'y': e.y}]),
         list_min([{'c': s.c + d, 'x': s.x || 'D', 'y': s.y}, {'c': e.c + CASE WHEN i = 's' THEN k ELSE 99999 END, 'x': e.x || 'K', 'y': e.y || line}]),
         list_min([{'c': u2.c + d, 'x': u2.x || 'D', 'y': u2.y}]
           || list_transform([e, s, a2], lambda z: {'c': z.c + CASE WHEN i = 'u' THEN k ELSE 99999 END, 'x': z.x || 'K', 'y': z.y || line})
           || list_transform([e, s, a2], lambda z: {'c': z.c + k + 3, 'x': z.x || 'R', 'y': z.y || chr(10) || 'user:' || text})),
         list_min([{'c': a2.c + d, 'x': a2.x || 'D', 'y': a2.y},
           {'c': u2.c + CASE WHEN i = 'a' THEN k ELSE 99999 END, 'x': u2.x || 'K', 'y': u2.y || line},
           {'c': u2.c + k + 3, 'x': u2.x || 'R', 'y': u2.y || chr(10) || 'assistant:' || text}])
  FROM (
    SELECT f.conv_id, f.p, f.i, f.text, chr(10) || f.role || ':' || f.text AS line, t.e, t.s, CAST(4 AS BIGINT) AS d,
           CAST(CASE f.fault WHEN 't' THEN 3 WHEN '-' THEN 0 ELSE 99999 END AS BIGINT) AS k,
           list_min([t.u] || list_transform([t.e, t.s, t.a], lambda z: {'c': z.c + 3, 'x': z.x || 'I', 'y': z.y || chr(10) || 'user:'})) AS u2,
           list_min([t.a, {'c': t.u.c + 3, 'x': t.u.x || 'I', 'y': t.u.y || chr(10) || 'assistant:'}]
             || list_transform([t.e, t.s], lambda z: {'c': z.c + 6, 'x': z.x || 'II', 'y': z.y || chr(10) || 'user:' || chr(10) || 'assistant:'})) AS a2
    FROM steps t JOIN faulty f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = t.p + 1)),
ends AS (
  SELECT t.conv_id, list_min([t.e, t.a, {'c': t.u.c + 3, 'x': t.u.x || 'I', 'y': t.u.y || chr(10) || 'assistant:'},
                              {'c': t.s.c + 6, 'x': t.s.x || 'II', 'y': t.s.y || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS best
  FROM steps t LEFT JOIN counts c ON t.conv_id IS NOT DISTINCT FROM c.conv_id WHERE t.p = coalesce(c.n, 0))
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.x AS audit, sha256(substr(best.y, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts c ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
""",
)
def op13_repair_conversations(spark, sf_dir):
    """Faults of every conversation after the damage, and its cheapest repair."""
    rows = repair.conversation_rows(table(spark, sf_dir, "conversations"))
    fixed = repair.repair(repair.damage(rows)).withColumnRenamed("conv", "conv_id")
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query(
    "op11_collocations",
    rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
cuts AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, a, i, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
""",
)
def op11_collocations(spark, sf_dir):
    """The best collocations of every language."""
    return collocations.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))
