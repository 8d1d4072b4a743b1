"""Language model, URL filter, personal data, secrets and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from reviewmill.llm import catalog, gru, lmscore, privacy, secret_scan, urls

SF = "/root/testdata/sf0.001"


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    masses = rng.random(12) + 0.1
    model = gru.new_model(masses, 3, 4, seed=2)
    for a in model.arrays():
        a += rng.standard_normal(a.shape).astype(np.float32) * 0.3
    texts = [rng.integers(0, 12, n).astype(np.int32) for n in (7, 4, 3)]
    given, targets, fresh, owner = gru.lay_out(texts, 2)
    h = rng.standard_normal((2, 4)).astype(np.float32)

    def loss():
        return gru.gradients(model, h, given, targets, fresh, owner >= 0)[0]

    _, grad, _ = gru.gradients(model, h, given, targets, fresh, owner >= 0)
    for a, g in zip(model.arrays(), grad.arrays()):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-2
            up = loss()
            a[at] = old - 1e-2
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_new_model_is_the_unigram_model_and_scores_do_not_depend_on_lanes():
    masses = np.array([5.0, 3, 8, 1, 0, 0, 2, 1])
    model = gru.new_model(masses, 2, 4)
    texts = [np.array(t, np.int32) for t in ([2, 3, 1], [1], [6, 7, 2, 2, 1], [0, 1])]
    want = [sum(math.log(masses[w] / masses.sum()) for w in t) for t in texts]
    for lanes in (1, 2, 8):
        assert np.allclose(gru.score(model, texts, lanes, window=2), want, atol=1e-4)
    for a in model.arrays():
        a += np.random.default_rng(3).standard_normal(a.shape).astype(np.float32) * 0.2
    assert np.allclose(gru.score(model, texts, 1, window=2), gru.score(model, texts, 4, window=64), atol=1e-4)


def test_model_is_a_distribution():
    model = gru.new_model(np.arange(1.0, 9), 2, 4)
    for a in model.arrays():
        a += np.random.default_rng(3).standard_normal(a.shape).astype(np.float32) * 0.2
    state = np.random.default_rng(4).standard_normal((1, 4)).astype(np.float32)
    assert abs(sum(np.exp(gru.log_probabilities(model, state, np.array([w]))[0]) for w in range(8)) - 1) < 1e-5


def brute_base(rows):
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    floor = math.log10(total + 0.5 * (distinct + 1))
    return {
        i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10(counts[w] + 0.5) - floor for w in ws))
        for i, ws in words.items()
    }


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = lmscore.score_documents(docs, block_chars=100_000).collect()
    assert len(out) == len(want)
    for r in out:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    fresh = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)


def test_lm_odd_rows(make):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "A a\ta", "x"), (3, "A a\ta", "x")]
    out = lmscore.score_documents(make(rows, "doc_id bigint, text string, score string")).collect()
    assert len(out) == 5
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert all(math.isfinite(r["score"]) for r in out)
    assert lmscore.score_documents(make([], "doc_id bigint, text string")).count() == 0
    only_held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = lmscore.score_documents(make([(only_held, "a b")], "doc_id bigint, text string")).first()
    assert (alone["held_out"], alone["n_known"], alone["train_tokens"]) == (True, 0, 0)
    assert math.isfinite(alone["score"])


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, rule_host, rule_path in urls.RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = (rule_host + rule_path, verdict)
    return host, path, best


def brute_ratio(judged):
    """Log-likelihood difference per character, from counts in plain dictionaries."""
    def codes(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        rest = re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), rest))
        return "~~" + re.sub("[^a-z0./-]", "~", rest)

    def model(texts):
        n3 = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
        n_ab, n_bc, n_b, n_c, t_ab, t_b = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
        for g, n in n3.items():
            n_ab[g[:2]] += n
            n_bc[g[1:]] += n
            n_b[g[1]] += n
            n_c[g[2]] += n
            t_ab[g[:2]] += 1
        for bc in n_bc:
            t_b[bc[0]] += 1
        total = sum(n3.values())

        def p(g):
            p0 = (n_c[g[2]] + 1) / (total + urls.SIZE)
            p1 = (n_bc[g[1:]] + t_b[g[1]] * p0) / (n_b[g[1]] + t_b[g[1]]) if n_b[g[1]] else p0
            return (n3[g] + t_ab[g[:2]] * p1) / (n_ab[g[:2]] + t_ab[g[:2]]) if n_ab[g[:2]] else p1

        return p

    yes, no = (model([codes(u) for u, v in judged if v == w]) for w in ("allow", "block"))

    def score(url):
        t = codes(url)
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        return sum(math.log(yes(g)) - math.log(no(g)) for g in grams) / len(grams) if grams else None

    return score


def test_url_filter_equals_brute_force(spark):
    rows = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    out = {r["page_id"]: r for r in catalog.QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == len(rows)
    ruled = {i: brute_rule(u) for i, u in rows}
    score = brute_ratio([(u, ruled[i][2][1]) for i, u in rows if ruled[i][2]])
    for i, url in rows:
        host, path, best = ruled[i]
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, best[0] if best else None)
        assert abs(out[i]["score"] - score(url)) < 1e-9
        if best:
            assert out[i]["verdict"] == best[1]
    free = [out[i] for i in ruled if not ruled[i][2]]
    assert min((r["score"] for r in free if r["verdict"] == "allow"), default=9) >= max((r["score"] for r in free if r["verdict"] == "block"), default=-9)


def test_url_odd_rows(make):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.ORG/es/x?y#z"), (6, "http://org"), (7, "x://org/en"),
        (8, "http://notorg/x"), (9, "http://example.org/en/12"), (9, "http://example.org/en/12"), (10, "http://b.com/fr/" + "a1" * 20_000), (11, "http://b.com/de/é\n?q"),
        (12, "http://q.net?x://org/"),
    ]
    out = urls.filter_urls(make([(*r, "h") for r in rows], "page_id bigint, url string, host string")).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for i, url in rows:
        host, path, best = brute_rule(url)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, best[0] if best else None)
    assert all(by[i]["verdict"] == "block" for i in (1, 2, 3, 4))
    assert urls.filter_urls(make([], "page_id bigint, url string")).count() == 0


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(digits)) % 10 == 0


def brute_base_spans(text):
    count = lambda v: sum(c in "0123456789" for c in v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= count(v) <= 19 and luhn(v)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= count(v) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, pattern, holds in kinds for m in re.finditer(pattern, text or "") if holds(m.group())]


def private_rows():
    rng = random.Random(8)
    parts = [
        "a.b@c.de", "a@b.c_x@d.e", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111",
        "4111 1111 1111 1112", "41111111111111111111111", "+1 (202) 555-0143", "+49", "+1 2", "+12345678", "12 34", " ", "é", "😀", "\n", "..", "word", "-", "5",
        "378282246310005", "+378282246310005",
    ]
    return [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))) for i in range(300)]


def test_private_base_spans_equal_brute_force(make):
    rows = private_rows() + [(900, None), (901, ""), (902, "1 " * 30_000 + "a" * 50_000 + "1" * 50_000 + "+" + " " * 50_000), (None, "q@r.st"), (5, "q@r.st"), (5, "q@r.st")]
    out = privacy.find_private(make([(*r, "s") for r in rows], "doc_id bigint, text string, spans string")).collect()
    assert len(out) == len(rows)
    got = sorted(str((r["doc_id"], [tuple(s) for s in r["spans"] if s["kind"] != "term"])) for r in out)
    assert got == sorted(str((i, brute_base_spans(t))) for i, t in rows)
    assert privacy.find_private(make([], "doc_id bigint, text string")).count() == 0


def test_private_query(spark):
    out = {r["doc_id"]: r for r in catalog.QUERIES["op7_pii"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = brute_base_spans(r["text"])
        got = out[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [got[f"n_{k}"] for k in privacy.PATTERNS] == [sum(s[0] == k for s in spans) for k in privacy.PATTERNS]
        assert got["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def test_disclosing_terms(make):
    rows = [(i, f"call surgeon Zebedee {i} at zed@home.example today") for i in range(3)]
    rows += [(10 + i, f"the call of today at {i} home") for i in range(40)]
    rows += [(60, "Zebedee alone is not near any address")]
    out = {r["doc_id"]: r["spans"] for r in privacy.find_private(make(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    terms = {texts[0][s["start"] : s["stop"]] for s in out[0] if s["kind"] == "term"}
    assert "Zebedee" in terms and "surgeon" in terms and "today" not in terms and "call" not in terms
    assert not out[60] and not out[10]
    safe = make([(texts[0], [tuple(s) for s in out[0]])], "text string, spans array<struct<kind:string,start:int,stop:int>>")
    shown = safe.select(privacy.sanitise(safe["text"], safe["spans"]).alias("s")).first()["s"]
    assert "zed@" not in shown and "Zebedee" not in shown and "[email]" in shown and shown.endswith("today")


def test_terms_of_entities_that_occur_once(make):
    rows = [(i, f"Quixley wrote from u{i}@host{i}.example today") for i in range(18)]
    rows += [(20 + i, f"the oncologist Vellamo at p{i}@clinic.example today") for i in range(2)]
    rows += [(30, "Vellamo at home today")] + [(40 + i, f"the home {i} wrote from today") for i in range(39)]
    out = {r["doc_id"]: r["spans"] for r in privacy.find_private(make(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)

    def terms(i):
        return {texts[i][s["start"] : s["stop"]] for s in out[i] if s["kind"] == "term"}

    assert all(terms(i) == {"Quixley"} for i in range(18))  # by their kind: no address and no host occurs twice
    assert terms(20) == terms(21) == {"oncologist", "Vellamo"}  # the name by their host, as one of three texts with it has no address
    assert not out[30] and not out[40]


def test_secrets(make):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(i, f'some words token = "{hexes(40)}" and more') for i in range(60)]
    rows += [(100 + i, f"verylongcompoundword{'abcdefgh' * rng.randint(1, 4)} of the text") for i in range(60)]
    rows += [(200 + i, f"commit {hexes(40)} of the license") for i in range(40)]
    rows += [(300, None), (301, ""), (None, f'secret: "{hexes(32)}"'), (1, f'password="{hexes(32)}"'), (1, f'password="{hexes(32)}"')]
    df = make([(*r, 5) for r in rows], "doc_id bigint, text string, start int")
    out = secret_scan.find_secrets(df).collect()
    judged = [(r["secret"], r["doc_id"] is None or r["doc_id"] < 100) for r in out]
    assert len(judged) == 163
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    text = rows[0][1]
    assert any(text[r["start"] : r["stop"]] == r["value"] for r in out if r["doc_id"] == 0)
    assert secret_scan.find_secrets(make([], "doc_id bigint, text string")).count() == 0
    by_hand = make([(r["value"], 0) for r in out[:20]] + [(r["value"], 1) for r in out[-20:]], "value string, label int")
    assert secret_scan.find_secrets(df, labels=by_hand).count() == 163


def test_secret_query_finds_assigned_tokens(spark):
    out = catalog.QUERIES["op8_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    found = {(r["doc_id"], r["value"]) for r in out if r["secret"]}
    planted = {
        (r["doc_id"], v) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() for v in re.findall(r'token = "([0-9a-f]{40})"', r["text"])
    }
    assert planted and planted <= found


def test_pipeline(spark):
    import corpus_pipeline

    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    rules = {r["doc_id"] for r in catalog.QUERIES["op2_quality_rules"](spark, SF).filter("kept").collect()}
    assert kept and set(kept) <= rules
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = docs
    for name, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, SF)
        assert stage.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_pipeline_stages_on_odd_rows(spark, make):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, None, None), (2, "a b", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, run in corpus_pipeline.STAGES:
            assert run(spark, docs, SF).count() <= len(rows)


def test_pipeline_drops_what_line_dedup_empties(spark, make):
    import corpus_pipeline

    text = "one line of words that stands in both of the documents here\nand a second line of them that also stands in both"
    more = f"{text}\nbut this line stands in one of them only"
    rows = [(1, text, 999), (2, text.upper(), 999), (3, more, 999), (4, "", 0), (5, None, 7)]
    out = corpus_pipeline.line_dedup(spark, make(rows, "doc_id bigint, text string, n_chars bigint"), "").collect()
    rest = more.split("\n")[2]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out) == [(1, text, len(text)), (3, rest, len(rest)), (4, "", 0), (5, None, 7)]


def test_secrets_of_few_distinct_findings(make):
    """Two kinds of findings, far more copies than the sample has rows; the default label would be wrong."""
    secrets, harmless = ["abcdefghijklmnopqrstuvwxyzabcdef", "zyxwvutsrqponmlkjihgfedcbazyxwvu"], ["a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6", "f1e2d3c4b5a6f7e8d9c0b1a2f3e4d5c6"]
    rows = [(i, f"see {v} here") for i, v in enumerate((secrets + harmless) * 1000)]
    labels = make([(v, 1) for v in secrets] + [(v, 0) for v in harmless], "value string, label int")
    out = secret_scan.find_secrets(make(rows, "doc_id bigint, text string"), labels=labels, train_rows=4).collect()
    assert len(out) == len(rows) and all(r["secret"] == (r["value"] in secrets) for r in out)


def test_tokens_of_a_block_are_counted_piece_by_piece(monkeypatch):
    texts_ = ["a b a", None, "", "B c", "a a d"]
    held = [False, False, True, True, False]
    table = pa.table({"block": pa.array([3] * 5, pa.int32()), "held_out": pa.array(held), "text": pa.array(texts_, pa.string())})
    whole = lmscore._count(table).to_pydict()
    most = []
    monkeypatch.setattr(lmscore, "TOKENS_AT_ONCE", 4)
    real = np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda parts, *a, **k: most.append(1) or real(parts, *a, **k))
    assert lmscore._count(table).to_pydict() == whole and len(most) > 4
    assert sum(whole["n"]) == 4 + 1 + 4 and set(whole["block"]) == {3}
