"""Mixing, conversation repair and phrase mining against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest

from reviewmill.llm import collocations, mixing, repair

# ---- mixing ----


def fair_targets(sizes):
    """Targets in exact arithmetic: full sources drop out until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_ = Fraction(3 * sum(sizes.values()), 2), set(names)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mixing_meets_its_targets(make):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 12 + ["b", "ä", "c", None, "z", ""])
        n = 4000 if rng.random() < 0.004 else rng.randint(0, 60)
        rows.append((i, source, None if n == 7 else " ".join(["w"] * n), "x"))
    rows += [(1, "b", "w w w", "x")] * 20
    docs = make(rows, "doc_id bigint, source string, text string, size string").repartition(7)
    out = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["copies"]))
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes = Counter()
    for _, source, text, _ in rows:
        sizes[source] += len((text or "").split())
    wanted = fair_targets(sizes)
    taken = Counter()
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(wanted[r["source"]]), rel=1e-12)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for source in sizes:
        largest = max(len((t or "").split()) for _, s, t, _ in rows if s == source)
        assert abs(taken[source] - wanted[source]) <= 2 * largest
    expected = sum(wanted.values())
    assert abs(sum(taken.values()) - expected) < 0.1 * float(expected)
    emitted = mixing.repeat_rows(mixing.mix_sources(docs))
    assert emitted.count() == sum(r["copies"] for r in out)


def test_mixing_of_odd_tables(make):
    schema = "doc_id bigint, source string, text string, rank int, in_0 string, copies string, target string"
    assert mixing.mix_sources(make([], schema)).collect() == []
    out = mixing.mix_sources(make([(None, None, None, 1, "q", "r", "s"), (1, None, "", 2, "q", None, "t")], schema)).collect()
    assert [(r["size"], r["target"], r["copies"], r["in_0"]) for r in out] == [(0, 0.0, 0, "q")] * 2
    one = mixing.mix_sources(make([(1, "a", "word " * 300_000, 1, "q", "r", "s")], schema)).head()
    assert (one["size"], one["target"], one["rank"]) == (300_000, 450_000.0, 1) and one["copies"] in (1, 2)
    levels = mixing.source_targets(make([("a", 10), ("b", 1000), ("c", 100000)], "source string, source_size bigint")).collect()
    assert {r["source"]: r["target"] for r in levels} == {k: float(v) for k, v in fair_targets({"a": 10, "b": 1000, "c": 100000}).items()}


def test_prefix_sums_run_across_tasks(make):
    """Copies are those of one prefix sum per source, however rows are split."""
    rows = [(r, i, 3 * (1 << 50) + r, (r * 77) << 40) for r in range(3) for i in range(40 if r != 1 else 400)]
    one = 1 << mixing.ONE
    want = {(r, i): (off + (k + 1) * e) // one - (off + k * e) // one for r in range(3) for k, (_, i, e, off) in enumerate(x for x in rows if x[0] == r)}
    df = make(rows, "rank bigint, i bigint, expected bigint, offset bigint")
    got = mixing.systematic_copies(df.repartition(9), ["i"])
    assert {(r["rank"], r["i"]): r["copies"] for r in got.collect()} == want


# ---- conversations ----


def cheapest(rows):
    """(cost, edits, lines) by trying all edits in order of cost, then of the audit: rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        seen.add((at, last))
        wanted = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        heapq.heappush(heap, (cost + 3, audit + "I", at, wanted[0], (*lines, wanted + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, lines))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                initial = role[:1]
                if initial == wanted[0] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, wanted[0], (*lines, f"{wanted}:{text}")))


SPACE = " \t\n\x0b\x0c\r"


def plain_repair(rows, damaged=True):
    """All columns of the query for rows of one conversation: (conv, turn, role, text)."""
    alive = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20 if damaged else 19
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        if case == 4:
            role = "user"
        alive += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    alive.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in alive:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = {t for t, _, _ in alive if t is not None}
    initials = [r[:1] for _, r, _ in alive]
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(alive, faults)])
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def odd_conversations(rng, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice([f"Text {rng.randint(0, 9)}.", "Same.", "open end", "ends!  \n", "", " \t", None, "why? no", "?", "é."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conv(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_repair_equals_brute_force(make):
    rows = odd_conversations(random.Random(3), [*range(150), None], 9)
    df = make([(*r, "extra") for r in rows], "conv bigint, turn bigint, role string, text string, mark string")
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damage(df)).collect()}
    assert got == {c: plain_repair(g) for c, g in by_conv(rows).items()}


def test_long_conversations_go_by_chunks(make, monkeypatch):
    """The same results when conversations are cut into chunks of four rows over many tasks."""
    monkeypatch.setattr(repair, "CHUNK_BITS", 2)
    rows = odd_conversations(random.Random(5), [*range(6), None], 60) + [(9, None, "user", "Same.")] * 40
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}: ".encode()) % 20 == 0)
    rows += [(dropped, None, "user", "x.")] * 30
    df = repair.damage(make(rows, "conv bigint, turn bigint, role string, text string"))
    got = repair.repair(df, with_text=True, long_rows=20).collect()
    assert {r["conv"]: tuple(r[c] for c in COLUMNS) for r in got} == {c: plain_repair(g) for c, g in by_conv(rows).items()}
    assert all(hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"] for r in got)
    short = {r["conv"]: r["repaired"] for r in repair.repair(df, with_text=True).collect()}
    assert short == {r["conv"]: r["repaired"] for r in got}


def test_runs_are_passed_by_powers():
    rng = random.Random(8)
    for _ in range(200):
        symbols = [s for _ in range(rng.randint(0, 5)) for s in [rng.choice("suao") + rng.choice("-tbd")] * rng.choice([1, 2, 3, 40])]
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "x"}[s[0]], f"{i}", s[1]) for i, s in enumerate(symbols)]
        edits, last, cost = repair.choose(symbols)
        want = cheapest(rows)
        assert (cost, "".join(edits) + repair.closing(last)) == want[:2]
        product = repair._through(repair.product(repair.run_lengths(symbols)), repair.AT_END)
        assert product[repair.START] == cost


def test_repair_of_odd_tables(make):
    schema = "conv_id string, turn int, role string, text string, alive string, name string"
    assert repair.repair(repair.damage(repair.conversation_rows(make([], schema)))).collect() == []
    many = [("c", i, "user" if i % 2 else "assistant", "word " * 50_000 + f"{i}.", "a", "b") for i in range(12)]
    rows = repair.conversation_rows(make(many + many[:3], schema))
    out = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(rows).collect()}
    assert out == {"c": plain_repair([r[:4] for r in many + many[:3]], damaged=False)}


# ---- phrases ----


def pieces_of(text):
    for c in ",;:!?\n\x0b\x0c\r":
        text = text.replace(c, ".")
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in lowered.split(".")]


def plain_phrases(rows, least, top=2000):
    out, langs = [], {}
    for lang, text in rows:
        langs.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in langs.items():
        f = Counter()
        for text in texts:
            for words in pieces_of(text):
                f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def chatter(rng, rows):
    words = ["The", "a", "of", "é", "rare", "New", "York", "city", "to", "be", "or", "not", "x y", "ß"]
    weights = [30, 20, 15, 3, 1, 5, 5, 4, 8, 8, 6, 6, 2, 2]
    out = []
    for _ in range(rows):
        text = []
        while rng.random() < 0.96:
            text += rng.choice([["New", "York", "city"], ["to", "be", "or", "not", "to", "be"], rng.choices(words, weights, k=3)])
            text += [rng.choice(["", "", "", ".", ",", "\n", "\t", "\x0b", "!?"])]
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), " ".join(text)))
    return out


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_phrases_equal_brute_force(make):
    rows = chatter(random.Random(6), 120) + [("en", None), ("fr", ""), (None, "..."), ("long", "again and again " * 30_000)]
    df = make([(l, t, "n", 1) for l, t in rows], "lang string, text string, phrase string, slot int").repartition(5)
    assert phrase_rows(collocations.mine_phrases(df, least=4)) == plain_phrases(rows, 4)
    assert phrase_rows(collocations.mine_phrases(df, least=4, top=3)) == plain_phrases(rows, 4, 3)
    assert collocations.mine_phrases(df.limit(0)).collect() == []


class Sent:
    def __init__(self, value):
        self.value = value


def test_stripes_survive_flushes_and_splits(monkeypatch):
    """Tasks that hand on what they counted again and again, with split stripes, still add up."""
    monkeypatch.setattr(collocations, "WORDS_HELD", 12)
    monkeypatch.setattr(collocations, "ENTRIES_HELD", 20)
    monkeypatch.setattr(collocations, "BYTES_AT_ONCE", 300)
    rows = [("en", t) for _, t in chatter(random.Random(7), 60)]
    batches = [pa.RecordBatch.from_pydict({"lang": [l for l, _ in rows], "text": [t.encode() for _, t in rows]})]
    everything = Sent(~collocations.np.zeros(1 << (collocations.FILTER_BITS - 6), collocations.np.uint64))
    hot = Sent({("en", "the"): 5, ("en", "to"): 3, ("en", "be"): 2})
    f = Counter()
    for _, text in rows:
        for words in pieces_of(text):
            f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    counted = Counter()
    for b in collocations.count_words(iter(batches)):
        for r in b.to_pylist():
            counted[(r["phrase"],)] += r["n"]
    assert counted == Counter({p: n for p, n in f.items() if len(p) == 1})
    parts = [r for size in (1, 2, 3) for b in collocations.count_stripes(size, everything, hot, 40)(iter(batches)) for r in b.to_pylist()]
    parts.sort(key=lambda r: (r["lang"], r["bundle"]))
    assert len({r["bundle"] for r in parts if "the" in r["prefixes"].split("\n")}) > 2 and len(parts) > 500
    table = pa.RecordBatch.from_pylist(parts)
    merged = [r for b in collocations.merge_stripes(1)(table.slice(i, 50) for i in range(0, len(parts), 50)) for r in b.to_pylist()]
    entries = {tuple([*r["prefix"].split(" "), r["word"]]): r["n"] for r in merged if r["word"] is not None}
    assert entries == {p: n for p, n in f.items() if len(p) > 1}
    totals = Counter()
    for r in merged:
        if r["word"] is None:
            totals[tuple(r["prefix"].split(" "))] += r["n"]
    assert all(n <= f[p] for p, n in totals.items()) and {p for p in f if len(p) < 4} >= set(totals) >= {p[:-1] for p in f if len(p) > 1}
    one = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(t for _, t in rows).encode()]})]
    whole = Counter()
    for _, words in [(0, w) for w in pieces_of(" ".join(t for _, t in rows))]:
        whole.update(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cut = Counter()
    for b in collocations.count_stripes(2, everything, Sent({}), 7)(iter(one)):
        for r in b.to_pylist():
            sizes = collocations.np.frombuffer(r["sizes"], "<u4").tolist()
            prefixes = [p for p, size in zip(r["prefixes"].split("\n"), sizes) for _ in range(size)]
            for prefix, word, n in zip(prefixes, r["following"].split(" "), collocations.np.frombuffer(r["counts"], "<u4").tolist(), strict=True):
                cut[(*prefix.split(" "), word)] += n if word else 0
    assert {p: n for p, n in cut.items() if n} == dict(whole)


def test_word_counts_are_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(collocations, "WORDS_HELD", 500)
    monkeypatch.setattr(collocations, "ENTRIES_AT_ONCE", 64)
    texts_ = [" ".join(f"w{i * 7 % 900 + j}" for j in range(60)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 300), pa.array([t.encode() for t in texts_], pa.binary())], names=["lang", "text"])
    found = list(collocations.count_words(iter([batch])))
    assert max(b.num_rows for b in found) <= 64
    counts = Counter()
    for b in found:
        for word, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist()):
            counts[word] += n
    assert counts == Counter(w for t in texts_ for w in t.split())
