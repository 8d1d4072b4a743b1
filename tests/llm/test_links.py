"""Near-duplicates, line groups and components against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import catalog, lines, linking, minhash


def groups_of(pairs, nodes):
    low = {n: n for n in nodes}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_equal_union_find(make):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (1000, 1001)]
    out = {r["v"]: r["label"] for r in linking.components(make(edges, "a bigint, b bigint")).collect()}
    want = groups_of(edges, {x for e in edges for x in e})
    assert out == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert linking.components(make([], "a bigint, b bigint")).count() == 0


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rows += ["same text here"] * 40 + ["Same  TEXT here", "", None, "   ", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(make):
    rows = near_copies()
    sets = {i: plain_set(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = groups_of(links, sets)
    out = minhash.near_duplicates(make(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets
    }


def test_a_pair_at_the_threshold_is_nearly_never_missed():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
        x, y = (minhash.signature(np.unique(np.concatenate([common, own]))) for own in (a, b))
        missed += not (minhash.band_keys(x) == minhash.band_keys(y)).any()
    assert missed == 0


def test_near_duplicates_odd_rows(make):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (1, None, 3), (2, "a b c d e f", 4), (3, "A B C d e f", 5), (3, "other words", 6), (2, "a b c d e f", 4)]
    df = make(rows, "doc_id bigint, text string, kept int")
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert out == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (3, 3, True)]
    assert minhash.drop_near_duplicates(df).columns == df.columns
    assert minhash.near_duplicates(make([], "doc_id bigint, text string")).count() == 0


def test_rare_members_bring_every_similar_pair_together(make):
    """All pairs at 75 % are matched; sets that share a passage and differ otherwise are hardly compared."""
    rng = random.Random(31)
    passage = [rng.getrandbits(62) for _ in range(60)]
    sets = [set(passage) | {rng.getrandbits(62) for _ in range(rng.randint(11, 40))} for _ in range(80)]
    for _ in range(60):
        base = [rng.getrandbits(62) for _ in range(rng.randint(1, 60))]
        for _ in range(3):
            sets.append({x for x in base if rng.random() > 0.12} | {rng.getrandbits(62) for _ in range(rng.randint(0, len(base) // 8))} or {1})
    similar = {
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    features = make([(i, 0, len(s), x) for i, s in enumerate(sets) for x in s], "id bigint, set bigint, size bigint, feature bigint")
    rest = make([(k, i, i, [0]) for i in range(len(sets)) for k in (1, 2)], "key bigint, id bigint, label bigint, sketch array<bigint>")
    found = {(r["a"], r["b"]) for r in linking.rare_matches(rest, features, 75, lambda a, b: a == b).collect()}
    assert len(similar) > 60 and similar <= found
    assert not any(j < 80 for _, j in found)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_edit_distance_equals_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        a = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        b = "".join(b)
        want = plain_distance(a, b)
        for most in (0, 1, 2, 4, 20):
            assert lines.edit_distance(a, b, most) == min(want, most + 1)


def test_edit_distance_of_long_lines():
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefgh ", k=20_000))
    for edits in (0, 3, 40, 90):
        b = list(base)
        for _ in range(edits):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b)
        assert lines.edit_distance(base, b, 2000) == sum(x != y for x, y in zip(base, b))
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(2))
        want = plain_distance(a, b)
        assert lines._by_diagonals(a, b, 30) == want == lines._by_columns(a, b, 30)


def test_lines_keep_one_occurrence_per_group(make):
    base = "the quick brown fox jumps over the lazy dog near number 17 today"
    other = " ".join(f"word{chr(97 + i)}" for i in range(26))
    rows = [
        (3, f"{base}\nunique line of text that nobody else has written down\n{base.upper()}!"),
        (1, f"short one\n{other}\nshort one"),
        (2, f"{base.replace('17', '99')}\n\n{other}."),
        (4, None), (5, ""), (None, base), (2, f"{base.replace('17', '99')}\n\n{other}."),
    ]
    df = make([(i, t, "x") for i, t in rows], "doc_id bigint, text string, places string")
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [f"short one\n{other}\nshort one"]
    assert got[2] == [f"{base.replace('17', '99')}\n"] * 2
    assert got[3] == ["unique line of text that nobody else has written down"]
    assert got[None] == [""] and got[4] == [None] and got[5] == [""]
    assert lines.drop_repeated_lines(make([], "doc_id bigint, text string")).count() == 0


def test_lines_link_small_edits(make):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    rows = []
    for i in range(40):
        line = " ".join(rng.choices(words, k=60))
        rows += [(2 * i, line), (2 * i + 1, line)]
    out = lines.repeated_lines(make(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [2 * i + 1 for i in range(40)]
    assert all(r["places"] == [0] for r in out)


def test_simhashes_do_not_depend_on_the_batch(spark):
    """A line's print is the same alone and among others. Groups are held against all pairs of the data further below."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted({lines.normal_line(line.encode()) for r in docs.collect() for line in (r["text"] or "").split("\n")} - {""})
    texts = [t for t in texts if len(t.split()) >= lines.MIN_WORDS]
    hashes = [lines.word_hashes(t.encode().split()) for t in texts]
    halves = lines.simhashes(np.concatenate(hashes), np.array([len(h) for h in hashes]))
    assert len(texts) > 100
    for i in range(0, len(texts), 7):
        assert (lines.simhashes(hashes[i], np.array([len(hashes[i])]))[0] == halves[i]).all()


def test_lines_with_a_changed_word_are_found(make):
    """Recall against edit similarity over all pairs: lines of 10 to 64 words, one word replaced."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for size in (10, 14, 20, 32, 64):
        for _ in range(40):
            line = rng.choices(words, k=size)
            other = list(line)
            other[rng.randrange(size)] = rng.choice(words)
            texts += [" ".join(line), " ".join(other)]
    pairs = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if lines.alike(texts[i], texts[j])}
    assert len(pairs) > 180
    out = lines.repeated_lines(make(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len({r["doc_id"] for r in out} & {j for _, j in pairs}) >= 0.99 * len(pairs)
    assert {r["doc_id"] for r in out} <= {j for _, j in pairs}


def test_edited_lines_of_the_data_are_found(spark):
    """All pairs of sf0.001 at the edit similarity, found by brute force, against the groups of the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {}
    for r in docs.collect():
        for place, line in enumerate((r["text"] or "").split("\n")):
            plain = lines.normal_line(line.encode())
            if len(plain.split()) >= lines.MIN_WORDS:
                seen.setdefault(plain, []).append((r["doc_id"], place))
    texts = sorted(seen, key=len)
    sizes = np.array([len(t) for t in texts])
    counts = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) for t in texts])
    pairs = []
    for i in range(len(texts)):
        last = np.searchsorted(sizes, sizes[i] / lines.EDIT_SIMILARITY + 1, "right")
        apart = np.abs(counts[i + 1 : last] - counts[i]).sum(axis=1)  # an edit moves two characters of two bytes each at most
        pairs += [(i, j) for j in i + 1 + np.flatnonzero(apart <= 4 * (0.1 * sizes[i + 1 : last] + 1)) if lines.alike(texts[i], texts[j])]
    assert len(pairs) > 30
    label = groups_of(pairs, range(len(texts)))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(label[i], []).extend(seen[t])
    want = {spot for spots in groups.values() for spot in sorted(spots)[1:]}
    got = {(r["doc_id"], p) for r in lines.repeated_lines(docs).collect() for p in r["places"]}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_short_lines_that_repeat_go(make):
    licences = ["All rights reserved.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, f"text number {chr(97 + i) * 5} of its own kind\n{line}\nand so") for i, line in enumerate(licences * 2)]
    out = {r["doc_id"]: r["places"] for r in lines.repeated_lines(make(rows, "doc_id bigint, text string")).collect()}
    assert out == {3: [1], 4: [1], 5: [1]}  # "and so" is too short to tell from chance


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_shuffles_of_a_step_are_gone_when_the_next_one_deals_rows(spark):
    rows = [(i, i // 2) for i in range(40)]
    keys = spark.createDataFrame(rows, "id bigint, key bigint")
    before = _shuffle_files(spark)
    left = []

    def verifier(wanted):
        def verify(pairs):
            for _ in range(100):
                if len(new := _shuffle_files(spark) - before) <= 1:  # that of the pairs' count, the last job
                    break
                time.sleep(0.1)
            left.append(len(new))
            return pairs

        return wanted.withColumn("sketch", F.lit(0)), verify

    found = linking.linked_components(keys, lambda a, b: a == b, verifier)
    assert sorted(map(tuple, found.collect())) == [(i, i - 1) for i in range(1, 40, 2)]
    assert left and max(left) <= 1


def test_lines_with_few_common_runs_are_not_compared_by_edits(monkeypatch):
    rng = random.Random(5)
    letters = "abcdefghij éß漢"
    lines_of = []
    for size in (39, 40, 41, 90, 400):
        base = "".join(rng.choice(letters) for _ in range(size))
        for edits in (0, 1, size // 12, size // 10, size // 10 + 1, size // 4, size // 2):
            other = list(base)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[], ["x"], ["y", other[at]]])
            lines_of.append((base, "".join(other)))
    for a, b in lines_of:
        longer = max(len(a), len(b))
        most = int((1 - lines.EDIT_SIMILARITY) * longer + 1e-9)
        assert lines.alike(a, b) == (lines.edit_distance(a, b, most) <= most)
    assert {lines.alike(a, b) for a, b in lines_of} == {True, False}
    monkeypatch.setattr(lines, "edit_distance", lambda *_: pytest.fail("compared"))
    assert not lines.alike("abcdefghij " * 40, "klmnopqrst " * 40)


def test_keys_of_distinct_words_are_those_of_all_words():
    words = [b"one", b"two", b"one", b"three", b"two", b"two"] * 90
    sizes = np.array([3, 300, 237])
    known, which = lines._distinct(words)
    assert [known[i] for i in which] == words
    every = lines.word_hashes(words)
    prints = lines.simhashes(every, sizes)
    for at, size in zip(np.cumsum(sizes) - sizes, sizes):
        counts = np.zeros(128, int)
        part = [int(h) for h in every[at : at + size]]
        pairs = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(part, part[1:])]
        for h in part + pairs:
            both = np.array([h, h ^ 0x5851F42D4C957F2D], np.uint64)
            counts += np.unpackbits(lines._spread(both).astype(">u8").view(np.uint8))
        want = np.packbits(2 * counts > 2 * size - 1).view(">u8").astype(np.uint64)
        assert (prints[list(np.cumsum(sizes) - sizes).index(at)] == want).all()
    lengths = np.array([len(w) for w in known])
    few = lines.candidate_keys(lines.word_hashes(known), lengths, which, sizes, prints)
    all_ = lines.candidate_keys(every, np.array([len(w) for w in words]), np.arange(len(words)), sizes, prints)
    assert all((a == b).all() for a, b in zip(few, all_))


def test_many_pairs_are_verified_in_parts_and_none_is_lost(spark):
    rows = [(i, 7) for i in range(30)]
    keys = spark.createDataFrame(rows, "id bigint, key bigint")
    sizes, seen = [], []

    def verifier(wanted):
        def verify(pairs):
            found = [tuple(r) for r in pairs.collect()]
            sizes.append(len(found))
            seen.extend(found)
            return pairs.filter("a % 10 = b % 10")

        return wanted.withColumn("sketch", F.lit(0)), verify

    labels = linking.linked_components(keys, lambda a, b: F.lit(True), verifier)
    assert sorted(map(tuple, labels.collect())) == [(i, i % 10) for i in range(10, 30)]
    assert max(sizes) <= 30 * (linking.PAIRS_PER_ROW + 1) and sum(sizes) > 300
    joined = groups_of([(a, b) for a, b in seen if a % 10 == b % 10], range(30))
    assert {(i, j) for i in range(30) for j in range(i) if joined[i] != joined[j]} <= {(max(p), min(p)) for p in seen}
