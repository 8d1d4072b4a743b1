"""Conversation structure repair: the cheapest edits that make roles alternate, by run-length dynamic programming.

A row is a symbol: its role's initial and its fault. A min-plus matrix over the four states of the wanted role order
says what passing one row costs from each state to each other. Equal consecutive symbols are one run, passed by
the cached binary powers of that matrix; the choices inside it are unrolled afterwards for the audit.

A conversation of up to ``LONG_ROWS`` rows is repaired in one pass over rows dealt out by conversation. A longer one
is never gathered: its rows are sorted over all tasks and cut into chunks, each chunk is one matrix, the product of the
matrices gives every chunk its first state and the cost of all that follows, and chunks are then unrolled on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.lookup import lookup_join
from reviewmill.session import cut_lineage, write_stage

LONG_ROWS = 20_000
CHUNK_BITS = 14  # a long conversation is cut into chunks of at most 16,384 rows
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs of edits, and of leaving a truncated row
INF = 1 << 60
SPACES = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: role that an inserted or reroled row takes in each state, and the state it leads to
WANTED = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
#: initials that may be kept: state -> initial -> state
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def _through(m: Matrix, v: Vector) -> Vector:
    a, b, c, d = v
    return tuple([min(w + a, x + b, y + c, z + d, INF) for w, x, y, z in m])


def _inserts() -> Matrix:
    """Cheapest inserts from state to state; more than three are never needed."""
    one = tuple(tuple(0 if i == j else INSERT if j == NEXT[i] else INF for j in range(4)) for i in range(4))
    return _times(one, _times(one, one))


INSERTS = _inserts()
IDENTITY: Matrix = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))
#: what is still to pay at the end: only nothing at all or an assistant row may be last
AT_END: Vector = _through(INSERTS, (0, INF, INF, 0))


@lru_cache(None)
def row_options(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) of one row, edits in ASCII order. A symbol is an initial and a fault, such as ``ut``."""
    initial, fault = symbol
    options = [("D", DELETE, state)]
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        if initial in KEEPS[state]:
            options.append(("K", extra, KEEPS[state][initial]))
        options.append(("R", REROLE + extra, NEXT[state]))
    return tuple(options)


@lru_cache(None)
def power(symbol: str, bit: int) -> Matrix:
    """Cost matrix of 2**bit rows of one symbol, inserts before each of them included."""
    if bit:
        half = power(symbol, bit - 1)
        return _times(half, half)
    row = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, then in row_options(symbol, state):
            row[state][then] = min(row[state][then], cost)
    return _times(INSERTS, tuple(map(tuple, row)))


def before(symbol: str, length: int, after: Vector) -> Vector:
    """Cost of a run and all that follows, per state, from the cost of what follows it."""
    bit = 0
    while length:
        if length & 1:
            after = _through(power(symbol, bit), after)
        length, bit = length >> 1, bit + 1
    return after


def product(runs: list[tuple[str, int]]) -> Matrix:
    """Cost matrix of many runs."""
    columns = [tuple(0 if i == j else INF for i in range(4)) for j in range(4)]
    for symbol, length in reversed(runs):
        columns = [before(symbol, length, c) for c in columns]
    return tuple(zip(*columns))


@lru_cache(1 << 16)
def _one_row(symbol: str, state: int, after: Vector) -> tuple[str, int]:
    """ASCII-least cheapest edits around one row (inserts before it, then its own) and the state they lead to."""
    here, edits = _through(power(symbol, 0), after), ""
    while True:
        delete, *others = row_options(symbol, state)
        if delete[1] + after[state] == here[state]:
            return edits + "D", state
        if INSERT + here[NEXT[state]] == here[state]:
            edits, state = edits + "I", NEXT[state]
            continue
        edit, _, then = next(o for o in others if o[1] + after[o[2]] == here[state])
        return edits + edit, then


def unroll(symbol: str, length: int, state: int, after: Vector, out: list[str]) -> int:
    """Append the edits of each row of a run; returns the state behind it."""
    if length > 16:
        front = length // 2
        state = unroll(symbol, front, state, before(symbol, length - front, after), out)
        return unroll(symbol, length - front, state, after, out)
    lows = [after]
    for _ in range(length - 1):
        lows.append(_through(power(symbol, 0), lows[-1]))
    for low in reversed(lows):
        least = min(low)  # only differences matter, so that few cases recur
        edits, state = _one_row(symbol, state, tuple([min(c - least, INF) for c in low]))
        out.append(edits)
    return state


def run_lengths(symbols: list[str]) -> list[tuple[str, int]]:
    return [(symbol, len(list(same))) for symbol, same in groupby(symbols)]


def choose(symbols: list[str], state: int = START, after: Vector = AT_END) -> tuple[list[str], int, int]:
    """Edits of each row, the state behind the last, and the cost of these rows and all that follows."""
    runs, lows = run_lengths(symbols), [after]
    for symbol, length in reversed(runs):
        lows.append(before(symbol, length, lows[-1]))
    cost, edits = lows[-1][state], []
    for (symbol, length), low in zip(runs, reversed(lows[:-1])):
        state = unroll(symbol, length, state, low, edits)
    return edits, state, cost


def closing(state: int) -> str:
    """Inserts at the very end."""
    return "I" * (AT_END[state] // INSERT)


def apply(edits: str, state: int, role: str, text: str, out: list[str]) -> int:
    """Append the repaired lines that one row's edits leave; returns the state behind it."""
    for edit in edits:
        if edit == "D":
            continue
        if edit == "K":
            out.append(f"{role}:{text}")
            state = KEEPS[state][role[0]]
        else:
            out.append(f"{WANTED[state]}:{text if edit == 'R' else ''}")
            state = NEXT[state]
    return state


def damage(rows: DataFrame) -> DataFrame:
    """Damaged copy of ``conv, turn, role, text``, by crc32(conv:turn) modulo 20; NULL counts as one space.

    0 drops the row (kept here without text, ``alive`` false, so that its conversation stays known), 1 empties the
    text, 2 removes its ``[.!?]``, 3 repeats the row, 4 sets role user.
    """

    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = rows.withColumn("case", F.crc32(F.concat_ws(":", known("conv"), known("turn")).cast("binary")) % 20)
    case = F.col("case")
    text = F.when(case.isin(0, 1), "").when(case == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return rows.select(
        "conv", "turn", (case != 0).alias("alive"),
        F.when(case == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _order() -> list[Column]:
    """By turn; rows of one turn by role, first characters and hash of the text. Equal rows are interchangeable."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]


def _marked(rows: DataFrame) -> DataFrame:
    """Add the role's initial with the faults a row shows by itself: blank, truncated or none."""
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.substring("role", 1, 1)
    return rows.withColumn("mark", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), fault))


RESULT = {
    "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
    "cost": "bigint", "audit": "string", "repaired": "string", "repaired_sha256": "string",
}
LEGAL = {"su", "ua", "au"}
TYPES = [pa.int64()] * 6 + [pa.string()] * 3


def _faults(marks: list[str], keys: list, seen: set) -> list[str]:
    """Symbols: blank first, then duplicate of an earlier row, then truncated."""
    out = []
    for mark, key in zip(marks, keys):
        out.append(mark[0] + "d" if key in seen and mark[1] != "b" else mark)
        seen.add(key)
    return out


def _illegal(marks: list[str]) -> int:
    return sum(a[0] + b[0] not in LEGAL for a, b in zip(marks, marks[1:]))


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _repaired(turns: list, roles: list[str], texts: list[str], marks: list[str], with_text: bool) -> tuple:
    symbols = _faults(marks, list(zip(roles, texts)), set())
    edits, last, cost = choose(symbols)
    lines, state = [], START
    for edit, role, text in zip(edits, roles, texts):
        state = apply(edit, state, role, text, lines)
    apply(closing(last), state, "", "", lines)
    whole, faults = "\n".join(lines), [s[1] for s in symbols]
    return (
        _gaps(turns), faults.count("b"), faults.count("d"), faults.count("t"), _illegal(marks), cost,
        "".join(edits) + closing(last), whole if with_text else None, hashlib.sha256(whole.encode()).hexdigest(),
    )


def _by_conversation(rows: DataFrame, with_text: bool) -> DataFrame:
    """Repair conversations that fit one task, streaming over rows sorted by conversation."""
    dealt = rows.repartition("conv").withColumn("t0", F.substring("text", 1, 64)).withColumn("t1", F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "t0", "t1").drop("t0", "t1")
    names, kind = ("turn", "role", "text", "mark"), rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, conv_type = None, None, None

        def results(done: list) -> pa.RecordBatch:
            convs, values = zip(*done)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*values), TYPES)]
            return pa.RecordBatch.from_arrays([pa.array(convs, conv_type), *columns], ["conv", *RESULT])

        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            data = batch.to_pydict()
            for i, key in enumerate(data["conv"]):
                if held is None or key != conv:
                    if held is not None:
                        done.append((conv, _repaired(*held, with_text)))
                    held, conv = ([], [], [], []), key
                if data["alive"][i]:
                    for column, name in zip(held, names):
                        column.append(data[name][i])
                if len(done) >= 1000:
                    yield results(done)
                    done = []
            if done:
                yield results(done)
        if held is not None:
            yield results([(conv, _repaired(*held, with_text))])

    fields = ", ".join(f"{n} {t}" for n, t in RESULT.items())
    return dealt.mapInArrow(run, f"conv {kind.simpleString()}, {fields}")


def _chunks(rows: DataFrame, summarise, schema: str, other: DataFrame | None = None) -> DataFrame:
    """``summarise(key, chunk, rows, other)`` of every chunk; rows of a chunk come sorted."""

    def tables(name: str, chunk: int, table: pa.Table, more: dict | None) -> pa.Table:
        return pa.Table.from_pylist([{"name": name, "chunk": chunk} | summarise(table.sort_by("pos"), more)], to_arrow(schema))

    if other is None:

        def alone(key, table):
            return tables(key[0].as_py(), key[1].as_py(), table, None)

        return rows.groupBy("name", "chunk").applyInArrow(alone, schema)

    def both(key, table, more):
        if not table.num_rows:
            return to_arrow(schema).empty_table()
        return tables(key[0].as_py(), key[1].as_py(), table, more.to_pylist()[0])

    return rows.groupBy("name", "chunk").cogroup(other.groupBy("name", "chunk")).applyInArrow(both, schema)


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (part.split(" ") for part in ddl.split(", "))])


def _per_name(rows: DataFrame, link, schema: str) -> DataFrame:
    """``link`` over the chunks of one conversation in order: one row for up to 16,384 of its rows."""

    def linked(table):
        return pa.Table.from_pylist(link(table.sort_by("chunk").to_pylist()), to_arrow(schema))

    return rows.groupBy("name").applyInArrow(linked, schema)


def _link_after(chunks: list[dict]) -> list[dict]:
    """What is still to pay behind every chunk, from the last to the first; sums of the counts on the first."""
    after, out = AT_END, []
    for at in range(len(chunks) - 1, -1, -1):
        c = chunks[at]
        out.append({"name": c["name"], "chunk": c["chunk"], "after": list(after)})
        after = _through(tuple(tuple(c["matrix"][4 * i : 4 * i + 4]) for i in range(4)), after)
    sums = {k: sum(c[k] for c in chunks) for k in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(chunks, chunks[1:]))
    out[-1] |= sums | {"cost": after[START]}
    return out


def _link_starts(chunks: list[dict]) -> list[dict]:
    """First state of every chunk, and what is inserted behind it (behind the last one only)."""
    state, out = START, []
    for c in chunks:
        out.append({"name": c["name"], "chunk": c["chunk"], "start": state, "after": c["after"], "closing": ""})
        state = c["ends"][state]
    out[-1]["closing"] = closing(state)
    return out


def _matrix_of(table: pa.Table, _) -> dict:
    symbols = table.column("symbol").to_pylist()
    faults = [s[1] for s in symbols]
    return {
        "matrix": [c for row in product(run_lengths(symbols)) for c in row], "first": symbols[0][0], "last": symbols[-1][0],
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": _illegal(symbols),
    }


def _ends_of(table: pa.Table, more: dict) -> dict:
    symbols, after = table.column("symbol").to_pylist(), tuple(more["after"])
    return {"after": more["after"], "ends": [choose(symbols, state, after)[1] for state in range(4)]}


def _lines_of(table: pa.Table, more: dict) -> dict:
    edits, _, _ = choose(table.column("symbol").to_pylist(), more["start"], tuple(more["after"]))
    lines, state = [], more["start"]
    for edit, role, text in zip(edits, table.column("role").to_pylist(), table.column("text").to_pylist()):
        state = apply(edit, state, role, text, lines)
    apply(more["closing"], state, "", "", lines)
    return {"audit": "".join(edits) + more["closing"], "lines": "\n".join(lines)}


def _digests(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Audit and digest of each conversation from its sorted chunks, read one after the other."""
    schema = to_arrow("name string, audit string, repaired string, repaired_sha256 string")
    name, audit, text, digest, any_line = None, [], [], None, False

    def result():
        row = {"name": name, "audit": "".join(audit), "repaired": "\n".join(text) if with_text else None, "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if name != row["name"]:
                if name is not None:
                    yield result()
                name, audit, text, digest, any_line = row["name"], [], [], hashlib.sha256(), False
            audit.append(row["audit"])
            if row["lines"]:
                digest.update((b"\n" if any_line else b"") + row["lines"].encode())
                any_line = True
                if with_text:
                    text.append(row["lines"])
    if name is not None:
        yield result()


def _by_chunks(rows: DataFrame, with_text: bool) -> DataFrame:
    """Repair conversations of any length: no task ever holds more than a chunk of rows.

    The digest and the audit are single values per conversation, so its chunks (text and edits, one row each) are
    read by one task in order, a batch at a time.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("conv").cast("string")), F.lit("n"))
    named = rows.withColumn("name", name)
    every = named.groupBy("name").agg(F.first("conv").alias("conv"))
    alive = named.filter("alive").withColumn("id", F.monotonically_increasing_id())
    fixed = cut_lineage(alive.orderBy("name", *_order(), "id").drop("id", "conv", "alive").withColumn("pos", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("chunk", F.shiftright("pos", CHUNK_BITS))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    firsts = fixed.groupBy("name", digest.alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    later = F.col("is_first").isNull() & (F.substring("mark", 2, 1) != "b")
    symbol = F.when(later, F.concat(F.substring("mark", 1, 1), F.lit("d"))).otherwise(F.col("mark"))
    symbols = fixed.select("name", "chunk", "pos", "mark").join(firsts, "pos", "left").select("name", "chunk", "pos", symbol.alias("symbol"))
    symbols = write_stage(symbols, "repair-symbols")
    parts = _chunks(
        symbols, _matrix_of,
        "name string, chunk bigint, matrix array<bigint>, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint",
    )
    after = write_stage(
        _per_name(parts, _link_after, "name string, chunk bigint, after array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"),
        "repair-after",
    )
    ends = _chunks(symbols, _ends_of, "name string, chunk bigint, after array<bigint>, ends array<bigint>", after.select("name", "chunk", "after"))
    starts = _per_name(ends, _link_starts, "name string, chunk bigint, start bigint, after array<bigint>, closing string")
    texts = fixed.select("name", "chunk", "pos", "role", "text").join(symbols.select("pos", "symbol"), "pos")
    lines = _chunks(texts, _lines_of, "name string, chunk bigint, audit string, lines string", starts)
    kind = "name string, audit string, repaired string, repaired_sha256 string"
    dealt = lines.repartition("name").sortWithinPartitions("name", "chunk").select("name", "audit", "lines")
    digests = dealt.mapInArrow(lambda batches: _digests(batches, with_text), kind)
    turns = fixed.groupBy("name").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    counts = after.filter(F.col("cost").isNotNull()).drop("chunk", "after")
    whole = every.join(counts, "name", "left").join(turns, "name", "left").join(digests, "name", "left")
    empty = {**{n: 0 for n in RESULT if RESULT[n] == "bigint"}, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    if with_text:
        empty["repaired"] = ""
    return whole.fillna(empty).select("conv", *RESULT)


def repair(rows: DataFrame, with_text: bool = False, long_rows: int = LONG_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``conv, turn, role, text`` (and ``alive``).

    Rows go by turn, NULL first; rows of one turn by role, then by the first 64 characters and the hash of the text. A
    row counts as blank, else as duplicate of an earlier row, else as truncated. NULL role or text is one space. A NULL
    conversation is one of its own. A conversation without living rows has zeros, no audit and the digest of the
    empty string. With ``with_text`` the repaired text is returned too.
    """
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = rows.select("conv", F.col("turn").cast("bigint").alias("turn"), F.col("alive"), known["role"].alias("role"), known["text"].alias("text"))
    lengths = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_rows)
    long = cut_lineage(lengths.select("conv", F.lit(True).alias("is_long")))
    rows = _marked(rows)
    if long.isEmpty():
        return _by_conversation(rows, with_text)
    split = lookup_join(rows, long, {"conv": "conv"})
    is_long = F.coalesce("is_long", F.lit(False))
    short = _by_conversation(split.filter(~is_long).drop("is_long"), with_text)
    return short.unionByName(_by_chunks(split.filter(is_long).drop("is_long"), with_text))


def conversation_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns the operators work on; whatever else a table has cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
