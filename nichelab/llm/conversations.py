"""Conversation structure repair by rank-convergence parallel Viterbi.

The rows of a conversation, by turn, are repaired into ``(s?(ua)+)?`` (role
initials) with the cheapest edits: keep a row, change its role to user or
assistant, delete it, or insert an empty one.  A state says what came last:
nothing yet, s, u or a.  The cost of repairing the rest of a conversation from
each state is a vector of four; a row maps the vector after it to the vector
before it by minima of sums, which only depend on the vector up to a constant.
Such vectors form a small set, so a step is a table look-up once seen.

A conversation is cut into chunks of at most ``CHUNK_ROWS`` rows, and a chunk needs
the vector behind it, which a later chunk yields.  All chunks run at once:

* Speculation: each chunk runs back from ``SPECULATIVE`` vectors, one a state.
  Costs of true vectors differ by ``SPREAD`` at most, so every true vector is a
  combination of them, and so is its result.  When the four results differ only by
  constants, what follows the chunk does not matter any more: the ranks have
  converged.
* Fix-up passes: chunks that have not converged run again, each from the vectors
  of the stretch behind it instead of the speculative ones, until the results
  differ only by constants.  A pass doubles the stretch, and the last chunk of a
  conversation has a single vector, so log2(chunks) passes are the most there
  can be, also where nothing converges (rows that must all be deleted).
* Tracing: with the stitched vector behind it, each chunk follows, from every state
  it may begin in, the ASCII-least edit among the cheapest (D < I < K < R).
  Traces from different states mostly run together; where they do not, the same
  passes from the front settle in which state each chunk begins.

Scale: one range exchange on (conversation, turn), so that a conversation of any
length is spread over tasks.  A conversation that one chunk holds is finished in
that pass; only those at the edge of a partition, or longer than a chunk, go
through the passes, with one row a chunk.  The digest of a repaired conversation is
sequential by nature: its chunks' repaired bytes stream through one task, in
constant memory.

Edge cases: null role and text are one space, and so are null conv_id and turn in
the damage draw; a null conv_id is a conversation of its own; null turns go first;
rows that share a turn go by a hash of role and text; equal rows are duplicates;
a role that is empty has no initial and is illegal next to any other; very long
texts make chunks shorter (``CHUNK_CHARS``); an empty table gives an empty result;
columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.common import stage, table

CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 22
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that must follow (and may be inserted), as a state; s only at the start.
FOLLOWS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
INITIALS = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Cost and edits that end a conversation from each state.
FINAL, ENDING = (0, 10, 5, 0), ("", "II", "I", "")
#: True vectors differ by 12 at most between states (a test enumerates them).
SPREAD = 16
SPECULATIVE = tuple(tuple(0 if s == t else SPREAD for s in range(4)) for t in range(4))

RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(maxsize=1 << 16)
def step(after: tuple[int, ...], symbol: str):
    """The vector before a row, given the one behind it (least cost 0), its least cost, and per state the edits up to
    and with this row and the state that they lead to.

    ``symbol``: D (must go), or the role's initial (x: none of s, u, a), as a capital when the row is truncated.
    """
    moves = []
    for s in range(4):
        found = [(DELETE + after[s], "D", s)]
        if symbol != "D":
            fine = TRUNCATED if symbol.isupper() else 0
            to = INITIALS.get(symbol.lower())
            if to == FOLLOWS[s] or (to == AFTER_S and s == START):
                found.append((fine + after[to], "K", to))
            found.append((fine + REROLE + after[FOLLOWS[s]], "R", FOLLOWS[s]))
        moves.append(found)
    cost = [min(m[0] for m in found) for found in moves]
    for _ in range(2):  # more than two insertions in a row come back to the same state
        cost = [min(cost[s], INSERT + cost[FOLLOWS[s]]) for s in range(4)]
    edits, to = [], []
    for s in range(4):
        text, at = "", s
        while True:
            least = [m for m in moves[at] if m[0] == cost[at]]
            inserted = INSERT + cost[FOLLOWS[at]] == cost[at]
            if least and least[0][1] == "D" or not inserted:
                text, at = text + least[0][1], least[0][2]
                break
            text, at = text + "I", FOLLOWS[at]
        edits.append(text)
        to.append(at)
    low = min(cost)
    return tuple(c - low for c in cost), low, tuple(edits), tuple(to)


def backward(symbols: str, after: tuple[int, ...]):
    """The vector before ``symbols``, and the steps, in order."""
    steps, base = [], min(after)
    vector = tuple(v - base for v in after)
    for symbol in reversed(symbols):
        found = step(vector, symbol)
        vector, base = found[0], base + found[1]
        steps.append(found)
    steps.reverse()
    return tuple(v + base for v in vector), steps


def trace(steps: list, state: int) -> tuple[str, int]:
    """The edits from ``state`` on, and the state at the end."""
    edits = []
    for found in steps:
        edits.append(found[2][state])
        state = found[3][state]
    return "".join(edits), state


@lru_cache(maxsize=1 << 16)
def solve(symbols: str) -> str:
    """The audit of a whole conversation."""
    edits, state = trace(backward(symbols, FINAL)[1], START)
    return edits + ENDING[state]


def apply(edits: str, roles: list[str], texts: list[str], marks: str, state: int) -> tuple[int, list[str]]:
    """Cost of the edits and the repaired lines, from ``state`` on."""
    cost, lines, at = 0, [], 0
    for edit in edits:
        if edit == "I":
            state = FOLLOWS[state]
            cost += INSERT
            lines.append(f"{ROLES[state]}:")
            continue
        if edit == "D":
            cost += DELETE
        else:
            cost += TRUNCATED if marks[at] == "t" else 0
            if edit == "K":
                state = INITIALS[roles[at][0]]
                lines.append(f"{roles[at]}:{texts[at]}")
            else:
                state = FOLLOWS[state]
                cost += REROLE
                lines.append(f"{ROLES[state]}:{texts[at]}")
        at += 1
    return cost, lines


def symbol_of(mark: str, role: str) -> str:
    if mark in "bd":
        return "D"
    initial = role[:1] if role[:1] in INITIALS else "x"
    return initial.upper() if mark == "t" else initial


class Chunk:
    """Rows of one conversation, in order."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq = conv, seq
        self.turns, self.roles, self.texts, self.marks = [], [], [], []
        self.seen: dict[tuple[str, str], int] = {}
        self.chars = 0

    def add(self, turn, role: str, text: str) -> None:
        body = text.rstrip(SPACE)
        if not body:
            mark = "b"
        elif (role, text) in self.seen:
            mark = "d"
        else:
            self.seen[role, text] = len(self.marks)
            mark = "o" if body[-1] in ".!?" else "t"
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.marks.append(mark)
        self.chars += len(text)

    def full(self, rows: int, chars: int) -> bool:
        return len(self.marks) >= rows or self.chars >= chars

    def keys(self) -> list[dict]:
        """A digest of role and text for each row that is the chunk's first with them."""
        return [{"i": i, "key": hashlib.blake2b(f"{len(r)}:{r}:{t}".encode(), digest_size=16).digest()} for (r, t), i in self.seen.items()]


def counts(turns: list, roles: list[str], marks: str) -> dict:
    """Faults and turn range of one stretch of rows."""
    known = [t for t in turns if t is not None]
    pairs = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    out = {"blank": marks.count("b"), "duplicate": marks.count("d"), "truncated": marks.count("t"), "illegal": pairs}
    return out | {"low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known))}


def finished(turns: list, roles: list[str], texts: list[str], marks: str) -> dict:
    """The result of a conversation that is all here."""
    found = counts(turns, roles, marks)
    audit = solve("".join(map(symbol_of, marks, roles)))
    cost, lines = apply(audit, roles, texts, marks, START)
    gaps = found["high"] - found["low"] + 1 - found["distinct"] if found["distinct"] else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return found | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest}


def chunk_rows(chunk_rows: int, chunk_chars: int):
    """Sorted rows (conv, turn, role, text, lost) of a partition: a result for each conversation that lies here in one
    chunk, and else its chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, kind = [], 0, None
        chunk, first = None, True

        def emit(c: Chunk, whole: bool) -> None:
            nonlocal size
            marks = "".join(c.marks)
            row = {"conv": c.conv, "seq": c.seq}
            if whole:
                row |= finished(c.turns, c.roles, c.texts, marks)
            else:
                row |= {"turns": c.turns, "roles": c.roles, "texts": c.texts, "marks": marks, "keys": c.keys()}
                size += c.chars
            out.append(row)

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            fields = [pa.field("conv", kind), pa.field("seq", pa.int32()), *map(pa.field, RESULT, RESULT_TYPES)]
            fields += [pa.field("turns", pa.list_(pa.int64())), pa.field("roles", pa.list_(pa.string())), pa.field("texts", pa.list_(pa.string()))]
            fields += [pa.field("marks", pa.string()), pa.field("keys", pa.list_(pa.struct([("i", pa.int32()), ("key", pa.binary())])))]
            made = pa.RecordBatch.from_pylist(out, pa.schema(fields))
            out, size = [], 0
            return made

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, lost in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if chunk is None or chunk.conv != conv:
                    if chunk is not None:
                        emit(chunk, not first and chunk.seq == 0)
                        first = False
                    chunk = Chunk(conv, 0)
                if lost:
                    continue
                if chunk.full(chunk_rows, chunk_chars):
                    emit(chunk, False)
                    chunk = Chunk(conv, chunk.seq + 1)
                chunk.add(turn, role, text)
                if len(out) >= 4096 or size >= chunk_chars:
                    yield flush()
        if chunk is not None:
            emit(chunk, False)
        if out:
            yield flush()

    return cut


def same(a: str, b: str, *more: str) -> Column:
    on = F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    for c in more:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, idx, symbols, last): the vectors that a chunk yields from each speculative one (from the final one, four
    times, where it is the last), four by four."""
    for batch in batches:
        found = []
        for symbols, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            made = [backward(symbols, FINAL if last else spec)[0] for spec in SPECULATIVE]
            low = min(map(min, made))
            found.append([v - low for vector in made for v in vector])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv", "idx", "vectors"])


def one_rank(vectors: str) -> Column:
    """Whether the four vectors differ only by constants."""
    v = lambda t, s: F.col(vectors)[4 * t + s]
    checks = [v(t, s) - v(t, 0) == v(0, s) - v(0, 0) for t in range(1, 4) for s in range(1, 4)]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def rerun(own: str, behind: str) -> Column:
    """The vectors of a chunk that runs from the results of the stretch behind it, with least cost 0."""
    cells = [F.least(*[F.col(behind)[4 * t + u] + F.col(own)[4 * u + s] for u in range(4)]) for t in range(4) for s in range(4)]
    made = F.array(*cells)
    return F.transform(made, lambda x: x - F.array_min(made))


def settle(chunks: DataFrame, value: str, to: int, done, join) -> DataFrame:
    """Fix-up passes: conv, idx and ``value``, with ``value`` joined to that of the neighbouring stretch (``to``: 1 behind,
    -1 before) until ``done``.  A pass doubles the stretch."""
    rest = stage(chunks.select("conv", "idx", value, (F.col("idx") + to).alias("next"), done(value).alias("done")), "pass")
    while not rest.filter("NOT done").isEmpty():
        r, n = rest.filter("NOT done").alias("r"), rest.alias("n")
        met = r.join(n, F.col("r.conv").eqNullSafe(F.col("n.conv")) & (F.col("r.next") == F.col("n.idx")))
        met = met.select("r.conv", "r.idx", join(f"r.{value}", f"n.{value}").alias(value), "n.next")
        rest = stage(rest.filter("done").unionByName(met.withColumn("done", done(value))), "pass")
    return rest.select("conv", "idx", value)


def trace_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, idx, symbols, behind): from each state the edits, and the state at the end."""
    for batch in batches:
        audits, ends = [], []
        for symbols, behind in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            steps = backward(symbols, tuple(behind))[1]
            found = [trace(steps, s) for s in range(4)]
            audits.append([f[0] for f in found])
            ends.append([f[1] for f in found])
        cols = [batch.column(0), batch.column(1), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["conv", "idx", "audits", "ends"])


PIECE = "idx long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, body binary"


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, idx, last, state, audit, turns, roles, texts, marks): counts, cost, edits and repaired bytes of each chunk."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            edits = row["audit"]
            found = counts(row["turns"], row["roles"], row["marks"])
            cost, lines = apply(edits, row["roles"], row["texts"], row["marks"], row["state"])
            out.append(
                found | {"conv": row["conv"], "idx": row["idx"], "first": row["roles"][0][:1], "last": row["roles"][-1][:1]}
                | {"cost": cost, "audit": edits, "body": "\n".join(lines).encode()}
            )
        longs = ["low", "high", "distinct", "blank", "duplicate", "truncated", "illegal"]
        fields = [batch.schema.field(0), pa.field("idx", pa.int64()), *[pa.field(c, pa.int64()) for c in longs]]
        fields += [("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("body", pa.binary())]
        yield pa.RecordBatch.from_pylist(out, pa.schema(fields))


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of conv and idx: one result a conversation.  Holds a digest and the audit, no texts."""
    now, total = None, None

    def close() -> dict:
        low, high = total["low"], total["high"]
        gaps = 0 if low is None else high - low + 1 - total["distinct"]
        return {c: total[c] for c in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")} | {
            "gaps": gaps,
            "audit": "".join(total["audit"]),
            "repaired_sha256": total["digest"].hexdigest(),
        }

    kind = None
    for batch in batches:
        kind, out = batch.schema.field(0), []
        for row in batch.to_pylist():
            if now is None or row["conv"] != total["conv"]:
                if now is not None:
                    out.append(close())
                now, total = True, row | {"audit": [row["audit"]], "digest": hashlib.sha256(row["body"]), "empty": not row["body"]}
                continue
            total["illegal"] += total["last"] + row["first"] not in LEGAL
            total["last"] = row["last"]
            if row["low"] is not None:  # turns ascend, so a turn on both sides is the highest so far
                total["distinct"] -= total["high"] == row["low"]
                total["low"] = row["low"] if total["low"] is None else total["low"]
                total["high"] = row["high"]
            for c in ("distinct", "blank", "duplicate", "truncated", "illegal", "cost"):
                total[c] += row[c]
            total["audit"].append(row["audit"])
            if row["body"]:
                total["digest"].update(row["body"] if total["empty"] else b"\n" + row["body"])
                total["empty"] = False
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([kind, *map(pa.field, RESULT, RESULT_TYPES)]))
    if now is not None:
        yield pa.RecordBatch.from_pylist([close()], pa.schema([kind, *map(pa.field, RESULT, RESULT_TYPES)]))


def across_chunks(pieces: DataFrame, conv_ddl: str) -> DataFrame:
    """The results of conversations in several chunks.  ``pieces``: conv, part, seq, turns, roles, texts, marks, keys."""
    # a conversation's chunks are numbered through: one row per conversation and partition gives where each partition begins
    per_part = pieces.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(W.partitionBy("conv"))
    offsets = stage(per_part.select("conv", "part", ahead.alias("ahead"), whole.alias("chunks")), "offsets")
    idx = F.col("o.ahead") + F.col("p.seq")
    placed = pieces.alias("p").join(offsets.alias("o"), same("p", "o", "part"))
    placed = stage(placed.select("p.*", idx.alias("idx"), (idx == F.col("o.chunks") - 1).alias("end")), "chunks")

    # a row that is its chunk's first may repeat one of an earlier chunk
    keys = placed.select("conv", "idx", F.explode("keys").alias("k")).select("conv", "idx", "k.i", "k.key")
    firsts = keys.groupBy("conv", "key").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = keys.alias("k").join(stage(firsts, "firsts").alias("f"), same("k", "f", "key")).filter("k.idx > f.first")
    repeats = repeats.groupBy("k.conv", "k.idx").agg(F.collect_list("k.i").alias("also"))  # at most a chunk's rows
    joined = placed.alias("p").join(repeats.alias("r"), same("p", "r", "idx"), "left")
    joined = joined.select("p.conv", "p.idx", "p.end", "p.turns", "p.roles", "p.texts", "p.marks", "r.also")
    marks = F.transform(F.split("marks", ""), lambda m, i: F.when(F.array_contains("also", i), "d").otherwise(m))
    marked = joined.withColumn("marks", F.when(F.col("also").isNull(), F.col("marks")).otherwise(F.array_join(marks, "")))
    initial = lambda r: F.when(F.substring(r, 1, 1).isin(*INITIALS), F.substring(r, 1, 1)).otherwise("x")
    mark = lambda i: F.substr(F.col("marks"), i + 1, F.lit(1))
    symbol = lambda r, i: F.when(mark(i).isin("b", "d"), "D").when(mark(i) == "t", F.upper(initial(r))).otherwise(initial(r))
    marked = stage(marked.withColumn("symbols", F.array_join(F.transform("roles", symbol), "")), "marked")
    symbols = marked.select("conv", "idx", "symbols", "end")

    vectors = symbols.mapInArrow(speculate, f"{conv_ddl}, idx long, vectors array<long>")
    before = settle(vectors, "vectors", 1, one_rank, rerun)  # the vector before each chunk
    s, b = symbols.alias("s"), before.alias("b")
    on = F.col("s.conv").eqNullSafe(F.col("b.conv")) & (F.col("s.idx") + 1 == F.col("b.idx"))
    behind = F.coalesce(F.slice("b.vectors", 1, 4), F.array(*[F.lit(v).cast("long") for v in FINAL]))
    traced = s.join(b, on, "left").select("s.conv", "s.idx", "s.symbols", behind.alias("behind"))
    traced = stage(traced.mapInArrow(trace_all, f"{conv_ddl}, idx long, audits array<string>, ends array<int>"), "traces")

    # in which state each chunk ends: known once all traces run together, or from the conversation's start on
    from_start = F.array_repeat(F.col("ends")[START], 4)
    ends = traced.select("conv", "idx", F.when(F.col("idx") == 0, from_start).otherwise(F.col("ends")).alias("ends"))
    together = lambda e: (F.array_min(e) == F.array_max(e))
    follow = lambda own, ahead: F.array(*[F.get(F.col(own), F.col(ahead)[s]) for s in range(4)])
    ended = settle(ends, "ends", -1, together, follow)
    t, e = traced.alias("t"), ended.alias("e")
    on = F.col("t.conv").eqNullSafe(F.col("e.conv")) & (F.col("t.idx") - 1 == F.col("e.idx"))
    state = F.coalesce(F.col("e.ends")[0], F.lit(START))
    chosen = t.join(e, on, "left").select("t.conv", "t.idx", state.alias("state"), F.get("t.audits", state).alias("audit"), F.get("t.ends", state).alias("stop"))
    m, c = marked.alias("m"), chosen.alias("c")
    ending = F.array(*[F.lit(x) for x in ENDING])
    audit = F.when(F.col("m.end"), F.concat("c.audit", F.get(ending, F.col("c.stop")))).otherwise(F.col("c.audit"))
    rows = m.join(c, same("m", "c", "idx")).select("m.conv", "m.idx", "c.state", audit.alias("audit"), "m.turns", "m.roles", "m.texts", "m.marks")
    pieces = rows.mapInArrow(repaired, f"{conv_ddl}, {PIECE}")
    return pieces.repartition("conv").sortWithinPartitions("conv", "idx").mapInArrow(stitch, f"{conv_ddl}, {RESULT_DDL}")


def repair(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    lost: str | None = None,
    most_rows: int = CHUNK_ROWS,
    most_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row per conversation: conv_id, the counts of faults, the cost, the audit and the digest of the repaired text.

    Rows for which ``lost`` holds name their conversation and nothing else.
    """
    space = F.lit(" ")
    data = rows.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
        (F.col(lost) if lost else F.lit(False)).alias("lost"),
    )
    conv_ddl = f"conv {data.schema['conv'].dataType.simpleString()}"
    # equal rows are told apart by where they stand, so that no group of them is one task
    keyed = data.withColumn("tie", F.xxhash64("role", "text")).withColumn("place", F.monotonically_increasing_id())
    order = ["conv", "turn", "tie", "place"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "lost")
    ddl = f"{conv_ddl}, seq int, {RESULT_DDL}, turns array<long>, roles array<string>, texts array<string>, marks string, keys array<struct<i:int,key:binary>>"
    cut = sorted_.mapInArrow(chunk_rows(most_rows, most_chars), ddl)
    found = stage(cut.withColumn("part", F.spark_partition_id()), "conversations")
    done = found.filter(F.col("audit").isNotNull()).select("conv", *RESULT)
    split = found.filter(F.col("audit").isNull())
    filled = split.filter(F.size("turns") > 0)
    stitched = stage(across_chunks(filled, conv_ddl), "stitched")
    # conversations that lost all rows
    bare = split.filter(F.size("turns") == 0).select("conv").distinct().alias("a")
    bare = bare.join(stitched.alias("b"), same("a", "b"), "left_anti")
    zeros = [F.lit(0).cast("long").alias(c) for c in RESULT[:6]]
    bare = bare.select("conv", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return done.unionByName(stitched.select("conv", *RESULT)).unionByName(bare).withColumnRenamed("conv", "conv_id")


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, drawn by crc32 of ``conv_id:turn``; a dropped row stays with ``lost`` set."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("draw"))
    changed = drawn.select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") == 0).alias("lost"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), lost="lost")


# Damage by a bitwise crc32, then a plain forward search: after each row the cheapest edits that end in each state
# (0 nothing yet, 1 after s, 2 after u, 3 after a), with at most two insertions before a row.
ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name
  FROM conversations),
d AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0],
              lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS draw FROM c),
k AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
r AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
ins AS (
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:'),
    (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 2, 10, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) t(a, z, cost, edits, lines)),
follow AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(a, letter, z)),
step AS (
  SELECT f.conv_id, f.i, s.a, s.z, s.cost + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cost, s.edit,
         chr(10) || CASE WHEN s.edit = 'K' THEN role WHEN s.z = 2 THEN 'user' ELSE 'assistant' END || ':' || text AS line
  FROM f JOIN (SELECT a, z, letter, 0 AS cost, 'K' AS edit FROM follow UNION ALL SELECT a, z, NULL, 1, 'R' FROM follow WHERE letter <> 's') s
    ON s.edit = 'R' OR s.letter = f.initial
  WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, a, a, 2, 'D', '' FROM f, (VALUES (0), (1), (2), (3)) t(a)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS p FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT b.conv_id, s.i, s.z, min({'cost': b.p.cost + n.cost + s.cost, 'audit': b.p.audit || n.edits || s.edit, 'lines': b.p.lines || n.lines || s.line})
  FROM best b JOIN ins n ON n.a = b.state JOIN step s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.a = n.z
  GROUP BY b.conv_id, s.i, s.z),
t AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
e AS (
  SELECT t.conv_id, min({'cost': b.p.cost + n.cost, 'audit': b.p.audit || n.edits, 'lines': b.p.lines || n.lines}) AS p
  FROM t JOIN best b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.n JOIN ins n ON n.a = b.state AND n.z IN (0, 3) GROUP BY t.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.p.cost, 0)::BIGINT AS cost,
       coalesce(e.p.audit, '') AS audit, sha256(coalesce(substr(e.p.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
