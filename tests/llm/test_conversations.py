"""Conversation repair against a plain shortest-path version, in one chunk and in many."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from llm_helpers import same
from pyspark.sql import functions as F

from nichelab.llm import conversations as C
from nichelab.llm.common import table

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired lines) by uniform-cost search over (row, state), cost first, then edits as text.

    ``rows``: (role, text, fault).
    """
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = True
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        for letter, to in moves[state].items():
            if letter != "s":
                name = {"u": "user", "a": "assistant"}[letter]
                heapq.heappush(heap, (cost + 5, audit + "I", at, to, (*lines, f"{name}:")))
                if at < len(rows) and rows[at][2] not in ("blank", "duplicate"):
                    more = 5 if rows[at][2] == "truncated" else 0
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, to, (*lines, f"{name}:{rows[at][1]}")))
            if at < len(rows) and rows[at][2] not in ("blank", "duplicate") and rows[at][0][:1] == letter:
                more = 5 if rows[at][2] == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*lines, f"{rows[at][0]}:{rows[at][1]}")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))


def judge(rows):
    """``rows`` after damage, in order: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows, damaged=True):
    """conv_id and result, for rows (conv_id, turn, role, text) whose turns are distinct but for equal rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20 if damaged else 9
        convs[conv] += []
        if draw == 1:
            text = ""
        elif draw == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif draw == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    for own in convs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return [(conv, *judge(own)) for conv, own in convs.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ORDER = ["conv_id", *C.RESULT]


def rows_of(df):
    return [tuple(r) for r in df.select(*ORDER).collect()]


def random_rows(rng, n_convs, length, roles=("user", "assistant", "system", "tool", "u", "", None)):
    texts = ["Yes.", "no", "What?", "A longer answer!", "and then", " \t", "", None, "Über.", "x\ny. ", "end.\x0b"]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(1, length)):
            if rng.random() < 0.9:
                role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
                text = f"turn {turn}{rng.choice('.!? x')}" if rng.random() < 0.6 else rng.choice(texts)
                rows.append((conv, turn, role, text))
    return rows


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    out = C.op12_conversation_repair(spark, sf)
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    same(rows_of(out), plain(rows))


@pytest.mark.parametrize("most", [1024, 3])
def test_random_conversations(spark, most):
    rows = random_rows(random.Random(most), 120, 14)
    rows += [(None, None, "user", "No turn."), (None, 3, None, None), (500, None, None, None), (501, None, "user", "only.")]
    rows += [(600, 1, "user", "Same."), (600, 1, "user", "Same."), (601, -5, "assistant", "Below."), (601, 5, "assistant", "Below.")]
    rows += [(700 + k, k, "user", "Hm.") for k in range(60)]  # some of them lose their only row
    docs = frame(spark, rows).withColumn("audit", F.lit("clash")).withColumn("lost", F.lit(False))
    same(rows_of(C.repair(C.damage(docs), lost="lost", most_rows=most)), plain(rows))


def test_sql_on_random_conversations():
    rows = random_rows(random.Random(8), 80, 14)
    rows += [(None, None, "user", "No turn."), (None, 3, None, None), (500, None, None, None), (601, -5, "assistant", "Below."), (601, 5, "assistant", "Below.")]
    rows += [(700 + k, k, "user", "Hm.") for k in range(60)]  # some of them lose their only row
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(ORDER)} FROM ({C.ORACLE})").fetchall()
    same(found, plain(rows))


def long_rows(rng, conv, kind):
    rows = [(conv, 0, "system", "Be good.")]
    for turn in range(1, 300):
        role = ("user", "assistant")[turn % 2]
        if kind == "truncated":
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), f"cut {turn}"))
        elif kind == "duplicates":
            rows.append((conv, turn, "user", "Again."))
        elif kind == "mixed":
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c?", "", f"{turn}.", f"{turn}"])))
        elif kind == "alternating":
            rows.append((conv, turn, "user" if turn < 150 else "assistant", f"row {turn}."))
        else:
            rows.append((conv, turn, role, f"row {turn}."))
    return rows


def test_long_conversations_in_many_chunks(spark):
    """Also where the vectors never converge: rows that are all truncated, or must all go; and equal rows without a turn."""
    rng = random.Random(3)
    rows = [r for conv, kind in enumerate(["healthy", "truncated", "duplicates", "mixed", "alternating"]) for r in long_rows(rng, conv, kind)]
    rows += [(9, None, "user", "Hello.")] * 300 + [(9, 1, "assistant", "Yes.")] * 3
    rows += [(20, t, "user", f"short {t}.") for t in range(5)]
    same(rows_of(C.repair(frame(spark, rows), most_rows=7)), plain(rows, damaged=False))


def test_ties_of_a_turn_and_long_texts(spark):
    rows = [(1, 1, r, t) for r in ("user", "assistant") for t in ("One.", "Two.")] + [(2, 1, "user", "w " * 300_000), (2, 2, "assistant", "ok." * 200_000)]
    one = rows_of(C.repair(frame(spark, rows)))
    same(one, rows_of(C.repair(frame(spark, rows[::-1]).repartition(5), most_rows=2, most_chars=1000)))
    assert {r[0] for r in one} == {1, 2}


def test_empty_table(spark):
    assert rows_of(C.repair(frame(spark, []))) == []


def test_vectors_are_few_and_close():
    """Every vector that can arise differs by less than the speculative ones, so these generate it."""
    seen, todo = {C.FINAL}, [C.FINAL]
    while todo:
        v = todo.pop()
        for symbol in "DsuaxSUAX":
            after = C.step(v, symbol)[0]
            if after not in seen:
                seen.add(after)
                todo.append(after)
    assert max(max(v) for v in seen) <= 12 < C.SPREAD and len(seen) < 1000


def test_least_audit_by_listing_all():
    """All edit sequences of short conversations, listed."""
    def listed(symbols):
        best = None
        todo = [("", 0, 0, C.START, 0)]
        while todo:
            audit, cost, at, state, inserts = todo.pop()
            if cost > 2 * len(symbols) + 4:
                continue
            if at == len(symbols) and state in (C.START, C.AFTER_A):
                best = min(best or (cost, audit), (cost, audit))
            if inserts < 3:
                todo.append((audit + "I", cost + 5, at, C.FOLLOWS[state], inserts + 1))
            if at < len(symbols):
                x = symbols[at]
                todo.append((audit + "D", cost + 2, at + 1, state, 0))
                if x != "D":
                    fine = 5 if x.isupper() else 0
                    todo.append((audit + "R", cost + fine + 1, at + 1, C.FOLLOWS[state], 0))
                    to = C.INITIALS.get(x.lower())
                    if to == C.FOLLOWS[state] or (to == C.AFTER_S and state == C.START):
                        todo.append((audit + "K", cost + fine, at + 1, to, 0))
        return best[1]

    rng = random.Random(2)
    for _ in range(150):
        symbols = "".join(rng.choice("DsuaxSUAX") for _ in range(rng.randrange(0, 6)))
        assert C.solve(symbols) == listed(symbols), symbols
