"""Operators with exact results against plain Python versions, on odd tables."""

import collections
import hashlib
import random

import brute
import pyarrow as pa
import pytest
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401

from nichelab.llm import decontaminate, exact, jaccard, mixing, substring

ITEMS = "item_id long, text string"


def items_frame(spark, rows):
    return spark.createDataFrame(
        [(1, " ".join(rows[0][1].split()[5:25])), (2, "one two three"), (3, "one"), (4, None), (5, ""), (2, "one two three"), (None, rows[6][1]), (7, "no such words at all here")],
        ITEMS,
    )


def items_list(df):
    return [(r["item_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("set_limit", [decontaminate.SET_LIMIT, 0])
def test_decontamination(spark, docs_frame, odd_rows, set_limit):
    items = items_frame(spark, odd_rows)
    out = decontaminate.decontaminate(docs_frame(odd_rows), items, set_limit=set_limit).select("doc_id", "n_words", "n_hit", "items").collect()
    want = brute.decontaminate(odd_rows, items_list(items))
    same([(r[0], r[1], r[2], ",".join(r[3])) for r in out], [(r[0], r[1], r[2], ",".join(r[3])) for r in want])


def test_decontamination_empty(spark, docs_frame, odd_rows):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(docs_frame(odd_rows), none).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs_frame([]), items_frame(spark, odd_rows)).count() == 0


@pytest.mark.parametrize("set_limit", [decontaminate.SET_LIMIT, 0])
def test_decontamination_of_long_texts(spark, docs_frame, set_limit):
    """Texts made of benchmark text, with stretches of one word: every place is a hit on both ways."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(400))) for i in range(10)]
    items += [(20, "again " * 30), (21, "w1 w2")]
    long = " ".join(t for _, t in items * 4)
    rows = [(1, long), (1, long), (2, long + " own words " + long), (3, "again " * 5000), (4, "own " * 3000), (None, items[0][1])]
    frame = spark.createDataFrame(items, ITEMS)
    out = decontaminate.decontaminate(docs_frame(rows), frame, set_limit=set_limit).select("doc_id", "n_words", "n_hit", "items").collect()
    want = brute.decontaminate(rows, items)
    same([(r[0], r[1], r[2], ",".join(r[3])) for r in out], [(r[0], r[1], r[2], ",".join(r[3])) for r in want])


def test_winnowing_keeps_every_span(spark, docs_frame):
    """A span of exactly ten words is found wherever it stands."""
    span = " ".join(f"w{i}" for i in range(10))
    rows = [(i, " ".join([*(f"p{i}x{j}" for j in range(i)), span, *(f"q{i}x{j}" for j in range(30 - i))])) for i in range(31)]
    items = spark.createDataFrame([(1, "a b c " + span + " d e f")], ITEMS)
    out = decontaminate.decontaminate(docs_frame(rows), items).collect()
    assert all(r["n_hit"] == 10 for r in out)


def test_substring(docs_frame, odd_rows):
    out = substring.substring_dedup(docs_frame(odd_rows))
    same(out.collect(), brute.substring(odd_rows))
    assert substring.substring_dedup(docs_frame([])).count() == 0


def test_substring_many_shards(docs_frame, odd_rows, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_SEGMENTS", 20)
    same(substring.substring_dedup(docs_frame(odd_rows)).collect(), brute.substring(odd_rows))


def test_substring_common_passage(docs_frame, monkeypatch):
    """A passage in ever different surroundings: no task gets all segments of its representatives."""
    rng = random.Random(4)
    passage = [f"common{i}" for i in range(30)]
    own = [[f"own{rng.randrange(40)}" for _ in range(40)] for _ in range(90)]
    rows = [(i, " ".join([*w[:20], *passage, *w[20:]])) for i, w in enumerate(own)]
    rows += [(100, " ".join(["again"] * 200 + passage)), (101, " ".join(["again"] * 90 + passage)), (None, rows[0][1]), (102, rows[3][1])]
    limit, shard_rows = 20, substring._shard_rows

    def bounded(span):
        run = shard_rows(span)

        def check(batches):
            got = list(batches)
            prints = [p for b in got for p in b.column(0).to_pylist()]
            if any(prints.count(p) > limit for p in prints):
                raise ValueError("one task holds all segments of a representative")
            yield from run(iter(got))

        return check

    monkeypatch.setattr(substring, "SHARD_SEGMENTS", limit * 10)
    monkeypatch.setattr(substring, "_shard_rows", bounded)
    same(substring.substring_dedup(docs_frame(rows)).collect(), brute.substring(rows))


def test_substring_common_representative_is_spread():
    """Of a task's documents with one representative two go to its task, whatever their number; none is lost."""
    passage = " ".join(f"common{i}" for i in range(30))
    ids = [*range(500), 7, 499]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"own{i} {passage} end{i}" for i in ids])], ["doc_id", "text"])
    rows = [r for b in substring._print_rows(13, 5)(iter([batch])) for r in b.to_pylist()]
    together = collections.Counter(r["print"] for r in rows if not r["salt"])
    everywhere = collections.Counter(r["print"] for r in rows)
    assert max(everywhere.values()) == 500 and max(together.values()) == 2
    assert len({(r["print"], r["doc_id"]) for r in rows}) == len(rows)
    lone = [r for r in rows if everywhere[r["print"]] == 1]
    assert lone and not any(r["salt"] for r in lone)


@pytest.mark.parametrize("prints", [1, 40])
def test_substring_few_prints_at_a_time(docs_frame, odd_rows, monkeypatch, prints):
    monkeypatch.setattr(substring, "PRINTS", prints)
    same(substring.substring_dedup(docs_frame(odd_rows)).collect(), brute.substring(odd_rows))


@pytest.mark.parametrize(("block", "hot_rows"), [(4096, 1000), (7, 1000), (16, 3)])
def test_exact(docs_frame, odd_rows, block, hot_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] if block < 100 else odd_rows
    out = exact.exact_dedup(docs_frame(rows), block=block, hot_rows=hot_rows)
    same(out.collect(), brute.exact(rows))


def test_exact_empty(docs_frame):
    assert exact.exact_dedup(docs_frame([])).count() == 0


def test_jaccard(docs_frame, odd_rows):
    same(jaccard.near_components(docs_frame(odd_rows)).collect(), brute.jaccard(odd_rows))
    assert jaccard.near_components(docs_frame([])).count() == 0


def test_jaccard_threshold_and_chain(docs_frame):
    """Sizes around the limit, small sets, and a chain of links whose ends are not alike."""
    rows = []
    for n in (5, 6, 7, 8, 9, 12, 20, 40, 80):
        words = [f"w{n}x{i}" for i in range(n)]
        rows += [(n * 100, " ".join(words)), (n * 100 + 1, " ".join([*words, "z"])), (n * 100 + 2, " ".join(words[: max(1, n * 7 // 8)])), (n * 100 + 3, " ".join(words[1:]))]
    long = [f"c{i}" for i in range(400)]
    rows += [(50_000 - k, " ".join(long[10 * k : 10 * k + 120])) for k in range(28)]
    common = " ".join(f"common{i}" for i in range(40))
    rows += [(60_000 + k, common + " " + " ".join(f"own{k}x{i}" for i in range(30 + k))) for k in range(60)]
    same(jaccard.near_components(docs_frame(rows)).collect(), brute.jaccard(rows))


def test_jaccard_bands_use_both_allocations():
    bands = [jaccard.Band(b) for b in range(12)]
    assert {b.weight for b in bands} == {1, 2}
    for b in bands:
        assert b.weight * b.segments > b.most


def test_mixing(docs_frame, odd_rows):
    rows = [(d, t, "en", None if i % 7 == 0 else f"s{i % 4}") for i, (d, t) in enumerate(odd_rows)]
    out = mixing.mix(docs_frame(rows))
    got = out.collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.tokens(t))
    target = brute.targets(sizes)
    taken = {}
    for r in got:
        s = None if r["no_source"] else r["source"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs_frame(rows).repartition(5)).collect()
    same([(r["doc_id"], r["size"], r["taken"], r["position"] or -1.0) for r in got], [(r["doc_id"], r["size"], r["taken"], r["position"] or -1.0) for r in again])
    stream = mixing.training_stream(out).collect()
    assert sum(r["words"] for r in stream) == sum(taken.values())
    assert [r["position"] for r in stream] == sorted(r["position"] for r in stream)


def test_mixing_schedule_and_empty(docs_frame):
    """Half-way through the run an early source has given more than half of its words, a late one less."""
    rows = [(i, "w " * 10, "en", f"s{i % 3}") for i in range(3000)]
    stream = mixing.training_stream(mixing.mix(docs_frame(rows))).join(docs_frame(rows).select("doc_id", "source"), "doc_id")
    half = {r["source"]: r["x"] for r in stream.groupBy("source").agg({"position": "median"}).toDF("source", "x").collect()}
    assert half["s0"] < 0.45 and abs(half["s1"] - 0.5) < 0.02 and half["s2"] > 0.55
    assert mixing.mix(docs_frame([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs_frame([(1, None), (2, "")])).collect()] == [0, 0]


def test_equal_texts_share_a_digest(docs_frame):
    out = exact.exact_dedup(docs_frame([(1, "ABC é"), (2, "abc é"), (3, "abc É")])).collect()
    assert {r["doc_id"]: (r["keep_id"], r["text_sha256"]) for r in out} == {
        1: (2, hashlib.sha256("abc é".encode()).hexdigest()),
        2: (2, hashlib.sha256("abc é".encode()).hexdigest()),
        3: (3, hashlib.sha256("abc É".encode()).hexdigest()),
    }


def test_jaccard_random_edits(docs_frame):
    """Sets of all sizes around common passages, edited at random, copies of copies among them."""
    rng = random.Random(11)
    passages = [[f"p{k}x{i}" for i in range(rng.randrange(4, 40))] for k in range(4)]
    rows, made = [], []
    for k in range(500):
        if made and rng.random() < 0.6:
            w = list(rng.choice(made))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = [f"e{k}x{rng.randrange(99)}"] * rng.randrange(0, 2)
        else:
            w = [f"d{k}x{i}" for i in range(rng.randrange(1, 70))]
            if rng.random() < 0.7:
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages)
        made.append(w or ["w"])
        rows.append((rng.randrange(10**6) * 1000 + k, " ".join(made[-1])))
    same(jaccard.near_components(docs_frame(rows)).collect(), brute.jaccard(rows))
