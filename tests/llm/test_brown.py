"""Class-based language model: contract base score, brute-force model, held-out perplexity, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401
from pyspark.sql import functions as F

from nichelab.llm import arrays, brown
from nichelab.llm.common import table

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").translate(LOWER).translate({ord(c): " " for c in SPACES}).split(" ")


def tokens(text):
    return [w for w in words(text) if w] + [None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    """The contract's columns, by hand."""
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i, is_held(i), len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def check_base(got, rows):
    cut = lambda r: (*r[:5], round(r[5], 5) + 0.0)
    same([cut(r) for r in got], [cut(r) for r in base(rows)])


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def hash_of(word):
    """The program's key of a word."""
    if word is None:
        return brown.END
    raw = np.frombuffer(word.encode(), np.uint8)
    return arrays.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = brown.op11_lm_scoring(spark, "/root/testdata/sf0.01").cache()
    got = out.select(*COLUMNS).collect()
    check_base([tuple(r) for r in got], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    by = {r["held_out"]: r for r in out.groupBy("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).collect()}
    for held, floor in ((True, 1.5), (False, 2.0)):
        assert 10 ** ((by[held]["s"] - by[held]["b"]) / by[held]["n"]) > floor  # perplexity falls by this factor
    assert all(math.isfinite(r["perplexity"]) and r["perplexity"] > 1 for r in out.select("perplexity").collect())
    out.unpersist()


def test_scores_equal_a_plain_model(spark, docs_frame, odd_rows, monkeypatch):  # noqa: F811
    """Scores from the program's classes, recomputed word by word; few hot words, so that the join does most of it."""
    rows = [r[:2] for r in odd_rows] + [(300, "New words ab1 never seen"), (301, "ab1 AB1 aB1"), (302, None)]
    docs = docs_frame(rows).withColumn("h", F.lit("clash")).withColumn("row", F.lit(1))
    monkeypatch.setattr(brown, "HOT", 7)
    kept = {}
    train = brown.train
    monkeypatch.setattr(brown, "train", lambda texts: kept.setdefault("found", train(texts)))
    out = brown.score(docs).select(*COLUMNS, "score").collect()
    check_base([tuple(r)[:6] for r in out], rows)
    model = kept["found"][0]
    class_of = lambda w: int(model.classes[brown.slots_of(np.array([hash_of(w)], np.uint64))[0]])
    c, pairs = Counter(), Counter()
    for i, text in rows:
        if not is_held(i):
            own = tokens(text)
            c.update(own)
            pairs.update(zip([0, *map(class_of, own[:-1])], map(class_of, own), strict=True))
    size, kinds, before = Counter(), Counter(), Counter()
    for w, n in c.items():
        size[class_of(w)] += n
        kinds[class_of(w)] += 1
    for (a, _), n in pairs.items():
        before[a] += n

    def score(text):
        total, last = 0.0, 0
        for w in tokens(text):
            k = class_of(w)
            total += math.log10((pairs[last, k] + 0.5) / (before[last] + 0.5 * brown.CLASSES))
            total += math.log10((c[w] + 0.1) / (size[k] + 0.1 * (kinds[k] + 1)))
            last = k
        return total

    same([(r["doc_id"], r["n_tokens"], round(r["score"], 5)) for r in out], [(i, len(tokens(t)), round(score(t), 5)) for i, t in rows])


def test_gain_is_the_change_of_the_likelihood():
    """Moving one slot changes the class bigram likelihood by the difference of its gains (no self bigrams here)."""
    rng = np.random.default_rng(4)
    slots = rng.integers(10, 60, 4000)
    slots[3::7] = 5  # every seventh token is the word that moves, never next to itself
    slots[-1] = brown.END_SLOT
    classes = np.full(brown.SLOTS + 1, 3, np.uint8)
    classes[:100] = rng.integers(1, 9, 100)
    classes[5], classes[brown.END_SLOT] = 4, 0  # in a class with others, some of them its neighbours

    def pairs_of(table):
        own, before, _ = brown.neighbours(slots, table)
        return np.bincount(before * brown.CLASSES + own, minlength=brown.CLASSES**2).reshape(brown.CLASSES, -1)

    def likelihood(table):
        p = pairs_of(table)
        return brown.x_log_x(p.astype(float)).sum() - 2 * brown.x_log_x(p.sum(axis=0).astype(float)).sum()

    own, before, behind = brown.neighbours(slots, classes)
    at = slots == 5
    key, n = np.unique(np.concatenate([before[at], brown.CLASSES + behind[at]]), return_counts=True)
    found, gain = brown.gains(np.full(len(key), 5), key, n, pairs_of(classes), classes)
    assert list(found) == [5]
    for to in range(1, 9):
        moved = classes.copy()
        moved[5] = to
        assert likelihood(moved) - likelihood(classes) == pytest.approx(gain[0, to] - gain[0, 4], abs=1e-6)


def test_exchange_finds_the_classes_of_a_made_up_language(spark, docs_frame):  # noqa: F811
    """Words of two kinds that alternate: afterwards nearly every class holds one kind."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"{'xy'[k % 2]}{int(150 * rng.random() ** 3)}" for k in range(60))
    rows = [(i, text()) for i in range(300)]
    model, counts, n, v = brown.train(docs_frame(rows).select("text"))
    trained = Counter(t for i, x in rows for t in tokens(x))
    assert n == 300 * 61 and v == counts.count() == len(trained)
    per_class = Counter()
    for word, times in trained.items():
        if word:
            per_class[int(model.classes[brown.slots_of(np.array([hash_of(word)], np.uint64))[0]]), word[0]] += times
    mixed = sum(min(per_class[c, "x"], per_class[c, "y"]) for c in range(brown.CLASSES))
    assert mixed < 0.02 * n


def test_nothing_to_learn_from(spark, docs_frame):  # noqa: F811
    held = [i for i in range(200) if is_held(i)][:3]
    rows = [(held[0], "some words"), (held[1], None), (held[2], "some")]
    out = brown.score(docs_frame(rows)).collect()
    check_base([tuple(r[c] for c in COLUMNS) for r in out], rows)
    assert brown.score(docs_frame([])).count() == 0
