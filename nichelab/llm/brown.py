"""Language-model scoring with Brown class-based bigrams.

Every word belongs to one class, and a word's probability is that of its class
after the class of the word before, times that of the word within its class.
Classes come from exchange clustering: starting with the most frequent words in
classes of their own and all others in one, each word is taken out of its class
and put where the likelihood of the training text gains most.  Exchanges are
made for one part of the words after the other (``PARTS`` parts), all words of a
part at once, against class counts taken anew for each part; after ``ROUNDS``
rounds little moves any more.

A text's probability runs over its words and one end, and starts after an end.
The end is a class of its own.  Transitions and emissions are smoothed by adding
``TRANSITION`` and ``EMISSION``; a class gives one more word's share to unseen ones.

Scale.  Words are 64-bit hashes.  Their counts are one map-side combined aggregate
over all training text, and stay a table however large the vocabulary grows.
Only classes are addressed by ``SLOT_BITS`` bits of the hash: words that share a
slot move together, so the broadcast class table is 1 MB at any size.  The training
text is staged as slot numbers, and an exchange reads it once: it counts, per
slot, the classes before and behind (at most 2 * CLASSES numbers a slot, combined
before the shuffle), and the best class of a block of slots is found in one group
of bounded size.  For scoring, the ``HOT`` most frequent words' counts travel to the
tasks; all other words of a text are joined with the counts by hash, where no
key is frequent.

Edge cases: a null text is empty, that is, one end; a null doc_id is not held out,
so it trains; rows that repeat count as often as they stand; ties (equal counts,
equal gains) go to the smaller hash or class; without training rows every token
has probability 1 in the base score; very long texts are scored whole, a chunk
each; an empty table gives an empty result; columns but doc_id and text are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.llm.arrays import IS_SPACE, LOWER, Chunk, chunks, spans, word_hashes
from nichelab.llm.common import discard, stage, table

#: Class 0 is that of the end.
CLASSES = 64
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Slots whose best classes are found in one group.
BLOCK = 1 << 12
ROUNDS, PARTS = 2, 4
EMISSION, TRANSITION = 0.1, 0.5
#: Words whose counts are broadcast (16 bytes each).
HOT = 1 << 16
#: The end's key among the words' hashes, and its slot behind the others.
END, END_SLOT = np.uint64((1 << 64) - 1), SLOTS
HELD_OUT_MOD = 10
#: Entries that a task combines before it sends them on.
TALLY = 1 << 21


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT_MOD == 0, F.lit(False))


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: the words of each text and its end."""
    data = LOWER[chunk.data]
    start, end, row = spans(chunk, ~IS_SPACE[data])
    words = word_hashes(data, start, end)
    ends = np.cumsum(np.bincount(row, minlength=chunk.n))
    return np.insert(words, ends, END), np.insert(row, ends, np.arange(chunk.n))


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END, END_SLOT, (hashes & np.uint64(SLOTS - 1)).astype(np.int64))


class Tally:
    """Sums of counts by key, handed on whenever there are many keys."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size >= TALLY:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, inverse = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.size = [], 0
        for at in range(0, len(keys), 1 << 16):
            piece = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[piece].view(np.int64)), pa.array(n[piece])], self.names)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally(["h", "n"])
    for batch in batches:
        for c in chunks(batch.column(0)):
            yield from tally.add(tokens(c)[0])
    yield from tally.flush()


def slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of whole texts, one after the other, 4 bytes each."""
    for batch in batches:
        for c in chunks(batch.column(0)):
            raw = slots_of(tokens(c)[0]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["slots"])


def neighbours(slots: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, of the one before and of the one behind; texts begin after an end."""
    own = classes[slots].astype(np.int64)
    edge = np.zeros(1, np.int64)
    return own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])


def context_rows(shared, part: int | None):
    """Counts by key: ``-1 - (a * CLASSES + b)`` for class b after class a; and for the slots of ``part``
    ``slot * 2 * CLASSES + c`` where class c stands before, ``+ CLASSES + c`` where it stands behind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, tally = shared.value, Tally(["key", "n"])
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                slots = np.frombuffer(raw.as_py(), np.int32).astype(np.int64)
                own, before, behind = neighbours(slots, classes)
                pairs += np.bincount(before * CLASSES + own, minlength=CLASSES * CLASSES)
                if part is not None:
                    mine = (slots < END_SLOT) & (slots % PARTS == part)
                    base = slots[mine] * (2 * CLASSES)
                    yield from tally.add(np.concatenate([base + before[mine], base + CLASSES + behind[mine]]))
        yield from tally.flush()
        key = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - key), pa.array(pairs[key])], ["key", "n"])

    return count


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(slot: np.ndarray, side: np.ndarray, n: np.ndarray, pairs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots (sorted, by entry) and what the log-likelihood of the class bigrams gains where each joins each class.

    Entries: ``n`` times a class before (``side`` below CLASSES) or behind.  A slot's own counts are taken out
    of its present class first; where it stands next to itself, the neighbour counts as staying.
    """
    found, first, at = np.unique(slot, return_index=True, return_inverse=True)
    own, rows = classes[slot].astype(np.int64), np.arange(len(slot))
    both = np.zeros((len(found), 2 * CLASSES))
    both[at, side] = n
    left, right = both[:, :CLASSES], both[:, CLASSES:]
    held = np.concatenate([pairs, pairs.T])[side].astype(float)  # by entry, per class that the slot may join
    held[rows, own] -= n
    before, behind = side == own, side == CLASSES + own  # neighbours in its own class
    held[before] -= right[at[before]]
    held[behind] -= left[at[behind]]
    held = np.maximum(held, 0)
    out = np.add.reduceat(x_log_x(held + n[:, None]) - x_log_x(held), first, axis=0)
    mine, each = classes[found].astype(np.int64), np.arange(len(found))
    # neighbours before and behind in the class joined are pairs of one and the same kind
    cell = np.repeat(np.diagonal(pairs)[None].astype(float), len(found), axis=0)
    cell[each, mine] = np.maximum(cell[each, mine] - left[each, mine] - right[each, mine], 0)
    out += x_log_x(cell + left + right) - x_log_x(cell + left) - x_log_x(cell + right) + x_log_x(cell)
    size = left.sum(axis=1, keepdims=True)
    total = np.repeat(pairs.sum(axis=0)[None].astype(float), len(found), axis=0)
    total[each, mine] = np.maximum(total[each, mine] - size[:, 0], 0)
    out -= 2 * (x_log_x(total + size) - x_log_x(total))
    # the end's class is its own; an empty class would draw many words at once, as each would gain by having it alone
    closed = np.repeat((pairs.sum(axis=0) == 0)[None], len(found), axis=0)
    closed[:, 0], closed[each, mine] = True, False
    out[closed] = -np.inf
    return found, out


def best_classes(shared, slots_at_once: int = 256):
    """For a block of slots the classes of those that move."""

    def choose(entries: pa.Table) -> pa.Table:
        classes, pairs = shared.value
        key, n = entries.column("key").to_numpy(), entries.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        slot, side = key // (2 * CLASSES), key % (2 * CLASSES)
        moved, to = [], []
        edges = np.searchsorted(slot, np.arange(slot[0], slot[-1] + slots_at_once + 1, slots_at_once))
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            found, gain = gains(slot[a:b], side[a:b], n[a:b], pairs, classes)
            best = gain.argmax(axis=1)
            at = np.arange(len(found))
            better = gain[at, best] > gain[at, classes[found]] + 1e-9
            moved.append(found[better])
            to.append(best[better])
        return pa.table({"slot": pa.array(np.concatenate(moved), pa.int64()), "class": pa.array(np.concatenate(to).astype(np.int32))})

    return choose


def pair_counts(contexts: DataFrame) -> np.ndarray:
    """How often each class stands behind each (at most CLASSES ** 2 rows)."""
    rows = contexts.filter("key < 0").toPandas()
    out = np.zeros(CLASSES * CLASSES, np.int64)
    out[-1 - rows["key"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(CLASSES, CLASSES)


def cluster(text_slots: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of every slot, and the class bigram counts, by exchange clustering."""
    spark = text_slots.sparkSession
    words = counts.filter(F.col("h") != F.lit(END.astype(np.int64).item()))
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    top = words.groupBy(slot).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(CLASSES - 2).collect()
    classes = np.full(SLOTS + 1, CLASSES - 1, np.uint8)
    classes[END_SLOT] = 0
    for k, row in enumerate(top):
        classes[row["slot"]] = 1 + k
    for p in range(rounds * PARTS):
        shared = spark.sparkContext.broadcast(classes)
        contexts = text_slots.mapInArrow(context_rows(shared, p % PARTS), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        contexts = stage(contexts, "contexts")
        both = spark.sparkContext.broadcast((classes, pair_counts(contexts)))
        block = F.floor(F.col("key") / (2 * CLASSES * BLOCK)).alias("block")
        moves = contexts.filter("key >= 0").groupBy(block).applyInArrow(best_classes(both), "slot long, class int").toPandas()  # at most SLOTS rows
        classes = classes.copy()
        classes[moves["slot"].to_numpy(np.int64)] = moves["class"].to_numpy(np.uint8)
        shared.unpersist()
        both.unpersist()
        discard(contexts)
    shared = spark.sparkContext.broadcast(classes)
    contexts = text_slots.mapInArrow(context_rows(shared, None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return classes, pair_counts(contexts)


class Model:
    """What the tasks need: counts of the hot words (sorted hashes), class by slot, and log10 probabilities."""

    def __init__(self, hot: np.ndarray, hot_counts: np.ndarray, classes: np.ndarray, transition: np.ndarray, spread: np.ndarray):
        self.hot, self.hot_counts, self.classes = hot, hot_counts, classes
        #: log10 of a class after a class; log10 of a class's smoothed size, by which emissions are divided.
        self.transition, self.spread = transition, spread


def class_words(shared):
    """Sizes of the classes: training tokens, and distinct words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(CLASSES), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own = shared.value[slots_of(batch.column(0).to_numpy().view(np.uint64))]
            total += np.bincount(own, batch.column(1).to_numpy(), CLASSES)
            words += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total.astype(np.int64)), pa.array(words)], ["class", "n", "words"])

    return count


def train(texts: DataFrame) -> tuple[Model, DataFrame, int, int]:
    """``texts``: one column, text.  The model, the word counts (h, n), and the numbers of tokens and of distinct ones."""
    spark = texts.sparkSession
    counts = stage(texts.mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    text_slots = stage(texts.mapInArrow(slot_rows, "slots binary"), "slots")
    classes, pairs = cluster(text_slots, counts)
    discard(text_slots)
    shared = spark.sparkContext.broadcast(classes)
    sizes = counts.mapInArrow(class_words(shared), "class int, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()
    spread = np.full(CLASSES, math.log10(EMISSION))  # of a class without words: one unseen word
    spread[sizes["class"].to_numpy(np.int64)] = np.log10(sizes["n"].to_numpy(float) + EMISSION * (sizes["words"].to_numpy(float) + 1))
    transition = np.log10((pairs + TRANSITION) / (pairs.sum(axis=1, keepdims=True) + TRANSITION * CLASSES))
    top = counts.orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    hot, hot_counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(hot)
    return Model(hot[order], hot_counts[order], classes, transition, spread), counts, int(n_tokens), int(n_types)


SCORED = "row long, doc_id long, n_tokens long, n_known long, words double, classes double, n_cold long, cold array<struct<h:long,n:int>>"


def score_rows(shared):
    """Per text: tokens, those among the hot words, the sum of log10 of their smoothed counts, the sum of what the classes
    give, and the other words with their numbers."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        logs = np.log10(model.hot_counts + EMISSION)
        for batch in batches:
            for c in chunks(batch.column(2)):
                hashes, row = tokens(c)
                own, before, _ = neighbours(slots_of(hashes), model.classes)
                first = np.searchsorted(row, np.arange(c.n))
                given = np.add.reduceat(model.transition[before, own] - model.spread[own], first)
                at = np.searchsorted(model.hot, hashes)
                at[at == len(model.hot)] = 0
                hot = model.hot[at] == hashes if len(model.hot) else np.zeros(len(hashes), bool)
                words = np.add.reduceat(np.where(hot, logs[at] if len(logs) else 0.0, 0.0), first)
                known = np.add.reduceat(hot.astype(np.int64), first)
                # the others, each once a text
                cold_row, cold_hash = row[~hot], hashes[~hot]
                order = np.lexsort((cold_hash, cold_row))
                cold_row, cold_hash = cold_row[order], cold_hash[order]
                new = np.ones(len(order), bool)
                new[1:] = (cold_row[1:] != cold_row[:-1]) | (cold_hash[1:] != cold_hash[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(order)))
                offsets = np.searchsorted(cold_row[starts], np.arange(c.n + 1))
                items = pa.StructArray.from_arrays([pa.array(cold_hash[starts].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"])
                n = np.bincount(row, minlength=c.n)
                cols = [
                    batch.column(0).slice(c.first, c.n),
                    batch.column(1).slice(c.first, c.n),
                    pa.array(n.astype(np.int64)),
                    pa.array(known),
                    pa.array(words),
                    pa.array(given),
                    pa.array(np.bincount(cold_row, minlength=c.n).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "n_known", "words", "classes", "n_cold", "cold"])

    return score


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (class
    model, log10) and perplexity (of the class model, per token).  Learns from the rows that are not held out."""
    spark = docs.sparkSession
    data = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model, counts, n_tokens, n_types = train(data.filter(~held_out()).select("text"))
    shared = spark.sparkContext.broadcast(model)
    numbered = data.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = stage(numbered.mapInArrow(score_rows(shared), SCORED), "scored")
    cold = scored.select("row", F.explode("cold").alias("c")).select("row", "c.h", F.col("c.n").alias("times"))
    # a word that training lacks has log10 of EMISSION, which is set below; the others add what they have beyond it
    least = math.log10(EMISSION)
    beyond = F.sum(F.col("times") * (F.log10(F.col("n") + EMISSION) - least)).alias("beyond")
    met = cold.join(counts, "h").groupBy("row").agg(beyond, F.sum("times").alias("times"))
    words = F.col("words") + F.col("n_cold") * least + F.coalesce("beyond", F.lit(0.0))
    per_token = math.log10(n_tokens + EMISSION * (n_types + 1))
    total = F.col("classes") + words
    return (
        scored.drop("cold")
        .join(met, "row", "left")
        .select(
            "doc_id",
            held_out().alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("times", F.lit(0))).alias("n_known"),
            F.lit(n_tokens).cast("long").alias("train_tokens"),
            (words - F.col("n_tokens") * per_token).alias("base_score"),
            total.alias("score"),
            F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
        )
    )


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
