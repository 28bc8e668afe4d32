"""Substring dedup: words in passages of ``SPAN`` words that a document with a smaller doc_id has too.

Sharding by content: the window of ``SPAN`` words at each place is represented
by the smallest hash of its runs of ``GRAM`` words.  Equal windows have equal
representatives, so windows can only match within a representative.  Those that
one document alone has are done with; a task first compares the documents it has
at hand, so that a representative in a third of all documents is not one task's.
Of the others, consecutive windows with one representative make a segment of text;
equal segments are counted once (with their smallest doc_id), and segments go to
shards by representative.

Each shard builds an FM-index over its segments (``fmindex``: BWT in a wavelet
matrix) and streams the segments' windows against it by backward search; the
matching statistics that reach ``SPAN`` yield the suffix interval, and with it
the smallest doc_id that has the window.  Every document then drops the words
covered by windows that some smaller doc_id has.

There is a shard for every ``SHARD_SEGMENTS`` segments (before equal ones are
counted once), so their number grows with the input; a passage that a third of
all documents repeat is one segment.  A representative with more than
``1 / HOT_SHARE`` of a shard's segments, all distinct (such a passage in ever
different surroundings), goes to no shard: its segments are cut into their
windows, which are dealt out and counted by the window as a whole, so an index
fits a task whatever the texts share.  Texts travel compressed.

Edge cases: null and empty texts have no words; a null doc_id neither loses words
nor takes them from others; rows that share a doc_id do not affect one another;
fewer than ``SPAN`` words make no window; of rows that tie for the smallest
doc_id each keeps its words; texts of any length are read whole, a row at a time;
an empty table gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.arrays import IS_SPACE, Chunk, chunks, gram_hashes, mix64, spans, word_hashes
from nichelab.llm.common import stage, table
from nichelab.llm.fmindex import ShardIndex

SPAN, GRAM = 13, 5
SHARD_SEGMENTS = 120_000
HOT_SHARE = 10
#: Representatives that a task compares before they are dealt.
PRINTS = 1 << 20
#: Windows searched at a time.
QUERIES = 1 << 18
ROWS = "doc_id long, tag long, n_words long, sha string, packed binary, print long, seg_id long, start int, seg binary"


def window_prints(chunk: Chunk, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representative of the window at each word where a window begins, the word's index, and its row."""
    start, end, row = spans(chunk, ~IS_SPACE[chunk.data])
    grams, at = gram_hashes(word_hashes(chunk.data, start, end), row, gram)
    whole = np.flatnonzero(row[: max(0, len(row) - span + 1)] == row[span - 1 :]) if len(row) >= span else np.zeros(0, np.int64)
    if not len(whole):
        return np.zeros(0, np.uint64), whole, whole
    every = np.full(len(row), np.iinfo(np.uint64).max, np.uint64)
    every[at] = grams
    least = every[whole]
    for j in range(1, span - gram + 1):
        least = np.minimum(least, every[whole + j])
    return least, whole, row[whole]


def _print_rows(span: int, gram: int):
    """The representatives of each document's windows.

    Of the documents that a task has at hand with one representative, those between
    the smallest and the largest doc_id surely share it.  They get a salt, so that
    only two of them are compared with other tasks' documents.
    """

    def settled(prints: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((docs, prints))
        prints, docs = prints[order], docs[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (docs[1:] != docs[:-1])
        prints, docs = prints[new], docs[new]
        first, last = np.ones(len(prints), bool), np.ones(len(prints), bool)
        first[1:] = last[:-1] = prints[1:] != prints[:-1]
        spread = (mix64(docs.view(np.uint64)) >> np.uint64(34)).astype(np.int32) + 1
        salt = np.where(first | last, 0, spread).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(docs), pa.array(salt)], ["print", "doc_id", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                prints, _, row = window_prints(c, span, gram)
                if not len(prints):
                    continue
                # neighbouring windows mostly share a representative
                new = np.ones(len(prints), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
                held.append((prints[new], ids[c.first + row[new]]))
                size += int(new.sum())
                if size >= PRINTS:
                    yield settled(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield settled(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, a hash that tells texts apart, and the compressed text."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
        tags = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags), pa.array([squeeze.compress(r) for r in raw], pa.binary())], ["doc_id", "tag", "packed"])


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _segment_rows(span: int, gram: int):
    """For each document a row with its words' number and digest (and text, if it shares anything), and a row per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        open_ = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                doc, tag, packed, shared = (batch.column(j)[i] for j in range(4))
                raw = open_.decompress(packed.as_py())
                words = raw.split()
                known = shared.values.to_numpy() if shared.is_valid else None
                rows.append((doc.as_py(), tag.as_py(), len(words), digest(words), packed.as_py() if known is not None else None, None, None, None, None))
                size += 200
                if known is not None:
                    size += len(packed.as_py())
                    data = np.frombuffer(raw, np.uint8)
                    prints, _, _ = window_prints(Chunk(0, 1, data, np.array([0, len(data)])), span, gram)
                    prints = prints.view(np.int64)
                    inside = np.isin(prints, known)
                    edge = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
                    for a, b in zip(edge, np.append(edge[1:], len(prints)), strict=True):
                        if inside[a]:
                            seg = b" ".join(words[a : b + span - 1])
                            seg_id = xxhash.xxh3_64_intdigest(seg) - (1 << 63)
                            rows.append((doc.as_py(), tag.as_py(), None, None, None, int(prints[a]), seg_id, int(a), seg))
                            size += len(seg) + 100
                if size > 1 << 22:
                    yield flush()
                    rows, size = [], 0
        yield flush()

    return run


def _shard_rows(span: int):
    """All rows of a partition are one shard: index its segments and search all their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        prints, ids, docs = (np.concatenate([b.column(j).to_numpy() for b in got]) for j in (0, 1, 3))
        # a window can only stand in segments of its representative: where there is one segment, nothing else has its windows
        _, group, count = np.unique(prints, return_inverse=True, return_counts=True)
        alone = count[group] == 1
        segs = [s for b in got for s in b.column(2)]
        del got
        if alone.any():
            n = np.array([segs[i].as_py().count(b" ") for i in np.flatnonzero(alone)]) + 2 - span
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.repeat(docs[alone], n)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[alone]), pa.array(ids[alone]), lists], ["print", "seg_id", "least"])
        if alone.all():
            return
        words = [segs[i].as_py().split(b" ") for i in np.flatnonzero(~alone)]
        del segs
        prints, ids, docs = prints[~alone], ids[~alone], docs[~alone]
        length = np.array([len(w) for w in words])
        coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        del words
        n_symbols = len(coded.dictionary) + 1
        first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        text = np.zeros(int(length.sum()) + len(length), np.int64)
        owner = np.repeat(np.arange(len(length)), length)
        text[np.arange(len(owner)) + owner] = coded.indices.to_numpy().astype(np.int64) + 1
        index = ShardIndex(text, n_symbols, np.repeat(docs, length + 1), span)
        n_windows = length - span + 1
        of = np.repeat(np.arange(len(length)), n_windows)
        ends = np.cumsum(n_windows)
        at = first[of] + np.arange(len(of)) - (ends - n_windows)[of]
        least = np.concatenate([index.search(text, at[i : i + QUERIES], span)[1] for i in range(0, len(at), QUERIES)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(least))
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(ids), lists], ["print", "seg_id", "least"])

    return run


def _window_rows(span: int):
    """For each segment a row per distinct window: where it begins in the segment, and its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["print", "seg_id", "doc_id", "at", "gram"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for mark, seg_id, seg, doc in zip(*batch.columns, strict=True):
                words = seg.as_py().split(b" ")
                places: dict[bytes, list[int]] = {}
                for i in range(len(words) - span + 1):
                    places.setdefault(xxhash.xxh3_128_digest(b" ".join(words[i : i + span])), []).append(i)
                rows += [(mark.as_py(), seg_id.as_py(), doc.as_py(), at, gram) for gram, at in places.items()]
                if len(rows) > 1 << 15:
                    yield flush()
                    rows = []
        yield flush()

    return run


def least_by_window(segments: DataFrame, span: int) -> DataFrame:
    """(print, seg_id, least) as the shards give it, without gathering segments: equal windows of all segments are counted together."""
    windows = stage(segments.mapInArrow(_window_rows(span), "print long, seg_id long, doc_id long, at array<int>, gram binary"), "windows")
    # staged, so that the join sees two plain inputs and a window that very many segments have is split
    known = stage(windows.groupBy("gram").agg(F.min("doc_id").alias("value")), "known")
    found = F.transform("at", lambda i: F.struct(i.alias("i"), F.col("value")))
    per_segment = windows.join(known, "gram").groupBy("print", "seg_id").agg(F.sort_array(F.flatten(F.collect_list(found))).alias("found"))
    return per_segment.select("print", "seg_id", F.transform("found", lambda x: x["value"]).alias("least"))  # a segment's own windows


def _kept_rows():
    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, n_words, sha, packed, runs = batch.columns
            removed, digests = np.zeros(batch.num_rows, np.int64), sha.to_pylist()
            for i in range(batch.num_rows):
                if not runs[i].is_valid:
                    continue
                words = open_.decompress(packed[i].as_py()).split()
                edges = np.zeros(len(words) + 1, np.int64)
                for run in runs[i].as_py():
                    half = len(run) // 2
                    for a, b in zip(run[:half], run[half:], strict=True):
                        edges[a] += 1
                        edges[b] -= 1
                covered = np.cumsum(edges)[:-1] > 0
                removed[i] = covered.sum()
                digests[i] = digest([w for w, c in zip(words, covered, strict=True) if not c])
            yield pa.RecordBatch.from_arrays([doc, n_words, pa.array(removed), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run_rows


def repeated_windows(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, tag, n_words, sha, packed) and, for those that repeat anything, the words to remove
    (doc_id, tag, runs: per segment the first words of its runs, then their ends)."""
    spark = docs.sparkSession
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_print = W.partitionBy("print", "salt")
    prints = data.filter("doc_id IS NOT NULL").mapInArrow(_print_rows(span, gram), "print long, doc_id long, salt int")
    shared = (
        prints.repartition("print", "salt")
        .select("print", "salt", "doc_id", F.min("doc_id").over(by_print).alias("a"), F.max("doc_id").over(by_print).alias("z"))
        .filter("salt <> 0 OR a < z")
    )
    per_doc = shared.groupBy("doc_id").agg(F.collect_set("print").alias("prints"))  # at most a document's own windows
    packed = data.mapInArrow(_pack, "doc_id long, tag long, packed binary")
    rows = packed.join(per_doc, "doc_id", "left").select("doc_id", "tag", "packed", "prints").mapInArrow(_segment_rows(span, gram), ROWS)
    rows = stage(rows, "segments")
    segs = rows.filter("print IS NOT NULL")
    distinct = segs.groupBy("print", "seg_id", "seg").agg(F.min("doc_id").alias("doc_id"))
    n_shards = max(1, -(-segs.count() // SHARD_SEGMENTS))
    distinct = distinct.select("print", "seg_id", "seg", "doc_id")
    per_print = segs.groupBy("print").agg(F.count_distinct("seg_id").alias("n"))
    hot = stage(per_print.filter(F.col("n") > SHARD_SEGMENTS // HOT_SHARE).select("print"), "hot")
    any_hot = not hot.isEmpty()
    rest = distinct.join(hot, "print", "left_anti") if any_hot else distinct
    shards = rest.repartition(n_shards, "print")
    least = stage(shards.mapInArrow(_shard_rows(span), "print long, seg_id long, least array<long>"), "least")
    if any_hot:
        least = least.unionByName(stage(least_by_window(distinct.join(hot, "print", "left_semi"), span), "least"))
    # runs of neighbouring windows to remove, as first word and end: usually one per segment
    taken = lambda j: F.coalesce(F.get("least", j) < F.col("doc_id"), F.lit(False))
    first = F.transform("least", lambda x, j: F.when(taken(j) & ~taken(j - 1), F.col("start") + j))
    end = F.transform("least", lambda x, j: F.when(taken(j) & ~taken(j + 1), F.col("start") + j + span))
    hit = F.array_compact(F.concat(first, end))
    members = segs.select("print", "seg_id", "doc_id", "tag", "start").join(least, ["print", "seg_id"])
    starts = members.select("doc_id", "tag", hit.alias("hit")).filter(F.size("hit") > 0)
    starts = starts.groupBy("doc_id", "tag").agg(F.collect_list("hit").alias("runs"))  # at most a document's own windows
    return rows.filter("print IS NULL").select("doc_id", "tag", "n_words", "sha", "packed"), starts


def substring_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space)."""
    whole, starts = repeated_windows(docs, span, gram)
    both = whole.join(starts, ["doc_id", "tag"], "left").select("doc_id", "n_words", "sha", "packed", "runs")
    return both.mapInArrow(_kept_rows(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 13)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
h AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM f) GROUP BY r),
e AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE r IN (SELECT r FROM h)),
k AS (
  SELECT e.r, string_agg(x, ' ' ORDER BY e.p) AS kept
  FROM e ANTI JOIN (SELECT r, unnest(gone) AS p FROM h) q ON e.r = q.r AND e.p = q.p GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
