"""Near-duplicate join: Jaccard similarity of word shingles, by universe partitioning and pigeonhole.

Two sets of ``x <= y`` shingles with Jaccard similarity of ``SHARE`` or more differ in
at most ``(x + y) / 7`` shingles (for 3/4).  Sets are put into size bands
(``2**(b-1) < n <= 2**b``); a pair lies in one band, or in two neighbouring ones,
and then meets in the lower.  Every band cuts the universe of shingles into
``m`` segments by hash, and a set into ``m`` subsets.  At most ``H`` segments can
differ, so the others have equal subsets: a signature (hash of band, segment,
subset) in common.

Allocation, band by band, by cost (rows indexed, and chance matches expected
from the subsets' sizes): either the exact subsets of ``H + extra`` segments, or
fewer segments with their one-deletion neighbourhoods, where a segment that
differs in a single shingle still meets, so that each counts twice.

Allocation, set by set, by measured cost: the number of sets with each signature
is counted over all rows, and every set keeps its ``H + 1`` least frequent ones
(ties by value, empty subsets last).  At most ``H`` of a set's signatures are not
its partner's, so the least frequent common one is always among what both keep.
Passages that many documents share make frequent signatures, which is what is
given up.  A set that has to keep a signature of more than ``FREQUENT`` sets is,
for those, partitioned as finely as can be, a segment per shingle, where it
gives up all but a quarter of its shingles and one: a similar pair whose least
frequent common signature is a frequent one consists of two such sets, each with
at most a quarter of its shingles missing in the other, and meets there.

Where a signature stands in the order of its set also bounds the sizes of the
partners that may meet there first: a pair of sizes ``x`` and ``y`` only counts
as met where the signature is among the first ``H(x, y) + 1`` of both sets.

Candidates are verified on the shingles themselves.  Pairs are never listed
within a group: the sets with a signature are compared with a leader, what is
linked becomes one component, and only signatures that still join different
components go on, with more leaders in each round, until none is left.

Edge cases: a text without words has an empty set and no links; fewer than
``WIDTH`` words are one shingle; rows that share a doc_id count as linked; a null
doc_id gets its count, a null component and no links; texts of any length are one
set; empty tables give an empty result; columns but the id and the text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.arrays import IS_SPACE, LOWER, Chunk, chunks, gram_hashes, mix64, spans, word_hashes
from nichelab.llm.common import discard, stage, table
from nichelab.llm.components import components

WIDTH = 5
#: The least similarity, as a fraction.
SHARE = (75, 100)
#: Cost model: a shingle is shared by chance with this share of CROWD comparable sets.
CHANCE, CROWD = 0.008, 1000.0
#: Spare segments, as a share of H + 1: what a set may give up.
SPARE_SEGMENTS = 0.6
#: A signature of more sets than this is not searched; its sets meet in the finest partition.
FREQUENT = 16
#: Leaders per signature in the first round; each round has LEADER_STEP times as many.
LEADERS, LEADER_STEP = 2, 4
#: A leader with more partners than this is copied to several tasks.
PARTNERS_PER_TASK = 4000


class Band:
    """How one size band is cut: segments, and weight (1: exact subsets, 2: with deletions)."""

    def __init__(self, b: int, share: tuple[int, int] = SHARE):
        num, den = share
        self.b, self.top = b, 1 << b
        self.most = most_different(self.top, self.top * den // num, share)
        need = self.most + 1
        exact_m = need + int(need * SPARE_SEGMENTS)
        delete_m = -(-need // 2)
        n = 0.75 * self.top if self.top > 1 else 1.0
        exact = need * (1 + CROWD * CHANCE ** (n / exact_m))
        delete = (delete_m + n) * (1 + CROWD * CHANCE ** max(n / delete_m - 1, 0))
        self.weight = 2 if delete < exact and need > 1 else 1
        self.segments = delete_m if self.weight == 2 else exact_m


def most_different(x: int, y: int, share: tuple[int, int] = SHARE) -> int:
    """The largest symmetric difference of sets of sizes x and y with Jaccard similarity of ``share`` or more."""
    num, den = share
    return (x + y) * (den - num) // (den + num)


def shingles(chunk: Chunk, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by row, their rows, and the number per row."""
    data = LOWER[chunk.data]
    start, end, row = spans(chunk, ~IS_SPACE[data])
    words = word_hashes(data, start, end)
    grams, at = gram_hashes(words, row, width)
    rows = row[at]
    n_words = np.bincount(row, minlength=chunk.n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        whole = []
        for r in few:
            total = np.uint64(n_words[r])
            with np.errstate(over="ignore"):
                for w in words[first[r] : first[r + 1]]:
                    total = total * np.uint64(0xD6E8FEB86659FD93) + w
            whole.append(total)
        grams, rows = np.concatenate([grams, mix64(np.array(whole, np.uint64))]), np.concatenate([rows, few])
    # one sort key: the row, then as much of the hash as fits; equality below is that of whole hashes
    order = np.argsort((rows.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, rows, np.bincount(rows, minlength=chunk.n)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of consecutive runs of ``values``."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


EMPTY = np.uint64(1 << 63)


def signatures(grams: np.ndarray, counts: np.ndarray, band: Band, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of some sets in a band, the sets' indexes, and per set how many signatures it may give up.

    ``partner`` is the largest partner's size per set.  The highest bit marks the
    signature of an empty subset; such are only listed where a set has too few others.
    """
    n_sets, m = len(counts), band.segments
    owner = np.repeat(np.arange(n_sets), counts)
    seed = np.uint64((band.b * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
    segment = (mix64(grams ^ seed) % np.uint64(m)).astype(np.int64)
    cell = owner * m + segment
    value = mix64(grams + seed)
    low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), n_sets * m).astype(np.uint64)
    high = np.bincount(cell, (value >> np.uint64(32)).astype(float), n_sets * m).astype(np.uint64)
    total = low + (high << np.uint64(32))
    size = np.bincount(cell, minlength=n_sets * m)
    place = np.tile(mix64(np.arange(m, dtype=np.uint64) ^ mix64(np.array([seed]))), n_sets)

    def sign(sums: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = mix64(sums ^ at) & ~EMPTY
        return np.where(left > 0, s, mix64(at) | EMPTY)

    exact = sign(total, size, place)
    owners = np.repeat(np.arange(n_sets), m)
    most = (counts + partner) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])
    if band.weight == 2:
        without = sign(total[cell] - value, size[cell] - 1, place[cell])
        sig, own = np.concatenate([exact, without]), np.concatenate([owners, owner])
        blocked = 2 * np.bincount(owners, size <= 1, n_sets)
        keep = (sig < EMPTY) | (blocked > 2 * m - most - 1)[own]
        return sig[keep], own[keep], np.zeros(n_sets, np.int64)
    filled = np.bincount(owners, size > 0, n_sets).astype(np.int64)
    keep = size > 0
    for r in np.flatnonzero(filled <= most):  # the first empty ones, to make up most + 1
        empty = r * m + np.flatnonzero(size[r * m : (r + 1) * m] == 0)
        keep[empty[np.argsort(exact[empty])[: most[r] + 1 - filled[r]]]] = True
    return exact[keep], owners[keep], np.maximum(filled - most - 1, 0)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles and two 64-bit sums that identify the set."""
    for batch in batches:
        for c in chunks(batch.column(1)):
            grams, _, counts = shingles(c)
            one, two = row_sums(mix64(grams + np.uint64(1)), counts), row_sums(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), counts)
            cols = [batch.column(0).slice(c.first, c.n), pa.array(counts.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_a", "set_b"])


def _fine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same columns for the finest partition, from compressed texts: a signature per shingle."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = pa.array([open_.decompress(t.as_py()) for t in batch.column(1)], pa.large_binary()).view(pa.large_string())
        for c in chunks(texts):
            grams, rows, counts = shingles(c)
            sig = mix64(grams ^ np.uint64(0xC2B2AE3D27D4EB4F)) & ~EMPTY
            need = -(-counts * SHARE[0] // SHARE[1])  # shingles in common with any similar set, at least
            meta = (2 * np.maximum(need - 1, 0)).astype(np.int32)
            cols = [pa.array(sig.view(np.int64)), pa.array(ids[c.first + rows]), pa.array(meta[rows]), pa.array(counts.astype(np.int32)[rows])]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "doc_id", "meta", "total"])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, doc_id, meta (twice the signatures that the set may give up, plus 1 for the band below its own) and
    total (how many filled subsets the set has in the band; 0 where their order says nothing)."""
    bands: dict[int, Band] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for c in chunks(batch.column(1)):
            grams, rows, counts = shingles(c)
            own = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
            wanted = counts > 0
            for b in np.unique(own[wanted]):
                for lower in (0, 1):
                    if b - lower < 0:
                        continue
                    band = bands.setdefault(b - lower, Band(int(b - lower)))
                    chosen = wanted & (own == b)
                    if lower:
                        chosen &= counts * SHARE[0] <= band.top * SHARE[1]
                    sets = np.flatnonzero(chosen)
                    if not len(sets):
                        continue
                    partner = np.full(len(sets), band.top) if lower else counts[sets] * SHARE[1] // SHARE[0]
                    sig, index, spare = signatures(grams[chosen[rows]], counts[sets], band, partner)
                    meta = (2 * spare + lower).astype(np.int32)[index]
                    filled = np.bincount(index[sig < EMPTY], minlength=len(sets)) if band.weight == 1 else np.zeros(len(sets))
                    total = filled.astype(np.int32)[index]
                    doc = ids[c.first + sets[index]]
                    cols = [pa.array(sig.view(np.int64)), pa.array(doc), pa.array(meta), pa.array(total)]
                    yield pa.RecordBatch.from_arrays(cols, ["sig", "doc_id", "meta", "total"])


def shingle_set(text: bytes, width: int = WIDTH) -> set[bytes]:
    words = text.translate(LOWER.tobytes()).split()
    if 0 < len(words) < width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def similar(a: set, b: set, share: tuple[int, int] = SHARE) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or share[1] * small < share[0] * large:
        return False
    both = len(a & b)
    return share[1] * both >= share[0] * (small + large - both)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [squeeze.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "packed"])


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b), the leader's own first (b null): yields the linked (a, b)."""
    leader, sets = None, []
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        found: list[tuple[int, int]] = []
        for a, salt, b, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (a, salt) != leader:
                leader, sets = (a, salt), []
            own = shingle_set(open_.decompress(packed))
            if b is None:
                sets.append(own)
            elif any(similar(s, own) for s in sets):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar.  ``texts``: node, packed.

    A leader's set is built once per task and its partners stream past; a
    leader with very many partners is dealt to several tasks.
    """
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(n, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS_PER_TASK)).cast("int"))
    salted = stage(salted.select("a", "salt", "b"), "pairs")
    leaders = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node"))
    partners = salted.join(texts, F.col("b") == F.col("node"))
    rows = leaders.select("a", "salt", F.lit(None).cast("long").alias("b"), "packed").unionAll(partners.select("a", "salt", "b", "packed"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify_rows, "a long, b long").distinct()


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    data = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = stage(data.mapInArrow(_set_rows, "doc_id long, n_shingles long, set_a long, set_b long"), "sets")
    filled = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "set_a", "set_b"]
    member = stage(
        filled.join(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")), key).select("doc_id", "rep", "n_shingles").distinct(), "members"
    )
    comps = link_classes(data.filter("doc_id IS NOT NULL"), member)
    of = member.select("doc_id", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    return sets.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def index_rows(rows: DataFrame, member: DataFrame) -> DataFrame:
    """sig, node, n, size and place: the signatures that each class keeps, of those that several documents have; how
    many have them, the set's size, and the signature's place among the set's, from the least frequent on.

    The one large exchange is by signature.  A third of all documents with one
    near copy are spread over the hundreds of signatures of their sets.
    """
    rows = rows.repartition("sig")
    counted = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("sig"))).filter("n > 1").repartition("doc_id")
    # a class is indexed by the document that stands for it
    reps = member.filter("doc_id = rep").groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("n_shingles")).alias("size"))
    empty = F.col("sig") < 0  # listed only by sets that give up nothing
    cost = W.partitionBy("doc_id", "meta", empty).orderBy(F.desc("n"), F.desc("sig"))
    ranked = counted.join(reps, "doc_id").withColumn("rank", F.row_number().over(cost))
    # rows that share a doc_id may repeat a signature
    kept = ranked.filter(F.col("rank") > F.shiftright("meta", 1))
    place = F.when(F.col("size").isNotNull() & ~empty, F.col("total") - F.col("rank") + 1).otherwise(0)
    return kept.select("sig", F.col("doc_id").alias("node"), "n", "size", place.alias("place")).dropDuplicates(["node", "sig"])


def may_meet(a: str, b: str) -> Column:
    """Whether two sets that share a signature can be similar and have no less frequent one in common.

    Unknown sizes (several texts under one doc_id) pass, and so do places of 0 or
    less (empty subsets, deletion neighbourhoods).
    """
    num, den = SHARE
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    p, q = F.col(f"{a}.place"), F.col(f"{b}.place")
    most = F.floor((x + y) * (den - num) / (den + num))
    need = F.ceil((x + y) * num / (den + num))
    coarse = F.greatest(p, q) <= most + 1
    fine = (p <= x - need + 1) & (q <= y - need + 1)
    sizes = F.least(x, y) * den >= F.greatest(x, y) * num
    return F.coalesce(sizes & F.when(F.col(f"{a}.fine"), fine).otherwise(coarse), F.lit(True))


def link_classes(data: DataFrame, member: DataFrame) -> DataFrame:
    """Components (node, comp) of the classes of equal sets, each standing for its smallest doc_id."""
    signed = "sig long, doc_id long, meta int, total int"
    coarse = stage(index_rows(data.mapInArrow(_signature_rows, signed), member), "coarse")
    # rows that share a doc_id are linked through it
    lowest = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = member.join(lowest, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    nodes = coarse.groupBy("node").agg(F.max(F.col("n") > FREQUENT).alias("frequent"))
    packed = data.mapInArrow(_pack, "doc_id long, packed binary")  # texts travel compressed
    texts = stage(packed.join(nodes, F.col("doc_id") == F.col("node")).select("node", "packed", "frequent"), "texts")
    fine = texts.filter("frequent").select(F.col("node").alias("doc_id"), "packed")
    fine = index_rows(fine.mapInArrow(_fine_rows, signed), member)
    columns = ["sig", "node", "size", "place"]
    few = coarse.filter(F.col("n") <= FREQUENT).select(*columns, F.lit(False).alias("fine"))
    index = stage(few.unionAll(fine.select(*columns, F.lit(True).alias("fine"))), "index")
    columns.append("fine")
    texts = texts.select("node", "packed")

    # first the leader with which a set shares most signatures
    leader = index.groupBy("sig").agg(F.min_by(F.struct(*columns), "node").alias("l"), F.max("node").alias("z")).filter("l.node <> z").select("l.*")
    # a table, not an aggregate above its exchange: then adaptive execution splits the rows of a frequent signature
    leader = stage(leader, "leader")
    met = index.alias("i").join(leader.alias("l"), (F.col("i.sig") == F.col("l.sig")) & (F.col("i.node") != F.col("l.node")) & may_meet("i", "l"))
    shared = met.groupBy(F.col("l.node").alias("a"), F.col("i.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    tested = stage(best, "tested")
    discard(leader)
    comps = stage(components(links.unionAll(verify(tested, texts))), "components")

    leaders = LEADERS
    while True:
        known = index.join(comps, "node", "left").select(*columns, F.coalesce("comp", "node").alias("comp"))
        mixed = stage(known.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).filter("a <> z").select("sig"), "mixed")
        index = stage(known.join(mixed, "sig", "left_semi"), "index")
        discard(mixed)
        if index.isEmpty():
            return comps
        top = index.withColumn("rank", F.row_number().over(W.partitionBy("sig").orderBy("node"))).filter(F.col("rank") <= leaders)
        top = stage(top.select(*columns, "comp"), "leaders")
        met = (F.col("i.sig") == F.col("t.sig")) & (F.col("i.comp") != F.col("t.comp")) & may_meet("i", "t")
        pairs = index.alias("i").join(top.alias("t"), met)
        pairs = pairs.select(F.least("i.node", "t.node").alias("a"), F.greatest("i.node", "t.node").alias("b")).distinct()
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        # a leader has met everyone with its signature
        index = index.join(top.select("sig", "node"), ["sig", "node"], "left_anti").select(*columns)
        tested = tested.unionAll(pairs)
        new = stage(verify(pairs, texts), "links")
        if not new.isEmpty():
            of = lambda c: F.coalesce(F.col(f"{c}.comp"), F.col(f"e.{c}"))
            joined = new.alias("e").join(comps.alias("a"), F.col("e.a") == F.col("a.node"), "left").join(comps.alias("b"), F.col("e.b") == F.col("b.node"), "left")
            merged = components(joined.select(of("a").alias("a"), of("b").alias("b")))
            moved = comps.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
            fresh = merged.join(comps.select("node"), "node", "left_anti")
            comps = stage(moved.select("node", F.coalesce("to", "comp").alias("comp")).unionAll(fresh.select("node", "comp")), "components")
        leaders *= LEADER_STEP


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT r, md5(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
-- equal sets are one class; pairs are sought between the classes' first rows
c AS (SELECT min(r) OVER (PARTITION BY k) AS c, r FROM (SELECT r, md5(string_agg(g, '' ORDER BY g)) AS k FROM s GROUP BY r)),
o AS (SELECT g, count(*) AS f FROM s JOIN c USING (r) WHERE c.c = c.r GROUP BY g),
-- a linked set shares three quarters of its shingles: one of the rarest quarter and one more is shared
p AS (
  SELECT r, g, n FROM (SELECT r, g, n, row_number() OVER (PARTITION BY r ORDER BY f, g) AS place FROM s JOIN c USING (r) JOIN n USING (r) JOIN o USING (g) WHERE c.c = c.r)
  WHERE place <= n - (3 * n + 3) // 4 + 1),
x AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.g = b.g AND a.r < b.r AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
y AS (SELECT a, b, count(*) AS same FROM x JOIN s u ON u.r = a JOIN s v ON v.r = b AND v.g = u.g GROUP BY a, b),
l AS (SELECT a, b FROM y JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * same >= 75 * (p.n + q.n - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT c AS v, c AS u FROM c UNION SELECT walk.v, e.b FROM walk JOIN e ON e.a = walk.u),
m AS (SELECT v AS c, min(doc_id) AS least FROM walk JOIN c ON c.c = walk.u JOIN d USING (r) GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN m ON m.c = c.c
"""
