"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every text becomes a short vector of statistics (``FEATURES``, counted over the
whole text).  Cosines of random projections approximate a Gaussian kernel; each
partition of the fit rows sums its part of the normal equations, the parts are
added on the driver (``FIT_PARTS`` matrices of ``WIDTH + 1`` squared) and solved
with a ridge.  A fifth of the labelled rows is kept out of that fit; the scores
of those rows are counted in bins and made monotone (pool adjacent violators),
which turns a score into the chance of label 1.  A thousandth of the raw score
is mixed in so that equal steps keep their order.

Labelled rows for the fit are bounded: at most ``FIT_ROWS``, by smallest id hash.
Statistics and scores cover every document.

Edge cases: null and empty texts have the statistics of an empty text; without
labels, or with labels of one kind only, every score is the share of label 1
(0.5 without labels); a doc_id labelled more than once takes the mean of its
labels, a tie counts as 1; a null doc_id cannot be labelled; repeated rows are
scored alike; texts of any length are read whole; an empty table gives an empty
result; columns but the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.llm.arrays import IS_SPACE, Chunk, chunks, mix64, spans, word_hashes
from nichelab.llm.common import hash_limit, stage, table

TRAIN_MOD, HELD_OUT = 3, 1
FIT_ROWS, FIT_PARTS = 200_000, 8
WIDTH, SIGMA, RIDGE, SEED = 384, 4.0, 1.0, 7
BINS = 2000
SYMBOLS = b"!|#$%&*"
FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_spread", "upper", "lower", "digit", "punctuation", "space", "high", "newline",
    *(f"symbol_{chr(c)}" for c in SYMBOLS), "distinct_words", "word_ends_in_symbol", "class_entropy", "log_line_words", "long_words",
)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % TRAIN_MOD == HELD_OUT, F.lit(False))


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    punct = ((b >= 0x21) & (b <= 0x2F)) | ((b >= 0x3A) & (b <= 0x40)) | ((b >= 0x5B) & (b <= 0x60)) | ((b >= 0x7B) & (b <= 0x7E))
    return {
        "upper": (b >= 0x41) & (b <= 0x5A),
        "lower": (b >= 0x61) & (b <= 0x7A),
        "digit": (b >= 0x30) & (b <= 0x39),
        "punctuation": punct,
        "space": IS_SPACE & (b != 0x0A),
        "high": b >= 0x80,
        "newline": b == 0x0A,
    }


CLASSES = _classes()


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of ``FEATURES`` per text of a chunk."""
    data, at = chunk.data, chunk.starts
    n_bytes = np.diff(at).astype(float)
    per_byte = np.maximum(n_bytes, 1)

    def count(of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(of, out=total[1:])
        return np.diff(total[at]).astype(float)

    shares = {k: count(v[data]) / per_byte for k, v in CLASSES.items()}
    symbols = [count(data == c) / per_byte for c in SYMBOLS]
    start, end, row = spans(chunk, ~IS_SPACE[data])
    length = (end - start).astype(float)
    words = np.bincount(row, minlength=chunk.n).astype(float)
    per_word = np.maximum(words, 1)
    mean = np.bincount(row, length, chunk.n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, chunk.n) / per_word - mean**2, 0))
    distinct = np.zeros(chunk.n)
    tail = np.zeros(chunk.n)
    long_words = np.zeros(chunk.n)
    if len(start):
        key = mix64(word_hashes(data, start, end) + mix64(row.astype(np.uint64) + np.uint64(1)))
        _, first = np.unique(key, return_index=True)
        distinct = np.bincount(row[first], minlength=chunk.n) / per_word
        tail = np.bincount(row, CLASSES["punctuation"][data[end - 1]], chunk.n) / per_word
        long_words = np.bincount(row, length >= 15, chunk.n) / per_word
    p = np.array([*shares.values(), *symbols])
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=0)
    lines = count(data == 0x0A) + 1
    cols = [np.log1p(n_bytes), np.log1p(words), mean, spread, *shares.values(), *symbols, distinct, tail, entropy, np.log1p(words / lines), long_words]
    return np.column_stack(cols)


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its statistics, one row per input row."""
    data = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                x = statistics(c)
                flat = pa.array(x.ravel())
                stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), stats], ["doc_id", "stats"])

    kind = data.schema["doc_id"].dataType.simpleString()
    return data.mapInArrow(run, f"doc_id {kind}, stats array<double>")


class Model:
    """Centre and scale of the statistics, projections, weights, and the calibration curve."""

    def __init__(self, centre, scale, project, phase, weights, curve_x, curve_y, constant=None):
        self.centre, self.scale, self.project, self.phase = centre, scale, project, phase
        self.weights, self.curve_x, self.curve_y, self.constant = weights, curve_x, curve_y, constant

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        waves = np.cos(z @ self.project + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.curve_x, self.curve_y) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of means ``y`` with weights ``n`` at increasing ``x``: block centres and block means."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """``stats`` from ``with_statistics``, ``labels``: doc_id and quality; held-out rows must be left out by the caller."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    limit = hash_limit(known, "doc_id", fit_rows)
    chosen = known.filter(F.xxhash64("doc_id") <= F.lit(limit))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    rows = stage(chosen.join(stats, "doc_id").select("y", part.alias("calibrate"), "stats", F.xxhash64("doc_id").alias("deal")), "quality-fit")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        return Model(*[None] * 7, constant=float(ones / n) if n else 0.5)
    each = [F.col("stats")[i] for i in range(len(FEATURES))]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    centre, scale = np.array(moments[: len(FEATURES)]), np.array(moments[len(FEATURES) :])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    project = rng.normal(size=(len(FEATURES), WIDTH)) / SIGMA
    phase = rng.uniform(0, 2 * np.pi, WIDTH)
    base = Model(centre, scale, project, phase, None, None, None)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's sums, a row per line of the equations: the line from its diagonal on, and the moment."""
        gram, moment, n_rows = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1), 0
        for batch in batches:
            z = base.features(_matrix(batch.column(1)))
            gram += z.T @ z
            moment += z.T @ batch.column(0).to_numpy()
            n_rows += batch.num_rows
        if n_rows:
            lines = [np.append(gram[i, i:], moment[i]) for i in range(WIDTH + 1)]
            part = np.full(WIDTH + 1, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1, dtype=np.int32)), pa.array(part), pa.array(lines)], ["line", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, sums_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[line] = totals.get(line, 0.0) + sums_.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["line", "sums"])

    # dealt and ordered by a hash of the id, so that the sums add in one order however the rows arrive
    dealt = rows.filter(~F.col("calibrate")).repartition(FIT_PARTS, "deal").sortWithinPartitions("deal", "stats")
    parts = dealt.select("y", "stats").mapInArrow(sums, "line int, part int, sums array<double>")
    added = parts.repartition(FIT_PARTS, "line").sortWithinPartitions("line", "part").select("line", "sums").mapInArrow(add, "line int, sums array<double>")
    # one matrix comes to the driver, however many partitions there are
    gram, moment = np.zeros((WIDTH + 1, WIDTH + 1)), np.zeros(WIDTH + 1)
    for line, values in added.collect():
        gram[line, line:] = gram[line:, line] = values[:-1]
        moment[line] = values[-1]
    base.weights = np.linalg.solve(gram + RIDGE * np.eye(WIDTH + 1), moment)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base.raw(_matrix(batch.column(1))))], ["y", "raw"])

    kept = rows.filter("calibrate").select("y", "stats").mapInArrow(scored, "y double, raw double")
    cell = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2))
    bins = kept.groupBy(cell.alias("cell")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    bins = bins.sort_values("cell")  # at most BINS + 1 rows
    if len(bins) and bins["y"].nunique() > 1:
        base.curve_x, base.curve_y = pool_adjacent(bins["x"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(float))
    else:  # too few rows to calibrate on
        base.curve_x, base.curve_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return base


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["doc_id", "held_out", "score"])

    data = stats.select("doc_id", held_out().alias("held_out"), "stats")
    kind = data.schema["doc_id"].dataType.simpleString()
    out = data.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    stats = stage(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out())
    return score(stats, fit(stats, labels))
