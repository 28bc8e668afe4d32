"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (1 to ``ORDER`` code points) of every
training document, per language; each task adds up its own matrix and Spark sums
them, so the counts cover all rows and the result has at most ``languages * BINS``
cells.  The smoothed log-probability matrix is broadcast and documents are
scored in numpy, a batch of texts at a time: the n-grams of all of them in one
array, one look-up in the matrix, sums by text (a long text goes by itself, in
slices that are summed, never cut).  More than ``MAX_LANGUAGES`` languages are cut into blocks:
one block at a time is counted, broadcast and scored, and Spark combines each
document's best score and sum of evidence over the blocks.

The score is the posterior of the chosen language at ``SHARPNESS`` evidence: the
mean log-likelihood per n-gram times ``SHARPNESS``, so that long and short
texts are on one scale and unsure texts score low.  It is a share among labels:
where one language goes by several names, these share it.  ``gain`` does not
depend on the names: the mean log-likelihood per n-gram in the chosen language
less that in the background, the model of all training text together.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and no gain; with
no training rows every text is ``und``; rows with a null lang do not train; a tie goes
to the language first by code point; repeated rows count as often as they stand
and are scored alike; very long texts are read whole, slice by slice; an empty
table gives an empty result; ``keep`` may hold columns of any names but the result's,
others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nichelab.llm.arrays import mix64
from nichelab.llm.common import stage, table

ORDER = 3
BINS = 1 << 15
SMOOTHING = 0.5
SHARPNESS = 60.0
#: Code points worked on at a time; n-grams times languages looked up at a time.
SLICE = 1 << 18
CELLS = 1 << 21
#: The matrix is broadcast; more languages than this (32 MB) go in blocks.
MAX_LANGUAGES = 128
UNKNOWN = "und"
TRAIN_MOD, HELD_OUT = 4, 2
#: A document that gains less in its language is in no known one: all training text together explains it better.
MIN_GAIN = -1.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % TRAIN_MOD == HELD_OUT, F.lit(False))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bins_of(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length the bins of the n-grams that end at each code point from the ``order``-th on, and the shorter ones before."""
    x = points.astype(np.uint64)
    found, total = [], np.zeros(len(x), np.uint64)
    for k in range(1, order + 1):
        if len(x) < k:
            break
        total = total[: len(x) - k + 1] * np.uint64(0x100000001B3) + x[k - 1 :] + np.uint64(k)
        found.append((mix64(total) & np.uint64(BINS - 1)).astype(np.int32))
    return found


def slices(text: str, order: int) -> Iterator[np.ndarray]:
    """The bins of a whole text in lower case, slice by slice; every n-gram falls into exactly one."""
    text = text.lower()
    for at in range(0, len(text), SLICE):
        body = code_points(text[at : at + SLICE + order - 1])
        more = len(body) - min(SLICE, len(text) - at)  # code points shared with the next slice
        for k, b in enumerate(bins_of(body, order), 1):
            yield b[: len(b) - max(0, more - (k - 1))] if more else b


def count_rows(languages: list[str], order: int):
    """Rows (lang, bin, n): the n-gram counts of one task."""
    index = {v: i for i, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BINS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                row = total[index[lang.as_py()]]
                for b in slices(text.as_py(), order):
                    row += np.bincount(b, minlength=BINS) if len(b) > BINS // 8 else 0
                    if len(b) <= BINS // 8:
                        np.add.at(row, b, 1)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[lang, cell])], ["lang", "bin", "n"]
        )

    return count


class Model:
    """Languages in code-point order and the log-probabilities, one row per bin; the last column is the background's."""

    def __init__(self, languages: list[str], weights: np.ndarray, order: int = ORDER):
        self.languages, self.weights, self.order = languages, weights, order


class BlockedModel:
    """More languages than one matrix holds: a block's matrix is learnt when it is asked for, so that one is held at a time."""

    def __init__(self, languages: list[str], rows: DataFrame, order: int = ORDER):
        self.languages, self.rows, self.order = languages, rows, order

    def blocks(self) -> Iterator[Model]:
        everything = counts(self.rows.withColumn("lang", F.lit("")), [""], self.order)
        for at in range(0, len(self.languages), MAX_LANGUAGES):
            block = self.languages[at : at + MAX_LANGUAGES]
            yield learn(counts(self.rows.filter(F.col("lang").isin(block)), block, self.order), everything, block, self.order)


def counts(rows: DataFrame, languages: list[str], order: int) -> np.ndarray:
    """How often each bin occurs in each of at most ``MAX_LANGUAGES`` languages, from rows in these languages."""
    counted = rows.mapInArrow(count_rows(languages, order), "lang int, bin int, n long")
    cells = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages * BINS rows
    total = np.zeros((BINS, len(languages)))
    total[cells["bin"].to_numpy(), cells["lang"].to_numpy()] = cells["n"].to_numpy()
    return total


def learn(total: np.ndarray, everything: np.ndarray, languages: list[str], order: int) -> Model:
    """The matrix of languages by their counts, with the background by the counts of all text."""
    smooth = np.concatenate([total, everything], axis=1) + SMOOTHING
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), order)


def train(rows: DataFrame, order: int = ORDER) -> Model | BlockedModel:
    """``rows``: text and lang, nulls left out.  Counts every row."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one name per language
    if not languages:
        return Model([], np.zeros((BINS, 1), np.float32), order)
    if len(languages) > MAX_LANGUAGES:
        return BlockedModel(languages, rows, order)
    total = counts(rows, languages, order)
    return learn(total, total.sum(axis=1, keepdims=True), languages, order)


def evidence(text: str, model: Model) -> np.ndarray:
    """The mean log-likelihood per n-gram in each language and the background, of one text in slices."""
    total, n = np.zeros(model.weights.shape[1]), 0
    for b in slices(text, model.order):
        if len(b) > BINS // 4:  # a long slice: count first, then one product
            total += np.bincount(b, minlength=BINS) @ model.weights
        else:
            total += model.weights[b].sum(axis=0, dtype=np.float64)
        n += len(b)
    return total / n


def batch_evidence(texts: list[str], model: Model) -> np.ndarray:
    """``evidence`` of several texts at once, a row each."""
    points = [code_points(t.lower()) for t in texts]
    lengths = np.array([len(p) for p in points])
    row = np.repeat(np.arange(len(texts)), lengths)
    total, n = np.zeros((len(texts), model.weights.shape[1])), np.zeros(len(texts), np.int64)
    for k, b in enumerate(bins_of(np.concatenate(points), model.order), 1):
        within = row[: len(b)] == row[k - 1 :]  # n-grams that do not reach into the next text
        per_row = np.maximum(lengths - (k - 1), 0)
        some = per_row > 0
        first = np.concatenate([[0], np.cumsum(per_row)[:-1]])[some]
        total[some] += np.add.reduceat(model.weights[b[within]], first, axis=0, dtype=np.float64)
        n += per_row
    return total / n[:, None]


def judge(texts: list[str | None], model: Model) -> tuple[list[int], np.ndarray]:
    """Which texts have a letter, and the ``evidence`` of these, a row each."""
    if not model.languages:
        return [], np.zeros((0, 1))
    wanted = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    most = min(SLICE, max(1, CELLS // model.weights.shape[1]))
    out = np.zeros((len(wanted), model.weights.shape[1]))
    group, size = [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            out[group] = batch_evidence([texts[wanted[j]] for j in group], model)
        group, size = [], 0

    for j, i in enumerate(wanted):
        if len(texts[i]) > most // 4:
            out[j] = evidence(texts[i], model)
            continue
        if size + len(texts[i]) > most:
            flush()
        group.append(j)
        size += len(texts[i])
    flush()
    return wanted, out


def score_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, float | None]]:
    """Language, score and gain of each text."""
    found: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
    wanted, means = judge(texts, model)
    own = means[:, :-1]
    best = own.argmax(axis=1) if len(wanted) else []
    for j, (i, k) in enumerate(zip(wanted, best, strict=True)):
        share = 1.0 / np.exp((own[j] - own[j, k]) * SHARPNESS).sum()
        found[i] = (model.languages[int(k)], float(share), float(own[j, k] - means[j, -1]))
    return found


def predict_blocks(docs: DataFrame, model: BlockedModel, keep: list[str], text: str) -> DataFrame:
    """As ``predict``, one block of languages at a time."""
    spark = docs.sparkSession
    rows = stage(docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    found = None
    for block in model.blocks():
        shared = spark.sparkContext.broadcast((block.languages, block.weights, block.order))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Model(*shared.value)
            for batch in batches:
                wanted, means = judge(batch.column(1).to_pylist(), known)
                own = means[:, :-1] * SHARPNESS
                best = own.argmax(axis=1) if len(wanted) else np.zeros(0, np.int64)
                top = own[np.arange(len(wanted)), best]
                cols = [
                    batch.column(0).take(pa.array(wanted, pa.int64())),
                    pa.array([known.languages[k] for k in best], pa.string()),
                    pa.array(top, pa.float64()),
                    pa.array(np.exp(own - top[:, None]).sum(axis=1), pa.float64()),
                    pa.array(top / SHARPNESS - means[:, -1], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["row", "lang", "best", "total", "gain"])

        part = stage(rows.select("row", "text").mapInArrow(score, "row long, lang string, best double, total double, gain double"), "scores")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    # the best of all blocks, a tie (up to rounding) to the language first by code point; the blocks' sums are taken to its scale
    top = F.min(F.struct(F.round(-F.col("best"), 9).alias("minus"), "lang", "gain"))
    per_row = found.groupBy("row").agg(top.alias("top"), F.collect_list(F.struct("best", "total")).alias("parts"))  # one per block
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["total"] * F.exp(p["best"] + F.col("top.minus")))
    judged = per_row.select("row", "top", (F.lit(1.0) / total).alias("share"))
    return rows.join(judged, "row", "left").select(
        "kept.*", F.coalesce("top.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("share", F.lit(0.0)).alias("score"), F.col("top.gain").alias("gain")
    )


def predict(docs: DataFrame, model: Model | BlockedModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns (taken as they are), lang_pred, score and gain, one row per input row."""
    if isinstance(model, BlockedModel):
        return predict_blocks(docs, model, keep, text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.order))
    data = docs.select(*keep, F.col(text).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            found = score_texts(batch.column(batch.num_columns - 1).to_pylist(), known)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            kinds = [pa.string(), pa.float64(), pa.float64()]
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols, *more], [*keep, "lang_pred", "score", "gain"])

    fields = [*data.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType())]
    return data.mapInArrow(score, T.StructType(fields))


def fit(docs: DataFrame) -> Model | BlockedModel:
    """The model of the query: learnt from text and lang of the rows that are not held out."""
    return train(docs.filter(~held_out()).select("text", "lang"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
