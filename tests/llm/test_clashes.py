"""Extra columns whose names the operators use themselves change nothing; very long texts are taken whole."""

import zlib

import brute
import pytest
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401
from pyspark.sql import functions as F

from nichelab.llm import decontaminate, exact, fmindex, jaccard, langid, license, mixing, quality, secrets, substring

CLASHES = """words h f10 hits tag n runs print seg_id start least block name keep_id group_size kept text_sha256 stats y score spans first_word
sig node size place comp part _row _text row order_hash piece before target position cap weight rank no_source""".split()


def models(docs):
    model = langid.train(docs)
    return langid.predict(docs, model, ["doc_id"])


def scored(docs):
    stats = quality.with_statistics(docs)
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    return quality.score(stats, quality.fit(stats, labels)).withColumn("score", F.round("score", 6))


OPERATORS = {
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.filter("doc_id < 3").withColumnRenamed("doc_id", "item_id")),
    "substring": substring.substring_dedup,
    "exact": exact.exact_dedup,
    "quality": scored,
    "license": license.scan,
    "secrets": secrets.scan,
    "jaccard": jaccard.near_components,
    "langid": models,
    "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(docs_frame, odd_rows, name):  # noqa: F811
    docs = docs_frame([r for r in odd_rows if r[0] is None or r[0] < 60])
    more = docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    same([map(str, r) for r in OPERATORS[name](more).collect()], [map(str, r) for r in OPERATORS[name](docs).collect()])


def test_very_long_texts(docs_frame):  # noqa: F811
    """A million words with the finds at the very end."""
    long = "plain words here " * 330_000
    rows = [(1, long + "under the mit license"), (2, long + "token = abcdef123456"), (3, "short")]
    docs = docs_frame(rows)
    found = {r["doc_id"]: [s["first_word"] for s in r["spans"] if s["exact"]] for r in license.scan(docs).collect()}
    assert found == {1: [990_002], 2: [], 3: []}
    base = [(r["doc_id"], str([(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3])) for r in secrets.scan(docs).collect()]
    same(base, [(d, str(s)) for d, s in brute.secret_base(rows)])
    assert quality.with_statistics(docs).count() == 3
    assert {r["doc_id"]: r["group_size"] for r in exact.exact_dedup(docs_frame([*rows, (4, rows[0][1])])).collect()} == {1: 2, 2: 1, 3: 1, 4: 2}


def test_index_is_compressed():
    """Bits of the wavelet levels, a mark per suffix and a value per window: far below 8 bytes a place and level."""
    import numpy as np

    text = np.array([zlib.crc32(str(i % 997).encode()) % 200 + 1 for i in range(60_000)])
    text[::500] = 0
    index = fmindex.ShardIndex(text, 201, np.arange(60_000) % 50, 13)
    assert index.nbytes() < 8 * len(text)
    at = np.flatnonzero(text[:-13])
    at = at[[not (text[a : a + 13] == 0).any() for a in at]]
    least = {}
    for a in range(len(text) - 12):
        k = text[a : a + 13].tobytes()
        least[k] = min(least.get(k, 99), a % 50)
    matched, value = index.search(text, at, 13)
    assert (matched == 13).all() and value.tolist() == [least[text[a : a + 13].tobytes()] for a in at]
