"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is fitted on random strings, one on ordinary identifiers; both are
order-1 chains over the characters of a token.  A token of ``MIN_TOKEN``
characters or more is reported (kind ``markov``) when its log-likelihood ratio
reaches ``MIN_RATIO`` nats and no pattern span overlaps it.  Pattern spans
always stay.

Labelled samples: random strings are the values that the patterns find, in the
whole corpus, and digests of sampled ids in several encodings; ordinary ones
are the tokens of a sample of at most ``SAMPLE_DOCS`` documents (smallest id
hashes; this bounds the fit only), but for long ones with both letters and
digits, which may be either.

Positions are code points, end exclusive.  They come from marking the matches
in the text, splitting at the marks and summing the lengths, which is linear in
the text; a NUL in a text counts as one character that no pattern contains.

Edge cases: a null text is empty and has no spans; rows that repeat a doc_id
and text get equal answers; spans that begin together are listed by kind; a null
doc_id is kept; texts of any length are scanned whole; an empty table gives an
empty result (and no model is needed); columns but doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.common import hash_limit, stage, table

#: The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))

MIN_RATIO = 10.0
SAMPLE_DOCS = 2000
MIN_WORD = 6
#: The alphabet is '+' to 'z'; state STATES is the start of a token.
FIRST, STATES = 43, 80
MARK = "\x00"


def marks(text: Column, kind: str) -> Column:
    """The text cut at the matches of a pattern: structs (kind, pos, len, match), match null between matches; null if none."""
    clean = F.replace(text, F.lit(MARK), F.lit("\x01"))
    parts = F.split(F.regexp_replace(clean, f"({PATTERNS[kind]})", f"{MARK}$1{MARK}"), MARK, -1)
    cut = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("pos"), F.char_length(p).alias("len"), F.when(i % 2 == 1, p).alias("match")
        ),
    )
    return F.when(text.rlike(PATTERNS[kind]), cut)


def log_ratios(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of all transitions, ``from * STATES + to``, from samples (token, label: 1 random, 0 ordinary).

    Each token's transitions are counted in Spark; at most 2 * 81 * 80 counts come to the driver.
    """
    chars = F.array_remove(F.split(F.col("token"), ""), "")
    codes = F.transform(chars, lambda c: F.ascii(c) - FIRST)
    steps = F.transform(F.col("codes"), lambda c, i: F.struct(F.when(i == 0, STATES).otherwise(F.get("codes", i - 1)).alias("a"), c.alias("b")))
    rows = samples.select("label", codes.alias("codes")).select("label", F.explode_outer(steps).alias("s")).filter(F.col("s").isNotNull())
    counts = rows.groupBy("label", "s.a", "s.b").count().collect()
    tables = {label: [[1.0] * STATES for _ in range(STATES + 1)] for label in (0, 1)}
    for r in counts:
        tables[r["label"]][r["a"]][r["b"]] += r["count"]
    if {r["label"] for r in counts} != {0, 1}:
        return None
    ratio = []
    for a in range(STATES + 1):
        random, plain = tables[1][a], tables[0][a]
        ratio += [math.log(random[b] / sum(random)) - math.log(plain[b] / sum(plain)) for b in range(STATES)]
    return ratio


def token_ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token; the table is one constant array."""
    lookup = F.expr("cast(split('" + ",".join(f"{x:.6g}" for x in ratios) + "', ',') as array<double>)")
    codes = F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.ascii(c) - FIRST)
    start = F.struct(F.lit(STATES).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.get(lookup, acc["last"] * STATES + c)).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, min_ratio: float = MIN_RATIO, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, kind, end, value) sorted by start, then kind as in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    limit = hash_limit(docs, "doc_id", sample_docs)
    in_sample = F.xxhash64("doc_id") <= F.lit(limit)
    # long tokens with letters and digits are as likely random as not and have no label
    open_ = lambda w: (F.length(w) >= MIN_TOKEN) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    words = F.filter(F.split(text, r"[^A-Za-z0-9+/_=-]+"), lambda w: (F.length(w) >= MIN_WORD) & ~open_(w))
    found = stage(
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("tag"),
            *[marks(text, k).alias(k) for k in KINDS],
            F.when(in_sample, words).alias("words"),
        ),
        "marks",
        "snappy",  # many nested columns: a native zstd context per page adds up beside the heap
    )
    none = F.array().cast("array<struct<kind:int,pos:int,len:int,match:string>>")
    parts = F.concat(*[F.coalesce(F.col(k), none) for k in KINDS])
    once = found.filter(F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()).dropDuplicates(["doc_id", "tag"])
    rows = once.select("doc_id", "tag", F.explode_outer(parts).alias("p")).select("doc_id", "tag", "p.*")
    end = F.sum("len").over(W.partitionBy("doc_id", "tag", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    spans = rows.withColumn("end", end).filter(F.col("match").isNotNull()).withColumn("start", F.col("end") - F.col("len"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    spans = stage(
        spans.withColumn("value", value)
        .filter(F.when(F.col("kind") == 0, F.length("value") >= MIN_VALUE).otherwise(True))
        .select("doc_id", "tag", "kind", "start", "end", "value"),
        "spans",
    )
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    coded = F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(F.sha2(digest, 256))), "+/=", ""))
    random = spans.filter("kind < 3").select(F.translate("value", ".", "").alias("token"))
    random = random.unionByName(found.filter(F.col("words").isNotNull()).select(F.explode_outer(coded).alias("token")))
    plain = found.select(F.explode_outer("words").alias("token"))
    samples = random.withColumn("label", F.lit(1)).unionByName(plain.withColumn("label", F.lit(0))).filter(F.col("token") != "")
    ratios = log_ratios(samples)
    ratio = token_ratio(F.col("value"), ratios) if ratios else F.lit(0.0)
    scored = spans.withColumn("ratio", F.when(F.col("kind") == 3, ratio)).filter((F.col("kind") < 3) | (F.col("ratio") >= min_ratio))
    # the furthest end of the pattern spans that begin before a token's end tells whether one overlaps it
    by_doc = W.partitionBy("doc_id", "tag").orderBy("at", "is_end")
    events = scored.withColumn("is_base", F.col("kind") < 3)
    reach = F.max(F.when(F.col("is_base"), F.col("end"))).over(by_doc.rowsBetween(W.unboundedPreceding, 0))
    # base spans stand at their start, tokens at their end, after every base span that starts before it
    placed = events.withColumn("at", F.when(F.col("is_base"), F.col("start")).otherwise(F.col("end") - 1)).withColumn("is_end", (~F.col("is_base")).cast("int"))
    left = placed.withColumn("reach", reach).filter(F.col("is_base") | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    per_doc = left.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value"))).alias("spans"))
    d, s = found.select("doc_id", "tag").alias("d"), per_doc.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.tag") == F.col("s.tag"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return d.join(s, same, "left").select("d.doc_id", F.coalesce("s.spans", empty).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(texts(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        texts(F.col("spans")).alias("spans"),
    )
