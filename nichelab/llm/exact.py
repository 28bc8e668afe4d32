"""Exact dedup by deterministic block naming.

A text (A-Z lower-cased) is cut into blocks of ``BLOCK`` bytes.  Blocks are
sorted and each distinct block gets an integer name; then adjacent names are
paired, the pairs sorted and named in turn, until one name is left.  Names come
from comparing whole contents, so two texts have the same (number of blocks,
last name) exactly when they are equal.

Sorting happens per bucket of a content hash: ``name = bucket * 2**38 + rank of
the content among the distinct contents of its bucket``.  A content that
thousands of rows share would fill one task; such contents (at most
``HOT_KEYS``, those with most rows) are made distinct with map-side combining,
named on their own (negative names) and looked up by a bounded broadcast.

Edge cases: a null text counts as the empty text, which is one empty block; all
empty texts are equal.  Rows that repeat a doc_id and text are equal rows and
get equal answers; a null doc_id is below every other (``keep_id`` is null only
for a group of nothing but null ids); rows that tie for the largest doc_id all
stay.  Texts of any length are cut into blocks whole.  An empty table gives an
empty result; columns but the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.common import ascii_lower, stage, table

BLOCK = 4096
BUCKET_BITS = 24
#: A content with so many rows is named apart, up to HOT_KEYS contents; any other has less than 1 / HOT_KEYS of the rows.
HOT_ROWS, HOT_KEYS = 1000, 4096
NO_PARTNER = -(1 << 62)


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per block: doc_id, tag, n (blocks of the text), pos, block; the text's sha256 at position 0.

    ``tag`` is a hash of the text that tells rows apart that share a doc_id.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("raw"), i * block + 1, F.lit(block)))
    whole = raw.select("doc_id", F.xxhash64("raw").alias("tag"), F.sha2("raw", 256).alias("sha"), n.alias("n"), cut.alias("cut"))
    # the outer form keeps the optimizer from testing the array's size in a filter that would cut the text again
    rows = whole.select("doc_id", "tag", "n", "sha", F.posexplode_outer("cut").alias("pos", "block"))
    return rows.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))


def with_names(rows: DataFrame, content: list[str], hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with the integer name of their content; the content columns go."""
    hashed = rows.withColumn("h", F.xxhash64(*content))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= hot_rows)
    hot = [r["h"] for r in counts.orderBy(F.desc("n_rows"), "h").limit(hot_keys).collect()]
    bucket = F.pmod(F.col("h"), F.lit(1 << BUCKET_BITS))
    keep = [c for c in rows.columns if c not in content]

    def named(part: DataFrame, name: Column) -> DataFrame:
        return part.withColumn("name", name).select(*keep, "name")

    if not hot:
        rank = F.dense_rank().over(W.partitionBy(bucket).orderBy(*content))
        return named(hashed, F.shiftleft(bucket, 38) + rank)
    is_hot = F.col("h").isin(hot)
    cold = hashed.filter(~is_hot)
    rank = F.dense_rank().over(W.partitionBy(bucket).orderBy(*content))
    # one row per hot content: at most a handful for each of the hot hashes
    contents = hashed.filter(is_hot).groupBy("h", *content).agg(F.count(F.lit(1)).alias("n_rows"))
    rank_hot = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("h", *content))
    names = contents.select("h", *content, (-rank_hot).cast("long").alias("name"))
    found = hashed.filter(is_hot).join(F.broadcast(names), ["h", *content]).select(*keep, "name")
    return named(cold, F.shiftleft(bucket, 38) + rank).unionByName(found)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, text_sha256 and the identity (n_blocks, name) of its text."""
    blocks = stage(text_blocks(docs, doc_id, text, block), "blocks")
    named = stage(with_names(blocks, ["block"], hot_rows), "names-0")
    rows = named.filter(F.col("pos") == 0).select("doc_id", "tag", "sha", F.col("n").alias("n_blocks"))
    piece = named.select("doc_id", "tag", F.col("n").alias("n_blocks"), "n", "pos", "name")
    done = []
    longest = named.agg(F.max("n")).first()[0] or 1
    level = 0
    while longest > 1:
        level += 1
        done.append(piece.filter(F.col("n") == 1))
        odd = F.col("pos") % 2 == 1
        pairs = (
            piece.filter(F.col("n") > 1)
            .groupBy("doc_id", "tag", "n_blocks", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(NO_PARTNER)).alias("b"))
        )
        piece = stage(with_names(stage(pairs, f"pairs-{level}"), ["a", "b"], hot_rows), f"names-{level}")
        longest = (longest + 1) // 2
    ends = piece.filter(F.col("n") == 1)
    for d in done:
        ends = ends.unionByName(d)
    # rows that repeat (doc_id, text) give equal pieces, of which one is kept
    ends = ends.groupBy("doc_id", "tag", "n_blocks").agg(F.max("name").alias("name"))
    r, e = rows.alias("r"), ends.alias("e")
    same = F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.tag") == F.col("e.tag")) & (F.col("r.n_blocks") == F.col("e.n_blocks"))
    return r.join(e, same).select("r.doc_id", F.col("r.sha").alias("text_sha256"), "r.n_blocks", "e.name")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256."""
    ident = stage(identities(docs, doc_id, text, block, hot_rows), "identities")
    # a table, not an aggregate above its exchange: then adaptive execution splits the rows of a large group
    groups = stage(ident.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ident.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
