"""Benchmark decontamination by winnowing.

Texts are words (A-Z lower-cased).  The hashes of all runs of ``GRAM`` words
are winnowed: in every window of ``span - GRAM + 1`` neighbouring hashes the
smallest is the window's fingerprint.  A window is exactly ``span`` words, so
two texts that share ``span`` consecutive words share that window's
fingerprint: no shared span of that length can be missed.  Document windows
whose fingerprint a benchmark item has are extended to their words and joined
with the items' windows on the words themselves, so hash collisions cost time
but never a wrong hit.

Items shorter than ``span`` are one window each; for every such length ``m``
the hashes of all runs of ``m`` words stand in for the fingerprints.

Scale: one pass over the documents with no shuffle of texts.  The benchmark's
fingerprints are looked up as a constant set up to ``SET_LIMIT``; a larger
benchmark is joined by fingerprint, with one row per run of places that share
one, and the documents found are read again for the words at those places: work
is linear in the texts on both ways, however many hits a text has.

Edge cases: a null or empty text has no words and no hits; an item without words
has no window; a null item_id counts for hits but is not listed; rows that
repeat a doc_id and text get equal answers, items that repeat an id count once;
empty tables give no hits or an empty result.  Only the id and the text are read:
further columns, whatever their names, change nothing.  Texts of any length are
one row and taken whole.  A word under several windows counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nichelab.llm.common import stage, table, words_of

SPAN, GRAM = 10, 5
#: Fingerprints of the benchmark that travel inside the plan (8 bytes each).
SET_LIMIT = 20_000


def gram_hashes(words: str, k: int) -> Column:
    """The hash of the ``k`` words from each position on."""
    at = lambda x, i: F.xxhash64(x, *[F.get(F.col(words), i + j) for j in range(1, k)])
    return F.slice(F.transform(words, at), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def window_minima(hashes: str, w: int) -> Column:
    """The smallest of ``w`` neighbouring hashes from each position on."""
    if w == 1:
        return F.col(hashes)
    least = F.transform(hashes, lambda x, i: F.least(x, *[F.get(F.col(hashes), i + j) for j in range(1, w)]))
    return F.slice(least, F.lit(1), F.greatest(F.size(hashes) - (w - 1), F.lit(0)))


def with_prints(df: DataFrame, span: int, short: list[int]) -> DataFrame:
    """Adds for each window size m the column ``f{m}``: the fingerprint of the window at each position.  Needs ``words``."""
    gram = min(GRAM, span)
    df = df.withColumn("h", gram_hashes("words", gram)).withColumn(f"f{span}", window_minima("h", span - gram + 1)).drop("h")
    for m in short:
        df = df.withColumn(f"f{m}", gram_hashes("words", m))
    return df


def item_windows(items: DataFrame, span: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, m, print and words of every window of the items."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("words"))
    w = stage(w.filter(F.size("words") > 0), "items")
    lengths = w.select(F.least(F.size("words"), F.lit(span)).alias("m")).distinct().collect()  # at most span numbers
    short = sorted(r["m"] for r in lengths if r["m"] < span)
    parts = []
    for m in [span, *short]:
        part = w.filter(F.size("words") >= span) if m == span else w.filter(F.size("words") == m)
        prints = with_prints(part, span, [] if m == span else [m])
        pairs = F.transform(f"f{m}", lambda x, i: F.struct(x.alias("print"), F.array_join(F.slice(F.col("words"), i + 1, m), " ").alias("window")))  # noqa: B023
        parts.append(prints.select("item_id", F.lit(m).alias("m"), F.explode_outer(pairs).alias("p")).select("item_id", "m", "p.print", "p.window"))
    return stage(reduce(DataFrame.unionByName, parts).filter(F.col("window").isNotNull()).distinct(), "item-windows")


def with_runs(prints: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds for each window size m the column ``r{m}``: structs (m, print, a, z) of the places a to z - 1 that share a fingerprint in a row."""
    for m in sizes:
        f, b = f"f{m}", f"b{m}"
        first = F.transform(f, lambda x, i: F.when((i == 0) | (x != F.get(F.col(f), i - 1)), i))  # noqa: B023
        run = lambda a, j: F.struct(F.lit(m).alias("m"), F.get(F.col(f), a).alias("print"), a.alias("a"), F.coalesce(F.get(F.col(b), j + 1), F.size(f)).alias("z"))  # noqa: B023, E731
        prints = prints.withColumn(b, F.array_compact(first)).withColumn(f"r{m}", F.transform(b, run))
    return prints


def hit_windows(sizes: list[int], hit) -> Column:
    """Structs (m, p, window) of the windows whose fingerprint passes ``hit(m, print)``."""
    found = []
    for m in sizes:
        at = F.array_compact(F.transform(f"f{m}", lambda x, i: F.when(hit(m, x), i)))  # noqa: B023
        found.append(
            F.transform(at, lambda p: F.struct(F.lit(m).alias("m"), p.alias("p"), F.array_join(F.slice(F.col("words"), p + 1, m), " ").alias("window")))  # noqa: B023
        )
    return F.concat(*found)


def candidates(docs: DataFrame, windows: DataFrame, span: int, set_limit: int, doc_id: str, text: str) -> DataFrame:
    """One row per input row: doc_id, tag, n_words and the windows to verify."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tag"), words_of(F.col(text)).alias("words"))
    sizes = sorted({r["m"] for r in windows.select("m").distinct().collect()})
    if not sizes:
        nothing = F.array().cast("array<struct<m:int,p:int,window:string>>")
        return stage(base.select("doc_id", "tag", F.size("words").cast("long").alias("n_words"), nothing.alias("hits")), "hits")
    short = [m for m in sizes if m != span]
    prints = with_prints(base, span, short)
    distinct = windows.select("m", "print").distinct()
    n = F.size("words").cast("long").alias("n_words")
    few = distinct.limit(set_limit + 1).collect()
    if len(few) <= set_limit:
        known = {m: [r["print"] for r in few if r["m"] == m] for m in sizes}
        hits = hit_windows(sizes, lambda m, x: x.isin(known[m]))
        return stage(prints.select("doc_id", "tag", n, hits.alias("hits")), "hits")
    runs = F.explode_outer(F.concat(*[F.col(f"r{m}") for m in sizes])).alias("r")
    rows = with_runs(prints, sizes).select("doc_id", "tag", runs).select("doc_id", "tag", "r.*")
    # staged, so that the join sees a plain table and a fingerprint that very many texts have is split
    known = stage(distinct, "prints")
    per_doc = rows.join(known, ["m", "print"]).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("m", "a", "z")).alias("runs"))
    b, d = base.alias("b"), stage(per_doc, "candidates").alias("d")
    both = b.join(d, _same("b", "d"), "left").select("b.*", F.coalesce("d.runs", F.array()).alias("runs"))
    window = lambda r, p: F.struct(r["m"].alias("m"), p.alias("p"), F.array_join(F.slice(F.col("words"), p + 1, r["m"]), " ").alias("window"))
    hits = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["a"], r["z"] - 1), lambda p: window(r, p))))
    return stage(both.select("doc_id", "tag", n, hits.alias("hits")), "hits")


def decontaminate(
    docs: DataFrame, items: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text", set_limit: int = SET_LIMIT
) -> DataFrame:
    """One row per input row: doc_id, tag (hash of the text), n_words, n_hit (words inside any window of an item) and items (sorted ids)."""
    windows = item_windows(items, span)
    rows = candidates(docs, windows, span, set_limit, doc_id, text)
    key = ["doc_id", "tag"]
    seen = rows.filter(F.size("hits") > 0).select(*key, F.explode_outer("hits").alias("h")).select(*key, "h.*")
    found = stage(seen.join(windows.select("window", "item_id"), "window").select(*key, "p", "m", "item_id").distinct(), "found")
    ends = found.select(*key, "p", (F.col("p") + F.col("m")).alias("end")).distinct()
    before = F.max("end").over(W.partitionBy(*key).orderBy("p", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("p"), F.coalesce("before", F.lit(0))), F.lit(0))
    n_hit = ends.withColumn("before", before).groupBy(*key).agg(F.sum(new).cast("long").alias("n_hit"))
    ids = found.groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    per_doc = stage(n_hit.alias("a").join(ids.alias("b"), _same("a", "b")).select("a.*", "b.items"), "hit-docs")
    none = F.array().cast("array<string>")
    return (
        rows.alias("r")
        .join(per_doc.alias("h"), _same("r", "h"), "left")
        .select("r.doc_id", "r.tag", "r.n_words", F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("h.items", none).alias("items"))
    )


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
f AS (SELECT r, dw.m, i, item_id FROM dw JOIN bw USING (g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
