"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Rules are short strings ``host/path-prefix``.  A rule fits its host and every
subdomain when the URL's path starts with the rule's path; the longest fitting
rule decides.  URLs that a rule decides are the labelled URLs: the trees are
fitted on them (a hash-ordered sample of at most ``FIT_ROWS`` rows, a bound of
the fit alone) and judge all the others.

Features: lengths, depth, digit ratio, character entropy, counts of parameters,
labels, hyphens and digits runs, and suffix statistics: the smoothed share of
blocked URLs among all labelled URLs with the same top-level label, the same
last two labels, and the same file suffix.  In the fit a URL's own label is left
out of its statistics, as it is absent from those of the URLs to be judged.

Edge cases: a null URL or one without ``://`` has an empty host and path and
fits no rule.  Without labelled URLs the method allows everything; with one
kind of label only, it gives that kind.  Repeated rows are judged alike; rules
of equal length that fit and differ resolve to block.  Only ``keep`` and the URL
are read: further columns, whatever their names, change nothing.  URLs of any
length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelab.llm.common import ascii_lower, stage, table

#: The rules of the query, as (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
FIT_ROWS = 20_000
TREES, DEPTH, STEP = 16, 4, 0.2
#: Pseudo-counts of the suffix statistics: so many labelled URLs at the overall share.
PRIOR = 20.0
SUFFIXES = ("top", "domain", "file")
LEXICAL = (
    "url_len", "host_len", "path_len", "depth", "digit_ratio", "entropy", "n_params",
    "n_labels", "n_hyphens", "n_digit_runs", "has_fragment", "ends_in_slash",
)


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0)
    return (
        pages.withColumn("_rest", rest)
        .withColumn("_host", raw)
        .withColumn("path", F.regexp_extract(F.col("_rest").substr(F.length("_host") + 1, F.length("_rest")), r"^[^?#]*", 0))
        .withColumn("host", ascii_lower(F.col("_host")))
        .drop("_rest", "_host")
    )


def rule_match(rules: tuple = RULES) -> Column:
    """Struct (length, blocks, rule, verdict) of the longest rule that fits, else null; of equal length, block wins."""
    fits = []
    for verdict, rule in rules:
        host, slash, prefix = rule.partition("/")
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + prefix)
        found = F.struct(F.lit(len(rule)).alias("length"), F.lit(verdict == "block").alias("blocks"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(fit, found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,blocks:boolean,rule:string,verdict:string>")


def lexical(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the suffix keys of a parsed URL."""
    u = F.coalesce(F.col(url), F.lit(""))
    length = F.length(u).cast("double")
    chars = F.array_remove(F.split(u, ""), "")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))) / length
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    last = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    cols = {
        "url_len": length,
        "host_len": F.length("host").cast("double"),
        "path_len": F.length("path").cast("double"),
        "depth": F.regexp_count(F.col("path"), F.lit("/")).cast("double"),
        "digit_ratio": F.when(length > 0, F.regexp_count(u, F.lit("[0-9]")) / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "n_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "n_labels": F.when(F.col("host") == "", 0.0).otherwise(F.regexp_count(F.col("host"), F.lit(r"\.")) + 1.0),
        "n_hyphens": F.regexp_count(u, F.lit("-")).cast("double"),
        "n_digit_runs": F.regexp_count(u, F.lit("[0-9]+")).cast("double"),
        "has_fragment": (F.instr(u, "#") > 0).cast("double"),
        "ends_in_slash": F.col("path").endswith("/").cast("double"),
        "top": F.regexp_extract(F.col("host"), r"([^.]*)$", 1),
        "domain": F.regexp_extract(F.col("host"), r"([^.]*\.?[^.]*)$", 1),
        "file": F.when(F.instr(last, ".") > 0, F.regexp_extract(last, r"([^.]*)$", 1)).otherwise(F.lit("")),
    }
    return parsed.withColumns(cols)


def suffix_statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """For each suffix kind the number of labelled rows and of blocked ones, from all labelled rows (``blocked`` is 0 or 1)."""
    return {k: labelled.groupBy(k).agg(F.sum("blocked").alias(f"{k}_blocked"), F.count(F.lit(1)).alias(f"{k}_rows")) for k in SUFFIXES}


def with_rates(df: DataFrame, stats: dict[str, DataFrame], overall: float, own: Column | None = None) -> DataFrame:
    """Adds the smoothed share of blocked URLs per suffix kind; a row whose label is ``own`` is itself left out of it."""
    df = reduce(lambda d, k: d.join(stats[k], k, "left"), SUFFIXES, df)
    less, one = (F.lit(0.0), F.lit(0.0)) if own is None else (own, F.lit(1.0))
    rate = lambda k: (F.col(f"{k}_blocked") - less + PRIOR * overall) / (F.col(f"{k}_rows") - one + PRIOR)
    return df.withColumns({f"{k}_rate": F.coalesce(rate(k), F.lit(overall)) for k in SUFFIXES})


def judge(pages: DataFrame, rules: tuple = RULES, url: str = "url", keep: tuple = ("page_id",), fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``keep``, host, path, rule, verdict, score (the method's chance of a block; null under a rule)."""
    parsed = parse(pages.select(*keep, F.col(url).alias("url"))).withColumn("m", rule_match(rules))
    rows = stage(lexical(parsed.select(*keep, "url", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("ruled"))), "urls")
    labelled = rows.filter(F.col("ruled").isNotNull()).withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    out = [*keep, "host", "path", "rule"]
    if blocked in (0, n):
        only = "block" if n and blocked else "allow"
        return rows.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.when(F.col("ruled").isNull(), F.lit(float(only == "block"))).alias("score"))
    overall = blocked / n
    stats = {k: stage(v, f"suffix-{k}") for k, v in suffix_statistics(labelled).items()}
    assemble = VectorAssembler(inputCols=[*LEXICAL, *(f"{k}_rate" for k in SUFFIXES)], outputCol="features")
    order = F.xxhash64("url")
    sample = labelled.select("blocked", *LEXICAL, *SUFFIXES, order.alias("order")).orderBy("order", *LEXICAL).limit(fit_rows)
    fit = stage(assemble.transform(with_rates(sample, stats, overall, F.col("blocked"))).select("features", F.col("blocked").alias("label")).coalesce(4), "url-fit")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7).fit(fit)
    scored = model.transform(assemble.transform(with_rates(rows, stats, overall)))
    score = vector_to_array("probability")[1]
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    ruled = F.col("ruled").isNotNull()
    return (
        scored.withColumn("score", score)
        .withColumn("verdict", F.coalesce("ruled", method))
        .select(*out, "verdict", F.when(~ruled, F.col("score")).alias("score"))
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
