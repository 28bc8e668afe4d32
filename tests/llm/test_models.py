"""Language ID, quality classifier and the pipeline."""

import zlib

import brute
import numpy as np
import pytest
from llm_helpers import docs_frame, odd_rows, same  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from nichelab.llm import arrays, langid, quality
from nichelab.llm.common import table
from nichelab.llm.queries import ORACLES, REGISTRY

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = table(spark, SF01, "documents")
    out = REGISTRY["op8_language_id"](spark, SF01)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, docs_frame):
    english, german = "the house and the garden of the king " * 9, "das haus und der garten von dem kaiser " * 9
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([(english, "en"), (german, "de")] * 8)]
    model = langid.train(docs_frame([*rows, (50, "zzz", None, "s"), (51, None, "fr", "s")]))
    assert model.languages == ["de", "en"]
    odd = docs_frame([(1, None), (2, ""), (3, "123 !?"), (None, german), (4, "the king"), (4, "the king"), (5, german * 20_000)])
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in langid.predict(odd, model, ["doc_id"]).collect())
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    nothing = langid.train(docs_frame([]))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs_frame([]), model, ["doc_id"]).count() == 0


def test_language_blocks(spark, docs_frame, monkeypatch):
    """More languages than one matrix holds: the answers are those of one matrix."""
    rows = [(i, f"{'abcdefgh'[i % 8] * 3} {'hgfedcba'[i % 8]} some common words {i % 5}", f"l{i % 8}", "s") for i in range(40)]
    rows += [(60, "qqq vvv", "l8", "s"), (61, "qqq vvv", "l9", "s")]
    odd = [(100, None), (101, "12 !?"), (None, "aaa h"), (102, "qqq vvv"), (102, "qqq vvv"), (103, "ccc f")]
    docs = docs_frame(rows + odd)
    one = langid.train(docs_frame(rows))
    want = [(r["doc_id"], *langid.score_texts([r["text"]], one)[0][:2]) for r in docs.collect()]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    model = langid.train(docs_frame(rows))
    assert model.languages == one.languages and len(list(model.blocks())) == 4
    clashing = [F.lit("clash").alias(c) for c in ("row", "top", "kept", "_row", "_text")]
    got = langid.predict(docs.select("*", *clashing), model, ["doc_id", "row", "top", "kept", "_row", "_text"]).collect()
    assert {tuple(r)[1:6] for r in got} == {("clash",) * 5}
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got]
    assert {r[1] for r in got if r[0] == 102} == {"l8"}
    assert langid.predict(docs_frame([]), model, ["doc_id"]).count() == 0
    same([(d, lang, round(s, 6)) for d, lang, s in got], [(d, lang, round(s, 6)) for d, lang, s in want])


def test_batches_score_as_single_texts(monkeypatch):
    """All texts of a batch in one array give what each gives by itself, whatever the batch holds."""
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.log(rng.random((langid.BINS, 4))).astype(np.float32))
    texts = ["x", "ab", "one text", None, "", "123", "日本", "longer " * 400, "é" * 5, "y", "1a1", "İstanbul"]
    wanted, got = langid.judge(texts, model)
    assert [texts[i] for i in wanted] == [t for t in texts if t and any(map(str.isalpha, t))]
    for cells in (1, 64, 1 << 21):
        monkeypatch.setattr(langid, "CELLS", cells)
        again = langid.judge(texts, model)[1]
        for row, i in zip(again, wanted, strict=True):
            points = langid.code_points(texts[i].lower())
            grams = np.concatenate(langid.bins_of(points, 3))
            assert np.allclose(row, model.weights[grams].mean(axis=0, dtype=np.float64), atol=1e-9)


def test_scores_equal_plain_naive_bayes(spark, docs_frame):
    """Counts, smoothing, posterior and gain by hand, from the bins of the n-grams."""
    rows = [(i, f"{'der die und ' if i % 3 else 'the of and '}{i} {'abc' * (i % 5)}", "de" if i % 3 else "en", "s") for i in range(30)]
    model = langid.train(docs_frame(rows))
    bins = lambda t: np.concatenate(langid.bins_of(langid.code_points(t.lower()), 3))
    total = {lang: np.bincount(np.concatenate([bins(r[1]) for r in rows if r[2] == lang]), minlength=langid.BINS) + 0.5 for lang in ("de", "en")}
    total["all"] = total["de"] + total["en"] - 0.5
    prob = {k: np.log(v / v.sum()) for k, v in total.items()}
    for text in ("the und", "of", "zzz der", "AND"):
        mean = {k: prob[k][bins(text)].mean() for k in prob}
        best = max(("de", "en"), key=lambda k: mean[k])
        share = 1 / sum(np.exp(langid.SHARPNESS * (mean[k] - mean[best])) for k in ("de", "en"))
        lang, score, gain = langid.score_texts([text], model)[0]
        assert lang == best and score == pytest.approx(share, rel=1e-3) and gain == pytest.approx(mean[best] - mean["all"], abs=1e-4)


def test_language_stage_does_not_depend_on_the_names_of_languages(spark):
    """One language under three names, or no name at all, loses no document."""
    docs = table(spark, SF01, "documents")
    plain = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, docs, SF01).select("doc_id").collect()}
    assert len(plain) >= 0.99 * docs.filter(F.col("text").rlike(r"\p{L}")).count()
    names = F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), "eng").when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 1), "en-US").otherwise(F.col("lang"))
    for changed in (docs.withColumn("lang", names), docs.withColumn("lang", F.lit(None).cast("string"))):
        kept = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, changed, SF01).select("doc_id").collect()}
        assert plain <= kept


def test_slices_hold_every_gram(monkeypatch):
    text = "abcdefghij klmnop é日本 qrstuv" * 7
    whole = sorted(np.concatenate(list(langid.slices(text, 3))).tolist())
    monkeypatch.setattr(langid, "SLICE", 11)
    assert sorted(np.concatenate(list(langid.slices(text, 3))).tolist()) == whole
    assert len(whole) == 3 * len(text) - 3


def test_quality_held_out(spark):
    out = REGISTRY["op4_quality"](spark, SF01).join(table(spark, SF01, "labels"), "doc_id").toPandas()
    held = out[out["held_out"]]
    rank, good = held["score"].rank().to_numpy(), held["quality"].to_numpy() == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.95
    assert ((held["predicted"] == 1) == good).mean() >= 0.95
    assert held["score"].between(0, 1).all()


def test_quality_odd_rows(spark, docs_frame, odd_rows):
    stats = quality.with_statistics(docs_frame(odd_rows))
    assert stats.count() == len(odd_rows)
    labels = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], labels)
    assert {r["score"] for r in quality.score(stats, quality.fit(stats, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (1, 1, 0)], labels)
    assert {r["score"] for r in quality.score(stats, quality.fit(stats, ones)).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], labels)
    scores = [r["score"] for r in quality.score(stats, quality.fit(stats, both)).collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)
    assert quality.with_statistics(docs_frame([])).count() == 0


def test_quality_does_not_depend_on_how_rows_arrive(spark, docs_frame, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(130)], "doc_id long, quality int, toxic int")

    def scores(docs):
        stats = quality.with_statistics(docs)
        return sorted((r["doc_id"], r["score"]) for r in quality.score(stats, quality.fit(stats, labels)).collect())

    # moments are averages over the rows, whose last digits may differ
    left, right = scores(docs_frame(rows)), scores(docs_frame(rows[::-1]).repartition(5))
    assert [(d, round(s, 6)) for d, s in left] == [(d, round(s, 6)) for d, s in right]


def test_isotonic():
    x, y = quality.pool_adjacent(np.arange(6.0), np.array([0.1, 0.3, 0.2, 0.5, 0.9, 0.7]), np.ones(6))
    assert list(np.round(y, 3)) == [0.1, 0.25, 0.5, 0.8] and list(x) == [0, 1.5, 3, 4.5]


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer("alpha beta alpha".encode(), np.uint8)
    h = arrays.word_hashes(data, np.array([0, 6, 11]), np.array([5, 10, 16]))
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = REGISTRY[name](spark, SF001)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    same(df.select(*cols).collect(), res.fetchall())


def test_every_operator_has_its_query():
    assert [sum(n.startswith(f"op{i}_") for n in REGISTRY) for i in range(1, 14)] == [1] * 13


NATIVE = ("op1_decontamination", "op3_exact_dedup", "op6_secret_scan", "op9_mixing", "op10_url_filter")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = REGISTRY[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def brute_pipeline(docs, items, model):
    """(doc_id, text) after the four filtering stages, and the sources' sizes."""
    rows = [r for r in docs if (p := langid.score_texts([r[1]], model)[0])[0] != "und" and p[2] >= langid.MIN_GAIN]
    kept, seen = [], set()
    for r, e in zip(rows, brute.exact([r[:2] for r in rows]), strict=True):
        if e[3] and (r[0], e[4]) not in seen:
            seen.add((r[0], e[4]))
            kept.append(r)
    comps = brute.jaccard([r[:2] for r in kept])
    rows = [r for r, c in zip(kept, comps, strict=True) if c[2] == r[0]]
    hits = brute.decontaminate([r[:2] for r in rows], items)
    return [r for r, h in zip(rows, hits, strict=True) if not h[2]]


def test_pipeline(spark, tmp_dir):
    """Against a plain version, with extra columns whose names the stages use themselves."""
    docs = table(spark, SF001, "documents").withColumn("score", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("tag", F.lit(2))
    more = [(1000, "12 34 !!", "en", "src1", 8, "mine", 1, 2), (1001, None, "en", None, 0, "mine", 1, 2), (1002, "", None, "src2", 0, "mine", 1, 2)]
    copies = [(2000 + r["doc_id"], r["text"], r["lang"], None, r["n_chars"], "mine", 1, 2) for r in docs.filter("doc_id < 20").collect()]
    docs = docs.unionByName(spark.createDataFrame(more + copies, docs.schema))
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    table(spark, SF001, "benchmark").write.parquet(f"{tmp_dir}/benchmark.parquet")
    out = corpus_pipeline.run(spark, tmp_dir).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF001, "benchmark").collect()]
    want = brute_pipeline(rows, items, langid.fit(docs.select("doc_id", "text", "lang")))
    sizes = {}
    for _, t, s in want:
        sizes[s] = sizes.get(s, 0) + len(brute.tokens(t))
    target = brute.targets(sizes)
    taken, by_id = {}, {r[0]: r for r in want}
    for r in out:
        assert by_id[r["doc_id"]][1] == r["text"] and r["score"] == "mine"
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_words"]
        assert 0 < r["mix_words"] <= 2 * len(brute.tokens(r["text"]))
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)
    whole = {s for s in sizes if target[s] >= sizes[s]}
    assert {r[0] for r in want if r[2] in whole and brute.tokens(r[1])} <= {r["doc_id"] for r in out}


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, docs_frame):
    docs = docs_frame([]).withColumn("lang_pred", F.lit("x")).withColumn("key_id", F.lit(1))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF001)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == 0


def test_pipeline_keeps_rows_without_id(spark, docs_frame):
    text = [f"the first text number {i} with some words of its own " + "abc " * i for i in range(4)]
    docs = docs_frame([(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3] + " and a different end")])
    kept = corpus_pipeline.drop_exact_copies(spark, docs, SF001)
    assert kept.count() == 4
    assert corpus_pipeline.drop_near_copies(spark, kept, SF001).filter("doc_id IS NULL").count() == 2
    assert corpus_pipeline.drop_benchmark_leaks(spark, kept, SF001).count() == 4


def test_pipeline_near_copies_of_repeated_and_null_ids(spark, docs_frame):
    """Rows are compared one by one: dissimilar texts under one id all stay, near copies without an id go."""
    text = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(6)]
    rows = [(1, text[0]), (7, text[1]), (7, text[0] + " more"), (7, text[2]), (9, text[2] + " more"), (None, text[3]), (None, text[3] + " more"), (None, text[1] + " end"), (8, None), (None, "")]
    kept = corpus_pipeline.drop_near_copies(spark, docs_frame([*rows, rows[0], rows[8]]).repartition(3), SF001).collect()
    got = [(r["doc_id"], r["text"]) for r in kept]
    none = [r for r in got if r[0] is None and r[1]]
    assert len(none) == 1 and none[0][1].startswith(text[3])
    same([r for r in got if r not in none], [rows[0], rows[1], rows[3], rows[8], rows[9]])
