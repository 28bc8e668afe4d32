"""Second-order trees against a plain numpy booster that works row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichelab.functions.numeric import hash_unit
from nichelab.operators import metrics
from nichelab.plans import boosting as B

NAMES = ["elevation", "bio1", "bio12", "flat"]


def _data(spark, n=500, seed=3):
    """Two informative features, one of them with 30 % gaps that mean something, one of noise and one constant."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(500, 200, n), rng.normal(15, 5, n).round(1), rng.integers(0, 9, n).astype(float), np.ones(n)])
    gap = rng.random(n) < 0.3
    logit = 0.01 * (x[:, 0] - 500) * ~gap + 1.5 * gap + 0.3 * (x[:, 1] - 15)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    x[gap, 0] = np.nan
    rows = [(k, int(y[k]), *[None if v != v and k % 2 else float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "key long, presence int, elevation double, bio1 double, bio12 double, flat double"), x, y


def _plain(x, y, cuts, p, kept):
    """Trees and margins by loops over rows and cuts, on values instead of bins."""
    margin, trees = np.zeros(len(y)), []
    t1 = lambda g: math.copysign(max(abs(g) - p.reg_alpha, 0), g)
    s = lambda g, h: t1(g) ** 2 / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0
    for t in range(p.n_estimators):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.round((prob - y) * B.SCALE), np.round(prob * (1 - prob) * B.SCALE)
        allowed = B.drawn_features(x.shape[1], p.colsample_bytree, p.seed, t)
        tree = {}

        def grow(node, rows, depth, g=g, h=h, allowed=allowed, tree=tree):
            seen = [i for i in rows if kept[t][i]]
            gs, hs = sum(g[i] for i in seen) / B.SCALE, sum(h[i] for i in seen) / B.SCALE
            best = None
            if depth < p.max_depth:
                for f in allowed:
                    for k, c in enumerate(cuts[f]):
                        for gaps_left in (True, False):
                            left = [i for i in seen if (gaps_left if x[i, f] != x[i, f] else x[i, f] < c)]
                            lg, lh = sum(g[i] for i in left) / B.SCALE, sum(h[i] for i in left) / B.SCALE
                            if lh < p.min_child_weight or hs - lh < p.min_child_weight:
                                continue
                            gain = 0.5 * (s(lg, lh) + s(gs - lg, hs - lh) - s(gs, hs)) - p.gamma
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, k, gaps_left)
            if best is None:
                tree[node] = -t1(gs) / (hs + p.reg_lambda) if hs + p.reg_lambda > 0 else 0.0
                for i in rows:
                    margin[i] += p.learning_rate * tree[node]
                return
            tree[node] = best[1:]
            _, f, k, gaps_left = best
            left = [i for i in rows if (gaps_left if x[i, f] != x[i, f] else x[i, f] < cuts[f][k])]
            grow(2 * node, left, depth + 1)
            inside = set(left)
            grow(2 * node + 1, [i for i in rows if i not in inside], depth + 1)

        grow(B.ROOT, list(range(len(y))), 0)
        trees.append(tree)
    return trees, 1 / (1 + np.exp(-margin))


def _as_dict(tree, node=B.ROOT):
    if tree.feature[node] < 0:
        return {node: tree.value[node]}
    return {node: (tree.feature[node], tree.cut[node], tree.gaps_left[node])} | _as_dict(tree, 2 * node) | _as_dict(tree, 2 * node + 1)


SETTINGS = [
    B.Params(n_estimators=3, max_depth=3, subsample=1.0, colsample_bytree=1.0, max_bins=8),
    B.Params(n_estimators=3, max_depth=2, learning_rate=0.3, subsample=0.7, colsample_bytree=0.5, gamma=0.4, reg_alpha=1.5, reg_lambda=0.1, min_child_weight=3.0, max_bins=6),
]


@pytest.mark.parametrize("p", SETTINGS)
def test_equal_to_the_plain_version(spark, p):
    df, x, y = _data(spark)
    model = B.train_booster(df.repartition(3), p, NAMES)
    kept = []
    for t in range(p.n_estimators):
        row = df.select("key", (hash_unit("key", 7919 + 2 * t, p.seed + t) < p.subsample).alias("k")).collect()
        kept.append({r["key"]: r["k"] or p.subsample >= 1 for r in row})
    trees, risk = _plain(x, y, model.cuts, p, kept)
    for mine, want in zip(model.trees, trees, strict=True):
        got = _as_dict(mine)
        assert got.keys() == want.keys()
        for node, v in want.items():
            assert got[node] == (v if isinstance(v, tuple) else pytest.approx(v, rel=1e-9))
    scored = {r["key"]: r["risk"] for r in B.score(model, df).collect()}
    assert [scored[k] for k in range(len(y))] == pytest.approx(list(risk), rel=1e-9)
    again = B.Booster.from_json(model.to_json())
    assert again == model and {f for f, _ in model.importances()} == set(NAMES)
    assert any(not t.gaps_left[n] for t in model.trees for n in range(len(t.feature)) if t.feature[n] == 0) or p is SETTINGS[1]


def test_each_parameter_changes_the_split_as_the_formula_says():
    """Two bins and gaps, by hand: sums G = (-6, 4, -1), H = (3, 2, 1)."""
    g, h = np.array([[-6.0, 4.0, -1.0]]), np.array([[3.0, 2.0, 1.0]])
    base = B.Params(min_child_weight=0.0)
    split = lambda p: B.best_split(g, h, p, [0])
    gain = lambda p: (s := split(p)) and (s.gain, s.feature, s.cut, s.gaps_left)
    assert split(base).left == (-7.0, 4.0) and split(base).right == (4.0, 2.0)
    assert gain(base) == (pytest.approx(0.5 * (49 / 5 + 16 / 3 - 9 / 7)), 0, 0, True)
    assert gain(B.replace(base, reg_lambda=0.1))[0] == pytest.approx(0.5 * (49 / 4.1 + 16 / 2.1 - 9 / 6.1))
    assert gain(B.replace(base, reg_alpha=1.0))[0] == pytest.approx(0.5 * (36 / 5 + 9 / 3 - 4 / 7))
    assert gain(B.replace(base, gamma=2.0))[0] == pytest.approx(0.5 * (49 / 5 + 16 / 3 - 9 / 7) - 2)
    assert gain(B.replace(base, gamma=100.0)) is None
    assert gain(B.replace(base, min_child_weight=2.5))[3] is False  # the gaps must go with the right bin to weigh enough
    assert gain(B.replace(base, min_child_weight=3.5)) is None
    assert B.leaf_value(-6.0, 3.0, B.replace(base, reg_alpha=1.0, reg_lambda=0.1)) == pytest.approx(5 / 3.1)
    assert B.leaf_value(0.5, 3.0, B.replace(base, reg_alpha=1.0)) == 0.0 and B.leaf_value(1.0, 0.0, B.replace(base, reg_lambda=0.0)) == 0.0


def test_wide_grid_has_all_eight_parameters():
    grid = B.wide_grid()
    assert len(grid) == len(set(grid)) == 3 * 3 * 3 * 2 * 2 * 2 * 3 * 3
    assert {k for k in B.WIDE_GRID if len({getattr(p, k) for p in grid}) > 1} == set(B.WIDE_GRID) and len(B.WIDE_GRID) == 8
    assert len(B.drawn_features(13, 0.8, 42, 0)) == 10 and B.drawn_features(13, 0.8, 42, 0) != B.drawn_features(13, 0.8, 42, 1)


def test_gaps_carry_information_and_a_level_is_one_small_shuffle(spark):
    df, x, y = _data(spark, 3000, 5)
    p = B.Params(n_estimators=6, max_depth=3, learning_rate=0.4, max_bins=16)
    train, rest = df.filter("key % 3 <> 0"), df.filter("key % 3 = 0")
    auc = lambda m: metrics.roc_auc(B.score(m, rest).select(F.col("presence").alias("label"), "risk")).first()["auc"]
    with_gaps, filled = auc(B.train_booster(train, p, NAMES)), auc(B.train_booster(train.fillna(0.0).withColumn("elevation", F.lit(0.0)), p, NAMES))
    assert with_gaps > 0.8 and with_gaps > filled + 0.05
    rows = df.select(F.array(F.lit(1), F.lit(-1)).alias("bins"), F.lit(1).cast("long").alias("g"), F.lit(1).cast("long").alias("h"), (F.col("key") % 4).cast("int").alias("node"))
    sums = B.level_sums(rows, [0, 1, 2], 2, 5)
    assert set(sums) == {0, 1, 2} and sums[0][0].shape == (2, 6) and sums[0][1][1, -1] * B.SCALE == 750


def test_margins_are_materialised_on_the_way(spark, monkeypatch):
    df, _, _ = _data(spark, 200)
    p = B.Params(n_estimators=5, max_depth=2, max_bins=4)
    want = B.train_booster(df, p, NAMES)
    monkeypatch.setattr(B, "MATERIALISE_EVERY", 2)
    assert [t.feature for t in B.train_booster(df, p, NAMES).trees] == [t.feature for t in want.trees]


def test_search_and_stored_model(spark, tmp_dir):
    df, _, _ = _data(spark)
    full = df.select("*", *[F.lit(0.0).alias(c) for c in B.FEATURE_COLUMNS if c not in df.columns])
    best, means = B.search(full, [B.Params(n_estimators=1, max_depth=1, max_bins=4), B.Params(n_estimators=3, max_depth=2, learning_rate=0.5, max_bins=16)], folds=2)
    assert len(means) == 2 and best.params.max_depth == (1 if means[0] >= means[1] else 2)
    B.save_booster(spark, best, f"{tmp_dir}/m")
    assert B.load_booster(spark, f"{tmp_dir}/m") == best


def test_one_class_and_no_rows(spark):
    df, _, _ = _data(spark, 50)
    p = B.Params(n_estimators=2, max_depth=2, max_bins=4)
    ones = B.score(B.train_booster(df.withColumn("presence", F.lit(1)), p, NAMES), df).collect()
    assert all(r["risk"] > 0.5 for r in ones)
    none = B.score(B.train_booster(df.limit(0), p, NAMES), df).collect()
    assert {r["risk"] for r in none} == {0.5}
