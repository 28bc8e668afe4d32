"""Second-order boosted trees for a binary label, grown level by level with one aggregate each.

Features are cut into bins at quantiles; a gap stays a gap, in a bin of its own.  A tree
fits the gradients ``g = p - y`` and hessians ``h = p (1 - p)`` of the log loss.  A
level is one Spark aggregate: the sums of g and h by (node, feature, bin), at most
nodes x features x bins rows whatever the data, combined before the shuffle.
From these sums the driver picks each node's split by

    gain = 1/2 (s(left) + s(right) - s(node)) - gamma,   s = t(G)^2 / (H + lambda),
    t(G) = sign(G) max(|G| - alpha, 0),                  leaf value = -t(G) / (H + lambda),

trying the node's gaps on either side, so that every split has a default direction.
The rows follow by one projection a level: a level is three short constant arrays
indexed by node.  Margins are those of the last materialised rows plus those of the trees
since, a constant too, so that plans stay small and a tree writes nothing.

Sums are taken over integers (``SCALE`` to the unit), so they do not depend on the
order of rows, and a rerun gives the same trees.  Columns are drawn per tree, rows by
a hash of the key.  Ties go to the first feature, then the lower cut, then gaps to the
left.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelab.functions.numeric import hash_unit
from nichelab.operators import metrics, sampling
from nichelab.operators.windows import _bucket_expr
from nichelab.schemas import CV_FOLDS, FEATURE_COLUMNS, SEED
from nichelab.session import ensure_checkpoint_dir

#: Gradients are summed in units of 1 / SCALE: exact up to 2^33 rows.
SCALE = 1 << 30
#: Trees after which the rows' margins are materialised (checkpointed where the cluster names a folder).
MATERIALISE_EVERY = 10
ROOT = 1


@dataclass(frozen=True)
class Params:
    """The booster's settings, under the names the reference's parameter grids use."""

    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    max_bins: int = 64
    seed: int = SEED


# fixed values: the wide grid of all eight parameters (1,944 settings, in this order)
WIDE_GRID = {
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.1, 0.2],
    "n_estimators": [50, 100, 200],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
    "gamma": [0, 0.1],
    "reg_alpha": [0, 0.1, 1],
    "reg_lambda": [0, 0.1, 1],
}


def wide_grid(base: Params = Params()) -> list[Params]:
    names = list(WIDE_GRID)
    return [replace(base, **dict(zip(names, values, strict=True))) for values in product(*WIDE_GRID.values())]


@dataclass
class Tree:
    """Nodes by number (children of n: 2n and 2n + 1): split feature (-1: a leaf), last bin that goes left, whether gaps do,
    value, and the gain of the split."""

    feature: list[int]
    cut: list[int]
    gaps_left: list[bool]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 1 << (depth + 1)
        return cls([-1] * n, [0] * n, [True] * n, [0.0] * n, [0.0] * n)


@dataclass
class Booster:
    params: Params
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def importances(self) -> list[tuple[str, float]]:
        """Share of the total gain by feature, largest first."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        whole = sum(total.values()) or 1.0
        return sorted(((k, v / whole) for k, v in total.items()), key=lambda kv: (-kv[1], kv[0]))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        return cls(Params(**d["params"]), d["features"], d["cuts"], [Tree(**t) for t in d["trees"]])


def threshold(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def strength(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    den = h + p.reg_lambda
    return np.where(den > 0, threshold(g, p.reg_alpha) ** 2 / np.where(den > 0, den, 1.0), 0.0)


def leaf_value(g: float, h: float, p: Params) -> float:
    den = h + p.reg_lambda
    return float(-threshold(np.float64(g), p.reg_alpha) / den) if den > 0 else 0.0


@dataclass
class Split:
    """The best split of a node and the sums (g, h) of its sides."""

    gain: float
    feature: int
    cut: int
    gaps_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


def best_split(g: np.ndarray, h: np.ndarray, p: Params, allowed: list[int]) -> Split | None:
    """The best split of a node, if one gains.  ``g``, ``h``: sums by feature and bin, the last bin for gaps."""
    best = None
    for f in allowed:
        whole_g, whole_h = g[f].sum(), h[f].sum()
        here = strength(whole_g, whole_h, p)
        below_g, below_h = np.cumsum(g[f, :-1])[:-1], np.cumsum(h[f, :-1])[:-1]
        # by cut, gaps left first
        lg = np.stack([below_g + g[f, -1], below_g], axis=1).ravel()
        lh = np.stack([below_h + h[f, -1], below_h], axis=1).ravel()
        rg, rh = whole_g - lg, whole_h - lh
        gain = 0.5 * (strength(lg, lh, p) + strength(rg, rh, p) - here) - p.gamma
        gain = np.where((lh >= p.min_child_weight) & (rh >= p.min_child_weight), gain, -np.inf)
        if not len(gain):
            continue
        k = int(gain.argmax())
        if gain[k] > 1e-12 and (best is None or gain[k] > best.gain):
            best = Split(float(gain[k]), f, k // 2, k % 2 == 0, (float(lg[k]), float(lh[k])), (float(rg[k]), float(rh[k])))
    return best


def drawn_features(n: int, share: float, seed: int, tree: int) -> list[int]:
    """The columns of a tree."""
    take = max(1, round(share * n))
    return sorted(np.random.default_rng([seed, tree]).permutation(n)[:take].tolist())


def find_cuts(df: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """At most ``max_bins - 1`` quantiles a feature, in one pass; gaps do not count."""
    probs = [i / max_bins for i in range(1, max_bins)]
    found = df.approxQuantile(features, probs, 1.0 / (4 * max_bins))
    return [sorted({float(v) for v in values if v == v}) for values in found]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]]) -> Column:
    """The bins of a row: how many cuts are at most the value; one more than the last bin for a gap."""

    def one(name: str, bounds: list[float]) -> Column:
        c = F.col(name).cast("double")
        place = _bucket_expr(c, bounds) if bounds else F.lit(0)
        return F.when(c.isNull() | F.isnan(c), F.lit(-1)).otherwise(place)

    return F.array(*[one(f, b) for f, b in zip(features, cuts, strict=True)])


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def step_down(node: Column, bins: Column, feature: Column, cut: Column, gaps_left: Column) -> Column:
    """Where a row goes on from ``node``, by a tree's arrays; it stays at a leaf."""
    f = F.get(feature, node)
    b = F.get(bins, F.greatest(f, F.lit(0)))
    side = F.when(b < 0, F.when(F.get(gaps_left, node), 0).otherwise(1)).when(b <= F.get(cut, node), 0).otherwise(1)
    return F.when(f < 0, node).otherwise(node * 2 + side).cast("int")


def forest_margin(bins: Column, trees: list[Tree], p: Params) -> Column:
    """The sum of the trees' values for a row; the expression's size does not depend on their number or depth."""
    if not trees:
        return F.lit(0.0)
    arrays = [{"f": t.feature, "c": t.cut, "l": t.gaps_left, "v": t.value} for t in trees]
    forest = _constant(arrays, "struct<f: array<int>, c: array<int>, l: array<boolean>, v: array<double>>")
    levels = F.sequence(F.lit(1), F.lit(p.max_depth))

    def add(total: Column, t: Column) -> Column:
        leaf = F.aggregate(levels, F.lit(ROOT), lambda node, _: step_down(node, bins, t["f"], t["c"], t["l"]))
        return total + F.get(t["v"], leaf) * p.learning_rate

    return F.aggregate(forest, F.lit(0.0), add)


def level_sums(rows: DataFrame, nodes: list[int], n_features: int, widths: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of g and h by feature and bin (gaps last) of each node: one aggregate, at most nodes x features x bins rows."""
    entries = rows.filter(F.col("node").isin(nodes)).select("node", "g", "h", F.posexplode("bins").alias("f", "b"))
    sums = entries.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out = {n: (np.zeros((n_features, widths + 1)), np.zeros((n_features, widths + 1))) for n in nodes}
    for r in sums:
        g, h = out[r["node"]]
        g[r["f"], r["b"]] = r["g"] / SCALE  # bin -1 is the last
        h[r["f"], r["b"]] = r["h"] / SCALE
    return out


def grow_tree(rows: DataFrame, p: Params, allowed: list[int], n_features: int, widths: int) -> Tree:
    """``rows``: bins, g, h (integers) of the rows that the tree sees.  One job a level; a split's sides give the sums of
    its children, so the leaves need none."""
    tree = Tree.empty(p.max_depth)
    open_, at = [ROOT], rows.withColumn("node", F.lit(ROOT))
    for depth in range(p.max_depth):
        level, grown = level_sums(at, open_, n_features, widths), []
        for node in open_:
            g, h = level[node]
            if node == ROOT:
                tree.value[node] = leaf_value(g[0].sum(), h[0].sum(), p)
            split = best_split(g, h, p, allowed)
            if split is None:
                continue
            tree.gain[node], tree.feature[node], tree.cut[node], tree.gaps_left[node] = split.gain, split.feature, split.cut, split.gaps_left
            tree.value[2 * node], tree.value[2 * node + 1] = leaf_value(*split.left, p), leaf_value(*split.right, p)
            grown += [2 * node, 2 * node + 1]
        open_ = grown
        if not open_ or depth == p.max_depth - 1:
            break
        arrays = _constant(tree.feature, "int"), _constant(tree.cut, "int"), _constant(tree.gaps_left, "boolean")
        at = at.withColumn("node", step_down(F.col("node"), F.col("bins"), *arrays))
    return tree


def train_booster(df: DataFrame, params: Params = Params(), features: list[str] | None = None, label: str = "presence", key: str = "key") -> Booster:
    """Fit on the rows of ``df``; feature values may be null or not a number.

    One aggregate per level and tree; the rows' margins are materialised every ``MATERIALISE_EVERY`` trees.
    """
    features = features or FEATURE_COLUMNS
    cluster = ensure_checkpoint_dir(df.sparkSession)
    cuts = find_cuts(df, features, params.max_bins)
    widths = max(map(len, cuts)) + 1
    booster = Booster(params, list(features), cuts)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("y"), binned(df, features, cuts).alias("bins"), F.lit(0.0).alias("margin"))
    rows = rows.persist()
    pending: list[Tree] = []
    for t in range(params.n_estimators):
        if len(pending) == MATERIALISE_EVERY:
            fresh = rows.withColumn("margin", F.col("margin") + forest_margin(F.col("bins"), pending, params))
            fresh = fresh.checkpoint() if cluster else fresh.persist()
            if cluster:
                rows.unpersist()
            rows, pending = fresh, []
        drawn = rows
        if params.subsample < 1:
            drawn = rows.filter(F.coalesce(hash_unit("key", 7919 + 2 * t, params.seed + t) < params.subsample, F.lit(True)))
        drawn = drawn.withColumn("margin", F.col("margin") + forest_margin(F.col("bins"), pending, params))
        drawn = drawn.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))))
        g = F.round((F.col("p") - F.col("y")) * SCALE).cast("long")
        h = F.round(F.col("p") * (F.lit(1.0) - F.col("p")) * SCALE).cast("long")
        seen = drawn.select("bins", g.alias("g"), h.alias("h"))
        tree = grow_tree(seen, params, drawn_features(len(features), params.colsample_bytree, params.seed, t), len(features), widths)
        booster.trees.append(tree)
        pending.append(tree)
    rows.unpersist()
    return booster


def score(booster: Booster, df: DataFrame, out_col: str = "risk") -> DataFrame:
    """Class-1 probability of every row: one projection, in which the forest is a constant."""
    at = df.withColumn("_bins", binned(df, booster.features, booster.cuts))
    margin = forest_margin(F.col("_bins"), booster.trees, booster.params)
    return at.withColumn(out_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop("_bins")


def search(df: DataFrame, settings: list[Params], folds: int = CV_FOLDS, label: str = "presence", key: str = "key") -> tuple[Booster, list[float]]:
    """Mean ROC AUC of each setting over stratified folds of the 80 % split; the best is fitted to all rows."""
    part = sampling.stratified_folds(df.filter(sampling.split_label(key) == "train"), folds, label, key).persist()
    means = []
    for p in settings:
        aucs = []
        for k in range(folds):
            model = train_booster(part.filter(F.col("fold") != k), p, label=label, key=key)
            held = score(model, part.filter(F.col("fold") == k)).select(F.col(label).alias("label"), "risk")
            aucs.append(metrics.roc_auc(held).first()["auc"])
        means.append(math.fsum(a or 0.0 for a in aucs) / folds)
    part.unpersist()
    return train_booster(df, settings[max(range(len(settings)), key=lambda i: means[i])], label=label, key=key), means


def save_booster(spark: SparkSession, booster: Booster, path: str) -> None:
    spark.createDataFrame([(booster.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_booster(spark: SparkSession, path: str) -> Booster:
    return Booster.from_json(spark.read.parquet(path).first()["model"])
