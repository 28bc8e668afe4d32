"""Binary-classification metrics as aggregates over scored rows.

Everything starts from ``score_counts`` -- rows grouped by (group, score)
with positive and negative counts -- so work after the first aggregate is
proportional to the number of distinct scores, and the per-score running
totals come from ``windows.running_totals`` (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelab.functions.bins import threshold_bin, threshold_value
from nichelab.functions.numeric import hash_order, ratio_or_zero
from nichelab.operators.windows import running_totals
from nichelab.schemas import (
    BALANCE_TOLERANCE,
    DEFAULT_THRESHOLD,
    SCORE_WEIGHTS,
    SEED,
    THRESHOLD_COUNT,
)

Threshold = float | Column | DataFrame


def predict(score: Column | str, threshold: float | Column) -> Column:
    """Class 1 when ``score >= threshold``."""
    s = F.col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (s >= t).cast("int")


def valid_scores(df: DataFrame, score: str = "risk") -> DataFrame:
    """Rows with a usable score (not null, not NaN)."""
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))


def score_counts(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    """(by..., score, pos, neg): one row per distinct usable score; label 1 is positive."""
    return valid_scores(df, score).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
    )


def _metric_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    n = tn + fp + fn + tp
    return [
        ratio_or_zero(tp + tn, n).alias("accuracy"),
        ratio_or_zero(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1_score"),
        ratio_or_zero(tp, tp + fn).alias("sensitivity"),
        ratio_or_zero(tn, tn + fp).alias("specificity"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
    ]


def _with_threshold(cum: DataFrame, threshold: Threshold, by: list[str]) -> tuple[DataFrame, Column]:
    if isinstance(threshold, DataFrame):
        if by:
            return cum.join(threshold.select(*by, F.col("threshold").alias("_thr")), by, "left"), F.col("_thr")
        return cum, threshold.select("threshold").scalar()
    if isinstance(threshold, Column):
        return cum, threshold
    return cum, F.lit(float(threshold))


def standard_metrics(
    df: DataFrame,
    threshold: Threshold = DEFAULT_THRESHOLD,
    score: str = "risk",
    label: str = "label",
    by: list[str] | tuple = (),
    with_threshold: bool = False,
) -> DataFrame:
    """accuracy, auc, f1_score, sensitivity, specificity, precision,
    average_precision and the confusion counts tn, fp, fn, tp per group.

    Ratios with a zero denominator are 0; AUC and AP are null when a class
    is absent.  AUC counts ties at half weight; AP is the step sum
    ``sum (R_n - R_n-1) P_n`` over distinct scores in descending order.
    ``threshold`` may be a number, a column (e.g. a scalar subquery) or a
    frame of per-group thresholds.
    """
    by = list(by)
    counts = score_counts(df, score, label, by)
    cum = running_totals(counts, score, ["pos", "neg"], by=by, ascending=False, inclusive=True)
    cum, thr = _with_threshold(cum, threshold, by)
    # compare in a projection: a scalar subquery may not sit inside an aggregate
    cum = cum.withColumn("_thr", thr).withColumn("_hit", F.col(score) >= F.col("_thr"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp_cum, fp_cum = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    agg = cum.groupBy(*by).agg(
        F.sum("pos").alias("_P"),
        F.sum("neg").alias("_N"),
        F.sum(pos * (fp_cum - F.lit(0.5) * neg)).alias("_auc_loss"),
        F.sum(pos * tp_cum / (tp_cum + fp_cum)).alias("_ap_sum"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("pos"))), F.lit(0).cast("long")).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("neg"))), F.lit(0).cast("long")).alias("fp"),
        F.max("_thr").alias("_threshold"),
    )
    P, N = F.col("_P"), F.col("_N")
    both = (P > 0) & (N > 0)
    agg = agg.withColumn("fn", P - F.col("tp")).withColumn("tn", N - F.col("fp"))
    tn, fp, fn, tp = F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")
    m = _metric_columns(tn, fp, fn, tp)
    return agg.select(
        *by,
        *([F.col("_threshold").cast("double").alias("threshold")] if with_threshold else []),
        m[0],
        F.when(both, F.lit(1.0) - F.col("_auc_loss") / (P.cast("double") * N.cast("double"))).alias("auc"),
        m[1],
        m[2],
        m[3],
        m[4],
        F.when(P > 0, F.col("_ap_sum") / P.cast("double")).alias("average_precision"),
        tn,
        fp,
        fn,
        tp,
    )


def confusion(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "risk", label: str = "label", by: list[str] | tuple = ()
) -> DataFrame:
    """tn, fp, fn, tp at a threshold (one pass, conditional counts)."""
    pred = F.col(score) >= F.lit(float(threshold))
    y = F.col(label) == 1
    return valid_scores(df, score).groupBy(*by).agg(
        F.count_if(~pred & ~y).alias("tn"),
        F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"),
        F.count_if(pred & y).alias("tp"),
    )


def roc_auc(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    return standard_metrics(df, DEFAULT_THRESHOLD, score, label, by).select(*by, "auc")


def average_precision(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    return standard_metrics(df, DEFAULT_THRESHOLD, score, label, by).select(*by, "average_precision")


def roc_points(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, collinear points kept."""
    by = list(by)
    counts = score_counts(df, score, label, by)
    cum = running_totals(counts, score, ["pos", "neg"], by=by, ascending=False, inclusive=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    if by:
        cum = cum.join(totals, by, "inner")
        P, N = F.col("_P"), F.col("_N")
    else:  # two numbers
        t = totals.first()
        P, N = F.lit(t["_P"] or 0), F.lit(t["_N"] or 0)
    return cum.select(
        *by,
        F.col(score).alias("threshold"),
        F.when(N > 0, F.col("cum_neg") / N.cast("double")).alias("fpr"),
        F.when(P > 0, F.col("cum_pos") / P.cast("double")).alias("tpr"),
    )


def threshold_sweep(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    """Confusion counts and metrics at each of the 80 search thresholds.

    One pass: every row gets the number of thresholds it reaches, the rows
    are counted per (group, bin) -- at most 81 bins -- and each threshold's
    counts are sums over the bins above it, evaluated on a bounded array per
    group.  No row is repeated per threshold.
    """
    by = list(by)
    bins = valid_scores(df, score).groupBy(*by, threshold_bin(F.col(score)).alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    per_group = bins.groupBy(*by).agg(
        F.collect_list(F.struct("bin", "pos", "neg")).alias("_bins"),
        F.sum("pos").alias("_P"),
        F.sum("neg").alias("_N"),
    )

    def above(i: Column, field: str) -> Column:
        return F.aggregate(F.filter("_bins", lambda x: x["bin"] > i), F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    rows = per_group.select(
        *by,
        "_P",
        "_N",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(THRESHOLD_COUNT - 1)),
                lambda i: F.struct(i.alias("i"), above(i, "pos").alias("tp"), above(i, "neg").alias("fp")),
            )
        ).alias("_t"),
    )
    tp, fp = F.col("_t.tp"), F.col("_t.fp")
    fn, tn = F.col("_P") - tp, F.col("_N") - fp
    out = rows.select(
        *by,
        F.col("_t.i").alias("i"),
        threshold_value(F.col("_t.i")).alias("threshold"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
    )
    tn, fp, fn, tp = F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")
    m = _metric_columns(tn, fp, fn, tp)
    out = out.select(*by, "i", "threshold", "tn", "fp", "fn", "tp", m[1], m[2], m[3], m[4])
    balance = F.sqrt(F.pow(F.lit(1.0) - F.col("sensitivity"), 2) + F.pow(F.lit(1.0) - F.col("specificity"), 2))
    return out.withColumn("balance", balance)


def best_threshold(sweep: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Ordered fold over the sweep (ascending threshold): take a threshold when
    its F1 beats the best so far and its balance is below 1.1 x the best
    balance; start from 0.5 / F1 0 / balance infinity."""
    by = list(by)
    items = F.array_sort(F.collect_list(F.struct("i", "threshold", "f1_score", "balance")))
    init = F.struct(
        F.lit(DEFAULT_THRESHOLD).alias("t"), F.lit(0.0).alias("f1"), F.lit(float("inf")).alias("bal")
    )

    def step(acc: Column, x: Column) -> Column:
        better = (x["f1_score"] > acc["f1"]) & (x["balance"] < acc["bal"] * F.lit(BALANCE_TOLERANCE))
        return F.when(
            better, F.struct(x["threshold"].alias("t"), x["f1_score"].alias("f1"), x["balance"].alias("bal"))
        ).otherwise(acc)

    return sweep.groupBy(*by).agg(F.aggregate(items, init, step).alias("_best")).select(
        *by, F.col("_best.t").alias("threshold")
    )


def optimal_threshold(df: DataFrame, score: str = "risk", label: str = "label", by: list[str] | tuple = ()) -> DataFrame:
    """Best threshold of the search and the standard metrics at it."""
    by = list(by)
    best = best_threshold(threshold_sweep(df, score, label, by), by)
    return standard_metrics(df, best, score, label, by, with_threshold=True)


def classification_report(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "risk", label: str = "label"
) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` with
    precision, recall, f1_score, support (zero denominators give 0)."""
    c = confusion(df, threshold, score, label)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p0, r0, f0, s0 = ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp), ratio_or_zero(2 * tn, 2 * tn + fn + fp), tn + fp
    p1, r1, f1, s1 = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn), ratio_or_zero(2 * tp, 2 * tp + fp + fn), tp + fn
    acc = ratio_or_zero(tp + tn, n)
    w = lambda a, b: ratio_or_zero(a * s0 + b * s1, n)

    def row(name: str, p: Column | None, r: Column | None, f: Column, s: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("label"),
            (p if p is not None else none).alias("precision"),
            (r if r is not None else none).alias("recall"),
            f.alias("f1_score"),
            s.cast("long").alias("support"),
        )

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", None, None, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n),
    )
    return c.select(F.inline(rows))


def model_scores(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Composite comparison score per model and the best model flag.

    ``metrics`` has one row per model (a few rows), so the window over it
    is bounded by the number of models.
    """
    score = sum(F.lit(w) * F.col(c) for c, w in SCORE_WEIGHTS.items())
    out = metrics.withColumn("score", score)
    everyone = Window.partitionBy()
    return out.withColumn("is_best", F.col("score") == F.max("score").over(everyone)).withColumn(
        "rank", F.dense_rank().over(Window.orderBy(F.col("score").desc()))
    )


def transfer_gap(
    df: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    score: str = "risk",
    label: str = "label",
    key: str = "key",
    model_col: str = "model",
    train_percent: int = 80,
) -> DataFrame:
    """Accuracy on the training share minus accuracy on the held-out share, per model."""
    is_train = hash_order(key, 7919, SEED) % 100 < train_percent
    correct = predict(score, threshold) == F.col(label)
    agg = valid_scores(df, score).groupBy(model_col).agg(
        F.count_if(is_train & correct).alias("_tc"),
        F.count_if(is_train).alias("_tn"),
        F.count_if(~is_train & correct).alias("_vc"),
        F.count_if(~is_train).alias("_vn"),
    )
    train_acc = ratio_or_zero(F.col("_tc"), F.col("_tn"))
    val_acc = ratio_or_zero(F.col("_vc"), F.col("_vn"))
    return agg.select(
        model_col,
        train_acc.alias("train_accuracy"),
        val_acc.alias("validation_accuracy"),
        (train_acc - val_acc).alias("gap"),
    )
