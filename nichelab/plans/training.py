"""Training sets, boosted-tree training with cross-validation, scoring, evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelab.operators import filters, metrics, sampling
from nichelab.session import ensure_checkpoint_dir
from nichelab.schemas import (
    BACKGROUND_GLOBAL,
    BACKGROUND_LOCAL,
    CV_FOLDS,
    FEATURE_COLUMNS,
    GBT_FEATURE_SUBSET,
    GBT_MAX_DEPTH_GRID,
    GBT_MAX_ITER,
    GBT_STEP_SIZE,
    GBT_SUBSAMPLE,
    GRID_FILL_VALUES,
    LOCAL_LAT_BOUNDS,
    LOCAL_LON_BOUNDS,
    RF_MAX_DEPTH,
    RF_MIN_LEAF,
    RF_NUM_TREES,
    SEED,
    WORLD_LAT_BOUNDS,
    WORLD_LON_BOUNDS,
)


def _labelled(df: DataFrame) -> tuple[DataFrame, tuple[bool, bool] | None]:
    # a label added here is 1 everywhere: the class check is known without a pass
    if "presence" in df.columns:
        return df, None
    return filters.add_presence_default(df), (True, False)


def training_set(global_df: DataFrame) -> DataFrame:
    """Global table labelled (presence = 1 when absent), plus 500 worldwide
    background rows when a class is missing."""
    g, known = _labelled(global_df)
    return sampling.with_background(g, BACKGROUND_GLOBAL, WORLD_LAT_BOUNDS, WORLD_LON_BOUNDS, known=known)


def validation_set(local_df: DataFrame) -> DataFrame:
    """Local table labelled, plus 100 background rows inside the local bounds
    when a class is missing."""
    loc, known = _labelled(local_df)
    return sampling.with_background(loc, BACKGROUND_LOCAL, LOCAL_LAT_BOUNDS, LOCAL_LON_BOUNDS, known=known)


def prepare_training(global_df: DataFrame, local_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both labelled tables with background rows where a class is missing."""
    return training_set(global_df), validation_set(local_df)


def class_balance(df: DataFrame, label: str = "presence") -> DataFrame:
    y = F.col(label)
    agg = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("n_presence"),
        F.coalesce(F.max((y == 1).cast("int")), F.lit(0)).cast("boolean").alias("has_presence"),
        F.coalesce(F.max((y == 0).cast("int")), F.lit(0)).cast("boolean").alias("has_background"),
    )
    return agg.select(
        "n_rows", "n_presence", (F.col("n_rows") - F.col("n_presence")).alias("n_background"), "has_presence", "has_background"
    )


def features(df: DataFrame) -> DataFrame:
    """The 13 model features with gaps filled by the fixed defaults (the learner
    rejects NaN); an absent feature column counts as all gaps (0 where there is no default)."""
    absent = {c: F.lit(GRID_FILL_VALUES.get(c, 0.0)) for c in FEATURE_COLUMNS if c not in df.columns}
    return filters.fill_defaults(df.withColumns(absent) if absent else df, GRID_FILL_VALUES)


# bytes a training row takes in the tree learner (13 doubles, label, weight, overhead)
TRAINING_ROW_BYTES = 160
TARGET_PARTITION_BYTES = 128 * 1024 * 1024
# rows that are worth a task of their own in a tree learner's short jobs
ROWS_PER_TASK = 20_000


def partition_count(rows: int, cores: int, row_bytes: int = TRAINING_ROW_BYTES, target: int = TARGET_PARTITION_BYTES) -> int:
    """A core per ``ROWS_PER_TASK`` rows as long as there are cores, and never more than ``target`` bytes per partition."""
    return max(1, -(-rows * row_bytes // target), min(cores, -(-rows // ROWS_PER_TASK)))


@contextmanager
def learner_input(df: DataFrame, key: str = "key") -> Iterator[DataFrame]:
    """The rows persisted, dealt by key hash into ``partition_count`` partitions; released at the end.

    The input is computed once, in the partitions it comes in (its scan and joins
    stay parallel), counted there, and only then dealt for the learner.
    """
    whole = df.persist()
    try:
        n = partition_count(whole.count(), df.sparkSession.sparkContext.defaultParallelism)
        dealt = whole.repartition(n, key).persist()
        dealt.count()
    finally:
        whole.unpersist()
    try:
        yield dealt
    finally:
        dealt.unpersist()


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features", handleInvalid="keep")


def gbt_pipeline(max_depth: int = GBT_MAX_DEPTH_GRID[0], max_iter: int = GBT_MAX_ITER) -> tuple[Pipeline, GBTClassifier]:
    gbt = GBTClassifier(
        labelCol="presence",
        featuresCol="features",
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=GBT_STEP_SIZE,
        subsamplingRate=GBT_SUBSAMPLE,
        featureSubsetStrategy=GBT_FEATURE_SUBSET,
        seed=SEED,
        checkpointInterval=10,  # effective when the cluster names spark.checkpoint.dir
    )
    return Pipeline(stages=[_assembler(), gbt]), gbt


def rf_pipeline(num_trees: int = RF_NUM_TREES) -> Pipeline:
    rf = RandomForestClassifier(
        labelCol="presence",
        featuresCol="features",
        numTrees=num_trees,
        maxDepth=RF_MAX_DEPTH,
        minInstancesPerNode=RF_MIN_LEAF,
        seed=SEED,
    )
    return Pipeline(stages=[_assembler(), rf])


def wide_param_grid(gbt: GBTClassifier) -> list:
    """The wider grid declared next to the default one (not used by default):
    depth {3,5,7} x step {0.01,0.1,0.2} x trees {50,100,200} x row sampling
    {0.8,1.0} x feature sampling {0.8,1.0} x minimum split gain {0,0.1}
    (216 settings).  The booster's L1/L2 leaf penalties have no counterpart
    in Spark's GBT and are left out."""
    return (
        ParamGridBuilder()
        .addGrid(gbt.maxDepth, [3, 5, 7])
        .addGrid(gbt.stepSize, [0.01, 0.1, 0.2])
        .addGrid(gbt.maxIter, [50, 100, 200])
        .addGrid(gbt.subsamplingRate, [0.8, 1.0])
        .addGrid(gbt.featureSubsetStrategy, ["0.8", "all"])
        .addGrid(gbt.minInfoGain, [0.0, 0.1])
        .build()
    )


@dataclass
class TunedModel:
    """Outcome of a grid search: the refit best pipeline and the mean fold AUC per setting."""

    bestModel: PipelineModel
    depths: list[int]
    avgMetrics: list[float]
    settings: list[dict] = field(default_factory=list)


def depth_grid(depths: list[int] = GBT_MAX_DEPTH_GRID) -> list[dict]:
    return [{"maxDepth": d} for d in depths]


def wide_grid() -> list[dict]:
    """``wide_param_grid`` as plain settings, for ``tune_gbt(..., settings=wide_grid())``."""
    _, gbt = gbt_pipeline()
    return [{p.name: v for p, v in m.items()} for m in wide_param_grid(gbt)]


def tune_gbt(
    train: DataFrame,
    depths: list[int] = GBT_MAX_DEPTH_GRID,
    folds: int = CV_FOLDS,
    max_iter: int = GBT_MAX_ITER,
    parallelism: int | None = None,
    settings: list[dict] | None = None,
    search_on_split: bool = True,
) -> TunedModel:
    """Grid search with k-fold ROC AUC on the 80 % split; the best setting is
    refit on all training rows.

    ``settings`` are parameter settings of the boosted trees (default: one per
    depth).  The split and the folds come from hashes of the key, so they are
    fixed whatever the partitioning.  Every (setting, fold) fit is submitted from
    a thread pool -- concurrent Spark jobs -- on one persisted input.  Fits that
    run side by side share the cores: each reads the input in as many partitions
    as fill its share.  A fit is hundreds of short jobs, and every task of each
    sends some kilobytes to the driver; only the last fit has all cores to itself.
    """
    from concurrent.futures import ThreadPoolExecutor

    ensure_checkpoint_dir(train.sparkSession)
    grid = settings or depth_grid(depths)
    evaluator = BinaryClassificationEvaluator(labelCol="presence", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    marks = {"fold": sampling.fold_id("key", folds, label="presence"), "split": sampling.split_label("key")}
    workers = parallelism or min(len(grid) * folds, 8)
    with learner_input(features(train).withColumns(marks)) as data:
        searched = data.filter(F.col("split") == "train") if search_on_split else data
        # merges partitions of the persisted rows, none of them moves through a shuffle; 1 stays 1
        searched = searched.coalesce(partition_count(data.count(), -(-data.sparkSession.sparkContext.defaultParallelism // workers)))

        def pipeline(setting: dict) -> Pipeline:
            pipe, gbt = gbt_pipeline(max_iter=max_iter)
            gbt.setParams(**setting)
            return pipe

        def fold_auc(task: tuple[int, int]) -> float:
            i, k = task
            model = pipeline(grid[i]).fit(searched.filter(F.col("fold") != k))
            return float(evaluator.evaluate(model.transform(searched.filter(F.col("fold") == k))))

        tasks = [(i, k) for i in range(len(grid)) for k in range(folds)]
        with ThreadPoolExecutor(max_workers=workers) as pool:
            results = list(pool.map(fold_auc, tasks))
        means = [sum(results[i * folds : (i + 1) * folds]) / folds for i in range(len(grid))]
        model = pipeline(grid[max(range(len(grid)), key=lambda i: means[i])]).fit(data)
    return TunedModel(model, [s.get("maxDepth", GBT_MAX_DEPTH_GRID[0]) for s in grid], means, grid)


def cv_results(model: TunedModel) -> list[tuple[int, float]]:
    """(max_depth, mean fold AUC) per grid setting."""
    return list(zip(model.depths, model.avgMetrics))


def fold_mean_auc(scored: DataFrame, folds: int = CV_FOLDS, by: list[str] | tuple[str, ...] = ("model",), key: str = "key") -> DataFrame:
    """Mean ROC AUC over the key-hash folds of already scored rows, per group (``risk``, ``label``)."""
    with_fold = scored.withColumn("fold", sampling.fold_id(key, folds, label="label"))
    per_fold = metrics.standard_metrics(with_fold, 0.5, by=[*by, "fold"])
    return per_fold.groupBy(*by).agg(F.count("auc").alias("n_folds"), F.avg("auc").alias("mean_auc"))


def score(model, df: DataFrame, out_col: str = "risk") -> DataFrame:
    """Class-1 probability of every row (the learner sees filled features)."""
    pred = model.transform(features(df))
    return pred.withColumn(out_col, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model, spark) -> DataFrame:
    """(feature, importance) of the fitted tree ensemble, highest first."""
    stage = model.bestModel.stages[-1] if isinstance(model, (CrossValidatorModel, TunedModel)) else model.stages[-1]
    vec = stage.featureImportances.toArray().tolist()
    rows = [(name, float(v)) for name, v in zip(FEATURE_COLUMNS, vec)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importances(imp: DataFrame, k: int = 10) -> DataFrame:
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


@dataclass
class TrainingResult:
    model: TunedModel
    scored: DataFrame
    threshold: float
    metrics: DataFrame
    cv: list[tuple[int, float]]
    summary: DataFrame


def train_and_evaluate(
    train: DataFrame,
    validation: DataFrame | None,
    limit_rows: int = 0,
    max_iter: int = GBT_MAX_ITER,
    depths: list[int] = GBT_MAX_DEPTH_GRID,
    tuned: TunedModel | None = None,
) -> TrainingResult:
    """Subsample (optional), tune + refit (unless ``tuned`` is given), score
    validation (or the training rows when there is none), search the
    threshold, report metrics.  ``scored`` stays persisted; unpersist it when done."""
    train, validation = sampling.subsample(train, validation, limit_rows)
    cvm = tuned or tune_gbt(train, depths=depths, max_iter=max_iter)
    target = validation if validation is not None else train
    scored = score(cvm.bestModel, target).select("key", "presence", "risk").persist()
    spark = train.sparkSession
    # the scores are read by the sweep, the quantiles, the running totals and the counts
    best = metrics.optimal_threshold(scored, score="risk", label="presence")
    row = best.first()
    best = spark.createDataFrame([row], best.schema)
    top = [f"{r['feature']}={r['importance']:.6f}" for r in top_importances(importances(cvm, spark), 10).collect()]
    # one summary row (J8): sizes, subsample flag, the searched threshold and its metrics, the strongest features
    fields = ["training_rows long", "validation_rows long", "subsampled boolean"]
    fields += [f"{f.name} {f.dataType.simpleString()}" for f in best.schema.fields] + ["top_features string"]
    n_target = scored.count()
    n_train = n_target if validation is None else train.count()
    values = (n_train, n_target, bool(limit_rows and limit_rows > 0), *[row[c] for c in best.columns], ", ".join(top))
    summary = spark.createDataFrame([values], ", ".join(fields))
    return TrainingResult(cvm, scored, float(row["threshold"]), best, cv_results(cvm), summary)


def save_model(model, path: str) -> None:
    target = model.bestModel if isinstance(model, (CrossValidatorModel, TunedModel)) else model
    target.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
