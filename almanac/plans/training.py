"""The two-stage model, its validation and its registry."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import unlog_target
from ..operators.correlation import correlation_filter
from ..operators.features import FEATURES, impute_for_training, sample_weights, with_training_weights
from ..operators.stats import entries_since_training
from ..operators.timeseries import pooled_folds
from ..session import Written, ensure_checkpoint_dir, materialize

# The 16 decision thresholds tried, 0.10 to 0.85.
THRESHOLDS = [round(0.1 + 0.05 * i, 2) for i in range(16)]
DEFAULT_THRESHOLD = 0.5
KEEP_VERSIONS = 2
MANIFEST = "manifest.json"
#: Rows that one task of a boosting round folds; fewer tasks would idle cores, more only add scheduling.
ROWS_PER_TASK = 16_384
#: Folds that are fitted at a time, each with its two ensembles side by side.
FOLDS_AT_A_TIME = 5


@dataclass(frozen=True)
class TrainingConfig:
    """Boosting settings; the defaults are those of the full training run."""

    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.05
    seed: int = 42
    folds: int = 5
    features: tuple = field(default=FEATURES)


class HurdleModel(Transformer):
    """Occurrence and severity pipelines applied in one ``transform``.

    Adds ``episode_probability`` (0-1) and ``severity`` (0-10).
    """

    def __init__(self, classifier: PipelineModel, regressor: PipelineModel, features):
        super().__init__()
        self.classifier, self.regressor, self.features = classifier, regressor, tuple(features)

    def _transform(self, df: DataFrame) -> DataFrame:
        # Inputs a caller does not have are null and get the trained fill value.
        absent = [c for c in self.features if c not in df.columns]
        given = df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df
        scored = self.regressor.transform(self.classifier.transform(given))
        log_pain = F.greatest(F.col("log_prediction"), F.lit(0.0))
        return scored.select(
            *[F.col(c) for c in df.columns],
            vector_to_array("class_probability")[1].alias("episode_probability"),
            F.least(unlog_target(log_pain), F.lit(10.0)).alias("severity"),
            log_pain.alias("log_severity"),
        )


def _feature_means(df: DataFrame, features) -> dict[str, float]:
    """Mean of every feature that has a value; all-null features are left out."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    return {c: row[c] for c in features if row[c] is not None}


def _stages(means: dict[str, float]):
    """Fill gaps with the training mean, then assemble: two stages a saved model keeps."""
    filled = ", ".join(f"coalesce(cast(`{c}` as double), {m!r}D) as `{c}__filled`" for c, m in means.items())
    return [
        SQLTransformer(statement=f"select *, {filled} from __THIS__"),
        VectorAssembler(inputCols=[f"{c}__filled" for c in means], outputCol="feature_vector"),
    ]


def _side_by_side(spark: SparkSession, calls):
    """Results of independent pieces of work, run from one thread each so that their jobs overlap."""
    with ThreadPoolExecutor(max_workers=len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def train_hurdle(features: DataFrame, config: TrainingConfig = TrainingConfig(), columns=None) -> HurdleModel:
    """K1: weighted boosting for "any pain" and for ``log(1 + pain)`` over all rows.

    Features are assembled once and written, because boosting reads them many times; pass a
    written frame, since means and class sizes are read from it first. Both ensembles are fitted
    at once: a round is a chain of small jobs, and the other's fill the gaps between them.
    """
    spark = features.sparkSession
    ensure_checkpoint_dir(spark)
    means = _feature_means(features, list(columns or config.features))
    columns = list(means)
    prepared = with_training_weights(features).withColumn("label", F.col("pain_binary").cast("double"))
    prep = PipelineModel(_stages(means))
    written = Written(
        prep.transform(prepared).select("feature_vector", "label", "pain_log", "sample_weight", "train_weight"), "training"
    )
    tasks = max(1, -(-written.frame.count() // ROWS_PER_TASK))
    data = written.frame.coalesce(tasks)
    common = dict(
        featuresCol="feature_vector",
        maxIter=config.max_iter,
        maxDepth=config.max_depth,
        stepSize=config.step_size,
        seed=config.seed,
        checkpointInterval=10,
    )
    classifier = GBTClassifier(labelCol="label", weightCol="train_weight", predictionCol="class_prediction", **common)
    classifier = classifier.setProbabilityCol("class_probability").setRawPredictionCol("class_raw")
    regressor = GBTRegressor(labelCol="pain_log", weightCol="sample_weight", predictionCol="log_prediction", **common)
    clf, reg = _side_by_side(spark, [lambda: classifier.fit(data), lambda: regressor.fit(data)])
    written.drop()
    return HurdleModel(PipelineModel(prep.stages + [clf]), PipelineModel([reg]), columns)


def _tree_sql(node, names) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    left, right = (_tree_sql(child, names) for child in (node.leftChild(), node.rightChild()))
    return f"if({names[split.featureIndex()]} <= {split.threshold()!r}D, {left}, {right})"


def _ensemble_sql(model, names) -> str:
    terms = (f"{weight!r}D * {_tree_sql(tree._call_java('rootNode'), names)}" for weight, tree in zip(model.treeWeights, model.trees))
    return " + ".join(terms)


def export_sql(model: HurdleModel) -> dict[str, str]:
    """K1: the trained model as plain SQL over the feature columns: ``episode_probability``,
    ``log_severity`` and ``severity``, with every gap filled as in training.

    The expressions need no model file and run wherever SQL does; all ``model.features`` must be columns.
    """
    statement = model.classifier.stages[0].getStatement()
    filled = statement[len("select *, ") : -len(" from __THIS__")].split(", coalesce(")
    filled = [filled[0], *(f"coalesce({f}" for f in filled[1:])]
    names = [f"({f[: f.rindex(' as ')]})" for f in filled]
    margin = _ensemble_sql(model.classifier.stages[-1], names)
    log_pain = f"greatest({_ensemble_sql(model.regressor.stages[-1], names)}, 0D)"
    return {
        "episode_probability": f"1D / (1D + exp(-2D * ({margin})))",
        "log_severity": log_pain,
        "severity": f"least(expm1({log_pain}), 10D)",
    }


def _f1(tp, fp, fn):
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def threshold_sweep(scored: DataFrame, keys=(), probability: str = "episode_probability", label: str = "pain_binary") -> DataFrame:
    """K2: best F1 over the 16 thresholds; a tie keeps the lowest, all-zero keeps 0.5.

    One aggregation counts hits for all thresholds at once.
    """
    p, y = F.col(probability), F.col(label) > 0
    counts = []
    for i, t in enumerate(THRESHOLDS):
        hit = p >= t
        counts += [
            F.count_if(hit & y).alias(f"tp{i}"), F.count_if(hit & ~y).alias(f"fp{i}"), F.count_if(~hit & y).alias(f"fn{i}")
        ]
    table = scored.groupBy(*keys).agg(*counts)
    scores = F.array(
        *[
            F.struct(_f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")).alias("f1"), F.lit(-t).alias("low_first"))
            for i, t in enumerate(THRESHOLDS)
        ]
    )
    best = F.array_max(scores)
    return table.withColumn("best", best).select(
        *keys,
        F.when(F.col("best.f1") > 0, -F.col("best.low_first")).otherwise(DEFAULT_THRESHOLD).alias("threshold"),
        F.col("best.f1").alias("f1"),
    )


def hurdle_metrics(scored: DataFrame, keys=(), label: str = "pain_binary") -> DataFrame:
    """K4: classification and severity metrics from one aggregation.

    ``scored`` has the label, ``predicted`` (0/1), ``pain`` and ``predicted_pain``.
    """
    y, hit = F.col(label) > 0, F.col("predicted") > 0
    error = F.abs(F.col("pain") - F.col("predicted_pain"))
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y).alias("positives"),
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"),
        F.avg(error).alias("mae"),
        F.coalesce(F.avg(F.when(y, error)), F.lit(0.0)).alias("mae_painful"),
    )
    n, tp, fp, fn = F.col("n"), F.col("tp"), F.col("fp"), F.col("fn")
    share = F.col("positives") / n
    zero = F.lit(0.0)
    return sums.select(
        *keys,
        "n",
        ((n - fp - fn) / n).alias("accuracy"),
        F.greatest(share, 1 - share).alias("baseline_accuracy"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), zero).alias("precision"),
        F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), zero).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        "mae",
        "mae_painful",
    )


def apply_threshold(scored: DataFrame, threshold) -> DataFrame:
    """Gate the severity in log space, then return to the 0-10 scale."""
    hit = (F.col("episode_probability") >= threshold).cast("int")
    return scored.withColumns(
        {"predicted": hit, "predicted_pain": unlog_target(F.greatest(F.col("log_severity"), F.lit(0.0)) * hit)}
    )


def fold_days(features: DataFrame, folds: int) -> list[tuple]:
    """First test day and first day after of every fold of a written frame."""
    span = features.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return [] if span["lo"] is None else pooled_folds(span["lo"], span["hi"], folds)


def validate_fold(data: DataFrame, days: tuple, number: int, config: TrainingConfig = TrainingConfig()) -> tuple:
    """K3, one fold: fit on the days before ``days``, choose the threshold on them, and measure there.

    ``data`` is a written frame that all folds share; a fold is nothing but a filter on its days.
    """
    start, end = days
    train = data.where(F.col("date") < F.lit(start))
    test = data.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    kept, _ = correlation_filter(train, config.features)
    model = train_hurdle(train, config, kept)
    scored = Written(model.transform(test).select("pain", "pain_binary", "episode_probability", "log_severity"), "fold")
    chosen = threshold_sweep(scored.frame).first()["threshold"]
    row = hurdle_metrics(apply_threshold(scored.frame, chosen)).first()
    scored.drop()
    return number, chosen, *row


FOLD_METRICS = (
    "fold int, threshold double, n long, accuracy double, baseline_accuracy double, precision double, recall double, "
    "f1 double, mae double, mae_painful double"
)


def cross_validate(features: DataFrame, config: TrainingConfig = TrainingConfig()) -> DataFrame:
    """K3: expanding-window validation; one row of metrics per fold, none without days.

    Features are written once for all folds. Folds are fitted side by side: their rounds are
    chains of small jobs that leave most cores idle one at a time. Selecting features, fitting
    and scoring are Spark jobs; the driver keeps one row a fold.
    """
    spark = features.sparkSession
    written = Written(impute_for_training(features), "folds")
    folds = list(enumerate(fold_days(written.frame, config.folds), start=1))
    rows = []
    for first in range(0, len(folds), FOLDS_AT_A_TIME):
        some = folds[first : first + FOLDS_AT_A_TIME]
        rows += _side_by_side(spark, [lambda n=n, days=days: validate_fold(written.frame, days, n, config) for n, days in some])
    written.drop()
    return spark.createDataFrame(rows, FOLD_METRICS)


def regression_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """K5: R2, MAE, MSE and RMSE from one aggregation."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return scored.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var_y")
    ).select(
        (1 - F.col("mse") / F.nullif(F.col("var_y"), F.lit(0.0))).alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse")
    )


def forest_grid_search(features: DataFrame, columns=FEATURES, *, grid: dict, folds: int = 3, seed: int = 42, parallelism: int = 2):
    """Exhaustive search over a regression forest; returns (best model, score table).

    ``grid`` lists the values of ``trees``, ``depth``, ``leaf`` and ``bootstrap``.
    """
    prepared = PipelineModel(_stages(_feature_means(features, columns))).transform(features)
    data = materialize(prepared.select("feature_vector", "pain_log"), "forest")
    forest = RandomForestRegressor(featuresCol="feature_vector", labelCol="pain_log", seed=seed)
    maps = (
        ParamGridBuilder()
        .addGrid(forest.numTrees, grid["trees"])
        .addGrid(forest.maxDepth, grid["depth"])
        .addGrid(forest.minInstancesPerNode, grid["leaf"])
        .addGrid(forest.bootstrap, grid["bootstrap"])
        .build()
    )
    search = CrossValidator(
        estimator=forest,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol="pain_log", metricName="r2"),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    ).fit(data)
    names = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "leaf", "bootstrap": "bootstrap"}
    rows = [
        ({names[p.name]: v for p, v in params.items()}, float(score)) for params, score in zip(maps, search.avgMetrics)
    ]
    table = features.sparkSession.createDataFrame(
        [(p["trees"], p["depth"], p["leaf"], p["bootstrap"], s) for p, s in rows],
        "trees int, depth int, leaf int, bootstrap boolean, r2 double",
    )
    return search.bestModel, table


# --- A11, K7: versions -----------------------------------------------------------------


def model_retention(registry: DataFrame, keep: int = KEEP_VERSIONS) -> DataFrame:
    """Number versions from the newest and flag those beyond the ones kept."""
    newest = Window.partitionBy("model_name").orderBy(F.col("version").desc())
    return registry.withColumn("age_rank", F.row_number().over(newest)).withColumn(
        "is_kept", F.col("age_rank") <= keep
    )


def needs_retrain(log: DataFrame, registry: DataFrame, threshold: int = 5) -> DataFrame:
    """K7: D19 against each subject's latest training day."""
    latest = registry.groupBy("subject_id").agg(F.max("trained_at").cast("date").alias("last_trained"))
    return entries_since_training(log, latest, threshold)


def _hadoop_fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def list_versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, newest first: those with a manifest."""
    fs, target = _hadoop_fs(spark, root)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    found = (int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return sorted((v for v in found if fs.exists(_hadoop_fs(spark, _manifest(root, v))[1])), reverse=True)


def _manifest(root: str, version: int) -> str:
    return f"{root}/version={version}/{MANIFEST}"


def save_model(model: HurdleModel, root: str, version: int | None = None, keep: int = KEEP_VERSIONS) -> int:
    """Save both stages under a new version and drop all but the newest ``keep``.

    The manifest, which names the features, is written aside and renamed into the version's
    folder last, so a version is seen whole or not at all. What an earlier try left in the
    folder is replaced; a complete version is never overwritten.
    """
    spark = SparkSession.active()
    version = version if version is not None else int(time.time())
    base = f"{root}/version={version}"
    fs, final = _hadoop_fs(spark, _manifest(root, version))
    if fs.exists(final):
        raise ValueError(f"version {version} exists")
    model.classifier.write().overwrite().save(f"{base}/classifier")
    model.regressor.write().overwrite().save(f"{base}/regressor")
    draft = _hadoop_fs(spark, f"{base}/{MANIFEST}.{uuid.uuid4().hex}")[1]
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps({"version": version, "features": model.features}).encode()))
    stream.close()
    if not fs.rename(draft, final):
        raise ValueError(f"version {version} exists")
    for old in list_versions(spark, root)[keep:]:
        # hidden first, so that no reader meets it half gone
        fs.delete(_hadoop_fs(spark, _manifest(root, old))[1], False)
        fs.delete(_hadoop_fs(spark, f"{root}/version={old}")[1], True)
    return version


def load_latest(spark: SparkSession, root: str) -> HurdleModel | None:
    """The newest complete model, with its ``version``, or ``None`` when there is none."""
    versions = list_versions(spark, root)
    if not versions:
        return None
    base = f"{root}/version={versions[0]}"
    fs, manifest = _hadoop_fs(spark, _manifest(root, versions[0]))
    stream = fs.open(manifest)
    try:
        told = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    model = HurdleModel(PipelineModel.load(f"{base}/classifier"), PipelineModel.load(f"{base}/regressor"), told["features"])
    model.version = told["version"]
    return model


def training_frame(features: DataFrame) -> DataFrame:
    """Features with serving defaults and sample weights, ready for K1 and K3."""
    return sample_weights(impute_for_training(features))
