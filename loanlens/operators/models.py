"""PD models on Spark ML (inventory 2.H).

Preprocessing (``preprocess``) is fitted on the training population only and
applied to the scoring population (no out-of-time leakage).

Fitting is distributed (treeAggregate / histogram-based trees); the training
frame is checkpointed once so iterative solvers re-read the written rows, not
the lineage.  Mapping of hyperparameters to the reference's estimators is
documented per builder; boosted trees cannot match another library bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators import boosting
from loanlens.operators.isotonic import apply_isotonic, isotonic_blocks
from loanlens.operators.metrics import binary_metrics, expected_calibration_error
from loanlens.operators.preprocess import Preparation, fit_preparation
from loanlens.operators.split import LABEL, feature_groups
from loanlens.session import materialize


#: Rows that are worth a task of their own.
TASK_ROWS = 20_000


def apply_categorical(df: DataFrame, prep: Preparation, categorical: Sequence[str]) -> DataFrame:
    """``df`` with the slots of its categorical values (``Preparation.slots``)."""
    return prep.slots(df) if categorical else df


def logistic(n_train: int, max_iter: int = 500) -> LogisticRegression:
    """L2 logistic regression equal to a C=1 summed-loss objective: regParam = 1/n (H3)."""
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter,
                              regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)


def boosted(max_iter: int = 250, step: float = 0.05, depth: int = 4, min_instances: int = 100,
            subsample: float = 0.8, feature_subset: str = "0.8", seed: int = 42) -> GBTClassifier:
    """First-order gradient-boosted trees of Spark ML, with a floor of rows in a leaf.  ``boosting.Params`` (second
    order, Hessian floor, H4) and ``boosting.LEAF_WISE`` (H5) are estimators as well."""
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, stepSize=step,
                         maxDepth=depth, minInstancesPerNode=min_instances, subsamplingRate=subsample,
                         featureSubsetStrategy=feature_subset, seed=seed, maxBins=64)


def forest(trees: int = 400, depth: int = 8, min_leaf: int = 30, seed: int = 42) -> RandomForestClassifier:
    """Random forest (H6)."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed)


class FittedModel:
    """A preparation, stages up to the vector of features, and a model: a Spark ML one (last stage) or ``boosted`` trees."""

    def __init__(self, name, pipeline: PipelineModel, prep: Preparation, numeric, categorical, boosted=None):
        self.name, self.pipeline, self.prep, self.boosted = name, pipeline, prep, boosted
        self.numeric, self.categorical = numeric, categorical

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """PD = P(class 1) (H7)."""
        pred = self.pipeline.transform(apply_categorical(df, self.prep, self.categorical))
        pd = self.boosted.pd_of(vector_to_array("features")) if self.boosted else vector_to_array(F.col("probability"))[1]
        return pred.withColumn(out, pd).select(*[c for c in df.columns if c != out], out)

    def feature_names(self) -> list[str]:
        """Readable names of the assembled feature slots (numeric, then one-hot levels).

        Checked against the length that the fitted estimator saw.
        """
        names = self.prep.names()
        slots = len(self.boosted.edges) if self.boosted else self.pipeline.stages[-1].numFeatures
        if len(names) != slots:
            raise ValueError(f"{len(names)} feature names for {slots} slots")
        return names

    def gains(self) -> list[float]:
        return (self.boosted.gains() if self.boosted else self.pipeline.stages[-1].featureImportances.toArray()).tolist()


def spread(df: DataFrame) -> DataFrame:
    """``df`` (stored) in as many partitions as there are cores, if it has fewer and its rows are many enough.

    Iterative solvers work in the partitions that they are given, and a stored table has as many as its files.
    """
    rows = -(-df.count() // TASK_ROWS)
    tasks = min(rows, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def fit(train: DataFrame, estimator_name: str, estimator, label: str = LABEL, numeric=None, categorical=None,
        min_frequency: int = 25, id_col: str = "loan_id") -> FittedModel:
    """``estimator``: a Spark ML classifier, or ``boosting.Params`` (whose rows are drawn by ``id_col``)."""
    if numeric is None or categorical is None:
        numeric, categorical = feature_groups(train)
    prep = fit_preparation(train, numeric, categorical, min_frequency)
    x = materialize(prep.slots(train).withColumn("label", F.col(label).cast("double")))
    stages = prep.stages(scale=isinstance(estimator, LogisticRegression))
    if isinstance(estimator, boosting.Params):
        features = PipelineModel(stages).transform(x).withColumn("_features", vector_to_array("features"))
        model = boosting.fit(features, "_features", "label", F.col(id_col), estimator)
        return FittedModel(estimator_name, PipelineModel(stages), prep, numeric, categorical, model)
    fitted = estimator.fit(spread(PipelineModel(stages).transform(x)))
    return FittedModel(estimator_name, PipelineModel([*stages, fitted]), prep, numeric, categorical)


def train_models(train: DataFrame, test: DataFrame, estimators: dict, label: str = LABEL,
                 id_col: str = "loan_id", keep_cols: Sequence[str] = ("origination_date", "observation_date",
                                                                       "original_upb")):
    """Champion-challenger run (H9): same split, several models; returns
    (models, metrics, scored) where ``scored`` has one ``<name>_pd`` column per model."""
    numeric, categorical = feature_groups(train)
    models = {name: fit(train, name, est, label, numeric, categorical, id_col=id_col) for name, est in estimators.items()}
    base_cols = [id_col, label, *[c for c in keep_cols if c in test.columns]]
    wide = test
    for name, m in models.items():
        wide = m.score(wide, f"{name}_pd")
    scored = materialize(wide.select(*base_cols, *[f"{name}_pd" for name in models]))
    metrics = None
    for name in models:
        one = binary_metrics(scored, label, f"{name}_pd").withColumn("model", F.lit(name))
        metrics = one if metrics is None else metrics.unionByName(one)
    return models, metrics, scored


def importance(model: FittedModel) -> DataFrame:
    """Tree importance with readable feature names, sorted."""
    rows = list(zip(model.feature_names(), model.gains(), strict=True))
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    return ss.createDataFrame(rows, "feature string, gain double").orderBy(F.col("gain").desc(), "feature")


def coefficients(model: FittedModel) -> DataFrame:
    """Coefficient table: coefficient, odds ratio exp(coef), direction."""
    est = model.pipeline.stages[-1]
    names = model.feature_names()
    coefs = est.coefficients.toArray().tolist()
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession()
    df = ss.createDataFrame(list(zip(names, coefs, strict=True)), "feature string, coefficient double")
    return (df.withColumn("odds_ratio_per_standard_deviation", F.exp("coefficient"))
              .withColumn("risk_direction", F.when(F.col("coefficient") >= 0, "higher_risk").otherwise("lower_risk"))
              .orderBy(F.col("coefficient").desc(), "feature"))


def isotonic_calibrate(calibration: DataFrame, target: DataFrame, score: str, label: str = LABEL,
                       out: str = "calibrated_pd") -> DataFrame:
    """Fit an increasing isotonic map score -> PD on a held-out cohort and apply it,
    clipping outside the fitted range (H8)."""
    return apply_isotonic(target, isotonic_blocks(calibration, score, label), score, out)


def calibration_versions(calibrated: DataFrame, raw: str, iso: str, keep: Sequence[str]) -> DataFrame:
    """Raw and calibrated scores under each other: ``keep``, ``score_version``, ``score``."""
    both = F.array(F.struct(F.lit("raw").alias("score_version"), F.col(raw).alias("score")),
                   F.struct(F.lit("isotonic").alias("score_version"), F.col(iso).alias("score")))
    return calibrated.select(*keep, F.inline(both))


def calibration_report(versions: DataFrame, label: str, id_col: str) -> DataFrame:
    """AUC, KS, average precision, Brier score and ECE of each score version."""
    stored = materialize(versions)
    ece = expected_calibration_error(stored, label, "score", id_col, groups=["score_version"])
    return binary_metrics(stored, label, "score", ["score_version"]).join(ece, "score_version")
