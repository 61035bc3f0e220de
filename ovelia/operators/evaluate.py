"""Splits, classifiers and metrics for rare classes. Label 1 is the positive class."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.shipping import ship
from ..functions.stages import cut, numbered
from .distance import Block, knn
from .numerics import SVC, platt
from .samplers import _arrays, _out

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity", "g_mean", "auc_roc"]
#: Ranges of scores whose counts are summed before scores are ranked.
SCORE_BUCKETS = 4096
CLASSIFIERS = ("decision_tree", "random_forest", "logistic_regression", "naive_bayes", "knn", "svm")


def ranked_in_class(df: DataFrame, seed: int, salt: str) -> DataFrame:
    """df with n, a row's place in its class by hash, and m, the class's size."""
    parts = []
    for r in sorted(df.groupBy("label").count().collect()):
        x = numbered(df.where(F.col("label") == r["label"]).withColumn("_u", uniform(seed, salt, "id")), F.col("_u"), F.col("id")).drop("_u")
        parts.append(x.withColumn("m", F.lit(r["count"]).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_split(df: DataFrame, test: float = 0.3, seed: int = 42) -> DataFrame:
    """df with is_test: round(test * n) rows of each class."""
    return ranked_in_class(df, seed, "split").withColumn("is_test", F.col("n") < F.round(F.col("m") * test).cast("long")).drop("n", "m")


def kfold(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """df with fold, evenly over each class."""
    return ranked_in_class(df, seed, "fold").withColumn("fold", (F.col("n") % folds).cast("int")).drop("n", "m")


def metrics(pred: DataFrame, digits: int = 4) -> DataFrame:
    """pred(label, prediction, score) -> one row of METRICS. The area is by rank sums, with mean ranks for ties; scores are summed first."""
    c = lambda y, p: F.sum(((F.col("label") == y) & (F.col("prediction") == p)).cast("long"))
    one = pred.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(0, 0).alias("tn"), c(1, 0).alias("fn"))
    per = pred.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("q"))
    # Negatives below a score: of lower buckets (one row for each, summed first) and of its own bucket.
    per = per.withColumn("b", F.floor(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) * SCORE_BUCKETS))
    upto = F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bars = per.groupBy("b").agg(F.sum("q").alias("t")).select("b", upto.alias("before"))
    per = per.join(F.broadcast(bars), "b")
    below = F.col("before") + F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = per.withColumn("u", F.col("p") * (below + F.col("q") / 2)).agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    x = one.join(F.broadcast(area))
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    rec, spec, prec = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    values = [ratio(tp + tn, tp + fp + tn + fn), (rec + spec) / 2, prec, rec, ratio(2 * tp, 2 * tp + fp + fn), spec, F.sqrt(rec * spec), F.col("auc")]
    return x.select(*[F.round(v, digits).alias(n) for n, v in zip(METRICS, values, strict=True)])


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _spark_model(name: str, n: int, seed: int):
    from pyspark.ml import classification as c

    if name == "decision_tree":
        return c.DecisionTreeClassifier(featuresCol="v", maxDepth=5, maxBins=256, seed=seed)
    if name == "random_forest":
        return c.RandomForestClassifier(featuresCol="v", numTrees=100, maxDepth=5, featureSubsetStrategy="sqrt", seed=seed)
    if name == "logistic_regression":
        return c.LogisticRegression(featuresCol="v", regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=1000)
    return c.NaiveBayes(featuresCol="v", modelType="gaussian")


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, score, prediction): the share of class 1 among the k nearest training rows."""
    t = train.select((F.col("id") * 2 + 1).alias("id"), "label", "features")
    nn = knn(test.select((F.col("id") * 2).alias("id"), "label", "features"), k, t)
    got = nn.groupBy("i").agg(F.first("yi").alias("label"), F.avg((F.col("yj") == 1).cast("double")).alias("score"))
    return got.select((F.col("i") / 2).cast("long").alias("id"), "label", F.round("score", 9).alias("score"), (F.col("score") > 0.5).cast("int").alias("prediction"))


def svm_predict(train: DataFrame, test: DataFrame) -> DataFrame:
    _, label, x = _arrays(train)
    model = SVC().fit(x, label)
    a, c = platt(model.decide(x), (label == 1).astype(float))
    ship(train.sparkSession)

    def run(batches):
        for batch in batches:
            b = Block(pa.Table.from_batches([batch]))
            m = model.decide(b.x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))), pa.array((m > 0).astype(np.int32))], ["id", "label", "score", "prediction"])

    return test.select("id", "label", "features").mapInArrow(run, "id long, label int, score double, prediction int")


def fit_predict(train: DataFrame, test: DataFrame, classifier: str = "random_forest", seed: int = 42) -> DataFrame:
    """(id, label, score, prediction) of test rows by a classifier fitted on train."""
    if classifier not in CLASSIFIERS:
        raise ValueError(f"classifier must be one of {CLASSIFIERS}")
    if classifier == "knn":
        return knn_predict(train, test)
    if classifier == "svm":
        return svm_predict(train, test)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = lambda d: d.select("id", F.col("label").cast("int").alias("label"), array_to_vector("features").alias("v"))
    x = v(train)
    model = _spark_model(classifier, x.count() if classifier == "logistic_regression" else 1, seed).fit(x)
    return model.transform(v(test)).select("id", "label", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))


class ModelEvaluator:
    """Compares resamplers by a classifier's metrics on held-out rows.

    leakage='reference' trains on all resampled rows, as the compared toolkit does; 'none' resamples the training part.
    """

    BASELINE = "Baseline (No Resampling)"

    def __init__(self, test_size: float = 0.3, seed: int = 42, cv_folds: int = 5, leakage: str = "none"):
        self.test_size, self.seed, self.cv_folds, self.leakage = test_size, seed, cv_folds, leakage
        self.results_: dict[str, dict] = {}
        self.predictions_: dict[str, DataFrame] = {}

    def evaluate(self, name: str, df: DataFrame, sampler=None, classifier: str = "random_forest") -> dict:
        x = cut(stratified_split(df, self.test_size, self.seed))
        test = x.where("is_test")
        source = df if self.leakage == "reference" else x.where("not is_test").select("id", "label", "features")
        train = sampler.resample(source) if sampler else source
        carry = getattr(sampler, "transform_", None)
        pred = cut(fit_predict(train.select("id", "label", "features"), carry(test) if carry else test, classifier, self.seed))
        self.predictions_[name] = pred
        self.results_[name] = metrics(pred, 9).first().asDict()
        return self.results_[name]

    def compare(self, df: DataFrame, samplers: dict, classifier: str = "random_forest", at_once: int = 1) -> DataFrame:
        """(technique, METRICS) of the baseline and each sampler, best g_mean first; at_once of them are under way together."""
        self.evaluate(self.BASELINE, df, None, classifier)
        with ThreadPoolExecutor(at_once) as pool:
            for done in [pool.submit(self.evaluate, name, df, s, classifier) for name, s in samplers.items()]:
                done.result()
        return self.table(df.sparkSession)

    def table(self, spark) -> DataFrame:
        rows = [(n, *[float(r[m]) if r[m] is not None else None for m in METRICS]) for n, r in self.results_.items()]
        x = spark.createDataFrame(rows, "technique string, " + ", ".join(f"{m} double" for m in METRICS))
        return x.select("technique", *[F.round(m, 4).alias(m) for m in METRICS]).orderBy(F.desc("g_mean"), "technique")

    def best(self, metric: str = "g_mean") -> str:
        if not self.results_:
            raise ValueError("nothing has been evaluated")
        return min(self.results_, key=lambda n: (-(self.results_[n][metric] or 0), n))

    def cross_validate(self, df: DataFrame, sampler=None, classifier: str = "random_forest", scoring: str = "g_mean") -> dict:
        """Mean, population deviation and scores over folds; rows are resampled within each training part."""
        scoring = scoring if scoring in ("balanced_accuracy", "g_mean") else "accuracy"
        x, scores = cut(kfold(df, self.cv_folds, self.seed)), []
        for f in range(self.cv_folds):
            train = x.where(F.col("fold") != f).select("id", "label", "features")
            train = sampler.resample(train).select("id", "label", "features") if sampler else train
            carry = getattr(sampler, "transform_", None)
            test = x.where(F.col("fold") == f)
            scores.append(metrics(fit_predict(train, carry(test) if carry else test, classifier, self.seed), 9).first()[scoring])
        return {"mean": float(np.mean(scores)), "std": float(np.std(scores)), "scores": scores}


def quick_evaluate(df: DataFrame, sampler, classifier: str = "random_forest") -> dict:
    return ModelEvaluator().evaluate("quick", df, sampler, classifier)


def with_origin(df: DataFrame) -> DataFrame:
    return _out(df)


def scored(df: DataFrame, score: Column, cutoff: float) -> DataFrame:
    """(label, score, prediction) from a column and a cut-off."""
    return df.select("label", score.alias("score"), (score > cutoff).cast("int").alias("prediction"))
