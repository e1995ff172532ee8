"""Learning over pair tables with MLlib: folds, out-of-fold scores, sampling of negatives, calibration, AUC."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_of(col: str, k: int = 3):
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


def sample_negatives(t: DataFrame, hard, hard_rate: float = 0.15, rest_rate: float = 0.015) -> DataFrame:
    """All positives, and negatives by hardness, chosen by a hash of the pair."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("3"), F.col("q").cast("string"), F.col("s").cast("string"))), 1, 7), 16, 10).cast("long") / float(16**7)
    return t.where((F.col("label") == 1) | F.when(hard, u < hard_rate).otherwise(u < rest_rate))


def _learner(trees: bool):
    kind = GBTClassifier(maxIter=10, maxDepth=3, seed=1) if trees else LogisticRegression(maxIter=20)
    return kind.setParams(featuresCol="features", labelCol="label")


def fold_models(t: DataFrame, features: list[str], trees: bool = False, k: int = 3) -> list:
    """One model for each fold of s, fitted on the others."""
    t = VectorAssembler(inputCols=features, outputCol="features").transform(t.withColumn("fold", fold_of("s", k)))
    return [_learner(trees).fit(t.where(F.col("fold") != i)) for i in range(k)]


def out_of_fold(t: DataFrame, features: list[str], trees: bool = False, k: int = 3) -> DataFrame:
    """q, s, label, p: each fold scored by a model of the others."""
    fitted = fold_models(t, features, trees, k)
    t = VectorAssembler(inputCols=features, outputCol="features").transform(t.withColumn("fold", fold_of("s", k)))
    out = [m.transform(t.where(F.col("fold") == i)).select("q", "s", "label", vector_to_array("probability")[1].alias("p")) for i, m in enumerate(fitted)]
    return reduce(DataFrame.unionByName, out)


def importance(t: DataFrame, features: list[str]) -> DataFrame:
    """feature, gain of a boosted model."""
    t = VectorAssembler(inputCols=features, outputCol="features").transform(t)
    gain = _learner(True).fit(t).featureImportances.toArray()
    return t.sparkSession.createDataFrame([(f, round(float(g), 6)) for f, g in zip(features, gain)], "feature string, gain double")


def pseudo_labels(pairs: DataFrame, sure: float, no: float, second: float) -> DataFrame:
    """q, s, label: 1 for a sure best candidate whose next is weak, 0 for weak candidates; all others stay unlabelled."""
    w = Window.partitionBy("q")
    t = pairs.withColumn("_r", F.row_number().over(w.orderBy(F.desc("p"), "s"))).withColumn("_n", F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("p"))).over(w), F.lit(0.0)))
    yes = (F.col("_r") == 1) & (F.col("p") >= sure) & (F.col("_n") <= second)
    return t.withColumn("label", F.when(yes, 1).when(F.col("p") <= no, 0)).where("label IS NOT NULL").select("q", "s", "label")


def isotonic(t: DataFrame, k: int = 3) -> DataFrame:
    """t (p, label, s, ...) with `calibrated`, cross-fitted: each fold of s is calibrated by the others."""
    t = t.withColumn("label", F.col("label").cast("double")).withColumn("fold", fold_of("s", k))
    out = []
    for i in range(k):
        model = IsotonicRegression(featuresCol="p", labelCol="label").fit(t.where(F.col("fold") != i))
        out.append(model.transform(t.where(F.col("fold") == i)).withColumnRenamed("prediction", "calibrated"))
    return reduce(DataFrame.unionByName, out)


def interpolate(x, xs: list[float], ys: list[float]):
    """Piecewise-linear value of x over a calibration's knots, constant beyond them."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, u, v in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(x <= b, F.lit(float(u)) + (x - a) / (b - a) * (v - u))
    return out.otherwise(F.lit(float(ys[-1])))


def mean_of_models(t: DataFrame, models: list, features: list[str]) -> DataFrame:
    """q, s and the mean score of all models, in one pass over the rows."""
    t = VectorAssembler(inputCols=features, outputCol="features").transform(t)
    for i, m in enumerate(models):
        t = m.transform(t).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return t.select("q", "s", (reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(models))]) / len(models)).alias("p"))


def logloss(t: DataFrame, eps: float = 1e-6) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    return t.agg(F.round(F.avg(-F.col("label") * F.log(p) - (1 - F.col("label")) * F.log(1 - p)), 6).alias("logloss"))


def bin_calibration(t: DataFrame, width: float = 0.5) -> DataFrame:
    """country, bin of the logit, share of true pairs."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.001)), F.lit(0.999))
    b = F.floor(F.round(F.log(p / (1 - p)), 9) / width).cast("long")
    return t.groupBy("country", b.alias("bin")).agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def auc(t: DataFrame, buckets: int = 4096) -> DataFrame:
    """Area under the ROC curve from counts by score. Running sums go over buckets first, then inside each bucket."""
    by = t.groupBy(F.floor(F.col("p") * buckets).alias("b"), "p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    under = by.groupBy("b").agg(F.sum("neg").alias("bneg"))  # a row for each bucket
    under = under.withColumn("lower", F.sum("bneg").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bneg"))
    inside = F.sum("neg").over(Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    c = by.withColumn("inside", inside).join(under, "b").withColumn("below", F.col("lower") + F.col("inside"))
    return c.agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))
