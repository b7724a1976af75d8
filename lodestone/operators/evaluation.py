"""Identifier-splitter features and measures, and role prediction from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Levels by which the tasks of a round of regression sum up their gradients before the driver has them: a few sums reach it, however many tasks there are.
DEPTH = 8


def splitter_features(df: DataFrame, split: str = "token_split", length: int = 40) -> DataFrame:
    """Adds chars (1 to 26, padded with 0) and flags (1 where a word begins, after the first); longer identifiers are dropped."""
    letters = F.filter(F.split(F.lower(split), ""), lambda c: c != "")
    kept = df.withColumn("__letters", letters).withColumn("__plain", F.filter("__letters", lambda c: c.rlike("[a-z]"))).where((F.size("__plain") > 0) & (F.size("__plain") <= length))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0), F.lit(length) - F.size(x)))
    codes = F.transform("__plain", lambda c: F.ascii(c) - 96)
    words = F.filter(F.split(F.lower(split), " "), lambda w: w != "")
    flags = F.flatten(F.transform(words, lambda w, i: F.concat(F.array((i > 0).cast("int")), F.array_repeat(F.lit(0), F.length(w) - 1))))
    return kept.withColumn("chars", pad(codes)).withColumn("flags", pad(flags)).drop("__letters", "__plain")


def precision_recall(df: DataFrame, truth: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """(precision, recall, f1) of 0/1 truth and scores at or over ``threshold``."""
    y, p = F.col(truth).cast("double"), F.when(F.col(predicted) >= threshold, 1.0).otherwise(0.0)
    sums = df.agg(F.sum(y * p).alias("tp"), F.sum(p).alias("p"), F.sum(y).alias("y"))
    precision, recall = F.col("tp") / (F.col("p") + EPSILON), F.col("tp") / (F.col("y") + EPSILON)
    return sums.select(precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + EPSILON)).alias("f1"))


def learning_rate(epoch: Column, start: float, end: float, epochs: int) -> Column:
    """Falls evenly from ``start`` to ``end``."""
    return F.lit(start) - F.lit((start - end) / epochs) * epoch


def epochs_of(samples: int, batch: int, epochs: int, per_epoch: int) -> tuple[int, int]:
    """(steps an epoch, epochs) if an epoch takes ``per_epoch`` samples."""
    return per_epoch // batch, -(-epochs * samples // per_epoch)


def common_roles(df: DataFrame, identifier: str, role: str, least: int = 10) -> DataFrame:
    """(identifier, role): the most frequent role of each (ties by name), of roles with at least ``least`` rows."""
    frequent = df.groupBy(role).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(role)
    n = df.join(frequent, role, "left_semi").groupBy(identifier, role).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(identifier).orderBy(F.desc("n"), F.asc(role)))
    return n.withColumn("__place", best).where("__place = 1").select(identifier, role)


def role_quality(df: DataFrame, vector: str, role: str, folds: int = 5, seed: int = 42, strengths: tuple[float, ...] = tuple(10.0**k for k in range(-7, -1))) -> DataFrame:
    """(accuracy, f1, reg_param) of a logistic regression, its penalty chosen by cross-validation, on a third that is held out.

    Rows are weighted so that each role counts the same. A strength is the inverse of a penalty on the summed loss; Spark
    takes the mean, so the penalty is one by the strength and the number of training rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    n = df.groupBy(role).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(vector), F.lit(3))
    data = df.join(n, role).select(part.alias("part"), F.col(role).cast("string").alias("role"), array_to_vector(vector).alias("features"), (1 / F.col("__n")).alias("weight"))
    regression = LogisticRegression(weightCol="weight", labelCol="label", maxIter=30, aggregationDepth=DEPTH)
    rows = max(data.where("part <> 0").count(), 1)
    grid = ParamGridBuilder().addGrid(regression.regParam, [1 / (c * rows) for c in strengths]).build()
    measure = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    search = CrossValidator(estimator=regression, estimatorParamMaps=grid, evaluator=measure, numFolds=folds, seed=seed, parallelism=4)
    indexed = Pipeline(stages=[StringIndexer(inputCol="role", outputCol="label")]).fit(data).transform(data)
    model = search.fit(indexed.where("part <> 0"))
    found = model.transform(indexed.where("part = 0"))
    rows = [(measure.evaluate(found), MulticlassClassificationEvaluator(labelCol="label", metricName="f1").evaluate(found), float(model.bestModel.getRegParam()))]
    return df.sparkSession.createDataFrame(rows, "accuracy double, f1 double, reg_param double")
