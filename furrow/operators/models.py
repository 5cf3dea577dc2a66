"""Classical models through MLlib. Boosted trees (M20) are in ``boosting``."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(features: list[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="feature_vector"), model.setFeaturesCol("feature_vector")])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as Spark has cores, where it comes in fewer: a small file is one part, and MLlib fits and predicts part by part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fit_forest(df: DataFrame, features: list[str], target: str, classify: bool = True, trees: int = 600, depth: int = 10, seed: int = 0):
    """A random forest, as classifier or regressor. The node that a row has reached in each tree is kept from pass to pass, in memory or on disk, so no pass walks the trees from their roots."""
    kind = RandomForestClassifier if classify else RandomForestRegressor
    return _assembled(features, kind(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)).fit(spread(df.select(*features, target)))


def fit_tree(df: DataFrame, features: list[str], target: str, depth: int = 30, seed: int = 0):
    """One tree by entropy gain; MLlib's depth ends at 30."""
    return _assembled(features, DecisionTreeClassifier(labelCol=target, impurity="entropy", maxDepth=min(depth, 30), seed=seed)).fit(df)


def feature_importance(model, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance) by falling importance."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
