"""The forest's fit is dealt over the cores."""

import numpy as np
from pyspark.sql import functions as F

from furrow.operators import models


def test_one_part_is_dealt_out(spark):
    """Rows that come in one part are fitted and predicted by as many tasks as there are cores; columns that the fit doesn't need may have any name."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - b), "x") for a, b in x], "a double, b double, y double, other string").coalesce(1).withColumn("feature_vector_", F.lit(1))
    sc = spark.sparkContext
    sc.setJobGroup("forest", "fit")
    try:
        model = models.fit_forest(df, ["a", "b"], "y", classify=False, trees=5, depth=4)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("forest") for s in seen.getJobInfo(j).stageIds]
    wide = [s for s in stages if s is not None and "Random" in s.name]
    assert wide and max(s.numTasks for s in wide) >= sc.defaultParallelism
    got = model.transform(models.spread(df))
    assert got.rdd.getNumPartitions() >= sc.defaultParallelism
    error = got.agg(F.avg((F.col("prediction") - F.col("y")) ** 2) / F.var_pop("y")).first()[0]
    assert got.count() == 300 and error < 0.3
    assert models.spread(df.repartition(9)).rdd.getNumPartitions() == 9
