"""Worked examples with known totals: the 24-cell sample and the quota micro-example."""

import pytest
from pyspark.sql import functions as F

from furrow.operators import quota, suitability, tillage


@pytest.fixture(scope="module")
def sample(spark):
    """v = 1..24: ta = v, tr = v - 1/3, depth = v, field = v + 9, aridity = v but null in the last cell, one rich country."""
    cells = spark.createDataFrame([(v, float(v), float(v + 9), float(v) if v < 24 else None, float(v), 240, 400) for v in range(1, 25)], "cell_id long, depth double, field double, aridity double, erosion double, country_code long, high int")
    cells = cells.withColumn("aridity", F.coalesce("aridity", F.lit(0.65)))
    groups = suitability.crop_groups(spark)
    crop = cells.select("cell_id").crossJoin(groups.select("crop")).withColumn("ta", F.col("cell_id").cast("double")).withColumn("tr", F.col("cell_id") - 1 / 3)
    return cells, crop, groups


def total(df, column):
    return df.agg(F.coalesce(F.sum(column), F.lit(0.0))).first()[0]


def test_sample_totals(spark, sample):
    cells, crop, groups = sample
    grains = suitability.eligible_area(crop, cells, groups, "large_or_high_income", "tr", 20.0, exclude_flat=True)
    mix = suitability.crop_mix(crop, grains)
    scores = cells.join(mix, "cell_id").withColumn("score", suitability.logit_score())
    pot = quota.potential_area(grains, scores)
    per_cell = pot.join(scores.select("cell_id", "country_code", "score"), "cell_id").groupBy("cell_id", "country_code", "score").agg(F.sum("potential").alias("area"))
    targets = spark.createDataFrame([(240, 10_000.0)], "country_code long, target double")
    wins = quota.quota_allocate_nearest(per_cell, targets).filter("wins").select("cell_id")
    ca = pot.join(wins, "cell_id", "left_semi").withColumnRenamed("potential", "allocated")
    classes = tillage.tillage_classes(tillage.tillage_inputs(crop, cells, groups, ca), tillage.Rules(field_threshold=20.0)).cache()
    want = {"area": 12600, "conventional": 806.6667, "rotational": 1430.0, "reduced": 7251.6667, "traditional_rotational": 0, "traditional_annual": 0, "conservation": 4216.6667}
    assert {k: total(classes, k) for k in want} == pytest.approx(want, abs=1e-4)
    assert sum(total(classes, c) for c in tillage.CLASSES) - 12600 == pytest.approx(1105)
    once = tillage.tillage_classes(tillage.tillage_inputs(crop, cells, groups, ca), tillage.Rules(field_threshold=20.0, dedupe_shallow_perennials=True))
    assert sum(total(once, c) for c in tillage.CLASSES) == pytest.approx(12600)
    flat = tillage.tillage_inputs(crop, cells, groups, ca).select("cell_id", "crop", tillage.Rules().reduced_initial().alias("reduced")).filter("reduced IS NOT NULL")
    scenario = quota.scenario_suitable(pot, flat, cells, groups, 20.0)
    assert total(scenario, "scenario") == pytest.approx(6526.6667, abs=1e-4)


@pytest.mark.parametrize("target,cutoff,allocated", [(6.0, 0.8, 12.0), (100.0, 0.1, 21.0), (None, 0.9, 5.0)])
@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_quota_example(spark, target, cutoff, allocated, buckets):
    cells = spark.createDataFrame([(1, 7, 0.9, 5.0), (2, 7, 0.8, 4.0), (3, 7, 0.8, 3.0), (4, 7, 0.1, 9.0)], "cell_id long, country_code long, score double, area double")
    reported = spark.createDataFrame([(7, 0.0 if target is None else target / 1000)], "country_code long, value double")
    targets = quota.quota_target(cells.groupBy("country_code").agg(F.sum("area").alias("potential")), reported)
    cut = quota.quota_cutoff(cells, targets, buckets=buckets)
    assert [r.cutoff for r in cut.collect()] == [cutoff]
    assert total(quota.quota_allocate(cells, cut), "allocated") == allocated


@pytest.mark.parametrize("tie,target,wins", [("take", 7.0, {1, 2}), ("skip", 7.0, {1}), ("take", 6.0, {1}), ("take", 8.0, {1, 2}), ("take", 30.0, {1, 2, 3, 4}), ("take", 1.0, set()), ("take", 3.0, {1})])
def test_nearest_allocation(spark, tie, target, wins):
    cells = spark.createDataFrame([(1, 7, 0.9, 5.0), (2, 7, 0.8, 4.0), (3, 7, 0.8, 3.0), (4, 7, 0.1, 9.0)], "cell_id long, country_code long, score double, area double")
    out = quota.quota_allocate_nearest(cells, spark.createDataFrame([(7, target)], "country_code long, target double"), tie=tie, buckets=2)
    assert {r.cell_id for r in out.filter("wins").collect()} == wins and out.count() == 4
