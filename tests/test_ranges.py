"""Percentiles by ranges against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import composites, diagnostics, ranges

SHARES = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p75": 0.75, "top": 1.0}


def plain(values, share):
    v = sorted(values)
    r = (len(v) - 1) * share
    a, b = math.floor(r), math.ceil(r)
    return v[a] if v[a] == v[b] else (b - r) * v[a] + (r - a) * v[b]


@pytest.mark.parametrize("cuts", [2, 5, 64])
def test_percentiles(spark, cuts):
    """Few and many values, ties that fill several ranges, negative ones, null keys and values, names of helpers."""
    rng = random.Random(cuts)
    groups = {("a", 1): [rng.gauss(0, 100) for _ in range(3000)], ("a", None): [5.0] * 500 + [7.0] * 499 + [-1.0], (None, 1): [3.0], (None, None): [1.0, 2.0], ("b", 2): [float(rng.randint(0, 3)) for _ in range(1000)]}
    rows = [(g, h, v) for (g, h), own in groups.items() for v in own] + [("c", 1, None), ("a", 1, None)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "part string, n long, v double, before string, cuts string")
    got = {(r.part, r.n): r for r in ranges.exact_percentiles(df, ["part", "n"], "v", SHARES, cuts).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert [got[g][s] for s in SHARES] == pytest.approx([plain(own, p) for p in SHARES.values()], rel=1e-12)
    one = ranges.exact_percentiles(df, [], "v", SHARES, cuts).collect()
    assert len(one) == 1 and list(one[0]) == pytest.approx([plain([v for own in groups.values() for v in own], p) for p in SHARES.values()], rel=1e-12)


def test_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g long, v double")
    assert ranges.exact_percentiles(df, ["g"], "v", {"m": 0.5}).count() == 0
    assert ranges.exact_percentiles(df, [], "v", {"m": 0.5}).collect() == [(None,)]
    assert composites.median_composite(df, "v", "g").collect() == [(1, None)]
    assert diagnostics.value_summary(df, "v").collect() == [(None, None, None)]


def test_no_group_is_ordered_whole(spark):
    """The only sorts are inside a range: the largest part that a window orders is a small share of the table."""
    df = spark.range(200_000).select((F.col("id") * 2_654_435_761 % 1_000_003).cast("double").alias("v"))
    plan = ranges.exact_percentiles(df, [], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    assert ranges.exact_percentiles(df, [], "v", {"m": 0.5}).first()[0] == plain([k * 2_654_435_761 % 1_000_003 for k in range(200_000)], 0.5)
