"""Operators that return the caller's rows keep every column, whatever it is called: each is run on input that has a column for every name its own code uses."""

import datetime
import inspect
import re

import pytest
from pyspark.sql import functions as F

from furrow.operators import columns, grid, quota, ranges, training

DAY = datetime.date(2024, 5, 1)


def helper_names(*functions):
    code = "".join(inspect.getsource(f) for f in (*functions, columns.pack, columns.unpack, ranges.running_sums))
    words = {w.lower() for text in re.findall(r'"([^"\n]*)"', code) for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)}
    return sorted(words | {"own", "g", "n", "k", "h", "v", "at", "place", "low", "high", "day", "tile", "rank_", "q_total", "q_cutoff", "value", "i_", "lent_", "fill_", "income_code"})


CELLS = ("cell_id long, country_code long, score double, area double", [(1, 1, 0.9, 5.0), (2, 1, 0.8, 4.0), (3, 2, 0.5, 3.0), (4, None, 0.4, 2.0), (5, 2, None, 1.0)])
CASES = {
    "quota_allocate": ([quota.quota_allocate], *CELLS, ["allocated"], lambda d, s: quota.quota_allocate(d, s.createDataFrame([(1, 0.85)], "country_code long, cutoff double")), 5),
    "quota_allocate_nearest": ([quota.quota_allocate_nearest, quota._crossing], *CELLS, ["wins"], lambda d, s: quota.quota_allocate_nearest(d, s.createDataFrame([(1, 5.0), (2, 1.0)], "country_code long, target double")), 5),
    "stratified_quota": ([training.stratified_quota], "cell_id long, tile_id long, label long", [(k, k % 2, k % 3) for k in range(12)], [], lambda d, s: training.stratified_quota(d, 3, 1), 6),
    "borrow_dates": ([training.borrow_dates], "id long, date date", [(1, DAY), (2, None), (3, None)], ["date"], lambda d, s: training.borrow_dates(d, "id", "date"), 3),
    "patch_composite": ([training.patch_composite], "patch_id long, tile_id long, date date", [(1, 1, DAY), (1, 1, DAY), (2, 7, DAY), (3, None, None)], ["value", "n_obs"], lambda d, s: training.patch_composite(d, s.createDataFrame([(1, datetime.datetime(2024, 5, 3), 4.0)], "tile_id long, ts timestamp, value double")), 4),
    "split": ([training.split, training.class_rank], "id long, label long", [(k, k % 2) for k in range(10)], ["part"], lambda d, s: training.split(d, {"a": 0.6, "b": 0.4}, "id", "label"), 10),
    "fill_focal": ([grid.fill_focal, grid.spine, grid._box_sums], "row_no long, col_no long", [(0, 0), (0, 1), (5, 5), (None, 1)], ["f"], lambda d, s: grid.fill_focal(s.createDataFrame([(0, 0, 3.0)], "row_no long, col_no long, f double"), d, "f", [3, 5], 64, 64, 8), 4),
    "high_income_mask": ([grid.high_income_mask], "cell_id long, country_code long", [(1, 1), (2, 2), (3, None)], ["high"], lambda d, s: grid.high_income_mask(d, s.createDataFrame([(1, 4)], "country_code long, income_code long")), 3),
    "points_within": ([grid.points_within, grid.crosses], "point_id long, x double, y double", [(1, 0.5, 0.5), (2, 9.0, 9.0)], ["country_code"], lambda d, s: grid.points_within(d, s.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 0.0), (1, 7, 1.0, 0.0, 1.0, 1.0), (1, 7, 1.0, 1.0, 0.0, 1.0), (1, 7, 0.0, 1.0, 0.0, 0.0)], "polygon_id long, country_code long, x1 double, y1 double, x2 double, y2 double"), 1.0), 2),
}


@pytest.mark.parametrize("name", list(CASES))
def test_clashing_names(spark, name):
    functions, schema, rows, new, run, n = CASES[name]
    df = spark.createDataFrame(rows, schema)
    given = df.columns
    more = [c for c in helper_names(*functions) if c not in given]
    out = run(df.withColumns({c: F.lit(f"mine {c}") for c in more}), spark)
    kept = [c for c in more if c not in new]
    assert sorted(out.columns) == sorted({*given, *kept, *new}) and len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert len(got) == n and all(r[c] == f"mine {c}" for r in got for c in kept)
    plain = sorted((tuple(r[c] for c in [*given, *new]) for r in run(df, spark).collect()), key=repr)
    assert sorted((tuple(r[c] for c in [*given, *new]) for r in got), key=repr) == plain


def test_patch_composite_against_all_pairs(spark):
    """Intervals before, inside and after the observed period, gaps, nulls and values of no size, several values, repeated patches."""
    import random

    rng = random.Random(1)
    day = lambda k: DAY + datetime.timedelta(days=k)
    obs = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *[rng.randint(0, 60) for _ in range(9)]]), rng.choice([None, float("nan"), float("inf"), rng.uniform(-1e6, 1e6), rng.random()]), rng.randint(0, 9)) for _ in range(400)]
    patches = [(k, rng.choice([1, 2, 3, None]), rng.choice([None, *[rng.randint(-30, 90) for _ in range(9)]])) for k in range(60)] + [(0, 1, 5)] * 2
    left = spark.createDataFrame([(k, t, None if d is None else day(d)) for k, t, d in patches], "patch_id long, tile_id long, date date")
    right = spark.createDataFrame([(t, None if d is None else datetime.datetime.combine(day(d), datetime.time(23, 59)), v, w) for t, d, v, w in obs], "tile_id long, ts timestamp, a double, b int")
    got = sorted(((r.patch_id, r.tile_id, r.date, r.a, r.b, r.n_obs) for r in training.patch_composite(left, right, 4, ("a", "b"), 10.0).collect()), key=repr)
    want = []
    for k, t, d in patches:
        own = [o for o in obs if None not in (t, d, o[0], o[1]) and o[0] == t and abs(o[1] - d) <= 4]
        a = [o[2] for o in own if o[2] is not None and abs(o[2]) < 1e300]
        mean = lambda v: pytest.approx(sum(v) / len(v) * 10, rel=1e-9, abs=1e-9) if v else None
        want.append((k, t, None if d is None else day(d), mean(a), mean([o[3] for o in own]), len(own)))
    for g in got:
        assert any(g == w for w in want), g
    assert len(got) == len(want)
    assert training.patch_composite(left, right.limit(0), 4, ("a",)).filter("n_obs > 0 OR a IS NOT NULL").count() == 0
