"""Operators whose details SQL checks don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import grid, metrics, models, phenology, quota, ranges, scenes, suitability, training
from furrow.operators.tillage import dominant_class
from furrow.session import fresh_path
from furrow.sources import tables


def test_null_and_nan_rules(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None), (4, 99.0)], "id long, v double")
    assert [r.x for r in df.select(grid.sanitize(F.col("v"), 0, 10).alias("x")).collect()] == [None, 3.0, None, None]
    nd = df.select(scenes.normalized_difference(F.lit(1.0), F.lit(-1.0)).alias("x")).first().x
    assert nd is None
    with pytest.raises(Exception, match="outside the globe"):
        df.select(scenes.aoi_box(F.lit(500.0), F.lit(0.0), 10, 10)[0].alias("w")).collect()
    with pytest.raises(ValueError, match="missing"):
        path = fresh_path(spark, "stats")
        tables.write_totals(df, path)
        tables.read_stats_csv(spark, path, df.schema, ["nothing"])


def test_dominant_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (1, 3), (1, 4), (2, None)], "cell_id long, code int")
    assert [tuple(r) for r in dominant_class(df).collect()] == [(1, 3)]


def plain_peaks(x, prominence, distance):
    tops, k = [], 1
    while k < len(x) - 1:
        if x[k - 1] < x[k]:
            end = k
            while end < len(x) - 1 and x[end + 1] == x[k]:
                end += 1
            if end < len(x) - 1 and x[end + 1] < x[k]:
                tops.append((k + end) // 2)
            k = end
        k += 1
    keep = {t: True for t in tops}
    for t in sorted(tops, key=lambda t: (x[t], t), reverse=True):
        if keep[t]:
            for o in tops:
                if o != t and abs(o - t) < distance:
                    keep[o] = False
    out = []
    for t in tops:
        if keep[t]:
            left = right = x[t]
            for v in x[t::-1]:
                if v > x[t]:
                    break
                left = min(left, v)
            for v in x[t:]:
                if v > x[t]:
                    break
                right = min(right, v)
            if x[t] - max(left, right) >= prominence:
                out.append(t)
    return out


@pytest.mark.parametrize("distance", [1, 3, 30])
def test_peaks_and_low_periods(spark, distance):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for c in range(12):
        x = np.round(rng.random(26), 1)
        rows += [(c, d, float(v)) for d, v in enumerate(x)]
        want |= {(c, float(t)) for t in plain_peaks(x.tolist(), 0.2, distance)}
    df = spark.createDataFrame(rows, "cluster long, doy long, mean double")
    assert {(r.cluster, r.doy) for r in phenology.detect_peaks(df, 0.2, distance).collect()} == want


def test_kmeans_finds_separate_groups(spark):
    rows = [(t, float(c * 100 + k)) for t in (1, 2) for c in range(4) for k in range(40)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "tile_id long, mjd double, id long")
    out = phenology.two_pass_kmeans(df, "mjd", k1=4, k2=4, rounds=4)
    assert out.count() == 320 and out.groupBy("tile_id", F.floor(F.col("mjd") / 100)).agg(F.countDistinct("cluster").alias("n")).filter("n > 1").count() == 0
    assert phenology.two_pass_kmeans(df.limit(50), "mjd").count() == 0


def test_focal_window_reaches_absent_cells(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (9, 9, 2.0), (20, 20, None)], "row_no long, col_no long, v double")
    got = {(r.row_no, r.col_no): (r.focal_sum, r.focal_n) for r in grid.focal_box(df, "v", 4, 32, 32, tile=8).collect()}
    assert got[1, 1] == (1.0, 1) and got[2, 2] == (1.0, 1) and got[3, 3] == (0.0, 0) and got[8, 8] == (2.0, 1) and got[11, 11] == (2.0, 1) and got[12, 12] == (0.0, 0)


def test_fill_nearest_far_away(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (100, 100, 2.0)], "row_no long, col_no long, v double")
    target = spark.createDataFrame([(40, 40), (60, 60), (50, 50), (0, 1)], "row_no long, col_no long")
    got = {(r.row_no, r.col_no): r.v for r in grid.fill_nearest(df, target, "v").collect()}
    assert got == {(40, 40): 1.0, (60, 60): 2.0, (50, 50): 1.0, (0, 1): 1.0}
    assert grid.fill_nearest(df.filter("v > 5"), target, "v").filter("v IS NULL").count() == 4


def test_fill_nearest_beyond_any_window(spark):
    rng = np.random.default_rng(5)
    cells = [(int(y), int(x)) for y, x in rng.integers(0, 40, (60, 2))] + [(y, x) for y in range(60, 75) for x in range(60, 75)] + [(9000, 0)]
    cells = {c: float(k) for k, c in enumerate(cells)}
    target = [(int(y), int(x)) for y, x in rng.integers(-300, 6000, (60, 2))] + [(67, 67), (10, 90), (100_000, -50_000)]
    df = spark.createDataFrame([(*c, v) for c, v in cells.items()], "row_no long, col_no long, v double")
    got = {(r.row_no, r.col_no): r.v for r in grid.fill_nearest(df, spark.createDataFrame([*target, (None, 3)], "row_no long, col_no long"), "v").collect()}
    assert got == {t: cells[min(cells, key=lambda c: ((c[0] - t[0]) ** 2 + (c[1] - t[1]) ** 2, c))] for t in target} | {(None, 3): None}


def test_augment_moves_every_pixel_once(spark):
    df = spark.createDataFrame([(p, y, x, y * 4 + x) for p in range(40) for y in range(4) for x in range(4)], "patch_id long, y int, x int, v int")
    out = training.augment(df, 4)
    assert out.select("patch_id", "y", "x").distinct().count() == 640 and out.select("patch_id", "v").distinct().count() == 640


def test_smote_balances(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 0 if k < 50 else 1, rng.normal(size=2).tolist()) for k in range(63)]
    made = training.smote(spark.createDataFrame(rows, "id long, label int, features array<double>"))
    assert made.filter("label = 1").count() == 37 and made.count() == 37


@pytest.mark.parametrize("crowd", [2000, 3])
def test_smote_neighbours_against_all_pairs(spark, crowd):
    """A dense part, far outliers, many features and equal rows."""
    rng = np.random.default_rng(7)
    rows = [(k, 1, (rng.normal(size=4) * (1 if k % 6 else 200)).tolist()) for k in range(50)] + [(50 + k, 1, [0.5, 0.5, 0.0, 1.0]) for k in range(8)]
    rows += [(100 + k, 2, [1000.0 * k, -1.0 * k, 3.0, float(k)]) for k in range(3)] + [(200, 3, [1.0, 2.0, 3.0, 4.0])]
    got = {}
    for r in training.nearest_of_class(spark.createDataFrame(rows, "id long, label int, features array<double>"), k=5, crowd=crowd).collect():
        got[r.id] = [n.o_key for n in r.near_]
    for i, label, f in rows:
        others = sorted((sum((a - b) * (a - b) for a, b in zip(f, g)), j) for j, m, g in rows if m == label and j != i)
        assert got.get(i, []) == [j for _, j in others[:5]]


def test_smote_interpolates_sparse_classes(spark):
    rows = [(k, 0, [0.0, 0.0]) for k in range(12)] + [(20 + k, 1, [100.0 * k, 0.0]) for k in range(3)]
    made = training.smote(spark.createDataFrame(rows, "id long, label int, features array<double>")).collect()
    assert len(made) == 9 and sum(r.features not in [f for _, _, f in rows] for r in made) >= 8


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for _ in range(120)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, s double, y int")
    assert metrics.roc_auc(df, "s", "y", ["g"]).first().auc == pytest.approx(want)


def test_first_source_with_a_value_wins(spark):
    one, two = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None)], "cell_id long, v double, w double"), spark.createDataFrame([(1, 7.0, 8.0), (3, None, 1.0)], "cell_id long, v double, w double")
    got = {r.cell_id: (r.v, r.w) for r in tables.read_cells([one, two], F.lit(True)).collect()}
    assert got == {1: (7.0, 2.0), 2: (5.0, None), 3: (None, 1.0)}


def plain_nearest(rows, targets, tie):
    """Cells by falling score and rising id, one after the other."""
    wins = {}
    for g, target in targets.items():
        own = sorted([r for r in rows if r[1] == g and r[2] is not None and r[3] is not None], key=lambda r: (-r[2], r[0]))
        if sum(r[3] for r in own) <= target:
            wins |= {r[0]: r[3] > 0 for r in own}
            continue
        cum = 0.0
        for r in own:
            short, long = abs(cum - target), abs(cum + r[3] - target)
            if cum + r[3] <= target:
                wins[r[0]] = True
                cum += r[3]
            else:
                wins[r[0]] = short > long if tie == "skip" else short >= long
                break
    return wins


@pytest.mark.parametrize("tie", ["take", "skip"])
@pytest.mark.parametrize("buckets", [1000, 3])
def test_nearest_quota_against_a_plain_walk(spark, tie, buckets):
    """Tied and crowded scores, one score for all, zero areas, rows without score, area, group or target, and columns with the names of helpers."""
    rng = np.random.default_rng(4)
    rows = [(k, int(k % 5), float(rng.integers(0, 6)), float(rng.integers(0, 5))) for k in range(200)] + [(200 + k, 7, 1.0, 2.0) for k in range(30)]
    rows += [(300, 1, None, 2.0), (301, 1, 3.0, None), (302, None, 3.0, 1.0), (303, 9, 2.0, 2.0)]
    targets = {0: 41.0, 1: 0.0, 2: 1e9, 3: 20.5, 7: 31.0}
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "cell_id long, country_code long, score double, area double, total long, cutoff long, target long")
    got = quota.quota_allocate_nearest(df, spark.createDataFrame(list(targets.items()), "country_code long, target double"), tie=tie, buckets=buckets)
    want = plain_nearest(rows, targets, tie)
    assert got.columns == [*df.columns, "wins"] and {r.cell_id: r.wins for r in got.collect()} == {r[0]: want.get(r[0], False) for r in rows}
    won = quota.quota_allocate(df, quota.quota_cutoff(df.select("country_code", "score", "area"), spark.createDataFrame(list(targets.items()), "country_code long, target double"), buckets=buckets))
    assert won.columns == [*df.columns, "allocated"] and won.count() == len(rows)
    none = quota.quota_allocate_nearest(df.limit(0), spark.createDataFrame([], "country_code long, target double"))
    assert none.count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_by_ranges(spark, descending):
    rng = np.random.default_rng(6)
    rows = [(g, float(v), int(n)) for g in (1, 2, None) for v, n in zip(rng.choice(2000, 300, replace=False), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "g long, v double, n long")
    got = {(r.g, r.v): r.run_n for r in ranges.running_sums(df, ["g"], "v", ["n"], descending, ranges=7).collect()}
    assert got == {(g, v): sum(m for h, w, m in rows if h == g and (w >= v if descending else w <= v)) for g, v, _ in rows}
    assert ranges.running_sums(df.limit(0), [], "v", ["n"]).count() == 0
    assert {r.run_n for r in ranges.running_sums(spark.createDataFrame([(5.0, 2), (None, 3)], "v double, n long"), [], "v", ["n"]).collect()} == {2}


def test_rank_correlation_and_gain_of_odd_rows(spark):
    rows = [(1, float(x), float(y)) for x, y in zip([1, 2, 2, 4, 5, 5, 5], [3, 1, 1, 2, 9, 8, 8])] + [(2, 1.0, 1.0), (2, 1.0, 2.0), (None, 1.0, 2.0), (None, 2.0, 1.0), (1, None, 3.0), (3, None, None)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    got = {r.g: r.rho for r in suitability.spearman(df, "x", "y", ["g"]).collect()}
    import pandas as pd

    one = pd.DataFrame([r[1:] for r in rows if r[0] == 1 and r[1] is not None]).corr("spearman").iloc[0, 1]
    assert got[1] == pytest.approx(one) and got[2] is None and got[None] == pytest.approx(-1) and 3 not in got
    gains = metrics.information_gain(spark.createDataFrame([(1.0, "a"), (1.0, "b"), (2.0, "a"), (None, "a"), (3.0, None)], "v double, y string"), "v", "y")
    h = lambda *p: -sum(x * np.log(x) for x in p)
    assert [(r.threshold, pytest.approx(r.gain)) for r in gains.collect()] == [(1.0, h(2 / 3, 1 / 3) - 2 / 3 * h(0.5, 0.5))]
    assert metrics.information_gain(df.limit(0), "x", "g").count() == 0


def test_points_in_crowded_bands(spark):
    square = [(1, 7, 0.0, 0.0, 10.0, 0.0), (1, 7, 10.0, 0.0, 10.0, 10.0), (1, 7, 10.0, 10.0, 0.0, 10.0), (1, 7, 0.0, 10.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "polygon_id long, country_code long, x1 double, y1 double, x2 double, y2 double")
    points = [(k, float(k % 23) - 5, float(k % 19) - 4) for k in range(300)] + [(300, None, 1.0), (301, 1.0, None)]
    df = spark.createDataFrame(points, "point_id long, x double, y double")
    got = {r.point_id: r.country_code for r in grid.points_within(df, edges, 4.0, crowd=10).collect()}
    assert all(got[k] == (7 if x is not None and y is not None and 0 < x < 10 and 0 < y < 10 else got[k]) for k, x, y in points) and got[300] is got[301] is None
    assert all(got[k] is None for k, x, y in points if x is not None and y is not None and not (0 <= x <= 10 and 0 <= y <= 10))


def test_kmeans_ends_where_nothing_moves(spark):
    rng = np.random.default_rng(8)
    rows = [(t, float(v)) for t in (1, 2) for v in np.concatenate([rng.normal(c, 3 + t, 60) for c in (0, 10, 40, 90)])] + [(3, 5.0)] * 4 + [(1, None)]
    df = spark.createDataFrame(rows, "tile_id long, v double")
    got = phenology.kmeans_1d(df, "v", 4, "tile_id").toPandas()
    assert len(got) == len(rows) - 1
    for _, tile in got.groupby("tile_id"):
        centres = tile.groupby("cluster")["v"].mean()
        nearest = tile["v"].apply(lambda v, c=centres: (c - v).abs().idxmin())
        assert (nearest == tile["cluster"]).all()


def labelled(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), float(a > 0.5), float(3 * a + b)) for a, b in rng.random((300, 2))]
    return spark.createDataFrame(rows, "a double, b double, y double, z double"), rows


def test_forest_and_tree_learn_a_threshold(spark):
    df, rows = labelled(spark)
    for model in (models.fit_forest(df, ["a", "b"], "y", trees=20, depth=4), models.fit_tree(df, ["a", "b"], "y")):
        got = model.transform(df).select("y", "prediction").collect()
        assert np.mean([r.y == r.prediction for r in got]) > 0.98
        first = models.feature_importance(model, ["a", "b"], df).first()
        assert first.feature == "a" and first.importance > 0.8
    root = models.fit_tree(df, ["a", "b"], "y", depth=1).stages[-1]
    a = sorted(r[0] for r in rows)
    # The split lies between the neighbours of the true threshold, give or take a bin.
    cut = float(root.toDebugString.split("<= ")[1].split(")")[0])
    assert abs(cut - 0.5) < 0.05 and a[0] < cut < a[-1]
    wood = models.fit_forest(df, ["a", "b"], "z", classify=False, trees=30, depth=6)
    err = [r.z - r.prediction for r in wood.transform(df).select("z", "prediction").collect()]
    assert np.mean(np.square(err)) < 0.1 * np.var([r[3] for r in rows])
