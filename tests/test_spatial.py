"""Nearest values, outlines, functions over windows and along an axis, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import applied, grid, suitability


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def nearest(valid, targets):
    out = []
    for r, c in targets:
        best = min((((r - y) ** 2 + (c - x) ** 2, y, x, v) for y, x, v in valid if None not in (y, x, v)), default=None) if None not in (r, c) else None
        out.append((r, c, best and best[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, share, height, width", [(1, 0.05, 40, 40), (2, 0.6, 25, 60), (3, 0.004, 70, 30), (4, 0.3, 1, 50), (5, 0.3, 50, 1), (6, 0.95, 30, 30)])
def test_fill_nearest(spark, seed, share, height, width):
    rng = random.Random(seed)
    cells = [(y, x) for y in range(-3, height - 3) for x in range(-7, width - 7)]
    valid = [(y, x, rng.choice("abcdef")) for y, x in cells if rng.random() < share] or [(0, 0, "a")]
    targets = rng.sample(cells, len(cells) * 3 // 4)
    df = spark.createDataFrame([(*v, "x", "x") for v in valid], "row_no long, col_no long, v string, at string, open string")
    got = rows_of(grid.fill_nearest(df, spark.createDataFrame(targets, "row_no long, col_no long"), "v"))
    assert got == nearest(valid, targets)


def test_fill_nearest_far_and_strange(spark):
    """Thousands of cells away; nulls, repeated targets and cells, clashing names, nothing to take from, no targets."""
    valid = [(0, 0, 7), (0, 0, 3), (9000, 4, 5), (None, 1, 1), (4, None, 1), (2, 2, None)]
    targets = [(4500, 2), (4500, 2), (4499, 0), (4501, 0), (0, 0), (None, 3), (3, None), (20000, 20000)]
    df = spark.createDataFrame([(*v, 1, 1) for v in valid], "row_no int, col_no int, low int, s long, n int")
    got = rows_of(grid.fill_nearest(df, spark.createDataFrame(targets, "row_no int, col_no int"), "low"))
    assert got == nearest([(0, 0, 3), (9000, 4, 5)], targets)
    target = spark.createDataFrame(targets, "row_no int, col_no int")
    assert all(r.low is None for r in grid.fill_nearest(df.filter("low > 99"), target, "low").collect())
    assert grid.fill_nearest(df, target.limit(0), "low").count() == 0


def squares(blocks):
    """Edges of boxes (x1, y1, x2, y2), in changing directions."""
    out = []
    for k, (key, a, b, c, d) in enumerate(blocks):
        edges = [(a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b)]
        out += [(k, key, *map(float, e if k % 2 else (e[2], e[3], e[0], e[1]))) for e in edges]
    return out


EDGES = "polygon_id long, country_code long, x1 double, y1 double, x2 double, y2 double"


def test_outline_of_boxes(spark):
    """Two boxes side by side, a long edge against two short ones, a hole, a part of its own, parts that touch at a corner."""
    boxes = [(1, 0, 0, 2, 2), (1, 2, 0, 4, 1), (1, 2, 1, 4, 2), (2, 10, 0, 13, 1), (2, 10, 2, 13, 3), (2, 10, 1, 11, 2), (2, 12, 1, 13, 2), (3, 0, 5, 1, 6), (3, 1, 6, 2, 7)]
    got = rows_of(grid.dissolve_outline(spark.createDataFrame(squares(boxes), EDGES)))
    want = [(1, 0, 0, 4, 0), (1, 0, 2, 4, 2), (1, 0, 0, 0, 2), (1, 4, 0, 4, 2), (2, 10, 0, 13, 0), (2, 10, 3, 13, 3), (2, 10, 0, 10, 3), (2, 13, 0, 13, 3)]
    want += [(2, 11, 1, 12, 1), (2, 11, 2, 12, 2), (2, 11, 1, 11, 2), (2, 12, 1, 12, 2), (3, 0, 5, 1, 5), (3, 0, 6, 2, 6), (3, 1, 7, 2, 7), (3, 0, 5, 0, 6), (3, 1, 5, 1, 7), (3, 2, 6, 2, 7)]
    assert got == sorted((tuple([k, *map(float, e)]) for k, *e in want), key=repr)


def test_outline_holds_the_same_cells(spark):
    """G20 on the outline gives what it gives on the parts: boxes cut at random, and a fan of triangles whose slanted edges are shared."""
    rng = random.Random(4)
    boxes = []

    def cut(a, b, c, d, depth):
        if depth == 0 or rng.random() < 0.15:
            boxes.append((rng.randint(1, 4), a, b, c, d))
        elif c - a > d - b:
            m = rng.randint(a + 1, c - 1) if c - a > 1 else c
            for p in ((a, b, m, d), (m, b, c, d)) if m < c else ((a, b, c, d),):
                cut(*p, depth - 1)
        else:
            m = rng.randint(b + 1, d - 1) if d - b > 1 else d
            for p in ((a, b, c, m), (a, m, c, d)) if m < d else ((a, b, c, d),):
                cut(*p, depth - 1)

    cut(0, 0, 40, 30, 7)
    rim = [(50.3, 5.1), (58.2, 6.7), (60.9, 14.4), (54.0, 21.3), (47.7, 13.9)]
    fan = []
    for k in range(5):
        p, q, o = rim[k], rim[(k + 1) % 5], (54.2, 12.6)
        fan += [(1000 + k, 9, *p, *q), (1000 + k, 9, *q, *o), (1000 + k, 9, *o, *p)]
    parts = spark.createDataFrame([*squares(boxes), *fan], EDGES)
    outline = grid.dissolve_outline(parts)
    assert outline.count() < parts.count() * 0.7 and outline.filter("country_code = 9").count() == 5
    box = grid.Grid(0.0, 64.0, 0.0, 32.0, 0.5)
    whole = outline.withColumn("polygon_id", F.col("country_code"))
    assert rows_of(grid.allocate_country(whole, box)) == rows_of(grid.allocate_country(parts, box))


def test_outline_of_strange_edges(spark):
    rows = [(1, None, 0.0, 0.0, 1.0, 0.0), (1, None, 1.0, 0.0, 3.0, 0.0), (1, 2, 0.0, None, 1.0, 1.0), (1, 2, 4.0, 4.0, 4.0, 4.0), (1, 2, 0.0, 0.0, 1.0, 2.0), (1, 2, 1.0, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, EDGES).withColumns({"line": F.lit(1), "at": F.lit(1), "k": F.lit(1), "n": F.lit(1)})
    assert rows_of(grid.dissolve_outline(df)) == [(None, 0.0, 0.0, 3.0, 0.0)]
    assert grid.dissolve_outline(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius, side, pad", [(1, 4, True), (3, 5, False), (4, 3, True), (2, None, True)])
def test_windows(spark, radius, side, pad):
    """Windows that cross tile edges and corners, sparse cells, and targets without any cell near."""
    rng = np.random.default_rng(radius)
    shape = (23, 31)
    full = np.full(shape, np.nan)
    at = rng.random(shape) < (0.5 if radius < 4 else 0.02)
    full[at] = rng.integers(0, 100, at.sum())
    targets = [(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random(shape) < 0.4))] + [(0, 0), (22, 30), (22, 30)]

    def f(w):
        weights = np.arange(w[0].size).reshape(w[0].shape)
        return np.where(np.isnan(w).all(axis=(1, 2)), np.nan, np.nansum(w * weights, axis=(1, 2)))

    padded = np.pad(full, radius, constant_values=np.nan)
    want = []
    for y, x in targets:
        v = f(padded[None, y : y + 2 * radius + 1, x : x + 2 * radius + 1])[0]
        outside = not pad and not (radius <= y < shape[0] - radius and radius <= x < shape[1] - radius)
        want.append((y, x, None if outside or np.isnan(v) else float(v)))
    cells = [(int(y), int(x), float(full[y, x]), "x", "x") for y, x in zip(*np.nonzero(at))] + [(None, 1, 1.0, "", ""), (3, None, 1.0, "", ""), (5, 5, None, "", ""), (99, 2, 1.0, "", "")]
    df = spark.createDataFrame(cells, "row_no long, col_no long, tx double, wanted string, v string")
    got = rows_of(applied.apply_windows(df, "tx", radius, f, "s double", spark.createDataFrame(targets, "row_no long, col_no long"), shape, pad, side))
    assert got == sorted(want, key=repr)


def test_windows_of_cells_themselves(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (70, 2, 2.0)], "row_no long, col_no long, v double")
    most = lambda w: np.nanmax(w, axis=(1, 2))
    assert rows_of(applied.apply_windows(df, "v", 1, most, "top int")) == [(0, 0, 5), (0, 1, 5), (70, 2, 2)]
    assert applied.apply_windows(df.limit(0), "v", 1, most, "top int").count() == 0


def test_along_an_axis(spark):
    rows = [(1, "a", 3, 2.0, "p"), (1, "a", 1, 5.0, "q"), (1, "b", 2, None, None), (None, "b", 1, 1.0, "r"), (1, "a", 2, None, "s"), (1, "a", None, 9.0, "t")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "g long, h string, k int, v double, w string, axis string, b0 string")
    flat = applied.apply_along(df, ["g", "h"], "k", ["v", "w"], lambda v, w: f"{np.nansum(v):g}" + "".join(x or "-" for x in w), "axis string")
    assert rows_of(flat) == [(1, "a", "16tqsp"), (1, "b", "0-"), (None, "b", "1r")]
    steps = applied.apply_along(df, ["g"], "k", ["v"], lambda v: np.cumsum(np.nan_to_num(v)), "steps array<double>")
    assert rows_of(steps) == [(1, [9.0, 14.0, 14.0, 14.0, 16.0]), (None, [1.0])] or rows_of(steps)[1] == (None, [1.0])
    assert applied.apply_along(df.limit(0), ["g"], "k", ["v"], len, "n long").count() == 0
    assert rows_of(applied.apply_along(df, ["h"], "k", ["v"], lambda v: float("nan") if np.isnan(v).any() else 1.0, "n double")) == [("a", None), ("b", None)]
    with pytest.raises(Exception, match="an axis has more than 3 rows"):
        applied.apply_along(df, ["g"], "k", ["v"], len, "n long", most=3).collect()


def test_sensitivity_correlations(spark):
    """Ranks of each scenario against the base, with ties and missing scores, over everything and by country."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, None]), float(rng.randint(1, 6)), float(rng.randint(5, 20)), rng.choice([0.1, 0.65, 0.9, None]), rng.choice([0.2, 0.5, 0.8, None])) for _ in range(300)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "country_code long, field double, erosion double, aridity double, crop_mix double, score double, g string")

    def ranks(v):
        order = sorted(v)
        return np.array([order.index(x) + (order.count(x) - 1) / 2 for x in v])

    def score(r, k):
        z = sum((k[n] * (x - suitability.MIDPOINTS[n]) for n, x in zip(("field", "erosion", "aridity", "crop_mix"), r[1:])), 0.0)
        return 1 / (1 + np.exp(-z))

    for by in (None, "country_code"):
        got = {r[:-1]: r.rho for r in suitability.sensitivity_correlations(df, by).collect()}
        groups = {(): rows} if by is None else {(g,): [r for r in rows if r[0] == g] for g in (1, 2, None)}
        assert len(got) == 16 * len(groups)
        for g, own in groups.items():
            own = [r for r in own if None not in r[3:]]
            base = ranks([round(float(score(r, suitability.SLOPES)), 12) for r in own])
            for name, k in suitability.sensitivity_scenarios()[1:]:
                other = ranks([round(float(score(r, k)), 12) for r in own])
                assert got[(name, *g)] == pytest.approx(np.corrcoef(base, other)[0, 1], abs=1e-6)
