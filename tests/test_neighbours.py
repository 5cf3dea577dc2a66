"""Neighbours of a class against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import neighbours, training

SCHEMA = "id long, label int, features array<double>"


def plain(rows, k):
    """Distances and keys of the nearest others; rows are told apart by their place in the list."""
    out = []
    good = [f is not None and label is not None and len(f) > 0 and all(v is not None and np.isfinite(v) for v in f) for _, label, f in rows]
    for p, (i, label, f) in enumerate(rows):
        near = []
        if good[p]:
            near = sorted((sum((a - b) * (a - b) for a, b in zip(f, g)), j) for q, (j, m, g) in enumerate(rows) if q != p and good[q] and m == label and len(g) == len(f))[:k]
        out.append((i, label, [(f"{d:.10g}", j) for d, j in near]))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted(((r.id, r.label, [(f"{n.d2:.10g}", n.o_key) for n in r.near_]) for r in neighbours.nearest_of_class(df, **how).collect()), key=repr)


@pytest.mark.parametrize("crowd, k", [(1000, 5), (12, 5), (3, 2)])
def test_thirteen_features(spark, crowd, k):
    """Clusters, far outliers, equal rows, repeated and shared ids, classes of one and two rows, k above the size of a class, missing features."""
    rng = np.random.default_rng(crowd)
    centres = rng.normal(size=(4, 13)) * 50
    rows = [(n, 1, (centres[n % 4] + rng.normal(size=13)).tolist()) for n in range(90)] + [(900 + n, 1, (rng.normal(size=13) * 1e4).tolist()) for n in range(4)]
    rows += [(n % 5, 2, [float(n % 3)] * 13) for n in range(40)]  # few points with many rows, ids shared inside and across them
    rows += [(7, 3, [1.0] * 13), (7, 3, [1.0] * 13), (8, 4, [2.0] * 13), (9, 5, [0.0] * 13), (9, 5, [1.0] * 13), (9, 5, [0.0] * 12)]
    rows += [(10, 1, None), (11, 1, [None] * 13), (12, 1, [float("nan")] * 13), (13, None, [1.0] * 13), (14, 1, [])]
    assert found(spark.createDataFrame(rows, SCHEMA), crowd=crowd, k=k) == plain(rows, k)


def test_skewed_values_end(spark):
    """Most values equal along the widest feature, neighbouring doubles: every cut parts something."""
    one = float(np.nextafter(1.0, 2.0))
    rows = [(n, 1, [1000.0 if n % 20 else 0.0, float(n) / 1000]) for n in range(120)] + [(200 + n, 2, [1.0 if n % 2 else one, 0.0]) for n in range(9)]
    assert found(spark.createDataFrame(rows, SCHEMA), crowd=2, k=3) == plain(rows, 3)


def test_pairs_grow_with_rows(spark, monkeypatch):
    """On clustered rows the leaves that a point visits stay few however many clusters the class has."""
    rng = np.random.default_rng(3)
    seen = {}
    real = neighbours.stored

    def counting(df, name="stored"):
        out = real(df, name)
        if name == "visits":
            seen[n] = out.count() / n
        return out

    monkeypatch.setattr(neighbours, "stored", counting)
    for n in (500, 3000):
        centres = rng.normal(size=(n // 25, 13)) * 1000
        rows = spark.createDataFrame([(k, 1, (centres[k % len(centres)] + rng.normal(size=13)).tolist()) for k in range(n)], SCHEMA)
        assert neighbours.nearest_of_class(rows, crowd=30).count() == n
    assert seen[3000] < 2 * seen[500] + 2


def test_smote_of_shared_ids(spark):
    """A class of two rows with one id ends; the rows move towards each other."""
    rows = [(k, 0, [float(k), 0.0]) for k in range(9)] + [(50, 1, [0.0, 0.0]), (50, 1, [10.0, 0.0]), (60, 2, [3.0, 3.0]), (61, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"near_": F.lit(1), "rank_": F.lit(1), "n_": F.lit(1)})
    made = training.smote(df).collect()
    assert sorted(r.label for r in made) == [1] * 7 + [2] * 8 + [3] * 8
    assert all(0 <= r.features[0] <= 10 and r.features[1] == 0 for r in made if r.label == 1) and all(r.features == [3.0, 3.0] for r in made if r.label == 2)
    assert neighbours.nearest_of_class(df.limit(0)).count() == 0


def test_features_without_structure(spark, monkeypatch):
    """Where every leaf is near every point, vectors travel once for each pair of tiles: what is written of visits are pairs of leaves, less than one for each row, and no vector stands in it."""
    rng = np.random.default_rng(8)
    rows = [(n, n % 2, rng.normal(size=13).tolist()) for n in range(1200)]
    seen, real = {}, neighbours.stored

    def counting(df, name="stored"):
        out = real(df, name)
        seen[name] = (out.count(), out.columns)
        return out

    monkeypatch.setattr(neighbours, "stored", counting)
    monkeypatch.setattr(neighbours, "TILE_POINTS", 150, raising=False)
    df = spark.createDataFrame(rows, SCHEMA)
    near = neighbours.nearest_of_class(df, crowd=60, k=4, vectors=False)
    assert near.schema["near_"].dataType.elementType.names == ["d2", "o_key"]
    got = sorted(((r.id, r.label, [(f"{n.d2:.10g}", n.o_key) for n in r.near_]) for r in near.collect()), key=repr)
    assert got == plain(rows, 4)
    assert 0 < seen["visits"][0] < len(rows) and "x" not in seen["visits"][1]
    assert seen["pairs"][0] >= 8  # several tiles in each class


@pytest.mark.parametrize("shift, scale", [(1e6, 1.0), (0.0, 2e153), (0.0, 1e-170)])
def test_sizes_of_values(spark, shift, scale):
    """Products of large numbers lose the digits in which near points differ, or are infinite, and those of small ones are 0; the distances don't come from them."""
    rng = np.random.default_rng(4)
    rows = [(n, 1, (shift + np.round(rng.normal(size=3), 2) * scale).tolist()) for n in range(150)]
    got = found(spark.createDataFrame(rows, SCHEMA), crowd=20, k=3)
    assert got == plain(rows, 3)
