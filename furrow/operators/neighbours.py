"""Exact nearest neighbours inside classes, over all features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import drop_stored, free_shuffles, stored

#: Distances that are in memory at once, the number of children of a tree's node as a power of two, and the most points and bytes of vectors in a tile.
CELLS, FAN, TILE_POINTS, TILE_BYTES = 1 << 22, 3, 1 << 16, 1 << 24
_CLASS = ["label", "width"]


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table[name].combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _matrix(table: pa.Table) -> np.ndarray:
    return _column(table, "x").flatten().to_numpy().reshape(len(table), -1)


class _Held:
    """The points of a table that can be found, and their members in the order that decides between equal distances."""

    @np.errstate(all="ignore")
    def __init__(self, table: pa.Table):
        self.x, self.points, self.nodes = _matrix(table), table["point"].to_numpy(), table["node"].to_numpy()
        self.squares = (self.x * self.x).sum(axis=1)
        members = _column(table, "members")
        self.count = members.value_lengths().to_numpy().astype(np.int64)
        flat = members.flatten()
        items = pa.table({"key": flat.field("key"), "row": flat.field("row"), "of": np.repeat(np.arange(len(table)), self.count)}).sort_by([("key", "ascending"), ("row", "ascending")])
        self.key, self.row, self.of = _column(items, "key"), _column(items, "row"), items["of"].to_numpy()
        # The ranks of a point's members, point after point.
        self.ranks, self.first = np.argsort(self.of, kind="stable"), np.concatenate([[0], np.cumsum(self.count)])

    @np.errstate(all="ignore")
    def look(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, places: np.ndarray, gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(d2, rank), k for each seeker: its nearest members at ``places`` (the least far boxes first, ``gaps`` says how far) within ``bound``; places that are left are infinitely far.

        A matrix product with a bound on its error says which points can matter; their distances are then summed feature by feature.
        """
        best, rank = np.full((len(q), k), np.inf), np.full((len(q), k), len(self.of))
        mine, at, step = (q * q).sum(axis=1), 0, max(256, 4 * k)
        while at < len(places):
            limit = np.minimum(bound, best[:, -1])
            here = places[at : at + step][gaps[at : at + step] <= limit.max() * (1 + 1e-9)]
            at += step
            step = max(1, min(4 * step, CELLS // max(1, len(q))))
            if not len(here):
                break  # all that follow are farther
            t = self.x[here]
            about = mine[:, None] + self.squares[here][None, :] - 2 * (q @ t.T)
            slack = 2e-15 * (q.shape[1] + 8) * (mine + self.squares[here].max())
            if len(here) > k and np.isinf(limit).any():
                limit = np.fmin(limit, np.partition(about, k, axis=1)[:, k] + slack)  # the seeker itself may be among the k + 1
            a, b = np.nonzero(~(about > (limit + slack)[:, None]))
            b = here[b]
            other = self.points[b] != own[a]
            a, b = a[other], b[other]
            d2 = np.zeros(len(a))
            for j in range(q.shape[1]):
                d2 += (q[a, j] - self.x[b, j]) * (q[a, j] - self.x[b, j])
            near = d2 <= np.minimum(bound, best[:, -1])[a]
            a, b, d2 = a[near], b[near], d2[near]
            if not len(a):
                continue
            n = self.count[b]
            member = np.repeat(self.first[b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            who = np.concatenate([np.repeat(a, n), np.repeat(np.arange(len(q)), k)])
            far, ranks = np.concatenate([np.repeat(d2, n), best.ravel()]), np.concatenate([self.ranks[member], rank.ravel()])
            order = np.lexsort((ranks, far, who))
            who = who[order]
            place = np.arange(len(who)) - np.searchsorted(who, np.arange(len(q)))[who]
            order = order[place < k]
            best, rank = far[order].reshape(-1, k), ranks[order].reshape(-1, k)
        return best, rank

    def lists(self, best: np.ndarray, rank: np.ndarray) -> pa.Array:
        """The found members as lists of (d2, key, row, other), ``other`` the point they are of."""
        real = np.isfinite(best)
        picked, ends = rank[real], np.concatenate([[0], np.cumsum(real.sum(axis=1))])
        near = pa.StructArray.from_arrays([pa.array(best[real]), self.key.take(pa.array(picked)), self.row.take(pa.array(picked)), pa.array(self.points[self.of[picked]])], ["d2", "key", "row", "other"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)


def _inside(table: pa.Table, k: int) -> pa.Table:
    """A leaf's points with near: the k nearest members of the leaf's other points."""
    held = _Held(table)
    best, rank = np.full((len(table), k), np.inf), np.full((len(table), k), 0)
    every, none = np.arange(len(table)), np.zeros(len(table))
    block = max(1, min(len(table), CELLS // max(1, len(table))))
    for a in range(0, len(table), block):
        part = slice(a, a + block)
        best[part], rank[part] = held.look(held.x[part], held.points[part], np.full(len(held.points[part]), np.inf), every, none, k)
    return table.append_column("near", held.lists(best, rank))


@np.errstate(all="ignore")
def _between(guests: pa.Table, hosts: pa.Table, k: int) -> pa.Table:
    """(point, near) of the guests that find members of hosts in other leaves within their bound: leaf by leaf of the guests, the leaves of hosts from the nearest box on."""
    empty = guests.slice(0, 0).select(["point"])
    held = _Held(hosts)
    order = np.argsort(held.nodes, kind="stable")
    leaves, starts = np.unique(held.nodes[order], return_index=True)
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    if not len(order) or not len(guests):
        return empty.append_column("near", held.lists(np.zeros((0, k)), np.zeros((0, k), np.int64)))
    low, high = np.minimum.reduceat(held.x[order], starts, axis=0), np.maximum.reduceat(held.x[order], starts, axis=0)
    q, own, bound, home = _matrix(guests), guests["point"].to_numpy(), guests["bound"].to_numpy(), guests["node"].to_numpy()
    best, rank = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    for node in np.unique(home):
        ours = np.flatnonzero(home == node)
        for a in range(0, len(ours), 1024):
            some = ours[a : a + 1024]
            apart = np.maximum(np.maximum(low - q[some].max(axis=0), q[some].min(axis=0) - high), 0.0)
            gap = (apart * apart).sum(axis=1)
            near = np.flatnonzero((gap <= bound[some].max()) & (leaves != node))
            near = near[np.argsort(gap[near], kind="stable")]
            if len(near):
                n = sizes[near]
                places = order[np.repeat(starts[near] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                best[some], rank[some] = held.look(q[some], own[some], bound[some], places, np.repeat(gap[near], n), k)
    met = np.isfinite(best[:, 0])
    return pa.table([pa.array(own[met]), held.lists(best[met], rank[met])], ["point", "near"])


def _box(width: int) -> list:
    """Smallest and largest value of each feature, as arrays."""
    return [F.array(*[f(F.get("x", F.lit(j))) for j in range(width)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]


def _tree(points: DataFrame, width: int, crowd: int) -> tuple[DataFrame, int]:
    """``points`` with node, and the number of levels: nodes of more than ``crowd`` points are cut along their widest feature at approximate quantiles, again and again."""
    at = [*_CLASS, "node"]
    tree, levels = points.withColumn("node", F.lit(0).cast("long")), 0
    while True:
        full = stored(tree.groupBy(*at).agg(F.count("*").alias("n"), *_box(width)).filter(F.col("n") > crowd), "nodes")
        if full.isEmpty():
            return tree, levels
        spread = F.zip_with("high", "low", lambda a, b: a - b)
        dim = full.withColumn("spread", spread).withColumn("dim", F.array_position("spread", F.array_max("spread")).cast("int") - 1)
        dim = dim.select(*at, "n", "dim", F.get("low", F.col("dim")).alias("least"), F.get("high", F.col("dim")).alias("most"))
        v = F.get("x", F.col("dim"))
        steps = F.array(*[F.lit(s / 8) for s in range(1, 8)])
        cuts = tree.join(dim, at).groupBy(*at).agg(F.percentile_approx(v, steps, F.lit(1000)).alias("cuts"))
        # As many parts as make leaves of about ``crowd``. Where most values are the largest one quantiles part nothing: then the cut is half way between the ends.
        half = (F.col("least") + F.col("most")) / 2
        fewer = F.when(F.col("n") > 4 * crowd, F.col("cuts")).when(F.col("n") > 2 * crowd, F.array(*[F.get("cuts", F.lit(j)) for j in (1, 3, 5)])).otherwise(F.array(F.get("cuts", F.lit(3))))
        sure = F.when(F.array_min(fewer) < F.col("most"), fewer).otherwise(F.array(F.when(half < F.col("most"), half).otherwise(F.col("least"))))
        cut = stored(dim.join(cuts, at).select(*at, "dim", sure.alias("cuts")), "cuts")
        part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < v)))
        new = stored(tree.join(cut, at, "left").withColumn("node", F.shiftleft("node", FAN) + part).select(*points.columns, "node"), "tree")
        if levels:
            drop_stored(tree)
        for used in (full, cut):
            drop_stored(used)
        tree, levels = new, levels + 1


def _tiles(leaves: DataFrame, levels: int, most: int) -> DataFrame:
    """(class, node, tile): for each leaf the highest node of the tree above it with at most ``most`` points."""
    ups = leaves.select(*_CLASS, "node", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("up")).withColumn("top", F.expr(f"shiftright(node, cast(up * {FAN} as int))"))
    few = ups.groupBy(*_CLASS, "up", "top").agg(F.sum("n").alias("points")).filter((F.col("points") <= most) | (F.col("up") == 0)).drop("points")
    return ups.join(few, [*_CLASS, "up", "top"]).groupBy(*_CLASS, "node").agg(F.max(F.struct("up", "top")).alias("t")).select(*_CLASS, "node", F.concat_ws("/", "t.up", "t.top").alias("tile"))


def nearest_of_class(rows: DataFrame, features: str = "features", label: str = "label", key: str = "id", k: int = 5, crowd: int = 1000, vectors: bool = True) -> DataFrame:
    """(key, label, features, near_) of each row: its ``k`` nearest other rows of the class, as (d2, o_key, o_features) from the nearest on, ties to the smallest key. Without ``vectors`` o_features is left out.

    Rows with equal features are one point that carries its k + 1 smallest keys. A tree cuts each class along its widest features into leaves of at most ``crowd`` points. The own leaf gives a point a first k-th
    distance; level by level a leaf then asks only the boxes of the tree that are not farther than the largest of these, over all features. Leaves that ask and leaves that are asked meet in tiles of up to ``TILE_POINTS``
    points: a point travels once for each pair of tiles, not once for each leaf, and in a tile only leaves near enough are compared. So on clustered rows work goes with the leaves near a point, not with the size of
    the class. Features that say nothing of each other make every leaf near, as for any exact index: then each two points of a class are compared, by matrix products, and a vector travels twice for each tile of its class.

    Defined results: rows are told apart by a number of their own, so those that share a key are neighbours of each other; rows whose features are null or hold null, NaN or infinite values,
    rows without a label and the only row of a class have an empty near_; so have neighbours only among rows with as many features; equal rows at equal distance stand in any order; an empty table gives an
    empty result; other columns don't come back.
    """
    spark = rows.sparkSession
    whole = F.col("x").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & (F.size("x") > 0)
    every = stored(rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(features).cast("array<double>").alias("x")).withColumn("row", F.monotonically_increasing_id()), "rows")
    good = every.filter(whole)
    of_key, of_label = (every.schema[c].dataType.simpleString() for c in ("key", "label"))
    # row_number with a bound is kept small on the way to the shuffle, so a common vector is never gathered.
    twins = good.withColumn("n", F.row_number().over(Window.partitionBy("label", "x").orderBy("key", "row"))).filter(F.col("n") <= k + 1)
    points = twins.groupBy("label", "x").agg(F.array_sort(F.collect_list(F.struct("key", "row"))).alias("members"))
    points = stored(points.withColumn("width", F.size("x")).withColumn("point", F.monotonically_increasing_id()), "points")
    width = points.agg(F.coalesce(F.max("width"), F.lit(1))).first()[0]
    tree, levels = _tree(points, width, crowd)
    leaf, near = [*_CLASS, "node"], f"near array<struct<d2: double, key: {of_key}, row: long, other: long>>"
    columns = ["label", "width", "node", "point", "x", "members"]
    inside, between = (lambda t: _inside(t, k)), (lambda a, b: _between(a, b, k))
    searched = tree.select(*columns).groupBy(*leaf).applyInArrow(inside, f"label {of_label}, width int, node long, point long, x array<double>, members array<struct<key: {of_key}, row: long>>, {near}")
    # What the row's twins don't fill has to come from other points: beyond the distance of the last of these no leaf matters.
    missing = F.lit(k) - F.size("members") + 1
    bound = F.when(missing <= 0, F.lit(-1.0)).when(F.size("near") < missing, F.lit(float("inf"))).otherwise(F.get("near", missing - 1)["d2"] * (1 + 1e-9))
    own = stored(searched.withColumn("bound", bound), "own-leaf")
    if levels:
        drop_stored(tree)
    found = own.select("point", "near")
    if levels:
        leaves = stored(own.groupBy(*leaf).agg(F.count("*").alias("n"), F.max("bound").alias("bound"), *_box(width)), "leaves")
        asking = leaves.filter("bound >= 0").select(*_CLASS, F.col("node").alias("home"), "bound", F.col("low").alias("from"), F.col("high").alias("to"), F.lit(0).cast("long").alias("at"))
        for level in range(1, levels + 1):
            here = F.shiftright("node", FAN * (levels - level))
            sides = [F.array(*[f(F.get(c, F.lit(j))) for j in range(width)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
            boxes = leaves.withColumn("here", here).groupBy(*_CLASS, "here").agg(*sides).withColumn("at", F.shiftright("here", FAN))
            apart = F.zip_with(F.zip_with("low", "to", lambda a, v: F.greatest(a - v, F.lit(0.0))), F.zip_with("from", "high", lambda v, b: F.greatest(v - b, F.lit(0.0))), lambda a, b: (a + b) * (a + b))
            gap = F.aggregate(F.slice(apart, 1, F.col("width")), F.lit(0.0), lambda s, v: s + v)
            asking = asking.join(boxes, [*_CLASS, "at"]).filter(gap <= F.col("bound")).drop("at", "low", "high").withColumnRenamed("here", "at")
        visits = stored(asking.filter("at <> home").select(*_CLASS, "home", F.col("at").alias("node")), "visits")
        tiles = stored(_tiles(leaves, levels, max(crowd, min(TILE_POINTS, TILE_BYTES // (8 * width)))), "tiles")
        seeks = tiles.withColumnsRenamed({"node": "home", "tile": "seek"})
        pairs = stored(visits.join(seeks, [*_CLASS, "home"]).join(tiles.withColumnRenamed("tile", "host"), leaf).select(*_CLASS, "seek", "host").distinct(), "pairs")
        free_shuffles(spark)
        placed, by = own.join(tiles, leaf), [*_CLASS, "seek", "host"]
        guests = placed.filter("bound >= 0").withColumnRenamed("tile", "seek").join(pairs, [*_CLASS, "seek"]).select(*[F.col(c).alias(c) for c in (*by, "node", "point", "x", "bound")])  # names of its own, as both sides come from one table
        hosts = placed.withColumnRenamed("tile", "host").join(pairs, [*_CLASS, "host"]).select(*by, "node", "point", "x", "members")
        more = stored(guests.groupBy(*by).cogroup(hosts.groupBy(*by)).applyInArrow(between, f"point long, {near}"), "more")
        free_shuffles(spark)
        found = stored(found.unionByName(more).groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "found")
        for used in (own, leaves, visits, tiles, pairs, more):
            drop_stored(used)
        free_shuffles(spark)
    if vectors:
        there = points.select(F.col("point").alias("other"), F.col("x").alias("o_x"))
        met = found.select("point", F.posexplode("near").alias("pos", "m")).withColumn("other", F.col("m")["other"]).join(there, "other")
        named = F.struct("pos", F.col("m")["d2"].alias("d2"), F.col("m")["key"].alias("key"), F.col("m")["row"].alias("row"), F.col("o_x").alias("x"))
        found = met.groupBy("point").agg(F.array_sort(F.collect_list(named)).alias("near"))
    named = lambda d2, m, x: F.struct(d2.alias("d2"), m["key"].alias("o_key"), m["row"].alias("row"), *([x.alias("o_features")] if vectors else []))
    others = points.join(found, "point", "left").select("label", "x", "members", "near")
    met = good.join(others, ["label", "x"])
    of_row = F.transform(F.filter("members", lambda m: m["row"] != F.col("row")), lambda m: named(F.lit(0.0), m, F.col("x")))
    theirs = F.transform("near", lambda m: named(m["d2"], m, m["x"] if vectors else None))
    best = F.slice(F.array_sort(F.concat(of_row, F.coalesce(theirs, F.array().cast(f"array<struct<d2: double, o_key: {of_key}, row: long{', o_features: array<double>' * vectors}>>")))), 1, k)
    near = F.transform(best, lambda m: F.struct(*[m[c].alias(c) for c in ("d2", "o_key", *["o_features"] * vectors)]))
    out = met.select("key", "label", "x", near.alias("near_"))
    bare = every.filter(~whole).select("key", "label", "x", F.array().cast(out.schema["near_"].dataType).alias("near_"))
    return out.unionByName(bare).select(F.col("key").alias(key), F.col("label").alias(label), F.col("x").alias(features), "near_")
