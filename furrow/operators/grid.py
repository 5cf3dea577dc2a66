"""Grids of cells: addresses, resampling, gap filling, windows over neighbours, polygons."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.columns import pack, unpack
from furrow.session import stored


@dataclass(frozen=True)
class Grid:
    """Extent and resolution; rows count from the top, columns from the left."""

    xmin: float = -180.0
    xmax: float = 180.0
    ymin: float = -56.0
    ymax: float = 84.0
    res: float = 1 / 12

    @property
    def nx(self) -> int:
        return round((self.xmax - self.xmin) / self.res)

    @property
    def ny(self) -> int:
        return round((self.ymax - self.ymin) / self.res)


def to_cell(grid: Grid, lon, lat) -> tuple:
    """G1: (row, column, cell id) of a place; null outside the grid."""
    inside = (lon >= grid.xmin) & (lon < grid.xmax) & (lat > grid.ymin) & (lat <= grid.ymax)
    col, row = F.floor((lon - grid.xmin) / grid.res), F.floor((grid.ymax - lat) / grid.res)
    return F.when(inside, row), F.when(inside, col), F.when(inside, row * grid.nx + col)


def to_lonlat(grid: Grid, row, col) -> tuple:
    """G1: the centre of a cell."""
    return grid.xmin + (col + 0.5) * grid.res, grid.ymax - (row + 0.5) * grid.res


def clip(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int], row: str = "row_no", col: str = "col_no") -> DataFrame:
    """Cells with first <= row < end and the same for columns; the ranges reach the scan."""
    return df.filter((F.col(row) >= rows[0]) & (F.col(row) < rows[1]) & (F.col(col) >= cols[0]) & (F.col(col) < cols[1]))


def georeference_default(has_reference, res, width):
    """The resolution of a source, or that of the whole globe over its width where it has no reference."""
    return F.when(has_reference, res).otherwise(360.0 / width)


def resample_nearest(source: DataFrame, target: DataFrame, factor: float, value: str) -> DataFrame:
    """Each target cell takes the value of the source cell that holds its centre; ``factor``: source cells per target cell."""
    at = target.withColumn("s_row", F.floor((F.col("row_no") + 0.5) * factor)).withColumn("s_col", F.floor((F.col("col_no") + 0.5) * factor))
    return at.join(source.select(F.col("row_no").alias("s_row"), F.col("col_no").alias("s_col"), value), ["s_row", "s_col"], "left").drop("s_row", "s_col")


def _coarse(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumn("c_row", F.floor(F.col("row_no") / factor)).withColumn("c_col", F.floor(F.col("col_no") / factor))


def resample_average(df: DataFrame, factor: int, value) -> DataFrame:
    """The mean of a column (or of a condition as 0 and 1) over the fine cells of each coarse one."""
    return _coarse(df, factor).groupBy("c_row", "c_col").agg(F.avg(value).alias("mean"))


def resample_mode(df: DataFrame, factor: int, value: str) -> DataFrame:
    """The most frequent value of each coarse cell, the smallest of equals; counts are summed before they meet."""
    counts = _coarse(df, factor).filter(F.col(value).isNotNull()).groupBy("c_row", "c_col", value).agg(F.count("*").alias("n"))
    return counts.groupBy("c_row", "c_col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"))


def resample_bilinear(source: DataFrame, target: DataFrame, factor: float, value: str) -> DataFrame:
    """Each target centre from its four source neighbours; missing ones give their weight to the others."""
    y, x = (F.col("row_no") + 0.5) * factor - 0.5, (F.col("col_no") + 0.5) * factor - 0.5
    fy, fx = y - F.floor(y), x - F.floor(x)
    four = F.array(*[F.struct((F.floor(y) + dy).alias("s_row"), (F.floor(x) + dx).alias("s_col"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    near = target.select("row_no", "col_no", F.explode(four).alias("f")).select("row_no", "col_no", "f.*")
    met = near.join(source.select(F.col("row_no").alias("s_row"), F.col("col_no").alias("s_col"), F.col(value).alias("v")), ["s_row", "s_col"]).filter("v IS NOT NULL AND w > 0")
    return met.groupBy("row_no", "col_no").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))


def disaggregate(coarse: DataFrame, fine: DataFrame, factor: int, value: str) -> DataFrame:
    """Every fine cell repeats the value of its coarse cell."""
    keyed = _coarse(fine, factor)
    return keyed.join(coarse.select(F.col("row_no").alias("c_row"), F.col("col_no").alias("c_col"), value), ["c_row", "c_col"], "left").drop("c_row", "c_col")


def sanitize(column, low: float, high: float):
    """Values outside the range, and NaN, as null."""
    return F.when(column.between(low, high) & ~F.isnan(column), column)


def autoscale(df: DataFrame, column: str, limit: float = 100.0, divisor: float = 10_000.0) -> DataFrame:
    """Divide the column if its largest value is above the limit."""
    most = df.agg(F.max(column).alias("most_"))  # one row
    return df.crossJoin(F.broadcast(most)).withColumn(column, F.when(F.col("most_") > limit, F.col(column) / divisor).otherwise(F.col(column))).drop("most_")


#: Codes of field sizes and their classes.
FIELD_SIZES = {3502: 1, 3503: 2, 3504: 3, 3505: 4, 3506: 5}


def reclassify(column, mapping: dict = FIELD_SIZES):
    """Codes by a table; others null."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def shallow_mask(depth, limit: float = 15.0):
    """Depths under the limit, others null."""
    return F.when(depth < limit, depth)


def spine(df: DataFrame, tile: int, halo: int, ny: int, nx: int) -> DataFrame:
    """Every cell of the tiles that hold data and of those that a window reaches from them."""
    tiles = df.select(F.floor(F.col("row_no") / tile).alias("ty"), F.floor(F.col("col_no") / tile).alias("tx")).distinct()
    ring = -(-halo // tile)
    around = F.sequence(F.lit(-ring), F.lit(ring))
    wide = tiles.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select((F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx")).distinct()
    steps = F.sequence(F.lit(0), F.lit(tile - 1))
    cells = wide.withColumn("y", F.explode(steps)).withColumn("x", F.explode(steps)).select((F.col("ty") * tile + F.col("y")).alias("row_no"), (F.col("tx") * tile + F.col("x")).alias("col_no"))
    return cells.filter((F.col("row_no") >= 0) & (F.col("row_no") < ny) & (F.col("col_no") >= 0) & (F.col("col_no") < nx))


def focal_box(df: DataFrame, value: str, size: int, ny: int, nx: int, tile: int = 64) -> DataFrame:
    """(row, column, focal_sum, focal_n): sums and numbers of values in a square window around each cell of the spine.

    Separable: sums along rows, then along columns of those sums. An even size reaches half back and one less forward. Cells beyond
    the grid count as absent.
    """
    return _box_sums(spine(df, tile, size, ny, nx).join(df.select("row_no", "col_no", F.col(value).alias("v")), ["row_no", "col_no"], "left"), size)


def _box_sums(dense: DataFrame, size: int) -> DataFrame:
    """(row, column, focal_sum, focal_n) of ``dense(row_no, col_no, v)``, v null where nothing is."""
    back, ahead = size // 2, (size - 1) // 2
    along_row = Window.partitionBy("row_no").orderBy("col_no").rangeBetween(-back, ahead)
    along_col = Window.partitionBy("col_no").orderBy("row_no").rangeBetween(-back, ahead)
    first = dense.select("row_no", "col_no", F.sum(F.coalesce("v", F.lit(0.0))).over(along_row).alias("s"), F.sum(F.when(F.col("v").isNotNull(), 1).otherwise(0)).over(along_row).alias("n"))
    return first.select("row_no", "col_no", F.sum("s").over(along_col).alias("focal_sum"), F.sum("n").over(along_col).alias("focal_n"))


def focal_circle(df: DataFrame, value: str, radius: int, ny: int, nx: int, tile: int = 64) -> DataFrame:
    """(row, column, focal_mean): the mean of the values in a disc, for cells that any value reaches. Each row of the disc is a chord, summed along its row; the
    chords of 2 r + 1 rows are added by window frames of one row each along the column, so a cell stays one row throughout."""
    dense = spine(df, tile, radius, ny, nx).join(df.select("row_no", "col_no", F.col(value).alias("v")), ["row_no", "col_no"], "left")
    chords = [(dy, int((radius * radius - dy * dy) ** 0.5)) for dy in range(-radius, radius + 1)]
    row, column = Window.partitionBy("row_no").orderBy("col_no"), Window.partitionBy("col_no").orderBy("row_no")
    widths = sorted({w for _, w in chords})
    sums = dense.select("row_no", "col_no", *[x for w in widths for x in (F.sum(F.coalesce("v", F.lit(0.0))).over(row.rangeBetween(-w, w)).alias(f"s{w}"), F.count("v").over(row.rangeBetween(-w, w)).alias(f"n{w}"))])
    there = lambda c, dy: F.coalesce(F.first(c).over(column.rangeBetween(dy, dy)), F.lit(0))  # noqa: E731  a row and column is one cell
    met = sums.select("row_no", "col_no", sum((there(f"s{w}", dy) for dy, w in chords), F.lit(0.0)).alias("s"), sum((there(f"n{w}", dy) for dy, w in chords), F.lit(0)).alias("n"))
    return met.filter("n > 0").select("row_no", "col_no", (F.col("s") / F.col("n")).alias("focal_mean"))


def dasymetric(coarse: DataFrame, fraction: DataFrame, size: int, ny: int, nx: int, cell_area: float = 6.25) -> DataFrame:
    """Coarse area spread by capacity: ``coarse(row_no, col_no, crop, area)``, ``fraction(row_no, col_no, fraction)``; fraction 0 as null."""
    capacity = fraction.select("row_no", "col_no", (cell_area * F.col("fraction")).alias("capacity"))
    local = focal_box(capacity, "capacity", size, ny, nx)
    weight = F.col("capacity") / F.when(F.col("focal_sum") == 0, 1.0).otherwise(F.col("focal_sum"))
    shares = capacity.join(local, ["row_no", "col_no"]).select("row_no", "col_no", F.when(F.col("capacity") > 0, weight).alias("weight"))
    return coarse.join(shares, ["row_no", "col_no"]).select("row_no", "col_no", "crop", (F.col("area") * F.col("weight")).alias("area")).filter("area IS NOT NULL")


def fill_focal(df: DataFrame, target: DataFrame, value: str, windows: list[int], ny: int, nx: int, tile: int = 64) -> DataFrame:
    """``target`` cells without a value take the rounded mean of valid, non-zero neighbours, in growing windows.

    Each pass starts from the cells that are still open: sums are taken only in their tiles and in those that a window reaches from there, and what a pass has filled is written and is a source of the next. So
    the last passes, with the widest windows, touch the few places that are left.

    Defined results: only target cells are sources; 0 is a value but no source; a cell that no window fills keeps null; of several values of one cell the first in order counts; repeated targets return as often;
    cells without row or column keep null. Columns of ``target`` come back, one called like the value is replaced.
    """
    place = ["row_no", "col_no"]
    own = pack(target, row_no=F.col("row_no").cast("long"), col_no=F.col("col_no").cast("long"))
    given = df.select(*[F.col(c).cast("long").alias(c) for c in place], F.col(value).alias("v")).filter("v IS NOT NULL").groupBy(*place).agg(F.min("v").alias("v"))
    known = stored(own.select(*place).filter("row_no IS NOT NULL AND col_no IS NOT NULL").distinct().join(given, place, "left"), "known")
    filled, open_, source = known.filter("v IS NOT NULL"), known.filter("v IS NULL").select(*place), known.filter("v IS NOT NULL AND v <> 0")
    for size in windows:
        if open_.isEmpty():
            break
        dense = spine(open_, tile, size, ny, nx).join(source, place, "left")
        mean = _box_sums(dense, size).filter("focal_n > 0").select(*place, F.bround(F.col("focal_sum") / F.col("focal_n")).alias("v"))
        new = stored(open_.join(mean, place), "filled")
        filled, source, open_ = filled.unionByName(new), source.unionByName(new.filter("v <> 0")), stored(open_.join(new, place, "left_anti"), "open")
    met = own.join(filled.select(F.col("row_no").alias("f_row"), F.col("col_no").alias("f_col"), "v"), (F.col("row_no") == F.col("f_row")) & (F.col("col_no") == F.col("f_col")), "left")
    return unpack(met, target.columns, **{value: F.col("v")})


def _nearest_in_row(sites: tuple[np.ndarray, np.ndarray], row: int, wanted: np.ndarray) -> np.ndarray:
    """For each column of ``wanted`` (ascending) the number of its nearest site; ``sites``: (rows, columns) with columns ascending, one site for each column. Ties to the lowest row, then column.

    Least values of a family of parabolas: the best site moves right as the target does, so the targets in the middle part the sites for those on both sides, all of one depth at once.
    """
    rows, columns = sites
    # Scaled so that whole numbers order by distance, then row; of equals the first, which has the lowest column, is taken.
    scale = int(rows.max() - rows.min()) + 1
    height = (rows - row) ** 2 * scale + (rows - rows.min())
    best = np.zeros(len(wanted), np.int64)
    parts = np.array([[0, len(wanted), 0, len(rows) - 1]])  # first target, end, first site, last site
    while len(parts):
        first, end, low, high = parts.T
        middle = (first + end) // 2
        n = high - low + 1
        starts = np.cumsum(n) - n
        site = np.arange(n.sum()) - np.repeat(starts - low, n)
        cost = height[site] + (columns[site] - np.repeat(wanted[middle], n)) ** 2 * scale
        least = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(least, n))
        found = site[hits[np.searchsorted(hits, starts)]]
        best[middle] = found
        parts = np.concatenate([np.stack([first, middle, low, found], 1), np.stack([middle + 1, end, found, high], 1)])
        parts = parts[parts[:, 0] < parts[:, 1]]
    return best


def fill_nearest(df: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """``target`` cells take the value of the nearest cell that has one, however far, ties to the lowest row, then column.

    An exact distance transform in two steps. Targets with a value of their own are served by a join. For the others only cells with a neighbour missing count, as behind any other there is a nearer one.
    Along its column such a cell is the nearest for an interval of rows, half way to the next ones; in a row of targets each column so has one candidate, and the lower envelope of their
    parabolas gives all targets of the row theirs. A row is one task's group, as long as the grid is wide; rows without targets are left out. Work grows with columns times rows of
    targets, not with the distance.

    Defined results: targets without row or column, and all targets where no cell has a value, get null; of several values of one cell the smallest counts; repeated targets return as often; an empty table of targets gives an
    empty result; other columns don't come back.
    """
    place = ["row_no", "col_no"]
    kind = df.schema[value].dataType
    # The caller's value may have any name: it is v from here on.
    valid = df.filter(F.col(value).isNotNull() & F.col("row_no").isNotNull() & F.col("col_no").isNotNull()).select(*[F.col(c).cast("long").alias(c) for c in place], F.col(value).alias("v"))
    valid = stored(valid.groupBy(*place).agg(F.min("v").alias("v")), "valid")
    met = stored(target.select(*[F.col(c).cast("long").alias(c) for c in place]).join(valid, place, "left"), "met")
    open_ = met.filter("v IS NULL AND row_no IS NOT NULL AND col_no IS NOT NULL").select(*place)
    span = open_.agg(F.min("row_no"), F.max("row_no")).first()
    served = met.filter("v IS NOT NULL OR row_no IS NULL OR col_no IS NULL").select(*place, "v")
    if span[0] is None or valid.isEmpty():
        return met.select(*place, F.col("v").alias(value))
    sides = F.explode(F.array(*[F.struct((F.col("row_no") + y).alias("row_no"), (F.col("col_no") + x).alias("col_no")) for y, x in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    inner = valid.select(sides.alias("s")).groupBy("s.row_no", "s.col_no").count().filter("count = 4").select(*place)
    edge = valid.join(inner, place, "left_anti")
    column = Window.partitionBy("col_no").orderBy("row_no")
    # Half way between two rows the upper one counts.
    low, high = F.floor((F.lag("row_no").over(column) + F.col("row_no")) / 2) + 1, F.floor((F.col("row_no") + F.lead("row_no").over(column)) / 2)
    reach = edge.withColumn("low", F.greatest(F.coalesce(low, F.lit(span[0])), F.lit(span[0]))).withColumn("high", F.least(F.coalesce(high, F.lit(span[1])), F.lit(span[1]))).filter("low <= high")
    rows = open_.select(F.col("row_no").alias("at")).distinct()
    sites = reach.select(F.explode(F.sequence("low", "high")).alias("at"), *place, "v").join(rows, "at", "left_semi")
    both = sites.withColumn("open", F.lit(False)).unionByName(open_.select(F.col("row_no").alias("at"), *place, F.lit(None).cast(kind).alias("v"), F.lit(True).alias("open")))

    def run(table: pa.Table) -> pa.Table:
        row, columns, is_open = (table[c].to_numpy() for c in ("row_no", "col_no", "open"))
        is_open = is_open.astype(bool)
        at = int(table["at"][0].as_py())
        held, wanted = np.flatnonzero(~is_open), np.flatnonzero(is_open)
        held, wanted = held[np.argsort(columns[held], kind="stable")], wanted[np.argsort(columns[wanted], kind="stable")]
        best = held[_nearest_in_row((row[held], columns[held]), at, columns[wanted])]
        return pa.table([pa.array(row[wanted]), pa.array(columns[wanted]), table["v"].take(pa.array(best))], [*place, "v"])

    found = both.groupBy("at").applyInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in place] + [T.StructField("v", kind)]))
    return served.unionByName(found).select(*place, F.col("v").alias(value))


def fill_default(value, default: float, where):
    """A default for missing values where the condition holds."""
    return F.when(where, F.coalesce(value, F.lit(default)))


def snap_to_categories(value, categories: tuple[float, ...] = (10.0, 20.0, 30.0, 40.0, 50.0)):
    """The nearest category, the smallest of equals."""
    near = F.array_min(F.array(*[F.struct(F.abs(value - c).alias("d"), F.lit(c).alias("c")) for c in categories]))
    return F.when(value.isNotNull(), near["c"])


def allocate_country(edges: DataFrame, grid: Grid) -> DataFrame:
    """(row, column, country_code) of cells whose centre lies in a polygon; of several the one with the largest ``polygon_id``.

    ``edges(polygon_id, country_code, x1, y1, x2, y2)``. Scan lines: every edge gives its crossing with each row of centres, sorted crossings
    of a row pair up, and the columns between a pair are filled.
    """
    y_of = lambda r: grid.ymax - (r + 0.5) * grid.res
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.ceil((grid.ymax - high) / grid.res - 0.5), F.lit(0)), F.least(F.ceil((grid.ymax - low) / grid.res - 0.5) - 1, F.lit(grid.ny - 1))
    rows = edges.filter("y1 <> y2").withColumn("first_", first).withColumn("last_", last).filter("first_ <= last_").withColumn("row_no", F.explode(F.sequence("first_", "last_")))
    y = y_of(F.col("row_no"))
    crossed = rows.filter((y >= low) & (y < high)).select("polygon_id", "country_code", "row_no", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    order = Window.partitionBy("polygon_id", "row_no").orderBy("x")
    paired = crossed.withColumn("k", F.row_number().over(order)).withColumn("x_end", F.lead("x").over(order)).filter("k % 2 = 1 AND x_end IS NOT NULL")
    a, b = F.greatest(F.ceil((F.col("x") - grid.xmin) / grid.res - 0.5), F.lit(0)), F.least(F.ceil((F.col("x_end") - grid.xmin) / grid.res - 0.5) - 1, F.lit(grid.nx - 1))
    filled = paired.withColumn("a", a).withColumn("b", b).filter("a <= b").select("polygon_id", "country_code", "row_no", F.explode(F.sequence("a", "b")).alias("col_no"))
    return filled.groupBy("row_no", "col_no").agg(F.nullif(F.max_by("country_code", "polygon_id"), F.lit(0)).alias("country_code")).filter("country_code IS NOT NULL")


def dissolve(parts: DataFrame, key: str, attributes: list[str], order: str = "part_id") -> DataFrame:
    """One row for each key; attributes of the first part."""
    return parts.groupBy(key).agg(*[F.min_by(a, order).alias(a) for a in attributes], F.count("*").alias("n_parts"))


def dissolve_outline(edges: DataFrame, key: str = "country_code") -> DataFrame:
    """(key, x1, y1, x2, y2): the outline of all parts of a key together, from the edges of its parts in any direction.

    Edges that two parts share are inside the whole and cancel out. Edges are taken by the line on which they lie (upright, level or, for slanted ones, the edge itself), cut at every end
    that lies there, and a piece stays if an odd number of edges covers it; pieces that touch and lie between the same two changes come back as one. So a long edge of one part goes
    against several short ones of its neighbours. Slanted edges cancel only where both ends are equal, as their lines can't be told apart exactly in floating point.

    Defined results: parts must not overlap in area (a place that two parts cover counts as outside, by the same rule of odd numbers as in G20); edges of no length or with a null coordinate are dropped; a
    null key is a key; an edge that stands there twice cancels itself; pieces have x1 < x2, or x1 = x2 and y1 < y2; an empty table gives an empty result; other columns don't come back.
    """
    ends = ("x1", "y1", "x2", "y2")
    whole = edges.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in ends]).filter(" AND ".join(f"{c} IS NOT NULL" for c in ends)).filter("x1 <> x2 OR y1 <> y2")
    turned = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    swapped = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    plain = whole.select("k", *[F.when(turned, F.col(swapped[c])).otherwise(F.col(c)).alias(c) for c in ends])
    # Equal edges first: a group-by that combines before its shuffle leaves the odd ones.
    odd = plain.groupBy("k", *ends).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
    slanted = odd.filter("x1 <> x2 AND y1 <> y2")
    upright = F.col("x1") == F.col("x2")
    on_line = odd.filter("x1 = x2 OR y1 = y2").select("k", upright.alias("upright"), F.when(upright, F.col("x1")).otherwise(F.col("y1")).alias("line"), F.when(upright, F.col("y1")).otherwise(F.col("x1")).alias("a"), F.when(upright, F.col("y2")).otherwise(F.col("x2")).alias("b"))
    # Each end changes whether what follows is covered by an odd number; ends that meet in even number change nothing.
    changes = on_line.select("k", "upright", "line", F.explode(F.array("a", "b")).alias("at")).groupBy("k", "upright", "line", "at").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    along = Window.partitionBy("k", "upright", "line").orderBy("at")
    pieces = changes.withColumn("place", F.row_number().over(along)).withColumn("to", F.lead("at").over(along)).filter("place % 2 = 1")
    straight = pieces.select("k", F.when(F.col("upright"), F.col("line")).otherwise(F.col("at")).alias("x1"), F.when(F.col("upright"), F.col("at")).otherwise(F.col("line")).alias("y1"), F.when(F.col("upright"), F.col("line")).otherwise(F.col("to")).alias("x2"), F.when(F.col("upright"), F.col("to")).otherwise(F.col("line")).alias("y2"))
    return straight.unionByName(slanted).select(F.col("k").alias(key), *ends)


def assign_codes(df: DataFrame, name: str = "iso3") -> DataFrame:
    """(name, code): 1..n in alphabetical order; null and -99 have none."""
    distinct = df.filter(F.col(name).isNotNull() & (F.col(name) != "-99")).select(name).distinct()
    return distinct.withColumn("code", F.dense_rank().over(Window.orderBy(name)))  # one row for each country


#: Income groups and their codes.
INCOME = {"L": 1, "LM": 2, "UM": 3, "H": 4}


def income_levels(history: DataFrame, year: int = 2010) -> DataFrame:
    """(iso3, income_code) of three-letter codes: that of the year, else of the nearest year (the earlier of equals)."""
    rows = history.filter((F.length("iso3") == 3) & F.col("level").isin(*INCOME))
    near = rows.groupBy("iso3").agg(F.min_by("level", F.struct(F.abs(F.col("year") - year), F.col("year"))).alias("level"))
    return near.select("iso3", reclassify(F.col("level"), INCOME).alias("income_code"))


def high_income_mask(cells: DataFrame, income: DataFrame, least: int = 3, mark: int = 400) -> DataFrame:
    """``cells`` with high: the mark where the country's income code is at least ``least``, else null."""
    met = pack(cells, c="country_code").join(income.select(F.col("country_code").alias("i_c"), F.col("income_code").alias("i_code")), F.col("c") == F.col("i_c"), "left")
    return unpack(met, cells.columns, high=F.when(F.col("i_code") >= least, mark))


def crosses(px, py):
    """Whether a ray to the right of (px, py) crosses the edge in x1, y1, x2, y2."""
    return ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))


def points_within(points: DataFrame, edges: DataFrame, bucket: float, crowd: int = 100_000) -> DataFrame:
    """``points(point_id, x, y)`` with the country_code of the polygon that holds each, null outside all; by ray casting.

    Points and edges meet in bands of y, so an edge is tested only against points of the bands that it spans. A band with more than ``crowd`` points is dealt by a hash
    into parts, each of which gets the band's edges. Points without x or y are outside; of several polygons the one with the largest id counts.
    A column of the points that is called country_code is replaced; all others come back.
    """
    at = lambda v: F.floor(v / bucket)
    placed = points.select("point_id", "x", "y", at(F.col("y")).alias("band"))
    parts = stored(placed.groupBy("band").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts")))
    spans = edges.withColumn("band", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    spans = spans.join(parts, "band").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = placed.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int")).drop("parts")
    met = dealt.join(spans, ["band", "part"]).filter(crosses(F.col("x"), F.col("y")))
    inside = met.groupBy("point_id", "polygon_id").agg(F.count("*").alias("n"), F.first("country_code").alias("country_code")).filter("n % 2 = 1")
    found = inside.groupBy("point_id").agg(F.max_by("country_code", "polygon_id").alias("of_polygon")).select(F.col("point_id").alias("p_id"), "of_polygon")
    return unpack(pack(points, id="point_id").join(found, F.col("id") == F.col("p_id"), "left"), points.columns, country_code=F.col("of_polygon"))
