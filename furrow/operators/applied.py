"""Functions of the caller along an axis and over windows, for what built-in expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def apply_along(df: DataFrame, by: list[str], order: str, values: list[str], f: Callable[..., object], result: str, most: int = 100_000) -> DataFrame:
    """(by, result): ``f`` of each group's ``values``, one array a column in the order of ``order``.

    ``result`` names one column and its type, as ``mode double``; a list type takes what has one entry for each place of the axis. Groups are put together by a group-by, so an
    axis is held whole: one of more than ``most`` rows is an error, as nothing may be cut from it. Arrays of many groups go to Python in one Arrow batch.

    Defined results: rows that share a place of the axis stand in the order of their values, null places first; null values are NaN in arrays of numbers and None in others; a null key is a group; a group has one
    row or more, so an empty table gives an empty result; None from ``f`` is null. Other columns don't come back.
    """
    name, kind = result.split(None, 1)
    to = T.StructType.fromDDL(f"r {kind}").fields[0].dataType
    arrow = to_arrow_type(to)
    kinds = [df.schema[v].dataType for v in values]

    def arrays(part: pa.Array, numbers: bool) -> list:
        flat = part.flatten()
        flat = flat.to_numpy(zero_copy_only=False).astype(float) if numbers else np.array(flat.to_pylist(), dtype=object)
        ends = np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(flat, ends[:-1])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            if len(columns[0]):
                axes = [arrays(c, isinstance(k, T.NumericType)) for c, k in zip(columns, kinds)]
                yield pa.array([_plain(f(*own)) for own in zip(*axes)], arrow)
            else:
                yield pa.array([], arrow)

    whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])))
    groups = df.groupBy(*[F.col(b).alias(f"b{k}") for k, b in enumerate(by)]).agg(whole.alias("axis"))
    axis = F.when(F.size("axis") <= most, F.col("axis")).otherwise(F.raise_error(F.concat(F.lit(f"an axis has more than {most} rows: "), F.size("axis").cast("string"))))
    call = F.arrow_udf(run, to)
    out = groups.withColumn("axis", axis).withColumn("r", call(*[F.col("axis")[f"v{k}"] for k in range(len(values))]))
    return out.select(*[F.col(f"b{k}").alias(b) for k, b in enumerate(by)], F.col("r").alias(name))


def _plain(x: object) -> object:
    if isinstance(x, np.ndarray):
        return [_plain(v) for v in x.tolist()]
    x = x.item() if isinstance(x, np.generic) else x
    return None if isinstance(x, float) and np.isnan(x) else x


def apply_windows(
    df: DataFrame, value: str, radius: int, f: Callable[[np.ndarray], np.ndarray], result: str, targets: DataFrame | None = None, shape: tuple[int, int] | None = None, pad: bool = True, side: int | None = None
) -> DataFrame:
    """(row_no, col_no, result): ``f`` over the square window of 2 ``radius`` + 1 cells around each target.

    ``f`` takes windows as an array (n, size, size), NaN where a cell is absent, and returns n numbers; NaN comes back as null. It gets the targets of one row of a tile at a time. ``targets(row_no, col_no)``
    are the cells of ``df`` if not given; those without any cell in reach get windows of NaN. With ``pad`` windows reach over the edges of a grid of ``shape`` (rows, columns), where all is absent;
    without it targets nearer to an edge than ``radius`` have null.

    Tiles of ``side`` cells (64, and not less than the radius, if not given) exchange their halo once: a cell goes to the tiles whose windows it can lie in, at most nine. A tile is as large as its
    cells, whatever the grid; a tile without a target is left out. Targets that stand there twice come back twice; of several values of one cell the largest counts; cells and targets without row or column
    are passed over.
    """
    side = side or max(64, radius)
    size = 2 * radius + 1
    name, kind = result.split(None, 1)
    to = to_arrow_type(T.StructType.fromDDL(f"r {kind}").fields[0].dataType)
    tile = lambda c, by=0: F.floor((F.col(c) + by) / side)
    there = lambda d: d.filter("row_no IS NOT NULL AND col_no IS NOT NULL")
    wanted = there((df if targets is None else targets).select("row_no", "col_no")).select(tile("row_no").alias("ty"), tile("col_no").alias("tx"), "row_no", "col_no", F.lit(None).cast("double").alias("v"), F.lit(True).alias("wanted"))
    cells = there(df.select("row_no", "col_no", F.col(value).cast("double").alias("v"))).filter("v IS NOT NULL")
    reach = lambda c: F.explode(F.sequence(tile(c, -radius), tile(c, radius)))
    dealt = cells.withColumn("ty", reach("row_no")).withColumn("tx", reach("col_no")).select("ty", "tx", "row_no", "col_no", "v", F.lit(False).alias("wanted"))
    if targets is not None:
        dealt = dealt.join(wanted.select("ty", "tx").distinct(), ["ty", "tx"], "left_semi")

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
        rows, columns, v, is_target = (table[c].to_numpy() for c in ("row_no", "col_no", "v", "wanted"))
        is_target = is_target.astype(bool)
        grid = np.full((side + 2 * radius, side + 2 * radius), np.nan)
        np.fmax.at(grid, (rows[~is_target] - ty * side + radius, columns[~is_target] - tx * side + radius), v[~is_target].astype(float))
        rows, columns = rows[is_target], columns[is_target]
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
        windows, out = np.lib.stride_tricks.sliding_window_view(grid, (size, size)), np.full(len(rows), np.nan)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            if a < b:
                out[a:b] = f(windows[rows[a] - ty * side, columns[a:b] - tx * side])
        if not pad and shape:
            out[(rows < radius) | (rows >= shape[0] - radius) | (columns < radius) | (columns >= shape[1] - radius)] = np.nan
        made = pa.array(out, from_pandas=True)
        return pa.table([pa.array(rows), pa.array(columns), made.cast(to)], ["row_no", "col_no", name])

    inside = dealt
    if shape:
        on_grid = (F.col("row_no") >= 0) & (F.col("row_no") < shape[0]) & (F.col("col_no") >= 0) & (F.col("col_no") < shape[1])
        inside, wanted = dealt.filter(on_grid), wanted.filter(on_grid)
    both = wanted.unionByName(inside).withColumns({c: F.col(c).cast("long") for c in ("ty", "tx", "row_no", "col_no")})
    found = both.groupBy("ty", "tx").applyInArrow(run, f"row_no long, col_no long, `{name}` {kind}")
    return found
