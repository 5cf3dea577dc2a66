"""Checks of mass, coverage, classes and value ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.ranges import exact_percentiles


def mass_check(coarse: DataFrame, fine: DataFrame, crop: str, inside, area: str = "area", factor: float = 1600) -> DataFrame:
    """Coarse area by ``factor`` against fine area of one crop inside a window: sums, difference, percent and the largest cell."""
    pick = lambda df: df.filter(inside & (F.col("crop") == crop))
    a = pick(coarse).agg((F.coalesce(F.sum(area), F.lit(0.0)) / factor).alias("coarse_sum"))
    b = pick(fine).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("fine_sum"), F.max(area).alias("fine_max"))
    both = a.crossJoin(b)  # one row each
    gap = F.col("fine_sum") - F.col("coarse_sum")
    return both.select("coarse_sum", "fine_sum", gap.alias("difference"), (100 * gap / F.greatest("coarse_sum", F.lit(1.0))).alias("percent"), "fine_max")


def class_balance(classes: DataFrame, names: list[str], by: str = "country_code", area: str = "area") -> DataFrame:
    """The sum of the classes less the total area of each group."""
    parts = sum((F.coalesce(F.sum(n), F.lit(0.0)) for n in names), F.lit(0.0))
    return classes.groupBy(by).agg(parts.alias("classes"), F.coalesce(F.sum(area), F.lit(0.0)).alias("total")).withColumn("balance", F.col("classes") - F.col("total"))


def max_cell_area(df: DataFrame, area: str, limit: float = 6.25) -> DataFrame:
    """D3: the largest summed area of a cell, and how many cells are over the limit."""
    cells = df.groupBy("cell_id").agg(F.sum(area).alias("a"))
    return cells.agg(F.max("a").alias("largest"), F.count_if(F.col("a") > limit).alias("over"), (F.coalesce(F.max("a"), F.lit(0.0)) <= limit).alias("ok"))


def coverage(df: DataFrame, area: str, total_cells: int) -> DataFrame:
    """Cells of the grid, those with area, those without, and percent covered."""
    cells = df.groupBy("cell_id").agg(F.sum(area).alias("a"))
    valid = F.count_if(F.col("a") > 0)
    total = F.lit(total_cells).cast("long")
    return cells.agg(total.alias("total_cells"), valid.alias("valid_cells"), (total - valid).alias("empty_cells"), (100 * valid / F.nullif(total, F.lit(0))).alias("percent"))


def category_counts(coded: DataFrame, codes: list[int]) -> DataFrame:
    """For each crop the number of cells of each code, and of all."""
    counts = coded.filter(F.col("code").isNotNull()).groupBy("crop").pivot("code", codes).agg(F.count(F.lit(1))).na.fill(0)
    named = counts.select("crop", *[F.col(str(c)).alias(f"code_{c}") for c in codes])
    return named.withColumn("all_codes", sum((F.col(f"code_{c}") for c in codes), F.lit(0)))


def value_profile(df: DataFrame, column: str) -> DataFrame:
    """Smallest, largest and mean value, the number above 0 and of distinct values."""
    v = F.col(column)
    return df.agg(F.min(v).alias("smallest"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.count_if(v > 0).alias("positive"), F.countDistinct(v).alias("distinct_values"))


def first_data_cell(df: DataFrame, value: str, row: str = "row_no", col: str = "col_no") -> DataFrame:
    """The first row and column that hold data."""
    return df.filter(F.col(value) > 0).agg(F.min(row).alias("first_row"), F.min(col).alias("first_col"))


def histogram_auto(df: DataFrame, column: str, least: int = 10, most: int = 50) -> DataFrame:
    """(bin, lower, upper, n) with Sturges' number of bins between ``least`` and ``most``; the last bin is closed."""
    rows = df.filter(F.col(column).isNotNull())
    one = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("all_rows"))
    one = one.withColumn("bins", F.least(F.greatest(F.ceil(F.log2(F.col("all_rows")) + 1), F.lit(least)), F.lit(most))).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    place = F.when(F.col("width") > 0, F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.col("bins") - 1)).otherwise(0)
    counted = rows.crossJoin(F.broadcast(one)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"))  # against one row
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"), "n")


def value_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, exact median and sample standard deviation beside the histogram; the median is sought by ranges, so the table is never one buffer."""
    one = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    return one.crossJoin(exact_percentiles(df, [], column, {"median": 0.5})).select("mean", "median", "std")  # one row against one row


def label_proportions(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, total, percent, weight): soft labels summed, their share and 100 / (number of labels x share)."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in labels])
    total = sum((F.col(c) for c in labels), F.lit(0.0))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("total"), F.try_divide(100 * F.col(c), total).alias("percent")) for c in labels]))
    return sums.select(rows.alias("r")).select("r.*").withColumn("weight", F.try_divide(F.lit(100.0), len(labels) * F.col("percent")))


def grid_cells_by_rule(df: DataFrame, area: str, threshold: float) -> DataFrame:
    """Area on small fields outside high income, and on large fields."""
    return df.agg(
        F.coalesce(F.sum(F.when((F.col("field") < threshold) & F.col("high").isNull(), F.col(area))), F.lit(0.0)).alias("small_low_income"),
        F.coalesce(F.sum(F.when(F.col("field") >= threshold, F.col(area))), F.lit(0.0)).alias("large"),
    )
