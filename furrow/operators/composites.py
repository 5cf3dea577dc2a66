"""Composites over time, seasonal statistics, histograms and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.ranges import exact_percentiles
from furrow.operators.scenes import to_mjd


def temporal_composite(obs: DataFrame, start, days: int = 30, value: str = "value", pixel: str = "pixel_id", ts: str = "ts") -> DataFrame:
    """(pixel, bin, mean, mjd): means of each pixel in bins of days; mjd is the mean over the bin's scenes. Empty bins have no row."""
    binned = obs.withColumn("bin", F.floor(F.datediff(ts, F.lit(start).cast("date")) / days)).filter("bin >= 0")
    days_of = binned.select("bin", ts).distinct().groupBy("bin").agg(F.avg(to_mjd(F.col(ts))).alias("mjd"))
    means = binned.groupBy(pixel, "bin").agg(F.avg(value).alias("mean"))
    return means.join(F.broadcast(days_of), "bin")  # a row for each bin of the period


def mean_composite(obs: DataFrame, value: str, pixel: str = "pixel_id") -> DataFrame:
    """The mean over time."""
    return obs.groupBy(pixel).agg(F.avg(value).alias("mean"))


def median_composite(obs: DataFrame, value: str, pixel: str = "pixel_id") -> DataFrame:
    """The exact median over time, however many observations a pixel has; null for pixels without a value."""
    found = exact_percentiles(obs, [pixel], value, {"median": 0.5})
    bare = obs.groupBy(pixel).agg(F.count(value).alias("n")).filter("n = 0").select(pixel, F.lit(None).cast("double").alias("median"))
    return found.unionByName(bare)


def quality_mosaic(obs: DataFrame, order: str, pixel: str = "pixel_id", ts: str = "ts", highest: bool = True, scene: str = "event_id") -> DataFrame:
    """The whole observation of each pixel with the highest (or lowest) value; the earliest, then smallest, of equals."""
    columns = [c for c in obs.columns if c != pixel]
    key = F.struct((-F.col(order) if highest else F.col(order)).alias("o"), F.col(ts).alias("t"), F.col(scene).alias("s"))
    rows = obs.filter(F.col(order).isNotNull())
    return rows.groupBy(pixel).agg(F.min_by(F.struct(*columns), key).alias("o")).select(pixel, "o.*")


def barest_observation(obs: DataFrame, ndvi: str, ndti: str, most: float = 0.35, **how) -> DataFrame:
    """The observation with the lowest NDVI of those under ``most`` that have an NDTI."""
    return quality_mosaic(obs.filter((F.col(ndvi) < most) & F.col(ndti).isNotNull()), ndvi, highest=False, **how)


def barest_date(points: DataFrame, obs: DataFrame, point: str, scene: str, ndvi: str, ts: str, least: float = 0.05, fallback: str = "2023-05-15") -> DataFrame:
    """(point, barest_date): the day of the scene whose mean NDVI around the point is lowest above ``least``; else the fallback."""
    means = obs.groupBy(point, scene).agg(F.avg(ndvi).alias("m"), F.min(ts).alias("t")).filter(F.col("m") > least)
    best = means.groupBy(point).agg(F.min_by("t", F.struct("m", scene)).alias("t"))
    return points.select(point).join(best, point, "left").select(point, F.coalesce(F.to_date("t"), F.lit(fallback).cast("date")).alias("barest_date"))


def phenology_metrics(obs: DataFrame, value: str, pixel: str = "pixel_id", ts: str = "ts", scene: str = "event_id") -> DataFrame:
    """(pixel, peak_time, min_time, mean_time, mean_value): MJD of the highest and lowest value, mean MJD (of whole microseconds, so exact) and mean value."""
    mjd = to_mjd(F.col(ts))
    return obs.groupBy(pixel).agg(
        F.min_by(mjd, F.struct(-F.col(value), F.col(ts), F.col(scene))).alias("peak_time"), F.min_by(mjd, F.struct(F.col(value), F.col(ts), F.col(scene))).alias("min_time"), (F.avg(F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000 + 40_587).alias("mean_time"), F.avg(value).alias("mean_value"),
    )


def season_of(ts):
    """Spring, summer, autumn, or winter, which crosses the year."""
    m = F.month(ts)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def seasonal_stats(obs: DataFrame, season, value: str, pixel: str = "pixel_id", scene: str = "scene_id") -> DataFrame:
    """By season the mean, least, largest and population deviation over pixels of their means over time, and the number of scenes."""
    rows = obs.withColumn("season", season)
    means = rows.groupBy("season", pixel).agg(F.avg(value).alias("m")).groupBy("season").agg(F.avg("m").alias("mean"), F.min("m").alias("least"), F.max("m").alias("largest"), F.stddev_pop("m").alias("std"))
    return means.join(rows.groupBy("season").agg(F.countDistinct(scene).alias("scenes")), "season")


def region_comparison(stats: DataFrame, first: str = "spring", second: str = "autumn") -> DataFrame:
    """(region, first, second, difference) of seasonal means; missing seasons as 0."""
    pick = lambda s: F.coalesce(F.avg(F.when(F.col("season") == s, F.col("mean"))), F.lit(0.0))
    return stats.groupBy("region").agg(pick(first).alias(first), pick(second).alias(second)).withColumn("difference", F.abs(F.col(first) - F.col(second)))


def extrema_stats(obs: DataFrame, value: str, by: list[str], pixel: str = "pixel_id") -> DataFrame:
    """Means over pixels of their mean, least and largest value over time, and the deviation of the means."""
    per = obs.groupBy(*by, pixel).agg(F.avg(value).alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.avg("lo").alias("mean_min"), F.avg("hi").alias("mean_max"), F.stddev_pop("m").alias("std"), F.count("*").alias("pixels"))


def fixed_histogram(df: DataFrame, value: str, lo: float, hi: float, n: int) -> DataFrame:
    """(bin, lower, n) of equal bins over lo..hi; values outside are dropped, empty bins are 0."""
    width = (hi - lo) / n
    counted = df.filter((F.col(value) >= lo) & (F.col(value) < hi)).groupBy(F.floor((F.col(value) - lo) / width).alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(n).select(F.col("id").alias("bin"))
    return bins.join(F.broadcast(counted), "bin", "left").select("bin", (lo + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def _edge_table(df: DataFrame, edges: list[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "class long, lo double, hi double")


def edge_index(value, edges: list[float], closed: bool = False):
    """The interval [lo, hi) of a value as a column without a join; ``closed``: the last interval takes its upper edge too."""
    last = len(edges) - 2
    out = F.when(value == edges[-1], last) if closed else F.lit(None).cast("int")
    for k in range(last, -1, -1):
        out = F.when((value >= edges[k]) & (value < edges[k + 1]), k).otherwise(out)
    return out.cast("long")


def rebin(histogram: DataFrame, edges: list[float], start: str = "lower", n: str = "n") -> DataFrame:
    """A fine histogram in coarse intervals, each fine bin by its start; empty intervals are 0."""
    sums = histogram.withColumn("class", edge_index(F.col(start), edges)).filter("class IS NOT NULL").groupBy("class").agg(F.sum(n).alias("n"))
    return _edge_table(histogram, edges).join(sums, "class", "left").select("class", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def truth_histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Raw values in intervals, the last one closed."""
    counts = df.withColumn("class", edge_index(F.col(value), edges, closed=True)).filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))
    return _edge_table(df, edges).join(counts, "class", "left").select("class", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def compare_stats(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Two one-row frames side by side with absolute differences, a row for each statistic."""
    both = a.select(*[F.col(c).alias(f"a_{c}") for c in columns]).crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in columns]))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"a_{c}").alias("first"), F.col(f"b_{c}").alias("second"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("difference")) for c in columns]))
    return both.select(rows.alias("r")).select("r.*")


def combine_regions(stats: DataFrame) -> DataFrame:
    """Regions as one: mean of means, least of least, largest of largest, mean deviation, summed images, number of regions."""
    return stats.agg(F.avg("mean").alias("mean"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.avg("std").alias("std"), F.sum("images").alias("images"), F.count("*").alias("regions"))


def sum_histograms(histograms: DataFrame) -> DataFrame:
    """Histograms of regions added by bin."""
    return histograms.groupBy("bin").agg(F.sum("n").alias("n"))


def class_breaks(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``df`` with the interval of its value, null outside all."""
    return df.withColumn("class", edge_index(F.col(value), edges))


def grid_sample(df: DataFrame, ny: int, nx: int, most: int = 4900, value: str = "value") -> DataFrame:
    """A regular grid of at most ``most`` places over ny x nx cells, aspect kept, with the value of the cell at each."""
    shrink = max(1.0, (ny * nx / most) ** 0.5)
    rows, cols = max(1, int(ny / shrink)), max(1, int(nx / shrink))
    grid = df.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    at = grid.select("i", "j", F.floor((F.col("i") + 0.5) * ny / rows).alias("row_no"), F.floor((F.col("j") + 0.5) * nx / cols).alias("col_no"))
    return at.join(df.select("row_no", "col_no", value), ["row_no", "col_no"], "left")
