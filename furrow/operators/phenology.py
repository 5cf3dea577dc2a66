"""Clusters of pixels, their time series, peaks, bare periods and the tillage window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ranges import exact_percentiles
from furrow.session import stored


def equal_width_clusters(df: DataFrame, value: str, n: int = 15) -> DataFrame:
    """K1: ``df`` with cluster: the equal-width bin of the value, 0 where all values are the same."""
    span = df.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))  # one row
    place = F.when(F.col("hi_") > F.col("lo_"), F.greatest(F.lit(0), F.least(F.floor((F.col(value) - F.col("lo_")) / ((F.col("hi_") - F.col("lo_")) / n)), F.lit(n - 1)))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumn("cluster", place.cast("long")).drop("lo_", "hi_")


def cluster_sizes(df: DataFrame) -> DataFrame:
    """K2: pixels of each cluster."""
    return df.groupBy("cluster").agg(F.count("*").alias("pixels"))


def cluster_timeseries(composites: DataFrame, clusters: DataFrame, value: str = "mean", pixel: str = "pixel_id") -> DataFrame:
    """K3: (cluster, bin, mean, std, p05, p25, p75, p95, n) over the pixels of each cluster and bin; the percentiles are exact and sought by ranges, so no cluster is one buffer.

    A cluster and bin without any value has nulls; a null bin is one of its own.
    """
    joined = composites.join(clusters.select(pixel, "cluster"), pixel).select("cluster", "bin", F.col(value).alias("k_value"))
    means = joined.groupBy("cluster", "bin").agg(F.avg("k_value").alias("mean"), F.stddev_pop("k_value").alias("std"), F.count("*").alias("n"))
    shares = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    found = exact_percentiles(joined, ["cluster", "bin"], "k_value", shares).withColumnsRenamed({"cluster": "k_cluster", "bin": "k_bin"})
    out = means.join(found, F.col("cluster").eqNullSafe(F.col("k_cluster")) & F.col("bin").eqNullSafe(F.col("k_bin")), "left")
    return out.select("cluster", "bin", "mean", "std", *shares, "n")


def detect_peaks(series: DataFrame, prominence: float = 0.1, distance: int = 30, by: str = "cluster", at: str = "doy", value: str = "mean") -> DataFrame:
    """K4: (by, at, value, prominence) of peaks. Interior maxima (a plateau by its middle) are thinned to ``distance`` samples, the higher first, and
    then held against the prominence, the height above the higher of the two lowest points on the way to a higher sample.

    A series has one row for each cluster and composite, so a group is as short as the year.
    """

    def peaks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[value]).sort_values(at, kind="stable")
        x = frame[value].to_numpy(np.float64)
        turns = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)  # where runs of equal samples begin
        ends = np.append(turns[1:], len(x)) - 1
        runs = [k for k in range(1, len(turns) - 1) if x[turns[k]] > x[turns[k - 1]] and x[turns[k]] > x[turns[k + 1]]]
        tops = [int(turns[k] + ends[k]) // 2 for k in runs]
        kept: list[int] = []
        for t in sorted(tops, key=lambda t: (-x[t], -t)):
            if all(abs(t - o) >= distance for o in kept):
                kept.append(t)
        rows = []
        for t in sorted(kept):
            higher_left, higher_right = np.flatnonzero(x[:t] > x[t]), np.flatnonzero(x[t + 1 :] > x[t])
            a = higher_left[-1] if len(higher_left) else 0
            b = t + 1 + higher_right[0] if len(higher_right) else len(x) - 1
            height = x[t] - max(x[a : t + 1].min(), x[t : b + 1].min())
            if height >= prominence:
                rows.append((frame[by].iat[0], float(frame[at].iat[t]), x[t], height))
        return pd.DataFrame(rows, columns=[by, at, value, "prominence"])

    kind = series.schema[by].dataType.simpleString()
    return series.select(by, F.col(at).cast("double").alias(at), value).groupBy(by).applyInPandas(peaks, f"`{by}` {kind}, `{at}` double, `{value}` double, prominence double")


def low_periods(series: DataFrame, threshold: float, min_duration: float, by: str = "cluster", at: str = "doy", value: str = "mean") -> DataFrame:
    """K5: (by, start, end): runs of samples under the threshold that last long enough; gaps and islands."""
    order = Window.partitionBy(by).orderBy(at)
    rows = series.filter(F.col(value).isNotNull()).withColumn("low", (F.col(value) < threshold).cast("int"))
    change = (F.col("low") != F.coalesce(F.lag("low").over(order), F.lit(-1))).cast("int")
    runs = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.filter("low = 1").groupBy(by, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    return out.filter(F.col("end") - F.col("start") >= min_duration).select(by, "start", "end")


def seasonality(n_peaks):
    """K6: a name for the number of peaks."""
    return F.when(n_peaks == 0, "no pattern").when(n_peaks == 1, "annual").when(n_peaks == 2, "biannual").otherwise("multiple")


def is_seasonal(series: DataFrame, by: str = "cluster", at: str = "doy", value: str = "mean", least_range: float = 0.10, most_peaks: int = 4, prominence: float = 0.1) -> DataFrame:
    """K7: (by, points, value_range, peaks, seasonal): at least three points, a range and no more than so many peaks."""
    stats = series.groupBy(by).agg(F.count(value).alias("points"), (F.max(value) - F.min(value)).alias("value_range"))
    tops = detect_peaks(series, prominence, 1, by, at, value).groupBy(by).agg(F.count("*").alias("peaks"))
    out = stats.join(tops, by, "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))
    return out.withColumn("seasonal", F.coalesce((F.col("points") >= 3) & (F.col("value_range") >= least_range) & (F.col("peaks") <= most_peaks), F.lit(False)))


def filter_clusters(clusters: DataFrame, small: int = 10_000, doubtful: int = 30_000) -> DataFrame:
    """K8: ``clusters(cluster, pixels, pattern, seasonal)`` with the reason why each is removed (null: kept) and the share of all pixels removed so."""
    reason = F.when(F.col("pixels") < small, "too small").when(F.col("pattern") == "no pattern", "no pattern").when((F.col("pixels") < doubtful) & ~F.col("seasonal"), "not seasonal")
    marked = clusters.withColumn("reason", reason)
    share = marked.agg(F.try_divide(100.0 * F.sum(F.when(F.col("reason").isNotNull(), F.col("pixels")).otherwise(0)), F.sum("pixels")).alias("removed_percent"))
    return marked.crossJoin(F.broadcast(share))  # against one row


def tillage_window(series: DataFrame, sizes: DataFrame, threshold: float = 0.35, min_duration: float = 15, share: float = 0.05, least_width: float = 20, near: float = 15) -> DataFrame:
    """K9: the one window (start, end, score, avg_duration, cluster_count, pixel_weight, clusters) in which most large clusters lie bare.

    Periods are rounded to ten days and vote with width x summed weight x count; the earliest found of equals.
    """
    total = sizes.agg(F.sum("pixels").alias("all_pixels"))
    large = sizes.crossJoin(F.broadcast(total)).filter(F.col("pixels") > share * F.col("all_pixels")).select("cluster", (F.col("pixels") / F.col("all_pixels")).alias("weight"))
    periods = low_periods(series, threshold, min_duration).join(F.broadcast(large), "cluster")
    ten = lambda c: F.bround(F.col(c) / 10) * 10
    votes = periods.withColumn("s", ten("start")).withColumn("e", ten("end")).groupBy("s", "e").agg(F.count("*").alias("cluster_count"), F.sum("weight").alias("pixel_weight"), F.avg(F.col("end") - F.col("start")).alias("avg_duration"), F.min(F.struct("cluster", "start")).alias("first_"))
    scored = votes.withColumn("score", (F.col("e") - F.col("s")) * F.col("pixel_weight") * F.col("cluster_count")).filter((F.col("e") - F.col("s") > least_width) & (F.col("score") > 0))
    best = scored.orderBy(F.desc("score"), "first_").limit(1)
    members = periods.crossJoin(F.broadcast(best.select("s", "e"))).filter((F.abs(F.col("start") - F.col("s")) < near) & (F.abs(F.col("end") - F.col("e")) < near))  # against one row
    joined = members.agg(F.array_join(F.array_sort(F.collect_set("cluster")), ",").alias("clusters"))
    return best.crossJoin(joined).select(F.col("s").alias("start"), F.col("e").alias("end"), "score", "avg_duration", "cluster_count", "pixel_weight", "clusters")


def pattern_counts(kept: DataFrame) -> DataFrame:
    """Clusters that are kept, by pattern."""
    return kept.filter("reason IS NULL").groupBy("pattern").agg(F.count("*").alias("clusters"))


def arable_tiles(cover: DataFrame, least: float = 1.0, code: int = 40) -> DataFrame:
    """(tile_id, percent) of tiles with more than ``least`` percent cropland."""
    return cover.groupBy("tile_id").agg((100 * F.avg((F.col("cover") == code).cast("int"))).alias("percent")).filter(F.col("percent") > least)


def tile_grid(spark, size: int = 5, south: int = -55, north: int = 70) -> DataFrame:
    """The tiles of the globe between two latitudes."""
    nx, ny = 360 // size, (north - south) // size
    t = spark.range(nx * ny)
    return t.select((F.col("id") % nx * size - 180).alias("xmin"), (F.floor(F.col("id") / nx) * size + south).alias("ymin"))


def kmeans_1d(df: DataFrame, value: str, k: int, by: str, rounds: int | None = None) -> DataFrame:
    """``df`` with cluster: Lloyd's rounds on one value for all groups at once, from quantiles as first centres, until no centre moves (or for ``rounds``).

    Rounds work on the distinct values of a group and their counts. Centres are an array of ``k`` numbers for each group; a round is one group-by of
    partial sums, and only groups whose centres have moved go on. Rows without a value are left out; of equally near centres the first counts.
    """
    points = df.filter(F.col(value).isNotNull())
    weighed = stored(points.groupBy(by, F.col(value).alias("k_value")).agg(F.count("*").alias("k_n")), "values")
    quantiles = ", ".join(str((j + 0.5) / k) for j in range(k))
    centres = stored(weighed.groupBy(by).agg(F.expr(f"percentile(k_value, array({quantiles}), k_n)").alias("k_centres"), F.lit(True).alias("k_open")), "centres")
    nearest = lambda v: F.array_min(F.transform("k_centres", lambda c, j: F.struct(F.abs(v - c).alias("d"), j.alias("j"))))["j"]
    done = 0
    while (rounds is None or done < rounds) and not centres.filter("k_open").isEmpty():
        mean = F.sum(F.col("k_value") * F.col("k_n")) / F.sum("k_n")
        sums = weighed.join(centres.filter("k_open"), by).groupBy(by, nearest(F.col("k_value")).alias("j")).agg(mean.alias("c"))
        moved = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("j", "c"))).alias("m"))  # k entries for each group
        new = F.when(F.col("m").isNotNull(), F.transform("k_centres", lambda c, j: F.coalesce(F.col("m")[j], c))).otherwise(F.col("k_centres"))
        # Sums in another order differ in their last digits, which is no move.
        moves = F.exists(F.zip_with(new, "k_centres", lambda a, b: F.abs(a - b) > 1e-9 * F.greatest(F.abs(b), F.lit(1.0))), lambda x: x)
        # A row for each group: written each round, so that plans don't grow with the rounds.
        centres = stored(centres.join(moved, by, "left").select(by, new.alias("k_centres"), moves.alias("k_open")), "centres")
        done += 1
    return points.join(centres, by).withColumn("cluster", nearest(F.col(value)).cast("long")).drop("k_centres", "k_open")


def two_pass_kmeans(df: DataFrame, value: str, tile: str = "tile_id", k1: int = 12, k2: int = 4, drop: float = 0.03, least1: int = 100, least2: int = 10, rounds: int | None = None) -> DataFrame:
    """Per tile k-means with ``k1`` clusters, without those of at most ``drop`` of the tile's rows, then again with ``k2``; tiles with too few rows or kept clusters go."""
    enough = df.filter(F.col(value).isNotNull()).groupBy(tile).agg(F.count("*").alias("rows_")).filter(F.col("rows_") >= least1)
    first = kmeans_1d(df.join(enough, tile), value, k1, tile, rounds).withColumnRenamed("cluster", "first_cluster")
    kept = first.groupBy(tile, "first_cluster", "rows_").agg(F.count("*").alias("n")).filter(F.col("n") > drop * F.col("rows_"))
    tiles = kept.groupBy(tile).agg(F.count("*").alias("kept_"), F.sum("n").alias("left_")).filter((F.col("kept_") >= 2) & (F.col("left_") >= least2)).select(tile)
    rest = first.join(kept.select(tile, "first_cluster"), [tile, "first_cluster"], "left_semi").join(tiles, tile, "left_semi").drop("rows_")
    return kmeans_1d(stored(rest, "kept-rows"), value, k2, tile, rounds)
