"""Limits of areas, national targets and their allocation to cells by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.columns import pack, unpack
from furrow.session import stored

#: Names of countries in the statistics that differ from the crosswalk's.
COUNTRY_NAMES = {
    "Canada": "CAN", "Croatia": "HRV", "Czechia": "CZE", "Denmark": "DNK", "Ecuador": "ECU", "France": "FRA", "Germany": "DEU", "Hungary": "HUN", "Lithuania": "LTU", "Luxembourg": "LUX",
    "Netherlands (Kingdom of the)": "NLD", "Panama": "PAN", "Poland": "POL", "Portugal": "PRT", "Spain": "ESP", "United States of America": "USA", "Zambia": "ZMB",
}


def limit_area(df: DataFrame, area: str, mode: str = "sanitize", limit: float = 6.25) -> DataFrame:
    """Areas within 0..limit. ``sanitize``: others null; ``div1600``: the same on a 1,600th; ``scale``: a cell's bands shrink to sum to the limit."""
    v = F.col(area)
    if mode == "div1600":
        v = v / 1600
    if mode == "scale":
        total = F.sum(area).over(Window.partitionBy("cell_id"))
        return df.withColumn(area, F.when(total > limit, v * limit / total).otherwise(v))
    return df.withColumn(area, F.when(v.between(0, limit), v))


def latest_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the last non-null value of each column; partial aggregates, no window."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def bridge_codes(stats: DataFrame, m49: DataFrame, country_map: DataFrame, names: dict[str, str] = COUNTRY_NAMES) -> DataFrame:
    """``stats(area, m49, ...)`` with map_id: by name, else by M49 code, to ISO3 and on to the map's code; unmatched rows go."""
    by_name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map()
    iso = stats.withColumn("by_name", by_name[F.col("area")] if names else F.lit(None).cast("string")).join(F.broadcast(m49.select("m49", F.col("iso3").alias("by_code"))), "m49", "left")
    iso = iso.withColumn("iso3", F.upper(F.coalesce("by_name", "by_code"))).drop("by_name", "by_code")
    return iso.join(F.broadcast(country_map.select("iso3", F.col("country_code").alias("map_id"))), "iso3")


def quota_target(potential: DataFrame, reported: DataFrame, fallback: float = 0.1) -> DataFrame:
    """(country_code, target): reported thousands as units; where zero or absent, a share of the potential."""
    joined = potential.join(reported, "country_code", "left")
    return joined.select("country_code", F.coalesce(F.nullif(F.col("value") * 1000, F.lit(0.0)), fallback * F.col("potential")).alias("target"))


def _crossing(cells: DataFrame, targets: DataFrame, group: str, key: str, strict: bool, buckets: int) -> DataFrame:
    """(group, q_target, q_total, q_last, q_cross, q_before): for each group with a target the first key, in falling order, at which the summed area reaches
    (``strict``: exceeds) it, the area before that key, all area, and the last key. q_cross is null where the target is never reached.

    ``cells(group, key, area)``: one row for each group and key. Keys are cut into buckets from the highest down; only the bucket in which the target is crossed is
    ordered row by row, so a group that holds most cells is summed in parallel. What is known of a group is written first, so that Spark
    sees its size and sends it to the cells where it is small.
    """
    span = cells.groupBy(group).agg(F.min(key).alias("q_last"), F.max(key).alias("q_first"), F.sum("area").alias("q_total"))
    span = stored(span.join(targets.select(group, F.col("target").alias("q_target")), group))
    place = F.least(F.floor(F.try_divide(F.col("q_first") - F.col("q_key"), F.col("q_first") - F.col("q_last")) * buckets), F.lit(buckets - 1))
    marked = cells.select(group, F.col(key).alias("q_key"), F.col("area").alias("q_area")).join(span, group).withColumn("q_bucket", F.coalesce(place.cast("long"), F.lit(0).cast("long")))
    over = lambda sum_: sum_ > F.col("q_target") if strict else sum_ >= F.col("q_target")
    sums = marked.groupBy(group, "q_bucket").agg(F.sum("q_area").alias("q_size"), F.first("q_target").alias("q_target"))
    cum = sums.withColumn("q_cum", F.sum("q_size").over(Window.partitionBy(group).orderBy("q_bucket")))
    crossed = stored(cum.filter(over(F.col("q_cum"))).groupBy(group).agg(F.min("q_bucket").alias("q_bucket"), F.min_by(F.col("q_cum") - F.col("q_size"), "q_bucket").alias("q_start")))
    inside = marked.join(crossed, [group, "q_bucket"])
    row_cum = F.col("q_start") + F.sum("q_area").over(Window.partitionBy(group).orderBy(F.desc("q_key")))
    first = inside.withColumn("q_cum", row_cum).filter(over(F.col("q_cum"))).groupBy(group).agg(F.max("q_key").alias("q_cross"), F.max_by(F.col("q_cum") - F.col("q_area"), "q_key").alias("q_before"))
    return stored(span.select(group, "q_target", "q_total", "q_last").join(first, group, "left"))


def quota_cutoff(cells: DataFrame, targets: DataFrame, group: str = "country_code", buckets: int = 1000) -> DataFrame:
    """(group, cutoff): the highest score at which the area of cells with at least this score reaches the target; if never, the lowest score.

    ``cells(group, score, area)``, ``targets(group, target)``. Ties share a cumulative sum, so the cutoff is unique. Rows without group or score are passed over, a null
    area counts as 0, groups without a target have no row, an empty table gives an empty result; other columns are ignored.
    """
    rows = cells.select(F.col(group).alias("g"), "score", "area").filter("score IS NOT NULL AND g IS NOT NULL")
    summed = stored(rows.groupBy("g", "score").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area")))
    found = _crossing(summed, targets.select(F.col(group).alias("g"), "target"), "g", "score", False, buckets)
    return found.select(F.col("g").alias(group), F.coalesce("q_cross", "q_last").alias("cutoff"))


def quota_allocate(cells: DataFrame, cutoffs: DataFrame, group: str = "country_code") -> DataFrame:
    """``cells`` with allocated: the area of winners, 0 for others, null where the area is. A column called allocated is replaced; all others come back, whatever they are called."""
    joined = pack(cells, g=group, score="score", area="area").join(cutoffs.select(F.col(group).alias("c_g"), "cutoff"), F.col("g") == F.col("c_g"), "left")
    wins = F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False))
    return unpack(joined, cells.columns, allocated=F.when(F.col("area").isNotNull(), F.when(wins, F.col("area")).otherwise(0.0)))


def quota_allocate_nearest(cells: DataFrame, targets: DataFrame, group: str = "country_code", tie: str = "take", buckets: int = 1000) -> DataFrame:
    """``cells(cell_id, group, score, area)`` with wins: cells by falling score, then cell_id, while the sum stays within the target, and one more unless stopping
    short is closer (at equal distance as ``tie`` says); groups below their target win every cell with area.

    Every row of ``cells`` comes back; those without score, area or group, and those of groups without a target, don't win. Scores are summed first; only the cells
    that share the score at which the target is crossed are told apart by cell_id, again by ranges whose areas are summed first. A column called wins is replaced; all others come back, whatever they are called.
    """
    own = pack(cells, g=group, score="score", area="area", cell="cell_id")
    rows = own.drop("own").filter("score IS NOT NULL AND area IS NOT NULL AND g IS NOT NULL")
    summed = stored(rows.groupBy("g", "score").agg(F.sum("area").alias("area")))
    by_score = _crossing(summed, targets.select(F.col(group).alias("g"), "target"), "g", "score", True, buckets)
    tied = rows.join(by_score.select("g", F.col("q_cross").alias("score"), "q_before", "q_target"), ["g", "score"]).select("g", (-F.col("cell")).alias("q_key"), "area", "q_before", "q_target")
    left = tied.groupBy("g").agg((F.first("q_target") - F.first("q_before")).alias("target"))
    by_id = _crossing(tied.groupBy("g", "q_key").agg(F.sum("area").alias("area")), left, "g", "q_key", True, buckets)
    # The first cell above the target: what stands before it is within, so it can be the one more.
    last = by_id.join(tied.select("g", F.col("q_key").alias("q_cross"), "area"), ["g", "q_cross"]).groupBy("g", "q_cross").agg(F.first("q_target").alias("q_target"), F.first("q_before").alias("q_before"), F.sum("area").alias("q_area"))
    short, long = F.col("q_target") - F.col("q_before"), F.abs(F.col("q_before") + F.col("q_area") - F.col("q_target"))
    last = stored(last.select("g", (-F.col("q_cross")).alias("q_cell"), ((short > long) if tie == "skip" else (short >= long)).alias("q_more")))
    known = stored(by_score.join(last, "g", "left").select("g", "q_target", "q_total", "q_cross", "q_cell", "q_more"))
    ahead = (F.col("score") > F.col("q_cross")) | (F.col("score") == F.col("q_cross")) & ((F.col("cell") < F.col("q_cell")) | (F.col("cell") == F.col("q_cell")) & F.col("q_more"))
    wins = F.when(F.col("score").isNotNull(), F.when(F.col("q_total") <= F.col("q_target"), F.col("area") > 0).otherwise(F.col("area").isNotNull() & ahead))
    return unpack(own.join(known, "g", "left"), cells.columns, wins=F.coalesce(wins, F.lit(False)))


def scenario_blend(potential, allocated, share: float = 0.5):
    """The allocated area and ``share`` of the potential that is left."""
    return F.coalesce(allocated, F.lit(0.0)) + share * F.greatest(F.coalesce(potential, F.lit(0.0)) - F.coalesce(allocated, F.lit(0.0)), F.lit(0.0))


def scenario_suitable(potential: DataFrame, reduced: DataFrame, cells: DataFrame, groups: DataFrame, field_threshold: float = 2.5) -> DataFrame:
    """(cell_id, crop, scenario): the potential plus suitable reduced area on high-income cells, or on large fields elsewhere."""
    suits = reduced.join(F.broadcast(groups.filter("ca_suitable").select("crop")), "crop", "left_semi").join(cells.select("cell_id", "field", "high"), "cell_id")
    suits = suits.filter(F.col("high").isNotNull() | (F.col("field") >= field_threshold)).select("cell_id", "crop", F.col("reduced").alias("extra"))
    both = potential.select("cell_id", "crop", "potential").join(suits, ["cell_id", "crop"], "full_outer")
    return both.select("cell_id", "crop", (F.coalesce("potential", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("scenario"))


def potential_area(grains: DataFrame, scores: DataFrame, weight_by_score: bool = False) -> DataFrame:
    """(cell_id, crop, potential): eligible area where a score exists, 0 as null; times the score if asked."""
    joined = grains.join(scores.filter("score IS NOT NULL").select("cell_id", "score"), "cell_id")
    area = F.nullif(F.col("grain"), F.lit(0.0))
    return joined.select("cell_id", "crop", (area * F.col("score") if weight_by_score else area).alias("potential"))


def allocation_share(df: DataFrame) -> DataFrame:
    """By crop the potential, the allocated area and its share in percent."""
    out = df.groupBy("crop").agg(F.sum("potential").alias("potential"), F.sum("allocated").alias("allocated"))
    return out.withColumn("share", F.round(F.try_divide("allocated", "potential"), 2) * 100)


def allocation_by_country(allocated: DataFrame, targets: DataFrame, group: str = "country_code") -> DataFrame:
    """Allocated against reported area of every country with a target."""
    return targets.join(allocated.groupBy(group).agg(F.sum("allocated").alias("allocated")), group, "left").select(group, "target", F.coalesce("allocated", F.lit(0.0)).alias("allocated"))
