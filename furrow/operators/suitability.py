"""Crop groups, crop mix and the suitability score of conservation agriculture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.ranges import running_sums
from furrow.session import stored

# Crop codes by group.
ANNUAL_CA = "WHEA MAIZ BARL REST TOBA COTT VEGE GROU SESA RAPE SUNF SOYB OPUL LENT PIGE COWP CHIC BEAN OCER SORG SMIL PMIL".split()
TUBER_RICE = "RICE SUGB ORTS CASS YAMS SWPO POTA".split()
PERENNIAL = "OOIL TEAS COCO RCOF COFF OFIB SUGC OILP TEMF TROF PLNT BANA CNUT".split()
#: Other spellings of codes.
ALIASES = {"ACOF": "COFF", "OTRS": "ORTS"}

# Slopes and midpoints of the logit score.
SLOPES = {"field": 1 / 4, "erosion": 1 / 60, "aridity": -5.0, "crop_mix": 10.0}
MIDPOINTS = {"field": 20.0, "erosion": 12.0, "aridity": 0.65, "crop_mix": 0.5}


def crop_groups(spark: SparkSession) -> DataFrame:
    """(crop, annual, ca_suitable, tuber_rice) for the 42 crops."""
    rows = [(c, True, True, False) for c in ANNUAL_CA] + [(c, True, False, True) for c in TUBER_RICE] + [(c, False, False, False) for c in PERENNIAL]
    return spark.createDataFrame(rows, "crop string, annual boolean, ca_suitable boolean, tuber_rice boolean")


def canonical_crop(crop):
    """The crop's code in its main spelling."""
    upper = F.upper(crop)
    for other, code in ALIASES.items():
        upper = F.when(upper == other, code).otherwise(upper)
    return upper


def eligible_area(cell_crop: DataFrame, cells: DataFrame, groups: DataFrame, mode: str = "all", area: str = "ta", field_threshold: float = 2.5, exclude_flat: bool = False) -> DataFrame:
    """(cell_id, crop, grain): area of suitable annual crops that may be farmed conservatively.

    ``all``: everywhere. ``large_or_high_income``: large fields, or small ones where ``high`` is set.
    """
    suitable = cell_crop.join(F.broadcast(groups.filter("ca_suitable").select("crop")), "crop", "left_semi")
    joined = suitable.join(cells.select("cell_id", "field", "depth", "high"), "cell_id")
    if mode == "large_or_high_income":
        joined = joined.filter((F.col("field") >= field_threshold) | ((F.col("field") < field_threshold) & F.col("high").isNotNull()))
    if exclude_flat:
        joined = joined.filter(F.coalesce(F.col("depth") >= 15, F.lit(True)))
    return joined.select("cell_id", "crop", F.col(area).alias("grain"))


def crop_mix(cell_crop: DataFrame, grains: DataFrame, divisor: str = "ta", least: float = 1e-6, most: float = 1.5) -> DataFrame:
    """(cell_id, crop_mix): grain area by total area; null for tiny totals and for ratios above ``most``."""
    total = cell_crop.groupBy("cell_id").agg(F.coalesce(F.sum(divisor), F.lit(0.0)).alias("total"))
    grain = grains.groupBy("cell_id").agg(F.coalesce(F.sum("grain"), F.lit(0.0)).alias("grain"))
    ratio = F.try_divide(F.when(F.col("g") < least, 0.0).otherwise(F.col("g")), F.when(F.col("total") >= least, F.col("total")))
    out = total.join(grain, "cell_id", "left").withColumn("g", F.coalesce("grain", F.lit(0.0))).select("cell_id", ratio.alias("ratio"))
    return out.select("cell_id", F.when(F.col("ratio") <= most, F.col("ratio")).alias("crop_mix"))


def logit_score(slopes: dict[str, float] = SLOPES, midpoints: dict[str, float] = MIDPOINTS):
    """T4: the score as a column over field, erosion, aridity and crop_mix; null where crop_mix is."""
    z = sum((F.lit(k) * (F.col(name) - midpoints[name]) for name, k in slopes.items()), F.lit(0.0))
    return F.when(F.col("crop_mix").isNotNull(), 1 / (1 + F.exp(-z)))


def sensitivity_scenarios() -> list[tuple[str, dict[str, float]]]:
    """The base and sixteen variants: each variable dropped, alone, with its slope doubled and halved."""
    out = [("base", dict(SLOPES))]
    for v, k in SLOPES.items():
        out += [(f"without_{v}", SLOPES | {v: 0.0}), (f"only_{v}", {n: (s if n == v else 0.0) for n, s in SLOPES.items()}), (f"double_{v}", SLOPES | {v: 2 * k}), (f"half_{v}", SLOPES | {v: k / 2})]
    return out


def logit_sensitivity(scored: DataFrame) -> DataFrame:
    """T5: (scenario, cell columns, score): one row for each scenario; the scenarios are an array of columns, so no join is needed."""
    scores = F.array(*[F.struct(F.lit(n).alias("scenario"), logit_score(s).alias("score")) for n, s in sensitivity_scenarios()])
    return scored.select("*", F.explode(scores).alias("s")).select(*scored.columns, "s.scenario", "s.score")


def sensitivity_correlations(scored: DataFrame, by: str | None = None) -> DataFrame:
    """T5: (scenario, by, rho): rank correlation of each scenario's scores with those of the base, over all cells or in each group of ``by``; T6 on all scenarios at once.

    Scores count as equal up to twelve digits, so that sums in another order are ties. Cells without a score in either don't count; rho is null where a scenario has one score only. A null in ``by`` is a group; an empty table gives an empty result.
    """
    even = lambda s: F.round(logit_score(s), 12)
    scores = [F.struct(F.lit(n).alias("scenario"), even(s).alias("score")) for n, s in sensitivity_scenarios()[1:]]
    rows = scored.select((F.col(by) if by else F.lit(None)).alias("g"), even(SLOPES).alias("base"), F.explode(F.array(*scores)).alias("s")).select("g", "base", "s.scenario", "s.score")
    out = spearman(rows, "base", "score", ["scenario", "g"] if by else ["scenario"])
    return out.select("scenario", F.col("g").alias(by), "rho") if by else out.select("scenario", "rho")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho): rank correlation over complete rows, ties with their mean rank, inside each group; null where x or y is constant.

    Rows are counted by (group, x, y) and ranks are running counts over the distinct values, so neither a large group nor a common value meets in one task.
    """
    keys = [f"s_by_{k}" for k in range(len(by))]
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = stored(complete.groupBy(*[F.col(b).alias(k) for k, b in zip(keys, by)], F.col(x).cast("double").alias("s_x"), F.col(y).cast("double").alias("s_y")).agg(F.count("*").alias("s_n")), "pairs")
    # Both columns in one long table, so that both are ranked by the same steps.
    both = F.explode(F.array(F.struct(F.lit(0).alias("s_column"), F.col("s_x").alias("s_v")), F.struct(F.lit(1).alias("s_column"), F.col("s_y").alias("s_v"))))
    ties = pairs.select(*keys, both.alias("s"), "s_n").groupBy(*keys, "s.s_column", "s.s_v").agg(F.sum("s_n").alias("s_ties"))
    ranks = stored(running_sums(ties, [*keys, "s_column"], "s_v", ["s_ties"]).withColumn("s_rank", F.col("run_s_ties") - (F.col("s_ties") - 1) / 2), "ranks")
    ranked = pairs
    for k, c in enumerate(("s_x", "s_y")):
        own = ranks.filter(F.col("s_column") == k).select(*[F.col(b).alias(f"{b}_{k}") for b in keys], F.col("s_v").alias(f"s_v_{k}"), F.col("s_rank").alias(f"{c}_rank"))
        on = F.col(c) == F.col(f"s_v_{k}")
        for b in keys:
            on = on & F.col(b).eqNullSafe(F.col(f"{b}_{k}"))
        ranked = ranked.join(own, on)
    # The mean rank is (n + 1) / 2 on both sides.
    sizes = pairs.groupBy(*[F.col(b).alias(f"{b}_n") for b in keys]).agg(((F.sum("s_n") + 1) / 2).alias("s_mean"))
    on = F.lit(True)
    for b in keys:
        on = on & F.col(b).eqNullSafe(F.col(f"{b}_n"))
    dx, dy, n = F.col("s_x_rank") - F.col("s_mean"), F.col("s_y_rank") - F.col("s_mean"), F.col("s_n")
    sums = ranked.join(sizes, on).groupBy(*keys).agg(F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))).alias("rho"))
    return sums.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "rho")


def spearman_global(df: DataFrame, x: str, y: str) -> float:
    """T6 without groups: ranks of the whole table by MLlib, whose sort is spread over partitions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=[x, y], outputCol="v").transform(df.select(x, y).dropna())
    return float(Correlation.corr(rows, "v", "spearman").first()[0].toArray()[0, 1])
