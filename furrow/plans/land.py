"""Queries of the land-use operators: sources, crop mix, quotas, tillage classes, totals, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import diagnostics as D
from furrow.operators import quota as Q
from furrow.operators import suitability as S
from furrow.operators import tillage as C
from furrow.operators import totals as A
from furrow.plans.base import oracle, plan, view
from furrow.session import fresh_path, stored, table
from furrow.sources import tables as X

LAND = ("cells", "cell_crop", "crops", "reported")
#: Steps of the land pipeline as SQL, each on those before it.
GRAINS = "grains AS (SELECT cell_id, crop, ta AS grain FROM cell_crop JOIN cells USING (cell_id) WHERE crop IN ('C1', 'C2', 'C3'))"
MIX = "mix AS (SELECT cell_id, CASE WHEN g / t <= 1.5 THEN g / t END AS crop_mix FROM (SELECT cell_id, sum(ta) AS t, coalesce(sum(CASE WHEN crop IN ('C1', 'C2', 'C3') THEN ta END), 0) AS g FROM cell_crop WHERE cell_id IN (SELECT cell_id FROM cells) GROUP BY cell_id) AS z)"
SCORE = "scored AS (SELECT cell_id, country_code, depth, field, high, crop_mix, 1 / (1 + exp(-((field - 20) / 4.0 + (erosion - 12) / 60.0 - 5 * (aridity - 0.65) + 10 * (crop_mix - 0.5)))) AS score FROM cells JOIN mix USING (cell_id))"
POTENTIAL = "pot AS (SELECT g.cell_id, crop, country_code, score, grain AS area FROM grains g JOIN scored USING (cell_id) WHERE score IS NOT NULL)"
CELL_POT = "cpot AS (SELECT cell_id, country_code, score, sum(area) AS area FROM pot GROUP BY ALL)"
TARGET = "target AS (SELECT p.country_code, coalesce(nullif(value * 1000, 0), 0.1 * p.area) AS target FROM (SELECT country_code, sum(area) AS area FROM cpot GROUP BY 1) p LEFT JOIN reported r USING (country_code))"
CUT = """cut AS (SELECT country_code, coalesce(max(score) FILTER (WHERE cum >= target), min(score)) AS cutoff FROM
  (SELECT country_code, score, target, sum(area) OVER (PARTITION BY country_code ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM cpot JOIN target USING (country_code)) AS z GROUP BY country_code)"""
CA = "ca AS (SELECT cell_id, crop, country_code, area, score, CASE WHEN score >= cutoff THEN area ELSE 0.0 END AS allocated FROM pot JOIN cut USING (country_code))"
INPUT = """inp AS (SELECT cell_id, crop, annual, ta AS area, depth, field, high, country_code, coalesce(allocated, 0) AS ca, depth < 15 AS flat, depth >= 15 AND depth < 20 AS mid, field < 2.5 AS small, high IS NOT NULL AS rich
  FROM cell_crop JOIN crops USING (crop) JOIN cells USING (cell_id) LEFT JOIN (SELECT cell_id, crop, allocated FROM ca) AS q USING (cell_id, crop))"""
PARTS = """part_ AS (SELECT *, CASE WHEN annual AND NOT flat AND small AND NOT rich THEN area END AS ta_, CASE WHEN NOT annual AND NOT flat AND small AND NOT rich THEN nullif(area, 0) END AS tr_,
  CASE WHEN flat THEN area END AS ri_, CASE WHEN NOT annual AND NOT flat AND (NOT small OR rich) THEN area END AS pr_ FROM inp)"""
REST = "rest AS (SELECT *, CASE WHEN NOT mid THEN nullif(pr_, 0) END AS ro_, area - coalesce(ta_, 0) - coalesce(tr_, 0) - coalesce(CASE WHEN NOT mid THEN pr_ END, 0) - coalesce(ri_, 0) - ca AS left_ FROM part_)"
CLASSES = """cls AS (SELECT cell_id, crop, country_code, annual, area, CASE WHEN NOT mid AND annual AND left_ > 0 THEN left_ END AS conventional, ta_ AS traditional_annual,
  nullif(coalesce(ri_, 0) + coalesce(CASE WHEN mid AND left_ > 0 THEN left_ END, 0) + coalesce(CASE WHEN mid THEN pr_ END, 0), 0) AS reduced, nullif(ca, 0) AS conservation, ro_ AS rotational, tr_ AS traditional_rotational FROM rest)"""
CODED = """coded AS (SELECT cell_id, crop, CASE WHEN annual THEN CASE WHEN conservation > 0 THEN 4 WHEN reduced > 0 THEN 3 WHEN traditional_annual > 0 THEN 2 WHEN conventional > 0 THEN 1 END
  ELSE CASE WHEN traditional_rotational > 0 THEN 6 WHEN rotational > 0 THEN 5 END END AS code FROM cls)"""
STEPS = {"grains": GRAINS, "mix": MIX, "scored": SCORE, "pot": POTENTIAL, "cpot": CELL_POT, "target": TARGET, "cut": CUT, "ca": CA, "inp": INPUT, "part_": PARTS, "rest": REST, "cls": CLASSES, "coded": CODED}


def upto(last: str, body: str, doubles: str = "") -> str:
    """``body`` after all steps up to ``last``."""
    names = list(STEPS)
    views = oracle("", *LAND).strip()
    head = ", ".join([views, *[STEPS[n] for n in names[: names.index(last) + 1]]])
    if doubles:
        return f"{head} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({body}) AS body"
    return f"{head} {body}"


def land(spark, sf):
    return tuple(view(spark, sf, n) for n in LAND)


def scored(spark, sf):
    cells, crop, groups, _ = land(spark, sf)
    grains = S.eligible_area(crop, cells, groups)
    mix = S.crop_mix(crop.join(cells.select("cell_id"), "cell_id", "left_semi"), grains)
    return grains, cells.join(mix, "cell_id").withColumn("score", S.logit_score())


def potential(spark, sf):
    grains, score = scored(spark, sf)
    pot = S_potential(grains, score)
    return pot.join(score.select("cell_id", "country_code", "score"), "cell_id").select("cell_id", "crop", "country_code", "score", F.col("potential").alias("area"))


def S_potential(grains, score):
    return Q.potential_area(grains, score)


def targets(spark, sf):
    """Cells with their summed potential, and the targets of their countries. Scores are used more than once, so they are stored."""
    pot = stored(potential(spark, sf), "potential")
    cell = pot.groupBy("cell_id", "country_code", "score").agg(F.sum("area").alias("area"))
    return pot, cell, Q.quota_target(cell.groupBy("country_code").agg(F.sum("area").alias("potential")), view(spark, sf, "reported"))


def allocated(spark, sf):
    pot, cell, target = targets(spark, sf)
    return Q.quota_allocate(pot, Q.quota_cutoff(cell, target))


def classes(spark, sf):
    cells, crop, groups, _ = land(spark, sf)
    return C.tillage_classes(C.tillage_inputs(crop, cells, groups, allocated(spark, sf)))


@plan(oracle("SELECT cell_id, coalesce(max(CASE WHEN src = 0 THEN v END), max(CASE WHEN src = 1 THEN v END)) AS v FROM (SELECT cell_id, 0 AS src, CASE WHEN depth > 10 THEN depth END AS v FROM cells WHERE row_no < 12 UNION ALL SELECT cell_id, 1, price FROM cells WHERE row_no >= 9) AS z WHERE cell_id BETWEEN 500 AND 1500 GROUP BY cell_id", "cells", doubles="v"))
def s1_read_cells(spark, sf):
    """Two sources that overlap; the first has cells without a value."""
    cells = view(spark, sf, "cells")
    return X.read_cells([cells.filter("row_no < 12").select("cell_id", F.when(F.col("depth") > 10, F.col("depth")).alias("v")), cells.filter("row_no >= 9").select("cell_id", F.col("price").alias("v"))], F.col("cell_id").between(500, 1500))


@plan(oracle("SELECT country_code, value FROM reported", "reported"))
def s2_read_stats_csv(spark, sf):
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    path = fresh_path(spark, "stats-csv")
    X.write_totals(view(spark, sf, "reported"), path)
    return X.read_stats_csv(spark, path, StructType([StructField("country_code", LongType()), StructField("value", DoubleType())]), ["country_code", "value"])


@plan("SELECT n_name AS country, CASE WHEN n_nationkey % 2 = 0 THEN '1000 ha' ELSE 'ha' END AS unit, CAST(n_nationkey AS DOUBLE) * CASE WHEN n_nationkey % 2 = 0 THEN 1000 ELSE 1 END AS value FROM nation WHERE n_nationkey > 0")
def s3_standardize_stats(spark, sf):
    raw = table(spark, sf, "nation").select(F.col("n_name").alias("Area"), F.when(F.col("n_nationkey") % 2 == 0, "1000 ha").otherwise("ha").alias("Unit"), F.col("n_nationkey").alias("Value"))
    return X.standardize_stats(raw, {"country": ["country", "Area", "Country"], "unit": ["Unit"], "value": ["Value", "value"]})


@plan("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")
def s4_preflight(spark, sf):
    return X.preflight(table(spark, sf, "part").select(F.col("p_partkey").alias("key")), table(spark, sf, "lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("key")), "key")


@plan(oracle("SELECT DISTINCT tile_id FROM (SELECT row_no AS tile_id FROM cells) AS t WHERE tile_id NOT IN (SELECT row_no FROM cells WHERE price > 1500)", "cells"))
def s5_pending_tiles(spark, sf):
    cells = view(spark, sf, "cells")
    return X.pending_tiles(cells.select(F.col("row_no").alias("tile_id")).distinct(), cells.filter("price > 1500").select(F.col("row_no").alias("tile_id")))


@plan("SELECT n_nationkey, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS xmin, CAST(50 - n_nationkey * 5 AS DOUBLE) AS ymin, CAST(n_nationkey * 5 - 55 AS DOUBLE) AS xmax, CAST(55 - n_nationkey * 5 AS DOUBLE) AS ymax FROM nation")
def s6_parse_tile_name(spark, sf):
    named = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("tile_X"), F.col("n_nationkey") * 5 - 60, F.lit("_Y"), 50 - F.col("n_nationkey") * 5, F.lit(".tif")).alias("name"))
    return X.parse_tile_name(named, "name").drop("name")


@plan(oracle("SELECT cell_id, depth, row_no AS tile_id FROM cells", "cells"))
def s7_write_cells(spark, sf):
    path = fresh_path(spark, "cells")
    cells = view(spark, sf, "cells").select("cell_id", "depth", F.col("row_no").alias("tile_id"))
    X.write_cells(cells, path)
    return spark.read.schema("cell_id long, depth double, tile_id long").parquet(path)


@plan("SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def s8_write_totals(spark, sf):
    path = fresh_path(spark, "totals")
    X.write_totals(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total")), path)
    return spark.read.schema("l_returnflag string, total double").option("header", True).csv(path)


@plan("SELECT p_partkey, crop, value FROM (SELECT p_partkey, 'a' AS crop, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'b', CASE WHEN p_size > 25 THEN p_retailprice END FROM part) AS z WHERE value IS NOT NULL")
def s9_flatten_cube(spark, sf):
    wide = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a_till"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("b_till"))
    return X.flatten_cube(wide, ["p_partkey"])


@plan("""WITH w AS (SELECT l_partkey AS sampleid, 3502 + l_linenumber % 5 AS field_size, sum(s_suppkey % 10) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT sampleid, CAST(field_size AS INTEGER) AS field_size, CAST(weight AS BIGINT) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY sampleid ORDER BY weight DESC, field_size) = 1""")
def s10_field_size_submissions(spark, sf):
    sub = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sampleid"), F.col("l_suppkey").alias("userid"), (3502 + F.col("l_linenumber") % 5).alias("field_size"))
    return X.field_size_submissions(sub, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("userid"), (F.col("s_suppkey") % 10).alias("quality")))


def _crop_values() -> str:
    rows = [(c, True, True, False) for c in S.ANNUAL_CA] + [(c, True, False, True) for c in S.TUBER_RICE] + [(c, False, False, False) for c in S.PERENNIAL]
    return ", ".join(f"('{c}', {a}, {b}, {t})" for c, a, b, t in rows)


@plan(f"SELECT p_partkey, crop, annual, ca_suitable, tuber_rice FROM part JOIN (SELECT *, row_number() OVER (ORDER BY crop) AS k FROM (VALUES {_crop_values()}) AS v(crop, annual, ca_suitable, tuber_rice)) AS g ON k = p_partkey % 42 + 1")
def t1_crop_groups(spark, sf):
    codes = sorted([*S.ANNUAL_CA, *S.TUBER_RICE, *S.PERENNIAL])
    crop = F.array(*[F.lit(c) for c in codes])[(F.col("p_partkey") % 42).cast("int")]
    return table(spark, sf, "part").select("p_partkey", S.canonical_crop(F.lower(crop)).alias("crop")).join(F.broadcast(S.crop_groups(spark)), "crop").select("p_partkey", "crop", "annual", "ca_suitable", "tuber_rice")


@plan(oracle("SELECT cell_id, crop, tr AS grain FROM cell_crop JOIN cells USING (cell_id) WHERE crop IN ('C1', 'C2', 'C3') AND (field >= 2.5 OR high IS NOT NULL) AND depth >= 15", *LAND))
def t2_eligible_area(spark, sf):
    cells, crop, groups, _ = land(spark, sf)
    return S.eligible_area(crop, cells, groups, "large_or_high_income", "tr", exclude_flat=True)


@plan(upto("mix", "SELECT * FROM mix", "crop_mix"))
def t3_crop_mix(spark, sf):
    return scored(spark, sf)[1].select("cell_id", "crop_mix")


@plan(upto("scored", "SELECT cell_id, score FROM scored", "score"))
def t4_logit_score(spark, sf):
    return scored(spark, sf)[1].select("cell_id", "score")


def _sensitivity_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT '{n}' AS scenario, cell_id, 1 / (1 + exp(-(({k['field']!r} * (field - 20)) + ({k['erosion']!r} * (12 - 12.0)) + ({k['aridity']!r} * (aridity - 0.65)) + ({k['crop_mix']!r} * (crop_mix - 0.5))))) AS score FROM base"
        for n, k in S.sensitivity_scenarios()
    )
    return upto("scored", f"SELECT scenario, avg(score) AS mean_score, min(score) AS least_score, max(score) AS largest_score FROM (WITH base AS (SELECT cell_id, field, aridity, crop_mix FROM scored JOIN (SELECT cell_id, aridity FROM cells) AS y USING (cell_id) WHERE crop_mix IS NOT NULL) {one}) AS z GROUP BY scenario", "mean_score least_score largest_score")


@plan(_sensitivity_sql())
def t5_logit_sensitivity(spark, sf):
    rows = S.logit_sensitivity(scored(spark, sf)[1].filter("crop_mix IS NOT NULL").drop("score"))
    return rows.groupBy("scenario").agg(F.avg("score").alias("mean_score"), F.min("score").alias("least_score"), F.max("score").alias("largest_score"))


def _correlations_sql() -> str:
    score = lambda k: f"round(1 / (1 + exp(-(({k['field']!r} * (field - 20)) + ({k['erosion']!r} * (12 - 12.0)) + ({k['aridity']!r} * (aridity - 0.65)) + ({k['crop_mix']!r} * (crop_mix - 0.5))))), 12)"
    every = " UNION ALL ".join(f"SELECT '{n}' AS scenario, cell_id, {score(k)} AS score FROM base" for n, k in S.sensitivity_scenarios()[1:])
    part = "PARTITION BY g, scenario"
    ranks = ", ".join(f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part}, {c}) - 1) / 2.0 AS {r}" for c, r in (("b", "rb"), ("score", "rs")))
    return upto("scored", f"""SELECT scenario, g AS country_code, CASE WHEN min(rb) < max(rb) AND min(rs) < max(rs) THEN corr(rb, rs) END AS rho FROM (SELECT scenario, g, {ranks} FROM
      (WITH base AS (SELECT cell_id, field, aridity, crop_mix, {score(S.SLOPES)} AS b, cc AS country_code FROM scored JOIN (SELECT cell_id, aridity, country_code AS cc FROM cells) AS y USING (cell_id) WHERE crop_mix IS NOT NULL), every AS ({every})
      SELECT scenario, CAST(NULL AS BIGINT) AS g, b, score FROM base JOIN every USING (cell_id) UNION ALL SELECT scenario, country_code, b, score FROM base JOIN every USING (cell_id)) AS w) AS z GROUP BY scenario, g""", "rho")


@plan(_correlations_sql())
def t5_sensitivity_correlations(spark, sf):
    """Each scenario against the base: over all cells (no country) and by country."""
    cells = stored(scored(spark, sf)[1].drop("score"), "scored")
    return S.sensitivity_correlations(cells).select("scenario", F.lit(None).cast("long").alias("country_code"), "rho").unionByName(S.sensitivity_correlations(cells, "country_code"))


@plan(oracle("""SELECT country_code, corr(rx, ry) AS rho FROM (SELECT country_code, rank() OVER (PARTITION BY country_code ORDER BY depth) + (count(*) OVER (PARTITION BY country_code, depth) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY country_code ORDER BY aridity) + (count(*) OVER (PARTITION BY country_code, aridity) - 1) / 2.0 AS ry FROM cells) AS z GROUP BY 1""", "cells", doubles="rho"))
def t6_spearman(spark, sf):
    return S.spearman(view(spark, sf, "cells"), "depth", "aridity", ["country_code"])


@plan(oracle("""SELECT a.cell_id, a.crop, CASE WHEN a.ta / 1600 BETWEEN 0 AND 0.1 THEN a.ta / 1600 END AS a1600, CASE WHEN a.ta BETWEEN 0 AND 60 THEN a.ta END AS sane, CASE WHEN t > 400 THEN a.ta * 400 / t ELSE a.ta END AS scaled
  FROM cell_crop a JOIN (SELECT cell_id, sum(ta) AS t FROM cell_crop GROUP BY 1) AS s ON a.cell_id = s.cell_id""", "cell_crop", doubles="a1600 scaled"))
def t7_limit_area(spark, sf):
    crop = view(spark, sf, "cell_crop").select("cell_id", "crop", "ta", F.col("ta").alias("a1600"), F.col("ta").alias("sane"), F.col("ta").alias("scaled"))
    out = Q.limit_area(Q.limit_area(Q.limit_area(crop, "a1600", "div1600", 0.1), "sane", "sanitize", 60.0), "scaled", "scale", 400.0)
    return out.select("cell_id", "crop", "a1600", "sane", "scaled")


@plan("""SELECT o_custkey, arg_max(price, (o_orderdate, o_orderkey)) FILTER (WHERE price IS NOT NULL) AS price, arg_max(status, (o_orderdate, o_orderkey)) FILTER (WHERE status IS NOT NULL) AS status
FROM (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders) AS z GROUP BY 1""")
def t8_latest_by(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return Q.latest_by(o, "o_custkey", "at", ["price", "status"])


@plan("""SELECT c_custkey, iso3, map_id FROM (SELECT c_custkey, upper(CASE WHEN n_name = 'FRANCE' THEN 'FRA' WHEN n_name = 'GERMANY' THEN 'DEU' ELSE CASE WHEN n_nationkey % 3 <> 0 THEN substr(n_name, 1, 3) END END) AS iso3 FROM customer JOIN nation ON c_nationkey = n_nationkey) AS z
JOIN (SELECT substr(n_name, 1, 3) AS iso3, min(CAST(n_nationkey AS BIGINT)) AS map_id FROM nation GROUP BY 1 UNION ALL SELECT 'DEU', CAST(99 AS BIGINT)) AS m USING (iso3)""")
def t9_bridge_codes(spark, sf):
    nation = table(spark, sf, "nation")
    stats = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("area"), F.col("n_nationkey").alias("m49"))
    m49 = nation.filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("m49"), F.substring("n_name", 1, 3).alias("iso3"))
    codes = nation.groupBy(F.substring("n_name", 1, 3).alias("iso3")).agg(F.min(F.col("n_nationkey").cast("long")).alias("country_code")).unionByName(nation.limit(1).select(F.lit("DEU").alias("iso3"), F.lit(99).cast("long").alias("country_code")))
    return Q.bridge_codes(stats, m49, codes, {"FRANCE": "FRA", "GERMANY": "DEU"}).select("c_custkey", "iso3", "map_id")


@plan(upto("target", "SELECT * FROM target", "target"))
def t10_quota_target(spark, sf):
    return targets(spark, sf)[2]


@plan(upto("cut", "SELECT * FROM cut", "cutoff"))
def t11_quota_cutoff(spark, sf):
    _, cell, target = targets(spark, sf)
    return Q.quota_cutoff(cell, target)


@plan(upto("ca", "SELECT n_name AS country, sum(allocated) AS allocated, count(*) FILTER (WHERE allocated > 0) AS winners FROM ca JOIN nation ON n_nationkey + 1 = country_code GROUP BY 1", "allocated"))
def t12_quota_allocate(spark, sf):
    """Hectares of each country that win its quota."""
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("country_code"), F.col("n_name").alias("country"))
    won = allocated(spark, sf).groupBy("country_code").agg(F.sum("allocated").alias("allocated"), F.count_if(F.col("allocated") > 0).alias("winners"))
    return won.join(F.broadcast(nation), "country_code").select("country", "allocated", "winners")


NEAREST = """, g AS (SELECT cell_id, country_code, area, CASE WHEN cell_id % 11 <> 0 THEN score END AS score, target FROM cpot LEFT JOIN (SELECT * FROM target WHERE country_code % 7 <> 0) AS t USING (country_code)),
o AS (SELECT cell_id, country_code, area, target, sum(area) OVER (PARTITION BY country_code) AS total, sum(area) OVER (PARTITION BY country_code ORDER BY score DESC, cell_id ROWS UNBOUNDED PRECEDING) AS cum FROM g WHERE score IS NOT NULL AND area IS NOT NULL AND target IS NOT NULL),
f AS (SELECT *, cum - area AS prior FROM o),
w AS (SELECT cell_id, country_code, CASE WHEN total <= target THEN area > 0 ELSE cum <= target OR (prior <= target AND abs(prior - target) >= abs(cum - target)) END AS wins FROM f)"""


@plan(upto("target", "@ SELECT cell_id, g.country_code, coalesce(wins, false) AS wins FROM g LEFT JOIN w USING (cell_id)").replace(" @", NEAREST))
def t13_quota_allocate_nearest(spark, sf):
    """Some cells have no score and some countries no target: these win nothing and stay."""
    _, cell, target = targets(spark, sf)
    cell = cell.withColumn("score", F.when(F.col("cell_id") % 11 != 0, F.col("score")))
    return Q.quota_allocate_nearest(cell, target.filter("country_code % 7 <> 0")).select("cell_id", "country_code", "wins")


@plan(upto("ca", "SELECT cell_id, crop, coalesce(allocated, 0) + 0.5 * greatest(coalesce(area, 0) - coalesce(allocated, 0), 0) AS blended FROM ca", "blended"))
def t14_scenario_blend(spark, sf):
    return allocated(spark, sf).select("cell_id", "crop", Q.scenario_blend(F.col("area"), F.col("allocated")).alias("blended"))


@plan(upto("cls", """SELECT cell_id, crop, coalesce(p.area, 0) + coalesce(e.reduced, 0) AS scenario FROM (SELECT cell_id, crop, area FROM pot) AS p FULL OUTER JOIN
(SELECT cell_id, crop, reduced FROM cls JOIN (SELECT cell_id, field, high FROM cells) AS y USING (cell_id) WHERE crop IN ('C1', 'C2', 'C3') AND reduced IS NOT NULL AND (high IS NOT NULL OR field >= 2.5)) AS e USING (cell_id, crop)""", "scenario"))
def t15_scenario_suitable(spark, sf):
    cells, _, groups, _ = land(spark, sf)
    reduced = classes(spark, sf).filter("reduced IS NOT NULL").select("cell_id", "crop", "reduced")
    return Q.scenario_suitable(potential(spark, sf).withColumnRenamed("area", "potential"), reduced, cells, groups)


@plan(upto("scored", "SELECT g.cell_id, crop, nullif(grain, 0) * score AS potential FROM grains g JOIN scored USING (cell_id) WHERE score IS NOT NULL", "potential"))
def t16_potential_area(spark, sf):
    return Q.potential_area(*scored(spark, sf), weight_by_score=True)


@plan(upto("ca", "SELECT crop, sum(area) AS potential, sum(allocated) AS allocated, round(sum(allocated) / nullif(sum(area), 0), 2) * 100 AS share FROM ca GROUP BY 1", "potential allocated share"))
def t17_allocation_share(spark, sf):
    return Q.allocation_share(allocated(spark, sf).withColumnRenamed("area", "potential"))


@plan(upto("ca", "SELECT country_code, target, coalesce(a, 0) AS allocated FROM target LEFT JOIN (SELECT country_code, sum(allocated) AS a FROM ca GROUP BY 1) AS z USING (country_code)", "target allocated"))
def t18_allocation_by_country(spark, sf):
    pot, cell, target = targets(spark, sf)
    return Q.allocation_by_country(Q.quota_allocate(pot, Q.quota_cutoff(cell, target)), target)


def _class_query(name: str, column: str, ids: str):
    def query(spark, sf):
        return classes(spark, sf).filter(F.col(column).isNotNull()).select("cell_id", "crop", column)

    query.__name__ = f"{ids}_{name}"
    plan(upto("cls", f"SELECT cell_id, crop, {column} FROM cls WHERE {column} IS NOT NULL", column))(query)


for _id, _column in (("t20", "traditional_annual"), ("t21", "traditional_rotational"), ("t23", "rotational"), ("t24", "conventional"), ("t25", "reduced")):
    _class_query({"t24": "conventional_annual", "t25": "reduced_final"}.get(_id, _column), _column, _id)


@plan(oracle("SELECT cell_id, crop, ta AS reduced_initial FROM cell_crop JOIN cells USING (cell_id) WHERE depth < 15", *LAND))
def t22_reduced_initial(spark, sf):
    cells, crop, groups, _ = land(spark, sf)
    none = crop.limit(0).select("cell_id", "crop", F.col("ta").alias("allocated"))
    return C.tillage_inputs(crop, cells, groups, none).select("cell_id", "crop", C.Rules().reduced_initial().alias("reduced_initial")).filter("reduced_initial IS NOT NULL")


@plan(upto("cls", "SELECT * FROM cls", "area conventional traditional_annual reduced conservation rotational traditional_rotational"))
def t26_tillage_classes(spark, sf):
    return classes(spark, sf)


SUMS = ", ".join(f"nullif(coalesce(sum({c}), 0), 0) AS {c}" for c in C.CLASSES)


@plan(upto("cls", f"SELECT * FROM (SELECT cell_id, {SUMS} FROM cls GROUP BY 1) AS z WHERE coalesce({', '.join(C.CLASSES)}) IS NOT NULL", " ".join(C.CLASSES)))
def t27_master_merge(spark, sf):
    return C.master_merge(classes(spark, sf))


def coded(spark, sf):
    return classes(spark, sf).select("cell_id", "crop", C.category_code().alias("code"))


@plan(upto("coded", "SELECT cell_id, crop, code FROM coded"))
def t28_category_code(spark, sf):
    return coded(spark, sf)


DOMINANT = "SELECT cell_id, code AS dominant FROM (SELECT cell_id, code, count(*) AS n FROM coded WHERE code IS NOT NULL GROUP BY 1, 2) AS z QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, code) = 1"


@plan(upto("coded", DOMINANT))
def t29_dominant_class(spark, sf):
    return C.dominant_class(coded(spark, sf))


@plan(upto("coded", f"""SELECT cell_id, CAST(count(DISTINCT code) AS INTEGER) AS n_codes, string_agg(DISTINCT CAST(code AS VARCHAR), ',' ORDER BY CAST(code AS VARCHAR)) AS codes, any_value(dominant) AS winner,
  coalesce(string_agg(DISTINCT crop, ',' ORDER BY crop) FILTER (WHERE code <> dominant), '') AS overridden FROM coded JOIN ({DOMINANT}) AS d USING (cell_id) WHERE code IS NOT NULL GROUP BY cell_id HAVING count(DISTINCT code) > 1"""))
def t30_class_conflicts(spark, sf):
    return C.class_conflicts(stored(coded(spark, sf), "coded"))


GROUPED = "SELECT cell_id, CASE WHEN c IN ('conservation', 'reduced') THEN 'conservation' WHEN c IN ('conventional', 'rotational') THEN 'conventional' ELSE 'traditional' END AS class_group, sum(v) AS group_area FROM (" + " UNION ALL ".join(f"SELECT cell_id, '{c}' AS c, {c} AS v FROM cls" for c in C.CLASSES) + ") AS z WHERE v IS NOT NULL GROUP BY 1, 2"


@plan(upto("cls", GROUPED, "group_area"))
def t31_group_classes(spark, sf):
    return C.group_classes(C.long_classes(classes(spark, sf)))


ALL = ["area", *C.CLASSES]


@plan(upto("cls", "SELECT " + ", ".join([f"coalesce(sum({c}), 0) AS {c}" for c in ALL] + [f"coalesce(sum({c}), 0) / 1e6 AS {c}_mha" for c in ALL]) + " FROM cls WHERE country_code > 0", " ".join(ALL + [f"{c}_mha" for c in ALL])))
def a1_global_totals(spark, sf):
    return A.global_totals(classes(spark, sf), ALL)


@plan(upto("cls", "SELECT country_code, measure, total FROM (" + " UNION ALL ".join(f"SELECT country_code, '{c}' AS measure, sum({c}) AS total FROM cls WHERE country_code > 0 GROUP BY 1" for c in ALL) + ") AS z WHERE total <> 0", "total"))
def a2_country_totals(spark, sf):
    return A.country_totals(classes(spark, sf), ALL)


@plan(upto("cls", "SELECT country_code, " + ", ".join(f"sum({c}) AS {c}" for c in ALL) + " FROM cls WHERE country_code > 0 GROUP BY ROLLUP (country_code)", " ".join(ALL)))
def a2_rolled_totals(spark, sf):
    return A.rolled_totals(classes(spark, sf), ALL)


@plan(upto("cls", "SELECT variable, weight, CASE variable WHEN 'depth' THEN CASE weight WHEN 'area' THEN sum(depth * area) / sum(area) ELSE sum(depth * reduced) / sum(reduced) END ELSE CASE weight WHEN 'area' THEN sum(aridity * area) / sum(area) ELSE sum(aridity * reduced) / sum(reduced) END END AS mean FROM cls JOIN (SELECT cell_id, CASE WHEN depth > 10 THEN depth END AS depth, aridity FROM cells) AS y USING (cell_id), (VALUES ('depth', 'area'), ('depth', 'reduced'), ('aridity', 'area'), ('aridity', 'reduced')) AS v(variable, weight) GROUP BY 1, 2", "mean"))
def a3_weighted_means(spark, sf):
    cells = view(spark, sf, "cells").select("cell_id", F.when(F.col("depth") > 10, F.col("depth")).alias("depth"), "aridity")
    return A.weighted_means(classes(spark, sf).join(cells, "cell_id"), ["depth", "aridity"], ["area", "reduced"])


@plan(upto("cls", "SELECT low_intensity, high_intensity, low_intensity / t AS low_share, high_intensity / t AS high_share, (low_intensity + 1e6) / (t + 1e6) AS low_share_fallow, high_intensity / (t + 1e6) AS high_share_fallow FROM (SELECT coalesce(sum(reduced), 0) + coalesce(sum(conservation), 0) AS low_intensity, coalesce(sum(conventional), 0) + coalesce(sum(rotational), 0) AS high_intensity, coalesce(sum(reduced), 0) + coalesce(sum(conservation), 0) + coalesce(sum(conventional), 0) + coalesce(sum(rotational), 0) AS t FROM cls) AS z", "low_intensity high_intensity low_share high_share low_share_fallow high_share_fallow"))
def a4_intensity_shares(spark, sf):
    totals = A.global_totals(classes(spark, sf), ALL, None)
    return A.intensity_shares(totals, ["reduced", "conservation"], ["conventional", "rotational"], 1e6)


@plan(oracle("SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.v, b.v) AS v FROM (SELECT cell_id, depth AS v FROM cells WHERE cell_id % 3 = 0) AS a FULL OUTER JOIN (SELECT cell_id, price AS v FROM cells WHERE cell_id % 2 = 0) AS b ON a.cell_id = b.cell_id", "cells", doubles="v"))
def a5_overlay_merge(spark, sf):
    cells = view(spark, sf, "cells")
    return A.overlay_merge(cells.filter("cell_id % 3 = 0").select("cell_id", F.col("depth").alias("v")), cells.filter("cell_id % 2 = 0").select("cell_id", F.col("price").alias("v")), "cell_id", "v")


@plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def a6_top_n(spark, sf):
    return A.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, "o_orderkey")


@plan(oracle("SELECT coarse_sum, fine_sum, fine_sum - coarse_sum AS difference, 100 * (fine_sum - coarse_sum) / greatest(coarse_sum, 1) AS percent, fine_max FROM (SELECT sum(ta) / 1600 AS coarse_sum, sum(tr) / 800 AS fine_sum, max(tr / 800) AS fine_max FROM cell_crop WHERE crop = 'C1' AND cell_id BETWEEN 100 AND 900) AS z", "cell_crop", doubles="coarse_sum fine_sum difference percent fine_max"))
def d1_mass_check(spark, sf):
    crop = view(spark, sf, "cell_crop")
    return D.mass_check(crop.withColumnRenamed("ta", "area"), crop.withColumn("area", F.col("tr") / 800), "C1", F.col("cell_id").between(100, 900))


@plan(upto("cls", "SELECT country_code, " + " + ".join(f"coalesce(sum({c}), 0)" for c in C.CLASSES) + " AS classes, sum(area) AS total, " + " + ".join(f"coalesce(sum({c}), 0)" for c in C.CLASSES) + " - sum(area) AS balance FROM cls GROUP BY 1", "classes total balance"))
def d2_class_balance(spark, sf):
    return D.class_balance(classes(spark, sf), list(C.CLASSES))


@plan(oracle("SELECT max(a) AS largest, count(*) FILTER (WHERE a > 900) AS over, max(a) <= 900 AS ok FROM (SELECT sum(ta) AS a FROM cell_crop GROUP BY cell_id) AS z", "cell_crop"))
def d3_max_cell_area(spark, sf):
    return D.max_cell_area(view(spark, sf, "cell_crop"), "ta", 900.0)


@plan(oracle("SELECT CAST(100000 AS BIGINT) AS total_cells, count(*) FILTER (WHERE a > 0) AS valid_cells, 100000 - count(*) FILTER (WHERE a > 0) AS empty_cells, 100.0 * count(*) FILTER (WHERE a > 0) / 100000 AS percent FROM (SELECT sum(ta) AS a FROM cell_crop GROUP BY cell_id) AS z", "cell_crop", doubles="percent"))
def d4_coverage(spark, sf):
    return D.coverage(view(spark, sf, "cell_crop"), "ta", 100_000)


@plan(upto("coded", "SELECT crop, " + ", ".join(f"count(*) FILTER (WHERE code = {k}) AS code_{k}" for k in range(1, 8)) + ", count(*) AS all_codes FROM coded WHERE code IS NOT NULL GROUP BY 1"))
def d5_category_counts(spark, sf):
    return D.category_counts(coded(spark, sf), list(range(1, 8)))


@plan("SELECT min(l_quantity) AS smallest, max(l_quantity) AS largest, round(avg(l_quantity), 6) AS mean, count(*) FILTER (WHERE l_quantity > 0) AS positive, count(DISTINCT l_quantity) AS distinct_values FROM lineitem")
def d6_value_profile(spark, sf):
    return D.value_profile(table(spark, sf, "lineitem"), "l_quantity")


@plan(oracle("SELECT min(row_no) AS first_row, min(col_no) AS first_col FROM cells WHERE depth - 45 > 0", "cells"))
def d7_first_data_cell(spark, sf):
    return D.first_data_cell(view(spark, sf, "cells").withColumn("v", F.col("depth") - 45), "v")


@plan("""WITH o AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(greatest(ceil(log2(count(*)) + 1), 10), 50) AS bins FROM orders)
SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, n FROM (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, any_value(lo) AS lo, any_value((hi - lo) / bins) AS w, count(*) AS n FROM orders, o GROUP BY 1) AS z""")
def d8_histogram_auto(spark, sf):
    return D.histogram_auto(table(spark, sf, "orders"), "o_totalprice")


@plan("SELECT round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(stddev_samp(o_totalprice), 6) AS std FROM orders")
def d8_value_summary(spark, sf):
    return D.value_summary(table(spark, sf, "orders"), "o_totalprice")


@plan("SELECT label, total, round(100 * total / s, 6) AS percent, round(100 / (3 * (100 * total / s)), 6) AS weight FROM (SELECT unnest(['l_quantity', 'l_tax', 'l_discount']) AS label, round(unnest([sum(l_quantity), sum(l_tax), sum(l_discount)]), 6) AS total, sum(l_quantity) + sum(l_tax) + sum(l_discount) AS s FROM lineitem) AS z")
def d9_label_proportions(spark, sf):
    return D.label_proportions(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_discount"])


@plan(oracle("SELECT sum(CASE WHEN field < 2.5 AND high IS NULL THEN ta ELSE 0 END) AS small_low_income, sum(CASE WHEN field >= 2.5 THEN ta ELSE 0 END) AS large FROM cell_crop JOIN cells USING (cell_id)", *LAND))
def d10_grid_cells_by_rule(spark, sf):
    cells, crop, _, _ = land(spark, sf)
    return D.grid_cells_by_rule(crop.join(cells, "cell_id"), "ta", 2.5)
