"""Queries of the grid, scene, composite and phenology operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import composites as P
from furrow.operators import grid as G
from furrow.operators import phenology as K
from furrow.operators import scenes as R
from furrow.plans.base import oracle, plan, rounded, view
from furrow.session import table

GRID = G.Grid(0.0, 64.0, 0.0, 512.0, 1.0)


def cells(spark, sf):
    return view(spark, sf, "cells")


def obs(spark, sf):
    return view(spark, sf, "obs")


@plan("SELECT o_orderkey, CAST(floor(512 - lat) AS BIGINT) AS row_no, CAST(floor(lon) AS BIGINT) AS col_no, CAST(floor(512 - lat) * 64 + floor(lon) AS BIGINT) AS cell_id FROM (SELECT o_orderkey, o_totalprice / 8000 AS lon, CAST(o_custkey % 600 AS DOUBLE) AS lat FROM orders) AS z WHERE lon >= 0 AND lon < 64 AND lat > 0 AND lat <= 512")
def g1_to_cell(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 8000).alias("lon"), (F.col("o_custkey") % 600).cast("double").alias("lat"))
    row, col, cell = G.to_cell(GRID, F.col("lon"), F.col("lat"))
    return o.select("o_orderkey", row.alias("row_no"), col.alias("col_no"), cell.alias("cell_id")).filter("cell_id IS NOT NULL")


@plan(oracle("SELECT cell_id, CAST(col_no + 0.5 AS DOUBLE) AS lon, CAST(512 - (row_no + 0.5) AS DOUBLE) AS lat FROM cells", "cells", doubles="lon lat"))
def g1_to_lonlat(spark, sf):
    lon, lat = G.to_lonlat(GRID, F.col("row_no"), F.col("col_no"))
    return cells(spark, sf).select("cell_id", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


@plan(oracle("SELECT cell_id FROM cells WHERE row_no >= 3 AND row_no < 11 AND col_no >= 5 AND col_no < 40", "cells"))
def g2_clip(spark, sf):
    return G.clip(cells(spark, sf), (3, 11), (5, 40)).select("cell_id")


@plan(oracle("SELECT cell_id, CASE WHEN high IS NOT NULL THEN aridity ELSE 360.0 / (col_no + 1) END AS res FROM cells", "cells", doubles="res"))
def g3_georeference_default(spark, sf):
    return cells(spark, sf).select("cell_id", G.georeference_default(F.col("high").isNotNull(), F.col("aridity"), F.col("col_no") + 1).alias("res"))


@plan(oracle("SELECT t.row_no, t.col_no, s.depth FROM (SELECT row_no, col_no FROM cells) AS t LEFT JOIN cells s ON s.row_no = CAST(floor((t.row_no + 0.5) * 2.5) AS BIGINT) AND s.col_no = CAST(floor((t.col_no + 0.5) * 2.5) AS BIGINT)", "cells"))
def g4_resample_nearest(spark, sf):
    c = cells(spark, sf)
    return G.resample_nearest(c, c.select("row_no", "col_no"), 2.5, "depth").select("row_no", "col_no", "depth")


@plan(oracle("SELECT CAST(floor(row_no / 4.0) AS BIGINT) AS c_row, CAST(floor(col_no / 4.0) AS BIGINT) AS c_col, avg(CASE WHEN depth > 20 THEN 1.0 ELSE 0.0 END) AS mean FROM cells GROUP BY 1, 2", "cells", doubles="mean"))
def g5_resample_average(spark, sf):
    return G.resample_average(cells(spark, sf), 4, (F.col("depth") > 20).cast("int"))


@plan(oracle("SELECT c_row, c_col, kind AS mode FROM (SELECT CAST(floor(row_no / 4.0) AS BIGINT) AS c_row, CAST(floor(col_no / 4.0) AS BIGINT) AS c_col, kind, count(*) AS n FROM cells GROUP BY 1, 2, 3) AS z QUALIFY row_number() OVER (PARTITION BY c_row, c_col ORDER BY n DESC, kind) = 1", "cells"))
def g6_resample_mode(spark, sf):
    return G.resample_mode(cells(spark, sf), 4, "kind")


@plan(oracle("""SELECT t.row_no, t.col_no, sum(w * s.depth) / sum(w) AS depth FROM (SELECT row_no, col_no, CAST(floor(y) AS BIGINT) + dy AS sr, CAST(floor(x) AS BIGINT) + dx AS sc,
  (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM (SELECT row_no, col_no, (row_no + 0.5) * 1.5 - 0.5 AS y, (col_no + 0.5) * 1.5 - 0.5 AS x FROM cells) AS p, (VALUES (0), (1)) AS a(dy), (VALUES (0), (1)) AS b(dx)) AS t
  JOIN cells s ON s.row_no = sr AND s.col_no = sc WHERE w > 0 GROUP BY 1, 2""", "cells", doubles="depth"))
def g7_resample_bilinear(spark, sf):
    c = cells(spark, sf)
    return G.resample_bilinear(c, c.select("row_no", "col_no"), 1.5, "depth")


@plan(oracle("SELECT f.row_no, f.col_no, c.depth FROM (SELECT row_no, col_no FROM cells) AS f LEFT JOIN cells c ON c.row_no = CAST(floor(f.row_no / 3.0) AS BIGINT) AND c.col_no = CAST(floor(f.col_no / 3.0) AS BIGINT)", "cells"))
def g8_disaggregate(spark, sf):
    c = cells(spark, sf)
    return G.disaggregate(c, c.select("row_no", "col_no"), 3, "depth").select("row_no", "col_no", "depth")


@plan(oracle("SELECT cell_id, CASE WHEN depth BETWEEN 5 AND 30 THEN depth END AS depth FROM cells", "cells"))
def g9_sanitize(spark, sf):
    return cells(spark, sf).select("cell_id", G.sanitize(F.col("depth"), 5, 30).alias("depth"))


@plan(oracle("SELECT cell_id, CASE WHEN (SELECT max(price) FROM cells) > 100 THEN price / 10000 ELSE price END AS price FROM cells", "cells", doubles="price"))
def g10_autoscale(spark, sf):
    return G.autoscale(cells(spark, sf), "price").select("cell_id", "price")


@plan("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 END AS size_class FROM lineitem")
def g11_reclassify(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", G.reclassify(F.col("l_linenumber") + 3501).alias("size_class"))


@plan(oracle("SELECT cell_id, CASE WHEN depth < 15 THEN depth END AS depth FROM cells", "cells"))
def g12_shallow_mask(spark, sf):
    return cells(spark, sf).select("cell_id", G.shallow_mask(F.col("depth")).alias("depth"))


@plan(oracle("SELECT a.row_no, a.col_no, sum(b.depth) AS focal_sum, count(*) AS focal_n FROM cells a JOIN cells b ON b.row_no BETWEEN a.row_no - 3 AND a.row_no + 2 AND b.col_no BETWEEN a.col_no - 3 AND a.col_no + 2 GROUP BY 1, 2", "cells"))
def g13_focal_box(spark, sf):
    c = cells(spark, sf)
    return G.focal_box(c, "depth", 6, 4096, 64).join(c.select("row_no", "col_no"), ["row_no", "col_no"], "left_semi")


@plan(oracle("SELECT a.row_no, a.col_no, avg(b.depth) AS focal_mean FROM cells a JOIN cells b ON (b.row_no - a.row_no) * (b.row_no - a.row_no) + (b.col_no - a.col_no) * (b.col_no - a.col_no) <= 25 GROUP BY 1, 2", "cells", doubles="focal_mean"))
def g14_focal_circle(spark, sf):
    c = cells(spark, sf)
    return G.focal_circle(c, "depth", 5, 4096, 64).join(c.select("row_no", "col_no"), ["row_no", "col_no"], "left_semi")


@plan(oracle("""SELECT row_no, col_no, crop, ta * (6.25 * f) / s AS area FROM cell_crop JOIN (SELECT a.cell_id, a.row_no, a.col_no, a.aridity AS f, sum(6.25 * b.aridity) AS s FROM cells a JOIN cells b ON b.row_no BETWEEN a.row_no - 2 AND a.row_no + 1
  AND b.col_no BETWEEN a.col_no - 2 AND a.col_no + 1 GROUP BY 1, 2, 3, 4) AS z USING (cell_id) WHERE f > 0""", "cells", "cell_crop", doubles="area"))
def g15_dasymetric(spark, sf):
    c = cells(spark, sf)
    coarse = view(spark, sf, "cell_crop").join(c.select("cell_id", "row_no", "col_no"), "cell_id").select("row_no", "col_no", "crop", F.col("ta").alias("area"))
    return G.dasymetric(coarse, c.select("row_no", "col_no", F.col("aridity").alias("fraction")), 4, 4096, 64)


@plan(oracle("""SELECT a.row_no, a.col_no, coalesce(any_value(a.v), round_even(avg(b.v), 0)) AS v FROM (SELECT row_no, col_no, CASE WHEN depth > 25 THEN depth END AS v FROM cells) AS a LEFT JOIN (SELECT row_no, col_no, depth AS v FROM cells WHERE depth > 25) AS b
  ON b.row_no BETWEEN a.row_no - 2 AND a.row_no + 2 AND b.col_no BETWEEN a.col_no - 2 AND a.col_no + 2 GROUP BY 1, 2""", "cells"))
def g16_fill_focal(spark, sf):
    c = cells(spark, sf)
    return G.fill_focal(c.filter("depth > 25").select("row_no", "col_no", F.col("depth").alias("v")), c.select("row_no", "col_no"), "v", [5], 4096, 64).select("row_no", "col_no", "v")


_FILL = "SELECT a.row_no, a.col_no, coalesce(any_value(a.v), round_even(avg(b.v), 0)) AS v FROM {of} AS a LEFT JOIN {of} AS b ON b.v IS NOT NULL AND b.v <> 0 AND b.row_no BETWEEN a.row_no - {r} AND a.row_no + {r} AND b.col_no BETWEEN a.col_no - {r} AND a.col_no + {r} GROUP BY 1, 2"


@plan(oracle(_FILL.format(of=f"({_FILL.format(of='(SELECT row_no, col_no, CASE WHEN depth > 47 THEN depth WHEN depth = 20 THEN 0 END AS v FROM cells)', r=1)})", r=3), "cells"))
def g16_fill_focal_passes(spark, sf):
    """Two windows: what the first fills is a source of the second; zeros are values, but no sources."""
    c = cells(spark, sf)
    known = c.filter("depth > 47 OR depth = 20").select("row_no", "col_no", F.when(F.col("depth") > 47, F.col("depth")).otherwise(0.0).alias("v"))
    return G.fill_focal(known, c.select("row_no", "col_no"), "v", [3, 7], 4096, 64).select("row_no", "col_no", "v")


@plan(oracle("""SELECT row_no, col_no, v FROM (SELECT a.row_no, a.col_no, b.depth AS v, row_number() OVER (PARTITION BY a.row_no, a.col_no ORDER BY (b.row_no - a.row_no) * (b.row_no - a.row_no) + (b.col_no - a.col_no) * (b.col_no - a.col_no), b.row_no, b.col_no) AS k
  FROM (SELECT row_no, col_no FROM cells) AS a, (SELECT row_no, col_no, depth FROM cells WHERE depth > 45) AS b) AS z WHERE k = 1""", "cells"))
def g17_fill_nearest(spark, sf):
    c = cells(spark, sf)
    return G.fill_nearest(c.filter("depth > 45").select("row_no", "col_no", F.col("depth").alias("v")), c, "v")


@plan(oracle("SELECT cell_id, CASE WHEN depth > 10 THEN coalesce(CASE WHEN field > 2 THEN field END, 20) END AS field FROM cells", "cells"))
def g18_fill_default(spark, sf):
    return cells(spark, sf).select("cell_id", G.fill_default(F.when(F.col("field") > 2, F.col("field")), 20.0, F.col("depth") > 10).alias("field"))


@plan(oracle("SELECT cell_id, CAST(CASE WHEN depth <= 15 THEN 10 WHEN depth <= 25 THEN 20 WHEN depth <= 35 THEN 30 WHEN depth <= 45 THEN 40 ELSE 50 END AS DOUBLE) AS category FROM cells", "cells"))
def g19_snap_to_categories(spark, sf):
    return cells(spark, sf).select("cell_id", G.snap_to_categories(F.col("depth")).alias("category"))


# Polygons: a slanted quadrangle and a triangle for each nation.
EDGES = """edges AS (SELECT CAST(n_nationkey AS BIGINT) AS polygon_id, CAST(n_nationkey AS BIGINT) AS country_code, x1 + CAST(n_nationkey % 5 AS DOUBLE) * 11 AS x1, y1 + floor(n_nationkey / 5.0) * 9 AS y1, x2 + CAST(n_nationkey % 5 AS DOUBLE) * 11 AS x2, y2 + floor(n_nationkey / 5.0) * 9 AS y2
  FROM nation, (VALUES (1.2, 0.7, 13.4, 2.9), (13.4, 2.9, 9.1, 11.3), (9.1, 11.3, 2.6, 8.2), (2.6, 8.2, 1.2, 0.7)) AS v(x1, y1, x2, y2))"""
SHAPE = [(1.2, 0.7, 13.4, 2.9), (13.4, 2.9, 9.1, 11.3), (9.1, 11.3, 2.6, 8.2), (2.6, 8.2, 1.2, 0.7)]
INSIDE = "SELECT {keys}, polygon_id, country_code FROM {points}, edges WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1"


def edges(spark, sf):
    shape = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), e)]) for e in SHAPE]))
    dx, dy = F.col("n_nationkey") % 5 * 11.0, F.floor(F.col("n_nationkey") / 5) * 9.0
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf, "nation").select("n_nationkey", shape.alias("e")).select(key.alias("polygon_id"), key.alias("country_code"), (F.col("e.a") + dx).alias("x1"), (F.col("e.b") + dy).alias("y1"), (F.col("e.c") + dx).alias("x2"), (F.col("e.d") + dy).alias("y2"))


BOX = G.Grid(0.0, 64.0, 0.0, 64.0, 1.0)


@plan(f"WITH {EDGES}, p AS (SELECT r AS row_no, c AS col_no, c + 0.5 AS px, 64 - (r + 0.5) AS py FROM range(64) AS a(r), range(64) AS b(c)) SELECT row_no, col_no, nullif(arg_max(country_code, polygon_id), 0) AS country_code FROM ({INSIDE.format(keys='row_no, col_no', points='p')}) AS z GROUP BY 1, 2 HAVING arg_max(country_code, polygon_id) <> 0")
def g20_allocate_country(spark, sf):
    return G.allocate_country(edges(spark, sf), BOX)


@plan("SELECT CAST(n_regionkey AS INTEGER) AS region, arg_min(n_name, n_nationkey) AS name, count(*) AS n_parts FROM nation GROUP BY 1")
def g21_dissolve(spark, sf):
    return G.dissolve(table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("part_id")), "region", ["name"])


_OUTLINE = """, q AS (SELECT (row_no // 4 + col_no // 16) % 5 AS country, row_no AS r, col_no AS c FROM cells WHERE row_no % 2 = 0
  UNION ALL SELECT (row_no // 4 + col_no // 16) % 5, row_no, col_no + d FROM cells, range(2) AS t(d) WHERE row_no % 2 = 1 AND col_no % 2 = 0),
u AS (SELECT country, upright, line, a FROM (SELECT country, false AS upright, r AS line, c AS a FROM q UNION ALL SELECT country, false, r + 1, c FROM q UNION ALL SELECT country, true, c, r FROM q UNION ALL SELECT country, true, c + 1, r FROM q) AS z
  GROUP BY ALL HAVING count(*) % 2 = 1),
m AS (SELECT country, upright, line, min(a) AS a, max(a) + 1 AS b FROM (SELECT *, a - row_number() OVER (PARTITION BY country, upright, line ORDER BY a) AS g FROM u) AS z GROUP BY country, upright, line, g)
SELECT country, CAST(CASE WHEN upright THEN line ELSE a END AS DOUBLE) AS x1, CAST(CASE WHEN upright THEN a ELSE line END AS DOUBLE) AS y1, CAST(CASE WHEN upright THEN line ELSE b END AS DOUBLE) AS x2, CAST(CASE WHEN upright THEN b ELSE line END AS DOUBLE) AS y2 FROM m"""


@plan(oracle("", "cells").strip() + _OUTLINE)
def g21_dissolve_outline(spark, sf):
    """Cells as parts of blocks of country: unit squares in even rows, boxes of two cells in odd ones, whose long edges go against two short ones."""
    c = cells(spark, sf).filter("row_no % 2 = 0 OR col_no % 2 = 0")
    wide = F.when(F.col("row_no") % 2 == 1, 2).otherwise(1)
    x1, y1, x2, y2 = (k.cast("double") for k in (F.col("col_no"), F.col("row_no"), F.col("col_no") + wide, F.col("row_no") + 1))
    sides = F.array(*[F.struct(a.alias("x1"), b.alias("y1"), d.alias("x2"), e.alias("y2")) for a, b, d, e in ((x1, y1, x2, y1), (x2, y1, x2, y2), (x2, y2, x1, y2), (x1, y2, x1, y1))])
    country = (F.floor(F.col("row_no") / 4) + F.floor(F.col("col_no") / 16)) % 5
    return G.dissolve_outline(c.select(country.alias("country"), F.explode(sides).alias("e")).select("country", "e.*"), "country")


@plan("SELECT iso3, CAST(dense_rank() OVER (ORDER BY iso3) AS INTEGER) AS code FROM (SELECT DISTINCT substr(n_name, 1, 3) AS iso3 FROM nation) AS z")
def g22_assign_codes(spark, sf):
    return G.assign_codes(table(spark, sf, "nation").select(F.substring("n_name", 1, 3).alias("iso3")))


@plan("""SELECT iso3, CASE level WHEN 'L' THEN 1 WHEN 'LM' THEN 2 WHEN 'UM' THEN 3 WHEN 'H' THEN 4 END AS income_code FROM (SELECT upper(substr(c_mktsegment, 1, 3)) || '' AS iso3, 2000 + c_custkey % 21 AS year,
  CASE c_nationkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'LM' WHEN 2 THEN 'UM' WHEN 3 THEN 'H' END AS level, c_custkey FROM customer) AS z WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY iso3 ORDER BY abs(year - 2010), year, c_custkey) = 1""")
def g23_income_levels(spark, sf):
    c = table(spark, sf, "customer")
    level = F.element_at(F.array(F.lit("L"), F.lit("LM"), F.lit("UM"), F.lit("H"), F.lit(None)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    rows = c.select(F.upper(F.substring("c_mktsegment", 1, 3)).alias("iso3"), (2000 + F.col("c_custkey") % 21).alias("year"), level.alias("level"), "c_custkey")
    one = rows.filter("level IS NOT NULL").groupBy("iso3", "year").agg(F.min_by("level", "c_custkey").alias("level"))
    return G.income_levels(one)


@plan(oracle("SELECT cell_id, CASE WHEN code >= 3 THEN 400 END AS high FROM cells LEFT JOIN (SELECT CAST(n_nationkey + 1 AS BIGINT) AS country_code, n_regionkey AS code FROM nation WHERE n_nationkey <> 7) AS i USING (country_code)", "cells"))
def g24_high_income_mask(spark, sf):
    income = table(spark, sf, "nation").filter("n_nationkey <> 7").select((F.col("n_nationkey") + 1).cast("long").alias("country_code"), F.col("n_regionkey").alias("income_code"))
    return G.high_income_mask(cells(spark, sf).select("cell_id", "country_code"), income).select("cell_id", "high")


@plan(f"WITH {EDGES}, p AS (SELECT p_partkey AS point_id, CAST((p_partkey * 37) % 640 AS DOUBLE) / 10 + 0.03 AS px, CAST((p_partkey * 91) % 640 AS DOUBLE) / 10 + 0.07 AS py FROM part) SELECT p.point_id, c AS country_code FROM p LEFT JOIN (SELECT point_id, arg_max(country_code, polygon_id) AS c FROM ({INSIDE.format(keys='point_id', points='p')}) AS z GROUP BY 1) AS w USING (point_id)")
def g25_points_within(spark, sf):
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), ((F.col("p_partkey") * 37 % 640).cast("double") / 10 + 0.03).alias("x"), ((F.col("p_partkey") * 91 % 640).cast("double") / 10 + 0.07).alias("y"))
    return G.points_within(points, edges(spark, sf), 8.0).select("point_id", "country_code")


@plan(oracle("SELECT event_id FROM obs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' AND cloudy_pct < 60", "obs"))
def r1_filter_scenes(spark, sf):
    from datetime import datetime

    return R.filter_scenes(obs(spark, sf), datetime(2024, 1, 5), datetime(2024, 1, 15), 60).select("event_id")


@plan(oracle("SELECT o.event_id, q.cs_cdf FROM obs o LEFT JOIN (SELECT scene_id, pixel_id, cs_cdf FROM obs WHERE scl <> 3) AS q USING (scene_id, pixel_id)", "obs"))
def r2_link_quality(spark, sf):
    o = obs(spark, sf)
    return R.link_quality(o.drop("cs_cdf"), o.filter("scl <> 3"), ["scene_id", "pixel_id"]).select("event_id", "cs_cdf")


def _profiles_sql() -> str:
    cases = " UNION ALL ".join(
        f"SELECT '{n}' AS profile, count(*) AS n, sum(value) AS total FROM obs WHERE cs_cdf >= {least} AND scl {'IN' if keep else 'NOT IN'} {(keep or drop) if len(keep or drop) > 1 else f'({(keep or drop)[0]})'}" for n, (least, keep, drop) in R.PROFILES.items()
    )
    return oracle(cases, "obs", doubles="total", digits=3)


@plan(_profiles_sql())
def r3_mask_pixels(spark, sf):
    o, out = obs(spark, sf), None
    for n in R.PROFILES:
        one = R.mask_pixels(o, n).agg(F.lit(n).alias("profile"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@plan(oracle("SELECT event_id FROM obs WHERE pixel_id % 4 = 0", "obs"))
def r4_mask_cropland(spark, sf):
    o = obs(spark, sf)
    cover = o.select("pixel_id").distinct().withColumn("cover", F.when(F.col("pixel_id") % 4 == 0, 40).otherwise(10))
    return R.mask_cropland(o, cover).select("event_id")


@plan("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax + l_discount <> 0 THEN greatest(-1, least(1, (l_tax - l_discount) / (l_tax + l_discount))) END AS nd, CAST(CASE WHEN l_tax + l_discount <> 0 THEN round_even(greatest(-1, least(1, (l_tax - l_discount) / (l_tax + l_discount))) * 10000, 0) END AS INTEGER) AS nd_int FROM lineitem""".replace("greatest(-1, least(1, (l_tax - l_discount) / (l_tax + l_discount))) END AS nd,", "round(greatest(-1, least(1, (l_tax - l_discount) / (l_tax + l_discount))), 6) END AS nd,"))
def r5_normalized_difference(spark, sf):
    a, b = F.col("l_tax"), F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.normalized_difference(a, b).alias("nd"), R.normalized_difference(a, b, 10_000).alias("nd_int"))


@plan("SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax / nullif(l_discount, 0), 6) AS sti FROM lineitem")
def r6_ratio_index(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.ratio_index(F.col("l_tax"), F.col("l_discount")).alias("sti"))


@plan(oracle("SELECT user_id, count(value) AS valid_pixels FROM obs GROUP BY 1 HAVING count(value) > 5", "obs"))
def r7_valid_pixel_count(spark, sf):
    return R.valid_pixel_count(obs(spark, sf), "user_id", "value", 5)


@plan(oracle("SELECT tile_id, user_id AS best_scene FROM (SELECT tile_id, user_id, count(value) AS n FROM obs GROUP BY 1, 2) AS z QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, user_id) = 1", "obs"))
def r8_best_scene(spark, sf):
    counts = obs(spark, sf).groupBy("tile_id", "user_id").agg(F.count("value").alias("valid_pixels"))
    return R.best_scene(counts, "tile_id", "user_id")


@plan("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 10000, 6) AS b8, round(l_extendedprice / 10000, 6) AS b4, round(l_tax / 10000, 6) AS b3 FROM lineitem")
def r9_scale_bands(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"b8": F.col("l_quantity"), "b4": F.col("l_extendedprice"), "b3": F.col("l_tax")})
    return R.scale_bands(li, "false_colour", ["l_orderkey", "l_linenumber", "l_partkey"])


@plan("SELECT event_id, CAST(floor(epoch_us(ts) / 86400000000.0 + 40587) AS BIGINT) AS mjd_day, CAST(floor(epoch_us(ts) / 86400000000.0 + 40587 - 58484 + 1) AS BIGINT) AS doy, CAST((floor(epoch_us(ts) / 86400000000.0 + 40587) - 40587) * 86400000 AS BIGINT) AS day_ms FROM events")
def r10_to_mjd(spark, sf):
    mjd = R.to_mjd(F.col("ts"))
    return table(spark, sf, "events").select("event_id", F.floor(mjd).alias("mjd_day"), F.floor(R.mjd_to_doy(mjd)).alias("doy"), R.mjd_to_ms(F.floor(mjd)).alias("day_ms"))


@plan(oracle("SELECT cell_id, lon - 500 / (111320 * cos(radians(lat))) AS west, lat - 250 / 110540.0 AS south, lon + 500 / (111320 * cos(radians(lat))) AS east, lat + 250 / 110540.0 AS north FROM (SELECT cell_id, CAST(col_no AS DOUBLE) AS lon, depth AS lat FROM cells) AS z", "cells", doubles="west south east north"))
def r11_aoi_box(spark, sf):
    box = R.aoi_box(F.col("col_no").cast("double"), F.col("depth"), 1000, 500)
    return cells(spark, sf).select("cell_id", *[c.alias(n) for c, n in zip(box, ("west", "south", "east", "north"))])


CORNERS = [(3.3, 2.2), (40.1, 5.5), (55.7, 30.3), (30.2, 20.1), (8.4, 44.6)]


@plan(oracle("SELECT cell_id, (" + " + ".join(f"CASE WHEN ({y1} > depth) <> ({y2} > depth) AND col_no < ({x2} - {x1}) * (depth - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(CORNERS, CORNERS[1:] + CORNERS[:1])) + ") % 2 = 1 AS inside FROM cells", "cells"))
def r12_in_polygon(spark, sf):
    return cells(spark, sf).select("cell_id", R.in_polygon(F.col("col_no"), F.col("depth"), CORNERS).alias("inside"))


@plan(oracle("SELECT cell_id, CASE WHEN depth >= 25 THEN 'N' ELSE 'S' END || CASE WHEN col_no < 32 THEN 'W' ELSE 'E' END AS quadrant FROM cells", "cells"))
def r13_quadrant_of(spark, sf):
    return cells(spark, sf).select("cell_id", R.quadrant_of(F.col("col_no"), F.col("depth"), 32, 25).alias("quadrant"))


COMPOSITE = """comp AS (SELECT pixel_id, bin, avg(value) AS mean, any_value(mjd) AS mjd FROM (SELECT *, CAST(floor(datediff('day', DATE '2024-01-02', CAST(ts AS DATE)) / 3.0) AS BIGINT) AS bin FROM obs) AS o
  JOIN (SELECT bin, avg(m) AS mjd FROM (SELECT DISTINCT CAST(floor(datediff('day', DATE '2024-01-02', CAST(ts AS DATE)) / 3.0) AS BIGINT) AS bin, epoch_us(ts) / 86400000000.0 + 40587 AS m FROM obs) AS d GROUP BY 1) AS t USING (bin) WHERE bin >= 0 GROUP BY 1, 2)"""


def with_obs(*steps: str, body: str, doubles: str = "", digits: int = 6) -> str:
    head = ", ".join([oracle("", "obs").strip(), *steps])
    return f"{head} SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in doubles.split())}) FROM ({body}) AS body" if doubles else f"{head} {body}"


def composite(spark, sf):
    return P.temporal_composite(obs(spark, sf), "2024-01-02", 3)


@plan(with_obs(COMPOSITE, body="SELECT bin, pixel_id, mean, mjd FROM comp", doubles="mean mjd"))
def r20_temporal_composite(spark, sf):
    return composite(spark, sf).select("bin", "pixel_id", "mean", "mjd")


@plan(oracle("SELECT pixel_id, avg(value) AS mean FROM obs GROUP BY 1", "obs", doubles="mean"))
def r21_mean_composite(spark, sf):
    return P.mean_composite(obs(spark, sf), "value")


@plan(oracle("SELECT pixel_id, quantile_cont(value, 0.5) AS median FROM obs GROUP BY 1", "obs", doubles="median"))
def r21_median_composite(spark, sf):
    return P.median_composite(obs(spark, sf), "value")


@plan(oracle("SELECT pixel_id, event_id, ts, value FROM obs QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY value DESC, ts, event_id) = 1", "obs", doubles="value"))
def r22_quality_mosaic(spark, sf):
    return P.quality_mosaic(obs(spark, sf).select("pixel_id", "event_id", "ts", "value"), "value")


@plan(oracle("SELECT pixel_id, event_id, ts, value, ndti FROM (SELECT *, CASE WHEN scl > 3 THEN cs_cdf END AS ndti FROM obs) AS z WHERE value < 35 AND ndti IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY value, ts, event_id) = 1", "obs", doubles="value"))
def r23_barest_observation(spark, sf):
    o = obs(spark, sf).withColumn("ndti", F.when(F.col("scl") > 3, F.col("cs_cdf")))
    return P.barest_observation(o.select("pixel_id", "event_id", "ts", "value", "ndti"), "value", "ndti", 35)


@plan(oracle("""SELECT p.pixel_id, coalesce(d, DATE '2023-05-15') AS barest_date FROM (SELECT DISTINCT pixel_id FROM obs) AS p LEFT JOIN (SELECT pixel_id, CAST(t AS DATE) AS d FROM (SELECT pixel_id, user_id, avg(value) AS m, min(ts) AS t FROM obs GROUP BY 1, 2) AS z
  WHERE m > 40 QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY m, user_id) = 1) AS b USING (pixel_id)""", "obs"))
def r24_barest_date(spark, sf):
    o = obs(spark, sf)
    return P.barest_date(o.select("pixel_id").distinct(), o, "pixel_id", "user_id", "value", "ts", 40)


@plan(oracle("""SELECT pixel_id, first(m ORDER BY value DESC, ts, event_id) AS peak_time, first(m ORDER BY value, ts, event_id) AS min_time, avg(m) AS mean_time, avg(value) AS mean_value FROM (SELECT *, epoch_us(ts) / 86400000000.0 + 40587 AS m FROM obs) AS z GROUP BY 1""", "obs", doubles="peak_time min_time mean_time mean_value"))
def r25_phenology_metrics(spark, sf):
    return P.phenology_metrics(obs(spark, sf), "value")


SEASON = "CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END"


@plan(f"SELECT o_orderkey, {SEASON} AS season FROM orders")
def r26_season_of(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.season_of(F.col("o_orderdate")).alias("season"))


SEASONAL = f"SELECT season, avg(m) AS mean, min(m) AS least, max(m) AS largest, stddev_pop(m) AS std FROM (SELECT {SEASON} AS season, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) AS z GROUP BY 1"


@plan(f"SELECT season, round(mean, 4) AS mean, round(least, 4) AS least, round(largest, 4) AS largest, round(std, 4) AS std, scenes FROM ({SEASONAL}) AS a JOIN (SELECT {SEASON} AS season, count(DISTINCT o_orderkey) AS scenes FROM orders GROUP BY 1) AS b USING (season)")
def r27_seasonal_stats(spark, sf):
    out = P.seasonal_stats(table(spark, sf, "orders"), P.season_of(F.col("o_orderdate")), "o_totalprice", "o_custkey", "o_orderkey")
    return out.select("season", *[F.round(c, 4).alias(c) for c in ("mean", "least", "largest", "std")], "scenes")


@plan(f"SELECT o_orderstatus AS region, round(s, 4) AS spring, round(a, 4) AS autumn, round(abs(s - a), 4) AS difference FROM (SELECT o_orderstatus, coalesce(avg(CASE WHEN season = 'spring' THEN v END), 0) AS s, coalesce(avg(CASE WHEN season = 'autumn' THEN v END), 0) AS a FROM (SELECT o_orderstatus, {SEASON} AS season, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) AS z GROUP BY 1) AS y")
def r28_region_comparison(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("region"), P.season_of(F.col("o_orderdate")).alias("season"), "o_totalprice")
    out = P.region_comparison(o.groupBy("region", "season").agg(F.avg("o_totalprice").alias("mean")))
    return out.select("region", *[F.round(c, 4).alias(c) for c in ("spring", "autumn", "difference")])


EXTREMA = "SELECT event_type, avg(m) AS mean, avg(lo) AS mean_min, avg(hi) AS mean_max, stddev_pop(m) AS std, count(*) AS pixels FROM (SELECT event_type, pixel_id, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1, 2) AS z GROUP BY 1"


@plan(oracle(EXTREMA, "obs", doubles="mean mean_min mean_max std"))
def r29_extrema_stats(spark, sf):
    return P.extrema_stats(obs(spark, sf), "value", ["event_type"])


HISTOGRAM = "SELECT k AS bin, CAST(k * 5.0 AS DOUBLE) AS lower, coalesce(n, 0) AS n FROM range(40) AS r(k) LEFT JOIN (SELECT CAST(floor(value / 5.0) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE value >= 0 AND value < 200 GROUP BY 1) AS c ON c.bin = k"


@plan(oracle(HISTOGRAM, "obs", doubles="lower"))
def r30_fixed_histogram(spark, sf):
    return P.fixed_histogram(obs(spark, sf), "value", 0.0, 200.0, 40)


BREAKS = [0.0, 10.0, 25.0, 50.0, 100.0, 150.0, 200.0]
BREAK_VALUES = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(zip(BREAKS, BREAKS[1:])))


@plan(oracle(f"SELECT CAST(class AS BIGINT) AS class, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (VALUES {BREAK_VALUES}) AS e(class, lo, hi) LEFT JOIN ({HISTOGRAM}) AS h ON lower >= lo AND lower < hi GROUP BY 1, 2, 3", "obs"))
def r31_rebin(spark, sf):
    return P.rebin(P.fixed_histogram(obs(spark, sf), "value", 0.0, 200.0, 40), BREAKS)


@plan(oracle(f"SELECT CAST(class AS BIGINT) AS class, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(value) AS n FROM (VALUES {BREAK_VALUES}) AS e(class, lo, hi) LEFT JOIN obs ON value >= lo AND (value < hi OR (class = 5 AND value = hi)) GROUP BY 1, 2, 3", "obs"))
def r32_truth_histogram(spark, sf):
    return P.truth_histogram(obs(spark, sf), "value", BREAKS)


@plan(oracle("SELECT statistic, first, second, abs(first - second) AS difference FROM (SELECT 'mean' AS statistic, avg(value) FILTER (WHERE scl < 6) AS first, avg(value) FILTER (WHERE scl >= 6) AS second FROM obs UNION ALL SELECT 'largest', max(value) FILTER (WHERE scl < 6), max(value) FILTER (WHERE scl >= 6) FROM obs) AS z", "obs", doubles="first second difference"))
def r33_compare_stats(spark, sf):
    stats = lambda w: obs(spark, sf).filter(w).agg(F.avg("value").alias("mean"), F.max("value").alias("largest"))
    return P.compare_stats(stats("scl < 6"), stats("scl >= 6"), ["mean", "largest"])


REGIONS = "SELECT tile_id, avg(value) AS mean, min(value) AS least, max(value) AS largest, stddev_pop(value) AS std, count(*) AS images FROM obs GROUP BY 1"


@plan(oracle(f"SELECT avg(mean) AS mean, min(least) AS least, max(largest) AS largest, avg(std) AS std, CAST(sum(images) AS BIGINT) AS images, count(*) AS regions FROM ({REGIONS}) AS z", "obs", doubles="mean least largest std"))
def r34_combine_regions(spark, sf):
    per = obs(spark, sf).groupBy("tile_id").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"), F.stddev_pop("value").alias("std"), F.count("*").alias("images"))
    return P.combine_regions(per)


@plan(oracle(f"SELECT bin, CAST(2 * n AS BIGINT) AS n FROM ({HISTOGRAM}) AS h", "obs"))
def r35_sum_histograms(spark, sf):
    h = P.fixed_histogram(obs(spark, sf), "value", 0.0, 200.0, 40)
    return P.sum_histograms(h.unionByName(h))


@plan(oracle(f"SELECT event_id, CAST(class AS BIGINT) AS class FROM obs LEFT JOIN (VALUES {BREAK_VALUES}) AS e(class, lo, hi) ON value >= lo AND value < hi", "obs"))
def r36_class_breaks(spark, sf):
    return P.class_breaks(obs(spark, sf), "value", BREAKS).select("event_id", "class")


@plan(oracle("SELECT i, j, depth AS value FROM (SELECT i, j, CAST(floor((i + 0.5) * 64 / 10.0) AS BIGINT) AS r, CAST(floor((j + 0.5) * 64 / 10.0) AS BIGINT) AS c FROM range(10) AS a(i), range(10) AS b(j)) AS g LEFT JOIN cells ON row_no = r AND col_no = c", "cells"))
def r37_grid_sample(spark, sf):
    return P.grid_sample(cells(spark, sf).withColumn("value", F.col("depth")), 64, 64, 100).select("i", "j", "value")


CLUSTERS = """means AS (SELECT pixel_id, avg(value) AS m FROM obs GROUP BY 1), span AS (SELECT min(m) AS lo, max(m) AS hi FROM means),
clus AS (SELECT pixel_id, m, CAST(CASE WHEN hi > lo THEN greatest(0, least(floor((m - lo) / ((hi - lo) / 6)), 5)) ELSE 0 END AS BIGINT) AS cluster FROM means, span)"""
SERIES = "ser AS (SELECT cluster, bin, avg(mean) AS mean, stddev_pop(mean) AS std, quantile_cont(mean, 0.05) AS p05, quantile_cont(mean, 0.25) AS p25, quantile_cont(mean, 0.75) AS p75, quantile_cont(mean, 0.95) AS p95, count(*) AS n FROM comp JOIN clus USING (pixel_id) GROUP BY 1, 2)"
LOW = """runs AS (SELECT cluster, bin * 3 AS doy, mean < 49 AS low, sum(CASE WHEN (mean < 49) IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(mean < 49) OVER (PARTITION BY cluster ORDER BY bin) AS prev FROM ser) AS z),
lows AS (SELECT cluster, min(doy) AS start, max(doy) AS "end" FROM runs WHERE low GROUP BY cluster, run HAVING max(doy) - min(doy) >= 3)"""


def clusters(spark, sf):
    return K.equal_width_clusters(obs(spark, sf).groupBy("pixel_id").agg(F.avg("value").alias("m")), "m", 6)


def series(spark, sf):
    return K.cluster_timeseries(composite(spark, sf), clusters(spark, sf))


def by_day(spark, sf):
    return series(spark, sf).select("cluster", (F.col("bin") * 3).alias("doy"), "mean")


@plan(with_obs(CLUSTERS, body="SELECT pixel_id, cluster FROM clus"))
def k1_equal_width_clusters(spark, sf):
    return clusters(spark, sf).select("pixel_id", "cluster")


@plan(with_obs(CLUSTERS, body="SELECT cluster, count(*) AS pixels FROM clus GROUP BY 1"))
def k2_cluster_sizes(spark, sf):
    return K.cluster_sizes(clusters(spark, sf))


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, body="SELECT * FROM ser", doubles="mean std p05 p25 p75 p95", digits=9), digits=9)  # interpolated means of hundredths: fewer digits would meet halves
def k3_cluster_timeseries(spark, sf):
    return series(spark, sf)


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, body="""SELECT cluster, CAST(doy AS DOUBLE) AS doy, mean FROM (SELECT cluster, bin * 3 AS doy, mean, lag(mean) OVER (PARTITION BY cluster ORDER BY bin) AS a, lead(mean) OVER (PARTITION BY cluster ORDER BY bin) AS b FROM ser) AS z WHERE mean > a AND mean > b""", doubles="mean"))
def k4_detect_peaks(spark, sf):
    return K.detect_peaks(by_day(spark, sf), prominence=0.0, distance=1).select("cluster", "doy", "mean")


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, LOW, body="SELECT * FROM lows"))
def k5_low_periods(spark, sf):
    return K.low_periods(by_day(spark, sf), 49, 3)


PEAKS = "tops AS (SELECT cluster, count(*) AS peaks FROM (SELECT cluster, mean, lag(mean) OVER w AS a, lead(mean) OVER w AS b FROM ser WINDOW w AS (PARTITION BY cluster ORDER BY bin)) AS z WHERE mean > a AND mean > b GROUP BY 1)"
NAME = "CASE coalesce(peaks, 0) WHEN 0 THEN 'no pattern' WHEN 1 THEN 'annual' WHEN 2 THEN 'biannual' ELSE 'multiple' END"
SEASONAL_CLUSTERS = f"{PEAKS}, seas AS (SELECT cluster, points, value_range, coalesce(peaks, 0) AS peaks, points >= 3 AND value_range >= 0.1 AND coalesce(peaks, 0) <= 3 AS seasonal FROM (SELECT cluster, count(mean) AS points, max(mean) - min(mean) AS value_range FROM ser GROUP BY 1) AS y LEFT JOIN tops USING (cluster))"


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, SEASONAL_CLUSTERS, body=f"SELECT cluster, {NAME} AS pattern FROM seas"))
def k6_seasonality(spark, sf):
    return K.is_seasonal(by_day(spark, sf), most_peaks=3, prominence=0.0).select("cluster", K.seasonality(F.col("peaks")).alias("pattern"))


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, SEASONAL_CLUSTERS, body="SELECT * FROM seas", doubles="value_range"))
def k7_is_seasonal(spark, sf):
    return K.is_seasonal(by_day(spark, sf), most_peaks=3, prominence=0.0)


FILTERED = f"""filt AS (SELECT cluster, pixels, pattern, seasonal, CASE WHEN pixels < 5 THEN 'too small' WHEN pattern = 'no pattern' THEN 'no pattern' WHEN pixels < 25 AND NOT seasonal THEN 'not seasonal' END AS reason FROM (SELECT cluster, pixels, {NAME} AS pattern, seasonal FROM seas JOIN (SELECT cluster, count(*) AS pixels FROM clus GROUP BY 1) AS s USING (cluster)) AS z)"""


def filtered(spark, sf):
    marked = K.is_seasonal(by_day(spark, sf), most_peaks=3, prominence=0.0).select("cluster", K.seasonality(F.col("peaks")).alias("pattern"), "seasonal")
    return K.filter_clusters(K.cluster_sizes(clusters(spark, sf)).join(marked, "cluster"), 5, 25)


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, SEASONAL_CLUSTERS, FILTERED, body="SELECT *, (SELECT 100.0 * sum(CASE WHEN reason IS NOT NULL THEN pixels ELSE 0 END) / sum(pixels) FROM filt) AS removed_percent FROM filt", doubles="removed_percent"))
def k8_filter_clusters(spark, sf):
    return filtered(spark, sf).select("cluster", "pixels", "pattern", "seasonal", "reason", "removed_percent")


WINDOW = """lg AS (SELECT cluster, pixels / total AS weight FROM (SELECT cluster, count(*) AS pixels FROM clus GROUP BY 1) AS s, (SELECT CAST(count(*) AS DOUBLE) AS total FROM clus) AS t WHERE pixels > 0.05 * total),
per AS (SELECT * FROM lows JOIN lg USING (cluster)), votes AS (SELECT round_even(start / 10.0, 0) * 10 AS s, round_even("end" / 10.0, 0) * 10 AS e, count(*) AS cluster_count, sum(weight) AS pixel_weight, avg("end" - start) AS avg_duration, min((cluster, start)) AS f FROM per GROUP BY 1, 2),
best AS (SELECT *, (e - s) * pixel_weight * cluster_count AS score FROM votes WHERE e - s > 5 AND (e - s) * pixel_weight * cluster_count > 0 ORDER BY score DESC, f LIMIT 1)"""


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, LOW, WINDOW, body="""SELECT CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end", score, avg_duration, cluster_count, pixel_weight, coalesce((SELECT string_agg(DISTINCT CAST(cluster AS VARCHAR), ',' ORDER BY CAST(cluster AS VARCHAR)) FROM per WHERE abs(start - s) < 15 AND abs("end" - e) < 15), '') AS clusters FROM best""", doubles="score avg_duration pixel_weight"))
def k9_tillage_window(spark, sf):
    out = K.tillage_window(by_day(spark, sf), K.cluster_sizes(clusters(spark, sf)), 49, 3, least_width=5)
    return out.withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})


@plan(with_obs(COMPOSITE, CLUSTERS, SERIES, SEASONAL_CLUSTERS, FILTERED, body="SELECT pattern, count(*) AS clusters FROM filt WHERE reason IS NULL GROUP BY 1"))
def k10_pattern_counts(spark, sf):
    return K.pattern_counts(filtered(spark, sf))


@plan(oracle("SELECT row_no AS tile_id, 100 * avg(CASE WHEN depth > 25 THEN 1.0 ELSE 0.0 END) AS percent FROM cells GROUP BY 1 HAVING 100 * avg(CASE WHEN depth > 25 THEN 1.0 ELSE 0.0 END) > 45", "cells", doubles="percent"))
def k11_arable_tiles(spark, sf):
    return K.arable_tiles(cells(spark, sf).select(F.col("row_no").alias("tile_id"), F.when(F.col("depth") > 25, 40).otherwise(10).alias("cover")), 45.0)


@plan(oracle("SELECT xmin, ymin, count(cell_id) AS n FROM (SELECT CAST(5 * a - 180 AS BIGINT) AS xmin, CAST(5 * b - 55 AS BIGINT) AS ymin FROM range(72) AS x(a), range(25) AS y(b)) AS t LEFT JOIN cells ON floor(col_no / 5.0) * 5 = xmin AND floor(depth / 5) * 5 = ymin GROUP BY 1, 2", "cells"))
def k12_tile_grid(spark, sf):
    tiles = K.tile_grid(spark)
    at = cells(spark, sf).select("cell_id", (F.floor(F.col("col_no") / 5) * 5).alias("xmin"), (F.floor(F.col("depth") / 5) * 5).alias("ymin"))
    return tiles.join(at, ["xmin", "ymin"], "left").groupBy("xmin", "ymin").agg(F.count("cell_id").alias("n"))


@plan()
def k13_two_pass_kmeans(spark, sf):
    rows = obs(spark, sf).select("tile_id", "event_id", R.to_mjd(F.col("ts")).alias("mjd"))
    out = K.two_pass_kmeans(rows, "mjd", least1=50)
    return out.groupBy("tile_id", "cluster").agg(F.count("*").alias("n"), F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"))
