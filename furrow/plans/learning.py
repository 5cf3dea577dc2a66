"""Queries of the training-data, metric, model and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import applied as AP
from furrow.operators import boosting as B
from furrow.operators import metrics as E
from furrow.operators import models as L
from furrow.operators import neighbours as N
from furrow.operators import tillage as C
from furrow.operators import training as M
from furrow.plans.base import oracle, plan, view
from furrow.plans.land import GROUPED, classes, upto
from furrow.session import stored, table

LABELS = ("conservation", "conventional", "traditional")
SOFT = f"""soft AS (SELECT cell_id, coalesce(conservation / nullif(t, 0), 0) AS conservation, coalesce(conventional / nullif(t, 0), 0) AS conventional, coalesce(traditional / nullif(t, 0), 0) AS traditional FROM (SELECT cell_id,
  coalesce(sum(group_area) FILTER (WHERE class_group = 'conservation'), 0) AS conservation, coalesce(sum(group_area) FILTER (WHERE class_group = 'conventional'), 0) AS conventional,
  coalesce(sum(group_area) FILTER (WHERE class_group = 'traditional'), 0) AS traditional, coalesce(sum(group_area), 0) AS t FROM ({GROUPED}) AS g GROUP BY 1) AS z)"""


def soft(spark, sf):
    return M.soft_labels(C.group_classes(C.long_classes(classes(spark, sf))), LABELS)


def with_soft(body: str, doubles: str = "") -> str:
    text = upto("cls", "@")
    inner = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({body}) AS body" if doubles else body
    return text.replace(" @", f", {SOFT} {inner}")


@plan(with_soft("SELECT * FROM soft", " ".join(LABELS)))
def m1_soft_labels(spark, sf):
    return soft(spark, sf)


@plan(oracle("SELECT row_no, col_no, focal_mean FROM (SELECT a.row_no, a.col_no, avg(b.v) AS focal_mean FROM cells a JOIN (SELECT row_no, col_no, CASE WHEN depth > 25 THEN 1.0 ELSE 0.0 END AS v FROM cells) AS b ON (b.row_no - a.row_no) * (b.row_no - a.row_no) + (b.col_no - a.col_no) * (b.col_no - a.col_no) <= 9 GROUP BY 1, 2) AS z WHERE focal_mean >= 0.6", "cells", doubles="focal_mean"))
def m2_hotspots(spark, sf):
    from furrow.operators.grid import focal_circle

    c = view(spark, sf, "cells").withColumn("v", F.when(F.col("depth") > 25, 1.0).otherwise(0.0))
    near = focal_circle(c, "v", 3, 4096, 64).join(c.select("row_no", "col_no"), ["row_no", "col_no"], "left_semi")
    return M.hotspots(near, 0.6)


HASH = "({k} * 2654435761 + {s} * 40503) % 2147483647"


@plan(oracle(f"SELECT cell_id, tile_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, cell_id) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, label ORDER BY h, cell_id) AS k1 FROM (SELECT cell_id, row_no AS tile_id, field AS label, {HASH.format(k='cell_id', s=1)} AS h FROM cells) AS x) AS y WHERE k1 <= 6) AS z WHERE k2 <= 90", "cells"))
def m3_stratified_quota(spark, sf):
    c = view(spark, sf, "cells").select("cell_id", F.col("row_no").alias("tile_id"), F.col("field").alias("label"))
    return M.stratified_quota(c, 90, 6, seed=1)


@plan(f"WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders), v AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM o WHERE d IS NOT NULL) AS x) SELECT o_orderkey, coalesce(o.d, v.d) AS d FROM o LEFT JOIN v ON o.d IS NULL AND v.i = {HASH.format(k='o_orderkey', s=0)} % (SELECT count(*) FROM v)")
def m4_borrow_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")).alias("d"))
    return M.borrow_dates(o, "o_orderkey", "d")


@plan(f"SELECT p_partkey AS id, {HASH.format(k='p_partkey', s=2)} AS shuffle_key FROM part UNION ALL SELECT s_suppkey, {HASH.format(k='s_suppkey', s=2)} FROM supplier")
def m5_union_and_shuffle(spark, sf):
    return M.union_and_shuffle(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", 2)


@plan(oracle("""SELECT patch_id, tile_id, date, value, coalesce(n, 0) AS n_obs FROM (SELECT p_partkey AS patch_id, p_partkey % 15 AS tile_id, DATE '2024-01-01' + CAST(p_partkey % 40 AS INTEGER) AS date FROM part) AS p LEFT JOIN
(SELECT p_partkey, avg(value) * 1000 AS value, count(*) AS n FROM part JOIN obs ON tile_id = p_partkey % 15 AND abs(datediff('day', DATE '2024-01-01' + CAST(p_partkey % 40 AS INTEGER), CAST(ts AS DATE))) <= 3 GROUP BY 1) AS m ON p_partkey = patch_id""", "obs", doubles="value"))
def m6_patch_composite(spark, sf):
    patches = table(spark, sf, "part").select(F.col("p_partkey").alias("patch_id"), (F.col("p_partkey") % 15).alias("tile_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 40).cast("int")).alias("date"))
    return M.patch_composite(patches, view(spark, sf, "obs").select("tile_id", "ts", "value"), 3, ("value",), 1000.0)


# Patches: embeddings as 8 x 8 pixels; every seventh place has no data.
PX = """px AS (SELECT vec_id AS patch_id, CAST(floor(k / 8.0) AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CASE WHEN (vec_id + k) % 7 <> 0 THEN CAST(embedding[k + 1] AS DOUBLE) END AS b1, CAST(embedding[(k + 5) % 64 + 1] AS DOUBLE) AS b2, label
  FROM (SELECT vec_id, embedding, label, CAST(unnest(range(64)) AS INTEGER) AS k FROM embeddings) AS e)"""


def px(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    return e.select(F.col("vec_id").alias("patch_id"), F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), F.when((F.col("vec_id") + F.col("k")) % 7 != 0, F.col("embedding")[F.col("k")].cast("double")).alias("b1"), F.col("embedding")[(F.col("k") + 5) % 64].cast("double").alias("b2"), "label")


def with_px(body: str, doubles: str = "", digits: int = 6) -> str:
    return f"WITH {PX} SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in doubles.split())}) FROM ({body}) AS body" if doubles else f"WITH {PX} {body}"


@plan(with_px("SELECT patch_id, y - 1 AS y, x - 1 AS x, CASE WHEN b2 > -0.1 AND b2 < 0.8 THEN coalesce(b1, 0) / 0.5 ELSE 0 END AS b1 FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND patch_id IN (SELECT patch_id FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND b1 IS NOT NULL AND b1 <> 0)", "b1"))
def m7_patch_preprocess(spark, sf):
    return M.patch_preprocess(px(spark, sf), 6, ["b1"], 0.5, "b2", full=8)


TURNED = f"""SELECT patch_id, CAST(CASE t WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y WHEN 3 THEN x ELSE y END AS INTEGER) AS y, CAST(CASE t WHEN 1 THEN y WHEN 2 THEN 7 - x WHEN 3 THEN 7 - y ELSE x END AS INTEGER) AS x, b2 FROM
(SELECT patch_id, CASE WHEN h % 2 = 1 THEN 7 - x ELSE x END AS x, CASE WHEN floor(h / 2.0) % 2 = 1 THEN 7 - y ELSE y END AS y, CAST(floor(h / 4.0) AS BIGINT) % 4 AS t, b2 FROM (SELECT *, {HASH.format(k='patch_id', s=0)} AS h FROM px) AS a) AS b"""


@plan(with_px(TURNED, "b2"))
def m8_augment(spark, sf):
    return M.augment(px(spark, sf).select("patch_id", "y", "x", "b2"), 8)


@plan(with_px("SELECT patch_id, avg(b1) AS b1, avg(b2) AS b2 FROM px GROUP BY 1", "b1 b2"))
def m9_patch_fractions(spark, sf):
    return M.patch_fractions(px(spark, sf), ["b1", "b2"])


@plan(with_px("SELECT patch_id, y, x, CASE WHEN b1 IS NOT NULL THEN greatest(0, least(b1, 0.2)) / 0.2 END AS b1 FROM px WHERE patch_id IN (SELECT patch_id FROM px GROUP BY 1 HAVING avg(CASE WHEN b1 IS NULL THEN 1.0 ELSE 0.0 END) <= 0.141)", "b1"))
def m10_nodata_filter(spark, sf):
    return M.nodata_filter(px(spark, sf), "b1", 0.141, 0.2).select("patch_id", "y", "x", "b1")


@plan(oracle("SELECT tile_id, label, cell_id, hits FROM (SELECT row_no AS tile_id, field AS label, cell_id, count(*) OVER (PARTITION BY row_no, field) AS hits FROM cells) AS z WHERE hits >= 13", "cells"))
def m11_class_extract(spark, sf):
    c = view(spark, sf, "cells")
    return M.class_extract(c.select("cell_id", F.col("row_no").alias("tile_id")), c.select("cell_id", F.col("field").alias("label")), 13).select("tile_id", "label", "cell_id", "hits")


@plan(oracle(f"SELECT cell_id, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) THEN 'validate' ELSE 'test' END AS part FROM (SELECT cell_id, row_number() OVER (PARTITION BY field ORDER BY {HASH.format(k='cell_id', s=4)}, cell_id) AS r, count(*) OVER (PARTITION BY field) AS n FROM cells) AS z", "cells"))
def m12_split(spark, sf):
    return M.split(view(spark, sf, "cells").select("cell_id", "field"), {"train": 0.6, "validate": 0.2, "test": 0.2}, "cell_id", "field", 4).select("cell_id", "part")


@plan("SELECT CAST(c_nationkey AS INTEGER) AS label, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) AS x) AS n FROM customer GROUP BY 1")
def m13_smote(spark, sf):
    """Rows of each class after balancing; every class ends as large as the largest."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"), F.array((F.col("c_acctbal") / 1000), (F.col("c_custkey") % 10).cast("double")).alias("features"))
    made = M.smote(rows)
    return rows.select("label").unionByName(made.select("label")).groupBy("label").agg(F.count("*").alias("n"))


NEAR = """SELECT label, id, o_key, d2 FROM (SELECT a.label, a.id, b.id AS o_key, (a.f1 - b.f1) * (a.f1 - b.f1) + (a.f2 - b.f2) * (a.f2 - b.f2) AS d2 FROM c a JOIN c b ON a.label = b.label AND a.id <> b.id) AS z
QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, o_key) <= 5"""


@plan(f"WITH c AS (SELECT c_custkey AS id, c_nationkey AS label, c_acctbal / 1000 AS f1, CAST(c_custkey % 10 AS DOUBLE) AS f2 FROM customer) SELECT * REPLACE (round(d2, 6) AS d2) FROM ({NEAR}) AS n")
def m13_nearest_of_class(spark, sf):
    """The neighbours that M13 interpolates with."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"), F.array((F.col("c_acctbal") / 1000), (F.col("c_custkey") % 10).cast("double")).alias("features"))
    near = N.nearest_of_class(rows, k=5).select("label", "id", F.explode("near_").alias("o"))
    return near.select("label", "id", "o.o_key", "o.d2")


@plan("""WITH c AS (SELECT vec_id AS id, label, CAST(embedding[1:13] AS DOUBLE[]) AS f FROM embeddings)
SELECT label, id, o_key, round(d2, 6) AS d2 FROM (SELECT a.label, a.id, b.id AS o_key, list_aggregate(list_transform(list_zip(a.f, b.f), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum') AS d2 FROM c a JOIN c b ON a.label = b.label AND a.id <> b.id) AS z
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d2, 12), o_key) <= 5""")
def m13_nearest_many_features(spark, sf):
    """Neighbours over thirteen features."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.slice(F.col("embedding").cast("array<double>"), 1, 13).alias("features"))
    near = N.nearest_of_class(rows, k=5, crowd=200, vectors=False).select("label", "id", F.explode("near_").alias("o"))
    return near.select("label", "id", "o.o_key", "o.d2")


@plan(oracle("SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2", "predictions"))
def m14_confusion_matrix(spark, sf):
    return E.confusion_matrix(view(spark, sf, "predictions"))


REPORT = """per AS (SELECT c, s, CASE WHEN p > 0 THEN h / p ELSE 0 END AS precision, CASE WHEN s > 0 THEN h / s ELSE 0 END AS recall, h FROM (SELECT c, CAST(count(*) FILTER (WHERE y_true = c) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE y_pred = c) AS DOUBLE) AS p,
  CAST(count(*) FILTER (WHERE y_true = c AND y_pred = c) AS DOUBLE) AS h FROM predictions, (VALUES (0), (1)) AS k(c) GROUP BY 1) AS z), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)"""


@plan(oracle("", "predictions").strip() + f", {REPORT} SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT CAST(c AS VARCHAR) AS name, precision, recall, f1, s AS support FROM f UNION ALL SELECT 'accuracy', sum(h) / sum(s), sum(h) / sum(s), sum(h) / sum(s), sum(s) FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) FROM f UNION ALL SELECT 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM f) AS z")
def m14_classification_report(spark, sf):
    return E.classification_report(view(spark, sf, "predictions"))


@plan(oracle("SELECT class, (tp + 1e-6) / (tp + fp + fn + 1e-6) AS iou, (2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6) AS dice, (tp + 1e-6) / (tp + 0.3 * fn + 0.7 * fp + 1e-6) AS tversky FROM (SELECT 0 AS class, sum(y_true * p1) AS tp, sum((1 - y_true) * p1) AS fp, sum(y_true * (1 - p1)) AS fn FROM predictions UNION ALL SELECT 1, sum(toxic * p1), sum((1 - toxic) * p1), sum(toxic * (1 - p1)) FROM predictions) AS z", "predictions", doubles="iou dice tversky"))
def m15_overlap_metrics(spark, sf):
    return E.overlap_metrics(view(spark, sf, "predictions"), [("y_true", "p1"), ("toxic", "p1")])


@plan(oracle("SELECT toxic, (sum(r) FILTER (WHERE y_true = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY toxic ORDER BY p1) + (count(*) OVER (PARTITION BY toxic, p1) - 1) / 2.0 AS r, count(*) FILTER (WHERE y_true = 1) OVER (PARTITION BY toxic) AS n1, count(*) FILTER (WHERE y_true = 0) OVER (PARTITION BY toxic) AS n0 FROM predictions) AS z GROUP BY toxic, n1, n0", "predictions", doubles="auc"))
def m16_roc_auc(spark, sf):
    return E.roc_auc(view(spark, sf, "predictions"), "p1", "y_true", ["toxic"])


@plan(oracle("SELECT toxic, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM (SELECT toxic, p, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(q) OVER w AS DOUBLE) AS fp FROM (SELECT toxic, p1, sum(y_true) AS p, sum(1 - y_true) AS q FROM predictions GROUP BY 1, 2) AS x WINDOW w AS (PARTITION BY toxic ORDER BY p1 DESC)) AS z GROUP BY 1", "predictions", doubles="ap"))
def m16_average_precision(spark, sf):
    return E.average_precision(view(spark, sf, "predictions"), "p1", "y_true", ["toxic"])


@plan("SELECT l_returnflag, round(1 - sum(e * e) / (var_pop(t) * count(t)), 6) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae FROM (SELECT l_returnflag, l_extendedprice AS t, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) AS z GROUP BY 1")
def m17_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return E.regression_metrics(li, "l_extendedprice", "p", ["l_returnflag"]).withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4)})


@plan("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_code, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 5 <> 0)) / (SELECT stddev_pop(c_acctbal) FROM customer WHERE c_custkey % 5 <> 0), 6) AS c_acctbal FROM customer")
def m18_encode_scale(spark, sf):
    return E.encode_scale(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", ["c_acctbal"], F.col("c_custkey") % 5 != 0)


def samples(spark, sf):
    return view(spark, sf, "cells").select("cell_id", (F.col("field") >= 3).cast("double").alias("target"), (F.col("field") + F.col("depth") / 50).alias("f1"), "depth", "aridity", "price")


FEATURES = ["f1", "depth", "aridity", "price"]


@plan()
def m19_fit_forest(spark, sf):
    rows = L.spread(samples(spark, sf))
    model = L.fit_forest(rows, FEATURES, "target")
    scored = model.transform(rows).select("target", F.col("prediction").alias("y_pred"))
    return E.classification_report(scored, "target", "y_pred")


@plan()
def m19_fit_forest_regressor(spark, sf):
    rows = L.spread(samples(spark, sf))
    scored = L.fit_forest(rows, ["depth", "aridity", "f1", "target"], "price", classify=False).transform(rows)
    return E.regression_metrics(scored, "price", "prediction", ["target"])


@plan()
def m20_fit_boosted(spark, sf):
    """The random search over all eight parameters: mean accuracy of each draw over the folds, and of the chosen model on all rows. The numbers of trees are smaller than the operator's (README has the times)."""
    rows = samples(spark, sf)
    model, tried = B.search(rows, FEATURES, "target", draws=12, folds=5, choices=B.CHOICES | {"n_estimators": [5, 10]}, n_bins=32, together=60)
    right = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("target")).cast("int")).alias("accuracy")).first()[0]
    names = list(B.CHOICES)
    said = [(k, *[float(getattr(p, n)) for n in names], float(a), float(right) if p == model.params else None) for k, (p, a) in enumerate(tried)]
    return spark.createDataFrame(said, f"draw int, {', '.join(f'{n} double' for n in names)}, held_out_accuracy double, accuracy double")


@plan()
def m21_fit_tree(spark, sf):
    rows = samples(spark, sf)
    scored = L.fit_tree(rows, FEATURES, "target").transform(rows).select("target", F.col("prediction").alias("y_pred"))
    return E.classification_report(scored, "target", "y_pred")


@plan(oracle("""SELECT threshold, h - (ln_ * hl + rn * hr) / (ln_ + rn) AS gain FROM (SELECT v AS threshold, ln_, rn, -(a / n * ln(a / n) + (n - a) / n * ln((n - a) / n)) AS h,
  -(CASE WHEN la > 0 THEN la / ln_ * ln(la / ln_) ELSE 0 END + CASE WHEN ln_ - la > 0 THEN (ln_ - la) / ln_ * ln((ln_ - la) / ln_) ELSE 0 END) AS hl, -(CASE WHEN ra > 0 THEN ra / rn * ln(ra / rn) ELSE 0 END + CASE WHEN rn - ra > 0 THEN (rn - ra) / rn * ln((rn - ra) / rn) ELSE 0 END) AS hr
  FROM (SELECT v, CAST(count(*) FILTER (WHERE depth <= v) AS DOUBLE) AS ln_, CAST(count(*) FILTER (WHERE depth > v) AS DOUBLE) AS rn, CAST(count(*) FILTER (WHERE depth <= v AND field >= 3) AS DOUBLE) AS la, CAST(count(*) FILTER (WHERE depth > v AND field >= 3) AS DOUBLE) AS ra,
  CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE field >= 3) AS DOUBLE) AS a FROM cells, (SELECT DISTINCT depth AS v FROM cells) AS d GROUP BY v) AS z WHERE rn > 0) AS y""", "cells", doubles="gain"))
def m22_information_gain(spark, sf):
    return E.information_gain(view(spark, sf, "cells").withColumn("y", F.col("field") >= 3), "depth", "y")


@plan()
def m23_feature_importance(spark, sf):
    rows = samples(spark, sf)
    return L.feature_importance(L.fit_tree(rows, FEATURES, "target", 5), FEATURES, rows)


PLACES = [("north", 40.0, 10.0), ("south", 5.0, 50.0), ("middle", 22.5, 33.3)]


@plan(oracle("SELECT region, patch_id, distance FROM (SELECT region, cell_id AS patch_id, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS distance FROM (SELECT region, cell_id, pow(sin(radians(depth - la) / 2), 2) + cos(radians(la)) * cos(radians(depth)) * pow(sin(radians(col_no - lo) / 2), 2) AS a FROM cells, (VALUES " + ", ".join(f"('{n}', {a}, {o})" for n, a, o in PLACES) + ") AS r(region, la, lo)) AS x) AS z QUALIFY row_number() OVER (PARTITION BY region ORDER BY distance, patch_id) = 1", "cells", doubles="distance"))
def m24_nearest_patch(spark, sf):
    return M.nearest_patch(view(spark, sf, "cells").select(F.col("cell_id").alias("patch_id"), F.col("depth").alias("lat"), F.col("col_no").cast("double").alias("lon")), PLACES)


@plan(with_soft("SELECT cell_id, a AS cons_percent, CAST(b + 100 - a - b - c AS INTEGER) AS conv_percent, c AS trad_percent, CASE WHEN a < 30 THEN 'act' WHEN a > 60 THEN 'keep' ELSE 'watch' END AS tier FROM (SELECT cell_id, CAST(round_even(conservation * 100, 0) AS INTEGER) AS a, CAST(round_even(conventional * 100, 0) AS INTEGER) AS b, CAST(round_even(traditional * 100, 0) AS INTEGER) AS c FROM soft) AS z"))
def m25_percent_triplet(spark, sf):
    return soft(spark, sf).select("cell_id", *M.percent_triplet(*LABELS))


@plan(with_px("SELECT label, patch_id, fraction FROM (SELECT patch_id, unnest(['b1', 'b2']) AS label, unnest([b1, b2]) AS fraction FROM (SELECT patch_id, avg(b1) AS b1, avg(b2) AS b2 FROM px GROUP BY 1 HAVING avg(CASE WHEN b1 <> 0 THEN 1.0 WHEN b1 = 0 THEN 0.0 END) > 0.3) AS x) AS z QUALIFY row_number() OVER (PARTITION BY label ORDER BY fraction DESC, patch_id) = 1", "fraction"))
def m26_best_patch_per_class(spark, sf):
    return M.best_patch_per_class(px(spark, sf), ["b1", "b2"], "b1")


@plan(with_soft("SELECT cell_id, CAST(CASE WHEN conservation >= conventional AND conservation >= traditional THEN 0 WHEN conventional >= traditional THEN 1 ELSE 2 END AS BIGINT) AS label FROM soft"))
def m27_hard_label(spark, sf):
    return soft(spark, sf).select("cell_id", M.hard_label(list(LABELS)).alias("label"))


@plan("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def x1_union_all(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@plan(oracle("SELECT cell_id, high IS NOT NULL AS masked FROM cells WHERE cell_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", "cells"))
def x2_mask(spark, sf):
    c = view(spark, sf, "cells").join(table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("cell_id")), "cell_id", "left_semi")
    rich = c.filter("high IS NOT NULL").select("cell_id")
    return c.join(rich, "cell_id", "left_semi").select("cell_id", F.lit(True).alias("masked")).unionByName(c.join(rich, "cell_id", "left_anti").select("cell_id", F.lit(False).alias("masked")))


@plan(oracle("SELECT p_partkey, avg(value) AS mean FROM part LEFT JOIN obs ON pixel_id = p_partkey GROUP BY 1", "obs", doubles="mean"))
def x3_mean_with_fallback(spark, sf):
    spine = table(spark, sf, "part").select("p_partkey")
    return spine.join(view(spark, sf, "obs").groupBy(F.col("pixel_id").alias("p_partkey")).agg(F.avg("value").alias("mean")), "p_partkey", "left")


@plan("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def x4_distinct_mapping(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct().orderBy("c_nationkey", "c_mktsegment")


@plan(oracle("SELECT a.row_no, a.col_no, max(b.depth) - min(b.depth) AS relief FROM cells a JOIN cells b ON abs(b.row_no - a.row_no) <= 1 AND abs(b.col_no - a.col_no) <= 1 GROUP BY 1, 2", "cells"))
def x5_window_function(spark, sf):
    """A user's function over windows: tiles with their halo go to it as arrays."""
    import numpy as np

    relief = lambda w: np.nanmax(w, axis=(1, 2)) - np.nanmin(w, axis=(1, 2))
    return AP.apply_windows(view(spark, sf, "cells"), "depth", 1, relief, "relief double", side=16)


@plan(oracle("""SELECT a.row_no, a.col_no, CASE WHEN a.row_no BETWEEN 2 AND (SELECT max(row_no) - 2 FROM cells) AND a.col_no BETWEEN 2 AND 61 THEN median(b.depth) FILTER (WHERE b.depth < 25 AND b.depth <> 0) END AS middle
  FROM cells a LEFT JOIN cells b ON abs(b.row_no - a.row_no) <= 2 AND abs(b.col_no - a.col_no) <= 2 WHERE a.depth >= 25 GROUP BY 1, 2""", "cells", doubles="middle"))
def x5_window_median(spark, sf):
    """The median of the values within two cells of those that have none; windows that leave the grid give null."""
    import numpy as np

    cells = view(spark, sf, "cells")
    rows = cells.agg(F.max("row_no")).first()[0] + 1

    def middle(w: np.ndarray) -> np.ndarray:
        flat = np.where(w == 0, np.nan, w).reshape(len(w), -1)
        out = np.full(len(w), np.nan)
        some = ~np.isnan(flat).all(axis=1)
        out[some] = np.nanmedian(flat[some], axis=1)
        return out

    return AP.apply_windows(cells.filter("depth < 25"), "depth", 2, middle, "middle double", cells.filter("depth >= 25"), (rows, 64), pad=False)


@plan(upto("coded", "SELECT cell_id, count(DISTINCT code) AS n_codes, sum(code) AS code_sum FROM coded WHERE code IS NOT NULL GROUP BY 1").replace("sum(code) AS", "CAST(sum(code) AS BIGINT) AS"))
def x6_function_along_axis(spark, sf):
    """A function along the crop axis of each cell, by built-in aggregates."""
    coded = classes(spark, sf).select("cell_id", C.category_code().alias("code")).filter("code IS NOT NULL")
    return coded.groupBy("cell_id").agg(F.countDistinct("code").alias("n_codes"), F.sum("code").alias("code_sum"))


_AXIS = """, axis AS (SELECT cell_id, crop, code, row_number() OVER (PARTITION BY cell_id ORDER BY crop) AS k FROM coded WHERE code IS NOT NULL),
runs AS (SELECT cell_id, code, count(*) AS n FROM (SELECT cell_id, code, k - row_number() OVER (PARTITION BY cell_id, code ORDER BY k) AS g FROM axis) AS z GROUP BY cell_id, code, g),
counts AS (SELECT cell_id, code, count(*) AS n FROM axis GROUP BY 1, 2)
SELECT cell_id, CAST(min(code) FILTER (WHERE n = most) AS BIGINT) AS mode, max(longest) AS longest_run FROM (SELECT *, max(n) OVER (PARTITION BY cell_id) AS most FROM counts) AS c JOIN (SELECT cell_id, max(n) AS longest FROM runs GROUP BY 1) AS r USING (cell_id) GROUP BY cell_id"""


@plan(upto("coded", _AXIS))
def x6_apply_along(spark, sf):
    """Functions of the caller along the crop axis: the most frequent code, the smallest of equals, and the longest run of one code, which no aggregate gives."""
    import numpy as np

    coded = classes(spark, sf).select("cell_id", "crop", C.category_code().alias("code")).filter("code IS NOT NULL")

    def mode(codes: np.ndarray) -> int:
        values, n = np.unique(codes, return_counts=True)
        return int(values[n.argmax()])

    def longest(codes: np.ndarray) -> int:
        edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))
        return int(np.diff(edges).max())

    modes = AP.apply_along(coded, ["cell_id"], "crop", ["code"], mode, "mode long")
    return modes.join(AP.apply_along(coded, ["cell_id"], "crop", ["code"], longest, "longest_run long"), "cell_id")


@plan(oracle("SELECT event_id, least(greatest(ndvi, 0.01), 0.08) AS v FROM obs WHERE cloudy_pct < 50", "obs", doubles="v"))
def x7_per_scene_map(spark, sf):
    clear = lambda df: df.filter("cloudy_pct < 50")
    clamp = lambda df: df.select("event_id", F.least(F.greatest(F.col("ndvi"), F.lit(0.01)), F.lit(0.08)).alias("v"))
    return view(spark, sf, "obs").transform(clear).transform(clamp)


@plan("""SELECT o_orderkey, upper(o_orderpriority) AS up, length(o_orderstatus) AS len, o_orderpriority LIKE '%HIGH%' AS is_high, regexp_extract(o_orderpriority, '([0-9])-', 1) AS rank, round(exp(-o_totalprice / 1e5), 6) AS e, round(sqrt(o_totalprice), 4) AS r, CAST(ceil(log2(o_totalprice + 1)) AS BIGINT) AS b,
  CAST(o_orderdate AS DATE) + 30 AS due, strftime(o_orderdate, '%Y-%m') AS month, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders""")
def x8_scalars(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.upper("o_orderpriority").alias("up"), F.length("o_orderstatus").cast("long").alias("len"), F.col("o_orderpriority").contains("HIGH").alias("is_high"), F.regexp_extract("o_orderpriority", "([0-9])-", 1).alias("rank"), F.exp(-p / 1e5).alias("e"),
        F.round(F.sqrt(p), 4).alias("r"), F.ceil(F.log2(p + 1)).alias("b"), F.date_add(F.to_date("o_orderdate"), 30).alias("due"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("days"),
    )
