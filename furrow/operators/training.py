"""Training data: soft labels, samples, patches, augmentation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.columns import pack, unpack
from furrow.operators.neighbours import nearest_of_class
from furrow.session import stored


def soft_labels(grouped: DataFrame, labels: tuple[str, ...] = ("conservation", "conventional", "traditional")) -> DataFrame:
    """M1: (cell_id, one share for each label): a group's area by the cell's total, 0 without data."""
    wide = grouped.groupBy("cell_id").agg(*[F.coalesce(F.sum(F.when(F.col("class_group") == la, F.col("group_area"))), F.lit(0.0)).alias(la) for la in labels])
    total = sum((F.col(la) for la in labels), F.lit(0.0))
    return wide.select("cell_id", *[F.coalesce(F.try_divide(F.col(la), total), F.lit(0.0)).alias(la) for la in labels])


def hotspots(density: DataFrame, least: float = 0.40, column: str = "focal_mean") -> DataFrame:
    """M2: places where a label's mean around them is dense."""
    return density.filter(F.col(column) >= least)


def hash_order(key, seed: int = 0):
    """A repeatable random order, as arithmetic that other engines share."""
    return (key * 2_654_435_761 + seed * 40_503) % 2_147_483_647


def stratified_quota(df: DataFrame, per_class: int, per_tile: int, key: str = "cell_id", tile: str = "tile_id", label: str = "label", seed: int = 0) -> DataFrame:
    """M3: up to ``per_tile`` rows of each tile and class, then ``per_class`` of each class, in a hashed order. Ties of the hash go to the smaller key; null tiles and labels are groups; all columns come back."""
    own = pack(df, key=key, tile=tile, label=label).withColumn("h", hash_order(F.col("key"), seed))
    # Ranks with a bound are cut before the shuffle too, so a large class is not sorted whole.
    capped = own.withColumn("k", F.row_number().over(Window.partitionBy("tile", "label").orderBy("h", "key"))).filter(F.col("k") <= per_tile).drop("k")
    return unpack(capped.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "key"))).filter(F.col("k") <= per_class), df.columns)


def borrow_dates(df: DataFrame, key: str, date: str) -> DataFrame:
    """M4: rows without a date take one of the valid dates, picked by the hash of their key; without any valid date they stay as they are. All columns come back in their places."""
    valid = df.filter(F.col(date).isNotNull()).groupBy(F.col(date).alias("lent")).agg(F.count("*").alias("n")).select("lent", (F.row_number().over(Window.orderBy("lent")) - 1).alias("place"))  # one row for each date
    own = pack(df, key=key, day=date).crossJoin(F.broadcast(valid.agg(F.count("*").alias("dates"))))  # against one row
    wanted = own.withColumn("at", F.when(F.col("day").isNull(), hash_order(F.col("key")) % F.nullif(F.col("dates"), F.lit(0))))
    met = wanted.join(valid, F.col("at") == F.col("place"), "left")
    return unpack(met, [c for c in df.columns if c != date], **{date: F.coalesce("day", "lent")}).select(*df.columns)


def union_and_shuffle(a: DataFrame, b: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """M5: both tables in a hashed order."""
    return a.unionByName(b).withColumn("shuffle_key", hash_order(F.col(key), seed)).orderBy("shuffle_key", key)


def patch_composite(patches: DataFrame, obs: DataFrame, days: int = 15, values: tuple[str, ...] = ("value",), scale: float = 1.0) -> DataFrame:
    """M6: the means of observations within so many days of each patch's date: ``patches(patch_id, tile_id, date)``, ``obs(tile_id, ts, ...)``.

    Observations are summed by tile and day, the only time that they are shuffled; the days' sums are added up along the calendar of each tile, which is as long as the period that was observed. A patch then takes the
    difference of two of these, that of the last day of its interval and that of the day before the first, by joins on tile and day. So an observation is not repeated for the patches that it
    belongs to. Day sums are decimals of twelve places from there on: nothing is lost in the difference.

    Defined results: null, NaN and infinite values don't count in a mean but their observations count in n_obs; without any value the mean is null and without any observation n_obs is 0; so for a null date or
    tile. Observations without day or tile are passed over. Columns of ``patches`` called n_obs or like a value are replaced; all others come back, repeated patches too.
    """
    sums = [f"s{k}" for k in range(len(values))] + [f"n{k}" for k in range(len(values))] + ["n"]
    real = [F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")), F.col(v).cast("double")) for v in values]
    seen = obs.select(F.col("tile_id").alias("tile"), F.unix_date(F.to_date("ts")).alias("day"), *[r.alias(f"v{k}") for k, r in enumerate(real)]).filter("tile IS NOT NULL AND day IS NOT NULL")
    added = [F.coalesce(F.sum(f"v{k}"), F.lit(0.0)).cast("decimal(38, 12)").alias(f"s{k}") for k in range(len(values))] + [F.count(f"v{k}").alias(f"n{k}") for k in range(len(values))]
    by_day = stored(seen.groupBy("tile", "day").agg(*added, F.count("*").alias("n")), "days")
    last = by_day.agg(F.max("day")).first()[0]
    last = 0 if last is None else last
    along = Window.partitionBy("tile").orderBy("day")
    running = by_day.select("tile", "day", F.coalesce(F.lead("day").over(along) - 1, F.lit(last)).alias("until"), *[F.sum(c).over(along).alias(c) for c in sums])
    calendar = running.select("tile", F.explode(F.sequence("day", "until")).alias("at"), *sums)
    upto = lambda side: calendar.select(F.col("tile").alias(f"{side}_tile"), F.col("at").alias(f"{side}_at"), *[F.col(c).alias(f"{side}_{c}") for c in sums])
    own = pack(patches, tile="tile_id", high=F.least(F.unix_date(F.date_add("date", days)), F.lit(last)), low=F.least(F.unix_date(F.date_sub("date", days + 1)), F.lit(last)))
    met = own.join(upto("b"), (F.col("tile") == F.col("b_tile")) & (F.col("high") == F.col("b_at")), "left").join(upto("a"), (F.col("tile") == F.col("a_tile")) & (F.col("low") == F.col("a_at")), "left")
    between = lambda c: F.coalesce(F.col(f"b_{c}"), F.lit(0)) - F.coalesce(F.col(f"a_{c}"), F.lit(0))
    means = {v: F.try_divide(between(f"s{k}").cast("double"), between(f"n{k}").cast("double")) * scale for k, v in enumerate(values)}
    return unpack(met, patches.columns, **means, n_obs=between("n").cast("long"))


def patch_preprocess(px: DataFrame, size: int, bands: list[str], divisor: float = 10_000.0, ndvi: str = "ndvi", low: float = -0.1, high: float = 0.8, full: int | None = None) -> DataFrame:
    """M7: the centre of each patch, nulls as 0, scaled; patches of zeros alone go; pixels with an NDVI outside the range become 0."""
    from_ = ((full or size) - size) // 2
    inner = px.filter((F.col("y") >= from_) & (F.col("y") < from_ + size) & (F.col("x") >= from_) & (F.col("x") < from_ + size))
    filled = inner.select("patch_id", (F.col("y") - from_).alias("y"), (F.col("x") - from_).alias("x"), F.coalesce(F.col(ndvi), F.lit(0.0)).alias("n_"), *[(F.coalesce(F.col(b), F.lit(0.0)) / divisor).alias(b) for b in bands])
    alive = filled.groupBy("patch_id").agg(F.max(F.greatest(*[F.abs(F.col(b)) for b in bands]) if len(bands) > 1 else F.abs(F.col(bands[0]))).alias("m_")).filter("m_ > 0").select("patch_id")
    ok = (F.col("n_") > low) & (F.col("n_") < high)
    return filled.join(alive, "patch_id", "left_semi").select("patch_id", "y", "x", *[F.when(ok, F.col(b)).otherwise(0.0).alias(b) for b in bands])


def augment(px: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """M8: each patch flipped and turned by a choice that its hash makes: left-right, up-down, quarter turns."""
    h = hash_order(F.col("patch_id"), seed)
    out = px.withColumn("x", F.when(h % 2 == 1, size - 1 - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(F.floor(h / 2) % 2 == 1, size - 1 - F.col("y")).otherwise(F.col("y")))
    turn = F.floor(h / 4) % 4
    y, x = F.col("y"), F.col("x")
    new_y = F.when(turn == 1, size - 1 - x).when(turn == 2, size - 1 - y).when(turn == 3, x).otherwise(y)
    new_x = F.when(turn == 1, y).when(turn == 2, size - 1 - x).when(turn == 3, size - 1 - y).otherwise(x)
    return out.withColumns({"y": new_y, "x": new_x})


def patch_fractions(px: DataFrame, labels: list[str]) -> DataFrame:
    """M9: the mean of each label over a patch."""
    return px.groupBy("patch_id").agg(*[F.avg(c).alias(c) for c in labels])


def nodata_filter(px: DataFrame, value: str, most: float = 0.9, high: float = 10_000.0) -> DataFrame:
    """Patches with at most so large a share without data; values cut to 0..high and scaled to 1."""
    ok = px.groupBy("patch_id").agg(F.avg(F.col(value).isNull().cast("int")).alias("share_")).filter(F.col("share_") <= most).select("patch_id")
    return px.join(ok, "patch_id", "left_semi").withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.col(value), F.lit(high))) / high))


def class_extract(px: DataFrame, labels: DataFrame, least: int = 10) -> DataFrame:
    """Pixels of each tile and class that have at least so many hits."""
    joined = px.join(labels.select("cell_id", "label"), "cell_id")
    enough = joined.groupBy("tile_id", "label").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    return joined.join(enough, ["tile_id", "label"])


def class_rank(df: DataFrame, key: str, by: list[str], seed: int = 0) -> DataFrame:
    """``df`` with rank_ (from 1, in a hashed order) and class_rows_ of each class. Ranges of the hash are counted first, so that no class, however large,
    is ordered in one task."""
    marked = df.withColumn("h_", hash_order(F.col(key), seed)).withColumn("cut_", F.floor(F.col("h_") / 2**21))
    sums = marked.groupBy(*by, "cut_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = sums.withColumn("before_", F.sum("n_").over(w.orderBy("cut_")) - F.col("n_")).withColumn("class_rows_", F.sum("n_").over(w)).drop("n_")  # at most 1,024 rows for each class
    placed = marked.join(before, [*by, "cut_"])
    return placed.withColumn("rank_", F.col("before_") + F.row_number().over(Window.partitionBy(*by, "cut_").orderBy("h_", key))).drop("h_", "cut_", "before_")


def split(df: DataFrame, shares: dict[str, float], key: str, label: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with part: exact shares (of each class, if ``label``) in a hashed order. A column called part is replaced; all others come back. Rows without a label are in no part and don't come back."""
    own = pack(df, key=key, **({"label": label} if label else {}))
    placed = class_rank(own, "key", ["label"] if label else [], seed)
    out, total = F.lit(None).cast("string"), 1.0
    for name, share in reversed(list(shares.items())):
        out = F.when(F.col("rank_") <= F.bround(F.col("class_rows_") * total), name).otherwise(out) if total < 1 else F.lit(name)
        total -= share
    return unpack(placed, df.columns, part=out)


def smote(df: DataFrame, features: str = "features", label: str = "label", key: str = "id", k: int = 5) -> DataFrame:
    """Synthetic rows that bring each class up to the largest: a row of the class moved by a hashed share towards one of its ``k`` nearest neighbours
    in the class, over all features (``nearest_of_class``).

    A row without neighbours (the only one of its class, or with missing features) is copied as it is; rows without a label make a class without neighbours; other columns don't come back.
    """
    counts = df.groupBy(F.col(label).alias("m_label")).agg(F.count("*").alias("m_n"))
    need = counts.crossJoin(F.broadcast(counts.agg(F.max("m_n").alias("m_most")))).filter("m_n < m_most").withColumn("m_need", F.col("m_most") - F.col("m_n"))  # against one row
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(features).alias("features")).join(need, F.col("label").eqNullSafe(F.col("m_label"))).drop("m_label")
    short = need.select(F.col("m_label").alias("of_label"), "m_n", "m_need")
    best = nearest_of_class(rows, "features", "label", "key", k).join(short, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    alone = F.array(F.struct(F.lit(0.0).alias("d2"), F.col("key").alias("o_key"), F.col("features").alias("o_features")))
    base = class_rank(best, "key", ["label"]).withColumn("near_", F.when(F.size("near_") > 0, F.col("near_")).otherwise(alone))
    times = F.floor(F.col("m_need") / F.col("m_n")) + F.when(F.col("rank_") <= F.col("m_need") % F.col("m_n"), 1).otherwise(0)
    copies = base.withColumn("copy_", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    pick = F.element_at("near_", (F.pmod(F.xxhash64("key", "copy_"), F.size("near_")) + 1).cast("int"))["o_features"]
    lam = F.pmod(F.xxhash64("copy_", "key"), F.lit(1000)) / 1000
    moved = F.zip_with("features", pick, lambda a, b: a + lam * (b - a))
    return copies.select(F.xxhash64("key", "copy_").alias(key), F.col("label").alias(label), moved.alias(features))


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371.0):
    """Great-circle distance in kilometres."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def nearest_patch(patches: DataFrame, regions: list[tuple[str, float, float]]) -> DataFrame:
    """(region, patch_id, distance): the patch nearest to each of a few named places; the smallest id of equals."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("region"), F.lit(la).alias("rlat"), F.lit(lo).alias("rlon")) for n, la, lo in regions]))
    d = haversine(F.col("r.rlat"), F.col("r.rlon"), F.col("lat"), F.col("lon"))
    return patches.select("patch_id", "lat", "lon", rows.alias("r")).select(F.col("r.region").alias("region"), "patch_id", d.alias("d")).groupBy("region").agg(F.min(F.struct("d", "patch_id")).alias("m")).select("region", "m.patch_id", F.col("m.d").alias("distance"))


def percent_triplet(cons: str, conv: str, trad: str) -> list:
    """Whole percents of three shares, the rest of 100 added to the second, and a tier by the first."""
    p = {n: F.bround(F.col(n) * 100).cast("int") for n in (cons, conv, trad)}
    rest = 100 - p[cons] - p[conv] - p[trad]
    tier = F.when(p[cons] < 30, "act").when(p[cons] > 60, "keep").otherwise("watch")
    return [p[cons].alias("cons_percent"), (p[conv] + rest).alias("conv_percent"), p[trad].alias("trad_percent"), tier.alias("tier")]


def best_patch_per_class(px: DataFrame, labels: list[str], value: str, least: float = 0.30) -> DataFrame:
    """For each label the patch with the highest mean among those with more than so large a share of pixels that aren't 0."""
    per = px.groupBy("patch_id").agg(F.avg((F.col(value) != 0).cast("int")).alias("share_"), *[F.avg(c).alias(c) for c in labels]).filter(F.col("share_") > least)
    rows = per.select("patch_id", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("fraction")) for c in labels])).alias("r")).select("patch_id", "r.*")
    return rows.groupBy("label").agg(F.min(F.struct(-F.col("fraction"), F.col("patch_id"))).alias("m")).select("label", F.col("m.patch_id").alias("patch_id"), (-F.col("m.col1")).alias("fraction"))


def hard_label(labels: list[str]):
    """The place (from 0) of the largest soft label, the first of equals."""
    a = F.array(*[F.col(c) for c in labels])
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")
