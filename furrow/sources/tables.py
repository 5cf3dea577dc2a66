"""Reading, checking and writing the tables of cells, crops and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cells(frames: list[DataFrame], inside, key: str = "cell_id") -> DataFrame:
    """A mosaic of sources inside a window (a condition that reaches each scan); where they overlap the first that has a value wins.

    Each column is filled on its own; a cell that is null in all sources stays null.
    """
    parts = [f.filter(inside).withColumn("source_rank", F.lit(k)) for k, f in enumerate(frames)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    values = [c for c in out.columns if c not in (key, "source_rank")]
    return out.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_rank"))).alias(c) for c in values])


def read_stats_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """A CSV file with a header under a fixed schema; a missing required column is an error."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema}
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in header if c in kinds])


def standardize_stats(df: DataFrame, names: dict[str, list[str]], value: str = "value", unit: str = "unit") -> DataFrame:
    """S3: columns under their main names, whichever spelling is there; thousands as units; rows without a positive value go."""
    have = set(df.columns)
    picked = [F.coalesce(*[F.col(f"`{o}`") for o in others if o in have]).alias(n) if any(o in have for o in others) else F.lit(None).alias(n) for n, others in names.items()]
    out = df.select(*picked)
    thousands = F.when(F.coalesce(F.col(unit).contains("1000"), F.lit(False)), 1000.0).otherwise(1.0)
    return out.withColumn(value, F.col(value).cast("double") * thousands).filter(F.col(value) > 0)


def preflight(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required data sets that are missing."""
    return required.join(present.select(key).distinct(), key, "left_anti")


def pending_tiles(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles not yet produced."""
    return tiles.join(done.select(key).distinct(), key, "left_anti")


def parse_tile_name(df: DataFrame, name: str, size: float = 5.0) -> DataFrame:
    """The box of a tile called ...X<lon>_Y<lat>...; null where the name says neither."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"X(-?\d+)_Y(-?\d+)", k), F.lit("")).cast("double")
    return df.withColumn("xmin", part(1)).withColumn("ymin", part(2)).withColumn("xmax", F.col("xmin") + size).withColumn("ymax", F.col("ymin") + size)


def write_cells(df: DataFrame, path: str, tile: str = "tile_id") -> None:
    """Cells by tile; a rerun overwrites only the tiles that it holds."""
    df.repartition(tile).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tile).parquet(path)


def write_totals(df: DataFrame, path: str) -> None:
    """Totals as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def flatten_cube(wide: DataFrame, keys: list[str], suffix: str = "_till") -> DataFrame:
    """One row for each key and crop from one column for each crop."""
    columns = [c for c in wide.columns if c.endswith(suffix)]
    long = wide.unpivot(keys, columns, "crop", "value")
    return long.withColumn("crop", F.regexp_replace("crop", f"{suffix}$", "")).filter("value IS NOT NULL")


def field_size_submissions(submissions: DataFrame, quality: DataFrame) -> DataFrame:
    """(sampleid, field_size, weight): the field size of each site that the contributors' summed quality favours; the smallest of equals."""
    weighed = submissions.filter("field_size IS NOT NULL").join(quality.select("userid", "quality"), "userid").groupBy("sampleid", "field_size").agg(F.sum("quality").alias("weight"))
    best = F.min_by(F.struct("field_size", "weight"), F.struct(-F.col("weight"), F.col("field_size")))
    return weighed.groupBy("sampleid").agg(best.alias("b")).select("sampleid", "b.field_size", "b.weight")


def top_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rank_ = 1").drop("rank_")
