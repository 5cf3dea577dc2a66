"""Scenes and observations: filters, masks, indices, time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_scenes(scenes: DataFrame, start, end, cloud_lt: float, ts: str = "ts", cloud: str = "cloudy_pct") -> DataFrame:
    """Scenes from ``start`` up to but not including ``end`` under a share of clouds."""
    return scenes.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)) & (F.col(cloud) < cloud_lt))


def link_quality(obs: DataFrame, quality: DataFrame, keys: list[str], column: str = "cs_cdf") -> DataFrame:
    """R2: the quality of each observation from another collection, by scene (and pixel)."""
    return obs.join(quality.select(*keys, column), keys, "left")


#: Least clear-sky score, classes kept, classes dropped.
PROFILES = {
    "strict": (0.65, (4, 5, 6, 7), ()), "advanced": (0.80, (), (1, 2, 3, 6, 8, 9, 10, 11)), "moderate": (0.65, (), (1, 3, 8, 9, 10)), "relaxed": (0.60, (), (1, 3, 6, 9, 10)),
    "permissive": (0.50, (), (1, 9, 10)), "minimal": (0.40, (), (1,)),
}


def mask_pixels(obs: DataFrame, profile: str, score: str = "cs_cdf", scl: str = "scl") -> DataFrame:
    """Observations that a profile lets through."""
    least, keep, drop = PROFILES[profile]
    ok = F.col(score) >= least
    return obs.filter(ok & F.col(scl).isin(*keep) if keep else ok & ~F.col(scl).isin(*drop))


def mask_cropland(obs: DataFrame, cover: DataFrame, pixel: str = "pixel_id", code: int = 40) -> DataFrame:
    """Observations of pixels whose land cover is cropland."""
    return obs.join(cover.filter(F.col("cover") == code).select(pixel), pixel, "left_semi")


def normalized_difference(a, b, scale: int | None = None):
    """(a - b) / (a + b) within -1..1, null for a zero sum; ``scale`` gives rounded whole numbers."""
    nd = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(a - b, a + b)))
    nd = F.when((a + b).isNotNull() & (a + b != 0), nd)
    return F.bround(nd * scale).cast("int") if scale else nd


def ratio_index(a, b):
    """A / b, null for b of 0."""
    return F.try_divide(a, b)


def valid_pixel_count(obs: DataFrame, scene: str = "scene_id", value: str = "value", more_than: int = 0) -> DataFrame:
    """(scene, valid_pixels) of scenes with more than so many valid pixels."""
    return obs.groupBy(scene).agg(F.count(value).alias("valid_pixels")).filter(F.col("valid_pixels") > more_than)


def best_scene(counts: DataFrame, by: str, scene: str = "scene_id") -> DataFrame:
    """The scene with the most valid pixels of each group, the smallest id of equals."""
    return counts.groupBy(by).agg(F.min_by(scene, F.struct(-F.col("valid_pixels"), F.col(scene))).alias("best_scene"))


#: Band selections.
BANDS = {"rgb": ("b4", "b3", "b2"), "false_colour": ("b8", "b4", "b3")}


def scale_bands(obs: DataFrame, selection: str, keys: list[str], factor: float = 1e-4) -> DataFrame:
    """A selection of bands as reflectances."""
    return obs.select(*keys, *[(F.col(b) * factor).alias(b) for b in BANDS[selection]])


def to_mjd(ts):
    """A timestamp as modified Julian day."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000 + 40_587


def mjd_to_doy(mjd, base: float = 58_484):
    """Day of the year that starts at ``base``."""
    return mjd - base + 1


def mjd_to_ms(mjd):
    """Milliseconds since 1970."""
    return (mjd - 40_587) * 86_400_000


def aoi_box(lon, lat, width, height, per_lat: float = 110_540.0):
    """(west, south, east, north) around a place from metres; an error outside the globe."""
    dx, dy = width / 2 / (111_320 * F.cos(F.radians(lat))), height / 2 / per_lat
    bad = ~(lon.between(-180, 180) & lat.between(-90, 90))
    ok = lambda c: F.when(bad, F.raise_error(F.lit("the place is outside the globe")).cast("double")).otherwise(c)
    return ok(lon - dx), ok(lat - dy), ok(lon + dx), ok(lat + dy)


def in_polygon(x, y, corners: list[tuple[float, float]]):
    """Whether a place is inside a polygon given by its corners, by ray casting."""
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            hits = hits + F.when(hit, 1).otherwise(0)
    return hits % 2 == 1


def quadrant_of(x, y, mid_x, mid_y):
    """NW, NE, SW or SE of the middle."""
    return F.concat(F.when(y >= mid_y, "N").otherwise("S"), F.when(x < mid_x, "W").otherwise("E"))
