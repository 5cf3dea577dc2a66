"""Column functions of the library, for use in any select."""

from furrow.operators.composites import edge_index, season_of
from furrow.operators.grid import fill_default, reclassify, sanitize, shallow_mask, snap_to_categories, to_cell, to_lonlat
from furrow.operators.phenology import seasonality
from furrow.operators.quota import scenario_blend
from furrow.operators.scenes import aoi_box, in_polygon, mjd_to_doy, mjd_to_ms, normalized_difference, quadrant_of, ratio_index, to_mjd
from furrow.operators.suitability import canonical_crop, logit_score
from furrow.operators.tillage import category_code
from furrow.operators.training import hard_label, hash_order, haversine, percent_triplet

__all__ = [
    "aoi_box", "canonical_crop", "category_code", "edge_index", "fill_default", "hard_label", "hash_order", "haversine", "in_polygon", "logit_score", "mjd_to_doy", "mjd_to_ms", "normalized_difference", "percent_triplet",
    "quadrant_of", "ratio_index", "reclassify", "sanitize", "scenario_blend", "season_of", "seasonality", "shallow_mask", "snap_to_categories", "to_cell", "to_lonlat", "to_mjd",
]
