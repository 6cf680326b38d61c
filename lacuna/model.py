"""Schemas and value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "location_id string, x double, y double, final_depth double"
ZONE = "zone_id string, zone_name string, max_spacing_m double, ord int, source_layer string, original_name string, ring array<array<struct<x:double,y:double>>>"
SITE = "x double, y double, coverage_radius double, source_pass string, status string, zone_id string, cluster_id string, tier int, is_centreline boolean"
TEST_POINT = "x double, y double, required_radius double, zone string, is_covered boolean"
COMBO = "combo_key string, min_depth int, require_spt boolean, require_txt boolean, require_txe boolean"

# The passes and statuses that files and documents carry.
PASSES = ["First Pass", "Second Pass", "Third Pass"]
STATUSES = ["proposed", "added", "removed", "locked", "centreline"]


def known_pass(c: Column) -> Column:
    """An unknown or missing pass is the first."""
    return F.when(c.isin(PASSES), c).otherwise(F.lit(PASSES[0]))


def known_status(c: Column) -> Column:
    """An unknown or missing status is `proposed`."""
    return F.when(c.isin(STATUSES), c).otherwise(F.lit(STATUSES[0]))


def position_key(x: str = "x", y: str = "y") -> list[Column]:
    """Two points are the same if they agree to six decimal places."""
    return [F.round(F.col(x), 6).alias("kx"), F.round(F.col(y), 6).alias("ky")]
