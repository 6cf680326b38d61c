"""Points and polygons, exactly.

Polygons are rings array<array<struct<x, y>>> without closing points, even-odd. Points meet the edges of their
own cell (`outlines`); no row holds a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scalar import col
from lacuna.operators import djoin, lattice, outlines, region, stream
from lacuna.operators.graph import cut

#: Edges of a polygon that may go with each of its cells.
FEW = 32


def near_regions(points: DataFrame, polygons: DataFrame, reach: float, bucket: float, keys: list[str], far: bool = True) -> DataFrame:
    """Points with each polygon (its columns keys) that contains them or is at most reach away: inside, boundary_m.

    On the boundary: not inside, at distance 0. Points without a place meet nothing. Without far, boundary_m is
    null where it is more than reach, else it is found for points deep inside too: for polygons of at most FEW edges from
    all of them, where points and polygons meet; for others by a descent of each pair.
    """
    e = outlines.edges(polygons, keys)
    named = lambda met: met.select("pt.*", *(F.col("_key")[k].alias(k) for k in keys), "inside", "boundary_m")
    if not far:
        return named(stream.meet(points, e, bucket, "pairs", reach))
    large = e.groupBy("_polygon").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("_polygon")
    large = cut(large)
    if large.isEmpty():
        return named(stream.meet(points, e, bucket, "pairs", reach, far=True))
    small = named(stream.meet(points, cut(e.join(large, "_polygon", "left_anti")), bucket, "pairs", reach, far=True))
    return small.unionByName(_descended(points, cut(e.join(large, "_polygon", "left_semi")), reach, bucket, keys))


def _descended(points: DataFrame, e: DataFrame, reach: float, bucket: float, keys: list[str]) -> DataFrame:
    """near_regions of polygons of many edges; equal points are answered once."""
    met = cut(outlines.held(outlines.spots(points), e, bucket, reach))
    deep = outlines.to_boundary(met.where("boundary_m IS NULL"), e, bucket)
    met = met.where("boundary_m IS NOT NULL").unionByName(deep.withColumn("inside", F.lit(True)))
    met = met.join(e.select("_polygon", "_key").distinct(), "_polygon").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "_key", "inside", "boundary_m")
    here = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
    return points.join(met, here).select(*points.columns, *(F.col("_key")[k].alias(k) for k in keys), "inside", "boundary_m")


def tier_report(points: DataFrame, polygons: DataFrame, keys: list[str], bucket: float, near_m: float = 10.0) -> DataFrame:
    """Each point with the polygons that hold it (distance_to_boundary) or miss it by less than near_m (distance_outside, status)."""
    met = near_regions(points, polygons, near_m, bucket, keys).where(F.col("inside") | (F.col("boundary_m") < near_m))
    d = F.round("boundary_m", 2)
    return met.select(*points.columns, *keys, F.when(F.col("inside"), d).alias("distance_to_boundary"), F.when(~F.col("inside"), d).alias("distance_outside"), F.when(~F.col("inside"), "near_but_outside").alias("status"))


def zone_info(points: DataFrame, zones: DataFrame, keys: list[str], bucket: float, excluded: list | None = None) -> DataFrame:
    """keys and zones, a map from each zone that holds the point to its spacing (C16). zones: zone, spacing, ring."""
    seen = zones.where(~F.col("zone").isin(excluded)) if excluded else zones
    found = stream.meet(points, outlines.edges(seen, ["zone", "spacing"]), bucket, "lists")
    placed = "abs(CAST(x AS double)) < double('infinity') AND abs(CAST(y AS double)) < double('infinity')"
    none = points.where(f"NOT coalesce({placed}, false)").select(*keys, F.lit(None).cast(found.schema["held"].dataType).alias("held"))
    found = found.select(*(F.col("pt")[k].alias(k) for k in keys), "held").unionByName(none)
    several = lambda df, by: not df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()
    held = F.array_distinct("held") if several(seen, ["zone"]) else F.col("held")
    if several(points, keys):  # what rows of one key meet is put together; null keys are not joined
        every = found.where("size(held) > 0").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"))
        found, held = points.select(*keys).join(every, keys, "left"), F.col("held")
    elif keys:
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        held = F.when(known, held)
    return found.select(*keys, F.when(F.size(held) > 0, F.map_from_entries(held)).alias("zones"))


def nearest_region(points: DataFrame, polygons: DataFrame, keys: list[str], key: str, start: float) -> DataFrame:
    """keys, region and distance: the first polygon that holds or touches the point, else the nearest; the least key wins ties.

    Those that no polygon holds descend a pyramid of the cells with edges, start wide at the bottom.
    """
    e = outlines.edges(polygons, [key])
    out = stream.meet(points.select(*dict.fromkeys([*keys, "x", "y"])), e, start, "least")
    out = cut(out.select("pt", "found", F.col("_key")[key].alias("region")))
    lost = out.where("NOT found").select("pt.*")
    near = outlines.nearest_edge(outlines.spots(lost), e, start).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_key")[key].alias("region"), "distance")
    here = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
    lost = lost.join(near, here, "left").select(*keys, "region", "distance")
    placed = "abs(CAST(x AS double)) < double('infinity') AND abs(CAST(y AS double)) < double('infinity')"
    none = points.where(f"NOT coalesce({placed}, false)").select(*keys, F.lit(None).cast(out.schema["region"].dataType).alias("region"), F.lit(None).cast("double").alias("distance"))
    return out.where("found").select(*(F.col("pt")[k].alias(k) for k in keys), "region", F.lit(0.0).alias("distance")).unionByName(lost).unionByName(none)


def centreline_points(lines: DataFrame, keys: list[str], spacing: str = "spacing") -> DataFrame:
    """Locked sites along each line at the zone's spacing (H11): keys, k, x, y, coverage_radius, status, is_centreline."""
    own = lattice.line_samples(lines, spacing, keys).join(lines.select(*keys, F.col(spacing).alias("coverage_radius")), keys)
    return own.withColumns({"status": F.lit("centreline"), "is_centreline": F.lit(True)})


def near_gaps(sites: DataFrame, gaps: DataFrame, zone: str, spacing: str, max_spacing: float) -> DataFrame:
    """Sites within their zone's spacing of one of its gap cells, x and y their centres."""
    own = sites.join(gaps.select(zone).distinct(), zone, "left_semi")
    near = djoin.distance_join(own, gaps.select(F.col(zone).alias("zone"), "x", "y"), spacing, max_spacing).where(F.col(zone) == F.col("r_zone"))
    return near.select(*sites.columns).distinct()


def disc_cells(points: DataFrame, radius: Column | float, h: float, keys: list[str], max_radius: float) -> DataFrame:
    """Cells whose centre is at most radius from the point."""
    k = int(max_radius // h) + 1
    steps = F.sequence(F.lit(-k), F.lit(k))
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    at = points.withColumns({"ix": F.floor(F.col("x") / h), "iy": F.floor(F.col("y") / h), "_r": r}).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    at = at.withColumns({"ix": F.col("ix") + F.col("_i"), "iy": F.col("iy") + F.col("_j")})
    dx, dy = (F.col("ix") + 0.5) * h - F.col("x"), (F.col("iy") + 0.5) * h - F.col("y")
    return at.where(F.sqrt(dx * dx + dy * dy) <= F.col("_r")).select(*keys, "ix", "iy")


def clip_to_visible(cover: DataFrame, zones: DataFrame, zone: str, excluded: list) -> DataFrame:
    """Cells of a coverage that lie in a zone which is not hidden."""
    return region.intersection(cover, zones.where(~col(zone).isin(excluded)) if excluded else zones)


def split_by_zones(gaps: DataFrame, zones: DataFrame, h: float, least_m2: float) -> DataFrame:
    """The pieces that each zone cuts out of the gaps, those of least_m2 or more: zone (an integer), ix, iy, piece (C14)."""
    parts = region.pieces(zones.join(gaps.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").select("zone", "ix", "iy"), "zone")
    large = parts.groupBy("zone", "piece").agg((F.count("*") * h * h).alias("area_m2")).where(F.col("area_m2") >= least_m2)
    return parts.join(large, ["zone", "piece"]).select("zone", "piece", "ix", "iy", "area_m2")
