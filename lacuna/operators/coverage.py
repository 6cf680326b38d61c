"""Coverage of zones by points, its gaps and its figures, and the cube of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import combination_key, percent, safe_depth
from lacuna.operators import djoin, ranking, region

FLAGS = ["has_spt", "has_txt", "has_txe"]
REQUIRED = ["require_spt", "require_txt", "require_txe"]


def qualifies() -> Column:
    """A point row against a combination row: deep enough, and every required test done (B1)."""
    ok = F.col("depth") >= F.col("min_depth")
    for flag, need in zip(FLAGS, REQUIRED, strict=True):
        ok = ok & (~F.col(need) | F.coalesce(F.col(flag), F.lit(False)))
    return ok


def filter_points(points: DataFrame, min_depth: int = 0, require_spt: bool = False, require_txt: bool = False, require_txe: bool = False) -> DataFrame:
    out = points.withColumn("depth", safe_depth("depth")).where(F.col("depth") >= min_depth)
    for flag, need in zip(FLAGS, (require_spt, require_txt, require_txe), strict=True):
        if need:
            out = out.where(F.coalesce(F.col(flag), F.lit(False)))
    return out


def combinations(points: DataFrame, step: int) -> DataFrame:
    """Every combination of depth step and required tests, with its key."""
    from lacuna.functions.scalar import depth_steps

    deepest = points.agg(F.coalesce(F.max(safe_depth("depth")), F.lit(0.0)).alias("deepest"))
    bits = F.explode(F.sequence(F.lit(0), F.lit(7)))
    out = deepest.select(F.explode(depth_steps("deepest", step)).alias("min_depth")).withColumn("mask", bits)
    for i, need in enumerate(REQUIRED):
        out = out.withColumn(need, F.expr(f"(mask & {1 << i}) <> 0"))
    return out.withColumn("combo_key", combination_key("min_depth", *REQUIRED))


def flag_mask() -> Column:
    mask = F.lit(0)
    for i, flag in enumerate(FLAGS):
        mask = mask + F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def covered_tests(tests: DataFrame, points: DataFrame, keys: list[str], max_radius: float) -> DataFrame:
    """Tests (keys, x, y, required_radius) with is_match: is a point within the radius (D1, D2)?"""
    return djoin.distance_join(tests, points.select("x", "y"), "required_radius", max_radius, "exists")


def per_zone(tests: DataFrame, points: DataFrame, keys: list[str], max_radius: float, zone: str = "zone") -> DataFrame:
    """Tests and covered tests of each zone; a zone without points in reach is a gap throughout."""
    c = covered_tests(tests, points, keys, max_radius).groupBy(zone).agg(F.count("*").alias("tests"), F.count_if("is_match").alias("covered"))
    return c.withColumn("covered_pct", F.round(percent("covered", "tests"), 4))


def cube(tests: DataFrame, points: DataFrame, combos: DataFrame, keys: list[str], max_radius: float, zone: str = "zone") -> DataFrame:
    """Covered tests of each zone under every combination, from one distance join.

    For each test and each set of flags, only the deepest point in reach matters; a combination covers
    the test if the deepest point among the flag sets that include its required ones is deep enough.
    Each test keeps at most eight depths, whatever the number of combinations; the depths then count up
    from the largest step down. Combinations without a covered test appear with 0.
    """
    own = points.withColumn("depth", safe_depth("depth")).withColumn("mask", flag_mask()).select("x", "y", "depth", "mask")
    best = djoin.distance_join(tests, own, "required_radius", max_radius).groupBy(*keys, zone, "r_mask").agg(F.max("r_depth").alias("depth"))
    needed = best.withColumn("required", F.explode(F.expr("filter(sequence(0, 7), m -> (m & r_mask) = m)"))).groupBy(*keys, zone, "required").agg(F.max("depth").alias("depth"))
    # each test counts at the last step that its depth reaches, and from there for every step before
    steps = combos.agg(F.array_sort(F.collect_set("min_depth")).alias("steps"))  # one row
    reached = F.expr("size(filter(steps, s -> s <= depth))")
    at = needed.groupBy(zone, "required", "depth").agg(F.count("*").alias("n")).crossJoin(steps).groupBy(zone, "required", reached.alias("step")).agg(F.sum("n").alias("n"))
    totals = tests.groupBy(zone).agg(F.count("*").alias("tests"))
    grid = totals.crossJoin(combos.crossJoin(steps).select("combo_key", F.col("mask").alias("required"), F.expr("array_position(steps, min_depth)").cast("int").alias("step")))  # zones times combinations: the result's own size
    down = Window.partitionBy(zone, "required").orderBy(F.desc("step")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = grid.join(at, [zone, "required", "step"], "left").withColumn("covered", F.coalesce(F.sum("n").over(down), F.lit(0)).cast("long")).select(zone, "combo_key", "tests", "covered")
    return out.withColumn("covered_pct", F.round(percent("covered", "tests"), 4))


def cell_coverage(cells: DataFrame, points: DataFrame, h: float | str, zone: str, radius: str, max_radius: float) -> DataFrame:
    """Cells (zone, ix, iy, radius) with is_match: is a point within the zone's radius of the centre? h: metres, or a column."""
    w = F.col(h) if isinstance(h, str) else F.lit(float(h))
    tests = cells.withColumns({"x": (F.col("ix") + 0.5) * w, "y": (F.col("iy") + 0.5) * w})
    return djoin.distance_join(tests, points.select("x", "y"), radius, max_radius, "exists").drop("x", "y")


def gap_statistics(gaps: DataFrame, points: DataFrame, h: float | str, zone: str, least_m2: float = 100.0, start: float = 200.0) -> DataFrame:
    """One row for each connected gap: area, centroid, representative cell, nearest point (D3).

    gaps: zone (integer), ix, iy; h: metres, or a column of gaps that is the same within a zone. Sorted by area, numbered from 1. The representative is the gap's cell
    nearest to the centroid; rep_distance_m is the distance from there to the nearest point.
    """
    w, keys = (F.col(h), [zone, "piece", h]) if isinstance(h, str) else (F.lit(float(h)), [zone, "piece"])
    own = region.pieces(gaps, zone)
    size = own.groupBy(*keys).agg((F.count("*") * w * w).alias("area_m2"), ((F.avg("ix") + 0.5) * w).alias("centroid_x"), ((F.avg("iy") + 0.5) * w).alias("centroid_y")).where(F.col("area_m2") >= least_m2)
    d2 = lambda: ((F.col("ix") + 0.5) * w - F.col("centroid_x")) * ((F.col("ix") + 0.5) * w - F.col("centroid_x")) + ((F.col("iy") + 0.5) * w - F.col("centroid_y")) * ((F.col("iy") + 0.5) * w - F.col("centroid_y"))
    rep = own.join(size, keys).groupBy(*keys, "area_m2", "centroid_x", "centroid_y").agg(F.min(F.struct(d2().alias("d"), F.col("iy"), F.col("ix"))).alias("m"))
    rep = rep.withColumns({"x": (F.col("m.ix") + 0.5) * w, "y": (F.col("m.iy") + 0.5) * w}).drop("m")
    near = djoin.nearest(rep.select(zone, "piece", "x", "y"), points, [zone, "piece"], points.columns[0], start)
    out = rep.join(near, [zone, "piece"], "left")
    return ranking.numbered(out, [F.desc("area_m2"), "piece"], "id").select("id", zone, "piece", "area_m2", (F.col("area_m2") / 10_000).alias("area_ha"), "centroid_x", "centroid_y", F.col("x").alias("suggested_x"), F.col("y").alias("suggested_y"), F.col("distance").alias("rep_distance_m"))


def summary(per_zone_area: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: covered, uncovered and total area, share, gaps, largest gap, largest distance."""
    a = per_zone_area.agg(F.coalesce(F.sum("covered_m2"), F.lit(0.0)).alias("covered_m2"), F.coalesce(F.sum("total_m2"), F.lit(0.0)).alias("total_m2"))
    g = gaps.agg(F.count("*").alias("gap_count"), F.coalesce(F.max("area_m2"), F.lit(0.0)).alias("largest_gap_m2"), F.coalesce(F.max("rep_distance_m"), F.lit(0.0)).alias("max_distance_m"))
    out = a.crossJoin(g)  # one row each
    return out.select("covered_m2", (F.col("total_m2") - F.col("covered_m2")).alias("uncovered_m2"), "total_m2", (F.col("covered_m2") / 10_000).alias("covered_ha"), F.round(percent("covered_m2", "total_m2"), 4).alias("covered_pct"), "gap_count", "largest_gap_m2", "max_distance_m")


def zone_stats(covered: DataFrame, h: float, zone: str) -> DataFrame:
    """Area, covered area and share of each zone, and their sums as the row without a zone."""
    a = covered.groupBy(zone).agg((F.count("*") * h * h).alias("total_m2"), (F.count_if("is_match") * h * h).alias("covered_m2"))
    out = a.rollup(zone).agg(F.sum("total_m2").alias("total_m2"), F.sum("covered_m2").alias("covered_m2"))
    return out.withColumn("covered_pct", F.round(percent("covered_m2", "total_m2"), 1))


def verify(gap_cells: DataFrame, sites: DataFrame, h: float, keys: list[str], radius: str, max_radius: float) -> DataFrame:
    """Does the proposal close the gaps: at least 99 % of their area, or less than 100 square metres left (D11)?"""
    tests = gap_cells.withColumns({"x": (F.col("ix") + 0.5) * h, "y": (F.col("iy") + 0.5) * h})
    done = djoin.distance_join(tests, sites.select("x", "y"), radius, max_radius, "exists")
    out = done.agg((F.count("*") * h * h).alias("gap_m2"), (F.count_if("is_match") * h * h).alias("closed_m2"))
    return out.withColumn("remaining_m2", F.col("gap_m2") - F.col("closed_m2")).withColumn("is_complete", (F.col("remaining_m2") < 100) | (F.col("closed_m2") >= 0.99 * F.col("gap_m2")))


def compare_with_naive(gaps: DataFrame, sites: DataFrame) -> DataFrame:
    """One point a gap against the proposal."""
    out = gaps.agg(F.count("*").alias("naive")).crossJoin(sites.agg(F.count("*").alias("proposed")))  # one row each
    return out.withColumn("improvement_pct", F.when(F.col("naive") > 0, 100.0 * (F.col("naive") - F.col("proposed")) / F.col("naive")).otherwise(F.lit(0.0)))


def zones_of_points(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """zone_ids of every point: all zone boxes that hold it, borders included; none: an empty list.

    zones: zone_id, x0, y0, x1, y1. Zones are repeated over the buckets that they span.
    """
    wide = 500.0
    spread = zones.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("x0") / wide), F.floor(F.col("x1") / wide)))).withColumn("_by", F.explode(F.sequence(F.floor(F.col("y0") / wide), F.floor(F.col("y1") / wide))))
    own = points.withColumns({"_bx": F.floor(F.col("x") / wide), "_by": F.floor(F.col("y") / wide)})
    hit = own.join(spread, ["_bx", "_by"]).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").groupBy(*keys).agg(F.array_sort(F.collect_set("zone_id")).alias("zone_ids"))
    return points.join(hit, keys, "left").withColumn("zone_ids", F.coalesce("zone_ids", F.array().cast("array<bigint>")))


def hide_excluded(points: DataFrame, excluded: list[int]) -> DataFrame:
    """Points none of whose zones is excluded."""
    return points.where(~F.arrays_overlap("zone_ids", F.array(*[F.lit(z).cast("bigint") for z in excluded]))) if excluded else points


def outside(points: DataFrame) -> DataFrame:
    """Points in no zone."""
    return points.where(F.size("zone_ids") == 0)
