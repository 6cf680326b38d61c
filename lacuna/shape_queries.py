"""Queries over polygons, text shapes and other coordinates, each with its SQL; they join the registry of lacuna.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import geometry, scalar
from lacuna.operators import coverage, djoin, places, region
from lacuna.plans import inputs as src
from lacuna.queries import ZG, HD, H, MAX_R, OWN_COVERED, RUNS, STEP, TEST_FACTOR, TEST_KEYS, A, C, CG, CUBE, P, S, T, Z, _gaps, _open_tests, covered_sql, d, query

HIDDEN = [3, 7, 12]
SEEN = "zone NOT IN (3, 7, 12)"

# --- polygons ---------------------------------------------------------------------------------

#: Each site's L-shaped polygon, with a notch in its north-east quarter.
CORNERS = [(-600.5, -600.5), (600.5, -600.5), (600.5, 0.5), (0.5, 0.5), (0.5, 600.5), (-600.5, 600.5)]


def _shapes(spark, sf):
    corner = ", ".join(f"struct(x + ({a}D) AS x, y + ({b}D) AS y)" for a, b in CORNERS)
    return src.sites(spark, sf).selectExpr("id AS shape", f"array(array({corner})) AS ring")


def _side(a: tuple[float, float], b: tuple[float, float]) -> str:
    """The distance from a point to a side along an axis, in SQL."""
    gap = lambda c, lo, hi: f"greatest({c} - ({hi}), ({lo}) - ({c}), 0)"
    x = gap("pts.x - sites.x", min(a[0], b[0]), max(a[0], b[0]))
    y = gap("pts.y - sites.y", min(a[1], b[1]), max(a[1], b[1]))
    return f"sqrt({x} * {x} + {y} * {y})"


BOUNDARY = f"least({', '.join(_side(a, b) for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))})"
HELD = """(pts.x - sites.x > -600.5 AND pts.x - sites.x < 600.5 AND pts.y - sites.y > -600.5 AND pts.y - sites.y < 0.5
  OR pts.x - sites.x > -600.5 AND pts.x - sites.x < 0.5 AND pts.y - sites.y > -600.5 AND pts.y - sites.y < 600.5)"""
MET = f"{P}, {S}, met AS (SELECT pts.id, sites.id AS shape, {HELD} AS inside, {BOUNDARY} AS boundary FROM pts, sites)"


@query(f"""WITH {MET} SELECT id, shape, CASE WHEN inside THEN round(boundary, 2) END AS distance_to_boundary, CASE WHEN NOT inside THEN round(boundary, 2) END AS distance_outside, CASE WHEN NOT inside THEN 'near_but_outside' END AS status FROM met WHERE inside OR boundary < 10""")
def tier_report(spark, sf):
    return places.tier_report(src.points(spark, sf).select("id", "x", "y"), _shapes(spark, sf), ["shape"], 1000.0).select("id", "shape", "distance_to_boundary", "distance_outside", "status")


@query(f"""WITH {MET} SELECT pts.id, (SELECT string_agg(shape || ':' || (100 + 50 * (shape % 4)), ',' ORDER BY shape) FROM met WHERE met.id = pts.id AND inside AND shape NOT IN (3, 7, 12)) AS zones FROM pts""")
def zone_info(spark, sf):
    z = _shapes(spark, sf).selectExpr("shape AS zone", "100 + 50 * (shape % 4) AS spacing", "ring")
    info = places.zone_info(src.points(spark, sf).select("id", "x", "y"), z, ["id"], 1000.0, HIDDEN)
    return info.select("id", F.array_join(F.transform(F.map_entries("zones"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("zones"))


@query(f"""WITH {MET}, n AS (SELECT *, CASE WHEN inside THEN 0 ELSE boundary END AS away FROM met) SELECT id, arg_min(shape, (away, shape)) AS region, round(min(away), 4) AS distance FROM n GROUP BY id""")
def nearest_region(spark, sf):
    return places.nearest_region(src.points(spark, sf).select("id", "x", "y"), _shapes(spark, sf), ["id"], "shape", 500.0).withColumn("distance", F.round("distance", 4))


# --- regions ----------------------------------------------------------------------------------

DISC = f"""cc AS (SELECT DISTINCT ix, iy, (ix + CAST(0.5 AS DOUBLE)) * {HD} AS x, (iy + CAST(0.5 AS DOUBLE)) * {HD} AS y FROM cells WHERE {SEEN})"""


@query(f"""WITH {P}, {ZG}, {CG}, {DISC} SELECT pts.id, count(*) * {A} AS area_m2 FROM pts JOIN cc ON pts.x BETWEEN cc.x - 200 AND cc.x + 200 AND {d("cc", "pts")} <= 200 GROUP BY pts.id""")
def clipped_coverage(spark, sf):
    """What of each point's own coverage lies in zones that are not hidden."""
    cover = places.disc_cells(src.points(spark, sf).select("id", "x", "y"), 200.0, H, ["id"], 200.0)
    return region.area(places.clip_to_visible(cover, src.cells(spark, sf, H, 100.0).select("zone", "ix", "iy"), "zone", HIDDEN), H, ["id"])


@query(f"""WITH RECURSIVE {covered_sql(HD, CG).replace(Z, ZG)}, h AS (SELECT DISTINCT ix, iy FROM cov WHERE NOT hit AND {SEEN}), g AS (SELECT zone, {HD} AS h, ix, iy FROM cells JOIN h USING (ix, iy)), {RUNS}
SELECT zone, piece, count(*) * {A} AS area_m2 FROM piece GROUP BY zone, piece HAVING count(*) * {A} >= 10000""")
def gap_zone_split(spark, sf):
    """The gaps of the zones that are not hidden, split at all zones."""
    cells = src.cells(spark, sf, H, 100.0)
    gaps = coverage.cell_coverage(cells.where(SEEN), src.points(spark, sf), H, "zone", "spacing", MAX_R).where("NOT is_match")
    return places.split_by_zones(gaps, cells, H, 10_000.0).groupBy("zone", "piece").agg(F.first("area_m2").alias("area_m2"))


CELL_TESTS = f"""{C}, tp AS (SELECT zone, iy AS "row", ix AS k, (ix + CAST(0.5 AS DOUBLE)) * {HD} AS x, (iy + CAST(0.5 AS DOUBLE)) * {HD} AS y, spacing AS required_radius FROM cells)"""
AREAS = CUBE.format(p=P, z=Z, t=CELL_TESTS, step=STEP, near=d("tp", "pts"), pct="0")


@query(f"SELECT combo_key, CAST(sum(covered) AS DOUBLE) * {A} / 10000 AS covered_ha, CAST(sum(tests) - sum(covered) AS DOUBLE) * {A} / 10000 AS uncovered_ha FROM ({AREAS}) GROUP BY combo_key")
def combination_areas(spark, sf):
    """Covered and open hectares of each filter combination."""
    cells = src.cells(spark, sf, H).select("zone", F.col("iy").alias("row"), F.col("ix").alias("k"), ((F.col("ix") + 0.5) * H).alias("x"), ((F.col("iy") + 0.5) * H).alias("y"), F.col("spacing").alias("required_radius"))
    p = src.points(spark, sf)
    c = coverage.cube(cells, p, coverage.combinations(p, STEP), TEST_KEYS, MAX_R).groupBy("combo_key").agg(F.sum("covered").alias("n"), F.sum("tests").alias("of"))
    return c.select("combo_key", scalar.hectares(F.col("n").cast("double") * H * H).alias("covered_ha"), scalar.hectares((F.col("of") - F.col("n")).cast("double") * H * H).alias("uncovered_ha"))


# --- centrelines ------------------------------------------------------------------------------

LINES = f"""l AS (SELECT zone, spacing, x0, y0, x1, y1, CAST(greatest(1, ceil(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / spacing)) AS BIGINT) AS n FROM zones),
line AS (SELECT zone, spacing, k, x0 + CAST(k AS DOUBLE) / n * (x1 - x0) AS x, y0 + CAST(k AS DOUBLE) / n * (y1 - y0) AS y FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM l))"""


def _centreline(spark, sf):
    lines = src.zones(spark, sf).selectExpr("zone", "spacing", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y1 AS y)) AS points")
    return places.centreline_points(lines, ["zone"])


@query(f"""WITH {Z}, {LINES} SELECT zone, CAST(k AS INT) AS k, round(x, 4) AS x, round(y, 4) AS y, spacing AS coverage_radius, 'centreline' AS status, true AS is_centreline FROM line""")
def centreline_points(spark, sf):
    return _centreline(spark, sf).withColumns({c: F.round(c, 4) for c in "xy"})


GAP_CELLS = f"{OWN_COVERED}, g AS (SELECT zone, (ix + CAST(0.5 AS DOUBLE)) * h AS x, (iy + CAST(0.5 AS DOUBLE)) * h AS y FROM cov WHERE NOT hit)"


@query(f"""WITH {GAP_CELLS}, {LINES} SELECT zone, CAST(k AS INT) AS k FROM line WHERE EXISTS (SELECT 1 FROM g WHERE g.zone = line.zone AND {d("g", "line")} <= line.spacing)""")
def centreline_near_gaps(spark, sf):
    return _near_centreline(spark, sf).select("zone", "k")


def _near_centreline(spark, sf):
    gaps = _gaps(spark, sf).select("zone", ((F.col("ix") + 0.5) * F.col("h")).alias("x"), ((F.col("iy") + 0.5) * F.col("h")).alias("y"))
    return places.near_gaps(_centreline(spark, sf).select("zone", "k", "x", "y", "coverage_radius"), gaps, "zone", "coverage_radius", MAX_R)


@query(f"""WITH {P}, {Z}, {T}, {LINES}, o AS (SELECT * FROM tp WHERE NOT EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {d("tp", "pts")} <= tp.required_radius)),
c AS (SELECT zone, EXISTS (SELECT 1 FROM line WHERE {d("o", "line")} <= o.required_radius) AS hit FROM o) SELECT zone, count(*) AS tests, count(*) FILTER (WHERE hit) AS by_centreline FROM c GROUP BY zone""")
def centreline_cover(spark, sf):
    """Open tests of each zone, and how many of them a locked centreline point already covers."""
    t = djoin.pre_covered(_open_tests(spark, sf), _centreline(spark, sf).select("x", "y"), ["problem", "test"], MAX_R)
    return t.groupBy(F.col("problem").alias("zone")).agg(F.count("*").alias("tests"), F.count_if("is_match").alias("by_centreline"))


# --- text, coordinates, colours ---------------------------------------------------------------

TEXT = ", ".join("printf('%.6f %.6f', x + ({}), y + ({}))".format(*c) for c in [*CORNERS, CORNERS[0]])


@query(f"""WITH {S} SELECT id AS shape, 'POLYGON ((' || concat_ws(', ', {TEXT}) || '))' AS text, 6 AS corners, CAST(1201 * 601 + 601 * 600 AS DOUBLE) AS area_m2 FROM sites""")
def polygon_text(spark, sf):
    """Polygons as rounded text, and what is read back from it."""
    t = _shapes(spark, sf).withColumn("text", geometry.rounded_wkt(geometry.wkt("ring")))
    return t.withColumn("back", geometry.rings("text")).select("shape", "text", F.size(F.col("back")[0]).alias("corners"), region.ring_area("back").alias("area_m2"))


@query(f"""WITH {P} SELECT id, 400000 + x AS x, 300000 + y AS y FROM pts""")
def grid_round_trip(spark, sf):
    """Grid metres to degrees and back; both datum shifts leave centimetres, so that tenths are equal."""
    p = src.points(spark, sf).selectExpr("id", "400000 + x AS x", "300000 + y AS y")
    back = geometry.to_grid(geometry.to_degrees(p, "x", "y"), "lon", "lat", "bx", "by")
    return back.select("id", F.round("bx", 1).alias("x"), F.round("by", 1).alias("y"))


@query(f"""WITH {Z} SELECT zone, CAST(k AS INT) AS k, round(x0 + spacing * cos(k * 2 * pi() / 64), 4) + 0 AS x, round(y0 + spacing * sin(k * 2 * pi() / 64), 4) + 0 AS y FROM (SELECT *, unnest(range(0, 65)) AS k FROM zones)""")
def circle_outlines(spark, sf):
    z = src.zones(spark, sf).select("zone", F.posexplode(geometry.circle("x0", "y0", "spacing")).alias("k", "p"))
    return z.select("zone", "k", (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"))


@query("""WITH p AS (SELECT a.n_name AS a, b.n_name AS b, a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, a AS zone_a, b AS zone_b FROM p""")
def known_pairs(spark, sf):
    """Keys of both forms, read back to their zones."""
    n = src.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS i", "n_name")
    names = n.agg(F.collect_list("n_name").alias("names"))  # one row of zone names
    pair = n.join(n.selectExpr("i AS j", "n_name AS b"), F.col("i") != F.col("j")).join(names)
    key = F.concat("n_name", F.when((F.col("i") + F.col("j")) % 2 == 0, "||").otherwise("_"), "b")
    back = pair.withColumn("z", scalar.known_pair(key, "names"))
    return back.select("i", "j", F.col("z")[0].alias("zone_a"), F.col("z")[1].alias("zone_b"))


@query(f"""WITH {Z} SELECT zone, printf('#%02x%02x%02x', CAST(trunc(16 + (240 - 16) * (zone / CAST(25 AS DOUBLE))) AS INT), CAST(trunc(200 - 136 * (zone / CAST(25 AS DOUBLE))) AS INT), 255) AS colour, x0 - (x1 - x0) / 4 AS x0, y0 - (y1 - y0) / 4 AS y0, x1 + (x1 - x0) / 4 AS x1, y1 + (y1 - y0) / 4 AS y1 FROM zones""")
def colours_and_bounds(spark, sf):
    z = src.zones(spark, sf).withColumn("colour", geometry.mixed_colour("#10c8ff", "#f040ff", F.col("zone") / F.lit(25.0)))
    return z.select("zone", "colour", *geometry.expanded("x0", "y0", "x1", "y1", 0.25))
