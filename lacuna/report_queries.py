"""Checks, tallies and tables that follow a proposal, each with its SQL; they join the registry of lacuna.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import scalar
from lacuna.operators import consolidate, coverage, dedupe, region
from lacuna.plans import inputs as src
from lacuna.queries import COVERED, HD, H, MAX_R, PIECES, A, C, E, P, S, Z, _covered_cells, _gaps, d, query
from lacuna.sources import geojson, points, sinks
from lacuna.streaming import edits as what_if

SPACING = "CASE WHEN zone % 5 = 4 THEN NULL ELSE CAST(100 + 50 * (zone % 3) AS DOUBLE) END"


# --- checks of a proposal ---------------------------------------------------------------------


@query(f"""WITH {COVERED}, {S}, g AS (SELECT spacing, (ix + CAST(0.5 AS DOUBLE)) * {HD} AS x, (iy + CAST(0.5 AS DOUBLE)) * {HD} AS y FROM cov WHERE NOT hit),
n AS (SELECT count(*) * {A} AS gap_m2, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sites WHERE {d("g", "sites")} <= g.spacing)) * {A} AS closed_m2 FROM g)
SELECT gap_m2, closed_m2, gap_m2 - closed_m2 AS remaining_m2, gap_m2 - closed_m2 < 100 OR closed_m2 >= CAST(0.99 AS DOUBLE) * gap_m2 AS is_complete FROM n""")
def proposal_check(spark, sf):
    """How much of the gaps the sites close."""
    gaps = _covered_cells(spark, sf).where("NOT is_match").select("zone", "spacing", "ix", "iy")
    return coverage.verify(gaps, src.sites(spark, sf), H, ["zone"], "spacing", MAX_R)


@query(f"""WITH RECURSIVE {PIECES}, {S}, n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT zone, piece FROM piece)) AS naive, (SELECT count(*) FROM sites) AS proposed)
SELECT *, CASE WHEN naive > 0 THEN CAST(100 AS DOUBLE) * (naive - proposed) / naive ELSE 0 END AS improvement_pct FROM n""")
def naive_comparison(spark, sf):
    """One site for each gap against the sites there are."""
    return coverage.compare_with_naive(region.pieces(_gaps(spark, sf), "zone").select("zone", "piece").distinct(), src.sites(spark, sf))


@query(f"""WITH {P}, {Z} SELECT id FROM pts WHERE NOT EXISTS (SELECT 1 FROM zones WHERE pts.x BETWEEN x0 AND x1 AND pts.y BETWEEN y0 AND y1 AND zone % 2 = 0)""")
def points_in_no_zone(spark, sf):
    """Points outside all zones of even number."""
    z = src.zones(spark, sf).where("zone % 2 = 0").select(F.col("zone").alias("zone_id"), "x0", "y0", "x1", "y1")
    return coverage.outside(coverage.zones_of_points(src.points(spark, sf).select("id", "x", "y"), z, ["id"])).select("id")


@query(f"""WITH {S}, {Z}, {C}, near AS (SELECT DISTINCT s.id, c.zone FROM sites s JOIN cells c ON c.ix BETWEEN floor(s.x / {HD}) - 4 AND floor(s.x / {HD}) + 4 AND c.iy BETWEEN floor(s.y / {HD}) - 4 AND floor(s.y / {HD}) + 4
  AND ((c.ix - floor(s.x / {HD})) * (c.ix - floor(s.x / {HD})) + (c.iy - floor(s.y / {HD})) * (c.iy - floor(s.y / {HD}))) * {A} <= 90000)
SELECT n.id, n.zone, 'external' AS role FROM near n JOIN sites s ON s.id = n.id WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.zone = n.zone AND c.ix = floor(s.x / {HD}) AND c.iy = floor(s.y / {HD}))""")
def external_sites(spark, sf):
    """Sites beyond a zone that still reach into it."""
    return consolidate.external(src.sites(spark, sf), src.cells(spark, sf, H).select("zone", "ix", "iy"), MAX_R, H, ["zone"]).select("id", "zone", "role")


@query(f"""WITH {Z}, s AS (SELECT zone % 5 AS g, {SPACING} AS v FROM zones) SELECT g, coalesce(min(v), 100) AS least, coalesce(max(v), 100) AS most, coalesce(avg(v), 100) AS mean FROM s GROUP BY g""")
def group_spacing(spark, sf):
    """The spacing of each fifth of the zones, by all methods; without any spacing the fallback."""
    z = src.zones(spark, sf).selectExpr("zone % 5 AS g", f"{SPACING} AS max_spacing_m")
    least, most, mean = (consolidate.spacing_of(z, ["g"], m).withColumnRenamed("spacing", n) for m, n in (("min", "least"), ("max", "most"), ("average", "mean")))
    return least.join(most, "g").join(mean, "g")


# --- tallies and tables -----------------------------------------------------------------------


@query(f"""WITH {S}, f AS (SELECT * FROM sites WHERE id % 3 <> 0 UNION ALL SELECT id, x + 5, y FROM sites WHERE id % 4 = 0)
SELECT (SELECT count(*) FROM sites) AS original, (SELECT count(*) FROM f) AS final, (SELECT count(*) FROM sites WHERE id % 3 = 0) AS removed, (SELECT count(*) FROM sites WHERE id % 4 = 0) AS added, (SELECT count(*) FROM f) - (SELECT count(*) FROM sites) AS net_change""")
def pass_tallies(spark, sf):
    """Sites before and after a pass that removes every third and adds beside every fourth."""
    s = src.sites(spark, sf)
    gone, new = s.where("id % 3 = 0"), s.where("id % 4 = 0").withColumn("x", F.col("x") + 5)
    return consolidate.tallies(s, dedupe.assemble(s, [gone], [new]), gone, new)


@query(f"""WITH {S} SELECT id, x, y FROM sites WHERE id % 3 <> 0 UNION ALL SELECT id, x + CAST(0.01 AS DOUBLE), y FROM sites m WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM sites s WHERE s.id % 3 <> 0 AND s.x = m.x AND s.y = m.y)""")
def restored_sites(spark, sf):
    """Sites with every even one that went missing; a hundredth of a unit is no other place."""
    s = src.sites(spark, sf)
    return dedupe.restore_missing(s.where("id % 3 <> 0"), s.where("id % 2 = 0").withColumn("x", F.col("x") + 0.01))


@query(f"""WITH RECURSIVE {P}, {E}, {Z}, {src.FOLDED} SELECT e.id AS "ID", e.x AS "Easting", e.y AS "Northing", coalesce(string_agg(CAST(zone AS VARCHAR), ', ' ORDER BY zone), '') AS "Zone" FROM ended e LEFT JOIN zones ON e.x BETWEEN x0 AND x1 AND e.y BETWEEN y0 AND y1 WHERE edited AND e.id % 7 <> 0 GROUP BY e.id, e.x, e.y""")
def edited_table(spark, sf):
    """The file of edited points, without every seventh."""
    z = src.zones(spark, sf).select(F.col("zone").alias("zone_id"), "x0", "y0", "x1", "y1")
    edited = coverage.zones_of_points(what_if.apply_edits(src.points(spark, sf).select("id", "x", "y"), src.edits(spark, sf)).where("is_edited"), z, ["id"])
    rows = edited.withColumn("index", F.col("id"))
    return sinks.edited_points_csv(rows, rows.where("id % 7 = 0").select("index"))


@query(f"""WITH {E}, a AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'known ' || seq END AS known FROM edits WHERE action = 'add'), n AS (SELECT seq, known, row_number() OVER (PARTITION BY known IS NULL ORDER BY seq) AS k FROM a)
SELECT seq, coalesce(known, 'NEW_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END) AS location_id FROM n""")
def numbered_additions(spark, sf):
    """Added points that come without an id get numbers in order."""
    a = src.edits(spark, sf).where("action = 'add'").selectExpr("seq", "CASE WHEN seq % 3 = 0 THEN concat('known ', seq) END AS location_id")
    return what_if.new_ids(a)


@query("""WITH s AS (SELECT event_type AS source, max(ts) AS modified FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT count(*) AS sources, arg_min(source, modified) AS oldest, arg_max(source, modified) AS newest, date_diff('second', date_trunc('second', min(modified)), date_trunc('second', max(modified))) AS apart_s, date_diff('second', date_trunc('second', min(modified)), date_trunc('second', max(modified))) > 60 AS is_stale FROM s""")
def source_staleness(spark, sf):
    """Whether the last events of the kinds are more than a minute apart."""
    s = src.table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("modified"))
    return geojson.staleness(s.withColumn("is_dynamic", F.col("source") != "view"), 60)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS zone_number, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'b ' || n_name ELSE 'Zone_' || n_nationkey END AS zone_name, CASE n_nationkey % 4 WHEN 0 THEN CAST(80 AS DOUBLE) WHEN 1 THEN CAST(120 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS max_spacing_m FROM nation""")
def zone_names(spark, sf):
    """Names and spacings by what their properties hold; a spacing that is no number is passed over."""
    props = "map_filter(map('Name', CASE WHEN n_nationkey % 3 = 0 THEN n_name END, 'zone_name', CASE WHEN n_nationkey % 3 = 1 THEN concat('b ', n_name) END, 'max_spacing_m', CASE n_nationkey % 4 WHEN 0 THEN '80' WHEN 2 THEN 'wide' END, 'spacing', CASE WHEN n_nationkey % 4 = 1 THEN '120' END), (k, v) -> v IS NOT NULL)"
    z = src.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS zone_number", f"{props} AS properties")
    return geojson.named_zones(z).select("zone_number", "zone_name", "max_spacing_m")


@query(f"""WITH {S}, {Z} SELECT zone FROM zones WHERE x1 >= (SELECT min(x) FROM sites WHERE id % 9 = 0) - 50 AND x0 <= (SELECT max(x) FROM sites WHERE id % 9 = 0) + 50 AND y1 >= (SELECT min(y) FROM sites WHERE id % 9 = 0) - 50 AND y0 <= (SELECT max(y) FROM sites WHERE id % 9 = 0) + 50""")
def zones_in_extent(spark, sf):
    """Zones that meet the extent of every ninth site, 50 wider."""
    return points.clip_to_box(src.zones(spark, sf), points.extent(src.sites(spark, sf).where("id % 9 = 0")), 50.0).select("zone")


@query("""SELECT p_partkey AS part, p_brand AS brand, CAST((dense_rank() OVER (ORDER BY p_brand) - 1) % 7 AS INT) AS colour FROM part""")
def brand_colours(spark, sf):
    """One of seven colours for each brand."""
    return scalar.palette_index(src.table(spark, sf, "part").selectExpr("p_partkey AS part", "p_brand AS brand"), "brand", 7)


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, n_name AS zone_a, r_name AS zone_b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def split_keys(spark, sf):
    """Pair keys, split again."""
    s, n, r = (src.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    named = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return named.select(F.col("s_suppkey").cast("long").alias("id"), scalar.pair_key("n_name", "r_name").alias("k")).select("id", *scalar.split_pair("k"))
