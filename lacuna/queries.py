"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.config import CellConfig, LatticeConfig, Settings, with_zone_settings
from lacuna.functions import scalar
from lacuna.operators import consolidate, coverage, dedupe, djoin, lattice, region, solve
from lacuna.operators.graph import connected_components, cut
from lacuna.plans import inputs as src
from lacuna.sources import sinks
from lacuna.streaming import edits as what_if

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
H = 64.0
MAX_R = 300.0
DIST = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def d(a: str, b: str) -> str:
    return DIST.format(a=a, b=b)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TEST_KEYS = ["zone", "row", "k"]
P, S, E = src.POINTS, src.SITES, src.EDITS
Z, ZG = src.zones_sql(), src.zones_sql(100.0)
C, CG = src.cells_sql(H), src.cells_sql(H)
TEST_FACTOR = LatticeConfig().test_factor
T = src.tests_sql(TEST_FACTOR)
#: Depth step of the filter cube, in the unit of the points' depth.
STEP = 50
PCT = "CASE WHEN {w} > 0 THEN CAST(100 AS DOUBLE) * {p} / {w} ELSE CAST(0 AS DOUBLE) END"


# --- coverage ---------------------------------------------------------------------------------


@query(f"""WITH {P}, {Z}, {T},
c AS (SELECT tp.zone, EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {d("tp", "pts")} <= tp.required_radius) AS hit FROM tp)
SELECT zone, count(*) AS tests, count(*) FILTER (WHERE hit) AS covered, round({PCT.format(p="count(*) FILTER (WHERE hit)", w="count(*)")}, 4) AS covered_pct FROM c GROUP BY zone""")
def coverage_per_zone(spark, sf):
    return coverage.per_zone(src.tests(spark, sf, TEST_FACTOR), src.points(spark, sf), TEST_KEYS, MAX_R)


CUBE = """WITH {p}, {z}, {t},
top AS (SELECT CAST((floor(coalesce(max(depth), 0) / {step}) + 1) * {step} AS BIGINT) AS last FROM pts),
combos AS (SELECT CAST(m AS INT) AS min_depth, b AS mask FROM (SELECT unnest(range(0, last + 1, {step})) AS m FROM top), (SELECT unnest(range(0, 8)) AS b)),
n AS (SELECT zone, count(*) AS tests FROM tp GROUP BY zone),
best AS (SELECT tp.zone, tp."row", tp.k, CAST(has_spt AS INT) + 2 * CAST(has_txt AS INT) + 4 * CAST(has_txe AS INT) AS m, max(depth) AS depth FROM tp JOIN pts ON pts.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {near} <= tp.required_radius GROUP BY ALL),
deep AS (SELECT zone, "row", k, mask, max(depth) AS depth FROM best, (SELECT unnest(range(0, 8)) AS mask) WHERE (m & mask) = mask GROUP BY ALL),
hist AS (SELECT zone, mask, depth, count(*) AS n FROM deep GROUP BY ALL),
c AS (SELECT hist.zone, combos.min_depth, combos.mask, sum(n) AS covered FROM hist JOIN combos ON hist.mask = combos.mask AND depth >= min_depth GROUP BY ALL)
SELECT n.zone, 'd' || combos.min_depth || '_spt' || (combos.mask & 1) || '_txt' || ((combos.mask >> 1) & 1) || '_txe' || ((combos.mask >> 2) & 1) AS combo_key, tests, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round({pct}, 4) AS covered_pct
FROM n CROSS JOIN combos LEFT JOIN c ON c.zone = n.zone AND c.min_depth = combos.min_depth AND c.mask = combos.mask"""


@query(CUBE.format(p=P, z=Z, t=T, step=STEP, near=d("tp", "pts"), pct=PCT.format(p="coalesce(covered, 0)", w="tests")))
def filter_cube(spark, sf):
    p = src.points(spark, sf)
    return coverage.cube(src.tests(spark, sf, TEST_FACTOR), p, coverage.combinations(p, STEP), TEST_KEYS, MAX_R)


@query(f"""WITH {P} SELECT id, x, y, CASE WHEN depth IS NULL OR isnan(depth) THEN 0 ELSE depth END AS depth FROM pts WHERE depth >= 1000 AND has_spt AND has_txe""")
def filtered_points(spark, sf):
    return coverage.filter_points(src.points(spark, sf), 1000, require_spt=True, require_txe=True).select("id", "x", "y", "depth")


@query(f"""WITH {P}, top AS (SELECT CAST((floor(coalesce(max(depth), 0) / {STEP}) + 1) * {STEP} AS BIGINT) AS last FROM pts)
SELECT CAST(m AS INT) AS min_depth, (b & 1) <> 0 AS require_spt, (b & 2) <> 0 AS require_txt, (b & 4) <> 0 AS require_txe, 'd' || m || '_spt' || (b & 1) || '_txt' || ((b >> 1) & 1) || '_txe' || ((b >> 2) & 1) AS combo_key,
  'Depth>=' || m || 'm, SPT:' || CASE WHEN (b & 1) <> 0 THEN 'Yes' ELSE 'No' END || ', TriaxialTotal:' || CASE WHEN (b & 2) <> 0 THEN 'Yes' ELSE 'No' END || ', TriaxialEffective:' || CASE WHEN (b & 4) <> 0 THEN 'Yes' ELSE 'No' END AS label
FROM (SELECT unnest(range(0, last + 1, {STEP})) AS m FROM top), (SELECT unnest(range(0, 8)) AS b)""")
def filter_combinations(spark, sf):
    return coverage.combinations(src.points(spark, sf), STEP).select("min_depth", *coverage.REQUIRED, "combo_key", scalar.readable_combination("combo_key").alias("label"))


def _covered_cells(spark, sf, h=64.0):
    return coverage.cell_coverage(src.cells(spark, sf, h), src.points(spark, sf), h, "zone", "spacing", MAX_R)


CX = f"(cells.ix + CAST(0.5 AS DOUBLE)) * CAST({H} AS DOUBLE)"
CY = f"(cells.iy + CAST(0.5 AS DOUBLE)) * CAST({H} AS DOUBLE)"


def covered_sql(h: str, cells: str) -> str:
    """Over cells whose lattice is h (a number or a column): hit tells whether a point is within the zone's spacing."""
    return f"""{P}, {Z}, {cells}, cc AS (SELECT *, (ix + CAST(0.5 AS DOUBLE)) * {h} AS x, (iy + CAST(0.5 AS DOUBLE)) * {h} AS y FROM cells),
cov AS (SELECT * EXCLUDE (x, y), EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN cc.x - spacing AND cc.x + spacing AND {d("cc", "pts")} <= spacing) AS hit FROM cc)"""


HD = f"CAST({H} AS DOUBLE)"
COVERED = covered_sql(HD, src.cells_sql(H))
A = f"CAST({H * H} AS DOUBLE)"


@query(f"""WITH {COVERED} SELECT coalesce(zone, -1) AS zone, count(*) * {A} AS total_m2, count(*) FILTER (WHERE hit) * {A} AS covered_m2, round({PCT.format(p="count(*) FILTER (WHERE hit)", w="count(*)")}, 1) AS covered_pct FROM cov GROUP BY ROLLUP (zone)""")
def zone_area_stats(spark, sf):
    return coverage.zone_stats(_covered_cells(spark, sf), H, "zone").withColumn("zone", F.coalesce("zone", F.lit(-1)))


# Gaps are seen at each zone's own resolution h, the largest power of two of at most spacing / 10
# (SURVEY 1.4). The SQL joins runs of cells of a row to runs of the next row, and follows those.
OWN_COVERED = covered_sql("h", src.own_cells_sql())
RUNS = """run AS (SELECT zone, h, iy, min(ix) AS a, max(ix) AS b, (zone * 2097152 + min(ix) + 1048576) * 2097152 + iy + 1048576 AS id FROM (SELECT *, ix - row_number() OVER (PARTITION BY zone, iy ORDER BY ix) AS r FROM g) GROUP BY zone, h, iy, r),
up AS (SELECT u.id AS a, v.id AS b FROM run u JOIN run v ON u.zone = v.zone AND v.iy = u.iy + 1 AND u.a <= v.b AND v.a <= u.b),
touch AS (SELECT a, b FROM up UNION ALL SELECT b, a FROM up),
reach(id, seen) AS (SELECT id, id FROM run UNION SELECT reach.id, touch.b FROM reach JOIN touch ON touch.a = reach.seen),
named AS (SELECT id, min(seen) AS piece FROM reach GROUP BY id),
piece AS (SELECT g.zone, g.h, g.ix, g.iy, named.piece FROM g JOIN run ON run.zone = g.zone AND run.iy = g.iy AND g.ix BETWEEN run.a AND run.b JOIN named ON named.id = run.id)"""
PIECES = f"{OWN_COVERED}, g AS (SELECT zone, h, ix, iy FROM cov WHERE NOT hit), {RUNS}"


def _covered_own(spark, sf):
    return coverage.cell_coverage(src.own_cells(spark, sf), src.points(spark, sf), "h", "zone", "spacing", MAX_R)


def _gaps(spark, sf):
    return _covered_own(spark, sf).where("NOT is_match").select("zone", "ix", "iy", "h")


@query(f"""WITH RECURSIVE {PIECES} SELECT zone, piece, h, count(*) * h * h AS area_m2, round((avg(ix) + CAST(0.5 AS DOUBLE)) * h, 4) AS centroid_x, round((avg(iy) + CAST(0.5 AS DOUBLE)) * h, 4) AS centroid_y FROM piece GROUP BY zone, piece, h""")
def gap_pieces(spark, sf):
    g = region.pieces(_gaps(spark, sf), "zone").groupBy("zone", "piece", "h")
    return g.agg((F.count("*") * F.col("h") * F.col("h")).alias("area_m2"), F.round((F.avg("ix") + 0.5) * F.col("h"), 4).alias("centroid_x"), F.round((F.avg("iy") + 0.5) * F.col("h"), 4).alias("centroid_y"))


GAPS = f"""{PIECES}, size AS (SELECT zone, piece, h, count(*) * h * h AS area_m2, (avg(ix) + CAST(0.5 AS DOUBLE)) * h AS cx, (avg(iy) + CAST(0.5 AS DOUBLE)) * h AS cy FROM piece GROUP BY zone, piece, h HAVING count(*) * h * h >= 100),
spot AS (SELECT s.*, p.ix, p.iy, (p.ix + CAST(0.5 AS DOUBLE)) * s.h AS px, (p.iy + CAST(0.5 AS DOUBLE)) * s.h AS py FROM size s JOIN piece p ON p.zone = s.zone AND p.piece = s.piece),
rep AS (SELECT zone, piece, area_m2, cx, cy, arg_min(px, (d2, iy, ix)) AS x, arg_min(py, (d2, iy, ix)) AS y FROM (SELECT *, (px - cx) * (px - cx) + (py - cy) * (py - cy) AS d2 FROM spot) GROUP BY ALL),
gs AS (SELECT zone, piece, area_m2, cx, cy, x, y, (SELECT min({d("rep", "pts")}) FROM pts) AS dist FROM rep)"""


@query(f"""WITH RECURSIVE {GAPS} SELECT row_number() OVER (ORDER BY area_m2 DESC, piece) AS id, zone, piece, area_m2, area_m2 / 10000 AS area_ha, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y, round(x, 4) AS suggested_x, round(y, 4) AS suggested_y, round(dist, 4) AS rep_distance_m FROM gs""")
def gap_statistics(spark, sf):
    g = coverage.gap_statistics(_gaps(spark, sf), src.points(spark, sf).select("id", "x", "y"), "h", "zone")
    return g.withColumns({c: F.round(c, 4) for c in ("centroid_x", "centroid_y", "suggested_x", "suggested_y", "rep_distance_m")})


@query(f"""WITH RECURSIVE {GAPS}, a AS (SELECT sum(h * h) FILTER (WHERE hit) AS covered_m2, sum(h * h) AS total_m2 FROM cov)
SELECT covered_m2, total_m2 - covered_m2 AS uncovered_m2, total_m2, covered_m2 / 10000 AS covered_ha, round(100 * covered_m2 / total_m2, 4) AS covered_pct, (SELECT count(*) FROM gs) AS gap_count, coalesce((SELECT max(area_m2) FROM gs), 0) AS largest_gap_m2, round(coalesce((SELECT max(dist) FROM gs), 0), 4) AS max_distance_m FROM a""")
def coverage_summary(spark, sf):
    m2 = F.col("h") * F.col("h")
    c = _covered_own(spark, sf)
    per = c.groupBy("zone", "h").agg((F.count("*") * m2).alias("total_m2"), (F.count_if("is_match") * m2).alias("covered_m2"))
    g = coverage.gap_statistics(c.where("NOT is_match").select("zone", "ix", "iy", "h"), src.points(spark, sf).select("id", "x", "y"), "h", "zone")
    return coverage.summary(per, g).withColumn("max_distance_m", F.round("max_distance_m", 4))


# --- joins ------------------------------------------------------------------------------------


@query(f"""WITH {P}, {S} SELECT pts.id, count(sites.id) AS near, min({d("pts", "sites")}) AS least FROM pts LEFT JOIN sites ON {d("pts", "sites")} <= 1000 GROUP BY pts.id""")
def distance_join_left(spark, sf):
    return djoin.counted(src.points(spark, sf).select("id", "x", "y"), src.sites(spark, sf), 1000.0, ["id"])


@query(f"""WITH {Z}, {T}, {S}, c AS (SELECT zone, EXISTS (SELECT 1 FROM sites WHERE {d("tp", "sites")} <= tp.required_radius) AS hit FROM tp)
SELECT zone, count(*) AS tests, count(*) FILTER (WHERE hit) AS served FROM c GROUP BY zone""")
def pre_coverage(spark, sf):
    c = djoin.pre_covered(src.tests(spark, sf, TEST_FACTOR), src.sites(spark, sf), TEST_KEYS, MAX_R)
    return c.groupBy("zone").agg(F.count("*").alias("tests"), F.count_if("is_match").alias("served"))


@query(f"""WITH {Z}, {T}, {S} SELECT zone, count(*) AS unserved FROM tp WHERE NOT EXISTS (SELECT 1 FROM sites WHERE {d("tp", "sites")} <= tp.required_radius) GROUP BY zone""")
def unsatisfied_tests(spark, sf):
    return djoin.unsatisfied(src.tests(spark, sf, TEST_FACTOR), src.sites(spark, sf), TEST_KEYS, MAX_R).groupBy("zone").agg(F.count("*").alias("unserved"))


@query(f"""WITH {S} SELECT s.id AS a, t.id AS b, round({d("s", "t")}, 4) AS distance FROM sites s JOIN sites t ON s.id < t.id AND {d("s", "t")} <= 1500""")
def conflict_pairs(spark, sf):
    return djoin.conflict_pairs(src.sites(spark, sf), 1500.0).withColumn("distance", F.round("distance", 4))


@query(f"""WITH {P}, {S} SELECT pts.id, arg_min(sites.id, ({d("pts", "sites")}, sites.id)) AS nearest_id, round(min({d("pts", "sites")}), 4) AS distance FROM pts, sites GROUP BY pts.id""")
def nearest_site(spark, sf):
    return djoin.nearest(src.points(spark, sf).select("id", "x", "y"), src.sites(spark, sf), ["id"], "id", 500.0).withColumn("distance", F.round("distance", 4))


@query(f"""WITH {P}, {S}, r AS (SELECT id AS seq, x, y FROM sites), a AS (SELECT id AS seq, x, y FROM pts),
m AS (SELECT r.seq, min(a.seq) AS added_seq FROM r JOIN a ON {d("r", "a")} <= 40 GROUP BY r.seq)
SELECT 'removed' AS side, seq FROM r WHERE seq NOT IN (SELECT seq FROM m) UNION ALL SELECT 'added', seq FROM a WHERE seq NOT IN (SELECT added_seq FROM m)""")
def coincident_pairs(spark, sf):
    r, a = djoin.drop_coincident(src.sites(spark, sf).withColumnRenamed("id", "seq"), src.points(spark, sf).select(F.col("id").alias("seq"), "x", "y"), 40.0)
    return r.select(F.lit("removed").alias("side"), "seq").unionByName(a.select(F.lit("added").alias("side"), "seq"))


@query(f"""WITH {P}, {ZG} SELECT pts.id, coalesce(string_agg(CAST(zone AS VARCHAR), ',' ORDER BY zone), '') AS zone_ids FROM pts LEFT JOIN zones ON pts.x BETWEEN x0 AND x1 AND pts.y BETWEEN y0 AND y1 GROUP BY pts.id""")
def zones_of_points(spark, sf):
    z = src.zones(spark, sf, 100.0).select(F.col("zone").alias("zone_id"), "x0", "y0", "x1", "y1")
    return coverage.zones_of_points(src.points(spark, sf).select("id", "x", "y"), z, ["id"]).select("id", F.array_join(F.col("zone_ids").cast("array<string>"), ",").alias("zone_ids"))


@query(f"""WITH {P}, {ZG}, h AS (SELECT DISTINCT pts.id FROM pts JOIN zones ON pts.x BETWEEN x0 AND x1 AND pts.y BETWEEN y0 AND y1 WHERE zone IN (3, 7, 12)) SELECT id FROM pts WHERE id NOT IN (SELECT id FROM h)""")
def visible_points(spark, sf):
    z = src.zones(spark, sf, 100.0).select(F.col("zone").alias("zone_id"), "x0", "y0", "x1", "y1")
    return coverage.hide_excluded(coverage.zones_of_points(src.points(spark, sf).select("id", "x", "y"), z, ["id"]), [3, 7, 12]).select("id")


@query(f"""WITH {P}, {Z}, {C}, cc AS (SELECT zone, spacing, {CX} AS x, {CY} AS y FROM cells)
SELECT pts.id, cc.zone AS zone_id, count(*) * {A} AS area_m2 FROM pts JOIN cc ON pts.x BETWEEN cc.x - spacing AND cc.x + spacing AND {d("cc", "pts")} <= spacing GROUP BY pts.id, cc.zone""")
def point_coverage(spark, sf):
    cells = src.cells(spark, sf, H).select(F.col("zone").alias("zone_id"), "ix", "iy", F.col("spacing").alias("max_spacing_m"))
    return what_if.point_coverage(src.points(spark, sf), cells, H, MAX_R)


# --- regions ----------------------------------------------------------------------------------


@query(f"""WITH {ZG}, {CG} SELECT a.zone AS zone_a, b.zone AS zone_b, count(*) * {A} AS area_m2 FROM cells a JOIN cells b ON a.ix = b.ix AND a.iy = b.iy AND a.zone < b.zone GROUP BY 1, 2 HAVING count(*) * {A} >= 100""")
def zone_overlaps(spark, sf):
    return region.overlaps(src.cells(spark, sf, H, 100.0), "zone", H, 100.0)


OWNER = f"""{ZG}, {CG}, own AS (SELECT ix, iy, arg_min(zone, (CAST(round(spacing / CAST(0.01 AS DOUBLE)) AS BIGINT), ord, -zone)) AS owner, count(*) AS claims FROM cells GROUP BY ix, iy)"""


@query(f"""WITH {OWNER} SELECT owner AS zone, count(*) * {A} AS area_m2, CAST(sum(claims - 1) AS BIGINT) AS contested FROM own GROUP BY owner""")
def priority_areas(spark, sf):
    o = region.priority_owner(src.cells(spark, sf, H, 100.0), "zone", "spacing", "ord")
    return o.groupBy("zone").agg((F.count("*") * H * H).alias("area_m2"), F.sum(F.col("claims") - 1).alias("contested"))


@query(f"""WITH {OWNER}, j AS (SELECT c.zone, o.owner FROM cells c JOIN own o USING (ix, iy))
SELECT zone, count(*) FILTER (WHERE owner <> zone) > 0 AS was_cut, coalesce(string_agg(DISTINCT CAST(CASE WHEN owner <> zone THEN owner END AS VARCHAR), ','), '') AS cut_by, count(*) FILTER (WHERE owner <> zone) * {A} AS cut_area_m2, count(*) FILTER (WHERE owner = zone) = 0 AS fully_consumed FROM j GROUP BY zone""".replace("coalesce(string_agg(DISTINCT CAST(CASE WHEN owner <> zone THEN owner END AS VARCHAR), ','), '')", "array_to_string(list_sort(list_distinct(list(owner) FILTER (WHERE owner <> zone))), ',')").replace("array_to_string(list_sort", "coalesce(array_to_string(list_sort").replace(", ',') AS cut_by", ", ','), '') AS cut_by"))
def priority_cuts(spark, sf):
    cells = src.cells(spark, sf, H, 100.0)
    return region.cut_report(cells, region.priority_owner(cells, "zone", "spacing", "ord"), "zone", H)


@query(f"""WITH {ZG}, {CG}, a AS (SELECT DISTINCT ix, iy FROM cells WHERE zone % 2 = 0), b AS (SELECT DISTINCT ix, iy FROM cells WHERE zone % 3 = 0)
SELECT 'union' AS op, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) * {A} AS area_m2 UNION ALL SELECT 'intersection', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) * {A} UNION ALL SELECT 'difference', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) * {A}""")
def cell_overlay(spark, sf):
    cells = src.cells(spark, sf, H, 100.0)
    a, b = cells.where("zone % 2 = 0").select("ix", "iy").distinct(), cells.where("zone % 3 = 0").select("ix", "iy").distinct()
    ops = {"union": region.union(a, b), "intersection": region.intersection(a, b), "difference": region.difference(a, b)}
    out = None
    for name, r in ops.items():
        one = region.area(r, H).select(F.lit(name).alias("op"), "area_m2")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {Z}, {C}, o AS (SELECT x AS dx, y AS dy FROM (SELECT unnest(range(-5, 6)) AS x), (SELECT unnest(range(-5, 6)) AS y) WHERE (x * x + y * y) * {A} <= 90000)
SELECT zone, count(*) * {A} AS area_m2, min(ix) AS ix0, max(ix) AS ix1, min(iy) AS iy0, max(iy) AS iy1 FROM (SELECT DISTINCT zone, ix + dx AS ix, iy + dy AS iy FROM cells, o) GROUP BY zone""")
def buffered_zones(spark, sf):
    b = region.dilate(src.cells(spark, sf, H), 300.0, H, ["zone"])
    return b.groupBy("zone").agg((F.count("*") * H * H).alias("area_m2"), F.min("ix").alias("ix0"), F.max("ix").alias("ix1"), F.min("iy").alias("iy0"), F.max("iy").alias("iy1"))


CLOUD = f"""{Z}, {T}, {S}, u AS (SELECT DISTINCT zone, CAST(floor(x / {H}) AS BIGINT) AS ix, CAST(floor(y / {H}) AS BIGINT) AS iy, required_radius AS r FROM tp),
o AS (SELECT x AS dx, y AS dy FROM (SELECT unnest(range(-5, 6)) AS x), (SELECT unnest(range(-5, 6)) AS y)),
cloud AS (SELECT DISTINCT zone, ix + dx AS ix, iy + dy AS iy FROM u JOIN o ON (dx * dx + dy * dy) * {A} <= r * r),
pair AS (SELECT a.zone AS zone_a, b.zone AS zone_b, a.zone * 2147483648 + b.zone AS pair, a.ix, a.iy FROM cloud a JOIN cloud b ON a.ix = b.ix AND a.iy = b.iy AND a.zone < b.zone)"""


def _pairs(spark, sf):
    c = consolidate.clouds(src.tests(spark, sf, TEST_FACTOR), H, MAX_R)
    a, b = c.select(F.col("zone").alias("zone_a"), "ix", "iy"), c.select(F.col("zone").alias("zone_b"), "ix", "iy")
    return a.join(b, ["ix", "iy"]).where("zone_a < zone_b").select("zone_a", "zone_b", (F.col("zone_a") * 2147483648 + F.col("zone_b")).alias("pair"), "ix", "iy")


@query(f"""WITH {CLOUD} SELECT zone_a, zone_b, zone_a || '||' || zone_b AS pair_key, count(*) * {A} AS area_m2 FROM pair GROUP BY zone_a, zone_b""")
def cloud_overlaps(spark, sf):
    p = _pairs(spark, sf).groupBy("zone_a", "zone_b").agg((F.count("*") * H * H).alias("area_m2"))
    return p.withColumn("pair_key", scalar.pair_key(F.col("zone_a").cast("string"), F.col("zone_b").cast("string")))


@query(f"""WITH RECURSIVE {CLOUD}, e AS (SELECT DISTINCT a.pair AS a, b.pair AS b FROM pair a JOIN pair b ON a.ix = b.ix AND a.iy = b.iy), r(id, seen) AS (SELECT DISTINCT pair, pair FROM pair UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT id AS pair, min(seen) AS cluster FROM r GROUP BY id""")
def pair_clusters(spark, sf):
    return consolidate.group_pairs(_pairs(spark, sf).select("pair", "ix", "iy"))


@query(f"""WITH {CLOUD}, p AS (SELECT DISTINCT pair, ix, iy FROM pair),
o8 AS (SELECT x AS dx, y AS dy FROM (SELECT unnest(range(-12, 13)) AS x), (SELECT unnest(range(-12, 13)) AS y)),
t1 AS (SELECT DISTINCT pair, ix + dx AS ix, iy + dy AS iy FROM p JOIN o8 ON (dx * dx + dy * dy) * {A} <= 90000), t2 AS (SELECT DISTINCT pair, ix + dx AS ix, iy + dy AS iy FROM p JOIN o8 ON (dx * dx + dy * dy) * {A} <= 562500),
s AS (SELECT id, CAST(floor(x / {H}) AS BIGINT) AS ix, CAST(floor(y / {H}) AS BIGINT) AS iy, id % 4 = 0 AS line FROM sites)
SELECT id, pair, CASE WHEN line THEN 'locked' ELSE 'candidate' END AS role FROM s JOIN t1 USING (ix, iy) UNION ALL SELECT s.id, t2.pair, 'locked' FROM s JOIN t2 USING (ix, iy) WHERE (t2.pair, s.ix, s.iy) NOT IN (SELECT pair, ix, iy FROM t1)""")
def tier_roles(spark, sf):
    p = _pairs(spark, sf).select("pair", "ix", "iy").distinct()
    t1, t2 = consolidate.tiers(p, 300.0, H, ["pair"]), consolidate.tiers(p, 750.0, H, ["pair"])
    s = src.sites(spark, sf).withColumn("is_centreline", F.expr("id % 4 = 0"))
    return consolidate.classify(s, t1, t2, H, ["pair"]).select("id", "pair", "role")


@query(f"""WITH {ZG}, {CG} SELECT zone, count(*) AS border FROM cells c WHERE EXISTS (SELECT 1 FROM cells o WHERE abs(o.ix - c.ix) <= 1 AND abs(o.iy - c.iy) <= 1 AND o.zone <> c.zone AND o.ix BETWEEN c.ix - 1 AND c.ix + 1) GROUP BY zone""")
def border_cells(spark, sf):
    return region.shared_borders(src.cells(spark, sf, H, 100.0), "zone").groupBy("zone").agg(F.count("*").alias("border"))


@query(f"""WITH {S}, o AS (SELECT x AS dx, y AS dy FROM (SELECT unnest(range(-40, 41)) AS x), (SELECT unnest(range(-40, 41)) AS y)),
c AS (SELECT id, x, y, CAST(floor(x / 32) AS BIGINT) + dx AS ix, CAST(floor(y / 32) AS BIGINT) + dy AS iy FROM sites, o)
SELECT id, count(*) AS cells, CAST(2 * 700.5 * 700.5 - 2 * 200.5 * 200.5 AS DOUBLE) AS area_m2 FROM (SELECT *, abs((ix + CAST(0.5 AS DOUBLE)) * 32 - x) + abs((iy + CAST(0.5 AS DOUBLE)) * 32 - y) AS m FROM c) WHERE m < 700.5 AND NOT m < 200.5 GROUP BY id""")
def polygon_cells(spark, sf):
    diamond = lambda r: f"array(struct(x - {r} AS x, y AS y), struct(x AS x, y - {r} AS y), struct(x + {r} AS x, y AS y), struct(x AS x, y + {r} AS y))"
    s = src.sites(spark, sf).selectExpr("id", f"array({diamond('700.5D')}, {diamond('200.5D')}) AS ring")
    cells = region.ring_cells(s, 32.0, ["id"]).groupBy("id").agg(F.count("*").alias("cells"))
    return cells.join(s.select("id", region.ring_area("ring").alias("area_m2")), "id")


@query(f"""WITH {Z}, {C} SELECT zone, CAST(floor(ix / CAST(8 AS DOUBLE)) AS BIGINT) AS tx, CAST(floor(iy / CAST(8 AS DOUBLE)) AS BIGINT) AS ty, count(*) AS cells FROM cells GROUP BY ALL HAVING count(*) >= 10""")
def grid_tiles(spark, sf):
    return lattice.grid_tiles(src.cells(spark, sf, H), ["zone"], 8, 10)


# --- generators -------------------------------------------------------------------------------


@query(f"""WITH {Z}, {T} SELECT zone, "row", k, round(x, 4) AS x, round(y, 4) AS y FROM tp""")
def hexagonal_lattice(spark, sf):
    return src.tests(spark, sf, TEST_FACTOR).select("zone", "row", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {Z} SELECT zone, count(*) AS points FROM (SELECT zone, x0 - spacing + k * spacing AS x, y0 - spacing + r * spacing AS y, x0 - spacing AS a, x1 + spacing AS b, y0 - spacing AS c, y1 + spacing AS e FROM (SELECT *, unnest(range(0, 100)) AS k FROM (SELECT *, unnest(range(0, 100)) AS r FROM zones))) WHERE x > a AND x < b AND y > c AND y < e GROUP BY zone""")
def rectangular_candidates(spark, sf):
    return lattice.box_lattice(src.zones(spark, sf), "spacing", "spacing", grid="rectangular").groupBy("zone").agg(F.count("*").alias("points"))


@query(f"""WITH {Z}, l AS (SELECT zone, x0, y0, x1, y1, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, spacing FROM zones), n AS (SELECT *, CAST(greatest(1, ceil(len / spacing)) AS INT) AS n FROM l),
s AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n) SELECT zone, CAST(k AS INT) AS k, round(x0 + least(greatest(k * (len / n) / len, 0), 1) * (x1 - x0), 4) AS x, round(y0 + least(greatest(k * (len / n) / len, 0), 1) * (y1 - y0), 4) AS y FROM s""")
def line_samples(spark, sf):
    lines = src.zones(spark, sf).selectExpr("zone", "spacing", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y1 AS y)) AS points")
    return lattice.line_samples(lines, "spacing", ["zone"]).select("zone", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- sets, order, scalars ---------------------------------------------------------------------


@query(f"""WITH {P}, q AS (SELECT id, CAST(CAST(x AS BIGINT) % 50 AS DOUBLE) AS x, CAST(CAST(y AS BIGINT) % 50 AS DOUBLE) AS y FROM pts) SELECT min(id) AS seq, x, y FROM q GROUP BY x, y""")
def first_wins(spark, sf):
    q = src.points(spark, sf).selectExpr("id AS seq", "CAST(CAST(x AS BIGINT) % 50 AS DOUBLE) AS x", "CAST(CAST(y AS BIGINT) % 50 AS DOUBLE) AS y")
    return dedupe.first_wins(q)


@query(f"""WITH {P}, {S}, f AS (SELECT x, y FROM pts WHERE id % 2 = 0), g2 AS (SELECT x, y FROM pts WHERE id % 10 = 0), a2 AS (SELECT x, y FROM sites), g3 AS (SELECT x, y FROM sites WHERE id % 5 = 0), a3 AS (SELECT x, y FROM pts WHERE id % 9 = 0)
SELECT x, y FROM ((((SELECT * FROM f EXCEPT SELECT * FROM g2) UNION SELECT * FROM a2) EXCEPT SELECT * FROM g3) UNION SELECT * FROM a3)""")
def final_assembly(spark, sf):
    p, s = src.points(spark, sf).select("id", "x", "y"), src.sites(spark, sf)
    pick = lambda df, cond: df.where(cond).select("x", "y")
    return dedupe.assemble(pick(p, "id % 2 = 0"), [pick(p, "id % 10 = 0"), pick(s, "id % 5 = 0")], [s.select("x", "y"), pick(p, "id % 9 = 0")])


@query(f"""WITH {P} SELECT x, y FROM pts WHERE id % 2 = 0 AND (x, y) NOT IN (SELECT x, y FROM pts WHERE id % 3 = 0)""")
def not_readded(spark, sf):
    p = src.points(spark, sf).select("id", "x", "y")
    return dedupe.not_readded(p.where("id % 2 = 0").select("x", "y"), p.where("id % 3 = 0"))


@query(f"""WITH {P} SELECT DISTINCT x, y FROM pts WHERE id % 2 = 0 EXCEPT SELECT x, y FROM pts WHERE id % 3 = 0""")
def position_difference(spark, sf):
    p = src.points(spark, sf).select("id", "x", "y")
    return dedupe.position_difference(p.where("id % 2 = 0"), p.where("id % 3 = 0"))


@query(r"""SELECT c_custkey AS id, 'nation:' || c_name AS zone_id, least(c_name, c_mktsegment) || '_' || greatest(c_name, c_mktsegment) AS pair_key, regexp_replace(regexp_replace(c_name || ' / x', '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe, regexp_replace('zone_' || c_custkey, '_\d+$', '') AS shown,
 c_acctbal / 10000 AS ha, CAST(least(greatest(ceil(CAST(c_acctbal AS DOUBLE) / 1000), 2), 8) AS INT) AS cells, greatest(CAST(1000 AS DOUBLE), CAST(0.5 AS DOUBLE) * c_nationkey * c_nationkey) AS threshold, CASE WHEN c_acctbal > 0 THEN round(100 * c_nationkey / CAST(c_acctbal AS DOUBLE), 4) ELSE 0 END AS pct FROM customer""")
def scalar_functions(spark, sf):
    c = src.table(spark, sf, "customer").withColumn("n", F.col("c_nationkey").cast("double"))
    return c.select(
        F.col("c_custkey").alias("id"), scalar.zone_id(F.lit("nation"), "c_name").alias("zone_id"), scalar.sorted_pair_key("c_name", "c_mktsegment").alias("pair_key"), scalar.safe_name(F.concat("c_name", F.lit(" / x"))).alias("safe"),
        scalar.display_name(F.concat(F.lit("zone_"), F.col("c_custkey").cast("string"))).alias("shown"), scalar.hectares("c_acctbal").alias("ha"), scalar.cell_count("c_acctbal", 1000.0, 2, 8).alias("cells"),
        scalar.cell_threshold(1000.0, 0.5, "n").alias("threshold"), F.round(scalar.percent("n", "c_acctbal"), 4).alias("pct"),
    )


@query(r"""WITH r AS (SELECT sha256(CAST(s_suppkey AS VARCHAR) || chr(31) || s_name) AS h FROM supplier), s AS (SELECT count(*) AS n, sum(CAST('0x' || h[1:8] AS BIGINT)) AS a, sum(CAST('0x' || h[9:16] AS BIGINT)) AS b, sum(CAST('0x' || h[17:24] AS BIGINT)) AS c, sum(CAST('0x' || h[25:32] AS BIGINT)) AS d FROM r)
SELECT sha256(n || '|' || a || '|' || b || '|' || c || '|' || d)[1:16] AS fingerprint FROM s""")
def fingerprint(spark, sf):
    return scalar.fingerprint(src.table(spark, sf, "supplier"), ["s_suppkey", "s_name"])


@query("""SELECT CAST(n_nationkey AS BIGINT) AS zone, 'region' || n_regionkey AS source_layer, n_name AS zone_name, CASE WHEN n_nationkey % 7 = 0 THEN CAST(40 + n_nationkey AS DOUBLE) WHEN n_regionkey <> 2 THEN CAST(60 + 10 * n_regionkey AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS max_spacing_m,
 CAST(CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey WHEN n_regionkey <> 3 THEN n_regionkey ELSE 999 END AS INT) AS ord FROM nation WHERE NOT n_nationkey % 11 = 5""")
def zone_settings(spark, sf):
    n = src.table(spark, sf, "nation")
    zones = n.selectExpr("CAST(n_nationkey AS BIGINT) AS zone", "concat('region', n_regionkey) AS source_layer", "n_name AS zone_name")
    layers = src.table(spark, sf, "region").selectExpr("concat('region', r_regionkey) AS layer_key", "CASE WHEN r_regionkey <> 2 THEN CAST(60 + 10 * r_regionkey AS DOUBLE) END AS max_spacing_m", "CAST(CASE WHEN r_regionkey <> 3 THEN r_regionkey END AS INT) AS ord")
    features = n.where("n_nationkey % 7 = 0 OR n_nationkey % 11 = 5").selectExpr("concat('region', n_regionkey) AS layer_key", "n_name AS zone_name", "n_nationkey % 11 <> 5 AS enabled", "CASE WHEN n_nationkey % 7 = 0 THEN CAST(40 + n_nationkey AS DOUBLE) END AS max_spacing_m", "CAST(CASE WHEN n_nationkey % 7 = 0 THEN n_nationkey END AS INT) AS ord")
    return with_zone_settings(zones, layers, features)


@query(f"""WITH {S} SELECT 'PROP_' || lpad(CAST(row_number() OVER (PARTITION BY id % 3 ORDER BY x, y) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (PARTITION BY id % 3 ORDER BY x, y) AS VARCHAR))) AS INTEGER), '0') AS "Location_ID", x AS "Easting", y AS "Northing", 'First Pass' AS "Source_Pass", 'd' || (id % 3) AS "Filter_Combination" FROM sites""")
def proposed_csv(spark, sf):
    s = src.sites(spark, sf).withColumns({"combo_key": F.concat(F.lit("d"), (F.col("id") % 3).cast("string")), "source_pass": F.lit("First Pass")})
    return sinks.proposed_table(s)


@query("""SELECT 'd' || (s_suppkey % 2) AS combo_key, CASE s_nationkey % 4 WHEN 0 THEN 'Second Pass' WHEN 1 THEN 'Third Pass' ELSE 'First Pass' END AS source_pass, CASE WHEN s_suppkey % 5 = 0 THEN 'locked' ELSE 'proposed' END AS status, count(*) AS sites FROM supplier GROUP BY ALL""")
def pass_statistics(spark, sf):
    s = src.table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS DOUBLE) AS x", "CAST(s_nationkey AS DOUBLE) AS y", "CASE s_nationkey % 4 WHEN 0 THEN 'Second Pass' WHEN 1 THEN 'Third Pass' WHEN 2 THEN 'unheard of' END AS source_pass", "CASE WHEN s_suppkey % 5 = 0 THEN 'locked' END AS status", "concat('d', s_suppkey % 2) AS combo")
    n = scalar.normalise_sites(s.select("x", "y", "source_pass", "status", F.col("combo").alias("zone_id"))).withColumnRenamed("zone_id", "combo_key")
    return sinks.pass_statistics(n)


# --- edits ------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {P}, {E}, {src.FOLDED} SELECT id, x, y, edited AS is_edited FROM ended""")
def edited_points(spark, sf):
    return what_if.apply_edits(src.points(spark, sf).select("id", "x", "y"), src.edits(spark, sf))


@query(f"""WITH {E} SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, action, count(*) AS edits FROM edits GROUP BY ALL""")
def edit_windows(spark, sf):
    return what_if.windowed_edits(src.edits(spark, sf), "6 hours").select(F.col("window_start").cast("string").alias("window_start"), "action", "edits")


# --- placement --------------------------------------------------------------------------------


def _open_tests(spark, sf, factor=TEST_FACTOR):
    t = djoin.unsatisfied(src.tests(spark, sf, factor), src.points(spark, sf).select("x", "y"), TEST_KEYS, MAX_R)
    return t.select(F.col("zone").alias("problem"), (F.col("row") * 100_000 + F.col("k")).cast("long").alias("test"), "x", "y", "required_radius")


def _candidates(spark, sf, factor=0.5):
    z = src.zones(spark, sf).withColumn("step", F.col("spacing") * factor)
    c = lattice.box_lattice(z, "step", "spacing")
    return c.select(F.col("zone").alias("problem"), (F.col("row") * 100_000 + F.col("k")).cast("long").alias("cand"), "x", "y", (F.col("spacing") * 0.9).alias("exclusion"))


@query()
def placement(spark, sf):
    """Sites that close every zone's gaps, by set cover with spacing conflicts."""
    return solve.place_sites(_open_tests(spark, sf), _candidates(spark, sf), MAX_R)


@query(f"""WITH {P}, {Z}, {T}, o AS (SELECT zone FROM tp WHERE NOT EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {d("tp", "pts")} <= tp.required_radius))
SELECT zone AS problem, count(*) AS tests, CAST(0 AS BIGINT) AS missed FROM o GROUP BY zone""")
def placement_gaps(spark, sf):
    """After placement no open test of a zone is left (every test has a candidate in reach)."""
    t = _open_tests(spark, sf)
    return _missed(t, solve.place_sites(t, _candidates(spark, sf), MAX_R))


def _missed(t, placed):
    s = placed.where("cand IS NOT NULL").select("problem", "x", "y")
    hit = djoin.distance_join(t, s.withColumnRenamed("problem", "owner"), "required_radius", MAX_R).where("problem = r_owner").select("problem", "test").distinct().withColumn("hit", F.lit(True))
    return t.join(hit, ["problem", "test"], "left").groupBy("problem").agg(F.count("*").alias("tests"), F.count_if(F.col("hit").isNull()).alias("missed"))


def _clusters(spark, sf):
    """Tier 1 of each cluster of zone overlaps, large clusters in cells: problem, cluster, ix, iy."""
    p = _pairs(spark, sf).select("pair", "ix", "iy").distinct()
    one = p.join(consolidate.group_pairs(p), "pair").select(F.col("cluster").alias("problem"), "ix", "iy").distinct()
    return consolidate.split_large(region.intersection(one, src.cells(spark, sf, H).select("ix", "iy").distinct()), H)


def _site_rows(spark, sf):
    return src.sites(spark, sf).select(F.col("id").alias("seq"), "x", "y", F.expr("id % 4 = 0").alias("is_centreline"))


def _test_rows(spark, sf):
    return src.tests(spark, sf, Settings().lattice.test_factor).select(F.xxhash64("zone", "row", "k").alias("test"), "x", "y", "required_radius")


@query()
def consolidation(spark, sf):
    """Second pass over the overlaps of the clouds of all zones, large clusters in cells."""
    tier1 = cut(_clusters(spark, sf).select("problem", "ix", "iy"))
    out = consolidate.consolidate(_site_rows(spark, sf), _test_rows(spark, sf), tier1, consolidate.tiers(tier1, 450.0, H, ["problem"]), MAX_R, H)
    return out["removed"].select(F.lit("removed").alias("kind"), "problem", "x", "y").unionByName(out["added"].select(F.lit("added").alias("kind"), "problem", "x", "y"))


def _passed_sql(kept: str) -> str:
    """Tests of all zones, how many a site covers before a pass, and what may not be after it."""
    return f"""WITH {Z}, {T}, {S} SELECT count(*) AS tests, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM sites WHERE sites.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {d("tp", "sites")} <= tp.required_radius)) AS covered_before, {kept} FROM tp"""


def _passed(spark, sf, final):
    t = cut(_test_rows(spark, sf))
    before = djoin.distance_join(t, src.sites(spark, sf).select("x", "y"), "required_radius", MAX_R, "semi")
    lost = djoin.distance_join(before, final.select("x", "y"), "required_radius", MAX_R, "anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return t, one(t, "tests").crossJoin(one(before, "covered_before")).crossJoin(one(lost, "lost"))  # one row each


ZERO = "CAST(0 AS BIGINT) AS {}"


@query(_passed_sql(", ".join(map(ZERO.format, ("lost", "still_open")))))
def consolidation_coverage(spark, sf):
    """After the second pass no test is open that was covered, and no test of a tier 1 that a candidate could cover."""
    tier1 = cut(_clusters(spark, sf).select("problem", "ix", "iy"))
    s = _site_rows(spark, sf)
    t = _test_rows(spark, sf)
    out = consolidate.consolidate(s, t, tier1, consolidate.tiers(tier1, 450.0, H, ["problem"]), MAX_R, H)
    final = cut(consolidate.passed(s, out))
    t, row = _passed(spark, sf, final)
    left = consolidate.still_open(t, tier1, final, out["candidates"], MAX_R, H)
    return row.crossJoin(left.agg(F.count("*").alias("still_open")))


def _all_passes(spark, sf):
    p = _pairs(spark, sf).select("pair", "ix", "iy").distinct()
    one = p.join(consolidate.group_pairs(p), "pair").select(F.col("cluster").alias("problem"), "ix", "iy").distinct()
    inside = region.intersection(one, src.cells(spark, sf, H).select("ix", "iy").distinct())
    return consolidate.run_passes(_site_rows(spark, sf), cut(_test_rows(spark, sf)), inside, MAX_R, H)


@query()
def third_pass(spark, sf):
    """All sites after the second pass and the third one over the seams of split clusters."""
    return _all_passes(spark, sf)["sites"].select("x", "y", "is_centreline", F.coalesce("source_pass", F.lit("First Pass")).alias("source_pass"))


@query(_passed_sql(ZERO.format("lost")))
def third_pass_coverage(spark, sf):
    """What was covered before the passes is covered after them."""
    return _passed(spark, sf, _all_passes(spark, sf)["sites"])[1]


@query(f"""WITH {P}, {Z}, {T}, o AS (SELECT zone FROM tp WHERE NOT EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN tp.x - tp.required_radius AND tp.x + tp.required_radius AND {d("tp", "pts")} <= tp.required_radius))
SELECT zone AS problem, count(*) AS tests, {", ".join(map(ZERO.format, ("missed", "conflicts", "below_bound")))} FROM o GROUP BY zone""")
def placement_in_tiles(spark, sf):
    """Placement in tiles of at most 60 000 edges: no open test is left, no two sites are nearer than the stated share of the exclusion distance, and no zone has fewer sites than its bound."""
    t = cut(_open_tests(spark, sf))
    placed = cut(solve.place_sites(t, _candidates(spark, sf), MAX_R, max_edges=60_000))
    total = solve.totals(placed).select("problem", F.greatest(F.col("lower_bound") - F.col("selected"), F.lit(0)).alias("below_bound"))
    apart = placed.where("cand IS NOT NULL").join(src.zones(spark, sf).select(F.col("zone").alias("problem"), (F.col("spacing") * 0.9).alias("exclusion")), "problem").withColumn("apart", F.coalesce(F.col("conflict_factor"), F.lit(0.0)) * F.col("exclusion"))
    near = djoin.distance_join(apart.select("problem", "cand", "x", "y", "apart"), apart.select("problem", "cand", "x", "y"), "apart", MAX_R).where("problem = r_problem AND cand < r_cand").groupBy("problem").agg(F.count("*").alias("conflicts"))
    return _missed(t, placed).join(total, "problem").join(near, "problem", "left").fillna(0, ["conflicts"])


@query()
def greedy_disk_cover(spark, sf):
    gaps = _gaps(spark, sf).withColumns({"x": (F.col("ix") + 0.5) * F.col("h"), "y": (F.col("iy") + 0.5) * F.col("h")})
    c = _candidates(spark, sf, 1.0).join(src.zones(spark, sf).select(F.col("zone").alias("problem"), "spacing"), "problem").withColumnRenamed("problem", "owner")
    near = djoin.distance_join(gaps, c.select("owner", "cand", "x", "y", "spacing"), F.col("r_spacing"), MAX_R).where("zone = r_owner")
    return solve.greedy_cover(near.select(F.col("zone").alias("problem"), F.col("r_cand").alias("cand"), region.cell_id().alias("cell"), (F.col("h") * F.col("h")).alias("cell_m2")), "cell_m2", 200.0)


@query()
def zone_split(spark, sf):
    """Large zones in cells of about a square kilometre each."""
    h = 128.0
    cells = src.cells(spark, sf, h)
    cfg = CellConfig()
    counts = cells.groupBy("zone").agg((F.count("*") * h * h).alias("area")).select("zone", scalar.cell_count("area", cfg.target, cfg.least, cfg.most).alias("k"))
    parts = region.split_by_centres(cells, region.centres_of(cells.select("zone", "ix", "iy"), "zone", counts, 4), ["zone"])
    return parts.groupBy("zone", "cell").agg((F.count("*") * h * h).alias("area_m2"))


@query(f"""WITH RECURSIVE {P}, close AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id < b.id AND {d("a", "b")} < 60), near AS (SELECT b AS id, list(a) AS l FROM close GROUP BY b),
turn AS (SELECT e.id, coalesce(l, []) AS l, row_number() OVER (ORDER BY e.id) AS n FROM (SELECT a AS id FROM close UNION SELECT b FROM close) e LEFT JOIN near ON near.id = e.id),
walk(n, kept, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT turn.n, CASE WHEN list_has_any(kept, l) THEN kept ELSE list_append(kept, CAST(turn.id AS BIGINT)) END, CASE WHEN list_has_any(kept, l) THEN list_append(gone, CAST(turn.id AS BIGINT)) ELSE gone END FROM walk JOIN turn ON turn.n = walk.n + 1)
SELECT id AS seq, x, y FROM pts WHERE NOT list_contains((SELECT gone FROM walk ORDER BY n DESC LIMIT 1), id)""")
def tolerance_dedupe(spark, sf):
    return dedupe.tolerance_dedupe(src.points(spark, sf).select(F.col("id").alias("seq"), "x", "y"), 60.0)


@query(f"""WITH RECURSIVE {S}, e AS (SELECT s.id AS a, t.id AS b FROM sites s JOIN sites t ON s.id <> t.id AND {d("s", "t")} < 1000), r(id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id""")
def site_components(spark, sf):
    s = src.sites(spark, sf)
    e = djoin.distance_join(s, s, 1000.0, strict=True).where("id < r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    return connected_components(e)
