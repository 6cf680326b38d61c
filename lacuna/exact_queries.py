"""Queries over exact areas, complete fills and areas after edits, each with its SQL; they join the registry of lacuna.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import discs, fill
from lacuna.operators.graph import cut
from lacuna.plans import inputs as src
from lacuna.queries import MAX_R, OWN_COVERED, TEST_FACTOR, A, C, E, H, P, Z, _candidates, _covered_own, d, query
from lacuna.shape_queries import _centreline
from lacuna.streaming import edits as what_if

# --- exact areas ------------------------------------------------------------------------------

ANGLE = "(a + 8 * pi()) - floor((a + 8 * pi()) / (2 * pi())) * (2 * pi())"
EXACT = f"""disc AS (SELECT DISTINCT zone, pts.x - x0 AS x, pts.y - y0 AS y, spacing AS r, x1 - x0 AS w, y1 - y0 AS t FROM pts JOIN zones ON pts.x BETWEEN x0 - spacing AND x1 + spacing AND pts.y BETWEEN y0 - spacing AND y1 + spacing),
near AS (SELECT i.*, atan2(j.y - i.y, j.x - i.x) AS mid, sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) AS dist FROM disc i JOIN disc j ON i.zone = j.zone AND (i.x <> j.x OR i.y <> j.y)),
gone AS (SELECT zone, x, y, r, mid, acos(dist / (2 * r)) AS half FROM near WHERE dist < 2 * r
  UNION ALL SELECT zone, x, y, r, -pi() / 2, acos(greatest(y / r, -1)) FROM disc WHERE y < r UNION ALL SELECT zone, x, y, r, CAST(0 AS DOUBLE), acos(greatest((w - x) / r, -1)) FROM disc WHERE w - x < r
  UNION ALL SELECT zone, x, y, r, pi() / 2, acos(greatest((t - y) / r, -1)) FROM disc WHERE t - y < r UNION ALL SELECT zone, x, y, r, pi(), acos(greatest(x / r, -1)) FROM disc WHERE x < r),
turned AS (SELECT zone, x, y, r, half, CASE WHEN half >= pi() THEN 0 ELSE {ANGLE} END AS a FROM (SELECT *, mid - half AS a FROM gone)),
span AS (SELECT zone, x, y, r, a, least(a + 2 * half, 2 * pi()) AS b FROM turned UNION ALL SELECT zone, x, y, r, 0, a + 2 * half - 2 * pi() FROM turned WHERE a + 2 * half > 2 * pi() UNION ALL SELECT zone, x, y, r, 2 * pi(), 2 * pi() FROM disc),
arc AS (SELECT * FROM (SELECT *, coalesce(max(b) OVER (PARTITION BY zone, x, y, r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM span) WHERE a > o),
side AS (SELECT zone, 1 AS s, w AS arm, greatest(y - sqrt(r * r - (w - x) * (w - x)), 0) AS a, least(y + sqrt(r * r - (w - x) * (w - x)), t) AS b FROM disc WHERE abs(w - x) < r
  UNION ALL SELECT zone, 2, t, greatest(w - x - sqrt(r * r - (t - y) * (t - y)), 0), least(w - x + sqrt(r * r - (t - y) * (t - y)), w) FROM disc WHERE abs(t - y) < r),
stretch AS (SELECT zone, arm, greatest(b - greatest(a, coalesce(max(b) OVER (PARTITION BY zone, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)), 0) AS new FROM side WHERE a < b),
exact AS (SELECT zone, sum(v) AS m2 FROM (SELECT zone, (r * r * (a - o) + r * x * (sin(a) - sin(o)) - r * y * (cos(a) - cos(o))) / 2 AS v FROM arc UNION ALL SELECT zone, new * arm / 2 FROM stretch) GROUP BY zone)"""


@query(f"""WITH {OWN_COVERED}, {EXACT}, cell AS (SELECT zone, sum(h * h) FILTER (WHERE hit) AS m2 FROM cov GROUP BY zone)
SELECT z.zone, (x1 - x0) * (y1 - y0) AS total_m2, round(coalesce(exact.m2, 0), 2) AS covered_m2, round(coalesce(cell.m2, 0) - coalesce(exact.m2, 0), 2) AS lattice_error_m2 FROM zones z LEFT JOIN exact ON exact.zone = z.zone LEFT JOIN cell ON cell.zone = z.zone""")
def exact_areas(spark, sf):
    """The exact covered area of every zone, and by how much that of the zone's own lattice differs."""
    z = src.zones(spark, sf)
    exact = discs.union_areas(discs.discs_of_zones(z, src.points(spark, sf)), MAX_R)
    cells = _covered_own(spark, sf).where("is_match").groupBy("zone").agg(F.sum(F.col("h") * F.col("h")).alias("cells_m2"))
    both = z.select("zone", F.expr("(x1 - x0) * (y1 - y0)").alias("total_m2")).join(exact, "zone", "left").join(cells, "zone", "left").fillna(0.0)
    return both.select("zone", "total_m2", F.round("area_m2", 2).alias("covered_m2"), F.round(F.col("cells_m2") - F.col("area_m2"), 2).alias("lattice_error_m2"))


# --- complete fills ---------------------------------------------------------------------------


def _completed(spark, sf):
    t = src.tests(spark, sf, TEST_FACTOR).select(F.col("zone").alias("problem"), (F.col("row") * 100_000 + F.col("k")).cast("long").alias("test"), "x", "y", "required_radius")
    locked = src.points(spark, sf).select("x", "y").unionByName(_centreline(spark, sf).select("x", "y"))
    cells = src.own_cells(spark, sf).select("zone", "ix", "iy", "h", "spacing")
    return cells, locked, fill.complete(cells, t, _candidates(spark, sf), locked, MAX_R)


@query()
def complete_fill(spark, sf):
    """Sites that close every gap behind points and centrelines: by the solver, then by filling what its tests don't see."""
    return _completed(spark, sf)[2]


@query(f"""WITH {P}, {Z}, {src.own_cells_sql()} SELECT zone, sum(h * h) AS total_m2, CAST(0 AS DOUBLE) AS remaining_m2 FROM cells GROUP BY zone""")
def filled_zones(spark, sf):
    """After the fill no cell of any zone is open."""
    cells, locked, added = _completed(spark, sf)
    every = cut(locked.unionByName(added.select("x", "y")))
    area = lambda df, name: df.groupBy("zone").agg(F.sum(F.col("h") * F.col("h")).alias(name))
    return area(cells, "total_m2").join(area(fill.open_cells(cells, every, MAX_R), "remaining_m2"), "zone", "left").fillna(0.0)


# --- areas after edits ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {P}, {Z}, {C}, {E}, {src.FOLDED}, cc AS (SELECT zone, spacing, (ix + CAST(0.5 AS DOUBLE)) * CAST({H} AS DOUBLE) AS x, (iy + CAST(0.5 AS DOUBLE)) * CAST({H} AS DOUBLE) AS y FROM cells)
SELECT zone AS zone_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM pts WHERE pts.x BETWEEN cc.x - spacing AND cc.x + spacing AND {d("cc", "pts")} <= spacing)) * {A} AS before_m2,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ended WHERE ended.x BETWEEN cc.x - spacing AND cc.x + spacing AND {d("cc", "ended")} <= spacing)) * {A} AS after_m2 FROM cc GROUP BY zone""")
def edited_areas(spark, sf):
    """Covered area of every zone before and after the edits, from cover counts that only changes touch."""
    p = src.points(spark, sf).select("id", "x", "y")
    cells = src.cells(spark, sf, H).select(F.col("zone").alias("zone_id"), "ix", "iy", F.col("spacing").alias("max_spacing_m"))
    before = cut(what_if.cover_counts(p, cells, H, MAX_R))
    moved = what_if.changes(p, src.edits(spark, sf)).where("NOT (was <=> present AND old_x <=> x AND old_y <=> y)")
    after = what_if.changed_counts(before, moved, cells, H, MAX_R)
    areas = [what_if.zone_areas(c, H).withColumnRenamed("covered_m2", n) for c, n in ((before, "before_m2"), (after, "after_m2"))]
    return cells.select("zone_id").distinct().join(areas[0], "zone_id", "left").join(areas[1], "zone_id", "left").fillna(0.0)
