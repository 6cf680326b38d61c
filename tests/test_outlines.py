"""Points and polygons by the index of edges, against every edge of every polygon."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import outlines, places

RING = "array<array<struct<x:double,y:double>>>"


def plain(rings, x, y):
    """inside and boundary_m of one point by all edges."""
    odd, best = False, math.inf
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
            dx, dy = bx - ax, by - ay
            t = min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return odd and best > 1e-12, best


def star(rng, cx, cy, n, r):
    at = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = rng.uniform(0.3 * r, r, n)
    return [(float(cx + f * math.cos(a)), float(cy + f * math.sin(a))) for a, f in zip(at, far)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [7.0, 100.0])
def test_near_regions_equal_every_edge(spark, seed, bucket):
    rng = np.random.default_rng(seed)
    shapes = [[star(rng, *rng.uniform(-80, 80, 2), 40, 60.0)] for _ in range(5)]
    shapes.append([[(-70.0, -70.0), (70.0, -70.0), (70.0, 70.0), (-70.0, 70.0)], star(rng, 0, 0, 30, 50.0)])
    pts = [(i, *map(float, rng.uniform(-150, 150, 2))) for i in range(300)]
    got = {(r.id, r.k): (r.inside, r.boundary_m) for r in places.near_regions(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(list(enumerate(shapes)), f"k long, ring {RING}"), 5.0, bucket, ["k"]).collect()}
    want = {(i, k): plain(s, x, y) for i, x, y in pts for k, s in enumerate(shapes)}
    want = {p: w for p, w in want.items() if w[0] or w[1] <= 5.0}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[p][0] == w[0] and got[p][1] == pytest.approx(w[1], abs=1e-9) for p, w in want.items())


@pytest.mark.parametrize("bucket", [1.0, 2.0, 3.0])
def test_corners_on_the_lines_of_the_lattice(spark, bucket):
    """Whole coordinates: edges and points run through the corners and along the sides of cells."""
    rng = np.random.default_rng(5)
    shapes = [[[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]], [[(0.0, 0.0), (6.0, 6.0), (0.0, 12.0), (-6.0, 6.0)]], [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (0.0, 8.0)], [(1.0, 5.0), (3.0, 5.0), (3.0, 7.0), (1.0, 7.0)]]]
    shapes += [[[tuple(map(float, p)) for p in rng.integers(-6, 13, (7, 2))]] for _ in range(6)]
    pts = [(x * 20 + y, float(x), float(y)) for x in range(-7, 14) for y in range(-7, 14)] + [(10_000 + x * 20 + y, x + 0.5, float(y)) for x in range(-7, 14) for y in range(-7, 14)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {}
    for r in places.near_regions(df, spark.createDataFrame(list(enumerate(shapes)), f"k long, ring {RING}"), 0.0, bucket, ["k"]).collect():
        got.setdefault((r.x, r.y, r.k), (r.inside, r.boundary_m))
    for _, x, y in pts:
        for k, s in enumerate(shapes):
            odd, far = plain(s, x, y)
            have = got.get((x, y, k))
            if far <= 1e-9:  # on the boundary, but for rounding
                assert have is None or have[1] <= 1e-9 or not have[0], (x, y, k)
            else:
                assert (have is not None and have[0]) == odd, (x, y, k)
                assert not odd or have[1] == pytest.approx(far)


def test_a_long_ring_and_many_points(spark):
    """100 000 corners and 100 000 points: rows of single edges; a sample against all edges."""
    n = 100_000
    i = F.col("id").cast("double")
    far = 1000 + 120 * F.sin(i * (2 * math.pi * 40 / n)) + 0.02 * F.sin(i * 1.7)
    corner = spark.range(n).select("id", F.struct((far * F.cos(i * (2 * math.pi / n))).alias("x"), (far * F.sin(i * (2 * math.pi / n))).alias("y")).alias("p"))
    ring = corner.groupBy(F.lit(1).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda s: s["p"]).alias("r")).select("k", F.array("r").alias("ring"))
    pts = spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2_400_000)) / 1000.0 - 1200).alias("x"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2_400_000)) / 1000.0 - 1200).alias("y"))
    rows = outlines.index(outlines.edges(ring, ["k"]), 20.0, 10.0)
    assert all(t not in ("array", "map", "struct") for t in (f.dataType.typeName() for f in rows.schema))
    got = {r.id: (r.inside, r.boundary_m) for r in places.near_regions(pts, ring, 10.0, 20.0, ["k"]).collect()}
    p = np.array([tuple(r.p) for r in corner.orderBy("id").collect()])
    q = np.roll(p, -1, axis=0)
    d = q - p
    sample = pts.where("id % 250 = 0").collect()
    assert len(sample) == 400
    for s in sample:
        cross = (p[:, 1] > s.y) != (q[:, 1] > s.y)
        odd = int((s.x < d[cross, 0] * (s.y - p[cross, 1]) / d[cross, 1] + p[cross, 0]).sum()) % 2 == 1
        t = np.clip(((s.x - p[:, 0]) * d[:, 0] + (s.y - p[:, 1]) * d[:, 1]) / (d**2).sum(1), 0, 1)
        away = float(np.hypot(s.x - p[:, 0] - t * d[:, 0], s.y - p[:, 1] - t * d[:, 1]).min())
        have = got.get(s.id)
        assert (have is not None) == (odd or away <= 10.0)
        if have:
            assert have[0] == odd and have[1] == pytest.approx(away, abs=1e-9)


def test_nearest_region_equals_every_edge(spark):
    rng = np.random.default_rng(8)
    shapes = [[star(rng, *rng.uniform(-3000, 3000, 2), 25, 80.0)] for _ in range(12)]
    pts = [(i, *map(float, rng.uniform(-9000, 9000, 2))) for i in range(60)] + [(100 + k, s[0][0][0], s[0][0][1]) for k, s in enumerate(shapes)]
    got = {r.id: (r.region, r.distance) for r in places.nearest_region(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(list(enumerate(shapes)), f"k long, ring {RING}"), ["id"], "k", 50.0).collect()}
    for i, x, y in pts:
        both = [plain(s, x, y) for s in shapes]
        away = min(0.0 if b[0] else b[1] for b in both)
        assert got[i][1] == pytest.approx(away, abs=1e-9) and (0.0 if both[got[i][0]][0] else both[got[i][0]][1]) == pytest.approx(away, abs=1e-9)


def test_odd_rows(spark):
    """Repeated polygons and points, one and two corners, missing coordinates, nothing at all."""
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    shapes = spark.createDataFrame([(1, square), (1, square), (None, square), (3, [[(9.0, 9.0)]]), (4, [[(20.0, 0.0), (20.0, 9.0)]]), (5, [[]]), (6, []), (7, None), (8, [[(None, 1.0), (2.0, None)]])], f"k long, ring {RING}")
    pts = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 9.0, 9.5), (5, 20.0, 4.0)], "id long, x double, y double")
    rows = sorted((r.id, r.k or 0, r.inside, r.boundary_m) for r in places.near_regions(pts, shapes, 0.5, 2.0, ["k"]).collect())
    assert rows == sorted([(1, 1, True, 1.0)] * 4 + [(1, 0, True, 1.0)] * 2 + [(4, 3, False, 0.5), (5, 4, False, 0.0)])
    assert places.near_regions(pts.limit(0), shapes, 0.5, 2.0, ["k"]).count() == 0
    assert places.near_regions(pts, shapes.limit(0), 0.5, 2.0, ["k"]).count() == 0
