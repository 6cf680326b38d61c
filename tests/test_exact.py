"""Exact areas, fills to the end and edits as a stateful service."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import discs, fill
from lacuna.streaming import edits

BOX = "zone long, x0 double, y0 double, x1 double, y1 double, spacing double"


def area(spark, points, r=10.0, box=(0.0, 0.0, 100.0, 100.0)):
    z = spark.createDataFrame([(1, *box, r)], BOX)
    p = spark.createDataFrame(points, "x double, y double")
    got = discs.union_areas(discs.discs_of_zones(z, p), r).first()
    return got.area_m2 if got else 0.0


def lens(d, r):
    return 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)


def segment(s, r):
    """The part of a disc beyond a line at distance s from its centre."""
    return r * r * math.acos(s / r) - s * math.sqrt(r * r - s * s)


CASES = [
    ([(50.0, 50.0)], math.pi * 100),
    ([(50.0, 50.0), (50.0, 50.0)], math.pi * 100),
    ([(30.0, 30.0), (70.0, 70.0)], 2 * math.pi * 100),
    ([(30.0, 30.0), (50.0, 30.0)], 2 * math.pi * 100),
    ([(50.0, 50.0), (62.0, 50.0)], 2 * math.pi * 100 - lens(12.0, 10.0)),
    ([(50.0, 50.0), (53.0, 54.0)], 2 * math.pi * 100 - lens(5.0, 10.0)),
    ([(0.0, 50.0)], math.pi * 50),
    ([(0.0, 0.0)], math.pi * 25),
    ([(100.0, 100.0)], math.pi * 25),
    ([(104.0, 50.0)], segment(4.0, 10.0)),
    ([(50.0, -6.0)], segment(6.0, 10.0)),
    ([(50.0, 97.0)], math.pi * 100 - segment(3.0, 10.0)),
    ([(-20.0, 50.0), (130.0, 50.0)], 0.0),
    ([(108.0, 108.0)], 0.0),
    ([], 0.0),
]


@pytest.mark.parametrize(("points", "want"), CASES)
def test_areas_of_known_shapes(spark, points, want):
    assert area(spark, points) == pytest.approx(want, abs=1e-6)


def test_a_box_inside_discs_is_all_covered(spark):
    points = [(float(x), float(y)) for x in range(-5, 40, 5) for y in range(-5, 30, 5)]
    assert area(spark, points, 8.0, (0.0, 0.0, 33.0, 21.0)) == pytest.approx(33 * 21, abs=1e-6)
    assert area(spark, [(1e6 + 2, 1e6 + 3)], 100.0, (1e6, 1e6, 1e6 + 5, 1e6 + 7)) == pytest.approx(35, abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_areas_equal_an_integral_over_lines(spark, seed):
    """Of random discs: the covered length of each vertical line, integrated between all its kinks."""
    rng = np.random.default_rng(seed)
    p, r = rng.random((40, 2)) * 120 - 10, 14.0
    kinks = {0.0, 100.0, *(p[:, 0] - r), *(p[:, 0] + r)}
    for i in range(len(p)):
        for y in (0.0, 100.0):
            if abs(y - p[i, 1]) < r:
                kinks |= {p[i, 0] + s * math.sqrt(r * r - (y - p[i, 1]) ** 2) for s in (-1, 1)}
        for j in range(i):
            d = math.dist(p[i], p[j])
            if 0 < d < 2 * r:
                across = math.sqrt(r * r - d * d / 4) / d
                kinks |= {(p[i, 0] + p[j, 0]) / 2 + s * across * (p[j, 1] - p[i, 1]) for s in (-1, 1)}
    kinks = sorted(k for k in kinks if 0 <= k <= 100)
    nodes, weights = np.polynomial.legendre.leggauss(40)

    def covered(x):
        half = np.sqrt(np.maximum(r * r - (x - p[:, 0]) ** 2, 0))
        out, end = 0.0, 0.0
        for a, b in sorted(zip(np.maximum(p[:, 1] - half, 0), np.minimum(p[:, 1] + half, 100), strict=True)):
            if b > max(a, end) and b > a:
                out += b - max(a, end)
                end = b
        return out

    total = 0.0
    for a, b in zip(kinks[:-1], kinks[1:], strict=True):
        # the square of the sine takes the roots at both ends out of the integrand
        t = (nodes + 1) * math.pi / 4
        x = a + (b - a) * np.sin(t) ** 2
        total += sum(w * covered(v) * math.sin(2 * s) for w, v, s in zip(weights, x, t, strict=True)) * (b - a) * math.pi / 4
    assert area(spark, [tuple(map(float, q)) for q in p], r) == pytest.approx(total, abs=1e-6 * total)


def test_fill_leaves_nothing_open(spark):
    cells = spark.createDataFrame([(z, i, j, 5.0, 40.0 if z else 60.0) for z in (0, 1) for i in range(60 * z, 60 * z + 60) for j in range(40)], "zone long, ix long, iy long, h double, spacing double")
    sites = spark.createDataFrame([(100.0, 100.0), (350.0, 60.0)], "x double, y double")
    new = fill.fill(cells, sites, 60.0).cache()
    every = sites.unionByName(new.select("x", "y"))
    assert fill.open_cells(cells, sites, 60.0).count() > 0 == fill.open_cells(cells, every, 60.0).count()
    rounds = new.agg(F.max("round")).first()[0]
    assert rounds <= 4 and fill.fill(cells, every, 60.0).count() == 0
    # no more than the inner squares of the discs, and what is left at their corners
    assert new.count() <= 2 * (300 * 200 / (2 * 60**2) + 300 * 200 / (2 * 40**2)) + 20


def test_solver_and_fill_as_one_chain(spark):
    cells = spark.createDataFrame([(0, i, j, 5.0, 50.0) for i in range(60) for j in range(60)], "zone long, ix long, iy long, h double, spacing double")
    tests = spark.createDataFrame([(0, i * 30 + j, 5.0 + 10 * i, 5.0 + 10 * j, 50.0) for i in range(30) for j in range(30)], "problem long, test long, x double, y double, required_radius double")
    cands = spark.createDataFrame([(0, i * 13 + j, 25.0 * i, 25.0 * j, 45.0) for i in range(13) for j in range(13)], "problem long, cand long, x double, y double, exclusion double")
    locked = spark.createDataFrame([(20.0 * i, 150.0) for i in range(16)], "x double, y double")
    out = fill.complete(cells, tests, cands, locked, 50.0).cache()
    by = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by["solver"] > 0 and set(by) <= {"solver", "fill 1", "fill 2", "fill 3"}
    assert fill.open_cells(cells, locked.unionByName(out.select("x", "y")), 50.0).count() == 0


def one_by_one(base, log):
    """Edits applied in order, as a user would."""
    now, edited = dict(base), set()
    for _, i, action, x, y in sorted(log):
        if action == "add" or action == "move" and i in now:
            now[i] = (x, y)
            edited.add(i)
        elif action == "delete":
            now.pop(i, None)
        elif action == "restore":
            now.pop(i, None)
            edited.discard(i)
            if i in base:
                now[i] = base[i]
        if i not in now:
            edited.discard(i)
    return sorted((i, x, y, i in edited) for i, (x, y) in now.items())


LOG = "seq long, id long, action string, x double, y double"


def random_log(seed, n=160):
    rng = random.Random(seed)
    base = {i: (float(i), 0.0) for i in range(6)}
    log = [(k, rng.randrange(12), rng.choice(edits.ACTIONS), rng.random() * 300, rng.random() * 300) for k in range(n)]
    return base, [(k, i, a, *((x, y) if a in ("add", "move") else (None, None))) for k, i, a, x, y in log]


@pytest.mark.parametrize("log", [
    [(1, 9, "add", 1.0, 1.0), (2, 9, "move", 2.0, 2.0)],
    [(1, 1, "delete", None, None), (2, 1, "move", 2.0, 2.0)],
    [(1, 1, "move", 2.0, 2.0), (2, 1, "restore", None, None), (3, 1, "move", 3.0, 3.0)],
    [(1, 9, "move", 2.0, 2.0), (2, 9, "restore", None, None)],
    [(1, 1, "delete", None, None), (2, 1, "add", 5.0, 5.0), (3, 1, "delete", None, None), (4, 1, "restore", None, None)],
])
def test_edits_hold_in_order(spark, log):
    base = {1: (0.0, 0.0)}
    got = edits.apply_edits(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), spark.createDataFrame(log, LOG))
    assert sorted(map(tuple, got.collect())) == one_by_one(base, log)


@pytest.mark.parametrize("seed", range(4))
def test_random_edits_equal_one_by_one(spark, seed):
    base, log = random_log(seed)
    random.Random(seed).shuffle(log)
    b = spark.createDataFrame([(i, *p) for i, p in base.items()], "id long, x double, y double")
    got = edits.apply_edits(b, spark.createDataFrame(log + log[:20], LOG))
    assert sorted(map(tuple, got.collect())) == one_by_one(base, log)


def test_service_equals_a_batch_and_drops_late_rows(spark, tmp_path):
    h, r = 20.0, 60.0
    base, log = random_log(11)
    b = spark.createDataFrame([(i, *p) for i, p in base.items()], "id long, x double, y double")
    cells = spark.createDataFrame([(z, i, j, r) for z in (0, 1) for i in range(8 * z, 8 * z + 8) for j in range(15)], "zone_id long, ix long, iy long, max_spacing_m double")
    e = spark.createDataFrame(log, LOG).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    for k in range(4):  # the edits of a batch come in any order
        e.where(f"seq % 160 DIV 40 = {k}").orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(10**6, 0, "add", 1.0, 1.0)], LOG).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    folder = str(tmp_path / "counts")
    edits.cover_counts(b, cells, h, r).write.parquet(f"{folder}/start")
    seen, keep = [], edits.keep_counts(spark, folder, cells, h, r)

    def apply(change, batch):
        change = change.persist()
        seen.append([tuple(c) for c in change.collect()])
        keep(change, batch)
        keep(change, batch)  # a batch that comes again

    def run():
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        edits.run_stream(stream, b, apply, str(tmp_path / "cp")).awaitTermination(120)

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run()
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    now = {i: p for i, p in base.items()}
    for batch in seen:
        for i, was, present, ox, oy, x, y, _ in batch:
            assert was == (i in now) and (not was or now[i] == (ox, oy))
            now.pop(i, None)
            if present:
                now[i] = (x, y)
    want = one_by_one(base, log)
    assert sorted((i, *p) for i, p in now.items()) == [w[:3] for w in want]
    last = max(int(p.name) for p in (tmp_path / "counts").iterdir() if p.name.isdigit())
    after = spark.createDataFrame([w[1:3] for w in want], "x double, y double")
    both = [sorted(map(tuple, c.select("zone_id", "ix", "iy", "n").collect())) for c in (spark.read.parquet(f"{folder}/{last}"), edits.cover_counts(after, cells, h, r))]
    assert both[0] == both[1] and len(both[0]) > 50
    areas = {x.zone_id: x.covered_m2 for x in edits.zone_areas(spark.read.parquet(f"{folder}/{last}"), h).collect()}
    assert sum(areas.values()) == len(both[0]) * h * h


def test_covered_circles_meet_no_disc(spark):
    """Dense discs: only circles that may show are kept for the pairs, and the area is that of all of them."""
    z = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0, 10.0)], "zone long, x0 double, y0 double, x1 double, y1 double, spacing double")
    p = spark.range(4000).selectExpr("CAST(pmod(xxhash64(id, 1), 601) / 10 AS DOUBLE) AS x", "CAST(pmod(xxhash64(id, 2), 1001) / 10 AS DOUBLE) AS y")
    d = discs.discs_of_zones(z, p)
    left = discs.bare(d.selectExpr("zone", "x", "y", "r", "x0", "y0", "x1", "y1"))
    assert left.columns == ["zone", "x", "y", "r", "x0", "y0", "x1", "y1"] and 0 < left.count() < d.count() / 5
    own = np.array([(r.x, r.y) for r in d.select("x", "y").collect()])
    h = 0.1
    grid = (np.arange(1000) + 0.5) * h
    most = np.array([[max((x + math.sqrt(max(100 - (y - v) ** 2, 0)) for x, v in own if abs(v - y) <= 10 and x > 50), default=0.0)] for y in grid[::10]])
    assert discs.union_areas(d, 10.0).first().area_m2 == pytest.approx(float(np.minimum(most, 100).mean() * 100), rel=2e-3)
