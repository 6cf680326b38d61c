"""Nearest points from anywhere, and near points in any order."""

import math
import random

import pytest

from lacuna.operators import dedupe, djoin

XY = "id long, x double, y double"


@pytest.mark.parametrize("seed", range(4))
def test_nearest_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    right = [(i, rng.uniform(-50, 50) + 3000 * (i % 3), rng.uniform(-50, 50)) for i in range(60)] + [(99, 7000.0, 1.0), (98, 7000.0, 1.0)]
    far = 10.0 ** rng.randint(2, 6)
    left = [(i, rng.uniform(-far, far), rng.uniform(-far, far)) for i in range(80)] + [(900, 7000.0, 1.0), (901, None, 1.0)]
    want = {i: min((math.dist((x, y), (u, v)), j) for j, u, v in right) for i, x, y in left if x is not None}
    l, r = spark.createDataFrame(left, XY), spark.createDataFrame(right, XY)
    got = {w.id: (w.distance, w.nearest_id) for w in djoin.nearest(l, r, ["id"], "id", 10.0).collect()}
    assert got.pop(901) == (None, None) and got.keys() == want.keys()
    assert all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0]) for i in want)
    close = {w.id: w.nearest_id for w in djoin.nearest(l, r, ["id"], "id", 10.0, within=700.0).collect()}
    assert close == {i: want[i][1] if i in want and want[i][0] <= 700 else None for i, _, _ in left}


def test_far_rows_carry_few_cells(spark):
    """Rows from afar: joins make a few rows for each, though 900 cells are occupied."""
    r = spark.range(900).selectExpr("id", "id % 30 * 10D AS x", "id DIV 30 * 10D AS y")
    l = spark.range(50).selectExpr("id", "1e6 + id AS x", "1e6 - id AS y")
    assert {w.nearest_id for w in djoin.nearest(l, r, ["id"], "id", 10.0).collect()} == {899}
    assert djoin.nearest(l, r.limit(0), ["id"], "id", 10.0).where("nearest_id IS NULL").count() == 50


def test_one_cell_and_one_point(spark):
    r = spark.createDataFrame([(5, 1.0, 1.0)], XY)
    got = djoin.nearest(spark.createDataFrame([(1, 4.0, 5.0)], XY), r, ["id"], "id", 100.0).first()
    assert (got.nearest_id, got.distance) == (5, 5.0)


@pytest.mark.parametrize("kind", ["random", "line", "reverse", "copies", "apart"])
def test_tolerance_equals_one_by_one(spark, kind):
    rng = random.Random(1)
    at = {
        "random": [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(300)], "line": [(3.0 * i, 0.0) for i in range(200)],
        "reverse": [(600 - 3.0 * i, 0.0) for i in range(200)], "copies": [(1.0, 1.0)] * 50 + [(2.0, 2.0)] * 50, "apart": [(100.0 * i, 0.0) for i in range(20)],
    }[kind]
    kept = []
    for i, p in enumerate(at):
        if all(math.dist(p, at[j]) >= 5 for j in kept):
            kept.append(i)
    got = dedupe.tolerance_dedupe(spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "seq long, x double, y double"), 5.0)
    assert sorted(r.seq for r in got.collect()) == kept


def test_counted_compares_few_pairs(spark):
    """By cells and by pairs alike, against all pairs; whole cells count at once, so fewer rows meet than pairs are near."""
    place = lambda n, seed: spark.range(n).selectExpr("id", f"CAST(pmod(xxhash64(id, {seed}), 1001) AS DOUBLE) AS x", f"CAST(pmod(xxhash64(id, {seed + 1}), 1001) AS DOUBLE) AS y")
    left = place(300, 1).unionByName(spark.createDataFrame([(900, None, 1.0), (901, 9e6, 1.0), (902, float("nan"), 1.0)], "id long, x double, y double"))
    right = place(2000, 3).unionByName(spark.createDataFrame([(900, None, 1.0)], "id long, x double, y double"))
    p, q = left.collect(), [r for r in right.collect() if r.x is not None]
    want = {}
    for a in p:
        d = [math.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) for b in q] if a.x is not None else []
        d = [x for x in d if x <= 200.0]
        want[a.id] = (len(d), min(d, default=None))
    for few in (0, 1e9):
        got = djoin.counted(left, right, 200.0, ["id"], few=few)
        assert {r.id: (r.near, r.least) for r in got.collect()} == want
