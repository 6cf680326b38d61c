"""Points past the polygons of their cell: no shuffle of pairs, cells dealt over tasks, odd keys."""

import numpy as np
import pyarrow as pa
import pytest

from lacuna.operators import places, stream

RING = "array<array<struct<x:double,y:double>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def squares(spark, n=30):
    """k from falling numbers, squares of 4 wide."""
    rng = np.random.default_rng(4)
    at = [(n - i, *map(float, rng.uniform(-10, 10, 2))) for i in range(n)]
    return at, spark.createDataFrame([(k, 100 + k, [[(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)]]) for k, x, y in at], f"zone long, spacing long, ring {RING}")


def spots(spark, n=200):
    rng = np.random.default_rng(6)
    at = [(i, *map(float, rng.uniform(-16, 16, 2))) for i in range(n)]
    return at, spark.createDataFrame(at, "id long, x double, y double")


@pytest.mark.parametrize("task", [1 << 31, 50])
def test_tier_report_ships_no_pairs(spark, monkeypatch, task):
    monkeypatch.setattr(stream, "TASK", task)
    (shapes, polygons), (at, points) = squares(spark), spots(spark)
    df = places.tier_report(points, polygons, ["zone"], 5.0, 1.0)
    above = plan(df).split("MapInArrow", 1)
    assert len(above) == 2 and not any(x in above[0] for x in ("Exchange", "Aggregate", "Join"))
    got = {(r.id, r.zone): (r.distance_to_boundary, r.distance_outside) for r in df.collect()}
    want = {}
    for i, x, y in at:
        for k, a, b in shapes:
            p, q = max(a - x, x - a - 4), max(b - y, y - b - 4)
            away = np.hypot(max(p, 0), max(q, 0)) if max(p, q) > 0 else max(p, q)
            if away < 1:
                want[i, k] = (round(-away, 2), None) if away < 0 else (None, round(float(away), 2))
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[p] == pytest.approx(want[p], abs=0.0101) for p in want)


def test_zone_info_ships_no_pairs(spark):
    (shapes, polygons), (at, points) = squares(spark), spots(spark)
    more = points.unionByName(spark.createDataFrame([(900, None, 1.0), (901, 1e6, 1e6), (None, 0.0, 0.0)], "id long, x double, y double"))
    df = places.zone_info(more, polygons, ["id"], 5.0, [3])
    above = plan(df).split("MapInArrow", 1)
    assert len(above) == 2 and not any(x in above[0] for x in ("Exchange", "Aggregate", "Join"))
    got = {r.id: r.zones for r in df.collect()}
    want = {i: {k: 100 + k for k, a, b in shapes if k != 3 and a < x < a + 4 and b < y < b + 4} or None for i, x, y in at}
    assert got == want | {900: None, 901: None, None: None} and any(want.values())


def test_zone_info_judges_one_place_for_a_square(spark, monkeypatch):
    """Triangles, notches, holes and corners on lattice points, against the plain way; few pairs are judged where places are crowded."""
    rng = np.random.default_rng(9)
    rings = [[[tuple(map(float, p)) for p in rng.integers(-12, 12, (int(rng.integers(3, 7)), 2))] for _ in range(int(rng.integers(1, 3)))] for _ in range(40)]
    polygons = spark.createDataFrame([(k, 100 + k, r) for k, r in enumerate(rings)], f"zone long, spacing long, ring {RING}")
    at = rng.uniform(-13, 13, (3000, 2))
    at[:1000] = np.round(at[:1000])  # on edges and corners
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double")
    near = places.near_regions(points, polygons, 0.0, 5.0, ["zone"], far=False).where("inside")
    want = {}
    for r in near.select("id", "zone").collect():
        want.setdefault(r.id, set()).add(r.zone)
    got = {r.pt.id: [z.zone for z in r.held] for r in stream.meet(points, places.outlines.edges(polygons, ["zone"]), 5.0, "lists").collect()}
    assert {i: set(z) for i, z in got.items() if z} == want and all(z == sorted(z) for z in got.values()) and len(got) == 3000

    judged = []
    plain = stream._Cell.judged
    monkeypatch.setattr(stream._Cell, "judged", lambda self, x, *a: judged.append(len(x)) or plain(self, x, *a))
    rows = stream.outlines.index(stream.outlines.edges(squares(spark)[1].select("zone", "ring"), ["zone"]), 40.0).where("u = 0 AND v = 0").toPandas()
    cell = cell_of(rows, 40.0)
    x, y = rng.uniform(0, 14, (2, 8000))
    pt = pa.array(np.arange(8000))
    out = list(cell.lists(pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pt], ["x", "y", "pt"])))
    pairs = sum(len(b.column(1).flatten()) for b in out)
    assert sum(b.num_rows for b in out) == 8000 and 0 < sum(judged) < pairs


def cell_of(rows, w):
    """A task's cell, from rows of the index."""
    by = {k: g for k, g in rows.groupby("_polygon")}
    box = {k: (g.ax.min(), g.ay.min(), g.bx.max(), g.by.max()) for k, g in by.items()}
    t = []
    for k, g in by.items():
        for r in g.itertuples():
            part = np.isnan(r.ax)
            t.append({"kind": stream.PART if part else stream.CROSSED, "_polygon": k, "_key": k, "before": int(r.before) if part else None, "c": None if part or np.isnan(r.c) else int(r.c)}
                     | dict(zip(("x0", "y0", "x1", "y1"), box[k], strict=True)) | {c: None if part else getattr(r, c) for c in stream.ENDS})
    t.sort(key=lambda r: (r["kind"], r["_key"]))
    schema = pa.schema([("kind", pa.int32()), ("_polygon", pa.int64()), ("_key", pa.int64()), ("before", pa.int64()), ("c", pa.int64()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", *stream.ENDS))])
    return stream._Cell([pa.RecordBatch.from_pylist(t, schema=schema)], schema, (0, 0), w, 0.0, False)


def test_zone_info_of_repeated_rows(spark):
    """An id at two places has the zones of both; a zone in two rows counts once."""
    (_, polygons), (_, points) = squares(spark, 3), spots(spark, 0)
    x, y = polygons.where("zone = 1").select("ring").first().ring[0][0]
    two = spark.createDataFrame([(1, x + 1, y + 1), (1, x + 2, y + 2), (2, x - 900, y)], "id long, x double, y double")
    rows = places.zone_info(two, polygons.where("zone = 1").unionByName(polygons.where("zone = 1")), ["id"], 5.0).collect()
    assert sorted((r.id, r.zones) for r in rows if r.zones) == [(1, {1: 101})] * 2 and [r.zones for r in rows if r.id == 2] == [None]


def test_nearest_region_ships_a_row_a_point(spark):
    (shapes, polygons), (at, points) = squares(spark), spots(spark)
    met = stream.meet(points, places.outlines.edges(polygons, ["zone"]), 5.0, "least")
    assert met.count() == len(at) and "MapInArrow" in plan(met).split("Exchange", 1)[0]
    got = {r.id: (r.region, r.distance) for r in places.nearest_region(points.unionByName(spark.createDataFrame([(900, None, 1.0)], "id long, x double, y double")), polygons, ["id"], "zone", 5.0).collect()}
    assert got.pop(900) == (None, None) and len(got) == len(at)
    for i, x, y in at:
        away = {k: float(np.hypot(max(a - x, x - a - 4, 0), max(b - y, y - b - 4, 0))) for k, a, b in shapes}
        least = min(away.values())
        assert got[i][1] == pytest.approx(least, abs=1e-9)
        assert got[i][0] == min(k for k, d in away.items() if d <= least + 1e-9)
