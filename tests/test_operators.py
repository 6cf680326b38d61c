"""Operators against brute force and the hand-checked cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.config import CellConfig, Settings, SolverConfig, env_bool
from lacuna.functions import scalar
from lacuna.operators import consolidate, coverage, dedupe, djoin, lattice, region, solve
from lacuna.operators.graph import connected_components
from lacuna.plans.cache import ResultCache
from lacuna.sources import geojson, points, sinks
from lacuna.streaming import edits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (80, 2)))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (40, 2)))]
    return a, b, spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double")


def test_distance_joins(cloud):
    a, b, left, right = cloud
    near = {(i, j) for i, x, y in a for j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= 49}
    assert set(rows(djoin.distance_join(left, right, 7.0), "id", "r_id")) == near
    hit = {i for i, _ in near}
    assert {r[0] for r in rows(djoin.distance_join(left, right, 7.0, how="anti"), "id")} == {i for i, _, _ in a} - hit
    assert len(rows(djoin.distance_join(left, right, 7.0, how="left"), "id")) == len(near) + len(a) - len(hit)
    got = dict(rows(djoin.nearest(left, right, ["id"], "id", 1.0), "id", "nearest_id"))
    assert got == {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)[1] for i, x, y in a}
    with pytest.raises(ValueError):
        djoin.distance_join(left, right, 0.0)


def test_inclusive_radius_and_required_radius(spark):
    tests = spark.createDataFrame([(1, 100.0, 0.0, 100.0), (2, 100.000001, 0.0, 100.0), (3, 120.0, 0.0, 100.0), (4, None, 0.0, 100.0)], "test long, x double, y double, required_radius double")
    locked = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert rows(djoin.pre_covered(tests, locked, ["test"], 150.0), "test", "is_match") == [(1, True), (2, False), (3, False), (4, False)]


def test_depths_and_combinations(spark):
    df = spark.createDataFrame([("5",), (None,), ("abc",), ("NaN",)], "d string").select(scalar.safe_depth("d").alias("v"))
    assert sorted(r.v for r in df.collect()) == [0.0, 0.0, 0.0, 5.0]
    for deepest, n in ((95.0, 88), (100.0, 96)):
        p = spark.createDataFrame([(1, 0.0, 0.0, deepest)], "id int, x double, y double, depth double")
        assert coverage.combinations(p, 10).count() == n
    key = spark.range(1).select(scalar.combination_key(F.lit(30), F.lit(True), F.lit(False), F.lit(False)).alias("k")).first().k
    assert key == "d30_spt1_txt0_txe0"


def test_cube_equals_every_combination_by_itself(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(rng.integers(0, 50)), float(rng.integers(0, 50)), float(rng.integers(0, 40)), *map(bool, rng.integers(0, 2, 3))) for i in range(40)]
    tests = [(z, i, float(rng.integers(0, 50)), float(rng.integers(0, 50)), 8.0 + z) for z in range(2) for i in range(50)]
    p = spark.createDataFrame(pts, "id int, x double, y double, depth double, has_spt boolean, has_txt boolean, has_txe boolean")
    t = spark.createDataFrame(tests, "zone int, test int, x double, y double, required_radius double")
    combos = coverage.combinations(p, 20)
    want = {}
    for c in combos.collect():
        own = [q for q in pts if q[3] >= c.min_depth and all(q[4 + i] or not c[n] for i, n in enumerate(coverage.REQUIRED))]
        for z in (0, 1):
            want[(z, c.combo_key)] = sum(any((q[1] - x) ** 2 + (q[2] - y) ** 2 <= r * r for q in own) for zz, _, x, y, r in tests if zz == z)
    assert {(r.zone, r.combo_key): r.covered for r in coverage.cube(t, p, combos, ["zone", "test"], 9.0).collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (None, 3)], "a long, b long")
    assert dict(rows(connected_components(e), "id", "component")) == {**{i: 0 for i in range(51)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(e.limit(0)).count() == 0


def test_regions(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 40.0, 50.0, 2), (2, 20.0, 0.0, 60.0, 40.0, 100.0, 1)], "zone long, x0 double, y0 double, x1 double, y1 double, max_spacing_m double, ord int")
    cells = region.box_cells(boxes, 4.0, ["zone", "max_spacing_m", "ord"])
    assert rows(region.area(cells, 4.0, ["zone"]), "zone", "area_m2") == [(1, 1600.0), (2, 1600.0)]
    assert rows(region.overlaps(cells, "zone", 4.0), "zone_a", "zone_b", "area_m2") == [(1, 2, 800.0)]
    owner = region.priority_owner(cells, "zone")
    assert rows(owner.groupBy("zone").count(), "zone", "count") == [(1, 100), (2, 50)]
    same = cells.withColumn("max_spacing_m", F.lit(50.0))
    assert rows(region.priority_owner(same, "zone").groupBy("zone").count(), "zone", "count") == [(1, 50), (2, 100)]
    one = cells.where("zone = 1").select("zone", "ix", "iy")
    grown = set(rows(region.dilate(one, 9.0, 4.0, ["zone"]), "ix", "iy"))
    held = set(rows(one, "ix", "iy"))
    want = {(x + dx, y + dy) for x, y in held for dx in range(-2, 3) for dy in range(-2, 3) if (dx * dx + dy * dy) * 16 <= 81}
    assert grown == want
    split = one.where("ix <> 4")
    assert region.pieces(split, "zone").select("piece").distinct().count() == 2


def test_polygon_with_hole(spark):
    ring = [[(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)], [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)]]
    df = spark.createDataFrame([(1, ring)], "zone long, ring array<array<struct<x:double,y:double>>>")
    assert df.select(region.ring_area().alias("a")).first().a == 1200.0
    assert region.ring_cells(df, 2.0, ["zone"]).count() * 4 == 1200


def test_dedupe(spark):
    line = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.4, 0.0), (2, 0.8, 0.0)], "seq long, x double, y double")
    assert [r[0] for r in rows(dedupe.tolerance_dedupe(line, 0.5), "seq")] == [0, 2]
    exact = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.0)], "seq long, x double, y double")
    assert dedupe.tolerance_dedupe(exact, 0.5).count() == 2
    assert rows(dedupe.not_readded(line.select("x", "y"), line.where("seq = 1")), "x") == [(0.0,), (0.8,)]
    removed, added = djoin.drop_coincident(line.where("seq = 0"), line.where("seq > 0"), 1.0)
    assert removed.count() == 0 and rows(added, "seq") == [(2,)]


def test_lattice_and_lines(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "zone long, x0 double, y0 double, x1 double, y1 double")
    got = rows(lattice.box_lattice(box, F.lit(4.0)), "row", "k", "x")
    want = sorted((r, k, (r % 2) * 2.0 + 4.0 * k) for r in range(4) for k in range(4) if 0 < (r % 2) * 2.0 + 4.0 * k < 10 and 0 < r * 4 * lattice.ROW < 10)
    assert got == want
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (101.0, 0.0)]), (2, [(0.0, 0.0), (0.9, 0.0)]), (3, [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0)])], "line long, points array<struct<x:double,y:double>>")
    s = rows(lattice.line_samples(lines, F.lit(50.0), ["line"]), "line", "k", "x", "y")
    assert [r for r in s if r[0] == 1][-1][2] == pytest.approx(101.0) and sum(r[0] == 1 for r in s) == 4 and not any(r[0] == 2 for r in s)
    assert [r[2:] for r in s if r[0] == 3] == [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0)]


def test_thresholds_and_settings(spark):
    assert CellConfig(target=1e6, threshold=1e6).thresholds(100.0) == (2e6, 4e6)
    df = spark.createDataFrame([(2.1e6,)], "a double").select(scalar.cell_count("a", 1e6, 2, 30).alias("n"))
    assert df.first().n == 3
    assert env_bool("false", True) is False and env_bool(None, True) is True
    with pytest.raises(ValueError):
        SolverConfig(mode="auto")
    assert Settings().with_env(env={"LACUNA_DEPTH_STEP": "10"}).depth_step == 10


def brute(covers, tests, near):
    coverable = set().union(*map(set, covers)) if covers else set()
    for k in range(len(covers) + 1):
        for pick in itertools.combinations(range(len(covers)), k):
            if set().union(*(set(covers[c]) for c in pick), set()) >= coverable and not any(b in near[a] for a, b in itertools.combinations(pick, 2)):
                return k
    return None


@pytest.mark.parametrize("seed", range(12))
def test_set_cover_is_optimal_on_small_problems(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.random(9) * 10, rng.random(9) * 10
    t = rng.random((14, 2)) * 10
    covers = [np.flatnonzero((t[:, 0] - x[c]) ** 2 + (t[:, 1] - y[c]) ** 2 <= 9) for c in range(9)]
    near = [set(k.tolist()) for k in solve.conflicts(x, y, 1.5)[0]]
    best = brute(covers, 14, near)
    chosen, status, factor, bound = solve.solve(covers, 14, x, y, 1.5, SolverConfig(exclusion_factor=1.0))
    if best is not None:
        assert len(chosen) == best and factor == 1.0 and bound <= best
    large, _, _, bound = solve.solve(covers, 14, x, y, 0.0, SolverConfig(exact_steps=0))
    free = brute(covers, 14, [set()] * 9)
    assert free <= len(large) and bound <= free
    assert set().union(*(set(covers[c]) for c in large), set()) == set().union(*map(set, covers))


def test_conflict_ladder_ends_without_conflicts():
    covers = [np.array([0]), np.array([1])]
    chosen, _, factor, _ = solve.solve(covers, 2, np.array([0.0, 1.0]), np.array([0.0, 0.0]), 10.0, SolverConfig())
    assert chosen == [0, 1] and factor is None


def test_cliques():
    near = [np.array([1, 2]), np.array([0, 2]), np.array([0, 1, 3]), np.array([2])]
    cliques, whole = solve.maximal_cliques(near)
    assert cliques == [[0, 1, 2], [2, 3]] and whole and not solve.maximal_cliques(near, 1)[1]
    assert solve.clique_stats(cliques)["pairwise_equivalent"] == 4


def test_grouped_placement_and_single_solve(spark):
    tests = spark.createDataFrame([(p, i, float(10 * i), 0.0, 6.0) for p in (1, 2) for i in range(4)], "problem long, test long, x double, y double, required_radius double")
    cands = spark.createDataFrame([(p, i, 5.0 + 10 * i, 0.0, 0.0) for p in (1, 2) for i in range(3)], "problem long, cand long, x double, y double, exclusion double")
    out = solve.place_sites(tests, cands, 6.0).collect()
    assert sorted((r.problem, r.cand, r.status) for r in out) == [(p, c, "optimal") for p in (1, 2) for c in (0, 2)]
    assert all(r.covered == r.coverable == 4 for r in out)
    assert rows(solve.once(tests, ["test", "x", "y"]), "problem", "representative") == [(1, 1), (2, 1)]


def test_classification_and_colours(spark):
    tier1 = spark.createDataFrame([(1, 0, 0)], "problem long, ix long, iy long")
    tier2 = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "problem long, ix long, iy long")
    s = spark.createDataFrame([(1, 5.0, 5.0, False), (2, 5.0, 6.0, True), (3, 15.0, 5.0, False), (4, 99.0, 0.0, False)], "seq long, x double, y double, is_centreline boolean")
    assert rows(consolidate.classify(s, tier1, tier2, 10.0, ["problem"]), "seq", "role") == [(1, "candidate"), (2, "locked"), (3, "locked")]
    pairs = spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 30, 40)], "pair long, a long, b long")
    colour = dict(rows(consolidate.pair_colours(pairs), "pair", "colour"))
    assert colour[1] != colour[2] and colour[2] != colour[3]


def test_consolidation_keeps_coverage(spark):
    h = 10.0
    tier1 = spark.createDataFrame([(1, x, y) for x in range(20) for y in range(20)], "problem long, ix long, iy long")
    tests = spark.createDataFrame([(i * 20 + j, 5.0 + 10 * i, 5.0 + 10 * j, 60.0) for i in range(20) for j in range(20)], "test long, x double, y double, required_radius double")
    s = spark.createDataFrame([(i * 7 + j, 15.0 + 28 * i, 15.0 + 28 * j, False) for i in range(7) for j in range(7)], "seq long, x double, y double, is_centreline boolean")
    out = consolidate.consolidate(s, tests, tier1, tier1, 60.0, h, Settings(solver=SolverConfig(conflict_mode="none")))
    removed, added = out["removed"], out["added"]
    final = dedupe.assemble(s.select("x", "y"), [removed], [added.select("x", "y")])
    assert final.count() < 49 and consolidate.valid_removals(removed, tier1, h).count() == removed.count()
    assert djoin.unsatisfied(tests, final, ["test"], 60.0).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text(" Location ID ,Easting,Northing,Final Depth\nA,1,2,5\nB,,2,5\nC,3,4,abc\n")
    (tmp_path / "spt.csv").write_text("Location ID,x\nA,1\nA,2\n")
    p = points.read_points(spark, str(tmp_path / "p.csv"))
    assert rows(p, "location_id", "depth") == [("A", 5.0), ("C", 0.0)]
    t = points.read_test_ids(spark, {"spt": str(tmp_path / "spt.csv"), "triaxial_total": str(tmp_path / "none.csv")})
    assert rows(points.with_flags(p, t), "location_id", "has_spt", "has_txt") == [("A", True, False), ("C", False, False)]
    assert points.extent(p) == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError):
        points.read_points(spark, str(tmp_path / "spt.csv"))
    df = spark.createDataFrame([(1.0, 2.0, "z")], "x double, y double, name string")
    sinks.write_features(sinks.collection(sinks.point_features(df, ["name"])), str(tmp_path / "g"))
    f = geojson.points(geojson.read_features(spark, str(tmp_path / "g")))
    assert [(r.x, r.y, r.properties["name"]) for r in f.collect()] == [(1.0, 2.0, "z")]
    empty = sinks.collection(sinks.point_features(df.limit(0), ["name"])).first().value
    assert empty == '{"type":"FeatureCollection","features":[]}'
    assert "| 1.0 | 2.0 | z |" in sinks.markdown(df, "t")


def test_cache(spark, tmp_path):
    df = spark.range(5)
    cache = ResultCache(spark, str(tmp_path / "c"))
    key = cache.key({"a": df}, "x")
    assert key == cache.key({"a": df.orderBy(F.desc("id"))}, "x") != cache.key({"a": spark.range(6)}, "x")
    assert cache.get(key, lambda: df).count() == cache.get(key, lambda: df).count() == 5
    assert cache.stats() == {"entries": 1, "hits": 1, "misses": 1}
    assert cache.prune(0) == [key] and not cache.has(key)


def test_edits_as_batch_and_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "id long, x double, y double")
    log = [(1, 1, "move", 5.0, 5.0), (2, 2, "delete", None, None), (3, 9, "add", 7.0, 7.0), (4, 8, "move", 1.0, 1.0), (5, 1, "move", 6.0, 6.0), (6, 3, "delete", None, None), (7, 3, "restore", None, None)]
    e = spark.createDataFrame([(*r, ) for r in log], "seq long, id long, action string, x double, y double").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    want = [(1, 6.0, True), (3, 0.0, False), (9, 7.0, True)]
    assert rows(edits.apply_edits(base, e), "id", "x", "is_edited") == want
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    q = edits.run_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), base, lambda b, _: seen.update({r.id: (r.was, r.present, r.x) for r in b.collect()}), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == {1: (True, True, 6.0), 2: (True, False, None), 9: (False, True, 7.0)}


def test_parts_share_no_candidate_and_no_conflict(spark):
    import itertools
    import random

    rng = random.Random(5)
    tests = [(p, i, rng.uniform(0, 900), rng.uniform(-300, 300), 10.0) for p in (1, 2) for i in range(40)]
    cands = [(p, i, x + rng.uniform(-9, 9), y, 15.0) for p, i, x, y, _ in tests]
    t = spark.createDataFrame(tests, "problem long, test long, x double, y double, required_radius double")
    c = spark.createDataFrame(cands, "problem long, cand long, x double, y double, exclusion double")
    named = {(r.problem, r.test): r.part for r in solve.parts(t, c).collect()}
    assert len(named) == 80 and len(set(named.values())) > 10
    for a, b in itertools.combinations(tests, 2):
        if a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 35.0**2:
            assert named[a[0], a[1]] == named[b[0], b[1]]
    total = {r.problem: r for r in solve.totals(solve.place_sites(t, c, 10.0)).collect()}
    assert [total[p].tests for p in (1, 2)] == [40, 40] and all(r.covered == r.coverable == 40 and r.parts > 5 and r.lower_bound <= r.selected for r in total.values())


def test_third_pass_over_seams_keeps_coverage(spark):
    h, r = 10.0, 30.0
    tier1 = spark.createDataFrame([(p, x + 500 * p, y) for p in (1, 2) for x in range(40 if p == 1 else 8) for y in range(10)], "problem long, ix long, iy long")
    cells = consolidate.split_large(tier1, h, CellConfig(target=10_000.0, threshold=20_000.0)).cache()
    n = {r.cluster: r for r in cells.groupBy("cluster").agg(F.countDistinct("problem").alias("problems"), F.count("*").alias("cells")).collect()}
    assert n[1].problems == 4 and n[1].cells == 400 and n[2].problems == 1 and n[2].cells == 80
    tests = spark.createDataFrame([(i * 10 + j, 5005.0 + 10 * i, 5.0 + 10 * j, r) for i in range(40) for j in range(10)], "test long, x double, y double, required_radius double")
    s = spark.createDataFrame([(i * 4 + j, 5012.0 + 20 * i, 12.0 + 25 * j, False) for i in range(20) for j in range(4)], "seq long, x double, y double, is_centreline boolean")
    out = consolidate.third_pass(s, tests, cells, r, h, Settings(solver=SolverConfig(conflict_mode="none")))
    final = [(p.x, p.y) for p in out["sites"].collect()]
    assert len(final) == 80 - out["removed"].count() + out["added"].count() < 80
    assert all(any((t.x - x) ** 2 + (t.y - y) ** 2 <= r * r for x, y in final) for t in tests.collect())
    whole = consolidate.third_pass(s, tests, cells.where("cluster = 2"), r, h)
    assert whole["removed"].count() == 0 and whole["added"].count() == 0
