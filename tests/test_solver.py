"""The solver: exact ids, bounds, cliques, tiles; passes and their invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.config import SolverConfig
from lacuna.operators import consolidate, djoin, region, solve

RADIUS = 100.0
TESTS = "problem long, test long, x double, y double, required_radius double"
CANDS = "problem long, cand long, x double, y double, exclusion double"


def test_ids_beyond_53_bits_beside_a_test_without_candidate(spark):
    big = 1 << 62
    tests = [(1, i, 1000.0 * i, 0.0, 10.0) for i in range(7)]
    cands = [(1, big + i, 1000.0 * i, 1.0, 5.0) for i in range(6)]
    edges = spark.createDataFrame([(1, 1, i, big + i if i < 6 else None) for i in range(7)], "problem long, part long, test long, cand long")
    c = spark.createDataFrame([(p, 1, *r) for p, *r in cands], "problem long, part long, cand long, x double, y double, exclusion double")
    got = solve.solve_problems(edges, c).collect()
    assert sorted(r.cand for r in got) == [big + i for i in range(6)]
    assert {(r.status, r.tests, r.coverable, r.covered, r.lower_bound) for r in got} == {("optimal", 7, 6, 6, 6)}
    placed = solve.place_sites(spark.createDataFrame(tests, TESTS), spark.createDataFrame(cands, CANDS), 10.0)
    assert placed.where("cand IS NOT NULL").count() == 6
    with_a_stranger = solve.solve_problems(edges.unionByName(edges.where("test = 0").withColumn("cand", F.lit(5).cast("long"))), c).collect()
    assert len(with_a_stranger) == 1 and with_a_stranger[0].status.startswith("error") and with_a_stranger[0].cand is None


def brute(covers, tests, near, need):
    for k in range(len(covers) + 1):
        for pick in itertools.combinations(range(len(covers)), k):
            if len(set().union(*(set(covers[c]) for c in pick), set())) >= need and not any(b in near[a] for a, b in itertools.combinations(pick, 2)):
                return k
    return None


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("spare", [0, 3])
def test_bounds_hold_and_are_close(seed, spare):
    rng = np.random.default_rng(seed)
    c, t = rng.random((10, 2)) * 10, rng.random((18, 2)) * 10
    covers = [np.flatnonzero(((t - p) ** 2).sum(1) <= 9) for p in c]
    near, _ = solve.conflicts(c[:, 0], c[:, 1], 1.5)
    coverable = len(set().union(*map(set, covers)))
    p = solve.Problem(covers, 18, near)
    best = brute(covers, 18, [set(k.tolist()) for k in near], coverable - spare)
    free = brute(covers, 18, [set()] * 10, coverable - spare)
    value, reduced, u, _ = p.dual(400, 10, spare=spare)
    assert np.ceil(value - 1e-6) <= free and value >= 0.6 * free - 1
    # candidates that the reduced cost rules out are in no better cover
    if best is not None:
        for pairs_only in (False, True):
            bound = p.dual(400, best, cliques=solve.clique_cover(near, pairs_only), spare=spare)[0]
            assert np.ceil(bound - 1e-6) <= best
    if not spare:
        out = frozenset(np.flatnonzero(value + reduced > free + 1e-6).tolist())
        assert solve.Problem(covers, 18, None).exact(None, 10**6, out)[0] is not None
        # shares of a candidate's cost in two halves of the tests add up to a bound
        side = t[:, 0] < 5
        halves = []
        for mine in (side, ~side):
            own = [k[mine[k]] for k in covers]
            share = np.array([len(a) / max(1, len(b)) for a, b in zip(own, covers, strict=True)])
            halves.append(solve.Problem(own, 18, None).dual(400, 10, share)[0])
        assert np.ceil(sum(halves) - 1e-6) <= free


def test_cliques_prove_what_pairs_cannot():
    """Three candidates in conflict with each other, of which a fractional cover takes half each."""
    covers = [np.array([0, 1, 5]), np.array([1, 2, 5]), np.array([0, 2, 5]), np.array([0]), np.array([1]), np.array([2])]
    x = np.array([0.0, 0.5, 0.25, 9.0, 13.0, 17.0])
    near, _ = solve.conflicts(x, np.zeros(6), 1.0)
    p = solve.Problem(covers, 6, near)
    by = [np.ceil(p.dual(400, 9, cliques=solve.clique_cover(near, pairs_only))[0] - 1e-6) for pairs_only in (True, False)]
    assert by == [2, 2] or by[0] < by[1]
    many = [np.array([2 * i, 2 * i + 1]) for i in range(4)]
    covers = [np.unique(np.concatenate([many[a], many[b]])) for a, b in itertools.combinations(range(4), 2)] + [np.array([i]) for i in range(8)]
    x = np.concatenate([np.linspace(0, 0.5, 6), np.arange(10, 90, 10.0)])
    near, _ = solve.conflicts(x, np.zeros(14), 1.0)
    p = solve.Problem(covers, 8, near)
    value = [p.dual(800, 9, cliques=solve.clique_cover(near, pairs_only))[0] for pairs_only in (True, False)]
    assert value[1] > value[0] + 0.5
    statuses = [solve.solve(covers, 8, x, np.zeros(14), 1.0, SolverConfig(exclusion_factor=1.0, exact_steps=1, conflict_mode=mode))[1:] for mode in ("pairwise", "clique")]
    assert statuses[0][0] == "feasible" and statuses[1][0] == "optimal"


@pytest.mark.parametrize("seed", range(5))
def test_clique_cover_holds_every_conflict(seed):
    rng = np.random.default_rng(seed)
    near, _ = solve.conflicts(rng.random(40) * 10, rng.random(40) * 10, 2.0)
    clique, member = solve.clique_cover(near)
    held = {(a, b) for k in set(clique.tolist()) for a, b in itertools.combinations(sorted(member[clique == k].tolist()), 2)}
    assert held == {(a, b) for a, k in enumerate(near) for b in k.tolist() if a < b}


@pytest.fixture(scope="module")
def square(spark):
    """Tests 25 m apart on a square of 1.5 km, candidates 50 m apart, and a second problem far too small to split."""
    tests = [(1, i * 60 + j, 25.0 * i, 25.0 * j, RADIUS) for i in range(60) for j in range(60)] + [(2, i, 40.0 * i, 7.0, RADIUS) for i in range(9)]
    cands = [(1, i * 31 + j, 50.0 * i + 1, 50.0 * j + 2, 90.0) for i in range(31) for j in range(31)] + [(2, i, 80.0 * i, 0.0, 90.0) for i in range(5)]
    return spark.createDataFrame(tests, TESTS).cache(), spark.createDataFrame(cands, CANDS).cache()


def test_tiles_cover_all_with_about_as_many_sites(spark, square):
    t, c = square
    whole = {r.problem: r for r in solve.totals(solve.place_sites(t, c, RADIUS)).collect()}
    placed = solve.place_sites(t, c, RADIUS, max_edges=12_000).cache()
    got = {r.problem: r for r in solve.totals(placed).collect()}
    assert got[2].selected == whole[2].selected and got[1].covered == got[1].coverable == 3600
    assert abs(got[1].selected - whole[1].selected) <= 0.05 * whole[1].selected
    assert 0.9 * whole[1].lower_bound <= got[1].lower_bound <= whole[1].selected
    factor = got[1].conflict_factor
    at = [(r.x, r.y) for r in placed.where("problem = 1").collect()]
    assert factor and all((a - u) ** 2 + (b - v) ** 2 > (factor * 90.0) ** 2 for (a, b), (u, v) in itertools.combinations(at, 2))


def test_no_tile_is_larger_than_stated(spark, square):
    t, c = square
    edges = djoin.distance_join(t.withColumn("part", F.lit(1).cast("long")), c.select("problem", "cand", "x", "y", "exclusion"), "required_radius", RADIUS).where("problem = r_problem")
    edges = edges.select("problem", "part", "test", F.col("x").alias("tx"), F.col("y").alias("ty"), "required_radius", F.col("r_cand").alias("cand"), F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col("r_exclusion").alias("exclusion"))
    tiled = solve.tiled(edges, 12_000).cache()
    sizes = tiled.groupBy("problem", "u", "v").agg(F.count("*").alias("n"), F.countDistinct("colour").alias("colours")).collect()
    assert tiled.count() == edges.count() and len(sizes) == 10 and all(r.n <= 12_000 and r.colours == 1 for r in sizes)
    # candidates of two tiles of one colour are neither shared nor in conflict
    of = [(r.colour, (r.u, r.v), r.x, r.y) for r in tiled.where("problem = 1").select("colour", "u", "v", "x", "y").distinct().collect()]
    by = {}
    for colour, tile, x, y in of:
        by.setdefault(colour, {}).setdefault(tile, []).append((x, y))
    for tiles in by.values():
        for a, b in itertools.combinations(tiles.values(), 2):
            a, b = np.array(a), np.array(b)
            assert ((a[:, None] - b[None]) ** 2).sum(2).min() > 90.0**2


def test_blocked_tests_are_covered_along_the_ladder(spark):
    """Neighbouring tiles whose only candidates are in conflict."""
    t = spark.createDataFrame([(1, i, 290.0 * i + 145, 0.0, 100.0) for i in range(12)], TESTS)
    c = spark.createDataFrame([(1, i, 290.0 * i + 145, 0.0, 300.0) for i in range(12)], CANDS)
    got = solve.totals(solve.place_sites(t, c, 100.0, max_edges=1)).first()
    assert (got.selected, got.covered, got.lower_bound) == (12, 12, 12) and got.conflict_factor == 0.8


def test_equal_problems_are_solved_once(spark, square, monkeypatch):
    t, c = (df.where("problem = 2").drop("problem").withColumn("problem", F.explode(F.array(F.lit(5), F.lit(6), F.lit(9)).cast("array<long>"))) for df in square)
    c = c.where("NOT (problem = 9 AND cand = 4)")
    solved = []
    plain = solve.place_sites
    monkeypatch.setattr(solve, "place_sites", lambda tests, *a, **k: solved.append(sorted(r[0] for r in tests.select("problem").distinct().collect())) or plain(tests, *a, **k))
    got = solve.place_once(t.select(TESTS.replace(" long", "").replace(" double", "").split(", ")), c.select(CANDS.replace(" long", "").replace(" double", "").split(", ")), RADIUS)
    by = {p: sorted(r.cand for r in got.where(F.col("problem") == p).collect()) for p in (5, 6, 9)}
    assert solved == [[5, 9]] and by[5] == by[6] != by[9]


@pytest.mark.parametrize("edges", [[(i, i, i + 1) for i in range(12)], [(i, 0, i + 1) for i in range(9)], [(i * 8 + j, i, j + 100) for i in range(8) for j in range(8)], []])
def test_colours_are_proper_and_few(spark, edges):
    got = {r.pair: r.colour for r in consolidate.pair_colours(spark.createDataFrame(edges, "pair long, a long, b long")).collect()}
    assert set(got) == {e[0] for e in edges}
    degree = {}
    for p, *ends in edges:
        for e in ends:
            degree.setdefault(e, []).append(got[p])
    assert all(len(set(c)) == len(c) for c in degree.values())
    assert len(set(got.values())) <= max([2 * max(map(len, degree.values()), default=1) - 1, 0])


def test_what_one_cluster_counts_on_no_other_removes(spark):
    """Two neighbouring clusters; each one's candidates are the other's locked sites."""
    h, r = 10.0, 60.0
    tier1 = spark.createDataFrame([(p, x + 12 * p, y) for p in (0, 1) for x in range(12) for y in range(12)], "problem long, ix long, iy long")
    tier2 = consolidate.tiers(tier1, 120.0, h, ["problem"])
    tests = spark.createDataFrame([(i * 12 + j, 5.0 + 10 * i, 5.0 + 10 * j, r) for i in range(24) for j in range(12)], "test long, x double, y double, required_radius double")
    s = spark.createDataFrame([(i * 5 + j, 15.0 + 25 * i, 12.0 + 25 * j, False) for i in range(9) for j in range(5)], "seq long, x double, y double, is_centreline boolean")
    out = consolidate.consolidate(s, tests, tier1, tier2, r, h)
    final = consolidate.passed(s, out)
    assert final.count() < s.count() and djoin.unsatisfied(tests, final.select("x", "y"), ["test"], r).count() == 0
    assert consolidate.still_open(tests, tier1, final, out["candidates"], r, h).count() == 0


def test_a_radius_beyond_its_bound_fails(spark):
    left = spark.createDataFrame([(0.0, 0.0, 500.0)], "x double, y double, required double")
    right = spark.createDataFrame([(450.0, 0.0, 500.0)], "x double, y double, own double")
    for how in ("inner", "left", "semi", "anti", "exists"):
        with pytest.raises(Exception, match="beyond max_radius"):
            djoin.distance_join(left, right, "required", 100.0, how).collect()
    assert djoin.distance_join(left, right, "required", 500.0, "exists").first().is_match
    for radius in (F.col("required"), F.col("r_own"), F.least("required", "r_own")):
        assert djoin.distance_join(left, right, radius, 500.0, "exists").first().is_match
        assert not djoin.distance_join(left, right, radius - 100, 500.0, "exists").first().is_match
    with pytest.raises(Exception, match="beyond max_radius"):
        djoin.distance_join(left, right.withColumn("x", F.lit(50.0)), F.col("r_own"), 100.0).collect()


def test_cells_that_do_not_pack_fail(spark):
    for g, x, y in ((1 << 21, 0, 0), (0, 1 << 20, 0), (0, 0, -(1 << 20) - 1), (-1, 0, 0)):
        with pytest.raises(Exception, match="too large to pack"):
            spark.createDataFrame([(g, x, y)], "g long, ix long, iy long").select(region.cell_id("g")).collect()
