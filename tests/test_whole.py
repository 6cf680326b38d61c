"""The queries and operators do the whole job: no row, zone, word or copy is left out."""

import numpy as np
import pytest

from lacuna.operators import consolidate, djoin, region
from lacuna.plans import inputs as src
from lacuna import queries as q


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture
def two_zones(spark, tmp_path):
    """Zones 1 and 2, side by side, of 300 m spacing, and some sites along their border."""
    table(spark, tmp_path, "nation", [(1, "a", 4), (2, "b", 4)], "n_nationkey int, n_name string, n_regionkey int")
    table(spark, tmp_path, "supplier", [(k,) for k in range(1, 400)], "s_suppkey long")
    return str(tmp_path)


def test_consolidation_covers_the_border_of_any_two_zones(spark, two_zones):
    out = q.QUERIES["consolidation"](spark, two_zones).cache()
    removed, added = out.where("kind = 'removed'").select("x", "y"), out.where("kind = 'added'").select("x", "y")
    assert removed.count() > 0
    sites = src.sites(spark, two_zones).select("x", "y")
    final = sites.join(removed, ["x", "y"], "left_anti").unionByName(added)
    clouds = consolidate.clouds(src.tests(spark, two_zones, 0.2), q.H, q.MAX_R)
    both = clouds.groupBy("ix", "iy").count().where("count > 1")
    tests = region.contains(src.tests(spark, two_zones, 0.2), both, q.H, [])
    assert tests.count() > 0 and djoin.unsatisfied(tests, final, q.TEST_KEYS, q.MAX_R).count() == 0


def test_conflict_pairs_are_all_there(spark, tmp_path):
    table(spark, tmp_path, "supplier", [(k,) for k in range(1, 1001)], "s_suppkey long")
    at = [(k, k * 15485863 % 10007, k * 32452843 % 10009) for k in range(1, 1001)]
    want = [(a, b) for a, x, y in at for b, u, v in at if a < b and (x - u) ** 2 + (y - v) ** 2 <= 1500**2]
    got = sorted((r.a, r.b) for r in q.QUERIES["conflict_pairs"](spark, str(tmp_path)).select("a", "b").collect())
    assert len(want) > 2000 and got == want
    # the cap is an option: the first by (a, b)
    some = djoin.conflict_pairs(src.sites(spark, str(tmp_path)), 1500.0, most=10).collect()
    assert [(r.a, r.b) for r in some] == want[:10]


HOLE = 1024.0


@pytest.fixture(scope="module")
def small_gap(spark, tmp_path_factory):
    """Zone 0 of 100 m spacing, full of points but for 170 m around a corner of four cells of 128 m."""
    folder = tmp_path_factory.mktemp("gap")
    at = [(k, k * 7919 % 10007, k * 104729 % 10009) for k in range(1, 100_000)]
    at = [(k, x, y) for k, x, y in at if x < 2100 and y < 2100 and (x - HOLE) ** 2 + (y - HOLE) ** 2 > 170**2]
    table(spark, folder, "nation", [(0, "a", 0)], "n_nationkey int, n_name string, n_regionkey int")
    table(spark, folder, "customer", [(k, 100.0, "A") for k, _, _ in at], "c_custkey long, c_acctbal double, c_mktsegment string")
    table(spark, folder, "orders", [(at[0][0], "1-URGENT")], "o_custkey long, o_orderpriority string")
    table(spark, folder, "supplier", [(1,)], "s_suppkey long")
    return str(folder), np.array([(x, y) for _, x, y in at], float)


def brute_gaps(p, h=8.0):
    """Cells of zone 0 without a point within 100 m, in 4-connected pieces."""
    c = [(i, j) for i in range(int(2000 // h)) for j in range(int(2000 // h))]
    open_ = {(i, j) for i, j in c if ((p - (np.array([i, j]) + 0.5) * h) ** 2).sum(1).min() > 100.0**2}
    cells, out = len(c), []
    while open_:
        piece, todo = [], [open_.pop()]
        while todo:
            i, j = todo.pop()
            piece.append((i, j))
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in open_:
                    open_.remove(n)
                    todo.append(n)
        out.append((len(piece) * h * h, *np.round((np.mean(piece, axis=0) + 0.5) * h, 4).tolist()))
    return cells * h * h, sorted(out)


def test_narrow_gaps_are_found(spark, small_gap):
    folder, p = small_gap
    total, want = brute_gaps(p)
    assert want
    cols = ("area_m2", "centroid_x", "centroid_y")
    got = sorted(tuple(r[c] for c in cols) for r in q.QUERIES["gap_pieces"](spark, folder).collect())
    assert np.allclose(got, want, atol=1e-3)
    big = [w for w in want if w[0] >= 100]
    got = sorted(tuple(r[c] for c in cols) for r in q.QUERIES["gap_statistics"](spark, folder).collect())
    assert np.allclose(got, big, atol=1e-3)
    s = q.QUERIES["coverage_summary"](spark, folder).first()
    assert (s.total_m2, s.uncovered_m2, s.gap_count, s.largest_gap_m2) == (total, sum(w[0] for w in want), len(big), big[-1][0])
    assert q.QUERIES["greedy_disk_cover"](spark, folder).count() == 1


def test_holes_between_thinned_tests_get_a_site(spark, tmp_path):
    """Zone 0 of 100 m spacing; the hole lies between three tests of a lattice of half the spacing."""
    hole = (1025.0, 967.0)
    at = [(k, k * 7919 % 10007, k * 104729 % 10009) for k in range(1, 400_000)]
    at = [(k, x, y) for k, x, y in at if x < 2100 and y < 2100 and (x - hole[0]) ** 2 + (y - hole[1]) ** 2 > 115**2]
    table(spark, tmp_path, "nation", [(0, "a", 0)], "n_nationkey int, n_name string, n_regionkey int")
    table(spark, tmp_path, "customer", [(k, 100.0, "A") for k, _, _ in at], "c_custkey long, c_acctbal double, c_mktsegment string")
    table(spark, tmp_path, "orders", [(at[0][0], "1-URGENT")], "o_custkey long, o_orderpriority string")
    d, p = str(tmp_path), np.array([(x, y) for _, x, y in at], float)
    lattice = np.array([(r.x, r.y) for r in src.tests(spark, d, 0.2).select("x", "y").collect()])
    missed = [t for t in lattice if ((p - t) ** 2).sum(1).min() > 100.0**2]
    assert q._open_tests(spark, d, 0.5).count() == 0 < len(missed)
    placed = q.QUERIES["placement"](spark, d).where("cand IS NOT NULL").collect()
    assert placed and all(min((s.x - x) ** 2 + (s.y - y) ** 2 for s in placed) <= 100.0**2 for x, y in missed)
    assert [tuple(r) for r in q.QUERIES["placement_gaps"](spark, d).collect()] == [(0, len(missed), 0)]
    cube = {r.combo_key: (r.tests, r.covered) for r in q.QUERIES["filter_cube"](spark, d).collect()}
    assert cube["d0_spt0_txt0_txe0"] == (len(lattice), len(lattice) - len(missed))
