"""Polygons, text shapes and the national grid on small fixtures."""

from math import hypot, radians

from pyspark.sql import functions as F

from lacuna.functions import geometry, scalar
from lacuna.operators import places

RING = "array<array<struct<x:double,y:double>>>"
SQUARE = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]


def polygons(spark):
    return spark.createDataFrame([(1, SQUARE), (2, [[(30.0, 0.0), (40.0, 0.0), (35.0, 10.0)]]), (3, [])], f"zone long, ring {RING}")


def test_grid_of_the_published_example(spark):
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    df = spark.createDataFrame([(radians(lat), radians(lon))], "la double, lo double")
    r = geometry.project(df, "la", "lo").first()
    assert abs(r.x - 651409.903) < 0.002 and abs(r.y - 313177.270) < 0.002
    assert geometry.project(df, "la", "lo").columns == ["la", "lo", "x", "y"]


def test_degrees_round_trip_to_centimetres(spark):
    df = spark.createDataFrame([(530000.0, 180000.0), (250000.0, 660000.0), (400000.0, 100000.0), (None, 1.0)], "x double, y double")
    rows = geometry.to_grid(geometry.to_degrees(df, "x", "y"), "lon", "lat", "bx", "by").collect()
    assert [hypot(r.bx - r.x, r.by - r.y) < 0.05 for r in rows if r.x] == [True] * 3
    london = rows[0]
    assert -0.2 < london.lon < 0.0 and 51.4 < london.lat < 51.6 and rows[3].lon is None and rows[3].bx is None


def test_wkt_round_trip(spark):
    df = polygons(spark).withColumn("t", geometry.wkt()).withColumn("back", geometry.rings("t")).orderBy("zone")
    rows = df.collect()
    assert rows[0].t == "POLYGON ((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0), (4.0 4.0, 6.0 4.0, 6.0 6.0, 4.0 6.0, 4.0 4.0))"
    assert all(r.back == r.ring for r in rows) and rows[2].t == "POLYGON EMPTY"
    odd = spark.createDataFrame([("POINT (1 2)",), (None,), ("",)], "t string").select(geometry.rings("t").alias("r"), geometry.rounded_wkt("t", 2).alias("s")).collect()
    assert [r.r for r in odd] == [None] * 3 and [r.s for r in odd] == ["POINT (1.00 2.00)", None, ""]
    assert spark.range(1).select(geometry.rounded_wkt(F.lit("POLYGON((-0.1234567 1e3, 2.5E-1 7))"))).first()[0] == "POLYGON((-0.123457 1000.000000, 0.250000 7.000000))"


def test_holes_boundaries_and_near_misses(spark):
    pts = spark.createDataFrame([(1, 2.0, 5.0), (2, 5.0, 5.0), (3, 0.0, 5.0), (4, 15.0, 5.0), (5, 35.0, 5.0), (6, 500.0, 5.0), (7, None, 5.0)], "id long, x double, y double")
    rows = {(r.id, r.zone): r for r in places.tier_report(pts, polygons(spark), ["zone"], 100.0).collect()}
    assert rows[1, 1].distance_to_boundary == 2.0 and rows[1, 1].status is None
    assert rows[2, 1].distance_outside == 1.0 and rows[2, 1].status == "near_but_outside"
    assert rows[3, 1].distance_outside == 0.0
    assert rows[4, 1].distance_outside == 5.0 and (4, 2) not in rows and (6, 2) not in rows
    near = {r.id: (r.region, r.distance and round(r.distance, 6)) for r in places.nearest_region(pts, polygons(spark), ["id"], "zone", 3.0).collect()}
    assert near[1] == (1, 0.0) and near[2] == (1, 1.0) and near[3] == (1, 0.0) and near[4] == (1, 5.0) and near[5] == (2, 0.0)
    assert near[6][0] == 2 and near[7] == (None, None)
    none = places.nearest_region(pts, polygons(spark).where("zone = 9"), ["id"], "zone", 3.0).collect()
    assert len(none) == 7 and all(r.region is None for r in none)
    info = {r.id: r.zones for r in places.zone_info(pts, polygons(spark).withColumn("spacing", F.lit(100.0)), ["id"], 50.0, [2]).collect()}
    assert info[1] == {1: 100.0} and info[3] is None and info[5] is None


def test_known_pairs(spark):
    known = ["Zone_1", "Zone", "1_Zone_2", "Zone_2"]
    keys = ["a||b", "Zone_1_Zone_2", "x_y_z"]
    df = spark.createDataFrame([(k, known) for k in keys], "k string, z array<string>").select(scalar.known_pair("k", "z").alias("p"))
    assert [r.p for r in df.collect()] == [["a", "b"], ["Zone", "1_Zone_2"], ["x", "y", "z"]]
