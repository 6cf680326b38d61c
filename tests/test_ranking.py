"""Numbers along an order, and sources and sinks that no query reaches, on small fixtures."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lacuna.operators import ranking, region
from lacuna.sources import geojson, points, sinks


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbers_equal_one_sort(spark, groups):
    """A third of the rows in one group, null groups, ties told apart by the last key, descending order."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b"]) if i % 3 else "hot", rng.choice([None, 1.0, 2.0, -5.0])) for i in range(600)]
    got = ranking.numbered(spark.createDataFrame(rows, "id long, g string, v double").repartition(7), [F.desc_nulls_last("v"), "id"], "n", groups)
    assert got.columns == ["id", "g", "v", "n"]
    want, seen = {}, {}
    for i, g, v in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0])):
        k = g if groups else 0
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert {r.id: r.n for r in got.collect()} == want


def test_a_hot_group_spans_several_ranges(spark):
    df = spark.range(200_000).selectExpr("id", "'one' AS g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.numbered(df, ["id"], "n", ["g"])
        assert got.where("n <> id + 1").count() == 0 and got.count() == 200_000
        ranges = df.repartitionByRange("g", "id").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert len(ranges) > 1 and max(r["count"] for r in ranges) < 150_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows_one_row_and_repeated_rows(spark):
    df = spark.createDataFrame([(1,)], "id long")
    assert ranking.numbered(df.limit(0), ["id"], "n").collect() == []
    assert [tuple(r) for r in ranking.numbered(df, ["id"], "n").collect()] == [(1, 1)]
    assert sorted(r.n for r in ranking.numbered(df.unionByName(df).unionByName(df), ["id"], "n").collect()) == [1, 2, 3]


def test_start_centres_are_those_of_one_sort(spark):
    """Spread along the rows of a region with a hole: each part holds as many cells as the others, but for one."""
    cells = spark.createDataFrame([(z, x, y) for z in (1, 2) for x in range(12) for y in range(9) if (x, y) != (4, 4)], "zone long, ix long, iy long")
    counts = spark.createDataFrame([(1, 3), (2, 1)], "zone long, k long")
    got = {(r.zone, r.cell): (r.x, r.y) for r in region.centres_of(cells, "zone", counts, 0).collect()}
    order = sorted((y, x) for x in range(12) for y in range(9) if (x, y) != (4, 4))
    for z, k in ((1, 3), (2, 1)):
        for c in range(k):
            part = [p for i, p in enumerate(order) if i * k // len(order) == c]
            assert got[z, c] == pytest.approx((sum(x for _, x in part) / len(part) + 0.5, sum(y for y, _ in part) / len(part) + 0.5))
    assert len(got) == 4


def test_layers_in_order_and_missing_ones(spark, tmp_path):
    def layer(name, x):
        square = [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Name": name}, "geometry": {"type": "Polygon", "coordinates": square}}]}))
        return str(tmp_path / name)

    found, failed = geojson.read_layers(spark, [("low", layer("a.json", 0.0)), ("gone", str(tmp_path / "none.json")), ("high", layer("b.json", 5.0))])
    assert failed == ["gone"]
    assert {(r.source_layer, r.properties["Name"], r.ring[0][0].x, len(r.ring[0])) for r in found.collect()} == {("low", "a.json", 0.0, 4), ("high", "b.json", 5.0, 4)}
    nothing, failed = geojson.read_layers(spark, [("gone", str(tmp_path / "none.json"))])
    assert nothing.count() == 0 and failed == ["gone"] and nothing.columns[-1] == "source_layer"


def test_newest_saved_positions(spark, tmp_path):
    assert points.saved_positions(spark, str(tmp_path / "none")) is None and points.saved_positions(spark, str(tmp_path)) is None
    (tmp_path / "old.csv").write_text("ID,Easting,Northing\nA,1,2\n")
    time.sleep(1.1)
    (tmp_path / "new.csv").write_text("ID, Easting ,Northing\nB,3.5,4\nC,5,\n")
    time.sleep(1.1)
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in points.saved_positions(spark, str(tmp_path)).collect()] == [("B", 3.5, 4.0), ("C", 5.0, None)]


def test_cells_as_features(spark):
    rows = sinks.cell_features(spark.createDataFrame([(2, -1, "z")], "ix long, iy long, zone string"), 10.0, ["zone"]).collect()
    f = json.loads(rows[0].value)
    assert f["properties"] == {"zone": "z"} and f["geometry"] == {"type": "Polygon", "coordinates": [[[20.0, -10.0], [30.0, -10.0], [30.0, 0.0], [20.0, 0.0], [20.0, -10.0]]]}
