"""Shapefiles written byte by byte, and what is read of them."""

import struct

import pytest

from lacuna.operators import region
from lacuna.sources import shapefile


def write(base, shapes, columns, rows, kind=5):
    """shapes: lists of rings, a point, or None; columns: name, type, length, digits."""
    records = []
    for s in shapes:
        if s is None:
            records.append(struct.pack("<i", 0))
        elif kind == 1:
            records.append(struct.pack("<i2d", 1, *s))
        else:
            flat = [p for ring in s for p in ring]
            x, y = zip(*flat, strict=True)
            starts = [sum(map(len, s[:k])) for k in range(len(s))]
            records.append(struct.pack(f"<i4d2i{len(s)}i{2 * len(flat)}d", kind, min(x), min(y), max(x), max(y), len(s), len(flat), *starts, *[c for p in flat for c in p]))
    shp, shx, at = b"", b"", 50
    for k, r in enumerate(records):
        shx += struct.pack(">2i", at, len(r) // 2)
        shp += struct.pack(">2i", k + 1, len(r) // 2) + r
        at += 4 + len(r) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    base.with_suffix(".shp").write_bytes(head(len(shp)) + shp)
    base.with_suffix(".shx").write_bytes(head(len(shx)) + shx)
    if columns:
        names = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([size, digits]) + b"\0" * 14 for n, t, size, digits in columns)
        body = b"".join(b" " + b"".join(str(v).encode().ljust(c[2])[: c[2]] for v, c in zip(r, columns, strict=True)) for r in rows)
        base.with_suffix(".dbf").write_bytes(struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + len(names), 1 + sum(c[2] for c in columns)) + names + b"\r" + body + b"\x1a")
    return str(base.with_suffix(".shp"))


COLUMNS = [("NAME", "C", 12, 0), ("SPACING", "N", 8, 2), ("ORDER", "N", 6, 0), ("ON", "L", 1, 0), ("ID", "C", 4, 0)]


def square(x, y, w):
    return [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]


@pytest.fixture
def squares(tmp_path):
    shapes = [[square(100.0 * i, 100.0 * j, 60.0)] for i in range(20) for j in range(20)]
    shapes[7] = None
    shapes[8].append(square(10.0, 810.0, 20.0)[::-1])  # a hole
    rows = [(f"z {k}" if k % 5 else "", 50 + k / 4, k, "T" if k % 2 else "F", f"i{k}") for k in range(400)]
    return write(tmp_path / "zones", shapes, COLUMNS, rows)


def test_round_trip(spark, squares):
    df = shapefile.read(spark, squares, 64)
    assert df.columns == ["id", "x0", "y0", "x1", "y1", "rings", "NAME", "SPACING", "ORDER", "ON", "ID_"] and df.rdd.getNumPartitions() == 7
    got = {r.id: r for r in df.collect()}
    assert len(got) == 400 and got[7].x0 is None and got[7].rings == [] and len(got[8].rings) == 2
    r = got[43]
    assert (r.x0, r.y0, r.x1, r.y1) == (200.0, 300.0, 260.0, 360.0) and [tuple(p) for p in r.rings[0]] == square(200.0, 300.0, 60.0)
    assert (r.NAME, r.SPACING, r.ORDER, r.ON, r.ID_) == ("z 43", 60.75, 43, True, "i43") and got[5].NAME is None and got[6].ON is False


def test_boxes_reach_the_file(spark, squares):
    df = shapefile.read(spark, squares, 64)
    want = sorted(r.id for r in df.where("x1 IS NOT NULL").collect() if r.x0 <= 500 and r.x1 >= 250 and r.y0 < 310 and r.y1 > 100)
    some = df.where("x0 <= 500 AND x1 >= 250 AND y0 < 310 AND y1 > 100")
    assert sorted(r.id for r in some.collect()) == want and len(want) == 4 * 3
    reader = shapefile.Reader(squares, {"recordsperpartition": "64"})
    filters = [shapefile.LessThanOrEqual(("x0",), 500), shapefile.GreaterThanOrEqual(("x1",), 250.0), shapefile.EqualTo(("NAME",), "z 1")]
    assert list(reader.pushFilters(filters)) == filters[2:]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert reader.decoded == len(rows) == 4 * 20 and len(reader.partitions()) == 7


def test_layers_as_zones(spark, squares):
    z = shapefile.zone_layer(shapefile.read(spark, squares), "NAME").cache()
    by = {r.zone: r for r in z.collect()}
    assert len(by) == 399 and by[1].zone_name == "z 1" and by[5].zone_name == "zone_6" and len(by[1].ring[0]) == 4
    cells = region.ring_cells(z.where("zone IN (8, 9)"), 4.0, ["zone"]).groupBy("zone").count().collect()
    assert {r.zone: r["count"] * 16.0 for r in cells} == {8: 3600.0 - 400.0, 9: 3600.0}


def test_points_lines_and_empty_files(spark, tmp_path):
    p = shapefile.read(spark, write(tmp_path / "p", [(1.0, 2.0), None, (3.0, 4.0)], [], [], kind=1)).orderBy("id").collect()
    assert [(r.x0, r.y1, [[tuple(q) for q in ring] for ring in r.rings]) for r in p] == [(1.0, 2.0, [[(1.0, 2.0)]]), (None, None, []), (3.0, 4.0, [[(3.0, 4.0)]])]
    lines = shapefile.read(spark, write(tmp_path / "l", [[[(0.0, 0.0), (5.0, 1.0)], [(9.0, 9.0), (8.0, 8.0), (7.0, 9.0)]]], [], [], kind=3)).first()
    assert [len(r) for r in lines.rings] == [2, 3] and (lines.x1, lines.y1) == (9.0, 9.0)
    assert shapefile.read(spark, write(tmp_path / "e", [], COLUMNS, [])).collect() == []
    with pytest.raises(Exception, match="kind 31"):
        shapefile.read(spark, write(tmp_path / "m", [[[(0.0, 0.0), (5.0, 1.0)]]], [], [], kind=31)).collect()
