"""Shapefiles as a Spark data source: records by ranges of the index file, boxes pushed down.

    read(spark, "zones.shp").where("x0 <= 500 AND x1 >= 100 AND y0 <= 900 AND y1 >= 300")

A row is a record: id (from 0), its box x0, y0, x1, y1, its rings (parts of lines, or one part with the point), and
the columns of the .dbf file. A task reads one range of the .shx file and seeks the records in the .shp
file; of records whose box fails the pushed conditions it reads the first 44 bytes only, and no attributes.

Null shapes: a null box and no rings, so conditions on the box drop them. Deleted .dbf records keep their
row. Without a .dbf file there are no more columns; names that clash with the first six get a trailing _.
The three files have to lie where every executor can open them, as they are read at offsets. Points (1), lines (3) and
polygons (5), also those with heights or measures, which are left out; other shapes fail.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

FIRST = "id long, x0 double, y0 double, x1 double, y1 double, rings array<array<struct<x: double, y: double>>>"
BOX = ["x0", "y0", "x1", "y1"]
OPERATORS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
#: Fixed values of the format: kinds of shapes without and with heights and measures, and the bytes of its headers.
POINTS, LINES, HEADER, INDEX = (1, 11, 21), (3, 5, 13, 15, 23, 25), 100, 8


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def fields(path: str) -> tuple[int, int, list[tuple[str, str, int]]]:
    """Of a .dbf file: where records begin, their length, and each field's name, Spark type and length."""
    with open(path, "rb") as f:
        head = f.read(32)
        begin, size = struct.unpack_from("<HH", head, 8)
        out, taken = [], {c.split()[0] for c in FIRST.split(", ")}
        while (d := f.read(32)) and d[0] != 0x0D:
            name, kind, length, digits = d[:11].split(b"\0")[0].decode("latin-1").strip(), chr(d[11]), d[16], d[17]
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append((name, "double" if kind in "NF" and digits or kind == "F" else "long" if kind == "N" else "boolean" if kind == "L" else "string", length))
    return begin, size, out


def _value(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding).strip("\0 ")
    if not text or set(text) <= {"*", "?"}:
        return None
    return text if kind == "string" else text in "YyTt" if kind == "boolean" else float(text) if kind == "double" else int(float(text))


class Reader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.base = path[:-4]
        self.per = int(options.get("recordsperpartition", 10_000))
        self.encoding = options.get("encoding", "utf-8")
        self.tests: list[tuple[int, str, float]] = []
        self.decoded = 0  # records of which more than the box was read

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in OPERATORS and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.tests.append((BOX.index(f.attribute[0]), OPERATORS[type(f)], float(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        n = (os.path.getsize(self.base + ".shx") - HEADER) // INDEX
        return [Range(a, min(a + self.per, n)) for a in range(0, n, self.per)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        with open(self.base + ".shx", "rb") as f:
            f.seek(HEADER + INDEX * part.first)
            index = struct.unpack(f">{2 * (part.last - part.first)}i", f.read(INDEX * (part.last - part.first)))
        begin, size, named = fields(self.base + ".dbf") if os.path.exists(self.base + ".dbf") else (0, 0, [])
        table = open(self.base + ".dbf", "rb") if named else None
        try:
            with open(self.base + ".shp", "rb") as f:
                for k in range(part.first, part.last):
                    at, long = index[2 * (k - part.first)] * 2 + 8, index[2 * (k - part.first) + 1] * 2
                    f.seek(at)
                    head = f.read(min(36, long))
                    (kind,) = struct.unpack_from("<i", head)
                    box = struct.unpack_from("<4d", head, 4) if kind in LINES else struct.unpack_from("<2d", head, 4) * 2 if kind in POINTS else (None,) * 4
                    if not all(box[i] is not None and getattr(box[i], test)(v) for i, test, v in self.tests):
                        continue
                    self.decoded += 1
                    values = []
                    if table:
                        table.seek(begin + size * k + 1)
                        row = table.read(size - 1)
                        for _, t, n in named:
                            values.append(_value(row[:n], t, self.encoding))
                            row = row[n:]
                    yield (k, *box, self._rings(kind, head + f.read(long - len(head))), *values)
        finally:
            if table:
                table.close()

    @staticmethod
    def _rings(kind: int, body: bytes) -> list[list[tuple[float, float]]]:
        if kind in POINTS:
            return [[struct.unpack_from("<2d", body, 4)]]
        if kind not in LINES:
            if kind:
                raise ValueError(f"shapes of kind {kind} are not read")
            return []
        parts, points = struct.unpack_from("<2i", body, 36)
        edges = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        at = list(zip(flat[::2], flat[1::2], strict=True))
        return [at[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lacuna_shapefile"

    def _path(self) -> str:
        path = self.options["path"].removeprefix("file://")
        if not path.lower().endswith(".shp"):
            raise ValueError("a .shp file is needed")
        return path

    def schema(self) -> str:
        table = self._path()[:-4] + ".dbf"
        more = fields(table)[2] if os.path.exists(table) else []
        return ", ".join([FIRST, *(f"`{n}` {t}" for n, t, _ in more)])

    def reader(self, schema) -> DataSourceReader:
        return Reader(self._path(), {k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, records_per_partition: int = 10_000, encoding: str = "utf-8") -> DataFrame:
    """The records of a shapefile; conditions on x0, y0, x1 and y1 with numbers reach the file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)
    return spark.read.format("lacuna_shapefile").option("recordsPerPartition", records_per_partition).option("encoding", encoding).load(path)


def zone_layer(layer: DataFrame, name_column: str | None = None, prefix: str = "zone") -> DataFrame:
    """Polygons of a layer as zones: zone, zone_name (of the column, or the prefix and the number from 1), rings without closing corners, and the box."""
    closed = "transform(rings, r -> CASE WHEN size(r) > 1 AND r[0] = element_at(r, -1) THEN slice(r, 1, size(r) - 1) ELSE r END)"
    name = f"coalesce(CAST(`{name_column}` AS STRING), concat('{prefix}_', id + 1))" if name_column else f"concat('{prefix}_', id + 1)"
    return layer.where("size(rings) > 0").selectExpr("id AS zone", f"{name} AS zone_name", f"{closed} AS ring", "x0", "y0", "x1", "y1")
