"""Generators of points: lattices, hexagons, samples along lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sqrt(3) / 2 as a literal, so that other engines can compute the same coordinates.
ROW = 0.8660254037844386


def box_lattice(regions: DataFrame, spacing: str | Column, buffer: str | Column | float = 0.0, grid: str = "hexagonal") -> DataFrame:
    """The lattice points strictly inside each region's (buffered) box.

    regions: x0, y0, x1, y1 and any other columns, which stay. Adds row, k (place in the row), x, y.
    Hexagonal rows are spacing * sqrt(3) / 2 apart, odd ones shifted by half a spacing; both loops run
    from the box's lower corner. The points of one region come from two nested sequences, so a large
    region makes rows, not a collection.
    """
    s = F.col(spacing) if isinstance(spacing, str) else spacing
    b = F.lit(float(buffer)) if isinstance(buffer, (int, float)) else (F.col(buffer) if isinstance(buffer, str) else buffer)
    df = regions.withColumns({"_s": s.cast("double"), "_x0": F.col("x0") - b, "_y0": F.col("y0") - b, "_x1": F.col("x1") + b, "_y1": F.col("y1") + b})
    dy = F.col("_s") * ROW if grid == "hexagonal" else F.col("_s")
    df = df.withColumn("_dy", dy)
    df = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_y1") - F.col("_y0")) / F.col("_dy")).cast("int"))))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("_x1") - F.col("_x0")) / F.col("_s")).cast("int"))))
    shift = F.when(F.col("row") % 2 == 1, F.col("_s") / 2).otherwise(F.lit(0.0)) if grid == "hexagonal" else F.lit(0.0)
    df = df.withColumns({"x": F.col("_x0") + shift + F.col("k") * F.col("_s"), "y": F.col("_y0") + F.col("row") * F.col("_dy")})
    return df.where("x > _x0 AND x < _x1 AND y > _y0 AND y < _y1").drop("_s", "_dy", "_x0", "_y0", "_x1", "_y1")


def cell_lattice(cells: DataFrame, h: float, spacing: str | Column, keys: list[str], buffer_cells: DataFrame | None = None, grid: str = "hexagonal") -> DataFrame:
    """Lattice points inside regions given as cells (ix, iy), each region from its own bounds (H1, H2).

    buffer_cells: the dilated region's cells, where candidates may lie outside the region itself.
    """
    inside = buffer_cells if buffer_cells is not None else cells
    box = inside.groupBy(*keys).agg((F.min("ix") * h).cast("double").alias("x0"), (F.min("iy") * h).cast("double").alias("y0"), ((F.max("ix") + 1) * h).cast("double").alias("x1"), ((F.max("iy") + 1) * h).cast("double").alias("y1"), *([F.first(spacing).alias(spacing)] if isinstance(spacing, str) else []))
    points = box_lattice(box, spacing, grid=grid).withColumns({"ix": F.floor(F.col("x") / h), "iy": F.floor(F.col("y") / h)})
    return points.join(inside.select(*keys, "ix", "iy").distinct(), [*keys, "ix", "iy"], "left_semi").select(*keys, "row", "k", "x", "y")


def hexagons(centres: DataFrame, spacing: str | Column) -> DataFrame:
    """The corners of a hexagon around each point, outer radius spacing / sqrt(3), from 30 degrees in steps of 60 (H5)."""
    s = F.col(spacing) if isinstance(spacing, str) else spacing
    r = s / F.sqrt(F.lit(3.0))
    angle = lambda i: F.radians(F.lit(30.0) + F.lit(60.0) * i)
    return centres.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((F.col("x") + r * F.cos(angle(i))).alias("x"), (F.col("y") + r * F.sin(angle(i))).alias("y"))))


def grid_tiles(cells: DataFrame, keys: list[str], size: int, least_cells: int = 1) -> DataFrame:
    """Square tiles of size cells a side, those of too few cells left out (H6)."""
    tile = [F.floor(F.col("ix") / size).alias("tx"), F.floor(F.col("iy") / size).alias("ty")]
    return cells.groupBy(*keys, *tile).agg(F.count("*").alias("cells")).where(F.col("cells") >= least_cells)


def line_samples(lines: DataFrame, interval: str | Column, keys: list[str], shortest: float = 1.0) -> DataFrame:
    """max(1, ceil(length / interval)) + 1 points along each line, both ends included (H9).

    lines: keys, points array<struct<x, y>> in order. Lines shorter than `shortest` give none. The
    cumulative length of each segment is a window sum; samples meet their segment in a range condition
    inside the line's key.
    """
    from pyspark.sql import Window

    iv = F.col(interval) if isinstance(interval, str) else interval
    seg = lines.select(*keys, iv.cast("double").alias("_iv"), F.posexplode(F.expr("transform(sequence(1, size(points) - 1), i -> struct(element_at(points, i) AS a, element_at(points, i + 1) AS b))")).alias("seg", "ab"))
    seg = seg.select(*keys, "_iv", "seg", F.col("ab.a.x").alias("ax"), F.col("ab.a.y").alias("ay"), F.col("ab.b.x").alias("bx"), F.col("ab.b.y").alias("by"))
    seg = seg.withColumn("len", F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))))
    order = Window.partitionBy(*keys).orderBy("seg")
    seg = seg.withColumns({"to": F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("len").over(Window.partitionBy(*keys)), "last": F.max("seg").over(Window.partitionBy(*keys))})
    seg = seg.where(F.col("total") >= shortest).withColumn("from", F.col("to") - F.col("len")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("_iv"))).cast("int"))
    step = F.col("total") / F.col("n")
    first = F.ceil(F.col("from") / step).cast("int")
    stop = F.when(F.col("seg") == F.col("last"), F.col("n")).otherwise(F.ceil(F.col("to") / step).cast("int") - 1)
    out = seg.where("len > 0").withColumns({"_first": F.least(first, F.col("n")), "_stop": F.least(stop, F.col("n"))}).where("_first <= _stop").withColumn("k", F.explode(F.sequence("_first", "_stop")))
    t = F.least(F.greatest((F.col("k") * step - F.col("from")) / F.col("len"), F.lit(0.0)), F.lit(1.0))
    return out.select(*keys, "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
