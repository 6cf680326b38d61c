"""Regions as relations of lattice cells: overlay by joins, area by counting.

A region is rows (keys, ix, iy) at a resolution of h metres; cell (ix, iy) covers
[ix * h, (ix + 1) * h) likewise in y, and its centre stands for it. Areas err by at most
h * sqrt(2) * perimeter.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import connected_components, cut

SPAN = 21  # bits of a cell number in a packed cell id


def resolution(radius: float, cells_per_radius: float = 10.0) -> float:
    """The largest power of two of at most radius / cells_per_radius."""
    return 2.0 ** floor(log2(radius / cells_per_radius))


def box_cells(boxes: DataFrame, h: float | str, keys: list[str]) -> DataFrame:
    """Cells whose centre is in [x0, x1) x [y0, y1)."""
    w = F.lit(float(h)) if isinstance(h, (int, float)) else F.col(h)
    first = lambda c: F.ceil(F.col(c) / w - 0.5)
    df = boxes.withColumn("ix", F.explode(F.sequence(first("x0"), first("x1") - 1))).withColumn("iy", F.explode(F.sequence(first("y0"), first("y1") - 1)))
    return df.select(*keys, "ix", "iy")


def ring_cells(regions: DataFrame, h: float, keys: list[str]) -> DataFrame:
    """Cells whose centre is inside polygons with holes: rings array<array<struct<x, y>>>, even-odd rule.

    Scan lines: every edge makes a crossing with each row of cell centres that it spans; the sorted
    crossings of a row pair up to intervals, and those to cells.
    """
    edge = regions.select(*keys, F.explode("ring").alias("r")).select(*keys, F.explode(F.expr("transform(sequence(1, size(r)), i -> struct(element_at(r, i) AS a, element_at(r, CASE WHEN i = size(r) THEN 1 ELSE i + 1 END) AS b))")).alias("e"))
    edge = edge.select(*keys, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ay <> by")
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    edge = edge.withColumns({"_f": F.ceil(lo / h - 0.5), "_l": F.ceil(hi / h - 0.5) - 1}).where("_f <= _l")
    cross = edge.withColumn("iy", F.explode(F.sequence("_f", "_l"))).withColumn("cy", (F.col("iy") + 0.5) * h)
    cross = cross.withColumn("cx", F.col("ax") + (F.col("cy") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    order = Window.partitionBy(*keys, "iy").orderBy("cx")
    span = cross.withColumns({"n": F.row_number().over(order), "to": F.lead("cx").over(order)}).where("n % 2 = 1 AND to IS NOT NULL")
    span = span.withColumns({"_a": F.ceil(F.col("cx") / h - 0.5), "_b": F.ceil(F.col("to") / h - 0.5) - 1}).where("_a <= _b")
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("ix"), "iy")


def ring_area(ring: str = "ring") -> Column:
    """The exact area of polygons with holes by the shoelace rule: the first ring less the others."""
    shoelace = lambda r: F.abs(F.aggregate(F.sequence(F.lit(1), F.size(r)), F.lit(0.0), lambda s, i: s + F.element_at(r, i)["x"] * F.element_at(r, i % F.size(r) + 1)["y"] - F.element_at(r, i % F.size(r) + 1)["x"] * F.element_at(r, i)["y"])) / 2
    parts = F.transform(F.col(ring), shoelace)
    return F.when(F.size(ring) > 0, 2 * F.element_at(parts, 1) - F.aggregate(parts, F.lit(0.0), lambda s, a: s + a)).otherwise(F.lit(0.0))


def union(*regions: DataFrame) -> DataFrame:
    out = regions[0]
    for r in regions[1:]:
        out = out.unionByName(r)
    return out.distinct()


def intersection(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return a.join(b.select(*(on or []), "ix", "iy").distinct(), [*(on or []), "ix", "iy"], "left_semi")


def difference(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return a.join(b.select(*(on or []), "ix", "iy"), [*(on or []), "ix", "iy"], "left_anti")


def area(region: DataFrame, h: float, keys: list[str] | None = None) -> DataFrame:
    return region.groupBy(*(keys or [])).agg((F.count("*") * h * h).alias("area_m2"))


def bounds(region: DataFrame, h: float, keys: list[str] | None = None) -> DataFrame:
    return region.groupBy(*(keys or [])).agg((F.min("ix") * h).alias("x0"), (F.min("iy") * h).alias("y0"), ((F.max("ix") + 1) * h).alias("x1"), ((F.max("iy") + 1) * h).alias("y1"))


def contains(points: DataFrame, region: DataFrame, h: float, keys: list[str]) -> DataFrame:
    """Points with the keys of each region whose cell they are in."""
    own = points.withColumns({"ix": F.floor(F.col("x") / h), "iy": F.floor(F.col("y") / h)})
    return own.join(region.select(*keys, "ix", "iy"), ["ix", "iy"]).drop("ix", "iy")


def edge_cells(region: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with a neighbour, of the four, outside the region."""
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = region.select(*keys, "ix", "iy", around.alias("o")).select(*keys, (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    held = near.groupBy(*keys, "ix", "iy").agg(F.count("*").alias("n")).where("n = 4")
    return region.join(held, [*keys, "ix", "iy"], "left_anti")


def dilate(region: DataFrame, radius: float | str, h: float, keys: list[str], max_radius: float | None = None) -> DataFrame:
    """Cells whose centre is within radius of a cell's centre. Only edge cells are spread; the inside stays.

    radius: metres, or a column (then max_radius bounds it).
    """
    most = float(radius) if isinstance(radius, (int, float)) else max_radius
    k = int(most // h)
    extra = [] if isinstance(radius, (int, float)) else [radius]
    limit = F.lit(float(radius) ** 2) if isinstance(radius, (int, float)) else F.col(radius) * F.col(radius)
    steps = F.explode(F.sequence(F.lit(-k), F.lit(k)))
    spread = edge_cells(region, keys + extra).withColumn("dx", steps).withColumn("dy", steps)
    spread = spread.where((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * h * h <= limit)
    grown = spread.select(*keys, *extra, (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"))
    return region.select(*keys, *extra, "ix", "iy").unionByName(grown).distinct()


def cell_id(group: str | Column | None = None) -> Column:
    """A packed id of a cell, groups apart; the job fails at groups from 2^21 on and at cells beyond 2^20."""
    half = 1 << (SPAN - 1)
    g = (F.lit(0) if group is None else (F.col(group) if isinstance(group, str) else group)).cast("long")
    fine = g.between(0, (1 << SPAN) - 1) & F.col("ix").between(-half, half - 1) & F.col("iy").between(-half, half - 1)
    packed = (((g * (1 << SPAN)) + F.col("ix") + half) * (1 << SPAN)) + F.col("iy") + half
    return F.when(fine, packed).otherwise(F.raise_error(F.lit("a group or cell number is too large to pack")).cast("long"))


def pieces(region: DataFrame, group: str) -> DataFrame:
    """Adds piece: the least packed cell id of the cell's 4-connected piece, within the integer group.

    Cells of a row that follow each other are one run; only runs, which touch runs of the next row, go
    into the search for components.
    """
    along = Window.partitionBy(group, "iy").orderBy("ix")
    own = region.withColumn("_r", F.col("ix") - F.row_number().over(along))
    runs = cut(own.groupBy(group, "iy", "_r").agg(F.min("ix").alias("ix"), F.max("ix").alias("b")).withColumn("_id", cell_id(group)))
    next_row = runs.select(group, (F.col("iy") - 1).alias("iy"), F.col("ix").alias("c"), F.col("b").alias("d"), F.col("_id").alias("to"))
    edges = runs.join(next_row, [group, "iy"]).where("ix <= d AND c <= b").select(F.col("_id").alias("a"), F.col("to").alias("b"))
    named = runs.join(connected_components(edges).withColumnRenamed("id", "_id"), "_id", "left")
    named = named.select(group, "iy", "_r", F.coalesce("component", "_id").alias("piece"))
    return own.join(named, [group, "iy", "_r"]).drop("_r").select(*region.columns, "piece")


def overlaps(region: DataFrame, key: str, h: float, least_m2: float = 0.0) -> DataFrame:
    """zone_a < zone_b and area of each overlapping pair.

    An equi self-join on the cell: a cell of k regions makes k * (k - 1) / 2 rows, and regions that share
    a cell are few by their nature.
    """
    a, b = region.select(F.col(key).alias("zone_a"), "ix", "iy"), region.select(F.col(key).alias("zone_b"), "ix", "iy")
    return a.join(b, ["ix", "iy"]).where("zone_a < zone_b").groupBy("zone_a", "zone_b").agg((F.count("*") * h * h).alias("area_m2")).where(F.col("area_m2") >= least_m2)


def priority_owner(region: DataFrame, key: str, spacing: str = "max_spacing_m", order: str = "ord", tolerance: float = 0.01) -> DataFrame:
    """Each cell's owner: the smaller spacing (to the tolerance), then the smaller order, then the later zone."""
    rank = F.struct(F.round(F.col(spacing) / tolerance).cast("long").alias("s"), F.col(order).alias("o"), (-F.col(key)).alias("z"))
    return region.groupBy("ix", "iy").agg(F.min_by(key, rank).alias(key), F.count("*").alias("claims"))


def cut_report(region: DataFrame, owners: DataFrame, key: str, h: float) -> DataFrame:
    """For each zone: was_cut, cut_by (sorted, comma-joined), cut_area_m2 and fully_consumed."""
    own = region.select(key, "ix", "iy").join(owners.select("ix", "iy", F.col(key).alias("owner")), ["ix", "iy"])
    lost = F.col("owner") != F.col(key)
    out = own.groupBy(key).agg(F.count("*").alias("n"), F.count_if(lost).alias("lost"), F.array_sort(F.collect_set(F.when(lost, F.col("owner")))).alias("by"))
    return out.select(key, (F.col("lost") > 0).alias("was_cut"), F.array_join(F.transform("by", lambda z: z.cast("string")), ",").alias("cut_by"), (F.col("lost") * h * h).alias("cut_area_m2"), (F.col("lost") == F.col("n")).alias("fully_consumed"))


def shared_borders(region: DataFrame, key: str) -> DataFrame:
    """Cells whose 8-neighbourhood (with themselves) holds two regions or more."""
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    near = region.select(key, "ix", "iy", around.alias("o")).select(key, (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    several = near.groupBy("ix", "iy").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("ix", "iy")
    return region.join(several, ["ix", "iy"], "left_semi")


def split_by_centres(cells: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Voronoi cells: each lattice cell goes to its region's nearest centre (keys, cell, x, y in cell units) (H7, H8).

    Centres are few for each region (CellConfig.most).
    """
    d = (F.col("ix") + 0.5 - F.col("x")) * (F.col("ix") + 0.5 - F.col("x")) + (F.col("iy") + 0.5 - F.col("y")) * (F.col("iy") + 0.5 - F.col("y"))
    return cells.join(centres, keys).groupBy(*keys, "ix", "iy").agg(F.min(F.struct(d.alias("d"), F.col("cell").alias("cell"))).alias("m")).select(*keys, "ix", "iy", F.col("m.cell").alias("cell"))


def centres_of(cells: DataFrame, key: str, counts: DataFrame, rounds: int = 8) -> DataFrame:
    """K-means centres for each region (key, k in counts), all regions at once: Lloyd's rounds as joins and averages.

    Starts from cells spread evenly along the region's rows, so the result is the same on every run.
    """
    rows = cells.groupBy(key, "iy").agg(F.count("*").alias("in_row"))
    down, along = Window.partitionBy(key).orderBy("iy"), Window.partitionBy(key, "iy").orderBy("ix")
    rows = rows.select(key, "iy", (F.sum("in_row").over(down) - F.col("in_row")).alias("above"))
    size = cells.groupBy(key).agg(F.count("*").alias("n")).join(counts, key)
    start = cells.withColumn("i", F.row_number().over(along) - 1).join(rows, [key, "iy"]).withColumn("i", F.col("i") + F.col("above")).join(size, key).withColumn("cell", F.floor((F.col("i") * F.col("k")) / F.col("n")))
    centres = start.groupBy(key, "cell").agg((F.avg("ix") + 0.5).alias("x"), (F.avg("iy") + 0.5).alias("y"))

    centres = cut(centres)
    for _ in range(rounds):
        near = split_by_centres(cells, centres, [key])
        centres = cut(near.groupBy(key, "cell").agg((F.avg("ix") + 0.5).alias("x"), (F.avg("iy") + 0.5).alias("y")))
    return centres
