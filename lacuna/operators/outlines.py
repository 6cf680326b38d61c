"""Polygons as an index of their edges by lattice cells.

No row holds a ring once it is exploded: the index has a row for each edge in each cell near it, for each cell
that edges come near to, and for each cell that is inside as a whole. A point meets the rows of its own cell alone.
Whether it is inside is a count modulo two along a path of three legs: along the lower line of the cell's row from
far left up to the cell (counted once for each cell by a running sum), on that line up to below the point, and
straight up to it. The last two legs only cross edges of the point's own cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import djoin
from lacuna.operators.graph import cut

ENDS = ["ax", "ay", "bx", "by"]
#: Edges are listed in cells that they miss by so many cell widths, as their places in a row are rounded.
SLACK = 1e-6


def edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each edge, closing ones included: polygon (a number of our own for each row of polygons), keys, ax, ay, bx, by.

    ring is array<array<struct<x, y>>> without closing points. Edges with a missing or infinite coordinate are left out;
    polygons without corners have no rows. Written to the checkpoint folder, so that the numbers stay.
    """
    corner = lambda r, i, n: F.element_at(r, i)[n]
    after = lambda r, i: i % F.size(r) + 1
    one = lambda r: F.transform(F.sequence(F.lit(1), F.size(r)), lambda i: F.struct(*(corner(r, j, n).cast("double").alias(a + n) for a, j in (("a", i), ("b", after(r, i))) for n in "xy")))
    every = F.flatten(F.transform(F.filter(F.col("ring"), lambda r: F.size(r) > 0), one))
    rows = polygons.select(F.struct(*keys).alias("_key"), F.monotonically_increasing_id().alias("_polygon"), "ring").select("_key", "_polygon", F.explode(every).alias("_e"))
    return cut(rows.where(" AND ".join(f"abs(_e.{c}) < double('infinity')" for c in ENDS)).select("_polygon", "_key", *(F.col("_e")[c].alias(c) for c in ENDS)))


def in_cells(edges: DataFrame, w: float, reach: float = 0.0) -> DataFrame:
    """The edges with each cell u, v (w wide) that they come within reach of; now and then with one a little farther."""
    pad = reach + SLACK * w
    cell = lambda c: F.floor(c / w)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("v", F.explode(F.sequence(cell(low - pad), cell(high + pad))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda y: F.when(dy == 0, None).otherwise(F.col("ax") + (y - F.col("ay")) / dy * dx)
    ends = [at(F.greatest(low, F.col("v") * w - pad)), at(F.least(high, (F.col("v") + 1) * w + pad))]
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    first = F.when(dy == 0, left).otherwise(F.greatest(left, F.least(*ends)))
    last = F.when(dy == 0, right).otherwise(F.least(right, F.greatest(*ends)))
    return rows.withColumns({"_f": cell(first - pad), "_l": cell(last + pad)}).withColumn("u", F.explode(F.sequence("_f", F.greatest("_f", "_l")))).drop("_f", "_l")


def index(edges: DataFrame, w: float, reach: float = 0.0) -> DataFrame:
    """The rows that a point of cell u, v meets: _polygon, u, v, before, ax, ay, bx, by, c.

    Rows of edges within reach of the cell: c is the column in which the edge crosses the lower line of row v, if it does.
    Rows without an edge: before is how often the line is crossed left of the cell; cells without edges are
    listed where that is odd, as they are inside as a whole. So a polygon has a row for each cell of its area.
    """
    line = F.col("v") * w
    crosses = (F.col("ay") > line) != (F.col("by") > line)
    at = F.col("ax") + (line - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    near = in_cells(edges.drop("_key"), w, reach).withColumn("c", F.when(crosses, F.floor(at / w)))
    row = Window.partitionBy("_polygon", "v").orderBy("u")
    cells = near.groupBy("_polygon", "v", "u").agg(F.count_if(F.col("c") == F.col("u")).alias("own"))
    cells = cells.withColumns({"after": F.sum("own").over(row), "next": F.lead("u").over(row)})
    known = cells.select("_polygon", "u", "v", (F.col("after") - F.col("own")).alias("before"))
    whole = cells.where("after % 2 = 1 AND next > u + 1").select("_polygon", F.explode(F.sequence(F.col("u") + 1, F.col("next") - 1)).alias("u"), "v", "after").withColumnRenamed("after", "before")
    return near.select("_polygon", "u", "v", *ENDS, "c").unionByName(known.unionByName(whole), allowMissingColumns=True)


def flips(w: float) -> Column:
    """How often the path's last two legs cross the edge (see above), for a point x, y of cell u, v.

    Both legs judge the corner below the point by one sign, so that they agree however it is rounded; an edge through
    a corner counts as if the line were a hair higher and the point a hair farther right.
    """
    x, y, line = F.col("x"), F.col("y"), F.col("v") * w
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = lambda yy: dx * (yy - F.col("ay")) - dy * (x - F.col("ax"))
    left = F.when(F.col("c") == F.col("u"), side(line) * dy <= 0).otherwise(F.col("c") < F.col("u"))
    along = (F.col("c") == F.col("u")) & left
    above = F.when(F.col("c").isNull(), F.col("ay") > line).otherwise(left == (dx * dy > 0))
    up = ((F.col("ax") > x) != (F.col("bx") > x)) & above & (side(y) * dx > 0)
    return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(up, F.lit(False)).cast("int")


def distance() -> Column:
    """From x, y to the edge."""
    x, y = F.col("x"), F.col("y")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    p, q = x - F.col("ax") - t * dx, y - F.col("ay") - t * dy
    return F.sqrt(p * p + q * q)


def spots(points: DataFrame) -> DataFrame:
    """The distinct places of points that have one: x, y."""
    return points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') AND abs(y) < double('infinity')").distinct()


def held(at: DataFrame, edges: DataFrame, w: float, reach: float = 0.0) -> DataFrame:
    """x, y, _polygon, inside and boundary_m of the places that a polygon holds or is within reach of.

    On the boundary: not inside, at distance 0. boundary_m is null where it is more than reach.
    """
    cell = lambda c: F.floor(F.col(c) / w).alias("u" if c == "x" else "v")
    met = at.select("x", "y", cell("x"), cell("y")).join(index(edges, w, reach), ["u", "v"])
    edge = F.col("ax").isNotNull()
    found = met.groupBy("x", "y", "_polygon").agg(F.sum(F.when(edge, flips(w)).otherwise(F.col("before"))).alias("n"), F.min(F.when(edge, distance())).alias("d"))
    on = F.coalesce(F.col("d") == 0, F.lit(False))
    return found.select("x", "y", "_polygon", ((F.col("n") % 2 == 1) & ~on).alias("inside"), F.when(F.col("d") <= reach, F.col("d")).alias("boundary_m")).where("inside OR boundary_m IS NOT NULL")


def to_boundary(pairs: DataFrame, edges: DataFrame, w: float) -> DataFrame:
    """x, y, _polygon and boundary_m, the distance of each place x, y to the boundary of that polygon, however far."""
    return _descended(pairs.select("x", "y", "_polygon"), edges, w, ["_polygon"]).groupBy("x", "y", "_polygon").agg(F.min(distance()).alias("boundary_m"))


def nearest_edge(at: DataFrame, edges: DataFrame, w: float) -> DataFrame:
    """x, y, distance and _key of the nearest edge of all polygons; the least key wins ties."""
    best = _descended(at.select("x", "y"), edges, w, []).groupBy("x", "y").agg(F.min(F.struct(distance().alias("distance"), "_key")).alias("m"))
    return best.select("x", "y", "m.distance", "m._key")


def _descended(at: DataFrame, edges: DataFrame, w: float, group: list[str]) -> DataFrame:
    """Each place with the edges of the cells that may hold its nearest one, in a pyramid of the cells with edges."""
    near = cut(in_cells(edges, w))
    cells = cut(near.select(*group, F.col("u").alias("cx"), F.col("v").alias("cy")).distinct())
    return djoin.descend(at, cells, ["x", "y", *group], w, group, SLACK * w * 4).join(near, [*group, "u", "v"])
