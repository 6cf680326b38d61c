"""The exact area of a union of discs inside boxes, by Green's theorem and without a lattice.

The border of the covered part of a zone is made of arcs of circles outside all other discs and inside
the zone, and of stretches of the zone's sides inside some disc. A circle's neighbours, and the sides that it
crosses, each take away an interval of angles; what is left of the circle are arcs. A disc that a side cuts
takes an interval of that side. Unions of intervals are running maxima over a circle's neighbours, or over a
piece of a side, so a task never holds more than what is near.

Where discs are dense nearly all circles lie inside other discs. Those that a few outer discs of the cells around
(half a radius wide) cover have no arc, and meet no other disc; as neighbours of the rest all discs stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.djoin import NEIGHBOURS, distance_join
from lacuna.operators.graph import cut

TURN = 2 * pi
#: By so many radians an interval of angles has to be longer than a circle needs it.
MARGIN = 1e-7
#: Directions in which a cell's outermost disc stands for it.
DIRECTIONS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
#: Angle of the outward normal of each side, and how far a centre is inside of it.
SIDES = [(-pi / 2, "y - y0"), (0.0, "x1 - x"), (pi / 2, "y1 - y"), (pi, "x - x0")]


def discs_of_zones(zones: DataFrame, points: DataFrame, radius: str = "spacing") -> DataFrame:
    """zone, the box, x, y and r of every point whose disc of the zone's radius may meet the zone; equal points once.

    zones: zone, x0, y0, x1, y1 and the radius.
    """
    from lacuna.operators.coverage import zones_of_points

    grown = zones.selectExpr("zone AS zone_id", f"x0 - {radius} AS x0", f"y0 - {radius} AS y0", f"x1 + {radius} AS x1", f"y1 + {radius} AS y1")
    own = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    near = zones_of_points(own, grown, ["x", "y"]).select("x", "y", F.explode("zone_ids").alias("zone"))
    return near.join(zones.select("zone", "x0", "y0", "x1", "y1", F.col(radius).cast("double").alias("r")), "zone")


def union_areas(discs: DataFrame, max_radius: float) -> DataFrame:
    """zone and area_m2 of the union of a zone's discs inside its box; zones without a disc give no row.

    discs: zone, x0, y0, x1, y1, x, y, r, no two rows of a zone with equal x, y and r.
    """
    # coordinates from the zone's corner, as large ones cost digits
    own = discs.selectExpr("zone", "x - x0 AS x", "y - y0 AS y", "r", "0D AS x0", "0D AS y0", "x1 - x0 AS x1", "y1 - y0 AS y1")
    return _arcs(own, max_radius).unionByName(_stretches(own, max_radius)).groupBy("zone").agg(F.sum("area").alias("area_m2"))


def _gone(at: Column, half: Column) -> Column:
    """The interval of angles about `at`, as one or two within a turn."""
    start = F.pmod(at - half, F.lit(TURN))
    end = start + 2 * half
    return F.when(half >= pi, F.array(F.struct(F.lit(0.0).alias("a"), F.lit(TURN).alias("b")))).when(end > TURN, F.array(F.struct(start.alias("a"), F.lit(TURN).alias("b")), F.struct(F.lit(0.0).alias("a"), (end - TURN).alias("b")))).otherwise(F.array(F.struct(start.alias("a"), end.alias("b"))))


def bare(own: DataFrame) -> DataFrame:
    """The discs whose circle isn't covered, by a margin, by the outermost discs of its own cell and the eight around and by the sides."""
    at = own.withColumns({"_u": F.floor(F.col("x") / (F.col("r") / 2)), "_v": F.floor(F.col("y") / (F.col("r") / 2))})
    cell = ["zone", "r", "_u", "_v"]
    most = [F.max(F.struct((F.col("x") * a + F.col("y") * b).alias("o"), "x", "y")).alias(f"m{i}") for i, (a, b) in enumerate(DIRECTIONS)]
    outer = at.groupBy(*cell).agg(*most).select(*cell, F.array_distinct(F.array(*[F.struct(f"m{i}.x", f"m{i}.y") for i in range(len(DIRECTIONS))])).alias("o"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS]))
    near = outer.withColumn("n", around).select("zone", "r", (F.col("_u") + F.col("n.dx")).alias("_u"), (F.col("_v") + F.col("n.dy")).alias("_v"), "o").groupBy(*cell).agg(F.flatten(F.collect_list("o")).alias("_o"))
    return at.join(near, cell).select(*own.columns, F.col("_o.x").alias("_p"), F.col("_o.y").alias("_q")).mapInArrow(_bare, own.schema)


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            names = part.schema.names
            get = lambda c: part.column(names.index(c))  # noqa: B023, E731
            x, y, r, x0, y0, x1, y1 = (get(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "r", "x0", "y0", "x1", "y1"))
            who = np.repeat(np.arange(len(x)), pc.list_value_length(get("_p")).to_numpy(zero_copy_only=False))
            dx, dy = get("_p").flatten().to_numpy(zero_copy_only=False) - x[who], get("_q").flatten().to_numpy(zero_copy_only=False) - y[who]
            far = np.hypot(dx, dy)
            use = (far > 0) & (far < 2 * r[who])
            who, mid, half = who[use], np.arctan2(dy[use], dx[use]), np.arccos(far[use] / (2 * r[who[use]]))
            for turn, depth in ((-pi / 2, y - y0), (0.0, x1 - x), (pi / 2, y1 - y), (pi, x - x0)):
                some = np.flatnonzero(depth < r)
                who, mid, half = np.append(who, some), np.append(mid, np.full(len(some), turn)), np.append(half, np.arccos(np.maximum(depth[some] / r[some], -1.0)))
            half = half - MARGIN
            who, mid, half = who[half > 0], mid[half > 0], half[half > 0]
            a = np.mod(mid - half, TURN)
            b = a + 2 * half
            over = b > TURN
            who, a, b = np.append(who, who[over]), np.append(a, np.zeros(over.sum())), np.append(np.minimum(b, TURN), b[over] - TURN)
            order = np.lexsort((a, who))
            who, a, b = who[order], a[order], b[order]
            reach = np.maximum.accumulate(b + 10 * who) - 10 * who  # angles are below 10, so no disc sees another one's
            first = np.ones(len(who), bool)
            first[1:] = who[1:] != who[:-1]
            last = np.append(first[1:], True) if len(who) else first
            before = np.append(0.0, reach[:-1]) if len(who) else reach
            gap = np.where(first, a > 0, a > before + MARGIN / 10) | (last & (reach < TURN - MARGIN / 10))  # reach is rounded
            covered = np.zeros(len(x), bool)
            covered[who] = True
            covered[who[gap]] = False
            yield part.select(names[:-2]).filter(pa.array(~covered))


def _arcs(own: DataFrame, max_radius: float) -> DataFrame:
    """zone and each arc's share of the area."""
    circle = ["zone", "x", "y", "r"]
    every, own = own, cut(bare(own))
    met = distance_join(own.select(*circle), every.select(*circle), 2 * max_radius, explode="left").where("zone = r_zone AND distance < r + r_r AND NOT (distance = 0 AND r = r_r) AND distance + r_r > r")
    cosine = F.expr("(distance * distance + r * r - r_r * r_r) / (2 * distance * r)")
    half = F.when(F.col("distance") + F.col("r") <= F.col("r_r"), F.lit(pi)).otherwise(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    by_discs = met.select(*circle, F.explode(_gone(F.atan2(F.col("r_y") - F.col("y"), F.col("r_x") - F.col("x")), half)).alias("i"))
    sides = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), F.expr(s).alias("s")) for at, s in SIDES]))
    cut_ = own.withColumn("side", sides).where("side.s < r")
    by_sides = cut_.select(*circle, F.explode(_gone(F.col("side.at"), F.acos(F.greatest(F.expr("side.s / r"), F.lit(-1.0))))).alias("i"))
    end = own.select(*circle, F.struct(F.lit(TURN).alias("a"), F.lit(TURN).alias("b")).alias("i"))
    rows = by_discs.unionByName(by_sides).unionByName(end).select(*circle, "i.a", "i.b")
    before = Window.partitionBy(*circle).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    arc = rows.withColumn("from", F.coalesce(F.max("b").over(before), F.lit(0.0))).where(F.col("a") > F.col("from"))
    return arc.select("zone", F.expr("(r * r * (a - `from`) + r * x * (sin(a) - sin(`from`)) - r * y * (cos(a) - cos(`from`))) / 2").alias("area"))


def _stretches(own: DataFrame, max_radius: float) -> DataFrame:
    """zone and each covered stretch's share of the area. Only the sides away from the origin have one."""
    wide = 8 * max_radius
    side = F.explode(F.array(F.struct(F.lit("right").alias("side"), F.expr("x1 - x").alias("s"), F.col("y").alias("at"), F.col("y1").alias("long"), F.col("x1").alias("arm")), F.struct(F.lit("top").alias("side"), F.expr("y1 - y").alias("s"), F.expr("x1 - x").alias("at"), F.col("x1").alias("long"), F.col("y1").alias("arm"))))
    cut_ = own.select("zone", "r", side.alias("c")).select("zone", "r", "c.*").where("abs(s) < r").withColumn("half", F.expr("sqrt(r * r - s * s)"))
    span = cut_.selectExpr("zone", "side", "arm", "greatest(at - half, 0D) AS a", "least(at + half, long) AS b").where("a < b")
    piece = span.withColumn("piece", F.explode(F.sequence(F.floor(F.col("a") / wide), F.floor(F.col("b") / wide)))).withColumns({"a": F.greatest("a", F.col("piece") * F.lit(wide)), "b": F.least("b", (F.col("piece") + 1) * F.lit(wide))})
    before = Window.partitionBy("zone", "side", "piece").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.col("a"))), F.lit(0.0))
    return piece.withColumn("new", new).select("zone", (F.col("new") * F.col("arm") / 2).alias("area"))
