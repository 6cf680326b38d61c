"""Fill to a fixpoint: what a proposal leaves open gets sites until nothing is open.

The chain: centreline points and other locked sites cover first; the solver closes the open tests; what is
left of the zones' cells, between tests, falls into pieces, each piece into squares that one disc
covers, and each of these gets a site at its cell nearest to its centre; what is then left goes round again. A
site covers at least its own cell, so the rounds end; a square is covered in one or two.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.config import SolverConfig
from lacuna.operators import djoin, region, solve
from lacuna.operators.graph import cut


def open_cells(cells: DataFrame, sites: DataFrame, max_radius: float) -> DataFrame:
    """Cells (zone, ix, iy, h, spacing) whose centre no site is within spacing of."""
    at = cells.withColumns({"x": (F.col("ix") + 0.5) * F.col("h"), "y": (F.col("iy") + 0.5) * F.col("h")})
    return djoin.distance_join(at, sites.select("x", "y"), "spacing", max_radius, "anti").drop("x", "y")


def fill(cells: DataFrame, sites: DataFrame, max_radius: float) -> DataFrame:
    """zone, x, y and round of the sites that cover all cells which `sites` leave open."""
    left, out, turn = cut(open_cells(cells, sites, max_radius)), None, 0
    while not left.isEmpty():
        turn += 1
        wide = F.col("spacing") * F.lit(sqrt(2.0)) / F.col("h")  # the side of a disc's inner square
        own = region.pieces(left, "zone").withColumns({"u": F.floor(F.col("ix") / wide), "v": F.floor(F.col("iy") / wide)})
        group = ["zone", "piece", "u", "v"]
        centre = own.groupBy(*group).agg(F.avg("ix").alias("cx"), F.avg("iy").alias("cy"))
        apart = F.expr("(ix - cx) * (ix - cx) + (iy - cy) * (iy - cy)")
        one = own.join(centre, group).groupBy(*group).agg(F.min(F.struct(apart.alias("d"), "iy", "ix", "h")).alias("m"))
        new = cut(one.select("zone", ((F.col("m.ix") + 0.5) * F.col("m.h")).alias("x"), ((F.col("m.iy") + 0.5) * F.col("m.h")).alias("y"), F.lit(turn).alias("round")))
        out = new if out is None else out.unionByName(new)
        left = cut(open_cells(left, new, max_radius))
    return out if out is not None else cells.select("zone", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("round")).limit(0)


def complete(cells: DataFrame, tests: DataFrame, candidates: DataFrame, locked: DataFrame, max_radius: float, config: SolverConfig = SolverConfig()) -> DataFrame:
    """zone, x, y and source (solver, or fill and its round) of sites that close all gaps that locked ones (x, y) leave.

    cells: zone, ix, iy, h, spacing; tests: problem (the zone), test, x, y, required_radius; candidates as for place_sites.
    """
    open_ = djoin.distance_join(tests, locked.select("x", "y"), "required_radius", max_radius, "anti")
    placed = cut(solve.place_sites(open_, candidates, max_radius, config).where("cand IS NOT NULL").select(F.col("problem").alias("zone"), "x", "y", F.lit("solver").alias("source")))
    both = locked.select("x", "y").unionByName(placed.select("x", "y"))
    return placed.unionByName(fill(cells, both, max_radius).select("zone", "x", "y", F.concat(F.lit("fill "), F.col("round").cast("string")).alias("source")))
