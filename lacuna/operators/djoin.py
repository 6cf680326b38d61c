"""Joins by distance: grid buckets as equi-join keys, the exact distance as residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.graph import cut

NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def distance(ax, ay, bx, by) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def distance_join(left: DataFrame, right: DataFrame, radius: float | str | Column, max_radius: float | None = None, how: str = "inner", prefix: str = "r_", strict: bool = False, explode: str = "right") -> DataFrame:
    """Rows of left and right (columns prefixed) whose x, y are at most radius apart, with their distance.

    radius: a number, or an expression over both sides' columns; then max_radius, its bound, is needed, and
    the job fails at a radius beyond it (a column of left is checked in every row, any other expression where
    two rows meet in a bucket).
    how: inner, left (unmatched rows of left stay, with nulls), semi, anti (rows of left that match, or
    don't), exists (left with is_match). Null coordinates match nothing.

    Buckets are as wide as the radius and are the keys of one equi-join whose residual condition is the
    distance, so semi, anti and exists stop at a row's first match. The side named by explode, for all
    but inner the right one, is repeated over nine neighbouring buckets; a crowded bucket is a skewed
    partition that adaptive execution splits.
    """
    wide = float(radius) if isinstance(radius, (int, float)) else max_radius
    if not wide or wide <= 0:
        raise ValueError("a positive radius, or max_radius for an expression, is needed")
    if how not in ("inner", "left", "semi", "anti", "exists"):
        raise ValueError(f"unknown join {how!r}")
    many_left = explode == "left" and how == "inner"
    limit = F.lit(float(radius)) if isinstance(radius, (int, float)) else (F.col(radius) if isinstance(radius, str) else radius)
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS]))
    checked = F.when(limit > wide, F.raise_error(F.concat(F.lit("a radius is beyond max_radius: "), limit.cast("string"))).cast("double"))
    ours = isinstance(radius, str) and radius in left.columns

    def keyed(df: DataFrame, p: str, bx: str, by: str, many: bool) -> DataFrame:
        place = lambda c: F.floor((F.coalesce(checked, F.col(c)) if ours and not p else F.col(p + c)) / wide)
        df = df.withColumns({bx: place("x"), by: place("y")})
        if not many:
            return df
        return df.withColumn("_o", around).withColumns({bx: F.col(bx) + F.col("_o.dx"), by: F.col(by) + F.col("_o.dy")}).drop("_o")

    renamed = right.where("x IS NOT NULL AND y IS NOT NULL").select(*[F.col(c).alias(prefix + c) for c in right.columns])
    one, other = keyed(left, "", "_bx", "_by", many_left), keyed(renamed, prefix, "_cx", "_cy", not many_left)
    apart = distance("x", "y", prefix + "x", prefix + "y")
    if not ours and not isinstance(radius, (int, float)):
        limit = F.coalesce(checked, limit)
    meet = (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy")) & (apart < limit if strict else apart <= limit)
    if how in ("semi", "anti"):
        return one.join(other, meet, f"left_{how}").drop("_bx", "_by")
    if how == "exists":
        if isinstance(radius, Column):
            found = [one.join(other, meet, f"left_{k}").withColumn("is_match", F.lit(k == "semi")) for k in ("semi", "anti")]
            return found[0].unionByName(found[1]).drop("_bx", "_by")
        bound = radius if isinstance(radius, str) else repr(float(radius))
        near = f"sqrt((l.x - r.{prefix}x) * (l.x - r.{prefix}x) + (l.y - r.{prefix}y) * (l.y - r.{prefix}y)) {'<' if strict else '<='} {bound}"
        found = left.sparkSession.sql(f"SELECT l.*, EXISTS (SELECT 1 FROM {{r}} r WHERE l._bx = r._cx AND l._by = r._cy AND {near}) AS is_match FROM {{l}} l", l=one, r=other)
        return found.drop("_bx", "_by")
    return one.join(other, meet, how).withColumn("distance", apart).drop("_bx", "_by", "_cx", "_cy")


def counted(left: DataFrame, right: DataFrame, radius: float, keys: list[str], fine: int = 12, few: float = 5e7) -> DataFrame:
    """keys, near (how many right rows are at most radius away) and least (the least of their distances, else null).

    Where the buckets of `distance_join` would bring together more than few pairs, the rows are dealt over cells of
    radius / fine: a right cell that is within the radius as a whole counts for all rows of a left cell at once, and
    single rows are compared only where a cell lies across the radius or may hold a row's nearest one. Rows of equal keys count together.
    """
    mine = left.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    real = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    place = mine.where(real)
    other = right.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(real)
    cell = lambda df, w: df.withColumns({"_u": F.floor(F.col("x") / w), "_v": F.floor(F.col("y") / w)})
    per = lambda df, w: cell(df, w).groupBy("_u", "_v").agg(F.count("*").cast("double").alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS]))
    spread = per(other, radius).withColumn("_o", around).select((F.col("_u") + F.col("_o.dx")).alias("_u"), (F.col("_v") + F.col("_o.dy")).alias("_v"), F.col("n").alias("m"))
    pairs = per(place, radius).join(spread, ["_u", "_v"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
    if pairs <= few:
        met = distance_join(mine, other, radius, how="left")
        return met.groupBy(*keys).agg(F.count("r_x").alias("near"), F.min("distance").alias("least"))
    w = radius / fine
    slack = 1e-6 * w
    here = cell(place, w)
    there = cell(other, w).select(F.col("_u").alias("_s"), F.col("_v").alias("_t"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    steps = F.explode(F.sequence(F.lit(-fine - 1), F.lit(fine + 1)))
    both = here.select("_u", "_v").distinct().withColumn("du", steps).withColumn("dv", steps).withColumns({"_s": F.col("_u") + F.col("du"), "_t": F.col("_v") + F.col("dv")})
    away = lambda by: F.hypot(*(F.greatest(F.abs(c) + by, F.lit(0)).cast("double") for c in ("du", "dv"))) * w
    # a little less and more than the bounds, as places are rounded
    both = both.join(there.groupBy("_s", "_t").agg(F.count("*").alias("n")), ["_s", "_t"]).withColumns({"begin": away(-1) - slack, "end": away(1) + slack}).where(F.col("begin") <= radius)
    both = cut(both.withColumns({"whole": F.col("end") <= radius, "bound": F.min("end").over(Window.partitionBy("_u", "_v"))}).select("_u", "_v", "_s", "_t", "n", "whole", (F.col("begin") <= F.col("bound")).alias("first")))
    single = both.where("NOT whole OR first").select("_u", "_v", "_s", "_t", "whole").join(there, ["_s", "_t"]).drop("_s", "_t")
    apart = distance("x", "y", "r_x", "r_y")
    met = here.join(single, ["_u", "_v"]).withColumn("d", apart).where(F.col("d") <= radius)
    met = met.groupBy("_u", "_v", *keys).agg(F.count_if(~F.col("whole")).alias("near"), F.min("d").alias("least")).drop("_u", "_v")
    wholes = here.join(both.where("whole").groupBy("_u", "_v").agg(F.sum("n").alias("near")), ["_u", "_v"]).select(*keys, "near", F.lit(None).cast("double").alias("least"))
    none = mine.select(*keys, F.lit(0).cast("long").alias("near"), F.lit(None).cast("double").alias("least"))
    return none.unionByName(wholes).unionByName(met).groupBy(*keys).agg(F.sum("near").alias("near"), F.min("least").alias("least"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], right_id: str, start: float, within: float | None = None) -> DataFrame:
    """keys, nearest_id and distance of the nearest right row (C8, C9, C18); the least id wins a tie.

    The right side is a pyramid of occupied cells, twice as wide on each level, start at the bottom. Every row of
    left descends from the top, of at most four cells, to the occupied parts of the cells that may hold its nearest
    point: those that begin no farther away than another one ends. So a row carries a few cells on each
    of as many levels as the logarithm of the extent, however far it is from all points, and meets points only in
    the last ones. keys identify a row. Without right rows, or beyond `within`: nulls.
    """
    fine = lambda c: F.floor(F.col(c) / start)
    points = right.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(right_id).alias("_id"), F.col("x").alias("px"), F.col("y").alias("py"), fine("x").alias("cx"), fine("y").alias("cy"))
    cells = cut(points.select("cx", "cy").distinct())
    none = left.select(*keys)
    if cells.isEmpty():
        return none.withColumns({"nearest_id": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")})
    rows = descend(left.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y"), cells, keys, start, within=within)
    apart = distance("x", "y", "px", "py")
    best = rows.join(points, [F.col("u") == F.col("cx"), F.col("v") == F.col("cy")]).groupBy(*keys).agg(F.min(F.struct(apart.alias("distance"), F.col("_id").alias("id"))).alias("m"))
    best = best.select(*keys, F.col("m.id").alias("nearest_id"), F.col("m.distance").alias("distance"))
    return none.join(best if within is None else best.where(F.col("distance") <= within), keys, "left")


def descend(rows: DataFrame, cells: DataFrame, keys: list[str], start: float, group: list[str] | None = None, slack: float = 0.0, within: float | None = None) -> DataFrame:
    """rows (keys, x, y) with the cells u, v, start wide, that may hold what is nearest to them.

    cells are the occupied ones, distinct and written down: group, cx, cy. Their pyramid is twice as wide on each level, up to the
    one on which each group has four cells at most. A row keeps the cells that begin no farther away than another one ends
    (slack: by how much a cell may miss what it is occupied by). keys, which identify a row, hold the group.
    """
    group = group or []
    low, high = ((f("cx").alias("x"), f("cy").alias("y")) for f in (F.min, F.max))
    ends = cells.groupBy(*group).agg(F.struct(*low).alias("low"), F.struct(*high).alias("high"))
    longest = ends.agg(F.max(F.greatest(F.col("high.x") - F.col("low.x"), F.col("high.y") - F.col("low.y")))).first()[0]
    top = 0 if longest is None else longest.bit_length()
    side = lambda c, k, w: F.greatest(F.col(k) * w - F.col(c), F.col(c) - (F.col(k) + 1) * w, F.lit(0.0))
    over = lambda c, k, w: F.greatest(F.abs(F.col(c) - F.col(k) * w), F.abs(F.col(c) - (F.col(k) + 1) * w))
    mine = Window.partitionBy(*keys)
    named = list(dict.fromkeys([*keys, "x", "y"]))
    wider = lambda by: cells.select(*group, F.shiftright("cx", by).alias("cu"), F.shiftright("cy", by).alias("cv")).distinct()
    first = wider(top).select(*group, F.col("cu").alias("u"), F.col("cv").alias("v"))
    if group:
        rows = rows.select(*named).join(first, group)
    else:
        few = [F.struct(F.lit(c.u).cast("long").alias("u"), F.lit(c.v).cast("long").alias("v")) for c in first.collect()]  # four at most
        rows = rows.select(*named, F.explode(F.array(*few) if few else F.expr("CAST(array() AS array<struct<u: bigint, v: bigint>>)")).alias("c")).select(*named, "c.u", "c.v")
    for level in range(top - 1, -1, -1):
        wide = start * (1 << level)
        parts = wider(level).withColumns({"u": F.shiftright("cu", 1), "v": F.shiftright("cv", 1)})
        met = rows.join(parts, [*group, "u", "v"]).withColumns({"begin": F.hypot(side("x", "cu", wide), side("y", "cv", wide)), "end": F.hypot(over("x", "cu", wide), over("y", "cv", wide))})
        # a little more than the bound, as both are rounded
        near = met.withColumn("bound", F.min("end").over(mine)).where(F.col("begin") <= F.col("bound") * (1 + 1e-9) + slack)
        rows = (near if within is None else near.where(F.col("begin") <= within)).select(*named, F.col("cu").alias("u"), F.col("cv").alias("v"))
        if level % 4 == 3:
            rows = cut(rows)
    return rows


def conflict_pairs(points: DataFrame, exclusion: float, id_col: str = "id", group: list[str] | None = None, most: int | None = None) -> DataFrame:
    """a < b of each two points at most exclusion apart, within a group; a cap takes the first by (a, b)."""
    group = group or []
    own = points.select(*group, F.col(id_col).alias("id"), "x", "y")
    pairs = distance_join(own, own, exclusion).where("id < r_id")
    for g in group:
        pairs = pairs.where(F.col(g) == F.col("r_" + g))
    out = pairs.select(*group, F.col("id").alias("a"), F.col("r_id").alias("b"), "distance")
    return out.orderBy(*group, "a", "b").limit(most) if most else out


def pre_covered(tests: DataFrame, locked: DataFrame, keys: list[str], max_radius: float) -> DataFrame:
    """Test points with is_match: is a locked point within the test point's own required radius (C4, C5)?"""
    return distance_join(tests, locked, "required_radius", max_radius, "exists")


def unsatisfied(tests: DataFrame, locked: DataFrame, keys: list[str], max_radius: float) -> DataFrame:
    """Test points that no locked point covers."""
    return distance_join(tests, locked, "required_radius", max_radius, "anti")


def drop_coincident(removed: DataFrame, added: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Removed and added points without those that stand for each other (C20).

    Each removed point takes the first added one in order of seq within the tolerance; both go.
    """
    pairs = distance_join(removed.select("seq", "x", "y"), added.select("seq", "x", "y"), tolerance).groupBy("seq").agg(F.min("r_seq").alias("added_seq"))
    pairs = cut(pairs)
    return removed.join(pairs.select("seq"), "seq", "left_anti"), added.join(pairs.select(F.col("added_seq").alias("seq")).distinct(), "seq", "left_anti")
