"""What-if edits of points as a batch, and as a stateful service over a stream.

An edit is (seq, id, action, x, y): add, move, delete, restore (back to the base position). Edits of an id hold in
order of seq: a move of a point that is not there does nothing, an add of one that is there replaces it. As an add, a
delete or a restore forgets all before it, the fold of an id's edits is its last one of these and its
last move, so edits may arrive in any order and be applied twice, and a hot id needs no list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.operators import ranking

ACTIONS = ["add", "move", "delete", "restore"]


def latest(edits: DataFrame) -> DataFrame:
    """id, c (action, x, y, seq of the last add, delete or restore) and m (x, y, seq of the last move), either null."""
    own = edits.where(F.col("action").isin(ACTIONS) & F.col("seq").isNotNull())
    moves = F.col("action") == "move"
    return own.groupBy("id").agg(F.max_by(F.struct("action", "x", "y", "seq"), F.when(~moves, F.col("seq"))).alias("c"), F.max_by(F.struct("x", "y", "seq"), F.when(moves, F.col("seq"))).alias("m"))


def _folded(known: Column) -> dict[str, Column]:
    """present, nx, ny and is_edited of rows with x, y (base), c and m."""
    action = F.col("c.action")
    present = F.when(action == "add", F.lit(True)).when(action == "delete", F.lit(False)).otherwise(known)
    moved = F.coalesce(present & (F.col("m.seq") > F.coalesce(F.col("c.seq"), F.col("m.seq") - 1)), F.lit(False))
    added = F.coalesce(action == "add", F.lit(False))
    at = lambda c: F.when(moved, F.col(f"m.{c}")).when(added, F.col(f"c.{c}")).otherwise(F.col(c))
    return {"present": present, "nx": at("x"), "ny": at("y"), "is_edited": moved | added}


def changes(base: DataFrame, edits: DataFrame) -> DataFrame:
    """id, was and present (is the point there before and after), old_x, old_y, x, y and is_edited of all points, base and edited."""
    both = base.select("id", "x", "y", F.lit(True).alias("known")).join(latest(edits), "id", "full_outer")
    known = F.coalesce("known", F.lit(False))
    done = both.select("id", known.alias("was"), F.col("x").alias("old_x"), F.col("y").alias("old_y"), *[c.alias(n) for n, c in _folded(known).items()])
    return done.select("id", "was", "present", "old_x", "old_y", F.when(F.col("present"), F.col("nx")).alias("x"), F.when(F.col("present"), F.col("ny")).alias("y"), (F.col("present") & F.col("is_edited")).alias("is_edited"))


def apply_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """id, x, y and is_edited after the edits."""
    return changes(base, edits).where("present").select("id", "x", "y", "is_edited")


def new_ids(added: DataFrame) -> DataFrame:
    """NEW_001, NEW_002, ... in order of seq for added points without an id."""
    fresh = ranking.numbered(added.where("location_id IS NULL"), ["seq"], "_number").withColumn("location_id", F.format_string("NEW_%03d", "_number"))
    return added.where("location_id IS NOT NULL").unionByName(fresh.drop("_number"))


def windowed_edits(edits: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Edits of each action in tumbling windows, on a batch or on a stream with a watermark."""
    own = edits.withWatermark("ts", late) if edits.isStreaming else edits
    return own.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("edits")).select(F.col("w.start").alias("window_start"), "action", "edits")


STATE = "action string, cx double, cy double, cseq long, mx double, my double, mseq long, x double, y double, there boolean"
CHANGE = "id long, was boolean, present boolean, old_x double, old_y double, x double, y double, seq long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One point: its last add, delete or restore, its last move, and where it is; a change is where it was and is."""
    if state.hasTimedOut:
        return
    action, cx, cy, cseq, mx, my, mseq, x, y, there = state.get if state.exists else (None,) * 10
    for rows in batches:
        for r in rows.itertuples(index=False):
            if there is None:
                there = bool(r.known)
                x, y = (float(r.bx), float(r.by)) if there else (None, None)
            base = (float(r.bx), float(r.by)) if r.known else None
            seq = int(r.seq)
            if r.action == "move" and (mseq is None or seq > mseq):
                mx, my, mseq = float(r.x), float(r.y), seq
            elif r.action != "move" and (cseq is None or seq > cseq):
                action, cseq = r.action, seq
                cx, cy = (float(r.x), float(r.y)) if action == "add" else (None, None)
            at = (cx, cy) if action == "add" else None if action == "delete" else base
            if at is not None and mseq is not None and (cseq is None or mseq > cseq):
                at = (mx, my)
    old, was = (x, y), there
    x, y = at or (None, None)
    there = at is not None
    state.update((action, cx, cy, cseq, mx, my, mseq, x, y, there))
    if (was, old) != (there, (x, y)):
        yield pd.DataFrame({"id": [key[0]], "was": [was], "present": [there], "old_x": [old[0]], "old_y": [old[1]], "x": [x], "y": [y], "seq": [max(cseq or 0, mseq or 0)]})


def service(edits: DataFrame, base: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The changes of points (CHANGE) that a stream of edits with a timestamp ts makes to base (id, x, y); ids and seqs are not null.

    Rows older than the watermark are dropped. The state holds one row for each id that was ever edited; to shorten
    it, start anew from what `apply_edits` makes of base. A change of a batch says where a point was and is.
    """
    known = base.select("id", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(True).alias("known"))
    own = edits.withWatermark("ts", late).where(F.col("action").isin(ACTIONS) & F.col("seq").isNotNull() & F.col("id").isNotNull())
    rows = own.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.groupBy("id").applyInPandasWithState(_fold, CHANGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_stream(edits: DataFrame, base: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes"):
    """Hands each batch of changes to apply, at least once."""
    return service(edits, base, late).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cover_counts(points: DataFrame, cells: DataFrame, h: float, max_radius: float) -> DataFrame:
    """zone_id, ix, iy and n: how many points (x, y) each cell is covered by, where any (the fragments of N7, added up). cells: zone_id, ix, iy, max_spacing_m."""
    from lacuna.operators.djoin import distance_join

    own = cells.withColumns({"x": (F.col("ix") + 0.5) * h, "y": (F.col("iy") + 0.5) * h})
    return distance_join(own, points.select("x", "y"), "max_spacing_m", max_radius).groupBy("zone_id", "ix", "iy").agg(F.count("*").alias("n"))


def changed_counts(counts: DataFrame, change: DataFrame, cells: DataFrame, h: float, max_radius: float) -> DataFrame:
    """counts after a change of points; only cells near what has changed are met."""
    new = cover_counts(change.where("present").select("x", "y"), cells, h, max_radius)
    old = cover_counts(change.where("was").select(F.col("old_x").alias("x"), F.col("old_y").alias("y")), cells, h, max_radius).withColumn("n", -F.col("n"))
    total = counts.unionByName(new).unionByName(old).groupBy("zone_id", "ix", "iy").agg(F.sum("n").alias("n"))
    return total.where("n > 0")


def keep_counts(spark, folder: str, cells: DataFrame, h: float, max_radius: float) -> Callable[[DataFrame, int], None]:
    """For run_stream: each batch's cover counts in a folder of its own, from those of the batch before; a batch that comes again writes the same.

    The counts of the base are in `start`.
    """

    def apply(change: DataFrame, batch: int) -> None:
        before = f"{folder}/{batch - 1}" if batch else f"{folder}/start"
        changed_counts(change.sparkSession.read.parquet(before), change, cells, h, max_radius).write.mode("overwrite").parquet(f"{folder}/{batch}")

    return apply


def zone_areas(counts: DataFrame, h: float) -> DataFrame:
    """zone_id and covered_m2."""
    return counts.groupBy("zone_id").agg((F.count("*") * h * h).alias("covered_m2"))


def point_coverage(points: DataFrame, cells: DataFrame, h: float, max_radius: float) -> DataFrame:
    """For each point and each zone in reach: the area within the zone's own radius (C21, N1). cells: zone_id, ix, iy, max_spacing_m."""
    from lacuna.operators.djoin import distance_join

    own = cells.withColumns({"x": (F.col("ix") + 0.5) * h, "y": (F.col("iy") + 0.5) * h})
    hit = distance_join(own, points.select("id", "x", "y"), "max_spacing_m", max_radius)
    return hit.groupBy(F.col("r_id").alias("id"), "zone_id").agg((F.count("*") * h * h).alias("area_m2"))
