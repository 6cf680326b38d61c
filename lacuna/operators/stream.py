"""Points meet the index of edges (`outlines`) cell by cell, inside tasks: pairs of a point and a polygon are never shuffled.

The index's rows and the points are dealt and sorted by cell together, a cell's polygons first and in order of their
keys, so that a task holds the rows of one cell's edges and reads its points past them in batches. Where
points times rows of a cell are more than TASK, its points are dealt over several tasks, each with the cell's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from lacuna.operators import outlines

#: Points times rows of the index that a task answers of one cell; box tests and edges that are looked at at a time.
TASK, BOXES, EDGES = 1 << 31, 1 << 18, 1 << 18
#: Squares that a cell is cut into along a side at most, so many places to a square; squares times polygons at most.
SIDE, PLACES, MARKS = 32, 8, 1 << 24
ENDS = outlines.ENDS
PART, CROSSED, MEASURED, POINT = range(4)


def meet(points: DataFrame, edges: DataFrame, w: float, answer: str, reach: float = 0.0, far: bool = False) -> DataFrame:
    """The points that have a place, with what holds them; on the boundary is not inside, at distance 0.

    answer: pairs (pt, the point's columns, _key, inside, boundary_m of every polygon that holds it or is within reach;
    boundary_m is null where it is more than reach, but with far it is known inside too, for which every
    edge of a polygon goes with each of its cells), lists (pt and held, the keys of the polygons that hold it in
    rising order), or least (pt, found and _key: the least key of those that hold or touch it).
    """
    cell = lambda c: F.floor(F.col(c).cast("double") / w)
    own = points.select(F.struct(*points.columns).alias("pt"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < double('infinity') AND abs(y) < double('infinity')")
    own = own.select("pt", "x", "y", cell("x").alias("u"), cell("y").alias("v"))
    box = edges.groupBy("_polygon").agg(F.first("_key").alias("_key"), F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1"))
    index = outlines.index(edges, w, reach)
    part = index.where("ax IS NULL").select("_polygon", "u", "v", "before")
    rows = part.join(box, "_polygon").withColumn("kind", F.lit(PART))
    rows = rows.unionByName(index.where("ax IS NOT NULL").drop("before").withColumn("kind", F.lit(CROSSED)), allowMissingColumns=True)
    if far:
        rows = rows.unionByName(part.drop("before").join(edges.drop("_key"), "_polygon").withColumn("kind", F.lit(MEASURED)), allowMissingColumns=True)
    load = rows.groupBy("u", "v").agg(F.count("*").alias("n")).join(own.groupBy("u", "v").agg(F.count("*").alias("m")), ["u", "v"])
    load = load.select("u", "v", F.ceil(F.col("n") * F.col("m") / F.lit(float(TASK))).alias("chunks"))  # cells with points alone
    rows = rows.join(load, ["u", "v"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    own = own.join(load, ["u", "v"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("x", "y"), F.col("chunks")), F.lit(0))).drop("chunks").withColumn("kind", F.lit(POINT))
    both = rows.unionByName(own, allowMissingColumns=True).repartition("u", "v", "chunk").sortWithinPartitions("u", "v", "chunk", "kind", "_key", "_polygon")
    both = both.select("u", "v", "chunk", "kind", "_polygon", "before", "x0", "y0", "x1", "y1", *ENDS, "c", "x", "y", "_key", "pt")
    pt, key = both.schema["pt"], both.schema["_key"]
    out = {"pairs": [pt, key, StructField("inside", BooleanType()), StructField("boundary_m", DoubleType())], "lists": [pt, StructField("held", ArrayType(key.dataType))], "least": [pt, StructField("found", BooleanType()), key]}[answer]
    return both.mapInArrow(_answered(answer, w, reach, far), StructType(out))


def _answered(answer: str, w: float, reach: float, far: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, cell = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in name[:3]] + [(name[3][1:] == POINT) != (name[3][:-1] == POINT)], axis=0)
            edge = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = tuple(int(c[a]) for c in name[:3])
                if at != last:
                    last, held, cell = at, [], None
                if name[3][a] != POINT:
                    held.append(batch.slice(a, b - a))
                    continue
                cell = cell or _Cell(held, batch.schema, at[:2], w, reach, far)
                held = []
                yield from getattr(cell, answer)(batch.slice(a, b - a))

    return run


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... (count[i] of them), one i after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class _Cell:
    """The polygons of one cell, in order of their keys, and their edges one polygon after the other."""

    def __init__(self, rows: list[pa.RecordBatch], schema: pa.Schema, at: tuple[int, int], w: float, reach: float, far: bool):
        t = pa.Table.from_batches(rows, schema=schema)
        number = lambda name, of=t: of.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        kind = number("kind")
        n = int((kind == PART).sum())  # they come first
        part = t.slice(0, n)
        self.key = part.column("_key").combine_chunks()
        self.before = number("before", part).astype(np.int64)
        self.box = [number(c, part) + s * (reach * (1 + 1e-9) + 1e-9 * w) for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
        self.u, self.line, self.reach, self.far = at[0], at[1] * w, reach, far
        self.w = w
        own = number("_polygon", part)
        by = np.argsort(own, kind="stable")
        self.edges = {}
        for k in (CROSSED, MEASURED):
            e = t.filter(pa.array(kind == k))
            place = by[np.searchsorted(own[by], number("_polygon", e))] if n else np.zeros(0, np.int64)
            order = np.argsort(place, kind="stable")
            c = e.column("c").combine_chunks()
            self.edges[k] = np.searchsorted(place[order], np.arange(n + 1)), [number(x, e)[order] for x in ENDS], (~np.asarray(c.is_null()))[order], c.fill_null(0).to_numpy(zero_copy_only=False)[order]

    def _each(self, kind: int, part: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the pairs of these polygons, of so many edges at a time: the pairs with edges, where theirs begin, each edge's pair, the edges."""
        start = self.edges[kind][0]
        size = start[part + 1] - start[part]
        total = np.cumsum(size)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EDGES, side="right")))
            some = at + np.flatnonzero(size[at:to])
            if len(some):
                s = size[some]
                first = np.cumsum(s) - s
                yield some, first, np.repeat(some, s), np.repeat(start[part[some]] - first, s) + np.arange(int(s.sum()))
            at = to

    def judged(self, x: np.ndarray, y: np.ndarray, part: np.ndarray, away: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a place and a polygon: inside, and the distance to the edges that are known here (infinite without); as `outlines` has it.

        Without away only edges whose boxes hold the place count for the distance, so that it is right where it is 0.
        """
        n, d = self.before[part], np.full(len(part), np.inf)
        _, (ax, ay, bx, by), crosses, column = self.edges[CROSSED]
        for some, first, pair, e in self._each(CROSSED, part):
            px, py, eax, eay, ebx = x[pair], y[pair], ax[e], ay[e], bx[e]
            dx, dy, has, c = ebx - eax, by[e] - eay, crosses[e], column[e]
            mine = has & (c == self.u)
            left = np.where(mine, (dx * (self.line - eay) - dy * (px - eax)) * dy <= 0, c < self.u)
            above = np.where(has, left == (dx * dy > 0), eay > self.line)
            up = ((eax > px) != (ebx > px)) & above & ((dx * (py - eay) - dy * (px - eax)) * dx > 0)
            n[some] += np.add.reduceat((mine & left).astype(np.int64) + up, first)
        kind, pad = MEASURED if self.far else CROSSED, outlines.SLACK * self.w
        _, (ax, ay, bx, by), _, _ = self.edges[kind]
        for some, first, pair, e in self._each(kind, part):
            px, py, eax, eay, ebx, eby = x[pair], y[pair], ax[e], ay[e], bx[e], by[e]
            if not away:
                near = np.flatnonzero((np.minimum(eax, ebx) <= px + pad) & (np.maximum(eax, ebx) >= px - pad) & (np.minimum(eay, eby) <= py + pad) & (np.maximum(eay, eby) >= py - pad))
                if not len(near):
                    continue
                some, first = np.unique(pair[near], return_index=True)
                px, py, eax, eay, ebx, eby = (c[near] for c in (px, py, eax, eay, ebx, eby))
            dx, dy = ebx - eax, eby - eay
            square = dx * dx + dy * dy
            with np.errstate(invalid="ignore", divide="ignore"):
                t = np.where(square > 0, np.clip(((px - eax) * dx + (py - eay) * dy) / square, 0.0, 1.0), 0.0)
            p, q = px - eax - t * dx, py - eay - t * dy
            d[some] = np.fmin.reduceat(np.sqrt(p * p + q * q), first)
        return (n % 2 == 1) & (d != 0), d

    def _boxed(self, x: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and the polygons a to b whose boxes hold them, by place."""
        x0, y0, x1, y1 = (c[a:b] for c in self.box)
        i, k = np.nonzero((x[:, None] >= x0) & (x[:, None] <= x1) & (y[:, None] >= y0) & (y[:, None] <= y1))
        return i, a + k

    def _blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xy")
        pt, step = batch.column(batch.schema.get_field_index("pt")), max(1, BOXES // max(1, len(self.key)))
        for at in range(0, len(x), step):
            px, py = x[at : at + step], y[at : at + step]
            i, k = self._boxed(px, py, 0, len(self.key))
            inside, d = self.judged(px[i], py[i], k)
            yield pt.slice(at, step), i, k, inside, d

    def pairs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for pt, i, k, inside, d in self._blocks(batch):
            keep = inside | (d <= self.reach)
            i, k, inside, d = i[keep], k[keep], inside[keep], d[keep]
            unknown = np.isinf(d) if self.far else d > self.reach
            yield pa.RecordBatch.from_arrays([pt.take(pa.array(i)), self.key.take(pa.array(k)), pa.array(inside), pa.array(d, mask=unknown)], ["pt", "_key", "inside", "boundary_m"])

    def _edged(self, g: int) -> np.ndarray:
        """Of g times g squares of the cell, by rows, and each polygon (square, polygon): does an edge come near the square?"""
        start, (ax, ay, bx, by), _, _ = self.edges[CROSSED]
        owner, s, pad = np.repeat(np.arange(len(self.key)), np.diff(start)), self.w / g, outlines.SLACK * self.w
        out = np.zeros((g * g, len(self.key)), bool)

        def squares(low: np.ndarray, high: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
            """Which of these stretches meet the cell, once for each row or column of squares, and the row or column."""
            a, b = (np.clip(np.floor((c - base) / s), -1, g).astype(np.int64) for c in (low - pad, high + pad))
            a, n = np.maximum(a, 0), np.maximum(np.minimum(b, g - 1) - np.maximum(a, 0) + 1, 0)
            return np.repeat(np.arange(len(n)), n), _ragged(a, n)

        e, row = squares(np.minimum(ay, by), np.maximum(ay, by), self.line)
        ax, ay, bx, by, owner = ax[e], ay[e], bx[e], by[e], owner[e]
        dx, dy, left, right = bx - ax, by - ay, np.minimum(ax, bx), np.maximum(ax, bx)
        low, high = np.maximum(np.minimum(ay, by), self.line + row * s - pad), np.minimum(np.maximum(ay, by), self.line + (row + 1) * s + pad)
        with np.errstate(invalid="ignore", divide="ignore"):
            p, q = (np.where(dy == 0, c, ax + (y - ay) / dy * dx) for y, c in ((low, left), (high, right)))
        e, column = squares(np.clip(np.minimum(p, q), left, right), np.clip(np.maximum(p, q), left, right), self.u * self.w)
        out[row[e] * g + column, owner[e]] = True
        return out

    def lists(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The cell is cut into squares: polygons without an edge near a square hold all of its places or none, so one place is judged for them."""
        x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xy")
        n = max(1, len(self.key))
        g = max(1, min(SIDE, int(np.sqrt(min(len(x) / PLACES, MARKS / n)))))
        column, row = (np.clip(np.floor((c - base) * (g / self.w)), 0, g - 1).astype(np.int64) for c, base in ((x, self.u * self.w), (y, self.line)))
        order = np.argsort(row * g + column, kind="stable")
        x, y, pt = x[order], y[order], batch.column(batch.schema.get_field_index("pt")).take(pa.array(order))
        square, first, own = np.unique((row * g + column)[order], return_index=True, return_inverse=True)
        edged = self._edged(g)[square]
        met, poly = np.nonzero(edged)
        met = np.searchsorted(met, np.arange(len(square) + 1))
        at, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(square), max(1, BOXES // n)):
            one = first[a : a + max(1, BOXES // n)]
            i, j = self._boxed(x[one], y[one], 0, len(self.key))
            i, j = (c[~edged[a + i, j]] for c in (i, j))
            inside = self.judged(x[one][i], y[one][i], j, False)[0]
            at.append(a + i[inside])
            k.append(j[inside])
        whole = np.concatenate(k)
        held = np.searchsorted(np.concatenate(at), np.arange(len(square) + 1))
        total = np.cumsum((np.diff(met) + np.diff(held))[own])
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BOXES, side="right")))
            of = own[a:b]
            size = np.diff(held)[of]
            i, j = np.repeat(np.arange(b - a), size), whole[_ragged(held[of], size)]
            size = np.diff(met)[of]
            p, q = np.repeat(np.arange(b - a), size), poly[_ragged(met[of], size)]
            px, py = x[a:b][p], y[a:b][p]
            near = (px >= self.box[0][q]) & (px <= self.box[2][q]) & (py >= self.box[1][q]) & (py <= self.box[3][q])
            p, q = p[near], q[near]
            inside = self.judged(px[near], py[near], q, False)[0]
            code = np.sort(np.concatenate([i * n + j, p[inside] * n + q[inside]]))
            offsets = np.searchsorted(code, np.arange(b - a + 1) * n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pt.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), self.key.take(pa.array(code % n)))], ["pt", "held"])
            a = b

    def least(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Polygons are tried in order of their keys, so few are tried where many hold a place."""
        x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xy")
        best, left, at, step = np.full(len(x), -1), np.arange(len(x)), 0, 8
        while at < len(self.key) and len(left):
            to = min(len(self.key), at + step)
            for a in range(0, len(left), BOXES // step):
                mine = left[a : a + BOXES // step]
                i, k = self._boxed(x[mine], y[mine], at, to)
                inside, d = self.judged(x[mine][i], y[mine][i], k)
                i, k = i[inside | (d == 0)], k[inside | (d == 0)]
                first, where = np.unique(i, return_index=True)
                best[mine[first]] = k[where]
            left, at, step = left[best[left] < 0], to, min(2 * step, 1 << 12)
        found = best >= 0
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("pt")), pa.array(found), self.key.take(pa.array(best, mask=~found))], ["pt", "found", "_key"])
