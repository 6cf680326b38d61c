"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors of cosine c or more are at most 2 - 2c apart in squared distance. All vectors are
rotated to the principal axes of the whole table and their axes are dealt to BLOCKS blocks in turn,
so that each block leads with an axis of large variance. Each block gets a share of the squared
distance in proportion to its variance: a pair within the whole budget is within the budget of one
block at least (pigeonhole). So for each block a range join on a grid over its two leading axes, whose
cells are SPAN times as wide as the block's budget, meets every pair that it is responsible for: a
vector goes to its own cell, and to those neighbours before it whose border is within the budget. A
pair is taken at the first block whose budget it keeps.

What travels are rotated coordinates in 16 bits. Distances of these are exact integers, and their
rounding is bounded, so most pairs are told apart by them; the few that are too close to the threshold
are verified by their exact cosine, and only for these the vectors themselves are fetched.

Equal vectors of a label are one class with a weight. A cell of more than CHUNK members is dealt over
slices along the block's third axis, which meet where they are within the budget; pairs of vectors
exist in a task's matrices only. What leaves a task are sums of links and a spanning forest of them.
The rotation is a d x d matrix for each length d of vectors, summed up on the executors.

Null labels and vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths link with nothing; a cosine of exactly the threshold links. Rows
that share a vec_id count as vectors of their own in n_links (the largest of the id's is given) and as
one node of the components. A null vec_id links with nothing and is kept. Extra columns are ignored.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._text import cut
from lacuna.operators.graph import connected_components

BLOCKS, CHUNK, SPAN, MIN_COSINE = 4, 4096, 3, 0.93
#: Slices of a crowded cell along its third axis; beyond that, members are dealt by hash.
SLICES = 32
#: Rows of a matrix of pairs.
TILE, WIDE = 256, 1024
#: The 16-bit value of a coordinate 1.
UNIT = 32767
#: Allowance for the rounding of rotated coordinates before they are stored, in units of 16 bits.
SLACK = 0.01


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, prints, vectors = [], [], [], []
        for i, label, x in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if x is None or label is None or not x:
                continue
            v = np.array([np.nan if y is None else y for y in x], np.float64)
            if np.isfinite(v).all() and v.any():
                raw = (v + 0.0).tobytes()
                ids.append(i)
                labels.append(label)
                vectors.append(raw)
                prints.append(hashlib.blake2b(raw, key=hashlib.blake2b(label.encode(), digest_size=32).digest(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(prints, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "print", "v"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(raw: list[bytes]) -> dict[int, list[int]]:
    by: dict[int, list[int]] = {}
    for i, v in enumerate(raw):
        by.setdefault(len(v) // 8, []).append(i)
    return by


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the sum of outer products of a task's unit vectors, for each length."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        raw = batch.column(0).to_pylist()
        for dim, own in _by_length(raw).items():
            x = _unit([raw[i] for i in own])
            total[dim] = total.get(dim, 0) + x.T @ x
    rows = [(d, i, s[i].tobytes()) for d, s in total.items() for i in range(d)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["dim", "i", "s"])


def _added(table: pa.Table) -> pa.Table:
    rows = np.frombuffer(b"".join(table.column("s").to_pylist()), np.float64).reshape(table.num_rows, -1)
    return table.slice(0, 1).set_column(2, "s", pa.array([rows.sum(axis=0).tobytes()], pa.binary()))


def _plan(rows: list, budget: float) -> dict[int, tuple[np.ndarray, list[float]]]:
    """For each length: the rotation, its axes ordered block by block, and the radius of each block's budget in units of 16 bits."""
    sums: dict[int, dict[int, bytes]] = {}
    for r in rows:
        sums.setdefault(r["dim"], {})[r["i"]] = r["s"]
    plan = {}
    for dim, own in sums.items():
        s = np.frombuffer(b"".join(bytes(own[i]) for i in range(dim)), np.float64).reshape(dim, dim)
        value, vector = np.linalg.eigh(s / np.trace(s))
        order = np.argsort(-value)
        blocks = [order[b::BLOCKS] for b in range(min(BLOCKS, dim))]
        share = np.array([max(value[b].sum(), 0) + 1e-6 for b in blocks])
        radius = np.sqrt(budget * share / share.sum()) * UNIT + np.sqrt([len(b) for b in blocks]) + SLACK
        plan[dim] = (vector[:, np.concatenate(blocks)], radius.tolist())
    return plan


def _edges(dim: int, n: int) -> np.ndarray:
    return np.cumsum([0] + [len(range(b, dim, n)) for b in range(n)])


PLACED = "grp string, block int, cx long, cy long, home boolean, slice_at int, reach int, rep long, cid long, w long, y binary"


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, cid, w, label, v = (c.to_pylist() for c in batch.columns)
            rows = []
            for dim, own in _by_length(v).items():
                rotation, radius = plan[dim]
                y = np.rint(_unit([v[i] for i in own]) @ rotation * UNIT).astype(np.int16)
                edge, raw = _edges(dim, len(radius)), [x.tobytes() for x in y]
                for b, r in enumerate(radius):
                    reach = ceil(r)
                    width = SPAN * reach
                    lead = np.zeros((len(own), 3), np.int64)
                    lead[:, : min(3, edge[b + 1] - edge[b])] = y[:, edge[b] : min(edge[b] + 3, edge[b + 1])]
                    cell = lead[:, :2] // width
                    low = lead[:, :2] - cell * width < reach
                    high = (cell + 1) * width - lead[:, :2] <= reach
                    for dx, dy, there in ((0, 0, np.ones(len(own), bool)), (-1, 0, low[:, 0]), (0, -1, low[:, 1]), (-1, -1, low.all(axis=1)), (-1, 1, low[:, 0] & high[:, 1])):
                        for k in np.flatnonzero(there).tolist():
                            i = own[k]
                            rows.append((f"{label[i]}/{dim}", b, int(cell[k, 0]) + dx, int(cell[k, 1]) + dy, not (dx or dy), int(lead[k, 2]), reach, rep[i], cid[i], w[i], raw[k]))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PLACED.split(", ")])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """A component number for each of n nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _pairs(y: np.ndarray, w: np.ndarray, first: np.ndarray, other: np.ndarray, ordered: bool, block: int, radius: list[float], far: float):
    """Of the pairs first x other that this block is the first to meet: each row's sum of links, a forest of the surely linked, and the pairs too close to tell.

    Squared block distances come from matrix products, exact as coordinates are integers, for a tile of
    TILE x WIDE pairs at a time; of a tile's links only sums and a forest are kept.
    """
    dim = y.shape[1]
    edge, links = _edges(dim, len(radius)), np.zeros(len(y))
    trees, close = [], []
    rounding = sqrt(dim) + SLACK
    parts = [slice(edge[b], edge[b + 1]) for b in range(len(radius))]
    for a in range(0, len(first), TILE):
        f = first[a : a + TILE]
        left = y[f].astype(np.float64)
        for c in range(0, len(other), WIDE):
            o = other[c : c + WIDE]
            right = y[o].astype(np.float64)
            gap = lambda p: np.einsum("ij,ij->i", left[:, p], left[:, p])[:, None] + np.einsum("ij,ij->i", right[:, p], right[:, p]) - 2 * left[:, p] @ right[:, p].T  # noqa: B023, E731
            total = gap(parts[block])
            mine = total <= radius[block] ** 2
            if ordered:  # each pair of one set once
                mine &= f[:, None] < o
            if not mine.any():
                continue
            for b, p in enumerate(parts):
                if b != block:
                    by = gap(p)
                    if b < block:
                        mine &= by > radius[b] ** 2
                    total += by
            total = np.sqrt(total)
            sure = mine & (total + rounding <= far)
            i, j = np.nonzero(mine & ~sure & (total - rounding <= far))
            close.append((f[i], o[j]))
            i, j = np.nonzero(sure)
            if len(i):
                links[f] += sure @ w[o].astype(np.float64)
                links[o] += w[f].astype(np.float64) @ sure
                rows = np.concatenate([f, o])
                root = _forest(i, j + len(f), len(rows))
                hit = np.unique(np.concatenate([i, j + len(f)]))
                trees.append((rows[hit], rows[root[hit]]))
    join = lambda found: tuple(np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return links, join(trees), join(close)


FOUND = "rep long, cid long, other long, other_cid long, links long, sure boolean"


def _join(plan, min_cosine: float):
    """A cell, or two slices of one (chunk <= chunk_2; side tells them apart): sums of links, a forest, and what is too close to tell."""
    far = sqrt(2 - 2 * min_cosine) * UNIT

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        home, side = table.column("home").to_numpy(), table.column("side").to_numpy()
        rep, cid, w = (table.column(c).to_numpy() for c in ("rep", "cid", "w"))
        y = np.frombuffer(b"".join(table.column("y").to_pylist()), np.int16).reshape(len(rep), -1)
        radius = plan[y.shape[1]][1]
        meets = []
        if table.column("same")[0].as_py():
            meets = [(np.flatnonzero(home), np.flatnonzero(home), True), (np.flatnonzero(home), np.flatnonzero(~home), False)]
        else:
            meets = [(np.flatnonzero(home & (side == 0)), np.flatnonzero(side == 1), False), (np.flatnonzero(~home & (side == 0)), np.flatnonzero(home & (side == 1)), False)]
        found = [_pairs(y, w, f, o, ordered, block, radius, far) for f, o, ordered in meets if len(f) and len(o)]
        i, j, p, q = (np.concatenate([x[k][e] for x in found]) if found else np.zeros(0, np.int64) for k, e in ((1, 0), (1, 1), (2, 0), (2, 1)))
        links = sum((x[0] for x in found), np.zeros(len(rep))).astype(np.int64)
        root, hit = _forest(i, j, len(rep)), np.flatnonzero(links)
        cols = [np.concatenate([x[hit], x[p]]) for x in (rep, cid)] + [np.concatenate([x[root[hit]], x[q]]) for x in (rep, cid)]
        cols += [np.concatenate([links[hit], np.zeros(len(p), np.int64)]), np.arange(len(hit) + len(p)) < len(hit)]
        return pa.table([pa.array(c) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _exact(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                x, z = (np.frombuffer(v, np.float64) for v in (a, b))
                x, z = x / np.abs(x).max(), z / np.abs(z).max()
                keep.append(bool(x @ z / np.sqrt((x @ x) * (z @ z)) >= min_cosine))
            yield pa.RecordBatch.from_arrays(batch.columns[:6], ["rep", "cid", "other", "other_cid", "w", "other_w"]).filter(pa.array(keep, pa.bool_()))

    return run


def _met(placed: DataFrame) -> DataFrame:
    """The rows that meet in a task: a whole cell, or two slices of a crowded one."""
    at = ["grp", "block", "cx", "cy"]
    share = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cells = placed.groupBy(*at).agg(F.count("*").alias("m"), F.count_if("home").alias("homes"), F.percentile_approx("slice_at", share).alias("marks")).where("homes > 0 AND m > 1")
    own = placed.join(cells, at)
    slices = f"ceil(m / {CHUNK})"
    # some of the marks, as many as there are slices; what SLICES can't hold is dealt by a hash beside them
    slice_of = F.expr(f"size(filter(marks, (x, i) -> x < slice_at AND (i + 1) * least({slices}, {SLICES}) div {SLICES} > i * least({slices}, {SLICES}) div {SLICES}))")
    own = own.withColumn("chunk", F.when(F.col("m") > CHUNK, slice_of * F.expr(f"ceil({slices} / {SLICES})") + F.expr(f"pmod(xxhash64(rep, cid), ceil({slices} / {SLICES}))")).otherwise(0).cast("long"))
    whole = own.where(f"m <= {CHUNK}").select(*at, F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("same"), F.lit(0).alias("side"), "home", "rep", "cid", "w", "y")
    crowded = own.where(f"m > {CHUNK}")
    chunks = crowded.groupBy(*at, "chunk").agg(F.min("slice_at").alias("low"), F.max("slice_at").alias("high"), F.max("reach").alias("reach"))
    left, right = (chunks.select(*at, F.col("chunk").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"), *(["reach"] if c == "a" else [])) for c in "ab")
    pairs = left.join(right, at).where("a <= b AND low_b - high_a <= reach AND low_a - high_b <= reach").select(*at, "a", "b")
    sides = pairs.select(*at, "a", "b", F.expr("a = b").alias("same"), F.lit(0).alias("side"), F.col("a").alias("chunk")).unionByName(pairs.where("a < b").select(*at, "a", "b", F.lit(False).alias("same"), F.lit(1).alias("side"), F.col("b").alias("chunk")))
    return whole.unionByName(crowded.join(sides, [*at, "chunk"]).select(whole.columns))


def components(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("embedding"))
    valid = cut(own.where("vec_id IS NOT NULL").mapInArrow(_valid, "vec_id long, label string, print binary, v binary"))
    classes = cut(valid.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("cid", F.xxhash64("print")))
    moments = valid.select("v").mapInArrow(_moments, "dim int, i int, s binary").groupBy("dim", "i").applyInArrow(_added, "dim int, i int, s binary")
    plan = _plan(moments.collect(), 2 - 2 * min_cosine)  # a matrix for each length of vectors
    placed = cut(classes.select("rep", "cid", "w", "label", "v").mapInArrow(_place(plan), PLACED))
    found = cut(_met(placed).groupBy("grp", "block", "cx", "cy", "a", "b").applyInArrow(_join(plan, min_cosine), FOUND))

    end = lambda p, c: classes.select(F.col("rep").alias(p), F.col("cid").alias(c), F.col("w").alias(f"{p}_w"), F.col("v").alias(f"{p}_v"))
    close = found.where("NOT sure").join(end("rep", "cid"), ["rep", "cid"]).join(end("other", "other_cid"), ["other", "other_cid"])
    close = close.select("rep", "cid", "other", "other_cid", "rep_w", "other_w", "rep_v", "other_v").mapInArrow(_exact(min_cosine), "rep long, cid long, other long, other_cid long, w long, other_w long")
    ends = close.select("rep", "cid", "other", "other_cid", F.col("other_w").alias("links")).unionByName(close.select(F.col("other").alias("rep"), F.col("other_cid").alias("cid"), F.col("rep").alias("other"), F.col("cid").alias("other_cid"), F.col("w").alias("links")))
    found = cut(found.where("sure").drop("sure").unionByName(ends))

    links = found.groupBy("rep", "cid").agg(F.sum("links").alias("links"))
    rows = valid.select("vec_id", "print").join(classes.select("print", "rep", "cid", "w"), "print")
    named = connected_components(found.select(F.col("other").alias("a"), F.col("rep").alias("b")).unionByName(rows.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))))
    per_row = rows.join(links, ["rep", "cid"], "left").groupBy("vec_id").agg(F.max(F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = own.select("vec_id").join(per_row, "vec_id", "left").join(named.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT d.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, d.vec_id = c.component_id AS kept
FROM embeddings d JOIN c ON c.id = d.vec_id LEFT JOIN n ON n.x = d.vec_id
"""
