"""Near-duplicates by min-max hashing, every link confirmed on full shingle sets.

1. Each text's set of distinct five-word shingles gives, under each of PERMUTATIONS hash functions,
   both its least and its greatest value: two signature entries for one evaluation. BANDS bands of
   ROWS entries each (minima and maxima in bands of their own) are hashed to bucket keys; four bits of
   every entry make a sketch. Texts with one set are one class; only the class's least id goes on.
2. Members of a bucket whose sketches may belong to similar sets are joined to candidate groups, by a
   spanning star for each bucket, not by pairs. A bucket of more than CROWD members is joined whole.
3. Each candidate group travels once, as texts, to a task that finds the components of its links on the
   full sets: rarest shingles first, similar sets share one of their first shingles, and pairs within a
   component found already aren't looked at. What leaves the task is a spanning star of each component.
4. A group of more than MEMBERS texts (or SHINGLES shingles) is dealt over tiles, each with the same few
   hubs. Afterwards what isn't in the group's largest component meets every tile, so that no pair of
   different components is left out.

A link needs 100 * intersection >= 75 * union of the full sets. A pair of similarity 0.75 shares no
bucket with probability 1.2e-8, and fails the comparison of sketches with probability below 2e-8. For k
texts in a group of which r are outside its largest component after the tiles, 2 k r / MEMBERS texts
travel in step 4; everything else grows with the number of texts.

Null and empty texts and those without words: empty set, linked with nothing, kept. Fewer than five
words: the whole sequence is the one shingle. Rows that share a doc_id are one node, also with several
texts. A row without doc_id can't be named: it is linked with nothing, has no component_id and is kept.
Extra columns are ignored by `components` and kept by `keep_first`. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm._text import LOWER, Words, blocks, cut, flat, mix, ragged
from lacuna.operators.graph import connected_components

WORDS, PERMUTATIONS, ROWS = 5, 96, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket whose sketches are compared in one task.
CROWD = 4096
#: Bounds of what a task verifies at a time; a single text may have more shingles.
MEMBERS, SHINGLES = 1024, 2_000_000
#: A tile of a large group has a hub for so many members.
PER_HUB = 8
#: Standard deviations by which a sketch may fall short of the similarity asked for.
SIGMAS = 5.6
MULTIPLIER = (mix(np.arange(1, PERMUTATIONS + 1)) | np.uint64(1)).tolist()
STAR = "a long, b long"


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, and the len + 1 offsets."""
    data, off = flat(col)
    w = Words(LOWER[data], off)
    word = np.fromiter((xxhash.xxh64_intdigest(x) for x in w.vocab.to_pylist()), np.uint64, len(w.vocab))[w.code] if len(w.code) else np.zeros(0, np.uint64)
    size = np.diff(w.bounds)
    n = len(word)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(np.arange(n) + WORDS <= w.bounds[1:][w.doc]) if n else np.zeros(0, np.int64)
        key = np.full(len(full), WORDS, np.uint64)
        for k in range(WORDS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ word[full + k])
        few = np.flatnonzero((size > 0) & (size < WORDS))
        short = np.zeros(len(few), np.uint64)
        for i, d in enumerate(few.tolist()):
            k = np.array([size[d]], np.uint64)
            for x in word[w.bounds[d] : w.bounds[d + 1]]:
                k = mix(k * np.uint64(0x9E3779B97F4A7C15) ^ x)
            short[i] = k[0]
    doc = np.concatenate([w.doc[full], few])
    key = np.concatenate([key, short])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(col) + 1))


def signatures(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text with shingles a row of BANDS bucket keys, and its sketch of PERMUTATIONS bytes."""
    start = bounds[:-1][np.diff(bounds) > 0]
    low, high = np.empty((PERMUTATIONS, len(start)), np.uint64), np.empty((PERMUTATIONS, len(start)), np.uint64)
    if len(start):
        with np.errstate(over="ignore"):
            for p, m in enumerate(MULTIPLIER):
                h = key * np.uint64(m)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                low[p], high[p] = np.minimum.reduceat(h, start), np.maximum.reduceat(h, start)
    with np.errstate(over="ignore"):
        rows = np.concatenate([low, high]).reshape(BANDS, ROWS, len(start))
        out = np.repeat(mix(np.arange(BANDS))[:, None], len(start), 1)
        for r in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, r])
    bits = np.uint64(15)
    sketch = ((low & bits) | ((high & bits) << np.uint64(4))).astype(np.uint8)
    return out.T.view(np.int64), np.ascontiguousarray(sketch.T)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text"):
            key, bounds = shingles(part.column(1))
            size = np.diff(bounds)
            some = size > 0
            bands, sketch = signatures(key, bounds)
            offsets = np.zeros(part.num_rows + 1, np.int32)
            np.cumsum(np.where(some, BANDS, 0), out=offsets[1:])
            prints = [hashlib.blake2b(key[a:b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            rows = iter(sketch)
            sketches = [next(rows).tobytes() if x else None for x in some.tolist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size.astype(np.int64)), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(bands).ravel()))],
                ["doc_id", "n_shingles", "print", "sketch", "bands"],
            )


def least_matches(threshold: int) -> int:
    """Equal entries that the sketches of two sets of this similarity have, but for SIGMAS deviations."""
    k = 2 * PERMUTATIONS
    p = threshold / 100 + (1 - threshold / 100) / 16
    return int(k * p - SIGMAS * sqrt(k * p * (1 - p)))


def matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of equal entries of sketches given as rows of 64-bit words."""
    z = x ^ y
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    z &= np.uint64(0x1111111111111111)
    return 2 * PERMUTATIONS - np.bitwise_count(z).sum(axis=-1, dtype=np.int64)


def _alike(sketch: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """For each member of a bucket the first member of its component by sketches and sizes."""
    need, root = least_matches(threshold), np.full(len(n), -1)
    left = np.arange(len(n))
    for s in range(len(n)):
        if root[s] >= 0:
            continue
        root[s] = s
        left, stack = left[left != s], [s]
        while stack and len(left):
            x = stack.pop()
            m = n[left]
            hit = (100 * np.minimum(m, n[x]) >= threshold * np.maximum(m, n[x])) & (matches(sketch[left], sketch[x]) >= need)
            found = left[hit]
            root[found] = s
            stack += found.tolist()
            left = left[~hit]
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, which come sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last, at = tuple(c[-1] for c in cols), 0
        for to in np.flatnonzero(new).tolist():
            if rest or to > at:
                yield pa.Table.from_batches([*rest, batch.slice(at, to - at)])
            rest, at = [], to
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


def _candidates(threshold: int):
    """From bucket, rep, n, sketch, sorted by bucket and rep: a star for each component of a bucket's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, 1):
            rep, n = group.column(1).to_numpy(), group.column(2).to_numpy()
            sketch = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint64).reshape(len(rep), -1)
            root = _alike(sketch, n, threshold)
            other = np.flatnonzero(rep[root] != rep)
            a.append(rep[root[other]])
            b.append(rep[other])
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def linked(sets: list[np.ndarray], label: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A star (least label, label) for each component of the links between sets; sets of one label are linked already.

    Shingles are numbered by rarity. Sets of the given similarity share one of their first
    n - ceil(threshold * n / 100) + 1; only sets that do, of different components so far, are compared.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    code = rank[inverse]
    order = np.lexsort((code, owner))
    code, bounds = code[order], np.concatenate([[0], np.cumsum(size)])
    first = size - -(-threshold * size // 100) + 1
    head = ragged(bounds[:-1], first)
    by = np.argsort(code[head], kind="stable")
    posting = np.repeat(np.arange(len(sets)), first)[by]
    at = np.searchsorted(code[head][by], np.arange(len(count) + 1))
    same = np.argsort(label, kind="stable")
    names, begin = np.unique(label[same], return_index=True)
    own = np.split(same, begin[1:])
    group = np.searchsorted(names, label)
    left, held, out = np.ones(len(sets), bool), np.zeros(len(count), bool), []
    for g in range(len(names)):
        if not left[own[g][0]]:
            continue
        found, stack = [g], own[g].tolist()
        left[own[g]] = False
        while stack:
            x = stack.pop()
            mine = code[bounds[x] : bounds[x + 1]]
            p = mine[: first[x]]
            met = posting[ragged(at[p], at[p + 1] - at[p])]
            met = np.unique(met[left[met]])
            met = met[100 * np.minimum(size[met], size[x]) >= threshold * np.maximum(size[met], size[x])]
            if not len(met):
                continue
            held[mine] = True
            both = np.add.reduceat(held[code[ragged(bounds[met], size[met])]].astype(np.int64), np.cumsum(size[met]) - size[met])
            held[mine] = False
            for y in np.unique(group[met[100 * both >= threshold * (size[x] + size[met] - both)]]).tolist():
                found.append(y)
                stack += own[y].tolist()
                left[own[y]] = False
        out += [(int(names[found[0]]), int(names[y])) for y in found[1:]]
    return out


def _verified(threshold: int):
    """From grp, tile, chunk, label, text, sorted by the first three: the stars of each of these groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets, labels = None, [], []

        def stars() -> pa.RecordBatch:
            found = linked(sets, np.array(labels, np.int64), threshold) if sets else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for part in blocks(batch, "text"):
                key, bounds = shingles(part.column(4))
                for i, row in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True)):
                    if row[:3] != last:
                        yield stars()
                        last, sets, labels = row[:3], [], []
                    if bounds[i + 1] > bounds[i]:
                        sets.append(key[bounds[i] : bounds[i + 1]].copy())
                        labels.append(row[3])
        yield stars()

    return run


def _verify(rows: DataFrame, threshold: int) -> DataFrame:
    rows = rows.select("grp", "tile", "chunk", "label", "text").repartition("grp", "tile", "chunk").sortWithinPartitions("grp", "tile", "chunk")
    return rows.mapInArrow(_verified(threshold), STAR)


def _tiles(n: str = "count(*)", weight: str = "sum(n)") -> F.Column:
    """How many tasks a group is dealt over."""
    return F.expr(f"CAST(ceil(greatest({n} / {MEMBERS}, {weight} / {SHINGLES})) AS LONG)")


def _across(work: DataFrame, found: DataFrame, threshold: int) -> DataFrame:
    """Links between different components of groups on several tiles: all outside the largest meet all."""
    named = work.where("tiles > 1").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    sizes = named.groupBy("grp", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    top = sizes.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max("m").alias("top_m"), F.max_by("w", F.struct("m", "label")).alias("top_w"))
    top = top.where("m > top_m").select("grp", "top", _tiles("(m - top_m)", "(w - top_w)").alias("chunks"))
    named = cut(named.join(top, "grp").withColumn("chunk", F.expr("pmod(xxhash64(rep, 1), chunks)")))
    cols = ["grp", "tile", "chunk", "label", "text"]
    everyone = named.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(cols)
    outside = named.where("label <> top").withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)"))).select(cols)
    return _verify(everyone.unionByName(outside), threshold)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = cut(own.mapInArrow(_signed, "doc_id long, n_shingles long, print binary, sketch binary, bands array<long>"))
    return _named(own, signed, threshold).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(own: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    rows = signed.select("doc_id", "n_shingles", "print")
    several = _several(rows)
    classes = cut(signed.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))

    member = classes.select(F.explode("bands").alias("bucket"), "rep")
    crowds = member.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    inside = cut(member.join(crowds, "bucket"))
    near = inside.where(f"m <= {CROWD}").select("bucket", "rep").join(classes.select("rep", "n", "sketch"), "rep").select("bucket", "rep", "n", "sketch")
    near = near.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_candidates(threshold), STAR)
    whole = inside.where(f"m > {CROWD} AND rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(near.unionByName(whole).distinct()).select(F.col("id").alias("rep"), F.col("component").alias("grp"))

    groups = groups.join(classes.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    dealt = groups.join(groups.groupBy("grp").agg(F.count("*").alias("m"), _tiles().alias("tiles")), "grp")
    texts = own.withColumnRenamed("doc_id", "rep")
    work = dealt.withColumn("tile", F.expr("pmod(xxhash64(rep), tiles)")).join(texts, "rep")
    work = cut(work.dropDuplicates(["rep", "text"]) if several else work)
    hub = F.expr(f"tiles > 1 AND pmod(xxhash64(rep, 2), m) * {PER_HUB} * tiles < m")
    hubs = work.where(hub).withColumn("tile", F.explode(F.expr("sequence(0L, tiles - 1)")))
    found = cut(_verify(work.unionByName(hubs).withColumn("chunk", F.lit(0).cast("long")).withColumnRenamed("rep", "label"), threshold))
    named = connected_components(found)
    if not work.where("tiles > 1").isEmpty():
        found = cut(found.unionByName(_across(work, named, threshold)))
        named = connected_components(found)

    top = classes.select("print", "rep").join(named.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = rows.join(top, "print", "left")
    if several:  # the classes of all texts of an id are joined by it
        ends = out.where("doc_id IS NOT NULL").select(F.coalesce("component", "doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        out = rows.join(connected_components(ends).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END").alias("component_id"))


def _several(rows: DataFrame) -> bool:
    """Does an id come in several rows?"""
    return not rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").isEmpty()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    It is the row of the least id; of several rows of that id the one of the least text, and of those any.
    Rows without an id stay.
    """
    found = components(docs, id_col, text_col)
    gone, again, nth = _unused(docs, 3)
    drop = found.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    out = docs.join(drop, docs[id_col].cast("long") == drop[gone], "left_anti")
    if not _several(found):
        return out
    several = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias(again))
    same = docs[id_col].cast("long") == several[again]
    first = Window.partitionBy(again).orderBy(docs[text_col])
    picked = out.join(several, same).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth, again)
    return out.join(several, same, "left_anti").unionByName(picked)


def _unused(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has, in any case of letters."""
    lead = "_" * (1 + max((len(c) for c in df.columns), default=0))
    return [f"{lead}{i}" for i in range(n)]


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 75 * (na.n + nb.n - inter)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
