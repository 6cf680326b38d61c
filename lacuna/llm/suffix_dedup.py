"""Removal of repeated substrings by distributed prefix doubling.

A position is ranked by the text that follows it, over growing lengths: the name of the 2k bytes from p is
made of the pair of the names of the k bytes from p and from p + k. Inside a block of texts names double
from one byte to 50 (1, 2, 4, 8, 16, 25, 50); what is alone in the corpus, or is not, Spark finds out by
shuffling and sorting names, twice:

1. Length 50. Of the 51 names that start in a position's 100 bytes the least stands for all; the
   positions that share it are a run, of which one entry is sorted: the name, and the name of all the bytes
   that the run's positions see (pairs of names at its first and its last position). A run whose name is
   alone in the corpus leaves: none of its positions can be repeated. A run of equal bytes that starts
   earlier elsewhere makes all of its positions repeated; of equal runs only the first stays.
2. Length 100, past the threshold. Positions of the runs that are left, where runs of other bytes share
   their name, are ranked one by one by the pair of names at p and p + 50. All but the first of an equal
   pair are repeated.

So whole copies cost one entry for about 26 bytes, and single positions are sorted only around the ends
of what is repeated. A very common passage costs one entry a block (lacuna.llm._packed). Names are of 64
bits and what decides a removal are pairs of them or more.

Earlier: by doc_id, then start. Null text: empty. A null doc_id is last (as is 2 ** 63 - 1, which comes back as null); rows of one doc_id count as
documents of their own, in the order of their blocks. Texts under 100 bytes hold no such string and stay.
Texts may be of any length. Extra columns are ignored. Empty table: empty result. The rows of docs should
come in a repeatable order (files, or a checkpoint), as a block is named by its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._packed import ROW_DDL, answered, by_bucket, groups, pack, rows, scattered, unpack
from lacuna.llm._text import blocks, flat, mix, ragged

BLOCK = 4 << 20
#: Bytes whose names are made at a time, so that they stay in the processor's cache.
CHUNK = 1 << 16
LENGTH = 100
HALF = LENGTH // 2
BYTE_NAMES = mix(np.arange(1, 257))
LAST = np.iinfo(np.int64).max
ASK, TEXT, STATE = 0, 1, 2


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray) -> np.ndarray:
    """The name of the HALF bytes from each position on (0 where fewer are left)."""
    out = np.zeros(len(data), np.uint64)
    for at in range(0, max(0, len(data) - HALF + 1), CHUNK):
        x = BYTE_NAMES[data[at : at + CHUNK + HALF - 1]]
        for long, more in ((1, 1), (2, 2), (4, 4), (8, 8), (16, 9), (25, 25)):
            assert more <= long
            x = pair(x[:-more], x[more:])
        out[at : at + len(x)] = x
    return out


def sliding(f, x: np.ndarray) -> np.ndarray:
    """f (minimum or maximum) over the HALF + 1 values from each position on, as far as they go."""
    out = np.empty_like(x)
    for at in range(0, len(x), CHUNK):
        y = x[at : at + CHUNK + HALF]
        for step in (1, 2, 4, 8, 16, HALF + 1 - 32):
            z = y.copy()
            f(y[:-step], y[step:], out=z[:-step]) if len(y) > step else None
            y = z
        out[at : at + CHUNK] = y[:CHUNK]
    return out


class Block:
    """The texts of a block in order of doc_id, with the positions at which LENGTH bytes begin."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, off: np.ndarray):
        self.ids, self.data, self.off = ids, data, off
        size = np.maximum(np.diff(off) - LENGTH + 1, 0)
        self.starts, self.doc_of = ragged(off[:-1], size), np.repeat(np.arange(len(ids)), size)

    @classmethod
    def read(cls, part: pa.RecordBatch) -> Block:
        ids = pc.fill_null(part.column(0), LAST).to_numpy(zero_copy_only=False)
        data, off = flat(part.column(1))
        order = np.argsort(ids, kind="stable")
        size = np.diff(off)[order]
        return cls(ids[order], data[ragged(off[:-1][order], size)], np.concatenate([[0], np.cumsum(size)]))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return pack(self.ids), pack(np.diff(self.off)), zstandard.compress(self.data.tobytes(), 3)

    @classmethod
    def unpacked(cls, a: bytes, b: bytes, c: bytes) -> Block:
        return cls(unpack(a, np.int64), np.frombuffer(zstandard.decompress(c), np.uint8), np.concatenate([[0], np.cumsum(unpack(b, np.int64))]))


class Runs:
    """Neighbouring positions of one text with the same least name (at most HALF + 1 of them), and their distinct entries.

    first, last: positions; entry: the number of each run's entry; leads: whether it is its entry's first run.
    Entries are sorted by bucket, name and bytes.
    """

    def __init__(self, block: Block, buckets: int):
        self.h = h = names(block.data)
        p = block.starts
        self.least = least = sliding(np.minimum, h)[p]
        new = np.ones(len(p) + 1, bool)
        new[1:-1] = (least[1:] != least[:-1]) | (block.doc_of[1:] != block.doc_of[:-1])
        begun = np.flatnonzero(new)
        since = np.arange(len(p)) - np.repeat(begun[:-1], np.diff(begun))
        new[:-1] |= since % (HALF + 1) == 0
        edge = np.flatnonzero(new)
        self.first, self.last = p[edge[:-1]], p[edge[1:] - 1]
        name = least[edge[:-1]]
        seen = pair(pair(pair(h[self.first], h[self.first + HALF]), pair(h[self.last], h[self.last + HALF])), (self.last - self.first).astype(np.uint64))
        bucket = (name % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((seen, name, bucket))
        other = np.ones(len(order), bool)
        other[1:] = (name[order][1:] != name[order][:-1]) | (seen[order][1:] != seen[order][:-1])
        self.leads, self.entry = np.zeros(len(order), bool), np.empty(len(order), np.int64)
        self.leads[order[other]] = True  # equal ones stay in the order of positions
        self.entry[order] = np.cumsum(other) - 1
        lead = order[other]
        self.name, self.seen, self.bucket = name[lead], seen[lead], bucket[lead]
        self.doc = block.ids[block.doc_of[edge[:-1]][lead]] if len(lead) else np.zeros(0, np.int64)

    def periodic(self, block: Block) -> np.ndarray:
        """Runs that may hold the same bytes twice: near two places of their least name, at most HALF apart."""
        floor = np.zeros(len(self.h) + HALF, np.uint64)
        floor[HALF + block.starts] = self.least
        place = np.flatnonzero((sliding(np.maximum, floor)[: len(self.h)] == self.h) & (self.h > 0))
        twice = np.flatnonzero((np.diff(place) <= HALF) & (self.h[place[1:]] == self.h[place[:-1]])) if len(place) else place
        out = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(out, np.searchsorted(self.last, place[twice] - HALF), 1)
        np.add.at(out, np.searchsorted(self.first, place[twice + 1], side="right") if len(twice) else place[:0], -1)
        return np.cumsum(out)[:-1] > 0


class Positions:
    """Single positions by the pair of names at p and p + HALF; entries as in Runs."""

    def __init__(self, block: Block, first: np.ndarray, last: np.ndarray, buckets: int):
        size = last - first + 1
        seen = ragged(first, size + LENGTH - 1)  # the bytes of each stretch, one after the other
        h = names(block.data[seen])
        at = ragged(np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1), size)
        self.place = seen[at]
        a, b = h[at], h[at + HALF]
        bucket = (pair(a, b) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((b, a, bucket))
        other = np.ones(len(order), bool)
        other[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.leads, self.entry = np.zeros(len(order), bool), np.empty(len(order), np.int64)
        self.leads[order[other]] = True
        self.entry[order] = np.cumsum(other) - 1
        lead = order[other]
        self.name, self.seen, self.bucket = a[lead], b[lead], bucket[lead]
        self.doc = block.ids[np.searchsorted(block.off, self.place[lead], side="right") - 1] if len(lead) else np.zeros(0, np.int64)


def _asked(block: int, e: Runs | Positions) -> list[tuple]:
    return [(block, ASK, k, pack(e.name[s]), pack(e.seen[s]), pack(e.doc[s]), None) for k, s in by_bucket(e.bucket)]


def _sorted(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """All entries of a bucket by name, bytes, doc_id and block: that order, the row of each, and where names and bytes change."""
    name, seen, doc = (np.concatenate([unpack(r[k], t) for r in held]) for k, t in ((3, np.uint64), (4, np.uint64), (5, np.int64)))
    row = np.repeat(np.arange(len(held)), [len(unpack(r[3], np.uint64)) for r in held])
    turn = np.argsort(np.argsort([r[0] for r in held], kind="stable"))[row]
    order = np.lexsort((turn, doc, seen, name))
    change = np.ones(len(order), bool)
    change[1:] = name[order][1:] != name[order][:-1]
    other = change.copy()
    other[1:] |= seen[order][1:] != seen[order][:-1]
    return order, row, change, other


def _replies(held: list[tuple], row: np.ndarray, code: np.ndarray) -> list[tuple]:
    edges = np.searchsorted(row, np.arange(len(held) + 1))
    return [(r[0], ASK, r[2], pack(code[edges[i] : edges[i + 1]]), None, None, None) for i, r in enumerate(held)]


#: The answers for runs: the only entry of its name; equal bytes are earlier elsewhere; the first of its bytes, others share the name; the first, and no other bytes share it.
ALONE, LATER, SHARED, ONLY = 0, 1, 2, 3


def _rank_runs(held: list[tuple]) -> list[tuple]:
    order, row, change, other = _sorted(held)
    group = np.cumsum(change) - 1
    entries, kinds = np.bincount(group), np.bincount(group, other).astype(np.int64)
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(entries[group] == 1, ALONE, np.where(~other, LATER, np.where(kinds[group] > 1, SHARED, ONLY)))
    return _replies(held, row, code)


def _rank_positions(held: list[tuple]) -> list[tuple]:
    order, row, _, other = _sorted(held)
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(other, ONLY, LATER)
    return _replies(held, row, code)


def _codes(held: list[tuple]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(unpack(r[3], np.uint8) for r in held if r[1] == ASK)])


def _read(limit: int, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() << 32
            for part in blocks(batch, "text", limit):
                yield rows(made(number, Block.read(part)))
                number += 1

    return run


def _second(buckets: int):
    """From the answers for runs: what is repeated, and the positions that are to be ranked one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in groups(batches, "block"):
            block = Block.unpacked(*next(r[3:6] for r in held if r[1] == TEXT))
            runs = Runs(block, buckets)
            code = _codes(held)[runs.entry]
            gone = (code == LATER) | ~runs.leads
            single = ~gone & ((code == SHARED) | runs.periodic(block))
            some = [runs.first[gone], runs.last[gone], runs.first[single], runs.last[single]]
            yield rows([(number, STATE, scattered(number, buckets), *(pack(x.astype(np.int32 if len(block.data) < 1 << 31 else np.int64)) for x in some)), *_asked(number, Positions(block, runs.first[single], runs.last[single], buckets))])

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(buckets: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "block"):
            block = Block.unpacked(*next(r[3:6] for r in held if r[1] == TEXT))
            wide = np.int32 if len(block.data) < 1 << 31 else np.int64
            first, last, one, other = (unpack(b, wide).astype(np.int64) for b in next(r[3:7] for r in held if r[1] == STATE))
            single = Positions(block, one, other, buckets)
            again = single.place[(_codes(held)[single.entry] == LATER) | ~single.leads]
            begins = np.zeros(len(block.data) + 1, np.int32)
            begins[ragged(first, last - first + 1)] = 1
            begins[again] = 1
            so_far = np.concatenate([[0], np.cumsum(begins)])
            n = len(block.data)
            at = np.arange(n)
            gone = so_far[at + 1] > so_far[np.maximum(at + 1 - LENGTH, 0)]
            total = np.concatenate([[0], np.cumsum(gone)])
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            edge = block.off[:-1][np.diff(block.off) > 0]
            rise[edge] = gone[edge]
            spans = np.concatenate([[0], np.cumsum(rise)])
            found = []
            for i, (a, b) in enumerate(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)):
                kept = block.data[a:b][~gone[a:b]].tobytes()
                found.append((None if block.ids[i] == LAST else int(block.ids[i]), b - a, int(total[b] - total[a]), int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), RESULT.types, strict=True)], schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left; null without texts) of every row.

    A cut may fall inside a character, so kept are bytes.
    """
    # a block's name holds the number of its partition of docs, which is the same wherever docs is read again
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.spark_partition_id().alias("part"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answer(asked: DataFrame, rank) -> DataFrame:
        return asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answered(rank), ROW_DDL)

    def back(answers: DataFrame) -> DataFrame:
        body = own.mapInArrow(_read(BLOCK, lambda number, block: [(number, TEXT, -1, *block.packed(), None)]), ROW_DDL)
        return answers.unionByName(body).repartition("block").sortWithinPartitions("block", "kind", "bucket")

    runs = own.mapInArrow(_read(BLOCK, lambda number, block: _asked(number, Runs(block, buckets))), ROW_DDL)
    positions = back(answer(runs, _rank_runs)).mapInArrow(_second(buckets), ROW_DDL)
    return back(answer(positions, _rank_positions)).mapInArrow(_apply(buckets, texts), RESULT_DDL)


def digest(docs: DataFrame) -> DataFrame:
    """The counts and hashes of remove_repeats, without the bytes."""
    return remove_repeats(docs, texts=False).drop("kept")
