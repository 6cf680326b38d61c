"""Rows that carry numpy arrays between blocks of texts and buckets of keys.

A block (texts of a few megabytes) sends each bucket one row with the distinct keys that it holds there, so
a key costs one entry a block however often it occurs; the bucket's answer goes back to the block in
the same order. Spark partitions, shuffles and sorts the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
ROW_DDL = "block long, kind int, bucket int, a binary, b binary, c binary, d binary"


def pack(x: np.ndarray, level: int = 1) -> bytes:
    """An array's bytes, all lowest ones first, then all second ones and so on, compressed."""
    wide = x.dtype.itemsize
    raw = np.ascontiguousarray(x).view(np.uint8)
    if wide > 1:
        raw = np.ascontiguousarray(raw.reshape(-1, wide).T)
    return zstandard.compress(raw.tobytes(), level)


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(dtype).ravel() if wide > 1 else raw.view(dtype)


def rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[] for _ in ROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)


def scattered(block: int, buckets: int) -> int:
    """A bucket for a row that only has to be somewhere; even for any numbering of the blocks."""
    return xxhash.xxh64_intdigest(block.to_bytes(8, "little")) % buckets


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each value of a column by which they come sorted."""
    now, held = None, []
    place = ROW.get_field_index(column)
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if row[place] != now:
                if held:
                    yield now, held
                now, held = row[place], []
            held.append(row)
    if held:
        yield now, held


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket and its slice, of entries sorted by bucket."""
    if len(bucket):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(bucket[a]), slice(a, b)


def answered(answer: Callable[[list[tuple]], list[tuple]]):
    """A map over rows sorted by bucket: answer() turns a bucket's rows of kind 0 into rows, all others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "bucket"):
            rest = [r for r in held if r[1]]
            if rest:
                yield rows(rest)
            asked = [r for r in held if not r[1]]
            if asked:
                yield rows(answer(asked))

    return run
