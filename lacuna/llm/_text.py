"""Arrow string columns as flat numpy arrays, and the session helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lacuna.operators.graph import cut  # noqa: F401

#: Bytes of text that are turned into numpy arrays at a time; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def id_values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of 64-bit ids, 0 where it is null, and where it is null; exact for every id."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most limit bytes together (one row at least)."""
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The maximal runs of bytes that are not separators, none across two texts.

    start, end: byte spans; bounds[i] to bounds[i + 1]: the words of text i; code: a number for each
    distinct word, exact; vocab: the distinct words as a binary array.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = ASCII_SPACE):
        inside = ~separator[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        size = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=size[1:])
        body = data[inside]
        words = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(size), pa.py_buffer(body)])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab = coded.dictionary
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... (count[i] of them), one i after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df
