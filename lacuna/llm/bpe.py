"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by the token-byte table.

1. Each task splits its texts into pre-tokens (the public pattern, vectorised over code points) and
   explodes them with their positions, in compact form: a block of texts becomes one row with the
   number of the word at each position and, for each hash bucket, one row with the block's distinct words.
2. The rows are shuffled and sorted by bucket. All blocks' copies of a word meet there and are encoded
   once; what a task remembers are the words of one bucket.
3. The ids go back to their block, which puts them in order by position, hashes them, and decodes
   them by the table of each token's bytes.

A block's row holds a word once, however often it occurs, so a very common word costs one entry a
block. Buckets follow spark.sql.shuffle.partitions.

Null text: empty. Empty text: no tokens and the hashes of nothing. Texts may be of any length;
repeated rows are encoded each; extra columns are ignored. Empty table: empty result. The rows of
docs should come in a repeatable order (files, or a checkpoint), as a block is named by its place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lacuna.llm._packed import scattered
from lacuna.llm._text import blocks, flat, id_values, ragged

BLOCK = 10 << 20
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
#: The contractions of the pattern; the letters after the apostrophe.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    """The ranks as a tiktoken encoding, and each token's bytes: all of them joined, and the offsets."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    off = np.zeros(len(table) + 1, np.int64)
    np.cumsum([len(t) for t in table], out=off[1:])
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, np.frombuffer(b"".join(table), np.uint8), off


@lru_cache(1)
def classes() -> np.ndarray:
    """White space, letter, number or other, of each code point."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((SPACE, "White_Space"), (LETTER, "L"), (NUMBER, "N")):
        for m in regex.finditer(rf"\p{{{name}}}+", text):
            out[at[m.start() : m.end()]] = kind
    return out


def pretokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pattern's matches begin; matches tile each text."""
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[point]
    begin = np.zeros(n + 1, bool)  # a text's first character
    begin[np.searchsorted(byte_at, off)] = True
    begin[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= begin
    space = kind == SPACE
    blank = point == 32
    start = change[:n].copy()
    # a blank belongs to what follows it
    joined = np.zeros(n, bool)
    joined[1:] = change[1:n] & ~begin[1:n] & ~space[1:] & blank[:-1]
    start &= ~joined
    # the last white-space character before other text begins a match
    last = space & change[1:] & ~begin[1:]
    start |= last
    # contractions
    quote = np.flatnonzero((point == 39) & start)
    quote = quote[~joined[quote]]
    for letters in CONTRACTIONS:
        k = len(letters)
        q = quote[quote + k < n]
        hit = np.ones(len(q), bool)
        for j, b in enumerate(letters):
            hit &= (point[q + 1 + j] == b) & ~begin[q + 1 + j]
        q = q[hit]
        start[q + 1] = False
        after = q[q + 1 + k < n] + 1 + k
        start[after[(kind[after] == LETTER) & ~begin[after]]] = True
        quote = np.setdiff1d(quote, q, assume_unique=True)
    return byte_at[np.flatnonzero(start)]


def _planes(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def _unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


ROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
ROW_DDL = "block long, kind int, bucket int, a binary, b binary, c binary, d binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ROW.types, strict=True)], schema=ROW)


def _explode(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                data, off = flat(part.column(1))
                start = pretokens(data, off)
                edges = np.append(start, len(data)).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
                code, vocab = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
                # words are numbered as they come up; a word's first place is 0, any later one its number plus 1
                later = np.ones(len(code), bool)
                later[np.unique(code, return_index=True)[1]] = False
                bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in vocab), np.int64, len(vocab))
                per_doc = np.diff(np.searchsorted(start, off))
                ids, null = id_values(part.column(0))
                rows = [(block, 1, scattered(block, buckets), ids.tobytes() + (null.tobytes() if null.any() else b""), _planes(per_doc), _planes(bucket), _planes(np.where(later, code + 1, 0)))]
                by = np.argsort(bucket, kind="stable")
                for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                    mine = [vocab[i] for i in own]
                    rows.append((block, 0, int(bucket[own[0]]), _planes(np.array([len(w) for w in mine])), zstandard.compress(b"".join(mine), 6), None, None))
                yield _rows(rows)
                block += 1

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, _ = encoding(path)
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            for block, kind, bucket, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if bucket != now:  # no word is in two buckets
                    now, known = bucket, {}
                if kind == 0:
                    body, end = zstandard.decompress(b), np.cumsum(_unplanes(a)).tolist()
                    ids, count, at = [], [], 0
                    for e in end:
                        word = body[at:e]
                        at = e
                        if (got := known.get(word)) is None:
                            got = known[word] = own._encode_single_piece(word)
                        ids.extend(got)
                        count.append(len(got))
                    a, b, c = _planes(np.array(count)), _planes(np.array(ids)), None
                yield _rows([(block, kind, bucket, a, b, c, d)])

    return run


def _assemble(path: str):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, token_bytes, token_off = encoding(path)
        now, counts, ids = None, [], []
        for batch in batches:
            for block, kind, _, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != now:
                    now, counts, ids = block, [], []
                if kind == 0:
                    counts.append(_unplanes(a))
                    ids.append(_unplanes(b))
                    continue
                per_doc = _unplanes(b).astype(np.int64)
                n = len(per_doc)
                doc_ids, null = np.frombuffer(a, np.int64, n), np.frombuffer(a[8 * n :], bool) if len(a) > 8 * n else np.zeros(n, bool)
                place = np.argsort(_unplanes(c), kind="stable")  # each word's bucket -> the words as they come back
                count = np.concatenate([*counts, np.zeros(0, np.uint32)]).astype(np.int64)
                words = np.concatenate([*ids, np.zeros(0, np.uint32)])
                first, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
                first[place], size[place] = np.cumsum(count) - count, count
                word = _unplanes(d).astype(np.int64)
                new = word == 0
                word = np.where(new, np.cumsum(new) - 1, word - 1)
                edges = np.concatenate([[0], np.cumsum(per_doc)])
                rows = []
                for i in range(len(doc_ids)):
                    mine = word[edges[i] : edges[i + 1]]
                    got = words[ragged(first[mine], size[mine])]
                    text = token_bytes[ragged(token_off[got], token_off[got + np.uint32(1)] - token_off[got])]
                    rows.append((None if null[i] else int(doc_ids[i]), len(got), hashlib.sha256(got.astype("<u4")).hexdigest(), hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)
                counts, ids = [], []

    return run


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    spark, path = docs.sparkSession, path or default_path()
    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    exploded = pair.mapInArrow(_explode(buckets), ROW_DDL)
    encoded = exploded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode(path), ROW_DDL)
    return encoded.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_assemble(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
