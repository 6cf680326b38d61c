"""Alignment of two tokenizers' tokens by byte-owner arrays.

A: byte-level BPE of a space and the text. B: sentence pieces of the text, which put that space themselves.
Per block of texts, np.repeat gives each byte the number of the A token and of the B token that own it.
Consecutive distinct pairs of owners are overlaps; where both owners change at once, a group ends, and
the A and the B token that end there are linked.

1. A task encodes each distinct pre-token (A) or space-led word (B) of a block once; no vocabulary entry of
   either crosses these, so the ids are those of the whole text. It aligns, hashes the groups, and sends
   one entry for each distinct id pair of the block to the bucket of its B id.
2. A bucket adds up the blocks' counts and finds each B id's highest.
3. The counts go back to the blocks, which sum them over each text's links.

Buckets follow spark.sql.shuffle.partitions; as the key is a B id, no more tasks than B has ids do step 2,
each on at most one entry for a block and pair.

Texts that are null, empty, or whose A or B tokens don't join to the space and the text again (one with U+2581,
say) have no tokens: zeros and ''. Special tokens' strings in texts are plain text. Texts may be of any
length; repeated rows each count; a null doc_id stays null; extra columns are ignored. Empty table: empty
result. What a task remembers of words is bounded (WORDS), and forgotten words are encoded again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lacuna.llm._packed import ROW_DDL, answered, by_bucket, groups, pack, rows, scattered, unpack
from lacuna.llm._text import blocks, id_values, ragged
from lacuna.llm.bpe import pretokens

BLOCK = 4 << 20
#: Distinct words whose ids a task keeps.
WORDS = 400_000
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
ASK, STATE = 0, 1
DIGITS = 6  # of an id, at most
COMMA, BAR, SEMICOLON = b",|;"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """What tokens a word has, remembered; and each token's bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], table: list[bytes]):
        self.encode, self.size = encode, np.array([len(t) for t in table], np.int64)
        self.table, self.known = table, {}

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many tokens each word has, all of them, and whether they join to the word again."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, words
        for w, ids in zip(new, self.encode(new), strict=True):
            self.known[w] = (ids, b"".join([self.table[i] for i in ids]) == w)
        got = [self.known[w] for w in words]
        count = np.fromiter((len(g[0]) for g in got), np.int64, len(got))
        return count, np.fromiter((i for g in got for i in g[0]), np.int64, int(count.sum())), np.fromiter((g[1] for g in got), bool, len(got))


@lru_cache(2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file: its entries as bytes are ranks, as merges are numbered in their order."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    own = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda words: [own.encode_ordinary(w.decode()) for w in words], table)


@lru_cache(2)
def pieces(path: str) -> Vocabulary:
    """A sentence-piece file; a word is given with its leading space, which the library puts itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)

    def bytes_of(i: int) -> bytes:
        if own.is_byte(i):
            return bytes([int(own.id_to_piece(i)[3:-1], 16)])
        return own.id_to_piece(i).replace("▁", " ").encode()

    table = [bytes_of(i) for i in range(own.get_piece_size())]
    blank = own.piece_to_id("▁")  # a text's last space; the library gives no piece for an empty text

    def encode(words: list[bytes]) -> list[list[int]]:
        return [ids or [blank] for ids in own.encode([w[1:].decode() for w in words], num_threads=1)] if words else []

    return Vocabulary(encode, table)


def spaced(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words with the spaces before them begin; every text begins with a space."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[:-1]] = True
    return np.flatnonzero(start)


def encoded(vocab: Vocabulary, data: np.ndarray, off: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the bounds of each text's ids, and whether each text's tokens join to it."""
    edges = np.append(start, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    count, ids, fine = vocab.words(words.dictionary.to_pylist())
    first = np.cumsum(count) - count
    all_ids = ids[ragged(first[code], count[code])]
    word_of = np.searchsorted(start, off)
    until = np.concatenate([[0], np.cumsum(count[code])])
    bad = np.concatenate([[0], np.cumsum(~fine[code])])
    return all_ids, until[word_of], bad[word_of[1:]] == bad[word_of[:-1]]


def _some(ids: np.ndarray, bounds: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that are ok, and their number in every text."""
    size = np.diff(bounds)
    return ids[ragged(bounds[:-1][ok], size[ok])], np.where(ok, size, 0)


class Aligned:
    """Texts (bytes with the leading space) in both tokenizers' tokens.

    a, b: ids, n_a and n_b of each text; cut_a, cut_b: the tokens that end each group; text_of: of each
    group; overlaps: how many pairs of tokens share bytes.
    """

    def __init__(self, texts: list[bytes], a: Vocabulary, b: Vocabulary):
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        a_ids, a_off, a_ok = encoded(a, data, off, pretokens(data, off))
        b_ids, b_off, b_ok = encoded(b, data, off, spaced(data, off))
        self.ok = ok = a_ok & b_ok
        self.a, self.n_a = _some(a_ids, a_off, ok)
        self.b, self.n_b = _some(b_ids, b_off, ok)
        owner_a = np.repeat(np.arange(len(self.a), dtype=np.int32), a.size[self.a])
        owner_b = np.repeat(np.arange(len(self.b), dtype=np.int32), b.size[self.b])
        turn_a, turn_b = (np.append(o[1:] != o[:-1], True) if len(o) else np.zeros(0, bool) for o in (owner_a, owner_b))
        self.overlaps = int(np.count_nonzero(turn_a | turn_b))
        ends = np.flatnonzero(turn_a & turn_b)
        self.cut_a, self.cut_b = owner_a[ends].astype(np.int64), owner_b[ends].astype(np.int64)
        self.text_of = np.searchsorted(np.cumsum(self.n_a), self.cut_a, side="right")

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.cut_a], self.b[self.cut_b]

    def written(self) -> tuple[bytes, np.ndarray]:
        """Every text's groups as a1,a2|b1;a3|b2,b3; one after the other, each group ended by a semicolon; and the bounds of the texts."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.cut_a], last_b[self.cut_b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # a group's A tokens stand behind the B tokens of earlier groups, its B tokens behind its A tokens
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.cut_b + 1])[group_a]
        place_b = np.arange(len(self.b)) + np.concatenate([self.cut_a + 1, [0]])[group_b]
        n = len(self.a) + len(self.b)
        ids, sign = np.empty(n, np.int64), np.empty(n, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a], sign[place_b] = np.where(last_a, BAR, COMMA), np.where(last_b, SEMICOLON, COMMA)
        digits, size = decimals()
        wide = np.empty((n, DIGITS + 1), np.uint8)
        wide[:, :DIGITS] = digits[ids]
        long = size[ids]
        wide[np.arange(n), long] = sign
        body = wide[np.arange(DIGITS + 1) <= long[:, None]]
        ends = np.concatenate([[0], np.cumsum(long + 1)])
        return body.tobytes(), ends[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]


@lru_cache(1)
def decimals() -> tuple[np.ndarray, np.ndarray]:
    """The digits of the numbers below 2 ** 17, from the left, and how many they are."""
    text = [str(i).encode() for i in range(1 << 17)]
    return np.frombuffer(b"".join(t.ljust(DIGITS) for t in text), np.uint8).reshape(-1, DIGITS), np.array([len(t) for t in text])


def _align(a_path: str, b_path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                ids, null = id_values(part.column(0))
                texts = part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                found = Aligned([b" " + texts[i].encode() for i in some], a, b)
                link_a, link_b = found.links()
                pair, link = np.unique(link_b << 32 | link_a, return_inverse=True)
                bucket = _mixed(pair >> 32, buckets)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                count = np.bincount(link, minlength=len(pair))[order]
                # links of a text in order of their pair's entry
                mine = np.sort(found.text_of << 32 | rank[link]) & 0xFFFFFFFF
                body, at = found.written()
                hashes = [hashlib.sha256(body[at[i] : at[i + 1] - 1]).hexdigest() if found.ok[i] else "" for i in range(len(some))]
                table = np.zeros((4, len(ids)), np.int64)
                table[0] = null
                table[1:, some] = found.n_a, found.n_b, np.bincount(found.text_of, minlength=len(some))
                names = [""] * len(ids)
                for i, h in zip(some, hashes, strict=True):
                    names[i] = h
                out = [(number, STATE, scattered(number, buckets), pack(ids), pack(table.ravel().astype(np.int32)), ",".join(names).encode(), pack(mine.astype(np.uint32)))]
                keys = pair[order]
                out += [(number, ASK, k, pack((keys[s] >> 32).astype(np.uint32)), pack((keys[s] & 0xFFFFFFFF).astype(np.uint32)), pack(count[s].astype(np.uint32)), None) for k, s in by_bucket(bucket[order])]
                yield rows(out)
                number += 1

    return run


def _mixed(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _count(held: list[tuple]) -> list[tuple]:
    sizes = [(unpack(r[3], np.uint32).astype(np.int64), unpack(r[4], np.uint32).astype(np.int64), unpack(r[5], np.uint32)) for r in held]
    b, a, n = (np.concatenate(x) for x in zip(*sizes, strict=True))
    pair, entry = np.unique(b << 32 | a, return_inverse=True)
    count = np.zeros(len(pair), np.int64)
    np.add.at(count, entry, n)
    begin = np.flatnonzero(np.diff(pair >> 32, prepend=-1))
    most = np.repeat(np.maximum.reduceat(count, begin), np.diff(np.append(begin, len(pair))))
    count, best = count[entry], (count == most)[entry].astype(np.uint8)
    edges = np.cumsum([0, *(len(x[0]) for x in sizes)])
    return [(r[0], ASK, r[2], pack(count[s:e]), pack(best[s:e]), None, None) for r, s, e in zip(held, edges[:-1], edges[1:], strict=True)]


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in groups(batches, "block"):
        asked = [r for r in held if r[1] == ASK]
        count = np.concatenate([np.zeros(0, np.int64), *(unpack(r[3], np.int64) for r in asked)])
        best = np.concatenate([np.zeros(0, np.uint8), *(unpack(r[4], np.uint8) for r in asked)])
        _, _, _, a, b, c, d = next(r for r in held if r[1] == STATE)
        ids = unpack(a, np.int64)
        null, n_a, n_b, links = unpack(b, np.int32).astype(np.int64).reshape(4, -1)
        mine = unpack(d, np.uint32)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[mine].astype(np.int64))])[np.concatenate([[0], np.cumsum(links)])])  # noqa: B023, E731
        columns = [pa.array(ids, mask=null.astype(bool)), *(pa.array(x) for x in (n_a, n_b, links, links, total(best), total(count))), pa.array(c.decode().split(","), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=RESULT)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = own.mapInArrow(_align(a_path or default_path(A_FILE), b_path or default_path(B_FILE), buckets), ROW_DDL)
    counted = asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answered(_count), ROW_DDL)
    return counted.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_sum, RESULT_DDL)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id and links: how often each id pair is linked in the corpus, the dictionary that an alignment gives."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    a_path, b_path = a_path or default_path(A_FILE), b_path or default_path(B_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                found = Aligned([b" " + t.encode() for t in part.column(1).to_pylist() if t], byte_level(a_path), pieces(b_path))
                a, b = found.links()
                pair, count = np.unique(b << 32 | a, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair & 0xFFFFFFFF), pa.array(pair >> 32), pa.array(count)], ["a_id", "b_id", "n"])

    return own.mapInArrow(run, "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "links")
