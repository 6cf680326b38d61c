"""Best-fit packing of whole documents into training sequences by hierarchical residual packing.

1. Each task tokenises its documents, cuts those longer than a sequence and packs its pieces by best
   fit, longest first. Bins that are nearly full are final.
2. The other bins travel on as single items, dealt anew by a hash to fewer nodes on each level: a node
   takes the items of FAN_IN nodes on average and packs them by best fit again, and so on up the tree.
   A level gets more nodes where its items would be too many for one task. The tree ends at a single
   node, or when the two emptiest bins can't share a sequence, or when a whole
   level of several nodes finds nothing to merge: then a node has one bin below half at most, fewer than
   one sequence in NODE_ITEMS.
3. Each piece finds its sequence and its place there through the levels' small maps.
4. Sequences that the tree leaves underfull are dissolved: their pieces are dealt to nodes of NODE_ITEMS
   pieces on average and packed by best fit anew. A node keeps the new bins where they are fewer than its
   share of the old ones, so no round adds sequences.

Only piece lengths travel, never texts or ids. What one task holds: an input split's lengths, or at
most NODE_ITEMS items on average.

Words are tokenised once for each distinct white-space word of a block. Words of ASCII and Latin
letters, digits and punctuation take a rank-ordered merge in one native call; every other word goes
through the tokenizers library itself.

Null text: empty. An empty text is one piece that holds the end id alone. Repeated rows are packed
each; extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._text import Words, blocks, cut, flat, id_values, ragged

CAPACITY = 2048
#: Bins with this share of their capacity are final.
NEARLY_FULL = 0.999
FAN_IN, NODE_ITEMS = 8, 200_000
#: Bytes of words that both ways of tokenising read alike: printable ASCII and the Latin-1 letters from U+00C0, no special token.
_PLAIN_BYTE = np.zeros(256, bool)
_PLAIN_BYTE[33:127] = _PLAIN_BYTE[0x80:0xC0] = _PLAIN_BYTE[0xC3] = True
_LETTER_BYTE = _PLAIN_BYTE.copy()
_LETTER_BYTE[33:65] = _LETTER_BYTE[91:97] = _LETTER_BYTE[123:127] = False
#: Many words share a block, so that each distinct one is encoded seldom.
TOKEN_BLOCK_BYTES = 12 << 20
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long"


class WordTokenizer:
    """Ids of texts by a word-end BPE vocabulary file, equal to tokenizers' encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path))
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte = {c: b for b, c in _byte_chars().items()}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + b"\0" * end

        vocab = model["vocab"]
        ranks, ids = {bytes([b]): b for b in range(256)}, {}
        for b in range(1, 256):  # a word's last byte is one symbol with the word end from the outset
            ranks[bytes([b, 0])] = 256 + b
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            ranks.setdefault(raw(a + b), 512 + len(ranks))
        for token, i in vocab.items():
            if token not in self.special and (r := ranks.get(raw(token))) is not None:
                ids[r] = i
        self.ids = np.full(max(ranks.values()) + 1, -1, np.int32)
        self.ids[list(ids)] = list(ids.values())
        self.sep = 1  # the byte 0x01 stands between words
        self.fast = tiktoken.Encoding("words", pat_str="\x01|[^\x00\x01]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\x01]|_)+")

    def words(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, one word after the other, and the number of each word."""
        words, kind = np.array(vocab.to_pylist(), object), _kind(vocab)
        order, ids, size = [], [], []
        for k, encode in enumerate((self._letters, self._mixed, self._other)):
            at = np.flatnonzero(kind == k)
            if len(at):
                got, n = encode(words[at])
                order.append(at)
                ids.append(got)
                size.append(n)
        if not order:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, ids, size = map(np.concatenate, (order, ids, size))
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[order], count[order] = np.cumsum(size) - size, size
        return ids[ragged(first, count)], count

    def _letters(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._merged(b"\0\x01".join(words).decode().lower() + "\0", len(words))

    def _mixed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._merged(self.split.sub(r"\g<0>" + "\0", b"\x01".join(words).decode().lower()), len(words))

    def _merged(self, marked: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.array(self.fast.encode_ordinary(marked), np.int32)
        between = tokens == self.sep
        count = np.bincount(np.cumsum(between)[~between], minlength=n)
        return self.ids[tokens[~between]], count

    def _other(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.slow.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        return np.array([x for e in got for x in e], np.int32), np.array([len(e) for e in got])


def _kind(vocab: pa.Array) -> np.ndarray:
    """0: the word has plain letters only, 1: other plain characters too, 2: not plain."""
    data, off = flat(vocab)
    after = np.append(data[1:], np.uint8(0))[: len(data)]
    odd = ~_PLAIN_BYTE[data] | ((data == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((data == 60) & (after == 124))
    kind = np.zeros(len(vocab), np.uint8)
    for k, where in ((1, ~_LETTER_BYTE[data]), (2, odd)):
        kind[np.searchsorted(off, np.flatnonzero(where), side="right") - 1] = k
    return kind


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE vocabularies: printable Latin-1 bytes are themselves, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(col: pa.Array, tok: WordTokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by id 0, and the len + 1 offsets."""
    w = Words(*flat(col))
    ids, count = tok.words(w.vocab)
    first = np.cumsum(count) - count
    per_word = count[w.code]
    body = ids[ragged(first[w.code], per_word)]
    ends = np.zeros(len(per_word) + 1, np.int64)
    np.cumsum(per_word, out=ends[1:])
    off = ends[w.bounds] + np.arange(len(w.bounds))
    out = np.zeros(int(off[-1]), np.uint32)
    keep = np.ones(len(out), bool)
    keep[off[1:] - 1] = False
    out[keep] = body
    return out, off


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, each bin's fill. Ties: input order."""
    bins, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if m := mask >> size:
            left = size + (m & -m).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += size
        if left > size:
            room[left - size].append(b)
            mask |= 1 << (left - size)
    return bins, offset, np.array(fill, np.int64)


def cut_pieces(ids: np.ndarray, off: np.ndarray, doc_ids: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of doc_id, piece, start, length, ids_crc32."""
    size = np.diff(off)
    n = -(-size // capacity)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(np.repeat(size, n) - start, capacity)
    at = np.repeat(off[:-1], n) + start
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
    return np.stack([np.repeat(doc_ids, n), piece, start, length, np.array(crc, np.int64)], 1) if len(piece) else np.zeros((0, 5), np.int64)


def _local(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, rows, nulls = tokenizer(path), [], []
        for batch in batches:
            for part in blocks(batch, "text", TOKEN_BLOCK_BYTES):
                ids, off = token_ids(part.column(1), tok)
                doc_ids, null = id_values(part.column(0))
                rows.append(cut_pieces(ids, off, doc_ids, capacity))
                nulls.append(np.repeat(null, -(-np.diff(off) // capacity)))
        if not rows:
            return
        rows, null = np.concatenate(rows), np.concatenate(nulls)
        bins, offset, _ = best_fit(rows[:, 3], capacity)
        bins += TaskContext.get().partitionId() << 32
        cols = [*rows.T, bins, offset]
        for a in range(0, len(rows), 50_000):
            part = [c[a : a + 50_000] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64(), mask=null[a : a + 50_000] if i == 0 else None) for i, c in enumerate(part)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def _node(level: int, capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values("bin")
        bins, offset, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        return pdf.assign(parent=bins + (int(key[0]) << 32) + (level << 56), parent_offset=offset, parent_fill=fill[bins])[["bin", "parent", "parent_offset", "parent_fill"]]

    return run


def _fits(items: DataFrame, capacity: int) -> bool:
    """Can the two emptiest bins share a sequence?"""
    two = [r["fill"] for r in items.select("fill").orderBy("fill").limit(2).collect()]
    return len(two) == 2 and sum(two) <= capacity


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = cut(pair.mapInArrow(_local(path or default_path(), capacity), PIECES))
    least = int(capacity * NEARLY_FULL)
    level, done = 0, None
    items = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < least).withColumn("node", F.shiftright("bin", 32).cast("long"))
    stats = items.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes")).first()
    n, nodes = stats["n"], stats["nodes"]
    while n > 1:
        level += 1
        nodes = max(-(-nodes // FAN_IN), -(-n // NODE_ITEMS))
        level_map = cut(items.withColumn("node", F.expr(f"pmod(xxhash64(bin, {level}), {nodes})")).groupBy("node").applyInPandas(_node(level, capacity), "bin long, parent long, parent_offset long, parent_fill long"))
        # the bins of the tree's leaves with their place in this level's bins
        here = level_map.select(F.col("bin").alias("via"), "parent", "parent_offset", "parent_fill")
        if done is None:
            done = here.select(F.col("via").alias("leaf"), "parent", "parent_offset", "parent_fill")
        else:
            done = done.withColumnRenamed("parent", "via").withColumnRenamed("parent_offset", "before").drop("parent_fill").join(here, "via", "left")
            done = cut(done.select("leaf", F.coalesce("parent", "via").alias("parent"), (F.col("before") + F.coalesce("parent_offset", F.lit(0))).alias("parent_offset"), F.coalesce("parent_fill", F.lit(capacity)).alias("parent_fill")))
        merged = level_map.select(F.col("parent").alias("bin"), F.col("parent_fill").alias("fill")).distinct()
        items = merged.where(F.col("fill") < least)
        after = merged.agg(F.count("*").alias("bins"), F.count_if(F.col("fill") < least).alias("n")).first()
        if nodes == 1 or not _fits(items, capacity) or after["bins"] == n:
            break
        n = after["n"]
    if done is None:
        placed = pieces.withColumnRenamed("bin", "sequence_id").withColumnRenamed("bin_offset", "offset")
    else:
        out = pieces.join(done.withColumnRenamed("leaf", "bin"), "bin", "left")
        placed = out.select(*PIECE, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("parent_offset", F.lit(0))).alias("offset"))
    return _dissolve(placed.select(*PIECE, "sequence_id", "offset"), capacity, least, level + 1)


def _dissolve(placed: DataFrame, capacity: int, least: int, level: int) -> DataFrame:
    """The pieces of underfull sequences packed anew; whole sequences are dealt, so that a node can compare."""
    under = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n")).where(F.col("fill") < least)
    n = under.agg(F.sum("n").alias("n")).first()["n"] or 0
    if n < 2:
        return placed
    node = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(-(-n // NODE_ITEMS)))
    loose = placed.join(under.select("sequence_id"), "sequence_id", "left_semi").select("sequence_id", "offset", "length", node.alias("node"))
    again = cut(loose.groupBy("node").applyInPandas(_again(level, capacity), "sequence_id long, offset long, new_id long, new_offset long"))
    return placed.join(again, ["sequence_id", "offset"], "left").select(*PIECE, F.coalesce("new_id", "sequence_id").alias("sequence_id"), F.coalesce("new_offset", "offset").alias("offset"))


def _again(level: int, capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["sequence_id", "offset"])
        bins, offset, fill = best_fit(pdf["length"].to_numpy(), capacity)
        if len(fill) < pdf["sequence_id"].nunique():
            return pdf.assign(new_id=bins + (int(key[0]) << 32) + (level << 56), new_offset=offset)[["sequence_id", "offset", "new_id", "new_offset"]]
        return pdf.assign(new_id=pdf["sequence_id"], new_offset=pdf["offset"])[["sequence_id", "offset", "new_id", "new_offset"]]

    return run
