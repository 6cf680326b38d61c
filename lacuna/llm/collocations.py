"""Phrase collocations: counts of word n-grams over fixed-width binary keys, scored by their weakest cut.

1. Words. Each block of texts counts its distinct words per language; a bucket adds the blocks' counts up
   and numbers the frequent ones. Only phrases of frequent words can be frequent, so a block keeps the
   number of each of its words (0 for a rare one, which breaks a piece like a mark does).
2. Pairs. Two numbers are one 64-bit key. Buckets are ranges of the mixed keys, even without a sample; a
   bucket radix-sorts the blocks' keys and adds the counts of each run. The blocks learn which of their
   pairs are frequent.
3. Three words or more. Only where all pairs of neighbours are frequent, n-grams of three to five words
   become keys of five 32-bit numbers (0 where there is none); ranges, radix sort and runs again.
4. The frequent phrases, few beside the corpus, are scored by joins of a phrase with its parts.

A block sends a bucket each of its distinct keys once with its count, so a very common word or phrase
costs one entry a block.

Words have A-Z lower-cased, pieces end at `[.,;:!?\\x0A-\\x0D]` and texts. Null lang: und, the same as the
language of that name. Null and empty texts: no words. Texts may be of any length; repeated rows each
count; extra columns are ignored; doc_id is not needed. Empty table: empty result. Scores are exact: sums and
products of decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm._packed import ROW_DDL, answered, by_bucket, groups, pack, rows, scattered, unpack
from lacuna.llm._text import LOWER, Words, blocks, cut, flat, mix, ragged

BLOCK = 4 << 20
MOST = 5
LEAST = 100
BEST = 2000
#: Parts that a language's phrases are dealt to before its first ones are taken.
DEALT = 64
END = np.zeros(256, bool)
END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = END.copy()
GAP[[9, 32]] = True
ASK, STATE, WORD, PHRASE, TOTAL = 0, 1, 2, 3, 4


def radix_order(*digits: np.ndarray) -> np.ndarray:
    """The order of rows by columns of 16-bit digits, the highest first: stable passes from the lowest on; constant columns need none."""
    order = np.arange(len(digits[0]))
    for d in reversed(digits):
        if len(d) and d.min() < d.max():
            order = order[np.argsort(d[order], kind="stable")]
    return order


def run_lengths(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of key (n x words of 32 bits) in order, the sum of their counts, and each row's place among them."""
    key = np.ascontiguousarray(key, np.uint32)
    halves = key.view(np.uint16).reshape(len(key), key.shape[1], 2)
    order = radix_order(*(halves[:, j, half] for j in range(key.shape[1]) for half in (1, 0)))
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.bincount(place, minlength=int(new.sum())) if count is None else np.zeros(int(new.sum()), np.int64)
    if count is not None:
        np.add.at(total, place, count)
    return sorted_[new], total.astype(np.int64), place


def ranged(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of each row's mixed key."""
    h = np.zeros(len(key), np.uint64)
    for column in key.T:
        h = mix(h ^ column.astype(np.uint64))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _words(buckets: int):
    """Of each block its words as numbers of its own dictionary, and that dictionary with counts to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                langs = pc.fill_null(part.column(0), "und").dictionary_encode()
                code, out = langs.indices.to_numpy(zero_copy_only=False), []
                vocab, count, series, before = [], [], [], 0
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    data, off = flat(part.column(1).filter(pa.array(code == i)))
                    data = LOWER[data]
                    w = Words(data, off, GAP)
                    if not len(w.code):
                        continue
                    ends = np.concatenate([[0], np.cumsum(END[data])])
                    broken = np.ones(len(w.code), bool)
                    broken[1:] = (w.doc[1:] != w.doc[:-1]) | (ends[w.start[1:]] != ends[w.end[:-1]])
                    # a word's language stands before it; no word holds a line end
                    vocab += [lang.encode() + b"\n" + x for x in w.vocab.to_pylist()]
                    count.append(np.bincount(w.code, minlength=len(w.vocab)))
                    series.append((w.code.astype(np.int64) + before) << 1 | broken)
                    before += len(w.vocab)
                    out.append((number, TOTAL, scattered(number, buckets), lang.encode(), str(len(w.code)).encode(), None, None))
                if vocab:
                    bucket = np.array([hash_of(x) % buckets for x in vocab], np.int32)
                    order = np.argsort(bucket, kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    total, all_ = np.concatenate(count)[order], np.concatenate(series)
                    out.append((number, STATE, scattered(number, buckets), pack((by_count(total)[1][rank[all_ >> 1]] << 1 | all_ & 1).astype(np.uint32), 3), pack(total.astype(np.uint32)), None, None))
                    for k, s in by_bucket(bucket[order]):
                        own = [vocab[j] for j in order[s].tolist()]
                        out.append((number, ASK, k, pack(np.array([len(x) for x in own], np.uint32)), pack(np.frombuffer(b"".join(own), np.uint8)), pack(total[s].astype(np.uint32)), None))
                if out:
                    yield rows(out)
                number += 1

    return run


def by_count(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by falling count, and the place of each in that order: small numbers for what is common pack better."""
    order = np.argsort(-total.astype(np.int64), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


def hash_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _split(body: bytes, size: np.ndarray) -> list[bytes]:
    out, at = [], 0
    for n in size.tolist():
        out.append(body[at : at + n])
        at += n
    return out


def own_block(bucket: int) -> int:
    """A block for a bucket's results, so that they go on evenly; texts' blocks are not negative."""
    return -1 - bucket


def _number_words(least: int, buckets: int):
    def answer(held: list[tuple]) -> list[tuple]:
        size = [unpack(r[3], np.uint32) for r in held]
        words = pa.array([w for r, s in zip(held, size, strict=True) for w in _split(unpack(r[4], np.uint8).tobytes(), s)], pa.binary()).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        total = np.zeros(len(words.dictionary), np.int64)
        np.add.at(total, code, np.concatenate([unpack(r[5], np.uint32) for r in held]))
        often = by_count(total)[0][: np.count_nonzero(total >= least)]
        # the buckets' numbers interleave, from 1 on, the most frequent first
        number = np.zeros(len(total), np.int64)
        number[often] = np.arange(len(often)) * buckets + held[0][2] + 1
        if len(often) and number[often[-1]] >= 1 << 32:
            raise ValueError("more frequent words than 32-bit numbers")
        edges = np.cumsum([0, *(len(s) for s in size)])
        out = [(r[0], ASK, r[2], pack(number[code[a:b]].astype(np.uint32)), None, None, None) for r, a, b in zip(held, edges[:-1], edges[1:], strict=True)]
        names = words.dictionary.take(pa.array(often)).to_pylist()
        if names:
            out.append((own_block(held[0][2]), WORD, held[0][2], pack(np.array([len(w) for w in names], np.uint32)), pack(np.frombuffer(b"".join(names), np.uint8)), pack(number[often]), pack(total[often])))
        return out

    return answer


def _asked(block: int, key: np.ndarray, count: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """Entries sorted by bucket; key: n x 2 or 5 numbers, one binary for each two columns at most."""
    out = []
    for k, s in by_bucket(bucket):
        out.append((block, ASK, k, pack(np.ascontiguousarray(key[s].T).ravel()), pack(np.array([key.shape[1]], np.uint8)), pack(count[s].astype(np.uint32)), None))
    return out


def _key(row: tuple) -> np.ndarray:
    return np.ascontiguousarray(unpack(row[3], np.uint32).reshape(int(unpack(row[4], np.uint8)[0]), -1).T)


def _kept(word: np.ndarray, broken: np.ndarray) -> np.ndarray:
    """The words with a frequent neighbour in their piece, in order, with one 0 between stretches that don't touch."""
    joined = np.zeros(len(word) + 1, bool)  # to the word before
    joined[1:-1] = (word[1:] > 0) & (word[:-1] > 0) & ~broken[1:]
    at = np.flatnonzero(joined[:-1] | joined[1:])
    first = ~joined[at]
    out = np.zeros(len(at) + int(first.sum()), np.uint32)
    out[np.arange(len(at)) + np.cumsum(first)] = word[at]
    return out


def _neighbours(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbours of kept words, and where their first ones are."""
    at = np.flatnonzero((word[:-1] > 0) & (word[1:] > 0))
    return np.column_stack([word[at], word[at + 1]]), at


def _to_ranges(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by range, and the ranges in that order."""
    bucket = ranged(key, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in groups(batches, "block"):
            rest = [r for r in held if r[1] > STATE]
            if rest:
                yield rows(rest)
            state = [r for r in held if r[1] == STATE]
            if not state:
                continue
            ids = np.concatenate([unpack(r[3], np.uint32) for r in held if r[1] == ASK])
            series = unpack(state[0][3], np.uint32)
            word = ids[by_count(unpack(state[0][4], np.uint32))[0]][series >> 1]
            word = _kept(word, (series & 1).astype(bool))
            key, count, _ = run_lengths(_neighbours(word)[0])
            order, bucket = _to_ranges(key, buckets)
            yield rows([(number, STATE, scattered(number, buckets), pack(word, 3), None, None, None), *_asked(number, key[order], count[order], bucket)])

    return run


def _count_keys(least: int):
    """Adds up the counts of equal keys; frequent ones are phrases, and where the blocks have asked about pairs they learn which are."""

    def answer(held: list[tuple]) -> list[tuple]:
        keys = [_key(r) for r in held]
        key, total, place = run_lengths(np.concatenate(keys), np.concatenate([unpack(r[5], np.uint32) for r in held]))
        often = total >= least
        found = key[often]
        out = [(own_block(held[0][2]), PHRASE, held[0][2], pack(np.ascontiguousarray(found.T).ravel()), pack(np.array([key.shape[1]], np.uint8)), pack(total[often]), None)] if len(found) else []
        if key.shape[1] == 2:
            edges = np.cumsum([0, *(len(k) for k in keys)])
            flag = often[place].astype(np.uint8)
            out += [(r[0], ASK, r[2], pack(flag[a:b]), None, None, None) for r, a, b in zip(held, edges[:-1], edges[1:], strict=True)]
        return out

    return answer


def _longer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in groups(batches, "block"):
            rest = [r for r in held if r[1] > STATE]
            if rest:
                yield rows(rest)
            state = [r for r in held if r[1] == STATE]
            if not state:
                continue
            word = unpack(state[0][3], np.uint32)
            pair, at = _neighbours(word)
            key, _, place = run_lengths(pair)
            answer = np.concatenate([np.zeros(0, np.uint8), *(unpack(r[3], np.uint8) for r in held if r[1] == ASK)])
            often = np.zeros(len(key), bool)
            often[_to_ranges(key, buckets)[0]] = answer > 0
            fine = np.zeros(len(word), bool)  # a frequent pair begins here
            fine[at] = often[place]
            keys, reach = [], fine
            for n in range(3, MOST + 1):
                # n words begin where n - 1 frequent pairs follow each other
                reach = reach[:-1] & fine[n - 2 :] if len(reach) else reach
                begin = np.flatnonzero(reach)
                more = np.zeros((len(begin), MOST), np.uint32)
                for j in range(n):
                    more[:, j] = word[begin + j]
                keys.append(more)
            key = np.concatenate(keys)
            if len(key):
                key, count, _ = run_lengths(key)
                order, bucket = _to_ranges(key, buckets)
                yield rows(_asked(number, key[order], count[order], bucket))

    return run


def score() -> Column:
    """floor(1000 * a * n / (l * r)) exactly, of counts below 10 ** 16 and totals below 10 ** 17."""
    whole = lambda c, digits: f"cast({c} as decimal({digits},0))"
    return F.expr(f"({whole(1000, 4)} * {whole('a', 16)} * {whole('n', 17)}) div ({whole('l', 18)} * {whole('r', 18)})")


COUNTED_DDL = "kind int, name binary, ids array<long>, n long"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, phrases and totals as rows of columns."""
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            kind, _, a, b, c, d = row[1:]
            if kind == WORD:
                names = _split(unpack(b, np.uint8).tobytes(), unpack(a, np.uint32))
                some = (names, [[i] for i in unpack(c, np.int64).tolist()], unpack(d, np.int64).tolist())
            elif kind == TOTAL:
                some = ([a], [[]], [int(b)])
            elif kind == PHRASE:
                key, total = _key(row), unpack(c, np.int64)
                some = ([None] * len(key), [k[k > 0].tolist() for k in key], total.tolist())
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some[0]), pa.int32()), pa.array(some[0], pa.binary()), pa.array(some[1], pa.list_(pa.int64())), pa.array(some[2], pa.int64())], ["kind", "name", "ids", "n"])


def counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """kind (WORD, PHRASE, TOTAL), name (language, and for a word a line end and the word), ids and n: all frequent words and phrases, and the languages' totals by block."""
    if least < 1:
        raise ValueError("least is 1 or more")
    own = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_buckets = lambda df: df.repartition("bucket").sortWithinPartitions("bucket", "block")
    at_blocks = lambda df: df.repartition("block").sortWithinPartitions("block", "kind", "bucket")
    numbered = at_buckets(own.mapInArrow(_words(buckets), ROW_DDL)).mapInArrow(answered(_number_words(least, buckets)), ROW_DDL)
    pairs = at_buckets(at_blocks(numbered).mapInArrow(_pairs(buckets), ROW_DDL)).mapInArrow(answered(_count_keys(least)), ROW_DDL)
    longer = at_buckets(at_blocks(pairs).mapInArrow(_longer(buckets), ROW_DDL)).mapInArrow(answered(_count_keys(least)), ROW_DDL)
    return longer.mapInArrow(_listed, COUNTED_DDL)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first phrases by score, a and phrase."""
    found = cut(counts(docs, least, lang_col, text_col))
    # the line end after the language is the last one, as no word holds any
    text = F.col("name").cast("string")
    word = found.where(F.col("kind") == WORD).select(F.col("ids")[0].alias("id"), F.regexp_extract(text, r"(?s)^(.*)\n", 1).alias("lang"), F.substring_index(text, "\n", -1).alias("word"), "n")
    total = found.where(F.col("kind") == TOTAL).groupBy(text.alias("lang")).agg(F.sum("n").alias("total"))
    phrase = found.where(F.col("kind") == PHRASE).select("ids", "n")
    every = phrase.unionByName(found.where(F.col("kind") == WORD).select("ids", "n"))
    cuts = phrase.select("ids", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = cuts.join(every.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(every.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    named = cuts.withColumn("id", F.col("ids")[0]).join(word.select("id", "lang"), "id").join(total.withColumnRenamed("total", "n"), "lang")
    weakest = named.withColumn("score", score()).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # a phrase goes where a longer one that holds it is as frequent
    inner = phrase.where("size(ids) > 2").select("n", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), w -> transform(sequence(1, size(ids) - w + 1), i -> slice(ids, i, w))))")).alias("ids"))
    held = inner.groupBy("ids").agg(F.max("n").alias("longer"))
    kept = weakest.join(held, "ids", "left").where("longer IS NULL OR longer < a").select("lang", "ids", "a", "n", "m.*")
    # words by their numbers, in order
    spelt = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(word.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = kept.join(spelt, "ids").select("lang", "phrase", "a", "l", "r", "n", "score", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
