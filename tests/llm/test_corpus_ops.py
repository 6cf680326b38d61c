"""Repeated substrings, token alignment and collocations against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lacuna.llm import align, collocations, suffix_dedup

ODD = [None, "", " ", "  x   y ", "a▁b", "<s> </s> <|endoftext|> <unk>", "\x00\x01 \t\n\n x", "don't we'll I'M", "a  b   c    d\n   e", "日本語 テスト ", "é" * 50, " lead", "trail  ", "\U0001f600 \U0001f468‍\U0001f469", "＃ ﬁ", "a b, c " * 300, "A B A B A B " * 200, "x" * 5000]


def repeats(rows, length=100):
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        body = (rows[i][1] or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if body[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(body[p : p + length])
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(body)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (rows[i][0], len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out, key=str)


def aligned(rows):
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a_own = tokenizers.Tokenizer.from_file(public_tokenizers.path(align.A_FILE))
    a_own.encode_special_tokens = True
    b_own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_FILE))
    a_bytes = align.byte_level(public_tokenizers.path(align.A_FILE)).table
    found, links = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_own.encode(text) if text else []
        b_bytes = [bytes([int(b_own.id_to_piece(i)[3:-1], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes) != whole:
            a, b, b_bytes = [], [], []
        ends, at = {}, 0
        for i, token in enumerate(a):
            at += len(a_bytes[token])
            ends[at] = i
        cuts, at = [], 0
        for j, piece in enumerate(b_bytes):
            at += len(piece)
            if at in ends:
                cuts.append((ends[at], j))
                links[a[ends[at]], b[j]] += 1
        found.append((doc, a, b, cuts))
    most = collections.Counter()
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    out = []
    for doc, a, b, cuts in found:
        text, p, q = [], 0, 0
        for i, j in cuts:
            text.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
            p, q = i + 1, j + 1
        best = sum(links[a[i], b[j]] == most[b[j]] for i, j in cuts)
        out.append((doc, len(a), len(b), len(cuts), len(cuts), best, sum(links[a[i], b[j]] for i, j in cuts), hashlib.sha256(";".join(text).encode()).hexdigest() if cuts else ""))
    return sorted(out, key=str)


def phrases(rows, least, best):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        held = {p[i : i + w] for p, a in some.items() for w in range(2, len(p)) for i in range(len(p) - w + 1) if 100 * a >= 100 * own[p[i : i + w]]}
        scored = []
        for p, a in some.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        scored.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, r[2], r[1], r[3], r[4], n[lang], r[0]) for i, r in enumerate(scored[:best])]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    """Texts of the given tables with odd ones, copies and pieces of each other, in small blocks of several partitions."""
    rnd = random.Random(7)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(80).collect()]
    rows = [(i, t, rnd.choice(["en", "fr", None, "und"])) for i, t in enumerate(texts)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD)]
    for i in range(60):
        t = rnd.choice(texts)
        a = rnd.randrange(max(1, len(t)))
        rows.append((2000 + i if i % 9 else rnd.choice([None, 3]), t[a : a + rnd.randint(50, 3000)] + rnd.choice(["", "#", texts[0]]), "en"))
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS block", "1 AS bucket", "2 AS kind").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("size", [5_000, 4 << 20])
def test_repeats_equal_brute_force(odd_docs, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "BLOCK", size)
    # equal ids: the order of the blocks decides, so brute force takes the rows as they are read
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (None, 3)]
    df = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 3")
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_one_id_and_of_none(spark, odd_docs):
    """Of rows of one id, and of rows without, as many bytes go as of rows in any order of theirs."""
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, t + "z")], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r)[:4] for r in suffix_dedup.digest(df.where("doc_id = 1")).collect())
    assert got == [(1, 300, 0, 0), (1, 300, 300, 1)]
    got = suffix_dedup.digest(df).collect()
    assert sum(r.n_removed for r in got) == 900 and len(got) == 4
    assert len(suffix_dedup.digest(odd_docs).collect()) == odd_docs.count()


@pytest.mark.parametrize("length", [99, 100, 101, 151, 400])
def test_names_and_least_names(length):
    data = np.random.default_rng(length).integers(0, 3, length).astype(np.uint8)
    h = suffix_dedup.names(data)
    by_bytes = {}
    for p in range(length - 49):
        assert by_bytes.setdefault(data[p : p + 50].tobytes(), h[p]) == h[p]
    assert len(set(by_bytes.values())) == len(by_bytes)
    low = suffix_dedup.sliding(np.minimum, h)
    assert all(low[p] == h[p : p + 51].min() for p in range(length - 50))


@pytest.mark.parametrize("size", [20_000, 4 << 20])
def test_alignment_equals_brute_force(odd_docs, monkeypatch, size):
    monkeypatch.setattr(align, "BLOCK", size)
    monkeypatch.setattr(align, "WORDS", 3000 if size < 1 << 20 else 400_000)
    got = align.align(odd_docs).collect()
    want = aligned([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(map(tuple, got), key=str) == want
    assert align.pair_counts(odd_docs).agg({"links": "sum"}).first()[0] == sum(r.n_links for r in got)


def test_overlaps_are_the_pairs_of_tokens_that_share_bytes():
    texts = [b" " + t.encode() for t in ODD if t]
    found = align.Aligned(texts, align.byte_level(align.default_path(align.A_FILE)), align.pieces(align.default_path(align.B_FILE)))
    a, b = align.byte_level(align.default_path(align.A_FILE)).size[found.a], align.pieces(align.default_path(align.B_FILE)).size[found.b]
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    shared = sum(int(np.sum((b_end > e - n) & (b_end - b < e))) for e, n in zip(a_end, a, strict=True))
    assert found.overlaps == shared


@pytest.mark.parametrize(("least", "best"), [(2, 40), (12, 2000), (10**6, 10)])
def test_collocations_equal_brute_force(odd_docs, monkeypatch, least, best):
    monkeypatch.setattr(collocations, "BLOCK", 20_000)
    got = collocations.collocations(odd_docs, least, best).collect()
    assert sorted(map(tuple, got)) == phrases([(r.text, r.lang) for r in odd_docs.collect()], least, best)


def test_scores_beyond_64_bits(spark):
    """Totals whose products pass 64 bits are scored exactly."""
    from pyspark.sql import functions as F

    n, a, left, right = 3_000_000_019, 2_000_000_011, 2_100_000_017, 2_900_000_023
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations.score().alias("s")).where(F.col("s").isNotNull()).first()
    assert row.s == 1000 * a * n // (left * right)


def test_radix_order_is_a_stable_sort():
    rnd = np.random.default_rng(1)
    key = rnd.integers(0, 1 << 32, (5000, 3), dtype=np.uint64).astype(np.uint32) % np.uint32(70_000)
    distinct, total, place = collocations.run_lengths(key)
    want, count = np.unique(key, axis=0, return_counts=True)
    assert (distinct == want).all() and (total == count).all() and (distinct[place] == key).all()


@pytest.mark.parametrize("f", [suffix_dedup.remove_repeats, align.align, align.pair_counts, collocations.collocations])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


@pytest.mark.parametrize("f", [suffix_dedup.remove_repeats, align.align])
def test_only_texts_without_tokens(spark, f):
    rows = f(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(sum(r[i] or 0 for i in range(1, 4)) == 0 for r in rows)
