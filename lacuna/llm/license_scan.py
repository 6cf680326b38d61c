"""License scans by a positional rare-token index.

The index holds, for each word of the licence templates, its postings: templates and places there. A
first pass counts over the whole corpus in how many texts each of these words stands; that gives
their inverse document frequencies. A second pass looks up each template's words of highest weight,
as many as leave less than MIN_SHARE of it to the others, and takes their postings: a place in the
text less the place in the template is where the template would begin. A beginning with a share of
MIN_SHARE matches one of these words, so every one is proposed. Each is verified: the words at their
places must make up MIN_SHARE of the template's weight, and the template's mandatory key phrase must
stand there word for word (within SLACK words).

The base phrases are found everywhere: each of their occurrences holds the phrase's rarest word, whose
postings propose the beginning, and all words are then compared.

Null text: empty. Texts without a word: counts 0, places null, labels empty, score 0. Ties in weight
go by the place. Repeated rows are scanned each; extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._text import LOWER, Words, blocks, flat

#: Phrases of the base scan and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label, template and mandatory key phrase (a part of the template), from the licences' public texts.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
]
#: Least share of a template's weight, shift allowed to the key phrase, allowance for rounding in sums of shares.
MIN_SHARE, SLACK, EPS = 0.6, 3, 1e-9

SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[65:91] = False


def _compile():
    base = [p.split() for p, _ in BASE]
    templates = [t.split() for _, t, _ in TEMPLATES]
    keys = [k.split() for _, _, k in TEMPLATES]
    words = sorted({w for p in base + templates for w in p})
    number = {w: i for i, w in enumerate(words)}
    coded = lambda p: np.array([number[w] for w in p])
    key_at = []
    for t, k in zip(templates, keys, strict=True):
        key_at.append(next(i for i in range(len(t)) if t[i : i + len(k)] == k))
    return words, [coded(p) for p in base], [coded(t) for t in templates], [coded(k) for k in keys], key_at


WORDS, BASE_CODES, TEMPLATE_CODES, KEY_CODES, KEY_AT = _compile()
VALUE_SET = pa.array([w.encode() for w in WORDS], pa.binary())


@dataclass
class Text:
    """The words of some texts by their number in WORDS, -1 for any other, and where each text's begin."""

    word: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray


def _read(col: pa.Array) -> Text:
    data, off = flat(col)
    w = Words(LOWER[data], off, SEPARATOR)
    known = pc.fill_null(pc.index_in(w.vocab, VALUE_SET), -1).to_numpy(zero_copy_only=False)
    return Text(known[w.code] if len(w.code) else np.zeros(0, np.int64), w.doc, w.bounds)


def _stands(t: Text, begin: np.ndarray, end: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Does the phrase stand at each beginning, inside the text that ends at end?"""
    ok = (begin >= 0) & (begin + len(phrase) <= end)
    out = ok.copy()
    for k, code in enumerate(phrase):
        out[ok] &= t.word[begin[ok] + k] == code
    return out


def frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The inverse document frequency of each licence word, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(WORDS), np.int64), 0
        for batch in batches:
            for part in blocks(batch, "text"):
                t = _read(part.column(0))
                at = np.flatnonzero(t.word >= 0)
                pair = np.unique(t.doc[at].astype(np.int64) * len(WORDS) + t.word[at])
                count += np.bincount(pair % len(WORDS), minlength=len(WORDS))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(WORDS)), -1)), pa.array(np.append(count, n))], ["word", "n"])

    counts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in counts.collect()}  # a row for each licence word
    n = got.get(-1, 0)
    return np.log((n + 1) / (np.array([got.get(i, 0) for i in range(len(WORDS))]) + 1)) + 0.01


def _voters(codes: np.ndarray, idf: np.ndarray) -> list[int]:
    """The template's places of highest weight that no beginning with a share of MIN_SHARE can do without.

    The places left out weigh less than MIN_SHARE together, so one of these at least is matched there.
    """
    order = np.lexsort((np.arange(len(codes)), -idf[codes]))
    left = 1 - np.cumsum(idf[codes][order]) / float(idf[codes].sum())
    return order[: int(np.argmax(left < MIN_SHARE - EPS)) + 1].tolist()


def _scan(t: Text, idf: np.ndarray):
    n = len(t.bounds) - 1
    ends = t.bounds[1:]
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
    for phrase, (_, label) in zip(BASE_CODES, BASE, strict=True):
        rare = int(np.argmax(idf[phrase]))
        begin = np.flatnonzero(t.word == phrase[rare]) - rare
        doc = t.doc[begin + rare]
        inside = begin >= t.bounds[doc]
        begin, doc = begin[inside], doc[inside]
        hit = _stands(t, begin, ends[doc], phrase)
        begin, doc = begin[hit], doc[hit]
        np.add.at(n_base, doc, 1)
        np.minimum.at(first, doc, begin - t.bounds[doc])
        np.maximum.at(last, doc, begin - t.bounds[doc])
        for d in np.unique(doc).tolist():
            base[d].add(label)
            labels[d].add(label)
            score[d] = 1.0

    at = np.flatnonzero(t.word >= 0)
    for (label, _, _), codes, phrase, key_at in zip(TEMPLATES, TEMPLATE_CODES, KEY_CODES, KEY_AT, strict=True):
        total = float(idf[codes].sum())
        begin, owner = [], []
        for place in _voters(codes, idf):
            mine = at[t.word[at] == codes[place]]
            begin.append(mine - place)
            owner.append(t.doc[mine])
        begin, owner = map(np.concatenate, (begin, owner))
        if not len(begin):
            continue
        # beginnings before a text's first word stay its own
        spot = np.unique(np.stack([owner, begin]), axis=1)
        d, b = spot
        share = np.zeros(len(b))
        for place, code in enumerate(codes):
            p = b + place
            inside = (t.bounds[d] <= p) & (p < ends[d])
            share[inside] += (t.word[p[inside]] == code) * (idf[code] / total)
        good = share >= MIN_SHARE
        for d, b, share in zip(d[good].tolist(), b[good].tolist(), share[good].tolist(), strict=True):
            near = b + key_at + np.arange(-SLACK, SLACK + 1)
            near = near[near >= t.bounds[d]]
            if _stands(t, near, np.full(len(near), ends[d]), phrase).any():
                labels[d].add(label)
                score[d] = max(score[d], min(1.0, share))
    return n_base, first, last, base, labels, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    idf = frequencies(docs, text_col)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                t = _read(part.column(1))
                n_base, first, last, base, labels, score = _scan(t, idf)
                none = n_base == 0
                joined = [pa.array([",".join(sorted(s)) for s in x], pa.string()) for x in (base, labels)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(t.bounds)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), *joined, pa.array(score)], names)

    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pair.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
