"""Quality rules by repetition coverage.

Words are runs without ASCII white space. For several lengths n, rolling hashes of the n-grams of a
text's words find those that occur twice or more in it (all their occurrences, confirmed on the words
themselves), and the code points of the words inside them are summed. A text is rejected when such
n-grams, or lines equal to an earlier line, hold too large a share of its characters. Everything is
counted over whole texts, one text by itself, in numpy over Arrow batches; nothing is shuffled.

Null text: no words, all counts 0, rejected (fewer than 10 words). Empty texts likewise. Repeated
rows are judged each by itself. Extra columns are kept by `keep_good` and ignored by `assess`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm._text import ASCII_SPACE, Words, blocks, flat, mix

#: n-gram length -> largest percentage of the words' characters inside duplicated n-grams.
COVER_MAX = {3: 45, 5: 30, 8: 25}
#: Largest percentage of the words' characters on lines equal to an earlier one.
LINE_MAX = 30
MIN_WORDS, BASE_N, BASE_MAX = 10, 5, 20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup{n}_chars" for n in COVER_MAX)]


def per_text(mask_or_weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask_or_weight) + 1, np.int64)
    np.cumsum(mask_or_weight, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeats(key: np.ndarray, same) -> np.ndarray:
    """Which entries have an equal one elsewhere; same(i, j) confirms equal keys on the values themselves."""
    coded = pa.array(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    many = np.bincount(coded)[coded] > 1 if len(coded) else np.zeros(0, bool)
    at = np.flatnonzero(many)
    first = np.full(coded.max() + 1 if len(coded) else 0, len(key))
    np.minimum.at(first, coded[at], at)
    if not same(at, first[coded[at]]).all():  # two different n-grams with one 64-bit hash
        raise ArithmeticError("hash collision")
    return many


def repeated_windows(w: Words, n: int) -> np.ndarray:
    """For each word: is it inside an n-gram that its text holds twice or more?"""
    words = len(w.code)
    covered = np.zeros(words + 1, np.int64)
    if words >= n:
        starts = np.flatnonzero(np.arange(words - n + 1) + n <= w.bounds[1:][w.doc[: words - n + 1]])
        for seed in (0, 1, 2):
            value = mix(w.code.astype(np.uint64) + np.uint64(seed << 40))
            with np.errstate(over="ignore"):
                key = mix(w.doc[starts].astype(np.uint64) ^ np.uint64(0xA5A5 + seed))
                for k in range(n):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + value[starts + k]
            same = lambda i, j: (w.doc[starts[i]] == w.doc[starts[j]]) & np.logical_and.reduce([w.code[starts[i] + k] == w.code[starts[j] + k] for k in range(n)])  # noqa: B023, E731
            try:
                hit = starts[repeats(key, same)]
                break
            except ArithmeticError:
                if seed == 2:
                    raise
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + n, -1)
    return np.cumsum(covered[:-1]) > 0


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    data, off = flat(col)
    w = Words(data, off)
    lead = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    chars = points[w.end] - points[w.start]
    out = {"n_words": np.diff(w.bounds), "word_chars": per_text(chars, w.bounds)}
    out["n_symbols"] = per_text(SYMBOL[data], off)

    newline = np.zeros(256, bool)
    newline[10] = True
    lines = Words(data, off, newline)  # lines without a character are no lines with a word
    in_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~ASCII_SPACE[data] & lead, out=in_word[1:])
    line_chars = in_word[lines.end] - in_word[lines.start]
    key = lines.doc.astype(np.int64) * max(1, len(lines.vocab)) + lines.code
    coded = pa.array(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    later = np.ones(len(coded), bool)
    later[np.unique(coded, return_index=True)[1]] = False
    later &= line_chars > 0
    out["n_dup_lines"] = per_text(later, lines.bounds)
    out["dup_line_chars"] = per_text(np.where(later, line_chars, 0), lines.bounds)
    for n in COVER_MAX:
        inside = repeated_windows(w, n)
        out[f"dup{n}_chars"] = per_text(np.where(inside, chars, 0), w.bounds)
        if n == BASE_N:
            out["n_repeat_words"] = per_text(inside, w.bounds)
    return out


def verdict(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > BASE_MAX * c["n_words"])
    bad = base | (100 * c["dup_line_chars"] > LINE_MAX * c["word_chars"])
    for n, most in COVER_MAX.items():
        bad = bad | (100 * c[f"dup{n}_chars"] > most * c["word_chars"])
    return base, ~bad


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                c = measure(part.column(1))
                base, kept = verdict(c)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(base), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])

    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pair.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                yield part.filter(pa.array(verdict(measure(part.column(part.schema.get_field_index(text_col))))[1]))

    return docs.mapInArrow(run, docs.schema)


def _sql() -> str:
    parts, picks = [], []
    for n in COVER_MAX:
        gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER p" for k in range(1, n))])
        parts.append(f"g{n} AS (SELECT doc_id, i, word, {gram} AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i))")
        parts.append(f"r{n} AS (SELECT doc_id, i, word, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS hit FROM g{n})")
        parts.append(f"c{n} AS (SELECT doc_id, length(word) AS n, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS covered FROM r{n})")
        parts.append(f"s{n} AS (SELECT doc_id, sum(CASE WHEN covered = 1 THEN n ELSE 0 END) AS dup{n}_chars, sum(covered) AS words{n} FROM c{n} GROUP BY doc_id)")
        picks.append(f"CAST(coalesce(dup{n}_chars, 0) AS BIGINT) AS dup{n}_chars")
    word = r"[^\x20\x09-\x0D]+"
    space = r"[\x20\x09-\x0D]"
    bad = " OR ".join([f"100 * dup_line_chars > {LINE_MAX} * word_chars", *(f"100 * dup{n}_chars > {m} * word_chars" for n, m in COVER_MAX.items())])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{word}') AS ws FROM t)),
{", ".join(parts)},
ww AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)),
lc AS (SELECT doc_id, length(regexp_replace(line, '{space}', '', 'g')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l),
ll AS (SELECT doc_id, sum(CASE WHEN nth > 1 AND n > 0 THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN nth > 1 THEN n ELSE 0 END) AS dup_line_chars FROM lc GROUP BY doc_id),
a AS (SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(words{BASE_N}, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(picks)}
  FROM t LEFT JOIN ww USING (doc_id) LEFT JOIN ll USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in COVER_MAX)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX} * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR {bad}) AS kept FROM b
"""


ORACLE = _sql()
