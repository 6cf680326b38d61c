"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, each filter keeps its largest
response in the window (max pooling), and a softmax layer reads the maxima. The network is trained in
numpy (Adam) on windows of labelled texts. A whole text is cut into windows; the last one reaches back
so that it is full; their mean log-probabilities give the text's language.

As the input of a convolution is a byte, a filter is a sum of table entries, two bytes at a time.

The training sample is bounded, by parameters of `fit`'s module: the MAX_LANGS most frequent values of
lang in the training fold (ties by name), MAX_DOCS documents of each, the first by a hash of the id,
and DOC_WINDOWS evenly spread windows of each document. Windows are cut where the texts are; one task
trains on at most MAX_WINDOWS windows of each language. Prediction reads every window of every text.

Null texts, empty ones and those without a letter: `und` with score 0; likewise all texts if there is
nothing to learn from. Languages that score alike: the first by name. A null doc_id is not held out and
not learnt from. Repeated rows are predicted alike; extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm._text import LOWER, blocks, flat, ragged

#: Bounds of the training sample.
MAX_LANGS, MAX_DOCS, DOC_WINDOWS, MAX_WINDOWS = 1000, 250, 8, 800
WINDOW, WIDTHS, FILTERS, EPOCHS, BATCH = 160, (2, 4, 6), 12, 6, 64
CHUNK = 512
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    filters: list[np.ndarray]  # for each width: its bytes x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width a table by byte pair for each two bytes of it."""
        return [[(f[k][:, None] + f[k + 1][None]).reshape(65536, -1) for k in range(0, len(f), 2)] for f in self.filters]


def places(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window begins, and the text of each."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    k = ragged(np.zeros(len(n), np.int64), n)
    return off[doc] + np.maximum(np.minimum(k * WINDOW, size[doc] - WINDOW), 0), doc


def windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The windows' bytes along the first axis. Windows of short texts are padded with zeros."""
    place = begin + np.arange(WINDOW)[:, None]
    return np.where(place < end, LOWER[data[np.minimum(place, max(0, len(data) - 1))]], 0).astype(np.uint8)


def pooled(pairs: list[list[np.ndarray]], bias: np.ndarray, win: np.ndarray) -> np.ndarray:
    two = win[:-1].astype(np.int32) * 256 + win[1:]
    parts = []
    for w, tables in zip(WIDTHS, pairs, strict=True):
        length = WINDOW - w + 1
        y = tables[0][two[:length]]
        for i, t in enumerate(tables[1:], 1):
            y += t[two[2 * i : 2 * i + length]]
        parts.append(y.max(axis=0))
    return np.maximum(np.hstack(parts) + bias, 0)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def predict(col: pa.Array, model: Model | None, pairs: list[list[np.ndarray]] | None = None) -> tuple[list[str], np.ndarray]:
    if model is None or not len(col):
        return ["und"] * len(col), np.zeros(len(col))
    pairs = pairs or model.pairs()
    data, off = flat(col)
    begin, doc = places(off)
    total = np.zeros((len(col), len(model.langs)))
    for a in range(0, len(begin), CHUNK):
        own = doc[a : a + CHUNK]
        win = windows(data, begin[a : a + CHUNK], off[own + 1])
        np.add.at(total, own, log_softmax(pooled(pairs, model.bias, win) @ model.out + model.out_bias))
    count = np.bincount(doc, minlength=len(col))
    p = np.exp(log_softmax(total / np.maximum(count, 1)[:, None]))
    best, raw = p.argmax(axis=1), data.tobytes()
    has = [LETTER.search(raw[a:b].decode("utf-8", "replace")) is not None for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, p.max(axis=1), 0.0)


def train(win: np.ndarray, langs: np.ndarray, only: np.ndarray) -> Model | None:
    """win: a row of bytes for each window; only: whether it is its text's only one."""
    names = sorted(set(langs.tolist()))
    if not names:
        return None
    rng = np.random.default_rng(5)
    y = np.searchsorted(names, langs)
    full = (win[:, 20] > 0) | only
    keep = []
    for c in range(len(names)):
        own = np.flatnonzero((y == c) & full)
        keep.append(rng.permutation(own)[:MAX_WINDOWS])
    keep = rng.permutation(np.concatenate(keep))
    if not len(keep):
        return None
    x, y = win[keep], y[keep]
    # some windows are cut short, so that short texts are learnt too
    x = x.copy()
    short = rng.random(len(x)) < 0.25
    x[short] = np.where(np.arange(WINDOW) < rng.integers(24, WINDOW, short.sum())[:, None], x[short], 0)
    n_f, n_c = FILTERS * len(WIDTHS), len(names)
    p = {f"w{w}": rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"b": np.zeros(n_f, np.float32), "o": rng.normal(0, 0.2, (n_f, n_c)).astype(np.float32), "c": np.zeros(n_c, np.float32)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            xb, yb = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
            at, top = [], []
            for w in WIDTHS:
                length = WINDOW - w + 1
                z = sum(p[f"w{w}"][k][xb[:, k : k + length]] for k in range(w))
                at.append(z.argmax(axis=1))
                top.append(np.take_along_axis(z, at[-1][:, None, :], 1)[:, 0])
            pre = np.hstack(top) + p["b"]
            h = np.maximum(pre, 0)
            drop = (rng.random(h.shape) > 0.2) / np.float32(0.8)
            prob = np.exp(log_softmax((h * drop) @ p["o"] + p["c"]))
            prob[np.arange(len(yb)), yb] -= 1
            prob /= len(yb)
            g = {"o": (h * drop).T @ prob, "c": prob.sum(axis=0)}
            dh = (prob @ p["o"].T) * drop * (pre > 0)
            g["b"] = dh.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                gw = np.zeros_like(p[f"w{w}"])
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), d.shape)
                for k in range(w):
                    np.add.at(gw[k], (np.take_along_axis(xb, at[i] + k, 1), f), d)
                g[f"w{w}"] = gw
            step += 1
            rate = 0.02 * (1 - 0.8 * epoch / EPOCHS)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, [p[f"w{w}"] for w in WIDTHS], p["b"], p["o"], p["c"])


def fold_of(id_col) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most DOC_WINDOWS windows of each text, evenly spread, as one binary value."""
    for batch in batches:
        for part in blocks(batch, "text"):
            data, off = flat(part.column(2))
            begin, doc = places(off)
            bounds, rows = np.searchsorted(doc, np.arange(part.num_rows + 1)), []
            for i in range(part.num_rows):
                n = int(bounds[i + 1] - bounds[i])
                pick = bounds[i] + (np.arange(DOC_WINDOWS) * n // DOC_WINDOWS if n > DOC_WINDOWS else np.arange(n))
                rows.append(np.ascontiguousarray(windows(data, begin[pick], np.full(len(pick), off[i + 1])).T).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["lang", "h", "win"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the sample is bounded, and the driver need not hold it."""
    langs, rows = [], []
    for batch in batches:
        langs += batch.column(0).to_pylist()
        rows += batch.column(1).to_pylist()
    n = [len(r) // WINDOW for r in rows]
    win = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)
    m = train(win, np.repeat(np.array(langs, object), n).astype(str), np.repeat(np.array(n, np.int64) == 1, n)) if len(win) else None
    if m is not None:
        flat_filters = np.concatenate([f.ravel() for f in m.filters])
        yield pa.RecordBatch.from_arrays([pa.array([m.langs], pa.list_(pa.string())), *(pa.array([x.ravel().tolist()], pa.list_(pa.float32())) for x in (flat_filters, m.bias, m.out, m.out_bias))], ["langs", "filters", "bias", "out", "out_bias"])


def fit(docs: DataFrame) -> Model | None:
    """Learns from the labelled documents outside the held-out fold."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~fold_of(F.col("doc_id")))
    # of a frequent language first a share of the ids, some four times MAX_DOCS, by hash; of those the first
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1))
    share = F.least(F.lit(1.0), F.lit(4.0 * MAX_DOCS) / F.col("n")) * float(1 << 62)
    langs = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang", share.alias("share"))
    some = own.join(F.broadcast(langs), "lang").where(h <= F.col("share")).select("lang", h.alias("h"), "text")  # MAX_LANGS rows at most
    some = some.mapInArrow(_sampled, "lang string, h long, win binary")
    first = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "win"))).where(F.col("nth") <= MAX_DOCS)
    row = first.repartition(1).sortWithinPartitions("h", "lang", "win").select("lang", "win").mapInArrow(_train, "langs array<string>, filters array<float>, bias array<float>, out array<float>, out_bias array<float>").first()
    if row is None:
        return None
    each = np.split(np.array(row["filters"], np.float32), np.cumsum([w * 256 * FILTERS for w in WIDTHS])[:-1])
    n_f = FILTERS * len(WIDTHS)
    return Model(list(row["langs"]), [f.reshape(w, 256, FILTERS) for f, w in zip(each, WIDTHS, strict=True)], np.array(row["bias"], np.float32), np.array(row["out"], np.float32).reshape(n_f, -1), np.array(row["out_bias"], np.float32))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.pairs() if model else None
        for batch in batches:
            for part in blocks(batch, "text"):
                lang, score = predict(part.column(2), model, pairs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(fold_of(docs["doc_id"]), F.lit(False)).alias("held_out"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
