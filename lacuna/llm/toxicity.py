"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the triples of letters that both hold in this order within a
window, the products of their gap-decayed weights, scaled by a function of each word's length. Gaps
and inserted characters so lower a match but don't undo it; punctuation inside words is skipped, and
runs of single letters are read as one word as well. Landmarks are words of the training sentences;
the machine is linear in the Nyström features. As every kernel value is a sum over triples, the
trained machine folds into one weight for each triple, and scoring is a table look-up.

Training takes sentences, long ones in stretches of SPAN characters; a sentence is a row of the machine,
with its document's label. A toxic document has one sentence at least with an insult, a clean one has none
(multi-instance learning): positive rows are the sentences of toxic documents that hold one of a smallest set
of telling words that covers each toxic document, negative rows are sentences of clean documents. The first
machine takes a sentence as the sum of its words' features over its length. Each later one takes it as the
features of its worst word by the machine before, so that the kernel of two sentences is that of their worst
words, and adds the clean sentences that the machine before took for the worst. A text scores as its worst
sentence, through a logistic fit on sampled documents that the machine hasn't seen.

What the fit is made from is bounded, by documented parameters: MAX_DOCS training documents of each
label, the first by a hash of the id, each with one text (of several rows of an id the least); of each
MAX_SENTENCES stretches, evenly spread, of MAX_CHARS characters at most (a longer one is a single word);
NEGATIVES clean sentences at random, and HARD more in each of ROUNDS rounds; LANDMARKS landmarks, half of them telling words of most sentences, the others words
of clean sentences. Scoring reads every word of every text.

Null or empty texts, and texts without a word of three letters, get the score of the bias alone.
Without labelled rows of both kinds every score is the share of toxic ones (0 without any). An id that
is labelled both ways counts as toxic. A null doc_id is not held out and not learnt from. Repeated rows
score alike; extra columns are ignored by `score` and kept by `drop_toxic`. Empty table: empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm._text import LOWER, Words, blocks, flat, ragged

#: Bounds of the training sample and of what is made from it.
MAX_DOCS, MAX_SENTENCES, SPAN, MAX_CHARS, NEGATIVES, HARD, LANDMARKS, ROUNDS = 1500, 400, 300, 600, 6000, 1500, 256, 6
#: INSERTED: the share of COST of a positive sentence whose worst word got a letter put in.
DECAY, WINDOW, COST, INSERTED, COVER, CLEAN = 0.6, 5, 30.0, 0.3, 3, 3.0
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
STRETCH = re.compile(rf"\S.{{0,{SPAN}}}\S*", re.S)

A = 60
#: Letters fold their case; the bytes that follow a UTF-8 lead fold theirs by their low five bits; leads and ASCII punctuation are skipped.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[48:58] = 27
SYMBOL[128:192] = 28 + (np.arange(128, 192) & 31)
OFFSETS = [(j, k) for k in range(2, WINDOW + 1) for j in range(1, k)]


@dataclass
class Model:
    weight: np.ndarray  # of each triple
    bias: float
    slope: float
    shift: float


def _symbols(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' symbols, each word followed by WINDOW zeros, and the len + 1 offsets."""
    data, off = flat(vocab)
    sym = SYMBOL[data]
    used = np.zeros(len(data) + 1, np.int64)
    np.cumsum(sym > 0, out=used[1:])
    edges = used[off] + WINDOW * np.arange(len(off))
    out = np.zeros(int(edges[-1]), np.int32)
    size = np.diff(used[off])
    out[ragged(edges[:-1], size)] = sym[sym > 0]
    return out, edges


def _square(size: np.ndarray) -> np.ndarray:
    return np.maximum(sum(np.maximum(size - k, 0) * DECAY ** (2 * (k - 2)) for _, k in OFFSETS), 1e-9)


def _scale(size: np.ndarray) -> np.ndarray:
    return np.sqrt(_square(size))


def _triples(sym: np.ndarray, j: int, k: int) -> np.ndarray:
    n = len(sym) - WINDOW
    a, b, c = sym[:n], sym[j : n + j], sym[k : n + k]
    return np.where((a > 0) & (b > 0) & (c > 0), (a * A + b) * A + c, 0)


def decision(vocab: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each word. weight[0] is 0."""
    if not len(vocab):
        return np.zeros(0)
    sym, edges = _symbols(vocab)
    total = np.zeros(len(sym) + 1)
    n = len(sym) - WINDOW
    if n > 0:
        each = np.zeros(n)
        for j, k in OFFSETS:
            each += DECAY ** (k - 2) * weight[(sym[:n] * A + sym[j : n + j]) * A + sym[k : n + k]]
        np.cumsum(each, out=total[1 : n + 1])
        total[n + 1 :] = total[n]
    return (total[edges[1:]] - total[edges[:-1]]) / _scale(np.diff(edges) - WINDOW) + bias


def _letters(vocab: pa.Array) -> np.ndarray:
    return np.diff(_symbols(vocab)[1]) - WINDOW


class Bag:
    """The distinct words of some texts, runs of single letters joined to words of their own, and what each text holds."""

    def __init__(self, col: pa.Array):
        data, off = flat(col)
        w = Words(LOWER[data], off)
        self.n = len(col)
        self.vocab = w.vocab
        self.doc, self.code = w.doc, w.code
        single = (_letters(w.vocab) == 1)[w.code] if len(w.code) else np.zeros(0, bool)
        if single.any():
            grow = np.ones(len(single), bool)
            grow[1:] = (single[1:] != single[:-1]) | (w.doc[1:] != w.doc[:-1])
            first = np.flatnonzero(grow)
            size = np.diff(np.append(first, len(single)))
            pick = single[first] & (size >= 3)
            if pick.any():
                words = w.vocab.to_pylist()
                runs = [b"".join(words[c] for c in w.code[a : a + k]) for a, k in zip(first[pick], size[pick], strict=True)]
                more = pa.array(runs, pa.binary()).dictionary_encode()
                self.code = np.concatenate([self.code, more.indices.to_numpy(zero_copy_only=False) + len(words)])
                self.doc = np.concatenate([self.doc, w.doc[first[pick]]])
                self.vocab = pa.concat_arrays([self.vocab, more.dictionary])

    def worst(self, value: np.ndarray, none: float) -> np.ndarray:
        """The largest value among each text's words."""
        out = np.full(self.n, none)
        if len(self.code):
            np.maximum.at(out, self.doc, value[self.code])
        return out


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared hinge with a cost for each row, by Newton's method; the last entry is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        on = y * (z @ w) < 1
        zc = z[on] * cost[on, None]
        new = np.linalg.solve(ridge + zc.T @ z[on], zc.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _witnesses(doc: np.ndarray, code: np.ndarray, value: np.ndarray, v: int) -> np.ndarray:
    """Words that together stand COVER times in each toxic document, where it has so many of a positive value.

    Chosen one by one, the word that helps most documents first: the many words that near copies of one
    document share help no further document once its insults are chosen.
    """
    usable = value[code] > 0
    doc, code = doc[usable], code[usable]
    by = np.argsort(code, kind="stable")
    doc, code = doc[by], code[by]
    at = np.searchsorted(code, np.arange(v + 1))
    need = np.full(int(doc.max()) + 1 if len(doc) else 0, COVER)
    gain = np.diff(at).astype(np.int64)  # an upper bound, brought up to date when it is the largest
    heap = [(-g, i) for i, g in enumerate(gain.tolist()) if g >= 2]
    heapq.heapify(heap)
    out = []
    while heap:
        g, i = heapq.heappop(heap)
        mine = doc[at[i] : at[i + 1]]
        now = int((need[mine] > 0).sum())
        if now < 2:
            continue
        if now < -g:
            heapq.heappush(heap, (-now, i))
            continue
        out.append(i)
        need[mine] -= 1
    return np.array(out, np.int64)


def _worst_words(sentence: np.ndarray, code: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The word of the largest value of each of n sentences, -1 where it has none."""
    order = np.lexsort((-value[code], sentence))
    first = np.ones(len(order), bool)
    first[1:] = sentence[order][1:] != sentence[order][:-1]
    out = np.full(n, -1, np.int64)
    out[sentence[order][first]] = code[order][first]
    return out


def _summed(rows: np.ndarray, at: np.ndarray, code: np.ndarray, square: np.ndarray, features) -> np.ndarray:
    """Each sentence as the sum of its words' features before their scaling, over the sentence's own scale."""
    size = at[rows + 1] - at[rows]
    words, place = np.unique(code[ragged(at[rows], size)], return_inverse=True)
    own = np.repeat(np.arange(len(rows)), size)
    each = features(words) * np.sqrt(square[words])[:, None]
    out = np.zeros((len(rows), each.shape[1]))
    np.add.at(out, own, each[place])
    return out / np.sqrt(np.bincount(own, weights=square[words][place], minlength=len(rows)))[:, None]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit, clean rows CLEAN times as heavy as toxic ones, mildly ridged."""
    cost = np.where(y > 0, 1 / y.sum(), CLEAN / (1 - y).sum()) / (1 + CLEAN) * len(y)
    z, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(60):
        p = _probability(z @ w)
        g = z.T @ (cost * (p - y)) + 1e-2 * w
        h = (z * (cost * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _nystroem(vocab: pa.Array, picks: np.ndarray):
    """A map from words to Nyström features, and one from their weights to those of the triples."""
    marks = vocab.take(pa.array(picks))
    sym, edges = _symbols(marks)
    word = np.repeat(np.arange(len(marks)), np.diff(edges))[: len(sym) - WINDOW]
    scale = _scale(np.diff(edges) - WINDOW)
    codes, rows, values = [], [], []
    for j, k in OFFSETS:
        t = _triples(sym, j, k)
        at = np.flatnonzero(t)
        codes.append(t[at])
        rows.append(word[at])
        values.append(DECAY ** (k - 2) / scale[word[at]])
    codes, rows, values = map(np.concatenate, (codes, rows, values))
    used, column = np.unique(codes, return_inverse=True)
    phi = np.zeros((len(used) + 1, len(marks)))
    np.add.at(phi, (column + 1, rows), values)
    place = np.zeros(A**3, np.int32)
    place[used] = np.arange(1, len(used) + 1)

    def kernel(words: pa.Array) -> np.ndarray:
        s, e = _symbols(words)
        own = np.repeat(np.arange(len(words)), np.diff(e))[: len(s) - WINDOW]
        held = np.zeros((len(words), len(used) + 1), np.float32)
        for j, k in OFFSETS:
            column = place[_triples(s, j, k)]
            at = np.flatnonzero(column)
            np.add.at(held, (own[at], column[at]), np.float32(DECAY ** (k - 2)))
        return (held @ phi) / _scale(np.diff(e) - WINDOW)[:, None]

    value, vector = np.linalg.eigh(kernel(marks) + 1e-8 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    features = lambda words: np.concatenate([kernel(words.slice(a, 1000)) @ root for a in range(0, len(words), 1000)])

    def fold(w: np.ndarray) -> np.ndarray:
        weight = np.zeros(A**3)
        weight[used] = phi[1:] @ (root @ w)
        return weight

    return features, fold


def _inserted(words: list[bytes], rng: np.random.Generator) -> pa.Array:
    """Each ASCII word with a letter put in between."""
    out = []
    for w in words:
        at = int(rng.integers(1, len(w)))
        out.append(w[:at] + bytes([97 + int(rng.integers(26))]) + w[at:])
    return pa.array(out, pa.binary())


def sentences(text: str | None) -> list[str]:
    """At most MAX_SENTENCES sentences of a text, or stretches of long ones, evenly spread."""
    own = [x[:MAX_CHARS] for part in SENTENCE_END.split(text or "") for x in STRETCH.findall(part)]
    return own if len(own) <= MAX_SENTENCES else [own[i * len(own) // MAX_SENTENCES] for i in range(MAX_SENTENCES)]


def train(texts: list[str], toxic: list[int]) -> Model:
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(A**3), 0.0, 0.0, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    rng = np.random.default_rng(7)
    each = [sentences(t) for t in texts]
    bag = Bag(pa.array([x for own in each for x in own], pa.string()))
    text_of = np.repeat(np.arange(len(each)), [len(own) for own in each])  # of each sentence
    fit = np.arange(len(y)) % 3 != 2  # the others are for the logistic fit
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit = np.ones(len(y), bool)
    v = len(bag.vocab)
    pair = np.unique(bag.doc.astype(np.int64) * v + bag.code)
    sentence, code = pair // v, pair % v
    learnt, bad = fit[text_of[sentence]], y[text_of[sentence]]
    pos = np.bincount(code[learnt & bad], minlength=v)
    neg = np.bincount(code[learnt & ~bad], minlength=v)
    value = np.log((pos + 0.5) / (neg + 0.5))
    value[(pos < 2) | (value < np.log(20)) & (neg > 0)] = -9
    long_enough = _letters(bag.vocab) >= 3
    value[~long_enough] = -9
    mine = np.unique(text_of[sentence[learnt & bad]] * v + code[learnt & bad])
    good = _witnesses(mine // v, mine % v, value, v)
    good = good[np.argsort(-pos[good], kind="stable")]
    clean = np.flatnonzero((neg > 0) & long_enough)
    clean = clean[np.argsort(-neg[clean], kind="stable")]  # the most frequent first
    usable = long_enough[code]
    sentence, code, learnt, bad = sentence[usable], code[usable], learnt[usable], bad[usable]
    total = len(text_of)
    at = np.searchsorted(sentence, np.arange(total + 1))
    positive = np.unique(sentence[learnt & bad & np.isin(code, good)])
    harmless = np.unique(sentence[learnt & ~bad])
    negative = rng.choice(harmless, min(len(harmless), NEGATIVES), replace=False)
    square = _square(_letters(bag.vocab))
    quarter = LANDMARKS // 4
    model = worst = None
    for _ in range(ROUNDS if len(positive) and len(negative) else 0):
        if worst is None:
            others = rng.choice(clean, min(len(clean), quarter), replace=False)
        else:
            others = np.unique(worst[negative])
            others = others[np.argsort(-value[others], kind="stable")][:quarter]
        features, fold = _nystroem(bag.vocab, np.unique(np.concatenate([good[: 2 * quarter], clean[:quarter], others])))
        of = lambda words: features(bag.vocab.take(pa.array(words)))  # noqa: B023, E731
        rows = np.concatenate([positive, negative])
        label = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        cost = np.full(len(rows), COST)
        if worst is None:
            z = _summed(rows, at, code, square, of)
        else:
            words, place = np.unique(worst[rows], return_inverse=True)
            inserted = _inserted([w for w in bag.vocab.take(pa.array(worst[positive])).to_pylist() if w.isalpha() and len(w) >= 5], rng)
            z = of(words)[place]
            if len(inserted):
                z = np.concatenate([z, features(inserted)])
            label = np.concatenate([label, np.ones(len(inserted))])
            cost = np.concatenate([cost, np.full(len(inserted), COST * INSERTED)])
        w = _svm(z, label, cost)
        model = fold(w[:-1]), float(w[-1])
        value = decision(bag.vocab, *model)
        value[~long_enough] = model[1]
        worst = _worst_words(sentence, code, value, total)
        hard = harmless[np.argsort(-value[worst[harmless]], kind="stable")[:HARD]]
        negative = np.union1d(negative, hard)
    if model is None:
        return Model(np.zeros(A**3), 0.0, 0.0, float(np.log(y.mean() / (1 - y.mean()))))
    worst = np.full(len(y), model[1])
    np.maximum.at(worst, text_of, bag.worst(decision(bag.vocab, *model), model[1]))
    held = ~fit if not fit.all() else fit
    slope, shift = _logistic(worst[held], y[held].astype(float))
    return Model(model[0].astype(np.float32), model[1], slope, shift)


def scores(col: pa.Array, model: Model) -> np.ndarray:
    bag = Bag(col)
    return _probability(model.slope * bag.worst(decision(bag.vocab, model.weight, model.bias), model.bias) + model.shift)


def fold_of(id_col) -> F.Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled documents outside the held-out fold."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~fold_of(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    ids = known.where("toxic = 1").orderBy(*order).limit(MAX_DOCS).unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_DOCS))
    pair = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sample = pair.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic")  # 2 * MAX_DOCS ids at most
    sample = sample.mapInArrow(_sampled, "h long, doc_id long, text string, toxic int")
    sample = sample.groupBy("h", "doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # a row an id, however often it comes
    row = sample.repartition(1).sortWithinPartitions("h", "doc_id", "text").select("text", "toxic").mapInArrow(_train, "at array<int>, weight array<float>, bias double, slope double, shift double").first()
    if row is None:
        return train([], [])
    weight = np.zeros(A**3, np.float32)
    weight[row["at"]] = row["weight"]
    return Model(weight, row["bias"], row["slope"], row["shift"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences that may be learnt from, a line each."""
    for batch in batches:
        for part in blocks(batch, "text"):
            yield part.set_column(2, "text", pa.array(["\n".join(x.replace("\n", " ") for x in sentences(t)) for t in part.column(2).to_pylist()], pa.string()))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the sample is bounded, and the driver need not hold it."""
    texts, toxic = [], []
    for batch in batches:
        texts += [t or "" for t in batch.column(0).to_pylist()]
        toxic += batch.column(1).to_pylist()
    m = train(texts, toxic)
    at = np.flatnonzero(m.weight)
    yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([m.weight[at].tolist()], pa.list_(pa.float32())), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.shift))], ["at", "weight", "bias", "slope", "shift"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                s = scores(part.column(2), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(fold_of(docs["doc_id"]), F.lit(False)).alias("held_out"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below 0.5, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text_col):
                yield part.filter(pa.array(scores(part.column(part.schema.get_field_index(text_col)), model) < 0.5))

    return docs.mapInArrow(run, docs.schema)
