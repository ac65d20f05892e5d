"""Operator 8, quality classifier: naive Bayes support vectors.

A text's features are indicators (present or not) of hashed n-grams: its words, pairs of words, word shapes
(runs of letter case, digits and marks), pairs and triples of shapes, words repeated in place, and which share of its word
5-grams it has had before.  Indicators are scaled by the class log-count ratio of naive Bayes and to unit length, and
a linear model with squared hinge loss is fitted by dual coordinate descent.  Platt's sigmoid, fitted on a held-out
third of the sample, turns margins into probabilities.

The fit reads at most `per_class` labelled texts of each class, those with the smallest hashes of their ids, one text
an id (of several that of the smallest features);
scoring reads every whole text.  Null and empty texts have no features and get the model's intercept.
Without labels of both classes every score is the share of label 1 (0.5 without labels).  Repeated rows give repeated results; of several
labels of one document the smallest counts; a null id stays null; empty tables give empty results; other columns are not read.  A very long text is one slice, and takes its task
some 200 bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import large_text, map_texts, record, texts
from millrace.llm.words import NONSPACE, Words, byte_values, mix, prefix_hash, span_hash

BITS, PER_CLASS = 18, 3000
_MASK = np.uint64((1 << BITS) - 1)
#: Classes of bytes for shapes: marks stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (text, feature) pairs, sorted, and the number of texts."""
    words = Words(column, NONSPACE)
    n = len(words.first) - 1
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    arr = large_text(column)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    shape = _SHAPE[np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]]]
    head = np.ones(len(shape), bool)
    head[1:] = shape[1:] != shape[:-1]
    head[words.start] = True
    runs = np.flatnonzero(head)
    form = span_hash(prefix_hash(byte_values(shape[runs])), np.searchsorted(runs, words.start), np.searchsorted(runs, words.end))
    owner, count = words.owner(), words.counts()
    last = np.repeat(words.first[1:], count)
    here = np.arange(len(words))
    texts_, hashes = [], []

    def add(salt: int, h: np.ndarray, ok: np.ndarray | slice = slice(None)) -> None:
        texts_.append(owner[: len(h)][ok])
        hashes.append(mix(h[ok] + np.uint64(salt)) & _MASK)

    w, c = words.hash, np.uint64(0x9E3779B97F4A7C15)
    add(1, w)
    add(2, form)
    two = here[:-1] + 1 < last[:-1]
    add(3, w[:-1] * c + w[1:], two)
    add(4, form[:-1] * c + form[1:], two)
    same = two & (w[:-1] == w[1:])
    add(5, np.zeros(len(same), np.uint64), same)
    if len(words) > 2:
        add(6, (form[:-2] * c + form[1:-1]) * c + form[2:], here[:-2] + 2 < last[:-2])
    g, ok = words.grams(5)
    at = np.flatnonzero(ok)
    if len(at):
        key = mix(g[at] ^ mix(owner[at].astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        total = np.bincount(owner[at], minlength=n)
        again = total - np.bincount(owner[at][first], minlength=n)
        level = (8 * again + total - 1) // np.maximum(total, 1)  # 0: none, 1: some, ... 8: nearly all
        for k in range(1, 9):
            some = np.flatnonzero(level >= k)
            texts_.append(some)
            hashes.append(np.full(len(some), mix(np.array([1000 + k], np.uint64))[0] & _MASK))
    key = np.unique(np.concatenate(texts_).astype(np.int64) << BITS | np.concatenate(hashes).astype(np.int64))
    return key >> BITS, key & int(_MASK), n


class Model:
    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, scale: float, shift: float):
        self.weight, self.ratio, self.bias, self.scale, self.shift = (weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, scale, shift

    def score(self, column: pa.Array) -> np.ndarray:
        row, feature, n = features(column)
        norm = np.bincount(row, weights=self.ratio[feature], minlength=n)
        margin = np.bincount(row, weights=self.weight[feature], minlength=n) / np.sqrt(np.maximum(norm, 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def log_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for f, label in zip(rows, y.tolist(), strict=True):
        (p if label > 0 else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 11, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared hinge loss and L2 penalty; a constant feature is the bias.  y: -1 or 1; cost: each row's C."""
    w, b, r = np.zeros(1 << BITS), 0.0, np.random.default_rng(seed)
    alpha, diagonal = np.zeros(len(y)), 0.5 / cost
    square = np.array([v @ v + 1.0 for v in values]) + diagonal
    for _ in range(epochs):
        worst = 0.0
        for i in r.permutation(len(y)).tolist():
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + b) - 1 + diagonal[i] * alpha[i]
            worst = max(worst, abs(min(g, 0.0) if alpha[i] == 0 else g))
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                b += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).sum() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, hold: np.ndarray, c: float = 1.0) -> Model:
    train = np.flatnonzero(~hold)
    own = [rows[i] for i in train]
    ratio = log_ratio(own, y[train])

    def scaled(f: np.ndarray) -> np.ndarray:
        v = ratio[f]
        return v / max(np.sqrt(v @ v), 1e-6)

    share = np.array([(y[train] <= 0).mean(), (y[train] > 0).mean()])
    cost = c * 0.5 / share[(y[train] > 0).astype(int)]
    w, b = dual_coordinate_descent(own, [scaled(f) for f in own], np.where(y[train] > 0, 1.0, -1.0), cost)
    at = np.flatnonzero(hold) if min((y[hold] > 0).sum(), (y[hold] <= 0).sum()) >= 5 else train
    a, s = platt(np.array([w[rows[i]] @ scaled(rows[i]) + b for i in at]), y[at])
    return Model(w, ratio, b, a, s)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, c: float = 1.0) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; others are left out).  The driver gets the sample's features: at most 2 x per_class rows."""
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        p = float(next(iter(sizes))) if sizes else 0.5
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, 1.0, float(np.log((p + 0.01) / (1.01 - p))))
    # per_class rows of each class, so the sample goes to the texts
    smallest = [labels.filter(F.col("quality") == k).orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = docs.join(F.broadcast(smallest[0].unionByName(smallest[1])), "doc_id").select("doc_id", "text", "quality")

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            row, feature, n = features(part.column("text"))
            own = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, n)))
            return record(doc_id=part.column("doc_id"), quality=part.column("quality"), features=pa.array([x.tobytes() for x in own], pa.binary()))

        return work

    # one text an id, however many rows have it; they are told apart before the shuffle
    one = map_texts(chosen, make, "doc_id long, quality int, features binary").groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("x"))
    got = sorted(one.select("doc_id", "x.*").collect(), key=lambda r: r.doc_id)
    rows = [np.frombuffer(r.features, np.int32) for r in got]
    y = np.array([r.quality for r in got])
    hold = np.array([int(mix(np.array([r.doc_id & (1 << 63) - 1], np.uint64))[0]) % 3 == 0 for r in got], bool)
    if len(set(y[~hold].tolist())) < 2:
        hold[:] = False
    if len(set(y.tolist())) < 2:
        p = y.mean() if len(y) else 0.5
        return Model(np.zeros(1 << BITS), np.ones(1 << BITS), 0.0, 1.0, float(np.log((p + 0.01) / (1.01 - p))))
    return fit(rows, y, hold, c)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 x 2**BITS numbers

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            s = sent.value.score(part.column("text"))
            return record(doc_id=part.column("doc_id"), score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32), pa.int32()))

        return work

    return map_texts(texts(docs, id_col, text_col), make, "doc_id long, score double, predicted int")
