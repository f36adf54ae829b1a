"""Quality classifier: a linear SVM on n-gram indicators scaled by Naive Bayes log-count ratios.

Features are words, pairs of words, word shapes, pairs of shapes, and which eighth of the words repeat the one before or
are new, hashed to 2**BITS indicators. Each is scaled by
the log of its smoothed share in the one class over that in the other, rows are brought to unit length, and a hinge
loss is minimised by dual coordinate descent. A logistic curve fitted to margins of rows held back turns a margin into
a score.

Scale: the fit uses at most `rows` labelled rows, chosen by a hash of doc_id, so it is of one size whatever the
corpus and runs as one task on an executor, the driver holding the finished weights only; every document is then
scored in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, text_of
from .words import GOLD, M1, M2, POWERS, VALUE, grouped, mix, places, scanned, spans, summed

BITS = 18
#: Most labelled rows that a model is fitted on.
TRAIN_ROWS = 8_000
#: Kinds of bytes in a word's shape: upper case, lower case and letters beyond ASCII, digits; any other is its own.
SHAPE = np.array([88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c > 127 else 57 if 48 <= c <= 57 else c for c in range(256)])
#: Runs of a shape that count.
RUNS = 15


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash in lower case, hash of the shape: kinds of bytes, runs of one as one) of the words of bytes."""
    start, end, at = spans(text)
    if not len(start):
        return start, np.empty(0, np.uint64), np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    kind = SHAPE[text[at]]
    opens = np.append(True, kind[1:] != kind[:-1])
    opens[first] = True
    run = np.cumsum(opens) - 1
    run -= np.repeat(run[first], size)
    value = np.where(opens & (run < RUNS), mix(kind.astype(np.uint64) + GOLD) * POWERS[np.minimum(run, RUNS)], np.uint64(0))
    return start, mix(summed(VALUE[text[at]], first, size) + size.astype(np.uint64) * GOLD), mix(np.add.reduceat(value, first) + M2)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indicators, how many) of texts: those of a text are sorted and distinct; one without words has none."""
    n, (h, shape) = scanned(texts, _words)
    own, place = np.repeat(np.arange(len(n)), n), places(n)
    after = np.flatnonzero(place)
    again = np.bincount(own[after], h[after] == h[after - 1], len(n)).astype(np.int64)
    new = np.bincount(_distinct((own << 40) | (h >> np.uint64(24)).astype(np.int64)) >> 40, minlength=len(n))
    some = np.flatnonzero(n)
    pair = lambda x: (x[after - 1] * GOLD) ^ (x[after] + np.uint64(1)) * M1
    every = np.concatenate((h, shape, pair(h), pair(shape), (101 + 8 * again[some] // n[some]).astype(np.uint64), (201 + 8 * new[some] // n[some]).astype(np.uint64)))
    at = np.concatenate((own, own, own[after], own[after], some, some))
    found = _distinct((at << BITS) | (every * GOLD >> np.uint64(64 - BITS)).astype(np.int64))
    return (found & ((1 << BITS) - 1)).astype(np.int32), np.bincount(found >> BITS, minlength=len(n))


def features(text: str) -> np.ndarray:
    """The indicators of one text."""
    return indicators([text.encode("utf-8", "surrogatepass")])[0]


MODEL = ["weight", "square", "bias", "slope", "shift"]


@dataclass
class Model:
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1, of many texts at once."""
        out = []
        for part in grouped(texts):
            x, n = indicators(texts[part])
            sums = lambda w, x=x, n=n: np.bincount(np.repeat(np.arange(len(n)), n), w[x], len(n))
            margin = sums(self.weight) / np.maximum(1e-9, np.sqrt(sums(self.square))) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))
        return np.concatenate(out) if out else np.empty(0)

    def margin(self, x: np.ndarray) -> float:
        return float(self.weight[x].sum(dtype=np.float64) / max(1e-9, float(self.square[x].sum(dtype=np.float64)) ** 0.5)) + self.bias


def _margins(rows: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int = 7) -> Model:
    """Ratios, then dual coordinate descent for the hinge loss, one document at a time in random order."""
    n = 1 << BITS
    counts = {s: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == s] or [np.empty(0, np.int32)]), minlength=n) + 1.0 for s in (1, -1)}
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    unit = [ratio[r] / max(1e-9, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]
    w, bias, alpha, order = np.zeros(n), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, r = unit[i], rows[i]
            gradient = y[i] * (float(w[r] @ x) + bias) - 1
            norm = float(x @ x) + 1
            new = min(max(alpha[i] - gradient / norm, 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12) -> Model:
    """The model of all rows, its logistic curve from margins of three folds held back. With one class or no rows the score is constant."""
    y = np.where(labels > 0, 1, -1)
    plus = int((y > 0).sum())
    if len(y) < 6 or plus in (0, len(y)):
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log((plus + 1) / (len(y) - plus + 1))))
    held = np.empty(len(y))
    for fold in range(3):
        on = [i for i in range(len(y)) if i % 3 != fold]
        part = _margins([rows[i] for i in on], y[on], cost, epochs)
        for i in range(fold, len(y), 3):
            held[i] = part.margin(rows[i])
    target = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (len(y) - plus + 2))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(a * held + b, -35, 35)))
        g = np.array([((p - target) * held).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * held * held).sum() + 1e-3, (s * held).sum()], [(s * held).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    model = _margins(rows, y, cost, epochs)
    model.slope, model.shift = a, b
    return model


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no label is learnt from; also for those with a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == 0, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of label 1 against 0 from at most `rows` rows of labels (doc_id, label) that docs (doc_id, text) has.

    Null ids and labels are left out; a doc_id with several labels counts by their mean.
    """
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([features(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))
        return pa.record_batch([b.column(0), found, b.column(2)], ["doc_id", "x", "label"])

    def model(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = table.column("x").combine_chunks()
        rows = [r.values.to_numpy(zero_copy_only=False) for r in x]
        m = fit(rows, (table.column("label").to_numpy() >= 0.5).astype(int))
        return pa.table([pa.array([m.weight.tobytes()]), pa.array([m.square.tobytes()]), *(pa.array([v]) for v in (m.bias, m.slope, m.shift))], MODEL)

    text = docs.select("doc_id", text_of().alias("text"))
    found = batches(text.join(F.broadcast(chosen), "doc_id"), run, "doc_id long, x array<int>, label double")
    got = found.groupBy(F.lit("all").alias("all")).applyInArrow(model, "weight binary, square binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([], np.empty(0, int))
    return Model(np.frombuffer(got[0].weight, np.float32), np.frombuffer(got[0].square, np.float32), got[0].bias, got[0].slope, got[0].shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with score from 0 to 1. Null and empty texts score by the bias; repeated rows stay; other columns are ignored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), pa.array(shared.value.scores(b.column(1).cast(pa.binary()).to_pylist()))], ["doc_id", "score"])

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, score double")


def passed(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all columns, that score least or more."""
    shared, names, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(at).to_pylist()]
        return b.filter(pa.array(shared.value.scores(texts) >= least))

    found = batches(docs.toDF(*[f"c{i}" for i in range(len(names))]), run, schema)
    return found.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)])
