"""Toxicity by a chain of linear classifiers over toxicity categories.

Categories are predicted in a fixed order. Each has a logistic model over hashed words and word beginnings
(a word's first 4 and 5 bytes, so that an unseen ending of a known stem counts); from the second on, a
model also gets the probabilities that the earlier ones predict. It is trained with out-of-fold predictions of
those, so it learns how far they can be trusted. Folds go by a hash of the text, so that copies of a text
are never on both sides. The last category's threshold is the one with the best F1 on out-of-fold predictions.

Training reads a bounded sample of labelled rows (``positives`` and ``negatives`` of the last category, by
hash of their id), weighted back to the shares in the whole label table; all features of these rows are used.
Prediction reads every whole text. The models are arrays of fixed length (``1 << BITS``), which is what makes
them safe to broadcast.

Null text is empty and gets the probability of a text without known words. Labels that are null, or that
have no document, are passed over; without labels, or with one class only, every probability is that
class's share and nothing is flagged. Repeated rows are scored alike. An empty table gives an empty
result. Columns of any other name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import ascii_lower, ascii_lowered, slices, span_hashes, text_buffer, word_spans

BITS = 18
_PREFIXES = (4, 5)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the different features it has: (text number, feature), sorted."""
    data, offsets = text_buffer(texts)
    data = ascii_lowered(data)
    starts, ends, counts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    for _ in range(3):
        starts = np.where((starts < ends - 1) & _PUNCTUATION[data[starts]], starts + 1, starts)
        ends = np.where((starts < ends - 1) & _PUNCTUATION[data[ends - 1]], ends - 1, ends)
    hashes = span_hashes(data, (starts, ends), *((starts, np.minimum(starts + k, ends)) for k in _PREFIXES))
    keys = [(doc << BITS) | ((h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64) for k, h in enumerate(hashes)]
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Linear:
    """Weights of hashed features, of earlier categories' probabilities, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, doc: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return _chance(self.bias + np.bincount(doc, self.weights[feature], n) + earlier @ self.earlier)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray, steps: int = 60, decay: float = 1e-4) -> Linear:
    """A logistic model by full-batch gradient steps (Adam), with L2 decay.

    A feature's value is the log-odds by which the class's share among its documents differs from that among all,
    shrunk for rare features: telling features move far in a few steps, chance ones hardly.
    """
    n, share = len(y), float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    bias, weights, extra = float(np.log(share / (1 - share))), np.zeros(1 << BITS), np.zeros(earlier.shape[1])
    if n == 0 or y.min() == y.max():
        return Linear(weights, extra, bias)
    chosen, place = np.unique(feature, return_inverse=True)
    k, plain = len(chosen), y.mean()
    with_, seen = np.bincount(place, y[doc], k), np.bincount(place, minlength=k)
    odds = np.log((with_ + 2 * plain) / (seen - with_ + 2 * (1 - plain))) - np.log(plain / (1 - plain))
    scale = np.abs(odds) * seen / (seen + 3)
    scale /= max(scale.max(initial=0.0), 1e-12)
    value = scale[place]
    theta = np.zeros(k + len(extra) + 1)
    theta[-1] = bias
    m, v, w = np.zeros_like(theta), np.zeros_like(theta), weight / weight.sum()
    for t in range(1, steps + 1):
        g = w * (_chance(np.bincount(doc, theta[place] * value, n) + earlier @ theta[k:-1] + theta[-1]) - y)
        grad = np.concatenate([np.bincount(place, g[doc], k) * scale, earlier.T @ g, [g.sum()]])
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[chosen] = theta[:k] * scale
    return Linear(weights, theta[k:-1].copy(), float(theta[-1]))


@dataclass
class Chain:
    """Linear models in category order, and the threshold of the last category."""

    categories: list[str]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 2.0

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, a column for each category; each is a feature of those after it."""
        p = np.zeros((n, 0))
        for model in self.models:
            p = np.column_stack([p, model.probability(doc, feature, n, p)])
        return p


def fit_chain(categories: list[str], doc: np.ndarray, feature: np.ndarray, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit a chain on documents 0 .. n-1 with ``labels`` (n x categories) of 0 and 1 and a fold number each."""
    n, chain = len(labels), Chain(categories)
    p = np.zeros((n, 0))
    for k in range(len(categories)):
        y, held = labels[:, k].astype(float), np.zeros(n)
        for at in np.unique(fold):
            rows = fold != at
            number = np.cumsum(rows) - 1
            inside = rows[doc]
            model = fit_linear(number[doc[inside]], feature[inside], y[rows], weight[rows], p[rows])
            held[~rows] = model.probability(doc, feature, n, p)[~rows]
        chain.models.append(fit_linear(doc, feature, y, weight, p))
        p = np.column_stack([p, held])
    if n and 0 < labels[:, -1].sum() < n:
        last, y = p[:, -1], labels[:, -1].astype(float)
        order = np.argsort(-last, kind="stable")
        hits, all_ = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
        f1 = 2 * hits / (all_ + (y * weight).sum())
        best = int(np.argmax(f1))
        below = last[order[best + 1]] if best + 1 < n else 0.0
        chain.threshold = float((last[order[best]] + below) / 2)
    return chain


def _featurise(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width, 1 << 20):
            doc, feature = features(batch.column(width))
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            found = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, pa.binary())], [*batch.schema.names[:width], "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", positives: int = 2500, negatives: int = 3500, folds: int = 3) -> Chain:
    """A chain from labelled documents.

    ``categories`` gives, in chain order, a boolean column over ``labels`` for each category. At most
    ``positives + negatives`` documents come to the driver, as feature numbers.
    """
    names = list(categories)
    rows = labels.select(F.col(id_col).alias("id"), *[categories[c].cast("int").alias(f"y{k}") for k, c in enumerate(names)]).dropna()
    last = f"y{len(names) - 1}"
    shares = {r[0]: r[1] for r in rows.groupBy(last).agg(F.count(F.lit(1))).collect()}
    chosen = [rows.where(F.col(last) == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, positives), (0, negatives))]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    width = len(names) + 2
    fold = F.pmod(F.xxhash64(ascii_lower(F.coalesce("text", F.lit("")))), F.lit(folds)).cast("int").alias("fold")
    found = texts.join(F.broadcast(chosen), "id").select("id", fold, *[f"y{k}" for k in range(len(names))], "text")
    kind = dict(found.dtypes)["id"]
    schema = f"id {kind}, fold int, " + ", ".join(f"y{k} int" for k in range(len(names))) + ", features binary"
    got = sorted(found.mapInArrow(_featurise(width), schema).collect(), key=lambda r: (str(r["id"]), r["features"]))
    sample = [np.frombuffer(r["features"], "<i4") for r in got]
    y = np.array([[r[f"y{k}"] for k in range(len(names))] for r in got], np.int64).reshape(len(got), len(names))
    doc = np.repeat(np.arange(len(got)), [len(x) for x in sample]) if got else np.zeros(0, np.int64)
    feature = np.concatenate(sample).astype(np.int64) if got else np.zeros(0, np.int64)
    taken = {v: max(1, int((y[:, -1] == v).sum())) for v in (0, 1)}
    weight = np.array([shares.get(int(v), 1) / taken[int(v)] for v in y[:, -1]], float)
    return fit_chain(names, doc, feature, y, weight, np.array([r["fold"] for r in got], np.int64))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (the whole row), ``id``, ``p_<category>`` for each category and ``flagged`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for array in texts:
            found = []
            for part in slices(iter([pa.RecordBatch.from_arrays([array], ["text"])]), 0, 1 << 20):
                doc, feature = features(part.column(0))
                found.append(model.predict(doc, feature, part.num_rows))
            p = np.concatenate(found) if found else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], names)

    packed = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("id"), predict(docs[text_col].cast("string")).alias("p"))
    return packed.select("doc", "id", "p.*").withColumn("flagged", F.col(names[-1]) >= chain.threshold)
