"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shares and means of a text's words, lines and characters; no
id, language, source or label is among them. Trees are fitted on the driver from a
bounded sample of labelled rows (``labelled.SAMPLE``), flattened into arrays and
broadcast (their size is fixed by ``TREES`` and ``DEPTH``); all documents are scored
in one pass, every tree traversed for all rows of a batch at once.

Defined cases: null and empty texts have statistics of zero and are scored like
any other; without labelled rows of both kinds every score is the share of label 1,
or 0.5 without any; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .lattice import held_out
from .repetition import _per_row, document_stats
from .textkit import LOWER, SPACE, Words, pieces

TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 80, 4, 64, 0.15, 20, 1.0

_CLASSES = {
    "upper": list(range(0x41, 0x5B)),
    "digit": list(range(0x30, 0x3A)),
    "stop": [ord(c) for c in ".?!"],
    "comma": [ord(c) for c in ",;:"],
    "loud": [ord("!")],
    "bar": [ord("|")],
    "mark": [ord(c) for c in "#*$%&<>"],
    "slash": [ord(c) for c in "/\\@=_"],
    "line": [0x0A],
}
_MASKS = {k: np.isin(np.arange(256), v) for k, v in _CLASSES.items()}


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Statistics of each row, in a fixed order of columns."""
    s = document_stats(raw, at, 8)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    w = Words(raw, at, LOWER)
    row, h, size = w.rows(), w.hashes(), w.ends - w.starts
    order = np.lexsort((h, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    n = len(at) - 1
    columns = [
        np.log1p(s["n_words"]), s["word_chars"] / words, np.bincount(row[order][new], minlength=n) / words, s["n_repeat_words"] / words, np.log1p(s["longest_repeat"]), s["n_dup_lines"] / words,
        np.bincount(row, size <= 3, n) / words, np.bincount(row, size >= 12, n) / words, np.sqrt(np.bincount(row, size.astype(float) ** 2, n) / words), _per_row((raw >= 0xC0), at) / chars,
        *(_per_row(m[raw], at) / (words if k in ("stop", "comma", "line", "loud", "bar", "mark") else chars) for k, m in _MASKS.items()),
        _per_row(SPACE[raw], at) / chars,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Flattened complete trees: inner node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, base: float):
        self.base = base
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains on histograms of quantile bins."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    trees = Trees(float(np.log(y.mean() / (1 - y.mean()))))
    margin = np.full(len(y), trees.base)
    inner, width = (1 << DEPTH) - 1, x.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            local = node - first
            gain = np.full((many, width), -np.inf)
            place = np.zeros((many, width), np.int64)
            for j in range(width):
                key = local * BINS + code[:, j]
                G, H, C = (np.bincount(key, v, many * BINS).reshape(many, BINS).cumsum(1) for v in (g, hess, None))
                left = (C >= LEAF) & (C[:, -1:] - C >= LEAF)
                part = lambda a, b: a * a / (b + RIDGE)
                got = np.where(left, part(G, H) + part(G[:, -1:] - G, H[:, -1:] - H) - part(G[:, -1:], H[:, -1:]), -np.inf)
                got[:, len(cuts[j]) :] = -np.inf
                place[:, j] = got.argmax(1)
                gain[:, j] = got.max(1)
            best = gain.argmax(1)
            for k in range(many):
                if gain[k, best[k]] > 1e-9:
                    feature[first + k] = best[k]
                    threshold[first + k] = cuts[best[k]][place[k, best[k]]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, hess, inner + 1) + RIDGE)
        margin += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.value.append(value)
    return trees


def _features(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(_MASKS) + 11), np.float32), *(features(raw, at) for _, _, raw, at in pieces(batch.column(text)))])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", **more) -> Trees:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch, "text")
            yield pa.RecordBatch.from_arrays([pa.array([*map(bytes, x)], pa.binary()), batch.column(label), batch.column("doc_id")], names=["x", "y", "doc_id"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = labelled.sample(docs, labels, [label], doc_id=doc_id, **more).mapInArrow(measured, f"x binary, y double, doc_id {kind}").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, len(_MASKS) + 11)
    return fit(x, rows.column("y").to_numpy())


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", **more) -> DataFrame:
    """Rows doc_id, held_out, score (0 to 1), predicted."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text=text, doc_id=doc_id, **more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = trees.value.score(_features(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    lean = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 3).alias("held_out"), F.col(text).alias("text"))
    return lean.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, score double, predicted int")
