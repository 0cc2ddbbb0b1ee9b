"""Toxicity categories by a chain of linear classifiers.

Categories are label columns, predicted in order. Each is a logistic model over
the presence of hashed words and over the probabilities of all earlier
categories. A later model is fitted with earlier probabilities that are out of
fold: each training row's come from models that haven't seen it. Words are chosen
per category by how far their presence shifts the label. Models are fitted on the
driver from a bounded sample of labelled rows (``labelled.SAMPLE``); what is
broadcast is bounded by ``CHOSEN`` words a category. All documents are scored in
one pass without a shuffle.

Defined cases: null and empty texts hold no words and get the model's base rate;
a category without labelled rows of both kinds has its share as probability (0
without any rows); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .lattice import held_out
from .textkit import ALNUM, Words, pieces

BUCKET_BITS, CHOSEN, FOLDS, STEPS, RIDGE = 20, 1500, 4, 250, 3e-4


def buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words in each row, each once, sorted."""
    w = Words(raw, at, ALNUM)
    key = (w.rows().astype(np.uint64) << np.uint64(BUCKET_BITS)) | (w.hashes() >> np.uint64(64 - BUCKET_BITS))
    key = np.unique(key)
    return (key >> np.uint64(BUCKET_BITS)).astype(np.int64), (key & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


class Link:
    """One category's model: weights of the chosen buckets and of the earlier probabilities."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.chosen, self.weights, self.earlier, self.bias = chosen, weights, earlier, bias

    def score(self, row: np.ndarray, bucket: np.ndarray, before: np.ndarray) -> np.ndarray:
        margin = np.full(len(before), self.bias) + before @ self.earlier
        if len(self.chosen):
            at = np.minimum(np.searchsorted(self.chosen, bucket), len(self.chosen) - 1)
            hit = self.chosen[at] == bucket
            margin += np.bincount(row[hit], self.weights[at[hit]], len(before))
        return 1 / (1 + np.exp(-margin))


def fit_link(row: np.ndarray, bucket: np.ndarray, before: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression by accelerated gradient steps on the chosen words."""
    n, k = before.shape
    none = np.zeros(0, np.int64)
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Link(none, np.zeros(0), np.zeros(k), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    size = 1 << BUCKET_BITS
    seen, ones = np.bincount(bucket, minlength=size), np.bincount(bucket, y[row], size)
    shift = np.abs(ones - seen * share) / np.sqrt(seen * share * (1 - share) + 1.0)
    shift[seen < 3] = 0
    chosen = np.sort(np.argsort(-shift, kind="stable")[:CHOSEN])
    chosen = chosen[shift[chosen] > 1.0]
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
        keep = chosen[at] == bucket
        r, c = row[keep], at[keep]
    else:
        r, c = none, none
    spread = np.sqrt(np.bincount(c, minlength=len(chosen)) / n + 1e-3)  # rare words get larger steps
    w, e, b = np.zeros(len(chosen)), np.zeros(k), float(np.log(share / (1 - share)))
    state = [np.zeros_like(w), np.zeros_like(e), 0.0]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(b + before @ e + np.bincount(r, w[c], n))))
        err = (p - y) / n
        step = [np.bincount(c, err[r], len(chosen)) / spread + RIDGE * w, before.T @ err + RIDGE * e, err.sum()]
        state = [0.9 * s + g for s, g in zip(state, step, strict=True)]
        w, e, b = w - 1.0 * state[0], e - 0.5 * state[1], b - 0.5 * state[2]
    return Link(chosen, w, e, b)


def fit_chain(row: np.ndarray, bucket: np.ndarray, labels: np.ndarray) -> list[Link]:
    """``labels``: a column a category, in the chain's order."""
    n, k = labels.shape
    fold = np.arange(n) % FOLDS
    before, chain = np.zeros((n, 0)), []
    for j in range(k):
        y = labels[:, j]
        chain.append(fit_link(row, bucket, before, y))
        if j + 1 < k:
            out = np.zeros(n)
            for f in range(FOLDS):
                learn, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                place = np.full(n, -1)
                place[learn] = np.arange(len(learn))
                used = place[row] >= 0
                link = fit_link(place[row[used]], bucket[used], before[learn], y[learn])
                out[test] = link.score(row, bucket, before)[test]
            before = np.column_stack([before, out])
    return chain


def run_chain(chain: list[Link], row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    before = np.zeros((n, 0))
    for link in chain:
        before = np.column_stack([before, link.score(row, bucket, before)])
    return before


def _kind(docs: DataFrame, doc_id: str) -> str:
    return docs.schema[doc_id].dataType.simpleString()


def train(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", **more) -> list[Link]:
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for lo, hi, raw, at in pieces(batch.column("text")):
                row, bucket = buckets(raw, at)
                words += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in words], pa.binary()), *(batch.column(c) for c in categories)], names=["doc_id", "words", *categories])

    sampled = labelled.sample(docs, labels, categories, doc_id=doc_id, **more)
    rows = sampled.mapInArrow(held, ", ".join([f"doc_id {_kind(docs, doc_id)}", "words binary", *(f"`{c}` double" for c in categories)])).toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    words = [np.frombuffer(x, np.int32) for x in rows.column("words").to_pylist()]
    row = np.repeat(np.arange(len(words)), [len(x) for x in words]) if words else np.zeros(0, np.int64)
    bucket = np.concatenate([np.zeros(0, np.int32), *words]).astype(np.int64)
    y = np.column_stack([rows.column(c).to_numpy() for c in categories]) if words else np.zeros((0, len(categories)))
    return fit_chain(row, bucket, y)


def score(docs: DataFrame, labels: DataFrame, categories: list[str], text: str = "text", doc_id: str = "doc_id", **more) -> DataFrame:
    """Rows doc_id, held_out and ``p_<category>`` for each category."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, text=text, doc_id=doc_id, **more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [run_chain(chain.value, *buckets(raw, at), hi - lo) for lo, hi, raw, at in pieces(batch.column("text"))]
            p = np.concatenate([np.zeros((0, len(categories))), *p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(p[:, j]) for j in range(p.shape[1]))], names=["doc_id", "held_out", *(f"p_{c}" for c in categories)])

    lean = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 3).alias("held_out"), F.col(text).alias("text"))
    return lean.mapInArrow(run, ", ".join([f"doc_id {_kind(docs, doc_id)}", "held_out boolean", *(f"`p_{c}` double" for c in categories)]))
