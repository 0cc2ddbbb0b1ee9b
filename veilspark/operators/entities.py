"""Named entities: words, windows, spans from scores, and one flat set of entities.

The model is pluggable: a function from windows of words and labels to scores of
shape (words, labels, 3): start, end and inside, as logits. It is loaded once a
Python worker. None is built in.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..policy import Policy
from . import spans
from .detect import Engine

WINDOW, OVERLAP, MAX_WORDS, THRESHOLD = 256, 32, 12, 0.3
LABELS = ("person", "organization", "address", "phone number", "username", "password")
_WORD = re.compile(tables.WORD)
Scorer = Callable[[list[str], tuple[str, ...]], np.ndarray]


class EntityError(ValueError):
    pass


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    label: str
    score: float


def words(text: Column | str) -> Column:
    """Words with offsets, as Column expressions."""
    return spans.scan(text, "(?U)" + tables.WORD)


def windows(n: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of (start, end) over ``n`` words: the last is cut off, none for no words."""
    step = size - overlap
    count = F.when(n <= 0, 0).otherwise(F.greatest(F.ceil((n - overlap) / F.lit(float(step))), F.lit(1))).cast("int")
    at = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * step).cast("int").alias("start"), F.least(k * step + size, n).cast("int").alias("end"))))
    return F.coalesce(at, F.array().cast("array<struct<start:int,end:int>>"))


def decode(scores: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """(first word, last word, label, score): spans that open and close at the threshold and stay inside it."""
    if scores.ndim != 3 or scores.shape[2] != 3:
        raise EntityError(f"scores of shape {scores.shape}")
    p = 1 / (1 + np.exp(-scores.astype(np.float32)))
    n, out = len(p), []
    for a, label in np.argwhere(p[:, :, 0] >= threshold).tolist():
        inside = p[a : min(a + MAX_WORDS, n), label, 2]
        stop = np.flatnonzero(inside < threshold)
        inside = inside[: stop[0]] if len(stop) else inside
        means = np.cumsum(inside, dtype=np.float64) / np.arange(1, len(inside) + 1)
        out += [(a, a + k, label, float(means[k])) for k in np.flatnonzero(p[a : a + len(inside), label, 1] >= threshold).tolist()]
    return out


def flat(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Disjoint spans: the best score first, in order of appearance where equal."""
    kept: list[tuple[int, int, int, float]] = []
    for s in sorted(found, key=lambda s: -s[3]):
        if all(s[1] < k[0] or s[0] > k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def entities_of(text: str, scorer: Scorer, labels: tuple[str, ...] = LABELS, threshold: float = THRESHOLD) -> list[Entity]:
    found = [m.span() for m in _WORD.finditer(text)]
    if not found or not labels:
        return []
    tokens, step, all_spans = [text[a:b] for a, b in found], WINDOW - OVERLAP, []
    for k in range(max(math.ceil((len(found) - OVERLAP) / step), 1)):
        part = tokens[k * step : k * step + WINDOW]
        scores = np.asarray(scorer(part, labels))
        if scores.shape != (len(part), len(labels), 3):
            raise EntityError(f"scores of shape {scores.shape} for {len(part)} words and {len(labels)} labels")
        all_spans += [(a + k * step, b + k * step, label, s) for a, b, label, s in decode(scores, threshold)]
    return [Entity(found[a][0], found[b][1], labels[label], s) for a, b, label, s in flat(all_spans)]


def find(df: DataFrame, load: Callable[[], Scorer], labels: tuple[str, ...] = LABELS, threshold: float = THRESHOLD, text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """``df`` with entities: array of start, end, label, score, category, replacement."""
    entity = "array<struct<start:int,end:int,label:string,score:double,category:string,replacement:string>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64()), ("category", pa.string()), ("replacement", pa.string())]))
    base, handle = df.drop("entities"), df.sparkSession.sparkContext.broadcast(Engine(policy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, scorer = handle.value, None
        for batch in batches:
            scorer = scorer or load()
            out = []
            for value in batch.column(text).to_pylist():
                rows = []
                for e in entities_of(value or "", scorer, labels, threshold):
                    own = value[e.start : e.end]
                    hide = e.label == "password"
                    rows.append({"start": e.start, "end": e.end, "label": e.label, "score": e.score, "category": "secret" if hide else "pii", "replacement": engine.mask_secret(own) if hide else engine.mask_pii(own)})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "entities"])

    return base.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"entities {entity}"]))


def serve(lines: Iterable[str], load: Callable[[], Scorer]) -> Iterator[str]:
    """One JSON response a request line: {text, labels?, threshold?} to {entities} or {error}. Blank lines are skipped."""
    scorer, broken = None, None
    for line in lines:
        if not line.strip():
            continue
        try:
            if scorer is None and broken is None:
                try:
                    scorer = load()
                except Exception as e:  # every request is told, as the process lives on
                    broken = str(e)
            if broken is not None:
                raise EntityError(broken)
            asked = json.loads(line)
            got = entities_of(asked["text"], scorer, tuple(asked.get("labels", LABELS)), asked.get("threshold", THRESHOLD))
            yield json.dumps({"entities": [e.__dict__ for e in got]})
        except (ValueError, KeyError, TypeError) as e:
            yield json.dumps({"error": str(e)})


def served(df: DataFrame, load: Callable[[], Scorer], request: str = "request") -> DataFrame:
    """Rows ``response``: what ``serve`` says to each request; the model is loaded once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (line or "" for batch in batches for line in batch.column(0).to_pylist())
        for response in serve(asked, load):
            yield pa.RecordBatch.from_arrays([pa.array([response])], names=["response"])

    return df.select(request).mapInArrow(run, "response string")
