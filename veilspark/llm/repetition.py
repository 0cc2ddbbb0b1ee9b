"""Quality rules on repetition inside a document, from suffix and LCP arrays.

The words of a run of documents are ranked by prefix doubling, documents apart
from each other; the ranks of each doubling give the longest common prefix of
neighbours in the suffix array. At each suffix the larger of its two LCP values
is the longest text that begins there and occurs twice: the LCP intervals of
``least`` words or more are the maximal repeats. The union of their spans gives
the covered words. A document is rejected if that share or the longest repeat
is over its limit. One pass, no shuffle; memory follows the longest document.

Defined cases: null is an empty text; a text without words has no repeats and
fails ``min_words``; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, Words, mix, pieces
from .textkit import _BASE, _BYTE, _INVERSE, _power

#: Production limits: at least so many words, at most this percentage of them in
#: repeats of ``LEAST`` words or more, and no repeat longer than ``LONGEST``.
MIN_WORDS, LEAST, COVERED, LONGEST = 20, 8, 30, 100

ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "longest_repeat": "long"}

#: Characters that count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_lcp(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp with the suffix before it) of ``ids``; nothing is common across rows."""
    n = len(ids)
    end = np.searchsorted(row, row, "right")
    with np.errstate(over="ignore"):
        key = ids ^ mix(row.astype(np.uint64) + np.uint64(1))
    sa = np.argsort(key, kind="stable")
    rank = np.full(n + 1, -1, np.int64)

    def regroup(where: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks for sa[where], whose sorted keys are given; which of them still share a rank."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        rank[sa[where]] = where[new][group]
        return np.bincount(group)[group] > 1

    where = np.arange(n)
    shared = regroup(where, key[sa]) if n else np.zeros(0, bool)
    levels, h = [], 1
    while shared.any():
        where = where[shared]
        levels.append((h, rank.astype(np.int32) if n < 2**31 else rank.copy()))
        at = sa[where]
        follow = np.where(at + h < end[at], rank[np.minimum(at + h, n)] + 1, 0)
        keys = rank[at] * (n + 1) + follow
        order = np.argsort(keys, kind="stable")
        sa[where] = at[order]
        shared = regroup(where, keys[order])
        h *= 2
    lcp = np.zeros(n, np.int64)
    if n:
        i, j = sa[:-1].copy(), sa[1:].copy()
        alike = np.flatnonzero(row[i] == row[j])
        i, j, size = i[alike], j[alike], np.zeros(len(alike), np.int64)
        for h, ranks in reversed(levels):
            same = ranks[i] == ranks[j]
            i, j, size = i + h * same, j + h * same, size + h * same
        lcp[1:][alike] = size
    return sa, lcp


def longest_here(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat of its row that begins there."""
    sa, lcp = suffix_lcp(ids, row)
    out = np.zeros(len(ids), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _dup_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    rows, n = len(at) - 1, len(raw)
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([at[:-1], breaks + 1])
    stops = np.concatenate([at[1:], breaks])
    row = np.concatenate([np.arange(rows), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    stops = stops[np.lexsort((stops, np.concatenate([np.arange(rows), np.searchsorted(at, breaks, "right") - 1])))]
    words = np.zeros(n + 1, np.int64)
    np.cumsum(~SPACE[raw], out=words[1:])
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_BASE, n), out=total[1:])
        h = mix((total[stops] - total[starts]) * _power(_INVERSE, n + 1)[starts] + (stops - starts).astype(np.uint64))
    some = words[stops] > words[starts]
    row, h = row[some], h[some]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    dup = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    return np.bincount(row[1:][dup], minlength=rows)


def document_stats(raw: np.ndarray, at: np.ndarray, least: int) -> dict[str, np.ndarray]:
    w = Words(raw, at)
    row = w.rows()
    longest = longest_here(w.hashes(), row)
    from_word = np.flatnonzero(longest >= least)
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, from_word, 1)
    np.subtract.at(edge, from_word + longest[from_word], 1)
    most = np.zeros(len(at) - 1, np.int64)
    np.maximum.at(most, row, longest)
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": _per_row(~SPACE[raw] & ((raw & 0xC0) != 0x80), at),
        "n_symbols": _per_row(_SYMBOL[raw], at),
        "n_dup_lines": _dup_lines(raw, at),
        "n_repeat_words": _per_row(np.cumsum(edge)[:-1] > 0, w.bounds),
        "longest_repeat": most,
    }


def measure(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the columns of ``ADDED`` (long)."""
    bare = docs.drop(*ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema), *(f"{n} {t}" for n, t in ADDED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_stats(raw, at, least) for _, _, raw, at in pieces(batch.column(text))]
            more = [pa.array(np.concatenate([np.zeros(0, np.int64), *(g[n] for g in got)]).astype(np.int64)) for n in ADDED]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *ADDED])

    return bare.mapInArrow(run, schema)


def judge(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """``measure`` with base_failed and kept; the share is compared in whole numbers."""
    too_much = 100 * F.col("n_repeat_words") > covered * F.col("n_words")
    base = (F.col("n_words") < min_words) | too_much
    return measure(docs.drop("base_failed", "kept"), text).withColumns({"base_failed": base, "kept": ~base & (F.col("longest_repeat") <= longest)})


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` (its columns) without the rejected documents."""
    lean = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in {*ADDED, "base_failed", "kept"}})
    kept = judge(lean, text, **limits).where("kept").select(*lean.columns)
    return kept.withColumnsRenamed({f"__own_{c}": c for c in docs.columns})
