"""Repeated passages: every window of ``WINDOW`` words but the first of its kind goes.

Candidates. A window's anchor is the least hash of its ``GRAM``-word grams, so equal
windows have equal anchors; a run of windows with one anchor is a segment. Only
segments whose anchor occurs twice or more in the corpus go on. Nothing is missed:
a repeated window has a repeated anchor.

Confirmation. Segments are routed by anchor, with their words; equal ones are
combined, in part before the shuffle, to their first occurrence (smallest doc_id, then
start), and the other copies are repeats in full. An anchor with more than ``HOT``
occurrences would gather in one task: its windows are routed one by one by their
own hash, and equal ones are combined, so no key holds many rows.

Location. A task takes the segments of its anchors in shards of ``SHARD`` rows,
anchors never split. The windows that occur twice in a shard are compiled into an
Aho-Corasick automaton over word numbers, and each segment is streamed through
it; of the occurrences of a window the first stays. Automata hold a shard's
windows, never the corpus's. The decisions return to the documents by doc_id.

Memory: a document and a shard. Words are compared as text, not by hash.

Defined cases: null has no words; documents shorter than a window lose nothing; a
null doc_id comes before all others; rows are told apart by doc_id and a hash of
their text, so rows that share an id are documents of their own, in the order of that
hash; rows equal in both are one document read twice, so that none is the repeat of
the other. Ids are whole numbers (else a TypeError). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_hash, whole_id
from .textkit import Words, parts, pieces, spans, window_hashes

WINDOW, GRAM, HOT, SHARD = 20, 6, 2000, 20_000


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its first least one."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        have += step
    return at


def segments(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor) of the segments; windows count from the row's first word."""
    n = len(w) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    row = w.rows()
    grams = window_hashes(w.hashes(), gram)
    least = _first_least(grams, window - gram + 1)[:n]
    inside = row[:n] == row[window - 1 :]
    where = np.flatnonzero(inside)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.ones(len(where), bool)
    new[1:] = (least[where][1:] != least[where][:-1]) | (row[where][1:] != row[where][:-1])
    begin = np.flatnonzero(new)
    lo = where[begin]
    return row[lo], lo - w.bounds[row[lo]], np.diff(np.append(begin, len(where))), grams[least[lo]].view(np.int64)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, raw, at in pieces(batch.column(2)):
                row, first, n, anchor = segments(Words(raw, at), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[lo + row]), pa.array(ths[lo + row]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "id", "th", "lo", "n"])

    return run


def _flat(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each element, the fields) of an array of structs; null arrays are empty."""
    flat = column.flatten()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if column.null_count:
        size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size)
    return np.repeat(np.arange(len(column)), size), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _combined(key: np.ndarray, words: pa.Array, ids: np.ndarray, ths: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """One row for equal keys and words: the first by (id, th, lo)."""
    coded = words.dictionary_encode().indices.to_numpy()
    order = np.lexsort((lo, ths, ids, coded, key))
    coded = coded[order]
    new = np.ones(len(order), bool)
    new[1:] = (coded[1:] != coded[:-1]) | (key[order][1:] != key[order][:-1])
    pick = order[new]
    return pa.RecordBatch.from_arrays([pa.array(key[pick]), words.take(pa.array(pick)), pa.array(ids[pick]), pa.array(ths[pick]), pa.array(lo[pick])], names=["key", "words", "id", "th", "lo"])


def _routed(window: int):
    """Segments, or windows of hot anchors, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            owner, (first, n, anchor, hot) = _flat(batch.column(3), ("lo", "n", "anchor", "hot"))
            hot = hot.astype(bool)
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            got = []
            for lo, hi, raw, at in pieces(batch.column(2)):
                own = slice(edges[lo], edges[hi])
                w = Words(raw, at)
                begin = w.bounds[owner[own] - lo] + first[own]
                joined, at_word = w.joined()
                size = w.ends - w.starts
                cold = np.flatnonzero(~hot[own])
                warm = np.flatnonzero(hot[own])
                each = np.repeat(begin[warm], n[own][warm]) + (np.arange(n[own][warm].sum()) - np.repeat(np.cumsum(n[own][warm]) - n[own][warm], n[own][warm]))
                by_window = window_hashes(w.hashes(), window).view(np.int64) if len(warm) else np.zeros(0, np.int64)
                a = np.concatenate([begin[cold], each])
                b = np.concatenate([begin[cold] + n[own][cold], each + 1]) + window - 2
                key = np.concatenate([anchor[own][cold], by_window[each]])
                row = np.concatenate([owner[own][cold], np.repeat(owner[own][warm], n[own][warm])])
                got.append((key, spans(joined, at_word[a], at_word[b] + size[b]), ids[row], ths[row], (a - w.bounds[row - lo]).astype(np.int32)))
            if got:
                key, words, own_ids, own_ths, first = zip(*got, strict=True)
                yield _combined(np.concatenate(key), pa.chunked_array(words, pa.string()).combine_chunks(), np.concatenate(own_ids), np.concatenate(own_ths), np.concatenate(first))

    return run


def locate(texts: pa.Array, order: list[tuple], window: int) -> list[int]:
    """Bits of the windows of each text that are the first of their kind among all of them.

    ``order``: (id, text hash, first window) of each text; an automaton over the windows
    that occur twice or more is run over all texts.
    """
    raw, at = parts(texts)
    w = Words(raw, at)
    row, n = w.rows(), len(w) - window + 1
    windows = np.diff(w.bounds) - window + 1
    out = [(1 << int(k)) - 1 if k > 0 else 0 for k in windows]
    if n <= 0:
        return out
    number = w.text(np.arange(len(w))).dictionary_encode().indices.to_numpy().astype(np.int64)
    h = window_hashes(w.hashes(), window)
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    _, back, count = np.unique(h[inside], return_inverse=True, return_counts=True)
    twice = inside[count[back] > 1]
    if not len(twice):
        return out
    numbers = number.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in twice.tolist():
        phrase = tuple(numbers[p : p + window])
        if phrase not in automaton:
            automaton.add_word(phrase, len(automaton))
    automaton.make_automaton()
    first: dict[int, tuple] = {}
    hits: list[tuple[int, int, int]] = []
    for r in np.unique(row[twice]).tolist():
        lo = int(w.bounds[r])
        *doc, start = order[r]
        for end, phrase in automaton.iter(tuple(numbers[lo : int(w.bounds[r + 1])])):
            k = end - window + 1
            at_doc = (*doc, start + k)
            hits.append((phrase, r, k))
            if phrase not in first or at_doc < first[phrase]:
                first[phrase] = at_doc
    for phrase, r, k in hits:
        *doc, start = order[r]
        if first[phrase] != (*doc, start + k):
            out[r] &= ~(1 << k)
    return out


def _located(window: int, shard: int):
    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, ths, lo = (t.column(c).to_numpy() for c in ("id", "th", "lo"))
        bits = locate(t.column("words").combine_chunks(), list(zip(ids.tolist(), ths.tolist(), lo.tolist(), strict=True)), window)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ths), pa.array(lo), pa.array(bits, pa.int64())], names=["id", "th", "lo", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                if size >= shard:  # up to the end of the anchor that is open
                    open_key = held[-1].column(0)[-1].as_py()
                    cut = int(np.argmax(key != open_key)) if (key != open_key).any() else len(key)
                    if cut:
                        held.append(batch.slice(0, cut))
                    if cut == len(key):
                        size += cut
                        break
                    yield flush(held)
                    held, size, batch = [], 0, batch.slice(cut)
                    continue
                take = min(batch.num_rows, shard - size)
                held.append(batch.slice(0, take))
                size += take
                batch = batch.slice(take)
        if held:
            yield flush(held)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s_row, (s_lo, s_n) = _flat(batch.column(2), ("lo", "n"))
            k_row, (k_lo, k_bits) = _flat(batch.column(3), ("lo", "first"))
            s_edge, k_edge = np.searchsorted(s_row, np.arange(batch.num_rows + 1)), np.searchsorted(k_row, np.arange(batch.num_rows + 1))
            text, words, removed = [], [], []
            for lo, hi, raw, at in pieces(batch.column(1)):
                w = Words(raw, at)
                gone = np.zeros(len(w) + 1, np.int64)  # windows that begin here and repeat
                s, k = slice(s_edge[lo], s_edge[hi]), slice(k_edge[lo], k_edge[hi])
                begin = w.bounds[s_row[s] - lo] + s_lo[s]
                begin, n = np.minimum(begin, len(w)), s_n[s]
                np.add.at(gone, begin, 1)
                np.subtract.at(gone, np.minimum(begin + n, len(w)), 1)
                gone = np.cumsum(gone)
                bits = (k_bits[k][:, None] >> np.arange(max(1, int(k_bits[k].max(initial=0)).bit_length()))[None, :]) & 1
                which, offset = np.nonzero(bits)
                kept_at = w.bounds[k_row[k][which] - lo] + k_lo[k][which] + offset
                gone[kept_at[kept_at < len(w)]] = 0
                from_ = np.flatnonzero(gone[: max(0, len(w) - window + 1)])
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, from_, 1)
                np.subtract.at(edge, from_ + window, 1)
                out = np.cumsum(edge)[:-1] > 0
                joined, at_word = w.joined()
                size = w.ends - w.starts
                left = joined[np.repeat(~out, size + 1)]
                stop = np.zeros(len(w) + 1, np.int64)
                np.cumsum(np.where(out, 0, size + 1), out=stop[1:])
                a, b = stop[w.bounds[:-1]], stop[w.bounds[1:]]
                text.append(spans(left, a, np.maximum(a, b - 1)))
                total = np.zeros(len(w) + 1, np.int64)
                np.cumsum(out, out=total[1:])
                words.append(np.diff(w.bounds))
                removed.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.chunked_array(text, pa.string()).combine_chunks(), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (words, removed))], names=["doc_id", "text", "n_words", "n_removed"]
            )

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """Rows ``doc_id, text`` (the kept words joined by one blank)``, n_words, n_removed``, one a row of ``docs``.

    A segment has ``window - gram + 1`` windows at most, whose decisions fit one long.
    """
    if not 0 <= window - gram < 63:
        raise ValueError("a gram may be up to 62 words shorter than a window, and not longer")
    lean = docs.select(F.col(doc_id).alias("own"), whole_id(docs, doc_id).alias("id"), text_hash(text).alias("th"), F.col(text).alias("text"))
    anchors = materialise(lean.select("id", "th", "text").mapInArrow(_anchors(window, gram), "anchor long, id long, th long, lo int, n int"), "anchors")
    # written first, so that the join below has plain exchanges and a hot anchor can be split
    twice = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "repeated-anchors")
    found = anchors.join(twice.hint("merge"), "anchor").groupBy("id", "th").agg(F.collect_set(F.struct("lo", "n", "anchor", (F.col("c") > hot).alias("hot"))).alias("segments"))
    found = materialise(found, "segments")
    discard(anchors, twice)
    routed = lean.join(found.hint("merge"), ["id", "th"]).select("id", "th", "text", "segments").mapInArrow(_routed(window), "key long, words string, id long, th long, lo int")
    # one shuffle, by key alone: the windows of an anchor meet in a task, and equal rows are combined there
    unique = routed.repartition("key").groupBy("key", "words").agg(F.min(F.struct("id", "th", "lo")).alias("at"))
    kept = unique.sortWithinPartitions("key").select("key", "words", "at.*").mapInArrow(_located(window, shard), "id long, th long, lo int, first long")
    decided = kept.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "first")).alias("kept"))
    plan = found.select("id", "th", F.transform("segments", lambda s: F.struct(s.lo.alias("lo"), s.n.alias("n"))).alias("segments")).join(decided.hint("merge"), ["id", "th"], "left")
    own = f"doc_id {lean.schema['own'].dataType.simpleString()}"
    return lean.join(materialise(plan, "decisions").hint("merge"), ["id", "th"], "left").select("own", "text", "segments", "kept").mapInArrow(_cut(window), f"{own}, text string, n_words long, n_removed long")
