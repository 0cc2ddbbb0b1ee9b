"""Benchmark decontamination with a generalised suffix automaton.

The words of the test items (lower case, see ``textkit.ALNUM``) form one suffix
automaton. Training words are streamed through it; the state gives the longest
run of item words that ends at the current word. Runs of ``window`` words or
more, and whole items shorter than that, are hits.

Cost: a document's words are first looked up as adjacent pairs in a bit table of
the items' pairs; only stretches in which every pair is known reach the
automaton, with their words as text, so hash collisions can't make a hit and no
hit is missed. No shuffle: one pass over the documents. An automaton is
broadcast, and holds at most ``shard_words`` item words; more items become
more automata, applied one after another to all documents.

Defined cases: null text has no words; null item text or one without words never
occurs; equal items are all reported; empty tables give no hits; input columns
named like an output are replaced; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .textkit import ALNUM, CHUNK, Words, mix, parts, pieces

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; see Blumer et al. (1985)."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.vocabulary: dict[str, int] = {}
        self.sequences: list[tuple[str, list[int]]] = []

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, c, known)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, item: str, words: list[str]) -> None:
        if not words:
            return
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.sequences.append((item, ids))
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def finish(self) -> SuffixAutomaton:
        """Which items own the window that ends in a state, and which short items end there."""
        w = self.window
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: the state of a match's last ``window`` words
        self.window_state = [-1] * len(self.next)
        for s in order:
            up = self.link[s]
            if self.length[s] >= w:
                self.window_state[s] = s if self.length[up] < w else self.window_state[up]
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        for item, ids in self.sequences:
            state, seen = 0, set()
            for c in ids:
                state = self.next[state][c]
                at = self.window_state[state]
                if at >= 0:
                    seen.add(at)
            for at in seen:
                self.owners.setdefault(at, set()).add(item)
            if len(ids) < w:
                self.whole.setdefault(state, set()).add(item)
        #: the nearest state on the way up, itself included, where a short item ends
        self.short = [-1] * len(self.next)
        for s in order:
            self.short[s] = s if s in self.whole else self.short[self.link[s]]
        self.least = min([w, *(len(ids) for _, ids in self.sequences)])
        return self

    def stream(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans, items) of one stretch of words; spans may overlap."""
        spans, items, state, n = [], set(), 0, 0
        get = self.vocabulary.get
        for i, word in enumerate(words):
            c = get(word, -1)
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                state, n = 0, 0
                continue
            state, n = to, n + 1
            if n >= self.window:
                spans.append((i + 1 - n, i + 1))
                at = self.window_state[state]
                items |= self.owners.get(at, set())
            if self.whole:
                at = self.short[state]
                while at > 0:
                    if self.length[at] <= n:
                        spans.append((i + 1 - self.length[at], i + 1))
                        items |= self.whole[at]
                    at = self.short[self.link[at]] if self.link[at] > 0 else -1
        return spans, items


def normalised_words(texts: list[str | None]) -> list[list[str]]:
    w = Words(*parts(pa.array(texts, pa.string())), ALNUM)
    flat = w.text(np.arange(len(w))).to_pylist()
    return [flat[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]


def build(items: list[tuple[str, str | None]], window: int) -> SuffixAutomaton:
    auto = SuffixAutomaton(window)
    for (item, _), words in zip(items, normalised_words([t for _, t in items]), strict=True):
        auto.add(item, words)
    return auto.finish()


def _filters(auto: SuffixAutomaton) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of item words and of adjacent pairs of them, by hash."""
    names = list(auto.vocabulary)
    one, two = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
    if names:
        raw, at = parts(pa.array(names, pa.string()))
        h = Words(raw, at).hashes()
        one[h >> np.uint64(64 - _BITS)] = True
        for _, ids in auto.sequences:
            if len(ids) > 1:
                g = h[ids]
                two[_pairs(g)] = True
    return one, two


def _pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * _PAIR + h[1:]) >> np.uint64(64 - _BITS)


def _stretches(w: Words, one: np.ndarray, two: np.ndarray, least: int) -> np.ndarray:
    """(from, to) words of the stretches that may hold a match of ``least`` words."""
    h = w.hashes()
    known = one[h >> np.uint64(64 - _BITS)]
    joined = np.zeros(len(h) + 1, bool)  # joined[i]: words i-1 and i may be adjacent in an item
    if len(h) > 1:
        joined[1:-1] = two[_pairs(h)] & known[1:] & known[:-1]
    joined[w.bounds] = False
    begin = np.flatnonzero(known & ~joined[:-1])
    end = np.flatnonzero(known & ~joined[1:]) + 1
    runs = np.stack([begin, end], 1) if len(begin) else np.zeros((0, 2), np.int64)
    return runs[runs[:, 1] - runs[:, 0] >= least]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: What the scan adds to the documents.
ADDED = {
    "n_words": T.LongType(),
    "hit_spans": T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("lo_byte", T.IntegerType()), T.StructField("hi_byte", T.IntegerType())])),
    "hit_items": T.ArrayType(T.StringType()),
}
_SPAN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("lo_byte", pa.int32()), ("hi_byte", pa.int32())]))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 1_000_000) -> DataFrame:
    """``docs`` with n_words, hit_spans (words lo:hi and their bytes, disjoint, sorted) and hit_items."""
    spark = docs.sparkSession
    lean = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("body"))
    size = lean.agg(F.sum(F.octet_length("body")).alias("b")).first().b or 0
    shards = max(1, -(-size // (shard_words * 4)))  # four bytes a word and its gap, or more
    out = docs.drop(*ADDED).withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items()})
    for k in range(shards):
        rows = lean.where(F.pmod(F.xxhash64("item", "body"), F.lit(shards)) == k).collect() if shards > 1 else lean.collect()
        handle = spark.sparkContext.broadcast(build([(r.item, r.body) for r in rows], window))
        out = out.mapInArrow(_scan(handle, text), out.schema)
        if k + 1 < shards:
            out = materialise(out, "decontaminate")
    return out


def _scan(handle, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = handle.value
        one, two = _filters(auto)
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi, raw, at in pieces(batch.column(text), CHUNK):
                w = Words(raw, at, ALNUM)
                n_words[lo:hi] = np.diff(w.bounds)
                for a, b in _stretches(w, one, two, auto.least) if auto.sequences else ():
                    row = int(np.searchsorted(w.bounds, a, "right")) - 1
                    got, owners = auto.stream(w.text(np.arange(a, b)).to_pylist())
                    if got:
                        spans[lo + row] += [(int(a + x - w.bounds[row]), int(a + y - w.bounds[row]), int(w.starts[a + x] - at[row]), int(w.ends[a + y - 1] - at[row])) for x, y in got]
                        items[lo + row] += owners
            before_s, before_i = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            done_s, done_i = [], []
            for r in range(batch.num_rows):
                own = spans[r] + [tuple(x.values()) for x in before_s[r] or ()]
                words, octets = merged([x[:2] for x in own]), {x[0]: x[2] for x in own}
                last = {x[1]: x[3] for x in own}
                done_s.append([{"lo": a, "hi": b, "lo_byte": octets[a], "hi_byte": last[b]} for a, b in words])
                done_i.append(sorted(set(items[r]) | set(before_i[r] or ())))
            new = {"n_words": pa.array(n_words), "hit_spans": pa.array(done_s, _SPAN), "hit_items": pa.array(done_i, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def hit_words() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s.hi - s.lo)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_span: int = 0, max_coverage: float = 0.5, **more) -> DataFrame:
    """``docs`` (its columns) without contamination.

    A hit span of more than ``max_span`` words is cut out of the text; a document
    of which more than ``max_coverage`` of the words are hit goes altogether.
    Documents without hits keep their text byte for byte; null stays null.
    """
    found = find(docs, items, text=text, window=window, **more)
    kept = found.where(hit_words() <= F.lit(float(max_coverage)) * F.col("n_words"))
    cut = F.filter("hit_spans", lambda s: s.hi - s.lo > max_span)
    raw = F.encode(F.col(text), "UTF-8")
    # what is left: the bytes between the cut spans
    edges = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s.hi_byte))
    stops = F.concat(F.transform(cut, lambda s: s.lo_byte), F.array(F.octet_length(F.col(text))))
    left = F.array_join(F.zip_with(edges, stops, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")), "")
    return kept.withColumn(text, F.when(F.size(cut) > 0, left).otherwise(F.col(text))).select(*docs.columns)
