"""Language-model scores: a subword lattice under counted words.

The lattice. An existing vocabulary gives pieces and scores. A word, with the
mark U+2581 before it, has the probability of all its segmentations into pieces,
summed by a forward recursion in log space. A character that no piece holds is a
piece of its own, priced by its bytes. The scores of the vocabulary are the start
of expectation maximisation over all distinct training words (``rounds`` times);
the pieces themselves never change. ``lattice_score`` has the vocabulary's own scores throughout. Word boundaries cut every segmentation, so a
text's lattice factors into those of its words, each computed once per word.

The model. P(token) = max(c - d, 0) / N + left * Q(token), with the training
count c, N training tokens, absolute discount d and all the discounted mass as
``left``: a known word is one more arc of its lattice, from end to end. Q gives
``END`` to the end of a text and the rest to the lattice. P is a distribution
over all strings: an unseen word pays for its spelling, where the base model
prices all unseen words as one class.

Scale. Counts are combined in each batch before the one shuffle by word. The
words of the highest counts, ``head`` at most, are broadcast and scored in
place; every other token is joined by word, and the sums return by row. Nothing
else is broadcast but the vocabulary (its size is fixed) and its weights.

Defined cases: null is an empty text, one end token; repeated rows are scored
each and each is learnt from; without training rows N is 0 and the model is Q;
a null id is a training row. Words are hashed to 64 bits for the head's lookup.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkit import LOWER, Words, parts, pieces

END = 0.01
MARK = "▁"
#: The base model's additive constant.
ADD = 0.5
_LOW = -1e30


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, natural log of its weight) of a SentencePiece model file.

    Unigram models hold log probabilities. Merge models hold minus the rank of
    each piece; ranks are weighted as Zipf's law has it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):
        scores = [-math.log(2.7 - s) for s in scores]
    return [(model.id_to_piece(i), s) for i, s in zip(ids, scores, strict=True)]


class Lattice:
    """Pieces as a trie with edges sorted by (node, character), for numpy lookups."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        vocabulary = sorted({p: s for p, s in vocabulary if p}.items())
        self.names = [p for p, _ in vocabulary]
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, name in enumerate(self.names):
            node = 0
            for ch in name:
                node = children.setdefault((node, ord(ch)), len(children) + 1)
            ends[node] = k
        keys = np.array([(node << 21) | ch for node, ch in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(children.values()), np.int64)[order]
        self.piece = np.full(len(children) + 1, -1, np.int64)
        for node, k in ends.items():
            self.piece[node] = k
        self.singles = np.sort(np.array([ord(p) for p in self.names if len(p) == 1], np.int64))
        self.deepest = max(map(len, self.names), default=0)
        scores = np.array([s for _, s in vocabulary])
        # the last weight is of characters without a piece, shared by their bytes
        self.weights = self.normalised(np.append(scores, scores.min(initial=0.0)))

    @staticmethod
    def normalised(w: np.ndarray) -> np.ndarray:
        top = w.max()
        return w - top - math.log(np.exp(w - top).sum())

    def arcs(self, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in ``text`` (code points; stop: where the word of each position ends).

        (position, length, piece or -1, share of the weight): -1 is a character without a piece.
        """
        at = np.arange(len(text))
        node = np.zeros(len(text), np.int64)
        found = []
        for size in range(1, self.deepest + 1):
            key = (node << 21) | text[at + size - 1]
            where = np.searchsorted(self.keys, key)
            where[where == len(self.keys)] = 0
            ok = self.keys[where] == key if len(self.keys) else np.zeros(len(key), bool)
            at, node = at[ok], self.to[where[ok]]
            hit = self.piece[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), size), self.piece[node[hit]], np.zeros(int(hit.sum()))))
            more = at + size < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        lone = np.flatnonzero(~np.isin(text, self.singles))
        octets = 1 + (text[lone] > 0x7F) + (text[lone] > 0x7FF) + (text[lone] > 0xFFFF)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1), -octets * math.log(256)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(self, words: pa.Array, expect: np.ndarray | None = None) -> np.ndarray:
        """Natural log of each word's marginal; adds expected piece counts to ``expect``."""
        out = np.empty(len(words))
        marked = np.frombuffer("".join(MARK + w for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.flatnonzero(_word_heads(marked, words))
        sizes = np.diff(np.append(heads, len(marked)))
        order = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(order):
            # words of one length, 64 k of characters or one word
            hi = lo + max(1, min(int(np.searchsorted(sizes[order[lo:]], sizes[order[lo]], "right")), 65536 // int(sizes[order[lo]])))
            out[order[lo:hi]] = self._same_length(marked, heads[order[lo:hi]], int(sizes[order[lo]]), expect)
            lo = hi
        return out

    def _same_length(self, marked: np.ndarray, heads: np.ndarray, size: int, expect: np.ndarray | None) -> np.ndarray:
        n = len(heads)
        text = marked[heads[:, None] + np.arange(size)[None, :]].ravel()
        stop = np.repeat((np.arange(n) + 1) * size, size)
        at, length, piece, extra = self.arcs(text, stop)
        word, col = np.divmod(at, size)
        score = self.weights[piece] + extra
        by_end = np.argsort(col + length, kind="stable")
        alpha = np.full((n, size + 1), _LOW)
        alpha[:, 0] = 0.0
        bounds = np.searchsorted((col + length)[by_end], np.arange(size + 2))
        for t in range(1, size + 1):
            k = by_end[bounds[t] : bounds[t + 1]]
            alpha[:, t] = _log_sum(word[k], alpha[word[k], col[k]] + score[k], n)
        total = alpha[:, size]
        if expect is not None:
            beta = np.full((n, size + 1), _LOW)
            beta[:, size] = 0.0
            by_start = np.argsort(col, kind="stable")
            bounds = np.searchsorted(col[by_start], np.arange(size + 1))
            for t in range(size - 1, -1, -1):
                k = by_start[bounds[t] : bounds[t + 1]]
                beta[:, t] = _log_sum(word[k], beta[word[k], col[k] + length[k]] + score[k], n)
            share = np.exp(np.minimum(alpha[word, col] + score + beta[word, col + length] - total[word], 0.0))
            expect += np.bincount(np.where(piece < 0, len(expect) - 1, piece), share, len(expect))
        return total


def _word_heads(marked: np.ndarray, words: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    heads = np.zeros(len(marked), bool)
    heads[np.cumsum(size) - size] = True
    return heads


def _log_sum(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """log of the summed exp(value) by group."""
    top = np.full(n, _LOW)
    np.maximum.at(top, group, value)
    total = np.bincount(group, np.exp(value - top[group]), n)
    with np.errstate(divide="ignore"):
        return np.where(total > 0, top + np.log(total), _LOW)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _unique(h: list[np.ndarray], w: list[Words]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some pieces of text, and their counts."""
    names, hashes, counts = [], [], []
    for own, words in zip(h, w, strict=True):
        u, first, n = np.unique(own, return_index=True, return_counts=True)
        names.append(words.text(first))
        hashes.append(u)
        counts.append(n)
    flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
    _, first, back = np.unique(flat, return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(first)).astype(np.int64)
    return pa.chunked_array(names, pa.string()).combine_chunks().take(pa.array(first)), total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, w = [], []
        for _, _, raw, at in pieces(batch.column(0)):
            w.append(Words(raw, at, LOWER))
            h.append(w[-1].hashes())
        names, n = _unique(h, w)
        yield pa.RecordBatch.from_arrays([names, pa.array(n)], names=["word", "c"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``word, c`` of all texts (ASCII lower case)."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_lattice(words: DataFrame, vocabulary: list[tuple[str, float]], rounds: int = 2, prior: float = 1e-3) -> Lattice:
    """Weights of ``vocabulary`` after expectation maximisation over the distinct ``words``.

    ``prior``: what each piece is given besides its expected count.
    """
    lattice = Lattice(vocabulary)
    spark = words.sparkSession
    for _ in range(rounds):
        handle = spark.sparkContext.broadcast(lattice)

        def expected(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            own = handle.value
            expect = np.zeros(len(own.weights))
            for batch in batches:
                own.run(batch.column(0), expect)
            some = np.flatnonzero(expect)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(expect[some])], names=["piece", "n"])

        total = np.zeros(len(lattice.weights))
        for r in words.select("word").mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            total[r.piece] = r.n
        lattice.weights = Lattice.normalised(np.log(total + prior))
    return lattice


def score(docs: DataFrame, vocabulary: list[tuple[str, float]], held: Column | None = None, text: str = "text", doc_id: str = "doc_id", head: int = 1 << 18, rounds: int = 4) -> DataFrame:
    """Rows doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, lattice_tokens, one a row of ``docs``.

    lattice_score: log10 of the text's marginal under the lattice alone, with the vocabulary's own scores and nothing
    learnt; lattice_tokens: tokens that only the lattice accounts for.
    """
    spark = docs.sparkSession
    held = held_out(doc_id) if held is None else held
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    train = lean.where(~F.col("held_out"))
    counts = materialise(word_counts(train), "word-counts")
    ends = train.count()
    octave = F.floor(F.log2("c") * 8).cast("int")
    by = counts.groupBy(octave.alias("bin")).agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).collect()
    v, n = sum(r.v for r in by) + (ends > 0), sum(r.n for r in by) + ends
    n1, n2 = sum(r.n1 for r in by), sum(r.n2 for r in by)
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    left = d * v / n if n else 1.0
    least, room = None, head
    for r in sorted(by, key=lambda r: -r.bin):
        if r.v > room:
            break
        least, room = r.bin, room - r.v
    lattice = spark.sparkContext.broadcast(train_lattice(counts, vocabulary, rounds))
    given = spark.sparkContext.broadcast(Lattice(vocabulary))
    log10_base = math.log10(n + ADD * (v + 1))

    def token(c: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 P of words with the counts c and the lattice's natural logs q."""
        seen = np.maximum(c - d, 0.0) / max(n, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(seen), math.log(left * (1 - END)) + q) / math.log(10)

    def alone(words: pa.Array) -> np.ndarray:
        """log10 of words under the lattice with the vocabulary's own scores."""
        return (math.log(1 - END) + given.value.run(words)) / math.log(10)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10(c + ADD) - log10_base

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(token(c, lattice.value.run(batch.column(0)))), pa.array(alone(batch.column(0)))], names=["word", "c", "p", "g"])

    prices = materialise(counts.mapInArrow(priced, "word string, c long, p double, g double"), "word-prices")
    top = prices.where(octave >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64()), "p": pa.array([], pa.float64()), "g": pa.array([], pa.float64())})
    raw, at = parts(top.column("word"))
    h = Words(raw, at).hashes()
    order = np.argsort(h)
    known = spark.sparkContext.broadcast((h[order], base(top.column("c").to_numpy())[order], top.column("p").to_numpy()[order], top.column("g").to_numpy()[order]))
    end_seen = np.array([max(ends - d, 0.0) / max(n, 1) + left * END])
    end_base, end_score = float(base(np.array([ends]))[0]), float(np.log10(end_seen)[0])
    end_lattice = math.log10(END)
    whole = f"rid long, doc_id {lean.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double, word string, k long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hh, hb, hp, hg = known.value
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            got = {k: [] for k in ("n", "known", "base", "score", "lattice")}
            tail_row, tail_word, tail_n = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for lo, _, raw, at in pieces(batch.column(2)):
                w = Words(raw, at, LOWER)
                row, own = w.rows(), w.hashes()
                where = np.searchsorted(hh, own)
                where[where == len(hh)] = 0
                ok = hh[where] == own if len(hh) else np.zeros(len(own), bool)
                rows = len(at) - 1
                got["n"].append(np.diff(w.bounds) + 1)
                got["known"].append(np.bincount(row[ok], minlength=rows) + (ends > 0))
                got["base"].append(np.bincount(row[ok], hb[where[ok]], rows) + end_base)
                got["score"].append(np.bincount(row[ok], hp[where[ok]], rows) + end_score)
                got["lattice"].append(np.bincount(row[ok], hg[where[ok]], rows) + end_lattice)
                rest = np.flatnonzero(~ok)
                if len(rest):
                    order = rest[np.lexsort((own[rest], row[rest]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (row[order][1:] != row[order][:-1]) | (own[order][1:] != own[order][:-1])
                    first = np.flatnonzero(new)
                    tail_row.append(lo + row[order[first]])
                    tail_n.append(np.diff(np.append(first, len(order))))
                    tail_word.append(w.text(order[first]))
            n_rows, tr = batch.num_rows, np.concatenate(tail_row)
            col = {k: np.concatenate([np.zeros(0), *x]) for k, x in got.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(col["n"].astype(np.int64)), pa.array(col["known"].astype(np.int64)), pa.array(col["base"]), pa.array(col["score"]), pa.array(col["lattice"]), pa.nulls(n_rows, pa.string()), pa.nulls(n_rows, pa.int64())],
                names=[x.split()[0] for x in whole.split(", ")],
            )
            if len(tr):
                words = pa.chunked_array(tail_word, pa.string()).combine_chunks()
                none = [pa.nulls(len(tr), t) for t in (batch.column(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(rid[tr]), *none, words, pa.array(np.concatenate(tail_n))], names=[x.split()[0] for x in whole.split(", ")])

    scanned = materialise(lean.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "held_out").mapInArrow(scan, whole), "token-scores")
    tail = scanned.where("word is not null").select("rid", "word", "k").join(prices, "word", "left")

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            p, g = (batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False).copy() for i in (4, 5))
            new = np.flatnonzero(batch.column(4).is_null().to_numpy(zero_copy_only=False))
            if len(new):
                coded = batch.column(0).take(pa.array(new)).dictionary_encode()
                at = coded.indices.to_numpy()
                p[new], g[new] = token(np.zeros(len(coded.dictionary)), lattice.value.run(coded.dictionary))[at], alone(coded.dictionary)[at]
            k = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(k * (c > 0)), pa.array(k * base(c)), pa.array(k * p), pa.array(k * g), pa.array(k * (c == 0))], names=["rid", "n_known", "base_score", "score", "lattice_score", "lattice_tokens"])

    fields = ("n_known", "base_score", "score", "lattice_score", "lattice_tokens")
    summed = tail.select("word", "rid", "k", "c", "p", "g").mapInArrow(missing, "rid long, n_known long, base_score double, score double, lattice_score double, lattice_tokens long").groupBy("rid").agg(*(F.sum(x).alias(f"t_{x}") for x in fields))
    rows = scanned.where("word is null").drop("word", "k").withColumn("lattice_tokens", F.lit(0).cast("long"))
    return rows.join(summed, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", F.lit(n).cast("long").alias("train_tokens"), *((F.col(x) + F.coalesce(f"t_{x}", F.lit(0))).alias(x) for x in fields)
    )
