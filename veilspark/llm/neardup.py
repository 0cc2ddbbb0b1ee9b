"""SimHash near duplicates, found with keys from the binary Golay code.

A document's fingerprint has 64 bits; each is the majority of that bit over the
XXH64 of its word shingles. Fingerprints at a distance of two bits or fewer link.

Candidates. The fingerprint is cut into segments of 22, 21 and 21 bits, each in a
23-bit word of the perfect (23,12,7) Golay code. A segment's Golay keys are the
codewords nearest to it and to its 23 neighbours at one bit: one key or six.
Two segments at distance two have a common neighbour and so a common key. Of
three segments with two errors in all, one has none: the keys of a fingerprint
are, for each segment, its exact bits with the Golay keys of the next one. So
every link shares a key, and a key has 33 bits or more.

Verification. Keys held by up to ``bucket`` fingerprints are joined and the
pairs verified by distance. Fingerprints of fuller buckets are linked exactly
without pairs: each is written under itself and its 64 neighbours; all under one
such word are within two bits of each other, and every link has such a word.
Copies are collapsed to one fingerprint before any of this.

Defined cases: null is an empty text, whose fingerprint is zero and links like
any other; fewer words than a shingle are hashed as one sequence; every row is a
document of its own and has a row in the result, whether it shares its doc_id or has
none; a component without any doc_id has a null component_id. Ids are of any type with
an order. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise, text_hash
from .textkit import LOWER, Words, pieces

_SEED = 42
_SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each 23-bit word modulo the generator, in two tables; error of each remainder)."""
    rest = np.zeros(23, np.int64)
    for bit in range(23):
        r = 1 << bit
        for k in range(bit, 10, -1):
            if r >> k & 1:
                r ^= _GENERATOR << (k - 11)
        rest[bit] = r
    words = np.arange(1 << 12)
    table = np.zeros((2, 1 << 12), np.int64)
    for bit in range(23):
        half, at = divmod(bit, 12)
        table[half] ^= np.where(words >> at & 1, rest[bit], 0)
    error = np.zeros(1 << 11, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = (1 << a) | (1 << b) | (1 << c)
                error[table[0][e & 0xFFF] ^ table[1][e >> 12]] = e
    return table, error


_REST, _ERROR = _golay()


def codeword_index(v: np.ndarray) -> np.ndarray:
    """Of the only codeword within three bits: its upper 12 bits, which are free."""
    return (v ^ _ERROR[_REST[0][v & 0xFFF] ^ _REST[1][v >> 12]]) >> 11


def golay_keys(v: np.ndarray) -> np.ndarray:
    """Rows of 24 sorted indices; repeated ones are -1."""
    near = v[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    keys = np.sort(codeword_index(near), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def composite_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys; ``fingerprints``: uint64."""
    cut = [((fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in _SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        soft = golay_keys(cut[(k + 1) % 3])
        row, col = np.nonzero(soft >= 0)
        rows.append(row)
        keys.append((np.int64(k) << 40) | (cut[k][row] << 12) | soft[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_words(w: Words, shingle: int) -> np.ndarray:
    """uint64 fingerprint of each row of ``w``."""
    joined, first = w.joined()
    size = w.ends - w.starts
    blob = joined.tobytes()
    counts = np.diff(w.bounds)
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), shingles)
    start_word = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + w.bounds[:-1][row]
    end_word = np.minimum(start_word + shingle, w.bounds[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(blob[a:b], _SEED) for a, b in zip(first[start_word].tolist(), (first + size)[end_word].tolist(), strict=True)), np.uint64, len(row))
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(shingles)
    if len(filled):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = (np.cumsum(shingles) - shingles)[filled]
        total = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        out[filled] = np.packbits(2 * total > shingles[filled][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows ``doc_id, th`` (a hash of the text)``, fp`` (the fingerprint as a signed long), one a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for _, _, raw, at in pieces(batch.column(2)):
                out.append(fingerprint_words(Words(raw, at, LOWER), shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "th", "fp"])

    lean = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("th"), F.col(text).alias("text"))
    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = composite_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def links(unique: DataFrame, bucket: int = 64) -> DataFrame:
    """``unique``: rows fp, each once. Links ``a, b`` of fingerprints whose components are those of all links."""
    keys = materialise(unique.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    members = materialise(keys.join(shared.hint("merge"), "key"), "golay-buckets")
    discard(keys, shared)
    lists = members.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("all"))
    pairs = F.flatten(F.transform("all", lambda x, k: F.transform(F.slice("all", k + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    full = members.where(F.col("n") > bucket).select("fp").distinct()
    around = full.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = around.join(least.hint("merge"), "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(stars)


def _grouped(docs: DataFrame, text: str, doc_id: str, shingle: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, th, fp; rows fp, part: the component's least fingerprint), both written."""
    prints = materialise(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    unique = materialise(prints.select("fp").distinct(), "unique-fingerprints")
    found = components(links(unique, bucket), "golay-links")
    return prints, materialise(unique.join(found.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part")), "golay-parts")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bucket: int = 64) -> DataFrame:
    """Rows ``doc_id, fingerprint`` (16 hexadecimal digits)``, component_id``, one a row of ``docs``."""
    prints, parts = _grouped(docs, text, doc_id, shingle, bucket)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("own"))
    named = materialise(least.join(parts.hint("merge"), "fp"), "golay-named")
    ids = materialise(named.groupBy("part").agg(F.min("own").alias("component_id")), "golay-ids")
    by_print = materialise(named.select("fp", "part").join(ids.hint("merge"), "part").select("fp", "component_id"), "golay-components")
    return prints.join(by_print.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bucket: int = 64) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (those without come last), then text hash, then row as JSON."""
    prints, parts = _grouped(docs, text, doc_id, shingle, bucket)
    each = prints.groupBy("fp", "doc_id", "th").agg(F.count("*").alias("n"))
    each = materialise(each.join(parts.hint("merge"), "fp"), "golay-rows")
    first = materialise(each.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")), "golay-first")
    judged = each.join(first.hint("merge"), "part").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    judged = materialise(judged.where("not stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "stays"), "near-duplicates")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(doc_id).alias("__own"), text_hash(text).alias("__hash"))
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    left = rows.join(judged.hint("merge"), same, "left_anti").select("__row")
    again = judged.where("stays")
    if not again.isEmpty():  # the row that stays is there more than once
        left = left.unionByName(rows.join(again.hint("merge"), same, "left_semi").groupBy("__own", "__hash").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row"))
    return left.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
