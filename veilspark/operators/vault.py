"""What was masked, to be restored later: a table of replacement, value, uses, last_used.

A table has rows profile, replacement, value, uses (long), last_used (long, unix
seconds). Recording is an aggregate, so it is combined before its shuffle.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redact import findings

MAX_REPLACEMENTS, MAX_CANDIDATES = 20_000, 50
MAGIC = b"RDV1"
PARTS = "array<struct<kind:string,text:string,original:string,replacement:string,candidates:array<string>>>"


class VaultError(ValueError):
    pass


def record(redacted: DataFrame, profile: Column, now: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """The vault after the findings of ``redacted`` are added to ``known``; no-ops and empty values don't count."""
    now = F.unix_timestamp() if now is None else now
    own = findings(redacted.select("input", "findings", profile.alias("profile")), "profile")
    new = own.where("original <> '' AND original <> replacement").select("profile", "replacement", F.col("original").alias("value"), F.lit(1).cast("long").alias("uses"), now.cast("long").alias("last_used"))
    return merge(new if known is None else known.select(*new.columns).unionByName(new))


def merge(entries: DataFrame) -> DataFrame:
    return entries.groupBy("profile", "replacement", "value").agg(F.sum("uses").alias("uses"), F.max("last_used").alias("last_used"))


def prune(vault: DataFrame, most: int = MAX_REPLACEMENTS) -> DataFrame:
    """The ``most`` replacements of each profile that were used last; ties go to the larger replacement.

    Ranks replacements, not values. Spark cuts the groups to ``most`` before the
    shuffle, so a hot profile sends no more than that from each task.
    """
    last = vault.groupBy("profile", "replacement").agg(F.max("last_used").alias("last"))
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("last"), F.desc("replacement")))).where(F.col("rank") <= most)
    return vault.join(ranked.select("profile", "replacement"), ["profile", "replacement"], "left_semi")


def candidates(vault: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """profile, replacement, n (of its originals) and the first ``most`` of them: most used first, then last used, then smallest.

    Originals are ranked and cut, in part before the shuffle, before any are gathered.
    """
    total = vault.groupBy("profile", "replacement").agg(F.count("*").alias("n"))
    order = Window.partitionBy("profile", "replacement").orderBy(F.desc("uses"), F.desc("last_used"), "value")
    first = vault.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    listed = first.groupBy("profile", "replacement").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias("originals"))
    return total.join(listed, ["profile", "replacement"])


def _trie(words: list[str]) -> str:
    """A pattern for the longest of ``words`` at a place: common beginnings are written once."""
    out, first = [], {}
    for w in words:
        first.setdefault(w[:1], []).append(w[1:])
    ends = "" in first
    for c, rest in sorted((c, rest) for c, rest in first.items() if c):
        while len(rest) == 1 or all(r[:1] == rest[0][:1] != "" for r in rest):  # one way on: no branch
            if not rest[0]:
                break
            c, rest = c + rest[0][0], [r[1:] for r in rest]
        out.append(re.escape(c) + (_trie(rest) if any(rest) else ""))
    return f"(?:{'|'.join(out)}){'?' if ends else ''}" if out else ""


def pattern(words: list[str]) -> re.Pattern:
    """Finds the longest of ``words`` at the first place where there is one."""
    try:
        return re.compile(_trie(sorted(words)))
    except RecursionError:  # words that begin with one another, hundreds deep
        return re.compile("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)))


def restore(df: DataFrame, vault: DataFrame, text: str = "text", most: int = MAX_REPLACEMENTS) -> DataFrame:
    """``df`` with parts, restored (text), n_restored and n_ambiguous, from the vault of one profile.

    Replacements are found leftmost-longest. One original is put back; several are
    reported (the first ``MAX_CANDIDATES``) and the text stays. What is broadcast is
    bounded by ``most`` replacements, as pruning leaves them.
    """
    rows = candidates(prune(vault, most)).select("replacement", "n", "originals").limit(most + 1).toArrow().to_pylist()
    if len(rows) > most:
        raise VaultError("restore takes the vault of one profile")
    table = {r["replacement"]: (r["n"], r["originals"]) for r in rows if r["replacement"]}
    handle = df.sparkSession.sparkContext.broadcast(table)
    base = df.drop("parts")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"parts {PARTS}"])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("original", pa.string()), ("replacement", pa.string()), ("candidates", pa.list_(pa.string()))]))

    def part(kind: str, text: str, original=None, replacement=None, candidates=()) -> dict:
        return {"kind": kind, "text": text, "original": original, "replacement": replacement, "candidates": list(candidates)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handle.value
        search = pattern(list(known)) if known else None
        for batch in batches:
            out = []
            for value in batch.column(text).to_pylist():
                parts, at = [], 0
                for m in search.finditer(value or "") if search else ():
                    if m.start() > at:
                        parts.append(part("plain", value[at : m.start()]))
                    n, own = known[m[0]]
                    parts.append(part("restored", own[0], own[0], m[0]) if n == 1 else part("ambiguous", m[0], None, m[0], own))
                    at = m.end()
                if value is not None and at < len(value):
                    parts.append(part("plain", value[at:]))
                out.append(None if value is None else parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "parts"])

    done = base.mapInArrow(run, schema)
    count = lambda kind: F.coalesce(F.size(F.filter("parts", lambda p: p.kind == kind)), F.lit(0)).alias(f"n_{kind}")
    return done.select("*", F.array_join(F.transform("parts", lambda p: p.text), "").alias("restored"), count("restored"), count("ambiguous"))


def generate_key() -> bytes:
    return os.urandom(32)


def key_from_hex(value: str) -> bytes:
    if not re.fullmatch("[0-9a-fA-F]{64}", value):
        raise VaultError("the key must be 64 hexadecimal digits")
    return bytes.fromhex(value)


def seal(vault: DataFrame, key: bytes) -> DataFrame:
    """profile, sealed: AES-256-GCM over the profile's JSON, bound to its name, behind a mark.

    A profile is at most ``MAX_REPLACEMENTS`` replacements, so its JSON is bounded.
    """
    entry = F.struct("replacement", "value", "uses", "last_used")
    whole = prune(vault).groupBy("profile").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("json"))
    crypt = F.aes_encrypt(F.encode("json", "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.encode("profile", "UTF-8"))
    return whole.select("profile", F.concat(F.lit(MAGIC), crypt).alias("sealed"))


def open_sealed(sealed: DataFrame, key: bytes) -> DataFrame:
    """The vault rows of ``seal``'s output. A wrong key, profile or file is an error."""
    if sealed.where((F.substring("sealed", 1, len(MAGIC)) != F.lit(MAGIC)) | F.col("sealed").isNull()).limit(1).count():
        raise VaultError("not a vault file")
    plain = F.aes_decrypt(F.substring("sealed", len(MAGIC) + 1, 2**31 - 1), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.encode("profile", "UTF-8"))
    entries = F.from_json(F.decode(plain, "UTF-8"), "array<struct<replacement:string,value:string,uses:bigint,last_used:bigint>>")
    return sealed.select("profile", F.inline(entries))
