"""Spans as Column expressions: find with offsets, resolve overlaps, apply, segment.

Spark has no function for all matches with their offsets. Here each match is put
between two marks, the text split at them, and offsets are summed lengths. Offsets
are characters, from 0; ``byte_offset`` turns one into UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables

_OPEN, _CLOSE = "\u0001", "\u0002"
SPAN = "struct<start:int,end:int,match:string>"


def scan(text: Column | str, pattern: str, group: int = 0, before: str = "", after: str = "") -> Column:
    """All matches: array of start, end, match.

    With ``group``, ``before`` and ``after`` are what the pattern matches around it,
    as replacement text (literals and group references). U+0001 and U+0002 in the text
    are taken as U+0003, also in a match.
    """
    t = F.col(text) if isinstance(text, str) else text
    clean = F.translate(t, _OPEN + _CLOSE, "\u0003\u0003")
    marked = F.regexp_replace(clean, pattern, f"{before}{_OPEN}${group}{_CLOSE}{after}")
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        n = F.char_length(p)
        here = F.struct(s.at.cast("int").alias("start"), (s.at + n).cast("int").alias("end"), p.alias("match"))
        return F.struct((s.at + n).alias("at"), (~s.inside).alias("inside"), F.when(s.inside, F.concat(s.out, F.array(here))).otherwise(s.out).alias("out"))

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, start, step, lambda s: s.out)).otherwise(F.array().cast(f"array<{SPAN}>"))


def char_before(text: Column | str, at: Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(at > 0, F.substring(t, at, F.lit(1))).otherwise(F.lit(""))


def char_at(text: Column | str, at: Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.substring(t, at + 1, F.lit(1))


def byte_offset(text: Column | str, at: Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.octet_length(F.left(t, at))


def utf16_offset(text: Column | str, at: Column) -> Column:
    """The character offset ``at`` in UTF-16 units, as JavaScript and Java count."""
    t = F.col(text) if isinstance(text, str) else text
    return (F.octet_length(F.encode(F.left(t, at), "UTF-16BE")) / 2).cast("int")


def priority(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, tables.CATEGORIES)), category)


def resolve(findings: Column | str) -> Column:
    """Disjoint findings of an array of start, end, category, replacement, sorted by start.

    Higher priority first, then the longer, the earlier and the smaller replacement;
    a finding that overlaps a kept one or is empty goes. Acceptance depends on what
    was accepted before, so this is a fold and no window.
    """
    f = F.col(findings) if isinstance(findings, str) else findings
    keyed = F.transform(f, lambda x: F.struct(priority(x.category).alias("p"), (x.start - x.end).alias("n"), x.start.alias("start"), x.replacement.alias("replacement"), x.end.alias("end"), x.category.alias("category")))
    first = F.array_sort(F.filter(keyed, lambda x: x.end > x.start))
    none = F.filter(first, lambda x: F.lit(False))
    kept = F.aggregate(first, none, lambda out, x: F.when(F.exists(out, lambda y: (y.start < x.end) & (x.start < y.end)), out).otherwise(F.concat(out, F.array(x))))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.category.alias("category"), x.replacement.alias("replacement"))))


def segments(text: Column | str, findings: Column | str) -> Column:
    """Plain and masked pieces in order; their originals join to the text, their texts to the masked one."""
    t = F.col(text) if isinstance(text, str) else text
    f = F.col(findings) if isinstance(findings, str) else findings
    ends = F.concat(F.array(F.lit(0)), F.transform(f, lambda x: x.end))
    starts = F.concat(F.transform(f, lambda x: x.start), F.array(F.char_length(t)))

    def plain(a: Column, b: Column) -> Column:
        gap = F.substring(t, a + 1, b - a)
        return F.struct(F.lit("plain").alias("kind"), gap.alias("text"), F.lit(None).cast("string").alias("category"), gap.alias("original"))

    gaps = F.zip_with(ends, starts, plain)
    masked = F.transform(f, lambda x: F.struct(F.lit("masked").alias("kind"), x.replacement.alias("text"), x.category.alias("category"), F.substring(t, x.start + 1, x.end - x.start).alias("original")))
    both = F.flatten(F.transform(gaps, lambda g, k: F.array_compact(F.array(g, F.get(masked, k)))))
    return F.filter(both, lambda s: (s.kind != "plain") | (s.text != ""))


def apply(text: Column | str, findings: Column | str) -> Column:
    return F.array_join(F.transform(segments(text, findings), lambda s: s.text), "")


def compose(parts: Column | str, revealed: Column) -> Column:
    """Segments as a text, with the originals where ``revealed`` (an array of indices) says so."""
    p = F.col(parts) if isinstance(parts, str) else parts
    return F.array_join(F.transform(p, lambda s, k: F.when(F.array_contains(revealed, k), s.original).otherwise(s.text)), "")


def merged(findings: Column | str, more: Column | str) -> Column:
    """``findings`` with those of ``more`` that lie in plain text; of overlapping ones the later (then the longer) is taken."""
    f = F.col(findings) if isinstance(findings, str) else findings
    m = F.col(more) if isinstance(more, str) else more
    last_first = F.reverse(F.array_sort(F.transform(m, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.category.alias("category"), x.replacement.alias("replacement")))))
    taken = F.aggregate(last_first, f, lambda out, x: F.when((x.end <= x.start) | F.exists(out, lambda y: (y.start < x.end) & (x.start < y.end)), out).otherwise(F.concat(out, F.array(x))))
    return F.array_sort(taken)


def masked_by_hand(parts: Column | str, index: Column, start: Column, end: Column, mask: Callable[[Column], Column]) -> Column:
    """Segments with characters ``start`` to ``end`` of plain segment ``index`` masked, outer blanks left out; a blank selection changes nothing."""
    p = F.col(parts) if isinstance(parts, str) else parts

    def split(s: Column) -> Column:
        chosen = F.substring(s.text, start + 1, end - start)
        lead = F.char_length(F.regexp_extract(chosen, r"(?U)^\s*", 0))
        own = F.regexp_replace(chosen, r"(?U)^\s+|\s+$", "")
        at = start + lead
        stop = at + F.char_length(own)

        def part(kind: str, text: Column, category: Column, original: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), text.alias("text"), category.cast("string").alias("category"), original.alias("original"))

        before, after = F.substring(s.text, F.lit(1), at), F.substring(s.text, stop + 1, F.char_length(s.text) - stop)
        pieces = F.array(part("plain", before, F.lit(None), before), part("masked", mask(own), F.lit("custom"), own), part("plain", after, F.lit(None), after))
        return F.when((s.kind == "plain") & (own != ""), F.filter(pieces, lambda x: (x.kind == "masked") | (x.text != ""))).otherwise(F.array(s))

    return F.flatten(F.transform(p, lambda s, k: F.when(k == index, split(s)).otherwise(F.array(s))))
