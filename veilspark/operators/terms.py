"""A policy's terms: folded literals, found leftmost-longest in folded text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import scalars
from ..policy import Policy

_FOLD = str.maketrans(tables.ACCENTED, tables.PLAIN)
#: Shorter terms must stand alone.
STRICT_BELOW = 4


def fold(text: str) -> str:
    """Lower case without accents; one character for one, so offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low.translate(_FOLD)


def client_variants(name: str) -> list[str]:
    """The folded name, and its words joined in the usual ways."""
    folded = fold(name).strip()
    words = re.findall(r"[^\W_]+", folded)
    return sorted({folded, *(glue.join(words) for glue in (" ", "-", "_", ".", "") if len(words) > 1)} - {""})


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    kind: str
    replacement: str | None = None


def listed(terms: DataFrame, wanted: str, column: str = "value") -> DataFrame:
    """The rows of a list of terms that hold ``wanted``, whatever the case."""
    return terms.where(F.contains(F.lower(column), F.lit(wanted.lower())))


class Terms:
    def __init__(self, policy: Policy):
        self.by_pattern: dict[str, tuple[str, str | None]] = {}
        wanted = [(v, "client", None) for c in policy.client for v in client_variants(c)]
        wanted += [(u, "user", None) for u in policy.users] + [(h, "host", None) for h in policy.hosts]
        wanted += [(t.value, "custom", "[REDACTED]" if t.replacement is None else t.replacement) for t in policy.terms]
        for value, kind, replacement in wanted:
            if pattern := fold(value).strip():
                self.by_pattern.setdefault(pattern, (kind, replacement))  # the first kind stands
        longest_first = sorted(self.by_pattern, key=len, reverse=True)
        self.search = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def find(self, text: str) -> Iterator[Hit]:
        if self.search is None:
            return
        for m in self.search.finditer(fold(text)):
            a, b = m.span()
            alone = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            if b - a >= STRICT_BELOW or alone:
                yield Hit(a, b, *self.by_pattern[m[0]])

    def shown(self, hit: Hit, text: str, keep: float) -> str:
        if hit.kind == "client":
            return "[CLIENT]"
        if hit.kind == "custom":
            return hit.replacement
        return scalars.keep_head(text[hit.start : hit.end], keep)

    def around(self, text: str, keep: float, mask: Callable[[str], str]) -> str:
        """Terms replaced, and ``mask`` of what lies between them."""
        out, at = [], 0
        for hit in self.find(text):
            out += [mask(text[at : hit.start]), self.shown(hit, text, keep)]
            at = hit.end
        return "".join([*out, mask(text[at:])])

    def replaced(self, text: str, keep: float) -> str | None:
        """Terms replaced and nothing else; None if there are none."""
        return self.around(text, keep, lambda gap: gap) if next(self.find(text), None) else None
