"""Masks of single values in Python, for what runs inside an Arrow function.

``masks`` has the same functions as Column expressions.
"""

from __future__ import annotations

import math
import re

_ALNUM_RUN = re.compile(r"[^\W_]+")


def cut_tail(value: str, ratio: float) -> str:
    at = [i for i, c in enumerate(value) if c.isalnum()]
    if not at:
        return value
    hide = set(at[-min(max(math.ceil(len(at) * ratio), 1), len(at)) :])
    return "".join("*" if i in hide else c for i, c in enumerate(value))


def keep_head(value: str, ratio: float) -> str:
    def word(m: re.Match) -> str:
        w = m[0]
        keep = min(math.ceil(len(w) * ratio), len(w) - 1)
        return w[:keep] + "*" * (len(w) - keep)

    return _ALNUM_RUN.sub(word, value)


def secret(value: str, ratio: float) -> str:
    n = len(value)
    keep = 0 if n < 7 else min(math.floor(n * ratio), 12)
    return f"{value[:keep]}…[len={n}]"


def private_ipv4(a: str, b: str) -> bool:
    second = int(b)
    return a in ("10", "127") or (a, b) in (("192", "168"), ("169", "254")) or (a == "172" and 16 <= second <= 31) or (a == "100" and 64 <= second <= 127)


def ipv4(value: str) -> str:
    parts = value.split(".")
    keep = 2 if private_ipv4(parts[0], parts[1]) else 1
    return ".".join(parts[:keep] + ["*"] * (4 - keep))


def ipv6(value: str) -> str:
    return f"{value.split(':')[0] or '0'}::*"


def card(value: str) -> str:
    total = sum(c.isdigit() for c in value)
    out, seen = [], 0
    for c in value:
        if c.isdigit():
            seen += 1
            c = c if seen <= 4 or seen > total - 4 else "*"
        out.append(c)
    return "".join(out)


def luhn_valid(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = (d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def normalize_key(key: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", key).lower()


def is_id_key(key: str) -> bool:
    low = key.lower()
    return low in ("id", "uid", "uuid", "guid") or low.endswith(("_id", "-id", ".id")) or (len(key) > 2 and key.endswith(("Id", "ID")))
