"""Detectors: everything in a text that a policy would mask, before overlaps are resolved.

Runs inside an Arrow function, one text at a time. Each detector is a generator of
candidates; what needs no state is a row of ``SIMPLE``.
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import attrgetter

from .. import tables
from ..functions import scalars
from ..policy import Policy
from .terms import Terms

#: Nested values are masked down to here; deeper ones are opaque secrets.
MAX_DEPTH = 3


@dataclass(frozen=True, slots=True)
class Span:
    start: int
    end: int
    category: str
    replacement: str


def _rx(name: str) -> re.Pattern:
    return re.compile(getattr(tables, name))


RX = {n: _rx(n) for n in ("PRIVATE_KEY", "JWT", "EMAIL", "CARD", "UUID", "IPV4", "IPV6", "DOMAIN", "PATH_ID", "URL_CREDENTIALS", "HEADER", "CURL_USER", "CURL_COOKIE", "AUTH_PARAM", "JSON_STRING_PAIR", "JSON_NUMBER_PAIR", "NAME_VALUE", "VALUE_FOLLOWS", "VERSION_FOLLOWS", "COOKIES_ARRAY", "PARAM")}
VENDORS = [re.compile(p) for p in tables.VENDOR_TOKENS]


#: What each family can't do without. A text that lacks it isn't searched; each is a literal, or a pattern that begins
#: with one, so that looking for it costs next to nothing.
VENDOR_MARKS = (("AKIA", "ASIA"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("glpat-",), ("k_live_", "k_test_"), ("sk-",), ("xox",), ("AIza",), ("ya29.",))
_DIGIT, _UUID_DASHES, _DOT_DIGIT, _COLONS, _DOT_LETTER, _SLASH_DIGITS, _KEYED = (
    re.compile(p) for p in (r"\d", r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-", r"\.\d", r":[0-9A-Fa-f]{0,4}:", r"\.[A-Za-z]", r"/\d\d", r'"\s*:')
)


def _has_digit(text: str) -> bool:
    return any(d in text for d in "0123456789") or (not text.isascii() and _DIGIT.search(text) is not None)


def strict_base64(value: str) -> bytes | None:
    try:
        return base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return None


def string_end(text: str, at: int, escaped: bool) -> int | None:
    """Where a JSON string that begins at ``at`` closes; None at a line break or the end."""
    skip = re.compile(r'\\\\|\\"|"|\n|\\') if escaped else re.compile(r'\\[\s\S]|"|\n')
    for m in skip.finditer(text, at):
        token = m[0]
        if token == "\n":
            return None
        if token == ('\\"' if escaped else '"'):
            return m.start()
    return None


def array_end(text: str, at: int) -> int | None:
    """Where the JSON array opened before ``at`` closes."""
    depth, inside = 1, False
    for m in re.compile(r'\\[\s\S]|["\[\]]').finditer(text, at):
        c = m[0]
        if c == '"':
            inside = not inside
        elif not inside and c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                return m.start()
    return None


class Engine:
    """A compiled policy."""

    def __init__(self, policy: Policy = Policy()):
        self.ratios = policy.ratios
        self.terms = Terms(policy)
        self.headers = {h.lower() for h in (*tables.SENSITIVE_HEADERS, *(h.strip() for h in policy.sensitive_headers))}
        self.keys = {scalars.normalize_key(k) for k in policy.sensitive_keys} - {""}
        self.allowed = tuple(d.strip().lower().lstrip(".") for d in (*tables.ALLOWED_DOMAINS, *policy.allow_domains) if d.strip())
        self.tlds, self.second_level = set(tables.TLDS), set(tables.SECOND_LEVEL)

    # masks that depend on the policy

    def mask_secret(self, value: str) -> str:
        masked = scalars.secret(value, self.ratios.secret_keep)
        return self.terms.replaced(masked, self.ratios.pii_keep) or masked

    def mask_pii(self, value: str) -> str:
        keep = self.ratios.pii_keep
        return self.terms.around(value, keep, lambda gap: scalars.keep_head(gap, keep))

    def mask_id(self, value: str) -> str:
        return scalars.cut_tail(value, self.ratios.id_cut)

    def mask_email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        return f"{self.mask_pii(local)}@{self.mask_host(domain)}"

    def mask_host(self, host: str) -> str:
        keep, low = self.ratios.pii_keep, host.lower()
        if any(low == d or low.endswith("." + d) for d in self.allowed):
            return self.terms.replaced(host, keep) or host
        labels = host.split(".")
        suffix = 0 if len(labels) == 1 else 1
        if len(labels) > 1 and ".".join(labels[-2:]).lower() in self.second_level:
            suffix = min(2, len(labels) - 1)
        own = len(labels) - suffix - 1
        return ".".join(self.terms.replaced(x, keep) or (scalars.keep_head(x, keep) if k == own else x) for k, x in enumerate(labels))

    # candidates

    def candidates(self, text: str, depth: int = 0) -> list[Span]:
        """In the order patterns, headers, keys, terms; no-ops and repeated token spans left out."""
        tokens: set[tuple[int, int]] = set()
        out = []
        for start, end, category, replacement in self._all(text):
            if category == "token":
                if (start, end) in tokens:
                    continue
                tokens.add((start, end))
                rendered = self.render_jwt(text[start:end], depth)
                category, replacement = ("jwt", rendered) if rendered is not None else ("secret", self.mask_secret(text[start:end]))
            if start < end and replacement != text[start:end]:
                out.append(Span(start, end, category, replacement))
        return out

    def _all(self, text: str) -> Iterator[tuple[int, int, str, str | None]]:
        yield from self._patterns(text)
        yield from self._headers(text)
        yield from self._pairs(text)
        keep = self.ratios.pii_keep
        for hit in self.terms.find(text):
            shown = self.mask_host(text[hit.start : hit.end]) if hit.kind == "host" else self.terms.shown(hit, text, keep)
            yield hit.start, hit.end, hit.kind, shown

    def _patterns(self, text: str):
        if "-----BEGIN " in text:
            for m in RX["PRIVATE_KEY"].finditer(text):
                yield *m.span(), "private_key", f"-----BEGIN {m[1]}PRIVATE KEY-----[REDACTED]-----END {m[1]}PRIVATE KEY-----"
        if "eyJ" in text:
            for m in RX["JWT"].finditer(text):
                yield *m.span(), "token", None
        for marks, vendor in zip(VENDOR_MARKS, VENDORS, strict=True):
            if any(mark in text for mark in marks):
                for m in vendor.finditer(text):
                    yield *m.span(), "secret", self.mask_secret(m[0])
        if "@" in text:
            if "://" in text:
                for m in RX["URL_CREDENTIALS"].finditer(text):
                    yield *m.span(1), "credential", self.mask_pii(m[1])
                    yield *m.span(2), "credential", self.mask_secret(m[2])
            for m in RX["EMAIL"].finditer(text):
                yield *m.span(), "email", self.mask_email(m[0])
        if _has_digit(text):
            for m in RX["CARD"].finditer(text):
                if scalars.luhn_valid(m[0]):
                    yield *m.span(), "card", scalars.card(m[0])
        if _UUID_DASHES.search(text):
            for m in RX["UUID"].finditer(text):
                yield *m.span(), "uuid", self.mask_id(m[0])
        if _DOT_DIGIT.search(text):
            for m in RX["IPV4"].finditer(text):
                a, b = m.span()
                version = text[a - 1 : a] == "." or text[b : b + 1] == "." or (text[a - 1 : a] == "/" and text[max(a - 2, 0) : a] != "//")
                if not version and m[0] not in ("0.0.0.0", "127.0.0.1", "255.255.255.255"):
                    yield a, b, "ip", scalars.ipv4(m[0])
        if _COLONS.search(text):
            for m in RX["IPV6"].finditer(text):
                if self._ipv6(text, *m.span()):
                    yield *m.span(), "ip", scalars.ipv6(m[0])
        if _DOT_LETTER.search(text):
            for m in RX["DOMAIN"].finditer(text):
                if m[1].lower() in self.tlds and not _dotted_on(text, m.end()):
                    yield *m.span(), "host", self.mask_host(m[0])
        if _SLASH_DIGITS.search(text):
            for m in RX["PATH_ID"].finditer(text):
                if not (m.start() and text[m.start() - 1].isdigit()) and not _dotted_on(text, m.end()):
                    yield *m.span(1), "id", self.mask_id(m[1])

    @staticmethod
    def _ipv6(text: str, a: int, b: int) -> bool:
        near = text[a - 1 : a] if a else "", text[b : b + 1]
        if any(c and (c.isalnum() or c in "_:.") for c in near):
            return False
        value = text[a:b]
        if sum(map(bool, value.split(":"))) < 2 or not re.search("[0-9]", value) or value == "::1":
            return False
        try:
            return bool(ipaddress.IPv6Address(value))
        except ValueError:
            return False

    def _headers(self, text: str):
        if ":" in text and any(h in low for low in [text.lower()] for h in self.headers):
            for m in RX["HEADER"].finditer(text):
                if m[2].lower() not in self.headers:
                    continue
                start = m.end()
                end = text.find("\n", start)
                end = len(text) if end < 0 else end
                if m[1] and (close := text.find(m[1], start, end)) >= 0:
                    end = close
                yield from self._header_value(m[2].lower(), text, start, start + len(text[start:end].rstrip()))
        if "-u" in text:  # --user too
            for m in RX["CURL_USER"].finditer(text):
                a, b = m.span(m.lastindex)
                user, colon, word = text[a:b].partition(":")
                yield a, b, "credential", f"{self.mask_pii(user)}:{self.mask_secret(word)}" if colon else self.mask_pii(user)
        if "-b" in text or "--cookie" in text:
            for m in RX["CURL_COOKIE"].finditer(text):
                yield from self._cookies(text, *m.span(m.lastindex), False)

    def _header_value(self, name: str, text: str, start: int, end: int):
        if start >= end:
            return
        if name in ("cookie", "set-cookie"):
            yield from self._cookies(text, start, end, name == "set-cookie")
        elif name in ("authorization", "proxy-authorization"):
            yield from self._authorization(text, start, end)
        else:
            yield start, end, "token", None

    @staticmethod
    def _cookies(text: str, start: int, end: int, only_first: bool):
        at = start
        for part in text[start:end].split(";")[: 1 if only_first else None]:
            if "=" in part:
                value = part[part.index("=") + 1 :]
                lead = at + len(part) - len(value) + len(value) - len(value.lstrip())
                yield lead, lead + len(value.strip()), "token", None
            at += len(part) + 1

    def _authorization(self, text: str, start: int, end: int):
        scheme = re.match(r"(\S+)\s+", text[start:end])
        if not scheme:
            if not text[start:end][:1].isspace():
                yield start, end, "token", None
            return
        at = start + scheme.end()
        if at >= end:
            return
        name = scheme[1].lower()
        if name == "basic":
            raw = strict_base64(text[at:end])
            try:
                pair = raw.decode() if raw is not None else ""
            except UnicodeDecodeError:
                pair = ""
            user, colon, word = pair.partition(":")
            if colon:
                yield at, end, "credential", f"[basic-auth {self.mask_pii(user)}:{self.mask_secret(word)}]"
            else:
                yield at, end, "token", None
        elif name in ("bearer", "token", "jwt", "sso-key"):
            yield at, end, "token", None
        else:
            found = False
            for m in RX["AUTH_PARAM"].finditer(text[at:end]):
                found = True
                if m[1].lower() not in tables.PUBLIC_AUTH_PARAMS:
                    a, b = m.span(m.lastindex)
                    yield at + a, at + b, "token", None
            if not found:
                yield at, end, "token", None

    def key_class(self, key: str, is_param: bool) -> str | None:
        name = scalars.normalize_key(key)
        if not name:
            return None
        described = name.endswith(tuple(tables.METADATA_SUFFIXES))
        listed = name in self.keys or name in tables.SECRET_KEYS or (is_param and name in tables.SECRET_PARAMS)
        if listed or (not described and any(p in name for p in tables.SECRET_KEY_PARTS)):
            return "secret"
        if scalars.is_id_key(key):
            return "id"
        return "pii" if name in tables.PII_KEYS else None

    def _keyed(self, text: str, key: str, is_param: bool, start: int, end: int, headers: bool = True):
        if headers and key.lower() in self.headers:
            yield from self._header_value(key.lower(), text, start, end)
            return
        kind = self.key_class(key, is_param)
        if kind and start < end:
            mask = {"secret": lambda v: None, "pii": self.mask_pii, "id": self.mask_id}[kind]
            yield start, end, "token" if kind == "secret" else kind, mask(text[start:end])

    def _pairs(self, text: str):
        if _KEYED.search(text):
            yield from self._json_pairs(text)
        if "=" in text:
            for m in RX["PARAM"].finditer(text):
                yield from self._keyed(text, m[1], True, *m.span(2), headers=False)

    def _json_pairs(self, text: str):
        for m in RX["JSON_STRING_PAIR"].finditer(text):
            end = string_end(text, m.end(), m[2].startswith("\\"))
            if end is None:
                continue
            key = m[1]
            label = (key in ("name", "key") and RX["VALUE_FOLLOWS"].match(text, end)) or (key == "name" and RX["VERSION_FOLLOWS"].match(text, end))
            if not label:
                yield from self._keyed(text, key, False, m.end(), end)
        for m in RX["JSON_NUMBER_PAIR"].finditer(text):
            if self.key_class(m[1], False) == "id":
                yield *m.span(2), "id", self.mask_id(m[2])
        jars = [(m.end(), end) for m in RX["COOKIES_ARRAY"].finditer(text) if (end := array_end(text, m.end())) is not None]
        for m in RX["NAME_VALUE"].finditer(text):
            start, end = m.end(), string_end(text, m.end(), m[2].startswith("\\"))
            if end is None:
                continue
            if any(a <= start < b for a, b in jars):
                yield start, end, "token", None
            else:
                yield from self._keyed(text, m[1], True, start, end)

    # tokens that decode

    def render_jwt(self, token: str, depth: int) -> str | None:
        parts = token.split(".")
        if len(parts) != 3 or not (parts[0].startswith("eyJ") and parts[1].startswith("eyJ")):
            return None
        try:
            head, body = (json.loads(_url_base64(p), parse_float=_Literal, parse_int=_Literal) for p in parts[:2])
        except (ValueError, binascii.Error, RecursionError):
            return None
        shown = [_flat(self._claims(x, None, depth)) for x in (head, body)]
        return f"[JWT header{shown[0]} payload{shown[1]} sig={f'…[len={len(parts[2])}]' if parts[2] else '<none>'}]"

    def _claims(self, value, key: str | None, depth: int):
        if isinstance(value, dict):
            return {k: self._claims(v, k, depth) for k, v in value.items()}
        if isinstance(value, list):
            return [self._claims(v, key, depth) for v in value]
        name = scalars.normalize_key(key) if key is not None else None
        if isinstance(value, _Literal):
            return self.mask_id(value) if name in tables.ID_CLAIMS else value
        if not isinstance(value, str):
            return value
        if name in tables.DESCRIPTIVE_CLAIMS:
            return self.terms.replaced(value, self.ratios.pii_keep) or value
        nested = self.nested(value, depth + 1)
        if key is None or nested != value:
            return nested
        return self.mask_id(value) if name in tables.ID_CLAIMS else self.mask_pii(value) if name in tables.PII_CLAIMS else value

    # whole texts

    def nested(self, text: str, depth: int) -> str:
        return self.mask_secret(text) if depth > MAX_DEPTH else self.redact(text, depth)[0]

    def redact(self, text: str, depth: int = 0) -> tuple[str, list[Span]]:
        spans = resolve(self.candidates(text, depth))
        return splice(text, spans), spans


class _Literal(str):
    """A JSON number as it was written."""


def _url_base64(part: str) -> bytes:
    bare = part.rstrip("=")
    if len(bare) % 4 == 1 or re.search(r"[^A-Za-z0-9_-]", bare):
        raise ValueError(part)
    return base64.urlsafe_b64decode(bare + "=" * (-len(bare) % 4))


def _flat(value) -> str:
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}={_flat(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_flat, value)) + "]"
    return value if isinstance(value, str) else json.dumps(value)


def _dotted_on(text: str, end: int) -> bool:
    return text[end : end + 1] == "." and bool(re.match("[A-Za-z0-9]", text[end + 1 : end + 2]))


def resolve(spans: list[Span]) -> list[Span]:
    """Disjoint spans: the higher priority first, then the longer, the earlier, the smaller replacement."""
    # stable sorts, the last one counts most: keys of four fields would take more memory than the spans
    ordered = [s for s in spans if s.start < s.end]
    for key in (attrgetter("replacement"), attrgetter("start"), lambda s: s.start - s.end, lambda s: tables.PRIORITY[s.category]):
        ordered.sort(key=key)
    starts: list[int] = []
    kept: list[Span] = []
    for s in ordered:
        k = bisect_left(starts, s.start)
        if (k == 0 or kept[k - 1].end <= s.start) and (k == len(kept) or s.end <= kept[k].start):
            starts.insert(k, s.start)
            kept.insert(k, s)
    return kept


def splice(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], s.replacement]
        at = s.end
    return "".join([*out, text[at:]])
