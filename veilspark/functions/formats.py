"""What a text is, and the one format that is decoded before detection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables

FORMATS = ("http_request", "http_response", "curl", "fetch", "har", "burp_xml", "postman", "text")


def detect_format(text: Column | str) -> Column:
    """The first rule that fits; null is ``text``."""
    t = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)^\s+", "")
    line = F.split_part(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit(1))
    xml = t.startswith("<") & (t.contains("burpVersion") | t.contains("<item>"))
    postman = t.startswith("{") & (t.contains('"_postman_id"') | t.contains("schema.getpostman.com"))
    har = t.startswith("{") & t.contains('"log"') & t.contains('"entries"')
    return (
        F.when(xml, "burp_xml").when(postman, "postman").when(har, "har").when(t.startswith("curl "), "curl")
        .when(t.startswith("fetch(") | t.startswith("await fetch("), "fetch")
        .when(line.rlike(r"^[A-Z]{3,10} \S+ HTTP/[0-9](?:\.[0-9])?$"), "http_request").when(line.startswith("HTTP/"), "http_response").otherwise("text")
    )


_ENCODED = re.compile(tables.BURP_BASE64)


def normalized(text: str, format: str) -> str:
    """Encoded messages of an XML export as readable text; what doesn't decode stays."""
    if format != "burp_xml":
        return text
    from ..operators.detect import strict_base64

    def plain(m: re.Match) -> str:
        raw = strict_base64("".join(m[1].split()))
        return m[0] if raw is None else f'base64="false"><![CDATA[{raw.decode("utf-8", "replace")}]]>'

    return _ENCODED.sub(plain, text)
