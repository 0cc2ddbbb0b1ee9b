"""Masks and key classes as Column expressions, all JVM-side.

Ratios are doubles: Spark would read 0.2 as a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables

_LETTER = r"[\p{L}\p{N}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _share(n: Column, ratio: float) -> Column:
    return F.ceil(n.cast("double") * F.lit(float(ratio)).cast("double")).cast("int")


def cut_tail(value: Column | str, ratio: float) -> Column:
    """The last share of the letters and digits becomes ``*``; at least one, separators stay."""
    v = _c(value)
    n = F.regexp_count(v, F.lit(_LETTER))
    hide = F.least(F.greatest(_share(n, ratio), F.lit(1)), n)
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    # right to left: (how many are still to hide, what is done)
    start = F.struct(hide.alias("left"), F.lit("").alias("out"))
    fold = F.aggregate(
        F.reverse(chars),
        start,
        lambda s, c: F.struct(F.when((s.left > 0) & c.rlike(_LETTER), s.left - 1).otherwise(s.left).alias("left"), F.concat(F.when((s.left > 0) & c.rlike(_LETTER), F.lit("*")).otherwise(c), s.out).alias("out")),
        lambda s: s.out,
    )
    return F.when(n == 0, v).otherwise(fold)


def keep_head(value: Column | str, ratio: float) -> Column:
    """Of each run of letters and digits the first share stays, never all of it."""
    v = _c(value)
    runs = F.regexp_extract_all(v, F.lit(rf"({_LETTER}+|[^\p{{L}}\p{{N}}]+)"), F.lit(1))

    def one(w: Column) -> Column:
        n = F.char_length(w)
        keep = F.least(_share(n, ratio), n - 1)
        return F.when(w.rlike(_LETTER), F.concat(F.left(w, keep), F.repeat(F.lit("*"), n - keep))).otherwise(w)

    return F.array_join(F.transform(runs, one), "")


def secret(value: Column | str, ratio: float) -> Column:
    v = _c(value)
    n = F.char_length(v)
    keep = F.when(n < 7, 0).otherwise(F.least(F.floor(n.cast("double") * F.lit(float(ratio)).cast("double")).cast("int"), F.lit(12)))
    return F.concat(F.left(v, keep), F.lit("…[len="), n.cast("string"), F.lit("]"))


def ipv4(value: Column | str) -> Column:
    v = _c(value)
    a, b = F.split_part(v, F.lit("."), F.lit(1)), F.split_part(v, F.lit("."), F.lit(2))
    second = F.expr("0") + F.coalesce(F.try_to_number(b, F.lit("999")), F.lit(0)).cast("int")
    private = a.isin("10", "127") | ((a == "192") & (b == "168")) | ((a == "169") & (b == "254")) | ((a == "172") & second.between(16, 31)) | ((a == "100") & second.between(64, 127))
    return F.when(private, F.concat(a, F.lit("."), b, F.lit(".*.*"))).otherwise(F.concat(a, F.lit(".*.*.*")))


def ipv6(value: Column | str) -> Column:
    head = F.split_part(_c(value), F.lit(":"), F.lit(1))
    return F.concat(F.when(head == "", "0").otherwise(head), F.lit("::*"))


def card(value: Column | str) -> Column:
    """The first four and last four digits stay, and the separators."""
    v = _c(value)
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    total = F.regexp_count(v, F.lit(r"\d"))
    fold = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("seen"), F.lit("").alias("out")),
        lambda s, c: F.struct(
            F.when(c.rlike(r"\d"), s.seen + 1).otherwise(s.seen).alias("seen"),
            F.concat(s.out, F.when(c.rlike(r"\d") & (s.seen >= 4) & (s.seen < total - 4), F.lit("*")).otherwise(c)).alias("out"),
        ),
        lambda s: s.out,
    )
    return fold


def luhn_valid(value: Column | str) -> Column:
    digits = F.regexp_replace(_c(value), r"[^0-9]", "")
    return F.char_length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def normalize_key(key: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(key), "[^A-Za-z0-9]", ""))


def fold(text: Column | str) -> Column:
    """Lower case without accents, one character for one."""
    return F.translate(F.lower(_c(text)), tables.ACCENTED, tables.PLAIN)


def slugify(name: Column | str) -> Column:
    flat = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.left(flat, F.lit(64)), "-+$", "")
    return F.when(short == "", "engagement").otherwise(short)


def valid_name(name: Column | str) -> Column:
    return _c(name).rlike(r"^(?!\.)[A-Za-z0-9._-]{1,64}$")


def is_id_key(key: Column | str) -> Column:
    k = _c(key)
    return F.lower(k).rlike(r"^(id|uid|uuid|guid)$|[_.-]id$") | ((F.char_length(k) > 2) & k.rlike("(Id|ID)$"))


def classify_key(key: Column | str, is_param: bool = False, extra: tuple[str, ...] = ()) -> Column:
    """``secret``, ``id``, ``pii`` or null."""
    k = _c(key)
    n = normalize_key(k)
    part = n.rlike("|".join(tables.SECRET_KEY_PARTS)) & ~n.rlike(f"({'|'.join(tables.METADATA_SUFFIXES)})$")
    named = n.isin([*tables.SECRET_KEYS, *extra, *(tables.SECRET_PARAMS if is_param else [])])
    return F.when(n == "", None).when(named | part, "secret").when(is_id_key(k), "id").when(n.isin(tables.PII_KEYS), "pii")


def mask_host(host: Column | str, keep: float, allowed: tuple[str, ...] = tuple(tables.ALLOWED_DOMAINS)) -> Column:
    """Of a host that isn't allowed, the label before the public suffix; without a policy's terms."""
    h = _c(host)
    low = F.lower(h)
    free = F.lit(False)
    for d in allowed:
        free = free | (low == d) | low.endswith("." + d)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(F.split(low, r"\."), F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    suffix = F.when(n == 1, 0).when(two.isin(tables.SECOND_LEVEL), F.least(F.lit(2), n - 1)).otherwise(1)
    return F.when(free, h).otherwise(F.array_join(F.transform(labels, lambda x, k: F.when(k == n - suffix - 1, keep_head(x, keep)).otherwise(x)), "."))


def mask_email(email: Column | str, keep: float) -> Column:
    e = _c(email)
    return F.concat(keep_head(F.substring_index(e, "@", 1), keep), F.lit("@"), mask_host(F.substring_index(e, "@", -1), keep))
