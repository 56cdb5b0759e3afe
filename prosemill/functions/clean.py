"""Column functions that make values from outside safe to store: sanitisers, redaction and keyed hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def plain_text(value: Column, most: int = 300) -> Column:
    """Without tags, white space as one space, cut; null is the empty text."""
    bare = T.trimmed(F.regexp_replace(F.regexp_replace(value, "<[^>]*>", ""), r"(?U)\s+", " "))
    # Most values are missing or plain, and then need not be rewritten.
    return F.when(value.isNull(), "").when(value.rlike(r"(?U)[<\s]"), F.substring(bare, 1, most)).otherwise(F.substring(value, 1, most))


def key(value: Column) -> Column:
    """Lower-case letters, digits, underscores and dashes."""
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.lower(value), "[^a-z0-9_-]", ""))


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    known = T.let(key(value), lambda k: F.when(k.isin(*allowed), k).otherwise(default))
    return F.when(value.isNull(), F.lit(default)).otherwise(known)


def number(value: Column, default: float = 0.0, least: float | None = None, most: float | None = None) -> Column:
    """A text as a number within limits; the default where it is none."""
    out = F.coalesce(value.try_cast("double"), F.lit(default))
    if least is not None:
        out = F.greatest(F.lit(least), out)
    return out if most is None else F.least(F.lit(most), out)


def truth(value: Column) -> Column:
    return F.when(value.isNull(), False).otherwise(F.lower(T.trimmed(value)).isin("1", "true", "on", "yes"))


def text_list(values: Column, limit: int = 10, most: int = 300) -> Column:
    """The first ``limit`` texts, cleaned; empty ones go."""
    kept = F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, limit)
    return F.filter(F.transform(kept, lambda x: plain_text(x, most)), lambda x: x != "")


def key_list(values: Column, limit: int = 10) -> Column:
    kept = F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, limit)
    return F.filter(F.transform(kept, key), lambda x: x != "")


# Entries that a stored report keeps of each list.
LIST_LIMITS = {"contributions": 80, "dimensions": 30, "providers": 6, "issues": 40, "claims": 32, "spans": 80, "sections": 12, "items": 40, "metrics": 80}


def capped(values: Column, kind: str) -> Column:
    return F.slice(F.coalesce(values, F.array()), 1, LIST_LIMITS[kind])


def source_lines(value: Column, most: int = 12) -> Column:
    """The filled lines of a box of sources."""
    lines = F.transform(F.split(F.coalesce(value, F.lit("")), "\r?\n"), T.trimmed)
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def at_path(json: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def url_summary(url: Column) -> Column:
    """The origin of an address, and how much of it is left out."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    steps = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    args = F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))
    left = F.array_compact(
        F.array(
            F.when(steps > 0, F.concat(steps.cast("string"), F.lit(" path"))),
            F.when(args > 0, F.concat(args.cast("string"), F.lit(" query"))),
            F.when(url.contains("#"), F.lit("fragment")),
        )
    )
    return F.when(F.size(left) > 0, F.concat(origin, F.lit(" ("), F.array_join(left, "; "), F.lit(" omitted)"))).otherwise(origin)


def without_urls(text: Column) -> Column:
    """The text with only the origins of its addresses."""
    return F.regexp_replace(text, r"(?i)(?<![A-Za-z0-9_])(https?://[^\s/?#<>\"'`]+)[^\s<>\"'`]*", "$1")


def keyed_hash(value: Column, secret: str) -> Column:
    """HMAC-SHA256 in hexadecimal: two nested digests whose pads depend on the secret alone."""
    secret_bytes = secret.encode()
    block = (hashlib.sha256(secret_bytes).digest() if len(secret_bytes) > 64 else secret_bytes).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(F.coalesce(value, F.lit("")), "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def rolling_hash(text: Column) -> Column:
    """A 32-bit hash in hexadecimal by which a text is known to have changed: h = 33 h xor the next UTF-16 unit."""
    mask = F.lit((1 << 32) - 1)

    def step(h: Column, unit: Column) -> Column:
        return (h * 33).bitwiseAND(mask).bitwiseXOR(unit)

    def feed(h: Column, c: Column) -> Column:
        n = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(n > 0xFFFF, step(step(h, high.cast("long")), low.cast("long"))).otherwise(step(h, n))

    units = F.filter(F.split(text, ""), lambda c: c != "")
    return F.lower(F.hex(F.aggregate(units, F.lit(5381).cast("long"), feed)))
