"""Web pages as a source: guards on their address, gates on their size, and their readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import text as T

MOST_BYTES = 2_000_000
# Elements whose content is none, and words that name a container of content.
CHROME = ("script", "style", "noscript", "svg", "template", "nav", "header", "footer", "aside", "form", "button", "iframe", "canvas")
CONTENT_WORDS = "article|content|entry|main|post|story|body"
# What a page's content may be, the most redirects, and elements whose end breaks a line.
CONTENT_TYPES = r"(?i)^\s*(?:text/html|text/plain|application/xhtml\+xml)(?:\s*;|\s*$)"
MOST_REDIRECTS = 5
BLOCK_ENDS = r"(?i)</(?:p|div|article|section|main|h[1-6]|li|blockquote|tr|table|ul|ol)>"
# The named references that are decoded.
ENTITIES = (("&apos;", "'"), ("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&"))
# Private and reserved IPv4 ranges, as network and prefix length.
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def normalized_url(url: Column) -> Column:
    """The address with a scheme; null where it is empty or of another scheme than http or https."""
    u = T.trimmed(url)
    full = F.when(u.rlike(r"^[a-zA-Z][a-zA-Z\d+\-.]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when((u != "") & full.rlike("(?i)^https?://[^/?#]+"), full)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    valid = host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & F.forall(parts, lambda p: F.try_to_number(p, F.lit("999")) <= 255)
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(valid, total)


def _range(network: str, bits: int) -> tuple[int, int]:
    low = 0
    for part in network.split("."):
        low = low * 256 + int(part)
    return low, low + (1 << (32 - bits)) - 1


def _is_private_v4(number: Column) -> Column:
    out = F.lit(False)
    for network, bits in PRIVATE:
        out = out | F.coalesce(number.between(*_range(network, bits)), F.lit(False))
    return out


def _once(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ipv6_parts(host: Column) -> Column:
    """The eight numbers of an IPv6 address, brackets or not, compressed or not, with a dotted end or not; null where it is none."""
    bare = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    dotted = r":((?:\d{1,3}\.){3}\d{1,3})$"

    def undotted(x: Column) -> Column:
        def tail(n: Column) -> Column:
            return F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))

        end = F.regexp_extract(x, dotted, 1)
        head = F.substring(x, F.lit(1), F.length(x) - F.length(end))
        return F.when(x.rlike(dotted), F.concat(head, _once(ipv4_number(end), tail))).otherwise(x)

    def parts(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def filled(halves: Column) -> Column:
        head, rest = parts(halves[0]), F.when(F.size(halves) == 2, parts(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        zeros = 8 - F.size(head) - F.size(rest)
        return F.when((F.size(halves) == 1) & (zeros == 0), head).when((F.size(halves) == 2) & (zeros >= 1), F.concat(head, F.array_repeat(F.lit("0"), zeros), rest))

    def numbers(whole: Column) -> Column:
        return F.when(F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda x: F.conv(x, 16, 10).cast("int")))

    whole = _once(_once(bare, undotted), lambda x: _once(F.split(x, "::", -1), filled))
    return F.when(bare.contains(":"), _once(whole, numbers))


def is_private_v6(parts: Column) -> Column:
    """Unspecified, loopback, discard, local, multicast and documentation ranges, and mapped private IPv4 addresses."""
    p = [F.get(parts, F.lit(i)) for i in range(8)]
    none = F.forall(F.slice(parts, 1, 7), lambda x: x == 0)
    mapped = F.forall(F.slice(parts, 1, 5), lambda x: x == 0) & (p[5] == 0xFFFF)
    inner = _is_private_v4(p[6].cast("long") * 65536 + p[7])
    reserved = (
        (none & p[7].isin(0, 1))
        | ((p[0] == 0x0100) & (p[1] == 0))
        | (p[0].bitwiseAND(F.lit(0xFE00)) == 0xFC00)
        | (p[0].bitwiseAND(F.lit(0xFFC0)) == 0xFE80)
        | (p[0].bitwiseAND(F.lit(0xFF00)) == 0xFF00)
        | (p[0] == 0x2002)
        | ((p[0] == 0x2001) & (((p[1] == 2) & (p[2] == 0)) | p[1].between(0x10, 0x1F) | (p[1] == 0x0DB8)))
    )
    return F.coalesce(F.when(mapped, inner).otherwise(reserved), F.lit(False))


def is_private(host: Column) -> Column:
    """Local names, and private or reserved addresses of either kind."""
    name = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local")
    return F.coalesce(name, F.lit(False)) | _once(ipv4_number(host), _is_private_v4) | _once(ipv6_parts(host), is_private_v6)


def url_host(url: Column) -> Column:
    """The host of a web address, of an IPv6 one without its brackets."""
    bracketed = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?\[([^\]]*)\]", 1)
    return F.when(bracketed != "", F.lower(bracketed)).otherwise(host_of(url))


def gate(url: Column, redirects: Column, addresses: Column, content_type: Column, html: Column) -> Column:
    """Why a fetched page is refused, or ``accepted``: the first that holds.

    ``redirects`` are the addresses it went through, ``addresses`` those its
    hosts resolved to; a null array is an empty one.
    """
    none = F.array().cast("array<string>")
    hops = F.coalesce(redirects, none)
    return (
        F.when(normalized_url(url).isNull() | F.exists(hops, lambda u: ~u.rlike("(?i)^https?://")), "not_web")
        .when(is_private(url_host(normalized_url(url))) | F.exists(hops, lambda u: is_private(url_host(u))), "private")
        .when(F.exists(F.coalesce(addresses, none), is_private), "resolves_to_private")
        .when(F.size(hops) > MOST_REDIRECTS, "too_many_redirects")
        .when(~F.coalesce(content_type.rlike(CONTENT_TYPES), F.lit(True)), "unsupported_type")
        .when(~within_size(html), "too_large")
        .otherwise("accepted")
    )


def is_plain(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)^\s*text/plain"), F.lit(False))


def decoded(text: Column) -> Column:
    """Named, decimal and hexadecimal references decoded in one pass, whatever their case and length.

    Unknown names, numbers beyond the last code point and halves of pairs stay
    as they are.
    """
    pattern = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]+);"
    named = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])

    def one(m: Column) -> Column:
        digits = F.regexp_extract(m, r"^&#[xX]?0*([0-9a-fA-F]*);$", 1)
        hexadecimal = F.lower(m).startswith("&#x")
        # Longer ones are beyond any code point.
        beyond = F.length(digits) > F.when(hexadecimal, 6).otherwise(7)
        number = F.when(beyond, -1).when(digits == "", 0).when(hexadecimal, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long"))
        valid = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(m.startswith("&#"), F.when(valid, letter).otherwise(m)).otherwise(F.coalesce(F.element_at(named, F.lower(m)), m))

    found, gaps = T.all_matches(text, pattern), F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("found"))
    whole = F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.when(p["found"].isNull(), "").otherwise(one(p["found"])))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def within_size(html: Column) -> Column:
    return F.octet_length(F.coalesce(html, F.lit(""))) <= MOST_BYTES


def without_chrome(html: Column) -> Column:
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in CHROME:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?![A-Za-z0-9_]).*?</{tag}\s*>", " ")
    return out


def fragment_text(html: Column) -> Column:
    """Markup as plain text: block ends as line feeds, list items as dashes; named references decoded last."""
    out = F.regexp_replace(html, r"(?i)<(?:br|hr)\s*/?>", "\n")
    out = F.regexp_replace(out, BLOCK_ENDS, "\n")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, "[ \t\u00a0]+", " ")
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
    return decoded(out)


def page_title(html: Column) -> Column:
    title = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(title != "", fragment_text(title))


def candidates(pages: DataFrame) -> DataFrame:
    """``page_id, ord, fragment``: containers that may hold the text, in order of their patterns."""
    found = [T.all_matches(F.col("clean"), rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}>") for tag in ("article", "main")]
    found += [
        T.all_matches(F.col("clean"), rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*(?:id|class|role)=[\"'][^\"']*(?:{CONTENT_WORDS})[^\"']*[\"'][^>]*>.*?</{tag}>")
        for tag in ("section", "div")
    ]
    return pages.select("page_id", F.posexplode(F.concat(*found)).alias("ord", "fragment"))


def with_score(fragments: DataFrame) -> DataFrame:
    """Adds ``text, words, score`` to rows with ``fragment``: words, paragraphs, headings and lists less linked words."""
    d = fragments.withColumn("text", fragment_text(F.col("fragment")))
    d = d.withColumn("words", T.count_of(F.col("text"), X.WORD))
    links = T.all_matches(F.col("fragment"), r"(?is)<a(?![A-Za-z0-9_])[^>]*>.*?</a>")
    linked = F.length(F.array_join(F.transform(links, lambda a: fragment_text(a)), " "))
    density = F.when(F.length("text") > 0, linked / F.length("text")).otherwise(0.0)
    count = lambda p: T.count_of(F.col("fragment"), p)
    score = F.col("words") + count("(?i)</p>") * 22 + count("(?i)<h[1-6](?![A-Za-z0-9_])") * 10
    score = score + F.least(F.lit(40), count("(?i)<li(?![A-Za-z0-9_])") * 3) - T.half_up(F.col("words") * density * 1.8)
    return d.withColumn("score", score.cast("long"))


def readable(pages: DataFrame) -> DataFrame:
    """``page_id, n_chars, words, chosen, confidence, text, notes``: the best container, or the whole page, and codes of how it went."""
    d = pages.select("page_id", without_chrome(F.col("html")).alias("clean"))
    scored = with_score(candidates(d)).filter("words >= 25")
    best = scored.groupBy("page_id").agg(F.max_by(F.struct("score", "text"), F.struct("score", -F.col("ord"))).alias("best"))
    d = d.select("page_id", fragment_text(F.col("clean")).alias("full")).join(best, "page_id", "left")
    enough = F.col("best.score") >= F.greatest(F.lit(60.0), T.count_of(F.col("full"), X.WORD) * 0.18)
    chosen = F.coalesce(enough, F.lit(False))
    d = d.withColumns({"chosen": chosen, "text": F.when(chosen, F.col("best.text")).otherwise(F.col("full"))})
    words = T.count_of(F.col("text"), X.WORD)
    sure = F.when(words >= 180, 0.86).when(words >= 80, 0.68).when(words >= 30, 0.42).otherwise(0.18)
    how = F.when(F.col("chosen"), "container_chosen").when(F.col("best").isNotNull(), "whole_page_after_scoring")
    notes = F.array_compact(F.array(how, F.when(words < 80, "little_text")))
    return d.select("page_id", F.length("text").alias("n_chars"), words.alias("words"), "chosen", sure.alias("confidence"), "text", notes.alias("notes"))


def editor_text(markup: Column) -> Column:
    """Editor markup as text: headings become # lines, list items - lines, other block ends line feeds."""
    out = F.coalesce(markup, F.lit(""))
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script(?![A-Za-z0-9_]).*?</script\s*>", r"(?is)<style(?![A-Za-z0-9_]).*?</style\s*>"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<li[^>]*>", "\n- ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|section|article|main|blockquote|li|ul|ol|h[1-6])>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), "[ \t\u00a0]+", " ")
    out = F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
