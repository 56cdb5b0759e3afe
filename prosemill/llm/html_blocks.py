"""Leaf blocks of an HTML page: runs of text between block-level tags, with what stands above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # A quote begins a value only after an equals sign; nothing is tried twice.
    r"|</?[a-zA-Z](?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Their text is never shown.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video select head annotation annotation-xml".split())
#: Of these the content is not markup, so only their own end tag ends them.
NOT_MARKUP = frozenset("script style textarea title iframe".split())
#: Of these, the ones that stand inside a line and don't end its block.
INLINE_RAW = frozenset("svg object audio video canvas annotation annotation-xml noscript script style template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open one of these, up to the nearest of the second list.
_ENDS = {
    **{t: (("li",), ("ul", "ol", "menu")) for t in ("li",)},
    **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")},
    **{t: (("td", "th"), ("tr", "table")) for t in ("td", "th")},
    **{t: (("tr", "td", "th"), ("table",)) for t in ("tr", "tbody", "thead", "tfoot")},
    "option": (("option",), ("select",)),
}
ATTRIBUTES = ("class", "id", "role", "itemprop", "aria-label", "data-role")


@dataclass(frozen=True)
class Node:
    """An open block-level element: its tag and the words of its telling attributes."""

    tag: str
    words: tuple[str, ...]


@dataclass
class Block:
    path: tuple[Node, ...]
    text: str
    linked: int  # characters inside links


def _node(tag: str, source: str) -> Node:
    words: list[str] = []
    rest = source[len(tag) + 1 :]
    if "=" in rest or "hidden" in rest:
        for name, value in _ATTRIBUTE.findall(rest):
            name = name.lower()
            value = value.strip("\"'")
            if name in ATTRIBUTES:
                words += _PART.findall(_CAMEL.sub(" ", value).lower())
            elif name == "hidden" or (name == "style" and "none" in value.replace(" ", "").lower().partition("display:")[2][:5]):
                words.append("hidden")
            elif name == "aria-hidden" and value.lower() == "true":
                words.append("hidden")
    return Node(tag, tuple(dict.fromkeys(words)))


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, references decoded and white space as one space."""
    out: list[Block] = []
    if not page:
        return out
    path: list[Node] = []
    texts: list[str] = []
    unclosed: set[str] = set()
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if texts:
            raw = "".join(texts)
            if not raw.isspace():
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    out.append(Block(tuple(path), text, linked))
            texts.clear()
        linked = 0

    def end_of(tag: str, at: int) -> int | None:
        """Behind the end tag that belongs to a start tag before ``at``, or none."""
        if tag in unclosed:
            return None
        depth, edge = 1, re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I)
        for m in edge.finditer(page, at):
            if m.end() == m.start():
                return m.end()
            depth += -1 if m.group(1) else 0 if tag in NOT_MARKUP or m.group().endswith("/>") else 1
            if not depth:
                return m.end()
        unclosed.add(tag)
        return None

    def shut(tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        for i in range(len(path) - 1, -1, -1):
            if path[i].tag in tags:
                del path[i:]
                return
            if path[i].tag in within:
                return

    at, size = 0, len(page)
    search = _TOKEN.search
    while at < size:
        m = search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            texts.append(text)
            linked += len(text) * in_link
        if not m:
            break
        token, at = m.group(), m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                texts.append(html.escape(token[9:-3]))
            continue
        tag = _NAME.match(token).group(1).lower()
        closing = token[1] == "/"
        if tag in RAW:
            if not closing and not (token.endswith("/>") and tag not in NOT_MARKUP):
                end = end_of(tag, at)
                # Without an end tag, text that is not markup runs to the end of the page;
                # of the others only the start tag is skipped.
                at = end if end is not None else size if tag in NOT_MARKUP else at
                if tag not in INLINE_RAW:
                    flush()
            continue
        if tag in BLOCK:
            flush()
            if closing:
                for i in range(len(path) - 1, -1, -1):
                    if path[i].tag == tag:
                        del path[i:]
                        break
                continue
            shut(("p",), ("button", "td", "th", "li", "div", "section", "article", "table"))
            if tag in _ENDS:
                shut(*_ENDS[tag])
            if tag not in VOID:
                path.append(_node(tag, token))
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "input", "img", "embed"):
            texts.append(" ")
    flush()
    return out
