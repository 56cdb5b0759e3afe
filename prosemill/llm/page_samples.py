"""Labelled pages on which the extractor is trained, made from a seed.

Layouts, element names and attribute names are drawn from what public style
guides and common site builders use; the prose is random syllables, so that
the model learns structure and shape rather than words.  Each page comes with
the texts of its main blocks.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ka lo mi ren tas vel dor pin sha que ul bar eth ion sol an er ist mar ne".split()
NAVIGATION = ("nav", "navbar", "menu", "main-menu", "top-menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "site-nav", "skip-links")
SIDE = ("sidebar", "side", "widget", "widget-area", "related", "related-posts", "recommended", "trending", "popular", "tags", "tag-cloud", "author-box", "archive", "blogroll", "secondary", "rail", "more-stories", "read-next", "see-also")
ADVERT = ("ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "sponsor", "promo", "promotion", "adsbox", "teaser", "ad-container", "affiliate", "commercial")
NOTICE = ("cookie", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "message", "warning", "disclaimer", "paywall", "announcement", "toast", "privacy-notice")
FORM = ("newsletter", "subscribe", "signup", "search", "search-form", "login", "contact-form", "subscription", "survey", "poll")
COMMENT = ("comments", "comment-list", "comment", "discussion", "replies", "responses", "respond", "disqus_thread", "reader-comments", "comment-section", "feedback", "user-comments")
SHARE = ("share", "social", "share-buttons", "social-links", "sharing", "toolbar", "actions", "meta-links")
FOOT = ("footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal", "footer-links")
HEAD = ("header", "site-header", "masthead", "top", "branding", "page-header", "logo", "topbar")
LABELS = (
    "Share this", "Share", "Follow us", "Related posts", "Related articles", "Read more", "You may also like", "Advertisement", "Sponsored", "Subscribe to our newsletter",
    "Sign up", "Log in", "Leave a comment", "Comments", "Reply", "We use cookies", "Accept all cookies", "Privacy policy", "All rights reserved", "Tags", "Categories", "Search", "Menu", "Home", "Back to top",
    "Print", "Tweet", "Next", "Previous",
)
#: Of the labels, the words that hardly stand in an article's short blocks.
LABEL_WORDS = ("share", "follow", "related", "advertisement", "sponsored", "subscribe", "newsletter", "login", "comment", "comments", "reply", "cookies", "privacy", "rights", "tags", "categories", "menu", "tweet")
BUILDER = ("elementor", "widget", "wrap", "et", "pb", "module", "fusion", "builder", "vc", "row", "column", "block", "wp", "section", "css", "element", "component", "cell")
CONTENT = ("content", "post", "entry", "article", "story", "post-content", "entry-content", "article-body", "main-content", "story-body", "text", "body", "page-content", "markdown-body", "single-post", "articleBody", "prose", "post-body", "blog-post", "news-text")
WRAP = ("wrapper", "container", "page", "row", "col", "grid", "layout", "site", "inner", "outer", "wrap", "columns")


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.words(low, high).capitalize()
        if self.r.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        return s + self.r.choice(("." * 8) + "?!")

    def prose(self, low: int = 1, high: int = 7) -> str:
        if self.r.random() < 0.06:  # tables and listings written as text
            return self.r.choice((" | ", " · ", " - ", " ### ")).join(self.words(1, 3) for _ in range(self.r.randint(3, 40)))
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def write(self, text: str, main: bool) -> str:
        if main:
            self.main.append(text)
        return html.escape(text)

    def links(self, n: int, low: int = 1, high: int = 3) -> list[str]:
        return [f'<a href="/{self.word()}">{html.escape(self.words(low, high).capitalize())}</a>' for _ in range(n)]

    def named(self, names: tuple[str, ...], tags: tuple[str, ...], inner: str) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        kind = self.r.choice(("class", "class", "class", "id"))
        if tag == "p" and "<p>" in inner or tag == "ul" and "<li>" not in inner:
            tag = "div"
        extra = self.r.choice(("", "", f"{self.r.choice(WRAP)} ", "js-")) if kind == "class" else ""
        return f'<{tag} {kind}="{extra}{name}">{inner}</{tag}>'

    def list_of(self, items: list[str]) -> str:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def menu(self) -> str:
        n = self.r.randint(3, 9)
        inner = self.list_of(self.links(n)) if self.r.random() < 0.7 else " | ".join(self.links(n))
        return f"<nav>{inner}</nav>" if self.r.random() < 0.5 else self.named(NAVIGATION, ("div", "nav", "ul", "header"), inner)

    def header(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(1, 3).title()}</h1>", f"<p>{self.sentence(3, 8)}</p>", f"<div>{self.links(1)[0]}</div>", self.words(1, 4).title()))
        if self.r.random() < 0.5:
            inner += self.menu()
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else self.named(HEAD, ("div", "header"), inner)

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; 20{self.r.randint(10, 26)} {self.words(1, 3).title()}. {self.sentence(3, 8)}", f"<p>&copy; {self.word()}.example &middot; {self.sentence(3, 10)}</p>", " &middot; ".join(self.links(4)), f"<p>{self.prose(1, 3)}</p>"))
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else self.named(FOOT, ("div", "footer", "section"), inner)

    def aside(self) -> str:
        inner = self.r.choice((f"<h3>{self.words(1, 3).title()}</h3>" + self.list_of(self.links(self.r.randint(2, 7), 3, 9)), f"<p>{self.prose(1, 4)}</p>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 3)}</p>"))
        return f"<aside>{inner}</aside>" if self.r.random() < 0.4 else self.named(SIDE, ("div", "aside", "section", "ul"), inner)

    def advert(self) -> str:
        inner = self.r.choice((self.sentence(3, 10), self.prose(1, 4), f"<p>{self.prose(1, 3)}</p>", self.links(1, 3, 8)[0], f"<h4>{self.words(2, 5)}</h4><p>{self.prose(1, 2)}</p>"))
        return self.named(ADVERT, ("div", "div", "aside", "section", "p"), inner)

    def notice(self) -> str:
        inner = self.r.choice((f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2), f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>"))
        return self.named(NOTICE, ("div", "div", "section", "p", "aside", "dialog"), inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type=text><button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.5:
            inner = f"<p>{self.sentence()}</p>" + inner
        return f"<form>{inner}</form>" if self.r.random() < 0.6 else self.named(FORM, ("div", "section", "form"), inner)

    def comments(self) -> str:
        def one() -> str:
            who = self.r.choice((f"<b>{self.word().title()}</b> ", f"<div class=author>{self.words(1, 2).title()}</div>", f"<h4>{self.word()}</h4>", ""))
            body = self.r.choice((f"<p>{self.prose(1, 5)}</p>", self.prose(1, 4), f"<p>{self.prose(1, 3)}</p><p>{self.prose(1, 3)}</p>"))
            return self.r.choice((f'<div class="comment">{who}{body}</div>', f"<li>{who}{body}</li>", f'<article class="comment">{who}{body}</article>', f'<div class="reply">{who}{body}</div>'))

        title = self.r.choice((f"<h3>{self.words(1, 3).title()}</h3>", f"<h2>{self.r.randint(1, 90)} {self.word()}</h2>", ""))
        inner = title + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.named(COMMENT, ("div", "section", "section", "ol", "ul"), inner)

    def share(self) -> str:
        label = f"<span>{self.r.choice(LABELS)}</span> " if self.r.random() < 0.5 else ""
        return self.named(SHARE, ("div", "ul", "p"), label + " ".join(self.links(self.r.randint(2, 5))))

    def label(self) -> str:
        """A short label without a telling name."""
        tag = self.r.choice(("div", "span", "p", "h3", "h4"))
        inner = f"<{tag}>{self.r.choice(LABELS)}</{tag}>"
        return f'<div class="{self.built()}">{inner}</div>' if self.r.random() < 0.6 else inner

    def built(self) -> str:
        """A class name as page builders make them."""
        return " ".join("-".join(self.r.choice(BUILDER) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.choice((1, 1, 2))))

    def linked(self, text: str) -> str:
        """The text with some of its words in links, or all of it."""
        words = text.split(" ")
        if self.r.random() < 0.4 and len(words) < 12:
            return f'<a href="/{self.word()}">{html.escape(text)}</a>'
        i = self.r.randrange(len(words))
        j = min(len(words), i + self.r.randint(1, 4))
        parts = [html.escape(" ".join(x)) for x in (words[:i], words[i:j], words[j:])]
        return " ".join(x for x in (parts[0], f'<a href="/{self.word()}">{parts[1]}</a>', parts[2]) if x)

    def kept(self, text: str, links: float) -> str:
        if self.r.random() < links:
            self.main.append(text)
            return self.linked(text)
        return self.write(text, True)

    def code(self) -> str:
        return f"<pre>{self.write(self.words(3, 20), True)}</pre>"

    def table(self) -> str:
        cells = lambda: "".join(f"<td>{self.write(self.words(1, 4), True)}</td>" for _ in range(2))
        return "<table>" + "".join(f"<tr>{cells()}</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"

    def definitions(self) -> str:
        return "<dl>" + "".join(f"<dt>{self.write(self.words(1, 3), True)}</dt><dd>{self.write(self.sentence(), True)}</dd>" for _ in range(self.r.randint(1, 3))) + "</dl>"

    def figure(self) -> str:
        return f"<figure><img src=/x.png><figcaption>{self.write(self.sentence(3, 12), True)}</figcaption></figure>"

    def body(self) -> str:
        """The main part, with things between that are none of it."""
        out, r = [], self.r
        builder = r.random() < 0.3
        if r.random() < 0.85:
            title = self.words(2, 12).capitalize() + r.choice(("", "."))
            head = f"<{(t := r.choice(('h1', 'h1', 'h2')))}>{self.write(title, True)}</{t}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        if r.random() < 0.15:
            out.append(self.share())
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.68:
                text = self.kept(self.prose(1, r.choice((1, 2, 8))), 0.25)
                form = r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><strong>{text}</strong><br>", f"<div>{text}</div>", f"<p><em>{text}</em></p>", f"<section><p>{text}</p></section>"))
                for _ in range(r.randint(1, 3) if builder else 0):
                    form = f'<div class="{self.built()}">{form}</div>'
                out.append(form)
            elif kind < 0.76:
                out.append(f"<{(t := r.choice(('h2', 'h3')))}>{self.write(self.words(1, 7).capitalize(), True)}</{t}>")
            elif kind < 0.82:
                some = r.choice((0.0, 0.0, 0.5, 1.0))
                items = [self.kept(self.sentence(1, 14).rstrip(r.choice((".", "?!"))), some) for _ in range(r.randint(2, 6))]
                out.append(self.list_of(items) if r.random() < 0.8 else "<ol>" + "".join(f"<li><p>{x}</p></li>" for x in items) + "</ol>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{self.write(self.prose(1, 3), True)}</p></blockquote>")
            elif kind < 0.89:
                out.append(r.choice((self.code, self.table, self.definitions, self.figure))())
            elif kind < 0.90:
                out.append(self.label())
            elif kind < 0.94:
                out.append(self.advert())
            elif kind < 0.96:
                out.append(self.aside())
            elif kind < 0.98:
                out.append(self.notice())
            else:
                out.append(self.form())
        inner = "".join(out)
        if self.r.random() < 0.12:
            inner += self.comments()
        tag = r.random()
        if tag < 0.5:
            return f"<article>{inner}</article>"
        if tag < 0.6:
            return f"<main>{inner}</main>"
        if tag < 0.9:
            return self.named(CONTENT, ("div", "div", "section", "article", "main"), inner)
        return f"<td>{inner}</td>" if tag < 0.93 else inner

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:  # an article by itself
            body = self.body()
            return body if r.random() < 0.5 else f"<html><body>{body}</body></html>"
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.8), (self.advert, 0.4), (self.share, 0.1), (self.form, 0.1), (self.aside, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.share, 0.15), (self.aside, 0.3), (self.comments, 0.35), (self.form, 0.2), (self.advert, 0.3), (self.menu, 0.15), (self.notice, 0.1), (self.footer, 0.8)) if r.random() < p]
        body = "".join(f() for f in before) + self.body() + "".join(f() for f in after)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(WRAP)}">{body}</div>'
        if r.random() < 0.1:
            return body
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[str]]]:
    """``n`` pages, each with the texts of its main blocks in page order."""
    out = []
    for i in range(n):
        p = _Page(seed * 1_000_003 + i)
        page = p.page()
        out.append((page, p.main))
    return out
