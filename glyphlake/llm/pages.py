"""Labelled web pages for training and testing main-text extraction.

Pages are laid out from a seed: invented words in invented templates, whose every block is known to be article or not.
"""

from __future__ import annotations

import html
import random

_PARTS = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ñ", "ü", "ß", "ción", "ung", "eau")
_MENU = ("nav", "menu", "navbar", "topbar", "site-header", "header", "masthead", "breadcrumb", "breadcrumbs", "toolbar", "main-nav", "navigation")
_FOOT = ("footer", "site-footer", "copyright", "legal", "bottom", "colophon", "foot")
_SIDE = ("sidebar", "aside", "side", "widget", "related", "recommended", "rail", "more-stories", "popular", "trending")
_AD = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsbox", "promotion", "ad-slot")
_NOTE = ("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "notification", "warning", "cookie-banner")
_TALK = ("comments", "comment", "comment-list", "replies", "disqus", "discussion", "responses", "reader-comments", "comment-body", "reply")
_FORM = ("newsletter", "subscribe", "signup", "search", "login", "form", "contact", "search-form")
_SHARE = ("share", "social", "sharing", "tags", "meta", "byline-links", "tools")
_BODY = ("content", "post", "entry-content", "article-body", "story", "main-text", "text", "body", "post-content", "article", "entry", "story-body", "page-content", "post-body")


class Page:
    """One page from a seed: html, and blocks as (text, is it of the article)."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.out: list[str] = []
        self.blocks: list[tuple[str, int]] = []
        self._page()
        self.html = "".join(self.out)

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        w = ["".join(r.choice(_PARTS) for _ in range(r.choice((1, 1, 2, 2, 2, 3, 4)))) for _ in range(r.randint(lo, hi))]
        if r.random() < 0.06:
            w = [x + r.choice(("###", "%%%", "&&&", "$$$", "***")) for x in w]
        elif r.random() < 0.05:
            w = [x.upper() + "!!" for x in w]
        text = " ".join(w)
        return text[:1].upper() + text[1:]

    def prose(self, lo: int = 3, hi: int = 90) -> str:
        n, out = self.rng.randint(lo, hi), []
        while n > 0:
            k = min(n, self.rng.randint(1, 16))
            out.append(self.words(k, k) + self.rng.choice((".", ".", ".", ".", "?", "", ",")))
            n -= k
        return " ".join(out)

    def put(self, tag: str, text: str, label: int, inside: str = "", close: bool = True, attrs: str = "") -> None:
        """A block of one element; inside: an inline element around some of it."""
        body = html.escape(text, quote=False)
        if inside:
            cut = body.find(" ", self.rng.randrange(len(body) + 1))
            cut = len(body) if cut < 0 or inside == "whole" else cut
            kind = "a" if inside == "whole" else inside
            body = f'<{kind}{" href=/x" if kind == "a" else ""}>{body[:cut]}</{kind}>{body[cut:]}'
        self.out.append(f"<{tag}{attrs}>{body}" + (f"</{tag}>" if close else ""))
        self.blocks.append((" ".join(text.split()), label))

    def name(self, kinds: tuple) -> str:
        n = self.rng.choice(kinds)
        return self.rng.choice((f' class="{n}"', f' id="{n}"', f' class="{self.words(1, 1).lower()} {n}"', f' class="{n} x-{n}"'))

    def links(self, kinds: tuple, tag: str) -> None:
        r = self.rng
        self.out.append(f"<{tag}{self.name(kinds) if r.random() < 0.7 or tag == 'div' else ''}>")
        if r.random() < 0.25:
            self.put(r.choice(("h3", "h4", "h2")), self.words(1, 4), 0)
        if r.random() < 0.75:
            self.out.append("<ul>")
            for _ in range(r.randint(2, 9)):
                self.put("li", self.words(1, 5 if tag != "aside" else 10), 0, "whole")
            self.out.append("</ul>")
        else:
            for _ in range(r.randint(1, 4)):
                self.put(r.choice(("div", "p")), self.words(1, 6), 0, "whole")
        self.out.append(f"</{tag}>")

    def plain(self, kinds: tuple, tag: str, lo: int, hi: int, most: int = 2) -> None:
        self.out.append(f"<{tag}{self.name(kinds) if tag == 'div' or self.rng.random() < 0.5 else ''}>")
        inner = self.rng.choice(("p", "div", "span"))
        if inner == "span":
            self.put("p", self.prose(lo, hi), 0)
        else:
            for _ in range(self.rng.randint(1, most)):
                self.put(inner, self.prose(lo, hi), 0, self.rng.choice(("", "", "a", "b")))
        self.out.append(f"</{tag}>")

    def bare(self, kinds: tuple, tag: str, lo: int, hi: int) -> None:
        self.put(tag, self.prose(lo, hi), 0, attrs=self.name(kinds) if tag in ("div", "section", "p") else "")

    def form(self) -> None:
        self.out.append(f"<form{self.name(_FORM)}>")
        for _ in range(self.rng.randint(1, 3)):
            self.put(self.rng.choice(("p", "div", "div")), self.words(1, 8), 0)
            self.out.append('<input type="text" name="q">')
        self.out.append("</form>")

    def talk(self) -> None:
        tag = self.rng.choice(("div", "section", "ul"))
        self.out.append(f"<{tag}{self.name(_TALK)}>")
        if tag != "ul" and self.rng.random() < 0.7:
            self.put("h3", self.words(1, 3), 0)
        for _ in range(self.rng.randint(1, 5)):
            one = "li" if tag == "ul" else self.rng.choice(("div", "article")) if self.rng.random() < 0.85 else ""
            self.out.append(f"<{one}{self.name(_TALK) if self.rng.random() < 0.6 else ''}>" if one else "")
            self.put("p", self.prose(2, 60), 0, self.rng.choice(("", "", "a", "i")))
            self.out.append(f"</{one}>" if one else "")
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.rng
        kind = r.random()
        tag = "article" if kind < 0.5 else "main" if kind < 0.6 else r.choice(("div", "section"))
        self.out.append(f"<{tag}{self.name(_BODY) if tag in ('div', 'section') or r.random() < 0.3 else ''}>")
        inner = r.random() < 0.25
        if r.random() < 0.85:
            self.put("h1", self.words(2, 12), 1)
        if inner:
            self.out.append(f"<div{self.name(_BODY)}>")
        for _ in range(r.choice((0, 1, 2, 3, 4, 5, 8, 12, 18))):
            x = r.random()
            if x < 0.7:
                self.put("p", self.prose(1, 110), 1, r.choice(("", "", "", "a", "b", "i", "em")), close=r.random() < 0.9)
            elif x < 0.8:
                text = self.prose(2, 60)
                self.out.append(f"<p><b>{html.escape(text, quote=False)}<br>")
                self.blocks.append((" ".join(text.split()), 1))
            elif x < 0.86:
                self.put(r.choice(("h2", "h3")), self.words(1, 8), 1)
            elif x < 0.9:
                self.out.append("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.put("li", self.prose(2, 20), 1)
                self.out.append("</ul>")
            elif x < 0.94:
                self.out.append("<blockquote>")
                self.put("p", self.prose(4, 40), 1)
                self.out.append("</blockquote>")
            elif x < 0.96:
                self.plain(_AD, "div", 2, 12, 1)
            elif x < 0.97:
                self.links(_SHARE, "div")
            else:
                self.put("p", self.prose(2, 30), 1)
        if inner:
            self.out.append("</div>")
        self.out.append(f"</{tag}>")

    def _page(self) -> None:
        r = self.rng
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        if r.random() < 0.3:
            self.plain(_NOTE, "div", 3, 25)
        for _ in range(r.randint(0, 2)):
            x = r.random()
            if x < 0.5:
                self.links(_MENU, "nav")
            elif x < 0.7:
                self.links(_MENU, "div")
            else:
                self.plain(_MENU, "header", 1, 6)
        self.out.append(r.choice(("", f"<!-- ad {r.randrange(99)} -->")))
        if r.random() < 0.6:
            self.bare(_AD, "div", 2, 14)
        if r.random() < 0.3:
            self.links(_SIDE, r.choice(("aside", "div")))
        wrap = r.random() < 0.3
        self.out.append(f'<div{r.choice((" id=page", " class=wrapper", " class=container", ""))}>' if wrap else "")
        self.article()
        after = [lambda: self.links(_SIDE, r.choice(("aside", "div"))), self.talk, self.form, lambda: self.bare(_AD, "div", 2, 14), lambda: self.links(_SHARE, "div"), lambda: self.plain(_SIDE, "aside", 3, 30), lambda: self.plain(_NOTE, "div", 3, 25), lambda: self.bare(_NOTE, r.choice(("div", "section")), 3, 25)]
        for f in r.sample(after, r.randint(0, 4)):
            f()
        self.out.append("</div>" if wrap else "")
        x = r.random()
        if x < 0.6:
            text = "© " + self.words(1, 3) + " · " + self.prose(2, 16)
            self.put("footer", text, 0)
        elif x < 0.75:
            self.links(_FOOT, "footer")
        elif x < 0.9:
            self.bare(_FOOT, "div", 2, 14)
        self.out.append(r.choice(("</body></html>", "</body></html>", "")))
