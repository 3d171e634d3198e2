"""Synthetic pages with known main text, on which the extraction model is trained.

A page is built as a tree of (tag, attributes, children, wanted); text children are strings.  The
templates vary wrappers, class names, the place of boilerplate, unclosed tags and lengths; some
have no wrapper, one without a telling name, or a table, so that the model learns roles rather than
one layout.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber con der el fin gra hol in jor kel lum men nor os par qui res sol tan ur ven wil xe yor zu".split()
GOOD_WRAPPERS = (("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body entry"'), ("section", 'class="story"'), ("div", 'class="article-text"'), ("article", 'class="post"'))
SHELLS = (("div", 'id="page"'), ("div", 'class="wrapper"'), ("div", 'class="container"'), ("div", ""), ("main", ""))
NOISE = {
    "menu": (("nav", ""), ("nav", 'class="main-menu"'), ("div", 'id="menu"'), ("ul", 'class="navigation"'), ("div", 'class="breadcrumbs"')),
    "header": (("header", ""), ("div", 'id="header"'), ("div", 'class="site-header masthead"')),
    "footer": (("footer", ""), ("div", 'id="footer"'), ("div", 'class="footer-links"')),
    "sidebar": (("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="right-rail" class="widget"'), ("div", 'class="related"')),
    "notice": (("div", 'class="cookie-notice"'), ("div", 'id="consent-banner" role="dialog"'), ("div", 'class="notice"'), ("section", 'class="alert message"')),
    "advert": (("div", 'class="ad"'), ("div", 'class="advert promo"'), ("aside", 'class="sponsored"'), ("div", 'id="ad-slot-3"'), ("ins", 'class="adsbygoogle"')),
    "form": (("form", 'action="/go"'), ("form", 'class="newsletter"'), ("div", 'class="subscribe-form"')),
    "comments": (("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="reader-comments discussion"')),
    "share": (("div", 'class="share social"'), ("ul", 'class="share-links"')),
}

Node = tuple[str, str, list, bool]


class Pages:
    """A seeded source of pages; `page()` gives markup and the tree it came from."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def sentence(self, least: int = 3, most: int = 18) -> str:
        return self.words(least, most).capitalize() + self.r.choice(".....!?")

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def label(self) -> str:
        """A short text with or without a capital and a mark."""
        text = self.words(1, self.r.choice((1, 1, 3, 8)))
        return (text.capitalize() if self.r.random() < 0.5 else text) + self.r.choice(("", "", ",", ".", "!", "..."))

    def links(self, n: int, good: bool = False) -> list:
        return [("li", "", [("a", f'href="/{self.words(1, 1)}"', [self.label()], good)], good) for _ in range(n)]

    def noise(self, kind: str) -> Node:
        r = self.r
        tag, attrs = r.choice(NOISE[kind])
        if kind in ("menu", "share"):
            body = self.links(r.randint(3, 10)) if tag == "ul" else [("ul", "", self.links(r.randint(3, 10)), False)]
        elif kind == "header":
            body = [("a", 'href="/"', [self.words(1, 3)], False), ("p", 'class="tagline"', [self.words(2, 8)], False)]
            if r.random() < 0.4:
                body.append(self.noise("menu"))
        elif kind == "footer":
            body = [r.choice(("© ", "Copyright ", "")) + self.words(1, 3) + r.choice((" · ", " | ", " ")) + self.sentence()]
            if r.random() < 0.4:
                body.append(("ul", "", self.links(r.randint(2, 6)), False))
        elif kind == "sidebar":
            body = [("h3", "", [self.words(1, 4)], False), ("ul", "", self.links(r.randint(3, 8)), False)] if r.random() < 0.6 else [("p", "", [self.prose(3)], False)]
        elif kind == "form":
            body = [("label", "", [self.words(1, 4)], False), ("input", 'type="text" name="q"', [], False), ("button", "", [self.words(1, 2)], False)]
        elif kind == "comments":
            item = "li" if tag == "ol" else "div"
            body = [(item, 'class="comment"', [("b", "", [self.words(1, 2)], False), ("p", "", [self.prose(4)], False)], False) for _ in range(r.randint(1, 6))]
        elif r.random() < 0.5:
            body = [self.prose(3)]
        else:
            body = [("p", "", [self.prose(2)], False), ("a", 'href="/more"', [self.words(1, 3)], False)]
        return (tag, attrs, body, False)

    def paragraph(self) -> Node:
        r = self.r
        if r.random() < 0.25:
            return ("p", "", [self.label()], True)
        text = self.prose(r.choice((1, 3, 9)))
        if r.random() < 0.25:
            cut = text.rfind(" ", 0, max(2, len(text) // 2))
            if r.random() < 0.3:
                formula: Node = ("math", "", [(t, "", [x], True) for t, x in (("mi", self.words(1, 1)[0]), ("mo", r.choice("=+-")), ("mn", str(r.randint(0, 99))))], True)
                return ("p", "", [text[: cut + 1], formula if r.random() < 0.5 else (r.choice(("code", "sub", "kbd", "q")), "", [self.words(1, 1)], True), text[cut:]], True)
            inline = (r.choice(("b", "em", "i", "strong", "span")), "", [text[cut + 1 :]], True) if r.random() < 0.6 else ("a", 'href="/x"', [text[cut + 1 :]], True)
            return ("p", "", [text[: cut + 1], inline], True)
        if r.random() < 0.2:
            return ("p", "", [("b", "", [text, ("br", "", [], True)], True)], True)
        return ("p", "", [text], True)

    def wrapped(self, body: list) -> list:
        """The main text in an element that says so, in one that does not, in a cell of a table, or in none."""
        r, x = self.r, self.r.random()
        if x < 0.55:
            return [(*r.choice(GOOD_WRAPPERS), body, True)]
        if x < 0.7:
            return [("div", "", body, True)]
        if x < 0.8:
            return [(r.choice(("div", "section")), f'class="{r.choice(("css-", "sc-", "x", ""))}{r.getrandbits(28):x}"', body, True)]
        if x < 0.9:
            return body
        cells: list = [("td", "", body, True)]
        if r.random() < 0.6:
            cells.insert(r.randint(0, 1), ("td", "", [self.noise(r.choice(("menu", "sidebar")))], False))
        return [("table", r.choice(("", 'width="100%"')), [("tr", "", cells, True)], True)]

    def main_text(self) -> list:
        r = self.r
        body: list = [(r.choice(("h1", "h1", "h2")), "", [self.words(2, 10)], True)] if r.random() < 0.9 else []
        for _ in range(r.choice((0, 1, 1, 2, 4, 8, 16))):
            x = r.random()
            if x < 0.75:
                body.append(self.paragraph())
            elif x < 0.8:
                body.append((r.choice(("h2", "h3")), "", [self.words(2, 6)], True))
            elif x < 0.87:
                body.append((r.choice(("ul", "ol")), "", [("li", "", [self.prose(2)], True) for _ in range(r.randint(2, 6))], True))
            elif x < 0.91:
                body.append(("blockquote", "", [self.paragraph()], True))
            elif x < 0.95:
                body.append(("table", "", [("tr", "", [("td", "", [self.words(1, 4)], True) for _ in range(3)], True) for _ in range(r.randint(1, 4))], True))
            else:
                body.append(("pre", "", [self.words(4, 20)], True))
        if len(body) < 2:
            body.append(self.paragraph())
        for kind in ("advert", "share", "form", "sidebar"):
            if r.random() < 0.12:
                body.insert(r.randint(1, len(body)), self.noise(kind))
        if r.random() < 0.15:
            body.append(self.noise("comments"))
        return self.wrapped(body)

    def body(self) -> Node:
        r = self.r
        before = [self.noise(k) for k in ("notice", "header", "menu", "advert") if r.random() < 0.55]
        after = [self.noise(k) for k in ("share", "comments", "sidebar", "form", "advert", "footer") if r.random() < 0.4]
        if r.random() < 0.5:
            r.shuffle(before)
        if r.random() < 0.08:
            before.append(self.words(1, 4))
        middle: list = self.main_text()
        while r.random() < 0.35:
            tag, attrs = r.choice(SHELLS)
            if r.random() < 0.3:
                middle.append(self.noise(r.choice(("sidebar", "comments", "advert"))))
            middle = [(tag, attrs, middle, True)]
        return ("body", "", [*before, *middle, *after], True)

    def render(self, node: Node | str, keep: list[str]) -> str:
        """Markup; the texts that are wanted go to `keep` in order."""
        if isinstance(node, str):
            return node.replace("&", "&amp;").replace("<", "&lt;")
        tag, attrs, children, _ = node
        inner = "".join(self.render(c, keep) for c in children)
        opened = f"<{tag}{' ' + attrs if attrs else ''}>"
        if tag in ("br", "input") or (tag in ("p", "li", "b") and self.r.random() < 0.05):
            return opened + inner
        return f"{opened}{inner}</{tag}>"

    def page(self) -> tuple[str, Node]:
        tree = self.body()
        head = f"<head><title>{self.words(2, 8)}</title><script>var a='<p>';</script></head>" if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}{self.render(tree, [])}</html>", tree
