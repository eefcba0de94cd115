"""Labelled pages for the HTML extractor: layouts written by hand, filled with invented words.

A page is a list of (html, parts); each part is the text of one leaf block and whether it
belongs to the article. The layouts cover the usual ways to mark menus, headers, footers,
sidebars, notices, adverts, forms and comments, and articles with or without helpful tags.
"""

from __future__ import annotations

import random

Page = tuple[str, list[tuple[str, bool]]]

ARTICLE_BOXES = ("<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<div class="entry-content">', '<div class="article-text">', '<section class="story">', '<div id="main"><div class="text">', "<div>", "<table><tr><td>", '<div role="main">')
MENUS = ("<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<div class="breadcrumbs">', '<div class="topbar">', '<div role="navigation">')
HEADERS = ("<header>", '<div id="header">', '<div class="masthead">', '<div class="site-header">')
FOOTERS = ("<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="legal">')
SIDEBARS = ("<aside>", '<div class="sidebar">', '<div id="right-column">', '<div class="widget">', '<div class="related">')
NOTICES = ('<div class="cookie-notice">', '<div class="notice">', '<div class="alert">', '<div id="banner">', '<p class="consent">', '<div class="popup">', '<div role="alert">')
ADVERTS = ('<div class="ad">', '<div class="advert">', '<div class="ads">', '<div id="sponsored">', '<div class="promo">', '<ins class="adsbygoogle">')
COMMENTS = ('<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="comment">', '<div id="disqus_thread">', '<article class="comment">', '<div class="responses">', '<div class="reply">')
FORMS = ("<form>", '<form class="search">', '<form id="newsletter">', '<form action="/login">')
SYLLABLES = "an be cor del en fi gra hu in jo ka lem mo nu or pel qua ri sta tu ul ver wi xe yo za ch sh th ing er".split()


def _closing(opening: str) -> str:
    tags = [p.split()[0].strip("<>") for p in opening.replace("><", "> <").split(" <")]
    tags = [t.lstrip("<") for t in tags]
    return "".join(f"</{t}>" for t in reversed(tags))


class _Writer:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.parts: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(f"{self.words(3, 16).capitalize()}{self.rng.choice(['.', '.', '.', '?', '!'])}" for _ in range(self.rng.randint(low, high)))

    def block(self, tag: str, text: str, main: bool, link: bool = False) -> str:
        self.parts.append((text, main))
        inner = f'<a href="/{self.word()}">{text}</a>' if link else text
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def inline(self, text: str) -> str:
        if self.rng.random() < 0.7 or " " not in text:
            return text
        head, tail = text.split(" ", 1)
        tag = self.rng.choice(["b", "i", "em", "strong", "span", "a href='/x'"])
        return f"<{tag}>{head}</{tag.split()[0]}> {tail}"

    def boxed(self, opening: str, make) -> str:  # noqa: ANN001
        return opening + make() + _closing(opening)

    def menu(self) -> str:
        items = [self.rng.random() < 0.8 for _ in range(self.rng.randint(2, 8))]
        opening = self.rng.choice(MENUS)
        lis = "".join(self.block("li", self.words(1, 2), False, link) for link in items)
        return self.boxed(opening, lambda: lis if opening.startswith("<ul") else f"<ul>{lis}</ul>")

    def loose(self, opening: str, low: int = 1, high: int = 3) -> str:
        """Boilerplate that reads like prose."""
        tag = "li" if opening.startswith("<ol") else self.rng.choice(["p", "div", "span", "p"])
        if opening.startswith("<p") or tag == "span" or self.rng.random() < 0.3:
            text = self.sentences(1, 2)
            self.parts.append((text, False))
            return opening + text + _closing(opening)
        return self.boxed(opening, lambda: "".join(self.block(tag, self.sentences(1, self.rng.choice([1, 2, 5])), False, self.rng.random() < 0.2) for _ in range(self.rng.randint(low, high))))

    def form(self) -> str:
        return self.boxed(self.rng.choice(FORMS), lambda: self.block("label", self.words(1, 4), False) + '<input name="q">' + self.block("button", self.words(1, 2), False))

    def footer(self) -> str:
        text = self.rng.choice(["© ", "&copy; ", "Copyright "]) + self.words(1, 3) + " · " + self.sentences(1, 2)
        self.parts.append((text, False))
        opening = self.rng.choice(FOOTERS)
        return opening + text + _closing(opening)

    def article(self) -> str:
        rng = self.rng
        out = [self.block("h1", self.words(2, 10).capitalize(), True)] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 4, 8, 14])):
            kind = rng.random()
            if kind < 0.70:
                text = self.sentences(1, rng.choice([1, 2, 6, 12]))
                self.parts.append((text, True))
                out.append(f"<p>{self.inline(text)}</p>")
            elif kind < 0.78:
                out.append(self.block(rng.choice(["h2", "h3"]), self.words(1, 7).capitalize(), True))
            elif kind < 0.85:
                out.append("<ul>" + "".join(self.block("li", self.words(2, 12), True) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                out.append(self.block(rng.choice(["blockquote", "pre", "figcaption"]), self.sentences(1, 2), True))
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr>{self.block('td', self.words(1, 3), True)}{self.block('td', str(rng.randint(1, 999)), True)}</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            else:
                out.append(rng.choice([lambda: self.loose(rng.choice(ADVERTS), 1, 1), lambda: self.loose(rng.choice(SIDEBARS), 1, 2), self.form])())
        return "".join(out)

    def page(self) -> Page:
        rng = self.rng
        out = ["<!DOCTYPE html><html><head><title>", self.words(2, 8), "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"]
        if rng.random() < 0.5:
            out.append(self.boxed(rng.choice(HEADERS), lambda: self.block(rng.choice(["div", "h2", "p"]), self.words(1, 4), False) + (self.menu() if rng.random() < 0.4 else "")))
        if rng.random() < 0.75:
            out.append(self.menu())
        for group, chance in ((NOTICES, 0.3), (ADVERTS, 0.5), (SIDEBARS, 0.2)):
            if rng.random() < chance:
                out.append(self.loose(rng.choice(group)))
        if rng.random() < 0.15:
            out.append(self.form())
        opening = rng.choice(ARTICLE_BOXES)
        out.append(self.boxed(opening, self.article))
        for group, chance in ((COMMENTS, 0.4), (SIDEBARS, 0.35), (ADVERTS, 0.25), (NOTICES, 0.1)):
            if rng.random() < chance:
                out.append(self.loose(rng.choice(group), 1, 4))
        if rng.random() < 0.15:
            out.append(self.form())
        if rng.random() < 0.8:
            out.append(self.footer())
        return "".join(out) + "</body></html>", self.parts


def pages(n: int, seed: int = 1) -> list[Page]:
    """``n`` labelled pages."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
