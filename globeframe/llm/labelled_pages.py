"""Labelled pages to train the extractor on: drawn from a grammar of page layouts.

Each page is a list of (html, is_main) fragments; ``draw`` gives the page's html and, for
each leaf block in order, its label.  Words are made up, so that only tags, attribute
names, shape of the text and a few words of page furniture carry over to real pages.
"""

from __future__ import annotations

import random

#: Attribute words that sites commonly use, by the part they mark.
ATTRIBUTES = {
    "menu": "nav navbar navigation menu topnav main-menu breadcrumbs breadcrumb site-nav tabs toolbar skip-link pagination pager".split(),
    "header": "header site-header masthead topbar top-bar banner branding page-header logo".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal footer-links".split(),
    "sidebar": "sidebar side-bar aside widget related related-posts trending popular recommended rail toc secondary more-stories tags share social".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert modal popup overlay paywall message".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promoted ad-slot banner-ad commercial".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment comment-list comment-body responses discussion disqus_thread replies reply reader-comments feedback".split(),
    "main": "content main article post entry story body text article-body post-content entry-content main-content story-body articleBody markdown prose".split(),
}
FURNITURE = {
    "menu": "Home About Contact News Sports Next Previous Skip to content".split(),
    "header": "Welcome to our daily site Sign in Log in".split(),
    "footer": "© Copyright All rights reserved Privacy policy Terms of use Imprint Sitemap".split(),
    "sidebar": "Related articles Read more Popular Trending Share Tweet Tags Archive Follow us".split(),
    "notice": "We use cookies Accept all privacy settings consent".split(),
    "advert": "Advertisement Sponsored Buy now offer Shop sale".split(),
    "form": "Subscribe newsletter Email address Submit Search Name Password Send".split(),
    "comments": "Comments Reply says wrote Anonymous Report Like ago Leave a comment".split(),
}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro sa ti vu wo xa ye zo an er in on st nd th lich keit ción ment é ä".split()


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        n = self.r.randint(low, high)
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(n)]
        glue = " | " if self.r.random() < 0.04 else " "
        return glue.join(words).capitalize() + self.r.choice([".", ".", ".", ".", ".", ".", "!", "?", ":", "", "", " |", "***", "%"])

    def text(self, low: int = 1, high: int = 7) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        for tag in ("b", "i", "em", "span", "code"):
            if self.r.random() < 0.06:
                out += f" <{tag}>{self.word()}</{tag}> {self.sentence()}"
        if self.r.random() < 0.15:
            out += f' <a href="/{self.word()}">{self.word()} {self.word()}</a>, {self.sentence()}'
        return out + (" &amp; " + self.word() + "." if self.r.random() < 0.05 else "")

    def furniture(self, kind: str) -> str:
        if self.r.random() < 0.45:
            return " ".join(self.r.sample(FURNITURE[kind], min(len(FURNITURE[kind]), self.r.randint(1, 4)))) + (" " + self.word()) * self.r.randint(0, 2)
        return self.sentence(1, 12) if self.r.random() < 0.6 else " ".join(self.word() for _ in range(self.r.randint(1, 4)))

    def attribute(self, kind: str, chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return f' class="{self.word()}"' if self.r.random() < 0.5 else ""
        name = self.r.choice(ATTRIBUTES[kind])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"' + (f' role="{ {"menu": "navigation", "footer": "contentinfo", "header": "banner", "form": "search", "sidebar": "complementary"}[kind]}"' if kind in ("menu", "footer", "header", "form", "sidebar") and self.r.random() < 0.2 else "")

    def block(self, tag: str, text: str, label: int, end: bool = True) -> None:
        if not text.strip():
            return
        self.html.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if end else ""))
        self.labels.append(label)

    def links(self, kind: str) -> None:
        self.html.append("<ul>")
        for _ in range(self.r.randint(2, 7)):
            self.block("li", f'<a href="/{self.word()}">{self.furniture(kind)}</a>', 0)
        self.html.append("</ul>")

    def part(self, kind: str) -> None:
        """A part that is no main text."""
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "advert": "aside", "notice": "div", "comments": "section"}[kind]
        plain = self.r.random() < 0.45
        tag = self.r.choice(["div", "div", "section"]) if plain else semantic
        bare = 0.92 if plain or kind in ("notice", "comments", "advert") else 0.5
        self.html.append(f"<{tag}{self.attribute(kind, bare)}>")
        if kind == "menu":
            self.links(kind)
        elif kind == "comments":
            if self.r.random() < 0.7:
                self.block(self.r.choice(["h2", "h3"]), self.furniture(kind), 0)
            for _ in range(self.r.randint(1, 6)):
                self.html.append(f"<{(t := self.r.choice(['div', 'li', 'article']))}{self.attribute(kind, 0.8)}>")
                if self.r.random() < 0.6:
                    self.block(self.r.choice(["span", "b", "cite"]), self.word(), 0)
                    self.labels.pop()
                    self.html.append(" ")
                    self.block("p", self.text(1, 4), 0)
                    self.labels.append(0)
                else:
                    self.block("p", self.text(1, 4), 0)
                self.html.append(f"</{t}>")
        elif kind == "form":
            self.block("label", self.furniture(kind), 0)
            self.html.append('<input type="text">')
            self.labels.pop()
            self.block("button", self.furniture(kind), 0)
            self.labels.append(0)
        elif kind == "header" and self.r.random() < 0.5:
            self.block(self.r.choice(["div", "p", "h2"]), self.furniture(kind), 0)
            self.links("menu")
        elif kind in ("advert", "notice", "footer") and self.r.random() < 0.5:
            self.html.append(self.furniture(kind) if kind != "footer" else "&copy; " + self.furniture(kind))
            self.labels.append(0)
        else:
            if kind == "sidebar" and self.r.random() < 0.7:
                self.block("h3", self.furniture(kind), 0)
                self.links(kind)
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.furniture(kind) if self.r.random() < 0.6 else self.text(1, 2), 0)
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        semantic = self.r.random() < 0.65
        tag = self.r.choice(["article", "main", "article"]) if semantic else "div"
        self.html.append(f"<{tag}{self.attribute('main', 0.15 if semantic else 0.9)}>")
        inner = self.r.random() < 0.25
        if inner:
            self.html.append(f"<{(t := self.r.choice(['div', 'section']))}{self.attribute('main')}>")
        title = self.sentence(2, 9)
        if self.r.random() < 0.85:
            self.block(self.r.choice(["h1", "h1", "h2"]), title, 1)
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 5, 6, 8, 10, 12])):
            x = self.r.random()
            if x < 0.72:
                self.block("p", self.text(), 1, self.r.random() < 0.9)
            elif x < 0.78:
                self.html.append("<p>")
                self.block("b", self.r.choice([title, self.sentence(2, 9)]) + "<br>", 1, False)
                self.block("p", self.text(), 1)
            elif x < 0.84:
                self.block(self.r.choice(["h2", "h3"]), self.sentence(1, 6), 1)
            elif x < 0.88:
                self.block("blockquote", self.text(1, 2), 1)
            elif x < 0.91:
                self.html.append(f"<{(t2 := self.r.choice(['ul', 'ol']))}>")
                for _ in range(self.r.randint(2, 5)):
                    self.block("li", self.text(1, 1), 1)
                self.html.append(f"</{t2}>")
            elif x < 0.93:
                self.html.append("<table><tr>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("td", self.sentence(1, 4), 1)
                self.html.append("</tr></table>")
            elif x < 0.94:
                self.block("pre", self.sentence(2, 12), 1)
            else:
                self.part(self.r.choice(["advert", "advert", "sidebar", "form", "notice"]))
        if inner:
            self.html.append(f"</{t}>")
        if self.r.random() < 0.2:
            self.part("comments")
        self.html.append(f"</{tag}>")

    def build(self) -> tuple[str, list[int]]:
        self.html.append(f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        if wrap := self.r.random() < 0.3:
            self.html.append(f'<div class="{self.r.choice(["wrapper", "page", "container", self.word()])}">')
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.75), ("advert", 0.35), ("form", 0.15), ("sidebar", 0.2)) if self.r.random() < p]
        if self.r.random() < 0.4:
            self.r.shuffle(before)
        for kind in before:
            self.part(kind)
            if self.r.random() < 0.3:
                self.html.append(f"<!-- {self.word()} --><script>var a='</p>';</script>")
        if self.r.random() < 0.97:
            self.article()
        for kind in [k for k, p in (("advert", 0.25), ("comments", 0.45), ("sidebar", 0.4), ("form", 0.25), ("notice", 0.12), ("menu", 0.12), ("footer", 0.8)) if self.r.random() < p]:
            self.part(kind)
        self.html.append("</div></body></html>" if wrap else "</body></html>")
        return "".join(self.html), self.labels


def draw(n: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    return [Page(seed * 1_000_003 + i).build() for i in range(n)]
