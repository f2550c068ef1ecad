"""Pages in random layouts with their main text: what the extractor is trained on.

A page is a main part of headings, paragraphs, lists, quotes and tables, in a container with a telling name or none, among menus,
headers, adverts, notices, sidebars, forms, comments and footers, some of which stand inside the main part. Words are random
syllables, so that nothing depends on a language; short texts of the other parts also use the usual words of such parts.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an en er in on re st th ti le la de es or ou el au ei sch ch ing tion ment ción ß é ñ ka mo ri su ta вы на по ти".split()
COMMON = "the of and to a in is that it with for on this we you your use more read by about at all have from was are be as or new one up out time now here".split()

# fixed values: usual names of the parts of a page
NAMES = {
    "main": "content article-body post entry-content story main-content article post-content text body-copy blog-post entry page-content article__body".split(),
    "menu": "menu nav navbar main-nav topnav breadcrumb breadcrumbs site-nav nav-links tabs pagination".split(),
    "header": "header site-header masthead top-bar banner logo branding page-header".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored promo adsbygoogle banner-ad ad-container".split(),
    "notice": "cookie cookie-banner notice consent gdpr alert newsletter-popup modal disclaimer cookie-notice".split(),
    "side": "sidebar aside related related-posts widget trending recommended most-read side-column more-stories".split(),
    "form": "search-form login signup newsletter subscribe contact-form form".split(),
    "comments": "comments comment-list comment responses discussion replies reader-comments disqus".split(),
    "footer": "footer site-footer copyright foot bottom legal footer-links colophon".split(),
    "share": "share social share-buttons social-links follow toolbar".split(),
}
TAGS = {"main": ("article", "main", "section", "div", "div", "div"), "menu": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "ad": ("div", "div", "aside", "section"), "notice": ("div", "div", "section", "dialog"), "side": ("aside", "aside", "div", "section"), "form": ("form",), "comments": ("section", "div", "div"), "footer": ("footer", "footer", "div"), "share": ("div", "ul", "nav")}
USUAL = {
    "menu": "home about contact news sport shop blog login archive help sitemap categories next previous".split(),
    "header": "welcome to the official site of search menu skip to content".split(),
    "ad": "advertisement sponsored buy now sale off free shipping order today click here learn more".split(),
    "notice": "we use cookies to improve your experience accept privacy policy settings this site uses cookies".split(),
    "side": "related stories read more most popular trending you may also like".split(),
    "form": "email address name password search submit subscribe send sign up log in".split(),
    "comments": "reply says comment posted on ago likes report".split(),
    "footer": "copyright all rights reserved terms privacy imprint powered by contact".split(),
    "share": "share tweet facebook email print like follow us".split(),
}


class Page:
    """One page as it is written: markup on one side, lines of the main text on the other."""

    def __init__(self, rng: random.Random):
        self.r, self.out, self.main = rng, [], []
        self.named = rng.random() < 0.75  # telling names of classes
        self.telling = rng.random() < 0.75  # telling elements
        self.tidy = rng.random() < 0.8

    def word(self) -> str:
        if self.r.random() < 0.25:
            return self.r.choice(COMMON)
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(n)]
        for k in range(2, n - 1):
            if self.r.random() < 0.08:
                words[k] += ","
        return words[0].capitalize() + (" " if n > 1 else "") + " ".join(words[1:]) + self.r.choice("....?!")

    def sentences(self, most: int) -> str:
        return " ".join(self.sentence(self.r.choice((1, 3, 6, 10, 16, 24))) for _ in range(self.r.randint(1, most)))

    def inline(self, text: str) -> str:
        """Text as markup: some words linked or stressed, some white space broken."""
        words = html.escape(text, quote=False).split(" ")
        for k in range(len(words)):
            x = self.r.random()
            if x < 0.01:
                words[k] = f'<a href="/{k}">{words[k]}</a>'
            elif x < 0.02:
                words[k] = f"<b>{words[k]}</b>"
            elif x < 0.03:
                words[k] = f"{words[k]}\n  "
        return " ".join(words)

    def put(self, tag: str, text: str, main: bool) -> None:
        """A leaf, sometimes left open as browsers allow."""
        end = "" if tag in ("p", "li") and not self.tidy and self.r.random() < 0.5 else f"</{tag}>"
        self.out.append(f"<{tag}>{self.inline(text)}{end}\n")
        if main:
            self.main.append(text)

    def open(self, part: str) -> str:
        tag = self.r.choice(TAGS[part]) if self.telling or part == "form" else "div"
        name = f" {self.r.choice(('class', 'class', 'id'))}=\"{self.r.choice(NAMES[part])}\"" if self.named or (not self.telling and self.r.random() < 0.5) else ""
        self.out.append(f"<{tag}{name}>")
        return tag

    def short(self, part: str, n: int) -> str:
        usual = self.r.random() < 0.6
        words = [self.r.choice(USUAL[part]) if usual and part in USUAL else self.word() for _ in range(n)]
        return " ".join(words).capitalize()

    def links(self, part: str, n: int) -> None:
        listed = self.r.random() < 0.7
        if listed:
            self.out.append("<ul>")
        for _ in range(n):
            a = f'<a href="/{self.word()}">{self.short(part, self.r.randint(1, 6 if part == "side" else 2))}</a>'
            self.out.append(f"<li>{a}</li>" if listed else self.r.choice((a + " | ", f"<div>{a}</div>")))
        if listed:
            self.out.append("</ul>")

    def other(self, part: str) -> None:
        tag = self.open(part)
        r = self.r
        if part in ("menu", "share"):
            self.links(part, r.randint(2, 9))
        elif part == "header":
            self.put(r.choice(("div", "h1", "p", "h2")), self.short("header", r.randint(1, 5)), False)
            if r.random() < 0.4:
                self.links("menu", r.randint(2, 6))
        elif part in ("ad", "notice"):
            for _ in range(r.choice((1, 1, 1, 2))):
                text = self.sentences(3) if r.random() < 0.6 else self.short(part, r.randint(2, 14)) + "."
                if r.random() < 0.5:
                    self.out.append(self.inline(text))
                else:
                    self.put(r.choice(("p", "div", "h3")), text, False)
            if part == "notice":
                self.out.append("<button>OK</button>")
        elif part == "side":
            self.put(r.choice(("h2", "h3", "h4")), self.short("side", r.randint(1, 4)), False)
            self.links("side", r.randint(2, 8))
            if r.random() < 0.4:
                self.put("p", self.sentences(2), False)
        elif part == "form":
            for _ in range(r.randint(1, 3)):
                self.out.append(f"<label>{self.short('form', r.randint(1, 3))}</label><input name=x>")
            if r.random() < 0.5:
                self.put("p", self.sentences(1), False)
            self.out.append("<button>" + self.short("form", 1) + "</button>")
        elif part == "comments":
            self.put(r.choice(("h2", "h3")), self.short("comments", 2), False)
            for _ in range(r.randint(1, 6)):
                opened, closed = r.choice((('<div class="comment">', "</div>"), ("<li>", "</li>"), ("<div>", "</div>"), ('<article class="comment">', "</article>")))
                self.out.append(opened)
                self.put(r.choice(("b", "div", "h4")), f"{self.word().capitalize()} {self.short('comments', 2)} {r.randint(1, 28)}", False)
                for _ in range(r.choice((1, 1, 2))):
                    self.put("p", self.sentences(4), False)
                self.out.append(closed)
        elif part == "footer":
            self.out.append(r.choice(("&copy; ", "Copyright &copy; 2024 ", "&copy; 2023&nbsp;&middot; ", "")) + self.inline(f"{self.word()}.example.{r.choice(('com', 'org', 'net'))} " + (self.sentences(1) if r.random() < 0.6 else self.short("footer", 4))))
            if r.random() < 0.5:
                self.links("footer", r.randint(2, 6))
        self.out.append(f"</{tag}>\n")

    def content(self) -> None:
        r, tag = self.r, self.open("main")
        if r.random() < 0.8:
            self.put(r.choice(("h1", "h1", "h2")), " ".join(self.word() for _ in range(r.randint(1, 12))).capitalize(), True)
        for _ in range(r.choice((1, 2, 4, 8, 14, 20))):
            x = r.random()
            if x < 0.7:
                self.put("p", self.sentences(r.choice((1, 1, 3, 6, 12))), True)
            elif x < 0.78:
                self.put(r.choice(("h2", "h3")), " ".join(self.word() for _ in range(r.randint(1, 8))).capitalize(), True)
            elif x < 0.84:
                kind = r.choice(("ul", "ol"))
                self.out.append(f"<{kind}>")
                for _ in range(r.randint(2, 6)):
                    self.put("li", self.sentences(1) if r.random() < 0.6 else self.short("none", r.randint(1, 6)), True)
                self.out.append(f"</{kind}>")
            elif x < 0.88:
                self.out.append("<blockquote>")
                self.put("p", self.sentences(3), True)
                self.out.append("</blockquote>")
            elif x < 0.91:
                self.out.append("<table>")
                for _ in range(r.randint(1, 4)):
                    self.out.append("<tr>")
                    for _ in range(r.randint(2, 4)):
                        self.put("td", self.short("none", r.randint(1, 3)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif x < 0.94:
                self.out.append("<p>" + ("<b>" if r.random() < 0.5 else ""))
                self.main.append(self.sentence(r.randint(3, 30)))
                self.out.append(self.inline(self.main[-1]) + "<br>")
            elif x < 0.97:
                self.other(r.choice(("ad", "side", "share", "form")))
            else:
                self.out.append("<script>var x = '<p>no</p>';</script>")
        self.out.append(f"</{tag}>\n")


def page(rng: random.Random) -> tuple[str, str]:
    """(html, main text) of one page."""
    p = Page(rng)
    chance = lambda x: rng.random() < x
    p.out.append(f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{html.escape(p.sentence(4))}</title><style>p{{margin:0}}</style></head><body>')
    before = [x for x, c in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("form", 0.2), ("menu", 0.2), ("ad", 0.5), ("share", 0.2), ("side", 0.15)) if chance(c)]
    after = [x for x, c in (("share", 0.3), ("ad", 0.3), ("side", 0.4), ("comments", 0.35), ("form", 0.3), ("menu", 0.2), ("footer", 0.85), ("notice", 0.15)) if chance(c)]
    if chance(0.2):
        rng.shuffle(before)
    wrapped = chance(0.4)
    if wrapped:
        p.out.append(f'<div class="{rng.choice(("wrapper", "container", "page", "site", "row"))}">')
    for x in before:
        p.other(x)
        if chance(0.1):
            p.out.append("<!-- <p>note</p> -->")
    if not chance(0.03):
        p.content()
    for x in after:
        p.other(x)
    if wrapped:
        p.out.append("</div>")
    if chance(0.85):
        p.out.append("</body></html>")
    return "".join(p.out), "\n".join(p.main)
