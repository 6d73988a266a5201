"""Labelled pages to train the extraction on.

Pages are put together from the usual parts of an article's page, in several ways of
marking them up. `data-content` says of each part whether it is the article.
"""

from __future__ import annotations

import random

#: Pages that are made.
COUNT = 160


class _Maker:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.syllables = ["".join(self.rnd.choice(("bcdfglmnprstv", "aeiou")[j % 2]) for j in range(self.rnd.randint(1, 4))) for _ in range(90)]

    def pick(self, *options: str) -> str:
        return self.rnd.choice(options)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rnd.choices(self.syllables, k=self.rnd.randint(1, 4))) for _ in range(self.rnd.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + self.pick(".", ".", ".", "?", "!") for _ in range(self.rnd.randint(low, high)))

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.rnd.randint(low, high)))

    def paragraph(self) -> str:
        kind = self.rnd.random()
        body = self.sentences(1, 6) if kind < 0.8 else self.words(1, 6)
        if kind < 0.15:
            body = f"<b>{body}<br>"
        elif kind < 0.3:
            body += f' <a href="/{self.words(1, 1)}">{self.words(1, 3)}</a> {self.sentences(1, 2)}'
        return f"<p>{body}" + self.pick("</p>", "</p>", "")

    def block(self) -> str:
        kind = self.rnd.random()
        if kind < 0.72:
            return self.paragraph()
        if kind < 0.8:
            return f"<{(h := self.pick('h2', 'h3', 'h4'))}>{self.words(1, 7)}</{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.pick(self.words(2, 6), self.sentences(1, 2))}</li>" for _ in range(self.rnd.randint(2, 5))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{self.pick('<p>', '')}{self.sentences(1, 3)}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rnd.randint(2, 4))) + "</table>"
        if kind < 0.98:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<div>{self.sentences(1, 4)}</div>"

    def article(self) -> str:
        inside = self.pick(f"<h1>{self.words(2, 9)}</h1>", f"<h1>{self.words(2, 9)}</h1>", "") + "".join(self.block() for _ in range(self.rnd.randint(1, 9)))
        if self.rnd.random() < 0.25:  # what stands in the article without belonging to it
            inside += self.pick(self.share(), self.related(), self.comments(), self.advert(), self.newsletter())
        if self.rnd.random() < 0.2:
            inside = self.advert() + inside
        name = self.pick("article", "article", "article", "main", "div", "section")
        marks = "" if name in ("article", "main") else self.pick(' class="content"', ' id="main-content"', ' class="post entry"', ' class="article-body"', ' class="story text"', "")
        out = f'<{name}{marks} data-content="1">{inside}</{name}>'
        return self.pick(out, out, f"<main>{out}</main>", f'<div class="page">{out}</div>') if name != "main" else out

    def menu(self) -> str:
        inside = f"<ul>{self.links(3, 9)}</ul>"
        return self.pick(f'<nav data-content="0">{inside}</nav>', f'<nav data-content="0">{inside}</nav>', f'<div class="menu" data-content="0">{inside}</div>', f'<div id="nav" role="navigation" data-content="0">{inside}</div>', f'<ul data-content="0">{self.links(4, 9)}</ul>')

    def header(self) -> str:
        inside = f"{self.pick('<h1>', '<h2>', '<p>', '<a href=/>')}{self.words(1, 4)}" + self.pick("", f"<p>{self.sentences(1, 1)}</p>")
        return self.pick(f'<header data-content="0">{inside}</header>', f'<div class="header" data-content="0">{inside}</div>', f'<div id="site-header" role="banner" data-content="0">{inside}</div>')

    def footer(self) -> str:
        inside = self.pick(f"&copy; {self.words(1, 2)} &middot; {self.sentences(1, 3)}", f"<p>{self.sentences(1, 3)}</p>", f"<ul>{self.links(2, 6)}</ul><p>{self.sentences(1, 1)}</p>")
        return self.pick(f'<footer data-content="0">{inside}</footer>', f'<footer data-content="0">{inside}</footer>', f'<div class="footer" data-content="0">{inside}</div>', f'<div id="foot" role="contentinfo" data-content="0">{inside}</div>')

    def sidebar(self) -> str:
        inside = f"<h3>{self.words(1, 3)}</h3>" + self.pick(f"<ul>{self.links(3, 7)}</ul>", f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 2)}</p><ul>{self.links(2, 4)}</ul>")
        return self.pick(f'<aside data-content="0">{inside}</aside>', f'<div class="sidebar" data-content="0">{inside}</div>', f'<div class="widget side" data-content="0">{inside}</div>', f'<section role="complementary" data-content="0">{inside}</section>')

    def advert(self) -> str:
        return f'<div class="{self.pick("ad", "ad", "ads", "advert", "banner", "sponsor promo", "advertisement")}" data-content="0">{self.pick("", "<p>")}{self.sentences(1, 3)}</div>'

    def notice(self) -> str:
        return f'<div {self.pick("class=cookie-notice", "class=consent", "id=cookie-banner", "class=notice", "role=alert", "class=popup")} data-content="0"><p>{self.sentences(1, 3)}</p>{self.pick("<button>ok</button>", "")}</div>'

    def newsletter(self) -> str:
        return f'<form {self.pick("", "class=newsletter", "id=subscribe", "class=search")} data-content="0"><p>{self.sentences(1, 2)}</p><label>{self.words(1, 2)}</label><input name=x><button>{self.words(1, 1)}</button></form>'

    def comments(self) -> str:
        one = self.pick("div class=comment", "li", "article class=comment")
        inside = "".join(f"<{one}><p>{self.words(1, 2)}</p><p>{self.sentences(1, 5)}</p></{one.split()[0]}>" for _ in range(self.rnd.randint(1, 4)))
        return f'<{(t := self.pick("section", "div", "ol"))} {self.pick("class=comments", "id=comments", "class=discussion", "id=respond")} data-content="0">{inside}</{t}>'

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social", "meta tags", "byline")}" data-content="0">{self.pick(f"<ul>{self.links(2, 4)}</ul>", self.words(2, 6))}</div>'

    def related(self) -> str:
        return f'<div class="{self.pick("related", "recommended", "breadcrumb", "pagination")}" data-content="0"><h4>{self.words(1, 3)}</h4><ul>{self.links(2, 5)}</ul></div>'

    def page(self) -> str:
        before = [self.menu()] if self.rnd.random() < 0.9 else []
        before += [part() for part, chance in ((self.header, 0.5), (self.notice, 0.3), (self.advert, 0.6)) if self.rnd.random() < chance]
        after = [part() for part, chance in ((self.sidebar, 0.4), (self.comments, 0.35), (self.newsletter, 0.25), (self.related, 0.25), (self.share, 0.2), (self.advert, 0.25), (self.notice, 0.1), (self.footer, 0.9)) if self.rnd.random() < chance]
        if self.rnd.random() < 0.15:
            self.rnd.shuffle(before)
        if self.rnd.random() < 0.2:
            before.append(self.sidebar())
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>"
        return head + "".join(before) + self.article() + "".join(after) + self.pick("</body></html>", "")


def pages(seed: int = 1) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(COUNT)]
