"""Labelled pages for training: layouts drawn at random, in invented words.

An element with ``data-label`` gives the label of all below it, up to the next
such element: 1 for the article, 0 for everything else. Features never see it.
"""

from __future__ import annotations

import random

SYLLABLES = "an be ci do en fa go hi in ka lo mi no ou pa re sa ti un vo wa yo ze la der ion ment ing ter".split()


MANNERS = (*["prose"] * 5, "signs", "capitals", "bars", "repeats", "figures", "bare")


class Pages:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.manner = "prose"

    def word(self) -> str:
        return "".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self) -> str:
        """Words in one of several manners: prose, junk signs, capitals, lists of words, repeats, figures."""
        words = [self.word() for _ in range(self.random.choice([1, 2, 4, 8, 12, 18]))]
        manner = self.manner
        if manner == "signs":
            return " ".join(w + self.random.choice(["###", "***", "%%%", "&amp;&amp;", "$$$", "!!", "|", " |", ""]) for w in words)
        if manner == "capitals":
            return " ".join(words).upper() + self.random.choice(["", "!!", "."])
        if manner == "bars":
            return " | ".join(words)
        if manner == "repeats":
            return " ".join([words[0].capitalize()] * self.random.randint(2, 40))
        if manner == "figures":
            return " ".join(self.random.choice([w, str(self.random.randint(0, 10**9)), f"{w}={w}"]) for w in words)
        if manner == "bare":
            return " ".join(words)
        if len(words) > 8 and self.random.random() < 0.6:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.random.choice(".....!?")

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(least, most)))

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(1, 8))).capitalize() + self.random.choice(["", ".", ""])

    def named(self, *names: str) -> str:
        """An attribute with one of these names, or none."""
        name = self.random.choice(names)
        return self.random.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f' class="{self.word()}-{name}"', f" class={name}"])

    def links(self) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (self.title() if self.random.random() < 0.3 else self.word() for _ in range(self.random.randint(2, 9))))

    def menu(self) -> str:
        inner = f"<ul>{self.links()}</ul>"
        if self.random.random() < 0.3:
            inner = " | ".join(f'<a href="#">{self.word()}</a>' for _ in range(5))
        return self.random.choice([f'<nav data-label="0">{inner}</nav>', f'<div data-label="0"{self.named("menu", "navbar", "topnav", "navigation", "breadcrumbs")}>{inner}</div>', f'<ul data-label="0">{self.links()}</ul>'])

    def header(self) -> str:
        inner = self.random.choice([f"<a href='/'>{self.title()}</a>", f"<p>{self.title()}</p>", f"<h1>{self.word()}</h1><p>{self.sentence()}</p>"]) + (self.menu() if self.random.random() < 0.5 else "")
        return self.random.choice([f'<header data-label="0">{inner}</header>', f'<div data-label="0"{self.named("header", "masthead", "topbar")}>{inner}</div>'])

    def footer(self) -> str:
        inner = self.random.choice(["&copy; ", "© 2020 ", "Copyright ", ""]) + self.word() + ".example " + self.random.choice(["&middot; ", "| "]) + self.prose(1, 4)
        if self.random.random() < 0.4:
            inner = f"<p>{inner}</p><ul>{self.links()}</ul>"
        return self.random.choice([f'<footer data-label="0">{inner}</footer>', f'<footer data-label="0">{inner}</footer>', f'<div data-label="0"{self.named("footer", "copyright", "colophon")}>{inner}</div>'])

    def advert(self) -> str:
        inner = self.random.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<a href='/x'>{self.sentence()}</a>"])
        return f'<div data-label="0"{self.named("ad", "ads", "advert", "banner", "sponsored", "promo")}>{inner}</div>'

    def notice(self) -> str:
        inner = self.random.choice([f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2)]) + "<button>OK</button>"
        return f'<div data-label="0"{self.named("cookie", "cookie-consent", "notice", "gdpr", "alert", "popup")}>{inner}</div>'

    def form(self) -> str:
        inner = f"<p>{self.sentence()}</p><label>{self.word()}</label><input name=q>"
        return self.random.choice([f'<form data-label="0">{inner}</form>', f'<div data-label="0"{self.named("newsletter", "subscribe", "search", "login")}><form>{inner}</form></div>'])

    def sidebar(self) -> str:
        inner = f"<h3>{self.title()}</h3>" + self.random.choice([f"<ul>{self.links()}</ul>", f"<p>{self.prose(1, 4)}</p>", "".join(f"<div><a href=/y>{self.title()}</a><p>{self.sentence()}</p></div>" for _ in range(3))])
        return self.random.choice([f'<aside data-label="0">{inner}</aside>', f'<div data-label="0"{self.named("sidebar", "related", "widget", "recommended", "trending")}>{inner}</div>'])

    def comments(self) -> str:
        each = "".join(self.random.choice([f"<div class='comment'><b>{self.word()}</b><p>{self.prose(1, 6)}</p></div>", f"<li><p>{self.word()}:</p><p>{self.prose(1, 6)}</p></li>", f"<article class=comment><p>{self.prose(1, 5)}</p></article>"]) for _ in range(self.random.randint(1, 6)))
        tag = self.random.choice(["div", "section", "div"])
        return f'<{tag} data-label="0"{self.named("comments", "comment-list", "replies", "discussion", "reader-comments")}><h3>{self.title()}</h3>{each}</{tag}>'

    def paragraph(self) -> str:
        text = self.prose(1, 10)
        if self.random.random() < 0.3:
            text = f"<b>{text}" + self.random.choice(["</b>", "<br>", ""])
        if self.random.random() < 0.2:
            text += f' <a href="/z">{self.title()}</a> {self.sentence()}'
        return "<p>" + text + self.random.choice(["</p>", "</p>", ""])

    def part(self) -> str:
        kind = self.random.random() * self.random.choice([0.75, 1])
        if kind < 0.75:
            return self.paragraph()
        if kind < 0.83:
            return f"<h2>{self.title()}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.prose(1, 2) if self.random.random() < 0.6 else self.title()}</li>" for _ in range(4)) + "</ul>"
        return self.random.choice([
            f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>",
            f"<pre>{self.title()}\n  {self.title()}</pre>",
            f"<table><tr><th>{self.word()}</th><td>{self.title()}</td></tr><tr><td>{self.word()}</td><td>{self.word()}</td></tr></table>",
            f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>",
            f"<div>{self.prose(1, 5)}</div>",
        ])

    def article(self) -> str:
        self.manner = self.random.choice(MANNERS)
        parts = [self.part() for _ in range(self.random.choice([0, 1, 1, 2, 3, 5, 8, 14]))]
        if self.random.random() < 0.06:  # a long one of many short paragraphs, or one said again and again
            own = [f"<p>{self.sentence()}" for _ in range(self.random.choice([1, 90]))]
            parts += (own * 90)[: self.random.randint(20, 90)]
        if self.random.random() < 0.25:
            parts.insert(self.random.randint(0, len(parts)), self.advert())
        if self.random.random() < 0.1:
            parts.append(self.random.choice([self.form, self.sidebar, self.comments])())
        head = f"<h1>{self.random.choice([self.title, self.sentence, lambda: self.prose(1, 3)])()}</h1>"
        if self.random.random() < 0.2:
            head = f"<header>{head}<p>{self.sentence()}</p></header>"
        body = (head if self.random.random() < 0.9 or not parts else "") + "".join(parts)
        names = ("content", "post", "entry", "article-body", "story", "main-text")
        self.manner = self.random.choice(MANNERS)
        return self.random.choice([
            *[f'<article data-label="1">{body}</article>'] * 3,
            f'<main data-label="1">{body}</main>',
            f'<div data-label="1"{self.named(*names)}>{body}</div>',
            f'<main><article data-label="1"{self.named(*names)}>{body}</article></main>',
            f'<div data-label="1">{body}</div>',
            f'<section data-label="1">{body}</section>',
        ])

    def page(self) -> str:
        some = lambda make, share: make() if self.random.random() < share else ""
        top = some(self.notice, 0.2) + some(self.header, 0.35) + some(self.menu, 0.8) + some(self.advert, 0.5) + some(self.form, 0.15)
        left, right = some(self.sidebar, 0.2), some(self.sidebar, 0.3)
        middle = left + self.article() + right + some(self.comments, 0.3) + some(self.advert, 0.15) + some(self.form, 0.15)
        if self.random.random() < 0.4:
            middle = f'<div{self.named("wrapper", "container", "page", "row")}>{middle}</div>'
        whole = f'<!DOCTYPE html><html><head><title>{self.title()}</title></head><body data-label="0">{top}{middle}{some(self.footer, 0.85)}{some(self.notice, 0.1)}</body></html>'
        return whole[: int(len(whole) * self.random.uniform(0.5, 1))] if self.random.random() < 0.1 else whole


def labelled_pages(n: int, seed: int) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
