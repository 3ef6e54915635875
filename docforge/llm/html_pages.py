"""Labelled training pages for the HTML extraction model.

The tables hold no labelled pages, so the model is trained on pages of common
layouts, written out here by templates with filler words (fixed seed).  The
attribute ``data-y`` labels an element and what is inside of it: 1 main text, 0
not; unlabelled text is not main text.
"""

from __future__ import annotations

import random

_WORDS = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt
ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi
aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia""".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + "." for _ in range(self.rng.randint(low, high)))

    def paragraph(self) -> str:
        text = self.sentences(1, self.rng.choice([1, 2, 6, 12]))
        style = self.rng.random()
        if style < 0.1:
            text = self.words(1, 6)
        elif style < 0.25:
            text = text.replace(" ", f' <a href="/{self.words(1, 1)}">{self.words(1, 2)}</a> ', 1)
        elif style < 0.4:
            text = f"<b>{text}<br>"
        end = "</p>" if self.rng.random() < 0.7 else ""
        return f"<p>{text}{end}"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(n))

    def some(self, *choices: str) -> str:
        return self.rng.choice(choices)

    # parts that are not main text
    def menu(self) -> str:
        items = self.links(self.rng.randint(3, 8))
        return self.some(f"<nav><ul>{items}</ul></nav>", f'<div class="navbar"><ul>{items}</ul></div>',
                         f'<ul id="menu">{items}</ul>', f'<div role="navigation">{items}</div>',
                         f"<ul>{items}</ul>")

    def top(self) -> str:
        return self.some(f"<header><h1>{self.words(1, 3)}</h1><p>{self.words(2, 8)}</p>{self.menu()}</header>",
                         f'<div id="header"><a href="/">{self.words(1, 3)}</a></div>{self.menu()}',
                         self.menu(), f'<div class="masthead">{self.words(1, 4)}</div>{self.menu()}')

    def advert(self) -> str:
        text = self.sentences(1, 3)
        return self.some(f'<div class="ad">{text}</div>', f'<div class="advert"><p>{text}</p></div>',
                         f'<aside class="sponsored">{text}</aside>', f'<div id="banner-ad">{text}</div>',
                         f'<div class="promo-box"><h3>{self.words(2, 4)}</h3><p>{text}</p></div>',
                         f'<span class="ad">{text}</span>')

    def notice(self) -> str:
        text = self.sentences(1, 3)
        return self.some(f'<div class="cookie-notice"><p>{text}</p><button>{self.words(1, 2)}</button></div>',
                         f'<div id="consent">{text}</div>', f'<div role="alert" class="notice">{text}</div>',
                         f'<dialog class="modal"><p>{text}</p></dialog>')

    def form(self) -> str:
        return self.some(f"<form><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button></form>",
                         f'<div class="newsletter"><p>{self.sentences(1, 1)}</p><form><input></form></div>',
                         f'<form class="search"><p>{self.words(2, 6)}</p><input type="submit"></form>',
                         f"<form><p>{self.sentences(1, 2)}</p><textarea>{self.words(1, 5)}</textarea></form>")

    def side(self) -> str:
        items, text = self.links(self.rng.randint(2, 6)), self.sentences(1, 4)
        return self.some(f"<aside><h3>{self.words(1, 3)}</h3><ul>{items}</ul></aside>",
                         f"<aside><p>{text}</p></aside>", f'<div class="sidebar"><p>{text}</p><ul>{items}</ul></div>',
                         f'<section class="related"><h2>{self.words(1, 3)}</h2><ul>{items}</ul></section>',
                         f'<div id="sidebar">{self.advert()}<div class="widget">{text}</div></div>')

    def readers(self) -> str:
        notes = "".join(self.some(f'<li class="comment"><p>{self.sentences(1, 5)}</p></li>',
                                  f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></div>')
                        for _ in range(self.rng.randint(1, 4)))
        return self.some(f'<section id="comments"><h2>{self.words(1, 3)}</h2>{notes}</section>',
                         f'<div class="comments">{notes}</div>', f'<ol class="commentlist">{notes}</ol>',
                         f'<div class="user-comments">{notes}{self.form()}</div>')

    def bottom(self) -> str:
        text = f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}"
        return self.some(f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{self.links(3)}</ul></footer>",
                         f'<div id="footer">{text}</div>', f'<div class="footer"><p>{text}</p></div>',
                         f'<div role="contentinfo" class="copyright">{text}</div>')

    # the main text
    def body(self) -> str:
        out = [self.some(f"<h1>{self.words(2, 10)}</h1>", f"<h1>{self.words(2, 10)}</h1>",
                         f"<header><h1>{self.words(2, 8)}</h1></header>", f"<h2>{self.words(2, 8)}</h2>", "")]
        for _ in range(self.rng.choice([1, 1, 2, 3, 5, 9])):
            kind = self.rng.random()
            if kind < 0.72:
                out.append(self.paragraph())
            elif kind < 0.78:
                out.append(f"<h{self.rng.randint(2, 4)}>{self.words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>"
                                            for _ in range(self.rng.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><th>{self.words(1, 2)}<th>{self.words(1, 2)}<tr><td>{self.words(1, 4)}"
                           f"<td>{self.words(1, 4)}</table>")
            elif kind < 0.93:
                out.append(f"<pre>{self.words(3, 12)}</pre>")
            elif kind < 0.95:
                out.append(f"<div>{self.sentences(1, 4)}</div>")
            else:
                junk = self.some(self.advert(), self.form(), self.side(), self.notice())
                out.append(f'<div data-y="0">{junk}</div>' if self.rng.random() < 0.3
                           else junk.replace(" ", ' data-y="0" ', 1) if junk.split(">")[0].count(" ") else
                           junk.replace(">", ' data-y="0">', 1))
        return "".join(out)

    def article(self) -> str:
        inner = self.body()
        return self.some(f'<article data-y="1">{inner}</article>', f'<article data-y="1">{inner}</article>',
                         f'<main data-y="1">{inner}</main>', f'<main><article data-y="1">{inner}</article></main>',
                         f'<div id="content" data-y="1">{inner}</div>',
                         f'<div class="post-body" data-y="1">{inner}</div>',
                         f'<section class="entry-content" data-y="1">{inner}</section>',
                         f'<div data-y="1">{inner}</div>')

    def page(self) -> str:
        few = lambda make, p: make() if self.rng.random() < p else ""
        middle = (few(self.advert, 0.5) + few(self.notice, 0.3) + self.article() + few(self.advert, 0.2)
                  + few(self.form, 0.2) + few(self.side, 0.4) + few(self.readers, 0.4))
        if self.rng.random() < 0.4:
            middle = f'<div class="{self.some("wrapper", "container", "row", "page")}">{middle}</div>'
        tail = "</body></html>" if self.rng.random() < 0.7 else ""
        return (f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>"
                f"{few(self.notice, 0.2)}{self.top()}{middle}{self.bottom()}{tail}")


def labelled_pages(n: int = 400, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]


class _EmbeddingPage(_Page):
    """Pages with fallback and foreign content: main text where it stands in the
    article, not main text outside; some of the elements have no end tag."""

    def embedded(self) -> str:
        tag = self.some("object", "noscript", "video", "audio", "canvas", "svg")
        text = self.sentences(1, 3)
        inner = f"<text>{text}</text>" if tag == "svg" else text
        return f"<{tag}>{inner}</{tag}>"

    def body(self) -> str:
        start = self.some("", "", "<svg>", "<object>", "<video>", "<canvas>")
        return (start + super().body() + self.embedded() + self.paragraph()
                + f"<p>{self.sentences(1, 1)} <math><mi>{self.words(1, 1)}</mi></math> {self.sentences(1, 1)}</p>")

    def top(self) -> str:
        options = "".join(f"<option>{self.words(1, 2)}" for _ in range(self.rng.randint(2, 5)))
        return self.some(self.embedded(), f"<select>{options}</select>") + super().top()

    def bottom(self) -> str:
        return super().bottom() + self.embedded()


def embedding_pages(n: int = 100, seed: int = 2) -> list[str]:
    rng = random.Random(seed)
    return [_EmbeddingPage(rng).page() for _ in range(n)]


class _LayoutPage(_Page):
    """Pages whose main text has no telling tag or name: nested unnamed elements,
    lines apart by breaks, table layouts, paragraphs right in the body; many are
    short and have little else on them."""

    def line(self) -> str:
        return self.sentences(1, self.rng.choice([1, 1, 2, 5]))

    def lines(self, tag: str) -> str:
        n = self.rng.choice([1, 2, 2, 3, 5, 8])
        return "".join(f"<{tag}>{self.line()}</{tag}>" for _ in range(n))

    def nested(self) -> str:
        inner = self.lines("div")
        if self.rng.random() < 0.3:
            inner = f"<div>{inner}</div><div>{self.lines('p')}</div>"
        return inner

    def title(self) -> str:
        return self.some("", f"<h1>{self.words(1, 8)}</h1>", f"<h2>{self.words(1, 8)}</h2>",
                         f"<div><h1>{self.words(2, 6)}</h1></div>")

    def sections(self) -> str:
        return "".join(f"<section><h2>{self.words(1, 5)}</h2>{self.lines('p')}</section>"
                       for _ in range(self.rng.randint(1, 3)))

    def breaks(self) -> str:
        return "<br><br>".join(self.line() for _ in range(self.rng.randint(1, 5)))

    def article(self) -> str:
        body = self.title() + self.some(self.nested(), self.nested(), self.breaks(), self.sections(),
                                        self.lines("p"), self.lines("section"))
        name = self.some("story", "content", "post", "text", "article-body", "main")
        bare = "".join(f'<p data-y="1">{self.line()}</p>' for _ in range(self.rng.randint(1, 5)))
        return self.some(f'<div class="{name}" data-y="1">{body}</div>', f'<div data-y="1">{body}</div>',
                         f'<div><div data-y="1">{body}</div></div>', f'<center data-y="1">{body}</center>',
                         f'<section data-y="1">{body}</section>', f'<div id="{name}" data-y="1">{body}</div>',
                         f'<article data-y="1">{body}</article>', f'<main data-y="1">{body}</main>',
                         f"<table><tr><td>{self.menu()}</td><td data-y=\"1\">{body}</td></tr></table>",
                         f'<h1 data-y="1">{self.words(1, 8)}</h1>{bare}')

    def page(self) -> str:
        few = lambda make, p: make() if self.rng.random() < p else ""
        middle = (few(self.advert, 0.2) + self.article() + few(self.form, 0.1) + few(self.side, 0.2)
                  + few(self.readers, 0.2))
        if self.rng.random() < 0.3:
            middle = f'<div{self.some("", " class=wrapper", " id=container")}>{middle}</div>'
        return (f"<html><head><title>{self.words(2, 8)}</title></head><body>{few(self.notice, 0.1)}"
                f"{few(self.top, 0.7)}{middle}{few(self.bottom, 0.5)}")


def layout_pages(n: int = 300, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [_LayoutPage(rng).page() for _ in range(n)]
