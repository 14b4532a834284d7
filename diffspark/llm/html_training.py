"""Labelled pages to train the block tagger on: many layouts, with the truth known because the pages are laid out here."""

from __future__ import annotations

import random

_SYLLABLES = "ta ri on es mo la ve st en qu er si pa du ro ke li na bo ge".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random) -> str:
    return _words(rng, 3, 25).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks."""
    truth: list[str] = []

    def wrap(tag: str, marks: list[str], inside: str) -> str:
        kind = rng.choice(["class", "id", "role", ""]) if tag not in ("div", "section", "p", "ul") else rng.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{rng.choice(marks)}">{inside}</{tag}>' if kind else f"<{tag}>{inside}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def furniture(place: str) -> str:
        """Something beside the article, of the given kind."""
        text = "".join(f"<{t}>{_sentence(rng)}</{t}>" for t in [rng.choice(["p", "div", "li", "h3"]) for _ in range(rng.randint(1, 3))])
        if place == "menu":
            return wrap(rng.choice(["nav", "div", "ul"]), ["nav", "main-menu", "navbar", "breadcrumbs", "pagination"], links(rng.randint(2, 7)))
        if place == "advert":
            return wrap(rng.choice(["div", "aside", "section"]), ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"], rng.choice([text, _sentence(rng)]))
        if place == "comments":
            some = "".join(wrap("div", ["comment", "comment-body", "reply"], f"<p>{_sentence(rng)} {_sentence(rng)}</p>") for _ in range(rng.randint(1, 5)))
            return wrap(rng.choice(["section", "div", "aside"]), ["comments", "comment-list", "discussion"], f"<h2>{_words(rng, 1, 3)}</h2>" + some)
        if place == "foot":
            return wrap(rng.choice(["footer", "div"]), ["footer", "site-footer", "colophon"], rng.choice([text, f"&copy; {_sentence(rng)}", links(3)]))
        if place == "head":
            return wrap(rng.choice(["header", "div"]), ["header", "masthead", "topbar"], rng.choice([f"<h1>{_words(rng, 1, 4)}</h1>", text, links(3)]))
        if place == "side":
            return wrap(rng.choice(["aside", "div", "section"]), ["sidebar", "related", "widget", "recommended", "share"], rng.choice([text, links(4), text + links(3)]))
        return wrap(rng.choice(["div", "section", "aside"]), ["notice", "cookie-banner", "alert", "newsletter", "consent", "subscribe-box"], text)

    def said(tag: str) -> str:
        text = _sentence(rng)
        truth.append(text)
        if rng.random() < 0.05:
            symbol = _words(rng, 1, 1)
            truth[-1] = f"{text} {symbol}"
            return f"<{tag}>{text} <math><mi>{symbol}</mi></math></{tag}>"
        if rng.random() < 0.2:
            head, _, tail = text.partition(" ")
            return f'<{tag}><a href="#">{head}</a> {tail}</{tag}>' if tail else f"<{tag}>{head}</{tag}>"
        return f"<{tag}>{text}</{tag}>"

    def body() -> str:
        out = [said("h1")] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.65:
                out.append(said("p") if rng.random() < 0.8 else said("p").removesuffix("</p>"))
            elif kind < 0.72:
                out.append(said(rng.choice(["h2", "h3", "blockquote", "pre", "figcaption"])))
            elif kind < 0.8:
                out.append("<ul>" + "".join(said("li") for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.85:
                out.append("<table>" + "".join("<tr>" + said("td") + said("td") + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(furniture(rng.choice(["advert", "advert", "side", "notice", "comments"])))
        return "".join(out)

    places = ["menu", "advert", "foot", "head", "side", "notice", "comments"]
    before = [furniture(p) for p in rng.sample(places, rng.randint(0, 4))]
    frame = rng.choice(["article", "article", "article", "main", "div", "section"])
    # Text order decides the truth, so the article is laid out after what stands before it.
    inner = body()
    if rng.random() < 0.25:
        inner += furniture("comments")
    marks = ["content", "post", "entry-content", "article-body", "story"]
    article = f"<{frame}>{inner}</{frame}>" if frame in ("article", "main") else wrap(frame, marks, inner)
    if rng.random() < 0.35:  # nothing around the article says what it is
        cell = f"<table><tr><td>{inner}</td></tr></table>"
        article = rng.choice([inner, f"<div>{inner}</div>", f'<div class="col-{rng.randint(1, 12)}">{inner}</div>', cell, f"<section><div>{inner}</div></section>"])
    after = [furniture(p) for p in rng.sample(places, rng.randint(0, 4))]
    form = ""
    if rng.random() < 0.4:
        asked = rng.choice(["", "", f"<p>{_words(rng, 2, 8)}</p>", f"<h3>{_words(rng, 1, 4)}</h3>", _words(rng, 1, 5)])
        form = f"<form>{asked}<label>{_words(rng, 1, 3)}</label><input name='q'><button>{_words(rng, 1, 1)}</button></form>"
    if rng.random() < 0.1:
        form += f"<noscript><p>{_sentence(rng)}</p></noscript>"
    middle = "".join(before) + form + article + "".join(after)
    if rng.random() < 0.4:
        middle = wrap("div", ["page", "wrapper", "container", "layout"], middle)
    if rng.random() < 0.15 and "<form" not in middle:
        middle = f'<form action="/">{middle}</form>'
    return f"<html><head><title>{_words(rng, 1, 5)}</title></head><body>{middle}</body></html>", truth


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(count)]
