"""Pages as sequences of leaf blocks with what is known of their place and text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

# HTML's void elements, and those that begin a block of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of the page's article: code, styles, form controls and their labels, metadata.
SILENT = frozenset(
    "button datalist head iframe input label legend meter noscript object optgroup option output progress script select style svg template textarea title".split()
)
#: A form with this share of a page's words is the page, not a form on it.
PAGE_FORM = 0.5
#: A start tag of a block ends an open element of these kinds first, up to the given container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# Words in class, id and role attributes, by what they usually mark.
PLACES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip toolbar tabs",
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner billboard",
    "comments": "comment comments reply replies discussion disqus respond feedback reactions",
    "foot": "footer foot colophon contentinfo copyright legal",
    "head": "header masthead topbar branding logo",
    "side": "sidebar aside side related widget widgets recommended recommendations complementary rail popular trending share social tags",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe subscription paywall signup login message toast disclaimer",
    "article": "article content post entry main story body text prose page",
}
_PLACE = {word: place for place, words in PLACES.items() for word in words.split()}
_TAG_PLACE = {"nav": "menu", "footer": "foot", "header": "head", "aside": "side", "article": "article", "main": "article", "menu": "menu", "dialog": "notice"}
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    features: list[str]
    form: int = 0  # the outermost form around it, from 1


class _Open:
    __slots__ = ("tag", "places", "hidden")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        self.tag = tag
        said = dict(attrs)
        marks = " ".join(filter(None, (said.get("class"), said.get("id"), said.get("role"), said.get("aria-label"))))
        marks = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", marks).lower()
        self.places = [_PLACE[w] for w in _WORDS.findall(marks) if w in _PLACE]
        if tag in _TAG_PLACE:
            self.places.append(_TAG_PLACE[tag])
        self.hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in (said.get("style") or "").replace(" ", "")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.silent = 0
        self.links = 0
        self.forms = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
            closing, until = CLOSES.get(tag, ({"p"}, frozenset()))
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth].tag
                if name in closing or name == "p":
                    self.drop(depth)
                    break
                if name in until or name in BLOCK and not until:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag == "body":  # ends a head that was left open
            self.stack.clear()
            self.silent = self.links = 0
        if tag not in VOID:
            self.stack.append(_Open(tag, attrs))
            self.silent += tag in SILENT
            self.links += tag == "a"
            self.forms += tag == "form"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCK:
            self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self.drop(depth)
                return

    def drop(self, depth: int):
        self.silent -= sum(o.tag in SILENT for o in self.stack[depth:])
        self.links -= sum(o.tag == "a" for o in self.stack[depth:])
        del self.stack[depth:]

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text:
            inside = any(o.tag == "form" for o in self.stack)
            self.blocks.append(Block(text, self.features(text), self.forms if inside else 0))
        self.parts.clear()
        self.linked = 0

    def features(self, text: str) -> list[str]:
        out = ["bias"]
        places = [p for o in self.stack for p in o.places]
        out += {f"under={p}" for p in places}
        out.append(f"deepest={places[-1] if places else 'none'}")
        if "article" in places:
            after = places[len(places) - 1 - places[::-1].index("article") + 1 :]
            out.append(f"in article={after[-1] if after else 'plain'}")
        tags = [o.tag for o in self.stack if o.tag in BLOCK]
        out.append(f"tag={tags[-1] if tags else 'none'}")
        if any(o.hidden for o in self.stack):
            out.append("hidden")
        words = len(text.split())
        size = min(words, 64).bit_length()
        out.append(f"words={size}")
        share = self.linked / max(1, words)
        links = "none" if not share else "some" if share < 0.5 else "most"
        out.append(f"links={links}")
        if not places:  # nothing but the text says what it is
            out += [f"plain words={size}", f"plain links={links}", f"plain tag={tags[-1] if tags else 'none'}"]
        out.append(f"stop={text[-1] in '.!?…。:;'}")
        return out

    def close(self):
        super().close()
        self.cut()
        words: dict[int, int] = {}
        for block in self.blocks:
            words[block.form] = words.get(block.form, 0) + len(block.text.split())
        for block in self.blocks:
            page = words[block.form] >= PAGE_FORM * sum(words.values())
            block.features.append(f"form={'none' if not block.form else 'page' if page else 'small'}")


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order; an empty list for NULL or a page without text."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.blocks
