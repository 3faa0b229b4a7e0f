"""HTML of pages and cards: text, reaction counts, and whether a card looks like a post."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from postmill.functions.numbers import first_number, social_count

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a line of their own when shown.
_BLOCKS = frozenset("address article aside blockquote dd div dl dt footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
#: Where a card's text is looked for, in this order (fixed values): tag, attribute, and what its value holds.
TEXT_PLACES = (
    ("div", "class", "feed-shared-update-v2__description-wrapper"),
    ("div", "class", "feed-shared-text"),
    ("span", "class", "break-words"),
    ("div", "data-test-id", "post-content"),
    ("p", "", ""),
)
#: Classes of elements that may be cards, classes that mark a card as one, classes of its text, and words of its reaction buttons (fixed values).
CARD_CLASSES = ("feed-shared-update-v2", "occludable-update", "update-components-update-v2", "fie-impression-container")
CARD_MARKERS = ("feed-shared", "occludable-update", "update-components", "main-feed-activity-card", "fie-impression-container")
BLOCK_CLASSES = ("feed-shared-text", "feed-shared-update-v2__description-wrapper", "break-words", "update-components-text")
REACTION_WORDS = ("reaction", "like", "react")


class Node:
    """An element and its children: elements and pieces of text."""

    def __init__(self, tag: str = "", attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def pieces(self):
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                yield from child.pieces()

    def text(self, between: str) -> str:
        return between.join(s for p in self.pieces() if (s := p.strip()))

    def raw(self) -> str:
        return "".join(self.pieces())

    def shown(self) -> str:
        """The text as it is shown: white space is single, breaks and blocks end lines."""
        out: list[str] = []
        _show(self, out)
        lines = [re.sub(r"[ \t\r\n\f]+", " ", line).strip(" ") for line in "".join(out).split("\0")]
        return re.sub(r"\n{2,}", "\n", "\n".join(lines)).strip("\n")

    def copy(self) -> Node:
        made = Node(self.tag, self.attributes)
        made.children = [c.copy() if isinstance(c, Node) else c for c in self.children]
        return made


def _show(node: Node, out: list[str]) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\0")
        elif child.tag not in ("script", "style"):
            edge = ["\0"] if child.tag in _BLOCKS else []
            out += edge
            _show(child, out)
            out += edge


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _flatten(node: Node) -> None:
    """Links become their text and a blank, or go if they have none; breaks become line ends."""
    kept = []
    for child in node.children:
        if isinstance(child, Node):
            _flatten(child)
            if child.tag == "a":
                if text := child.raw():
                    kept.append(text + " ")
                continue
            if child.tag == "br":
                kept.append("\n")
                continue
        kept.append(child)
    node.children = kept


def _has(node: Node, attribute: str, part: str) -> bool:
    value = node.attributes.get(attribute, "")
    return part in value if attribute == "class" else value == part


def _card_text_of(root: Node) -> str:
    _flatten(root)
    for tag, attribute, part in TEXT_PLACES:
        node = next((n for n in root.walk() if n.tag == tag and (not attribute or _has(n, attribute, part))), None)
        if node is not None and (text := node.text("\n")):
            return text
    text = root.text("\n")
    return text if len(text) > 3 else ""


def card_text(html: str | None) -> str:
    """A card's text: of the first place that has any, else all of it if it is longer than three characters."""
    return _card_text_of(parse(html))


def _is_card(node: Node) -> bool:
    """Whether an element is one of those that may be a card at all."""
    classes = node.attributes.get("class", "")
    return node.tag == "article" or node.tag == "div" and ("data-urn" in node.attributes or any(c in classes for c in CARD_CLASSES))


def _described(node: Node) -> dict:
    """What the rules for cards look at; text, buttons and blocks are of what is inside the element."""
    inside = list(node.walk())
    blocks = [n.shown() for n in inside if any(_has(n, "class", c) for c in BLOCK_CLASSES) or _has(n, "data-test-id", "post-content")]
    return {
        "tag": node.tag, "classes": node.attributes.get("class", ""), "urn": node.attributes.get("data-urn", ""),
        "buttons": [{"label": (n.attributes.get("aria-label") or "").lower(), "text": n.text(" ")} for n in inside if n.tag == "button"],
        "blocks": [b for b in blocks if b.strip()], "text": node.shown(),
    }


def _parts(html: str | None) -> dict:
    """The first element of a piece of HTML as a card, with the text of all of it."""
    root = parse(html)
    first = next((c for c in root.children if isinstance(c, Node)), Node())
    whole = _described(root)
    return whole | {"tag": first.tag, "classes": first.attributes.get("class", ""), "urn": first.attributes.get("data-urn", "")}


def page_cards(html: str | None) -> list[dict]:
    """The cards of a page in the order of the document; a card inside another is a card of its own."""
    return [_described(n) | {"content": _card_text_of(n.copy())} for n in parse(html).walk() if _is_card(n)]


_BUTTON = StructType([StructField("label", StringType()), StructField("text", StringType())])
_CARD = StructType(
    [StructField(n, StringType()) for n in ("tag", "classes", "urn", "text")]
    + [StructField("buttons", ArrayType(_BUTTON)), StructField("blocks", ArrayType(StringType()))]
)


_PAGE = ArrayType(StructType([*_CARD.fields, StructField("content", StringType())]))


@F.pandas_udf(_PAGE)
def _cards(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: page_cards(p if isinstance(p, str) else None))


def html_cards(html: Column) -> Column:
    """Array of the cards of a page: what ``html_card`` has, and ``content``, the text found by the places texts are in."""
    return _cards(html)


@F.pandas_udf(StringType())
def _card_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: card_text(p) if isinstance(p, str) else "")


@F.pandas_udf(_CARD)
def _card(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parts(p if isinstance(p, str) else None) for p in pages], columns=_CARD.names)


def html_text(html: Column) -> Column:
    """A card's text; null gives the empty text."""
    return _card_text(html)


def html_card(html: Column) -> Column:
    """Struct of what the rules for cards look at: tag, classes, urn, text, buttons and text blocks."""
    return _card(html)


def card_likes(card: Column) -> Column:
    """Reactions of a card: the first button named so with a number, else the largest of any button, else from the text."""
    counted = F.transform(
        card["buttons"],
        lambda b: F.struct(
            b["label"].rlike("|".join(REACTION_WORDS)).alias("named"),
            first_number(F.trim(F.concat(b["label"], F.lit(" "), b["text"]))).alias("n"),
        ),
    )
    named = F.get(F.filter(counted, lambda b: b["named"] & (b["n"] > 0)), F.lit(0))["n"]
    largest = F.nullif(F.coalesce(F.array_max(F.transform(counted, lambda b: b["n"])), F.lit(0)), F.lit(0))
    return F.coalesce(named, largest, social_count(card["text"]))


def likely_post(card: Column) -> Column:
    """Whether a card looks like a post: a text block, or 20 characters in an article, with a urn or a known class."""
    marked = F.lit(False)
    for marker in CARD_MARKERS:
        marked = marked | card["classes"].contains(marker)
    long_enough = F.length(F.trim(F.regexp_replace(card["text"], r"\s+", " "))) >= 20
    return (F.size(card["blocks"]) > 0) | long_enough & ((card["tag"] == "article") | (card["urn"] != "") | marked)


def is_card(card: Column) -> Column:
    """Whether an element is one of those that may be a card at all."""
    known = F.lit(False)
    for name in CARD_CLASSES:
        known = known | card["classes"].contains(name)
    return (card["tag"] == "article") | (card["tag"] == "div") & ((card["urn"] != "") | known)
