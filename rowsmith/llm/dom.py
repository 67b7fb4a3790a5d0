"""A small tolerant HTML reader: block elements as a tree, with the text between them as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())      # what they hold is no markup
UNSHOWN = frozenset("template svg select audio video canvas annotation annotation-xml".split())  # what they hold is markup
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark nobr q ruby rb rp rt rtc "
    "s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mpadded mphantom".split()
)
ENDLESS = frozenset(("script", "style"))  # without an end tag they go on to the end of the page
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSED_BY_BLOCK = "p"
CLOSES = {  # an element that a start tag ends, and what it is not looked for beyond
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody"), ("table",)),
}
CONTROLS = frozenset(("input", "button", "textarea", "select", "label"))

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-component"))
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where the elements of a name end: the place after the end tag, by that of the start tag.

    An end tag ends the last one open. Those without an end tag are not in the result.
    """
    ends, begun = {}, []
    for found in re.finditer(f"<(/?){re.escape(tag)}(?=[\\s/>])[^>]*+>", html, re.I):
        if not found[1]:
            if html[found.end() - 2] != "/":
                begun.append(found.start())
        elif begun:
            ends[begun.pop()] = found.end()
    return ends


@dataclass
class Page:
    """Nodes in page order: parent (-1: none), tag, attribute tokens, text of leaves, counts of own text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)


def attribute_tokens(source: str) -> tuple[str, ...]:
    """Lower-case words of the telling attributes of a start tag; ``hidden`` for what is not shown."""
    if not source or source.isspace():
        return ()
    out = []
    for name, a, b, c in ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if name in NAMED:
            out += [w.lower() for w in PART.findall(unescape(value))]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            out.append("hidden")
    return tuple(out)


def read(html: str, known: dict[str, tuple[str, ...]] | None = None) -> Page:
    """The block tree of a page. ``known`` remembers the tokens of attribute texts between pages.

    Scripts, styles, other raw elements and what is never shown as text, comments and tags are left
    out. Of these only a script or style without an end tag takes the rest of the page with it; of
    any other the start tag alone is left out then. White space in the text between two block
    boundaries becomes one blank; what is empty then is no leaf.
    """
    page = Page()
    known = {} if known is None else known
    stack, open_tags = [-1], [""]
    pieces: list[str] = []
    linked, in_link, at = 0, False, 0
    ends: dict[str, dict[int, int]] = {}
    unending: set[str] = set()  # raw elements that no end tag follows any more

    def add(tag: str, tokens: tuple[str, ...], text: str = "", link: int = 0) -> int:
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.tokens.append(tokens)
        page.text.append(text)
        page.linked.append(link)
        page.controls.append(0)
        return len(page.parent) - 1

    def text_ends() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                add("#text", (), text, min(linked, len(text)))
        linked = 0

    def close(names: tuple[str, ...], beyond: tuple[str, ...]) -> None:
        """End the outermost of ``names`` that is open, but none outside an element of ``beyond``."""
        found = None
        for i in range(len(open_tags) - 1, 0, -1):
            if open_tags[i] in beyond:
                break
            if open_tags[i] in names:
                found = i
                if len(names) == 1:
                    break
        if found is not None:
            text_ends()
            del stack[found:], open_tags[found:]

    def words(chunk: str) -> None:
        nonlocal linked
        if "&" in chunk:
            chunk = unescape(chunk)
        if in_link:
            linked += len(chunk)
        pieces.append(chunk)

    while True:
        match = MARKUP.search(html, at)
        if match is None:
            if at < len(html):
                words(html[at:])
            break
        if match.start() > at:
            words(html[at:match.start()])
        at = match.end()
        name = match[2] or match[5]
        if name is None:
            continue
        tag, end, attributes = name.lower(), bool(match[1] or match[4]), match[3] or match[6] or ""
        if end:
            if tag == "a":
                in_link = False
            elif tag not in INLINE:
                text_ends()
                close(HEADINGS if tag in HEADINGS else (tag,), ("td", "th", "table") if tag == "p" else ())
            continue
        if tag in CONTROLS and stack[-1] >= 0:
            page.controls[stack[-1]] += 1
        if tag in UNSHOWN:
            if tag not in ends:
                ends[tag] = _ends(html, tag)
            at = ends[tag].get(match.start(), at)
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in unending:
                shut = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
                if shut is not None:
                    after = html.find(">", shut.start())
                    at = len(html) if after < 0 else after + 1
                elif tag in ENDLESS:
                    at = len(html)
                else:
                    unending.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            elif tag in ("br", "img"):
                pieces.append(" ")
            continue
        text_ends()
        if CLOSED_BY_BLOCK in open_tags:
            close((CLOSED_BY_BLOCK,), ("td", "th", "table"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID:
            continue
        tokens = known.get(attributes)
        if tokens is None:
            tokens = attribute_tokens(attributes)
            if len(known) < 10_000:
                known[attributes] = tokens
        number = add(tag, tokens)
        if not attributes.endswith("/") or tag in ("p", "div", "li", "a"):
            stack.append(number)
            open_tags.append(tag)
            in_link = False
    text_ends()
    return page
