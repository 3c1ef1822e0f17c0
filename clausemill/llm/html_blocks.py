"""Leaf blocks of an HTML page: the runs of text between block-level tags, with the tags above them."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

#: Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select datalist textarea head title".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else ends it, as its end tag and the start tag of the body may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: An opening tag closes open elements of its group, up to the nearest element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_BOUNDS = frozenset("table td th caption button object article aside section main nav header footer form div li dd blockquote body".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Above:
    """An open element and those above it, shared by all blocks below; ``told`` is what a reader keeps about it."""

    __slots__ = ("names", "parent", "tag", "told")

    def __init__(self, parent: Above | None, tag: str, names: str):
        self.parent, self.tag, self.names = parent, tag, names
        self.told: Any = None


@dataclass
class Block:
    """One block: its text, the innermost element above it, how much of it is in links, and the inline tags in it."""

    text: str
    above: Above | None
    link_chars: int = 0
    tags: frozenset = field(default_factory=frozenset)

    @property
    def path(self) -> list[tuple[str, str]]:
        """The elements above it (tag, class and id words), outermost first."""
        out, node = [], self.above
        while node is not None:
            out.append((node.tag, node.names))
            node = node.parent
        return out[::-1]


def _named(attributes: str) -> str:
    """The class, id and role words of a tag in lower case; ``hidden`` where the element is not shown."""
    words = []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
        if key in ("class", "id", "role"):
            words.append(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
    return " ".join(words)


def blocks_of(page: str) -> list[Block]:
    """All blocks with text, in page order; character references decoded, white space runs as one space.

    Where elements of a tag are open is kept by tag, so an end tag costs the same at any depth.
    """
    found: list[Block] = []
    stack: list[tuple[str, Above | None]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)
    in_block: list[int] = []
    in_bound: list[int] = []
    parts: list[str] = []
    linked = 0
    inline: set[str] = set()
    skipping = 0  # open elements whose content is no text
    links = 0  # open links

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, stack[-1][1] if stack else None, min(linked, len(text)), frozenset(inline)))
        parts.clear()
        inline.clear()
        linked = 0

    def pop() -> None:
        nonlocal skipping, links
        tag, _ = stack.pop()
        places[tag].pop()
        if tag in BLOCK:
            in_block.pop()
        if tag in _BOUNDS:
            in_bound.pop()
        skipping -= tag in SKIPPED
        links -= tag == "a"

    def push(tag: str, names: str) -> None:
        nonlocal skipping, links
        above = stack[-1][1] if stack else None
        places[tag].append(len(stack))
        if tag in BLOCK:
            in_block.append(len(stack))
        if tag in _BOUNDS:
            in_bound.append(len(stack))
        stack.append((tag, Above(above, tag, names) if tag in BLOCK or names else above))
        skipping += tag in SKIPPED
        links += tag == "a"

    def innermost(tags: set[str] | frozenset) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def close(group: set[str] | frozenset, bound: int) -> None:
        """Closes the innermost open element of the group, unless that lies outside the bound."""
        k = innermost(group)
        while k >= max(bound, 0) and len(stack) > k:
            pop()

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            pop()

    def text(s: str) -> None:
        nonlocal linked
        if s.strip():
            end_head()
        if s and not skipping:
            parts.append(s)
            if links:
                linked += len(s.strip())

    at, end = 0, len(page)
    while at < end:
        open_ = page.find("<", at)
        if open_ < 0:
            text(page[at:])
            break
        text(page[at:open_])
        if page.startswith("<!--", open_):
            stop = page.find("-->", open_ + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", open_):
            stop = page.find("]]>", open_)
            text(html.escape(page[open_ + 9 : stop if stop >= 0 else end], quote=False))
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), open_):
            stop = page.find(">", open_)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, open_) or _LOOSE.match(page, open_)
        if not m:
            text("&lt;")
            at = open_ + 1
            continue
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag in HEADINGS:
                close(HEADINGS, in_bound[-1] if in_bound else -1)
            else:
                close({tag}, in_block[-1] if in_block and tag not in BLOCK else -1)
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in ("br", "wbr"):
            text(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            close({"p"}, in_bound[-1] if in_bound else -1)
            if tag in CLOSES:
                close(CLOSES[tag][0], innermost(CLOSES[tag][1]))
            if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                pop()
        if tag in VOID:
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
        if tag not in BLOCK:
            inline.add(tag)
        push(tag, _named(attributes) if attributes else "")
    flush()
    return found
