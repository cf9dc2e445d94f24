"""A page as a tree of block elements with their text runs, built in one pass over the markup."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; only the closing tag ends them.
RAW = frozenset("script style textarea title noscript template iframe svg noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br"
    # formulas and what stands in for objects are text of the block around them
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover"
    " munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml object canvas".split()
)
#: An opening tag of the key closes an open tag of these kinds, unless one of the stops lies between.
_P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: The slash at the end of a tag belongs to an unquoted value.
_VALUE_SLASH = re.compile(r"=\s*[^\s\"']*/\Z")
_WORD = re.compile(r"[a-z]+")
_NAMED = ("class", "id", "role", "itemprop", "aria-label", "data-role")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    own: int = 0  # characters of its own runs
    linked: int = 0  # of them in links
    inline: int = 0
    kids: list[int] = field(default_factory=list)


def _tokens(raw: str) -> list[str]:
    out = []
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in _NAMED:
            out += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
    return out


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block nodes (node 0 is the page) and the text runs in page order as (node, text with single spaces)."""
    nodes = [Node("page", -1, 0)]
    runs: list[tuple[int, str]] = []
    stack = [0]  # open nodes
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.linked += min(linked, len(text))
                runs.append((stack[-1], text))
        linked = 0

    def close_to(height: int) -> None:
        if height < len(stack):
            flush()
            del stack[height:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            text = page[at : m.start()]
            buffer.append(text)
            if links:
                linked += len(text.strip())
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        closing, tag = m[1], m[2].lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            for height in range(len(stack) - 1, 0, -1):
                if nodes[stack[height]].tag == tag:
                    close_to(height)
                    break
            continue
        if tag in RAW:
            # textarea and title hold text that is no part of a page's blocks
            if tag == "svg" and m[3].endswith("/") and not _VALUE_SLASH.search(m[3]):
                continue
            stop = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
            if stop is None and tag == "svg":
                continue  # the blocks after it end it
            if stop is None:
                at = end
            else:
                at = page.find(">", stop.start()) + 1 or end
            continue
        if tag in INLINE:
            nodes[stack[-1]].inline += 1
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                links += 1
            continue
        flush()
        if tag in _P_ENDERS:
            for height in range(len(stack) - 1, 0, -1):
                kind = nodes[stack[height]].tag
                if kind == "p":
                    close_to(height)
                    break
                if kind in ("div", "article", "section", "td", "th", "li", "body", "blockquote", "main"):
                    break
        if tag in _IMPLIED:
            kinds, stops = _IMPLIED[tag]
            for height in range(len(stack) - 1, 0, -1):
                kind = nodes[stack[height]].tag
                if kind in stops:
                    break
                if kind in kinds:
                    close_to(height)
                    if kind == tag or tag in ("dt", "dd", "td", "th"):
                        break
        if tag in VOID:
            continue
        links = 0  # a block ends what links were left open
        number = len(nodes)
        raw = m[3]
        nodes.append(Node(tag, stack[-1], len(stack), _tokens(raw) if "=" in raw or "hidden" in raw else []))
        nodes[stack[-1]].kids.append(number)
        if not raw.endswith("/"):
            stack.append(number)
    flush()
    return nodes, runs
