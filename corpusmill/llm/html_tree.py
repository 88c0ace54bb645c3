"""A forgiving reader of one page: its text blocks, and digests of the element subtrees around them."""

from __future__ import annotations

import hashlib
import html as entities
import re
from typing import NamedTuple

_NAME = r"[a-zA-Z][^\s/>]*+"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>{_NAME})(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*+>?)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# fixed values: elements of HTML by their role here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("aside center details div dl fieldset figure form header footer hgroup menu nav ol section table ul".split())
REMOVED = frozenset(
    "aside button datalist dialog embed footer form head iframe input label link menu meta nav noembed noframes noscript object "
    "script select style svg template textarea title canvas audio video".split()
)
# fixed values: words of class, id and role that name what is not the article
BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "complementary contentinfo disclaimer disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion "
    "related replies reply share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split()
)
# fixed values: words that say of a box only that it is one
BOX = frozenset("area bar block box button buttons container content form inner item items link links list outer panel section slot top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
"""A start tag ends the open elements named first, as far as the ones named second."""


class Block(NamedTuple):
    text: str
    inside: int
    """Place in ``Page.subtrees`` of the smallest one that holds the block, or -1."""


class Subtree(NamedTuple):
    """An element that may be a template of the site."""

    digest: int
    inside: int
    """Place of the smallest subtree around it, which is before its own, or -1."""


class Page(NamedTuple):
    blocks: list[Block]
    subtrees: list[Subtree]


def text_without(page: Page, gone: set[int]) -> str:
    """The blocks that no subtree of these digests holds, at any depth, joined by line ends."""
    out: list[bool] = []
    for digest, inside in page.subtrees:
        out.append(digest in gone or (inside >= 0 and out[inside]))
    return "\n".join(text for text, inside in page.blocks if inside < 0 or not out[inside])


class _Element:
    __slots__ = ("tag", "parent", "removed", "where", "parts", "digest", "place")

    def __init__(self, tag: str, parent: _Element | None, removed: bool, where: int):
        self.tag, self.parent, self.removed, self.where = tag, parent, removed, where
        self.parts: list[str] = []
        self.digest, self.place = 0, None


def is_boilerplate(tag: str, attrs: str, where: int) -> bool:
    """By element, or by a word of its class, id or role; ``where`` is 2 inside an article, 1 inside the main part."""
    if tag in REMOVED or (tag == "header" and where < 2):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if where == 2 and tag in HEADINGS:  # named after their own words
        return False
    found = [v for m in _NAMES.finditer(attrs) for v in m.groups() if v]
    if tag == "article":  # names of articles say much about what is in them
        return any(w in BOILERPLATE for v in found for w in v.lower().split())
    if where == 2:  # a name with a word of its own is about the text: related-work, notice-of-appeal
        names = [set(_WORD.findall(_CAMEL.sub(" ", n).lower())) for v in found for n in v.split()]
        return any(n & BOILERPLATE and n <= BOILERPLATE | BOX for n in names)
    return any(w in BOILERPLATE or (w == "header" and where < 2) for v in found for w in _WORD.findall(_CAMEL.sub(" ", v).lower()))


def blocks_of(page: str) -> Page:
    """Blocks of the article, else of the main part, else of the page, with the subtrees around them.

    What is boilerplate by its name is left out.
    """
    top = _Element("", None, False, 0)
    stack, texts, number, at = [top], [], 0, 0
    open_tags: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw and not stack[-1].removed:
            value = entities.unescape(raw) if "&" in raw else raw
            texts.append((number, stack[-1], value))
            stack[-1].parts.append(value)

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            open_tags[e.tag] -= 1
            if not e.removed:
                e.digest = _digest(e)
                e.parent.parts.append(f"<{e.digest}>")

    def find(names, barrier=()) -> int:
        """Place of the outermost open element of these names above the barrier, or 0."""
        found = 0
        if not any(open_tags.get(n) for n in names):
            return found
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in barrier:
                break
            if stack[i].tag in names:
                found = i
        return found

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK and not (m["end"] and tag != "p" and not open_tags.get(tag)):
            number += 1
        if m["end"]:
            if open_tags.get(tag):
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if tag in BLOCK or not any(e.tag in BLOCK for e in stack[i + 1 :]):
                    close(i)
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if tag in BLOCK and open_tags.get("p") and (i := find({"p"}, {"button", "table", "td", "th", "caption", "object"})):
            close(i)
        if tag in _CLOSES and (i := find(*_CLOSES[tag])):
            close(i)
        parent, attrs = stack[-1], m["attrs"]
        where = parent.where
        removed = parent.removed or is_boilerplate(tag, attrs, where)
        if not removed and (tag == "article" or (tag == "main" and where < 1) or 'role="main"' in attrs):
            where = 2 if tag == "article" else max(where, 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(_Element(tag, parent, removed, where))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close(1)
    return _joined(texts)


def _joined(texts: list[tuple[int, _Element, str]]) -> Page:
    best = max((e.where for _, e, value in texts if value.strip()), default=0)
    held: dict[int, tuple[_Element, list[str]]] = {}
    for number, e, value in texts:
        if e.where == best:
            held.setdefault(number, (e, []))[1].append(value)
    page = Page([], [])
    for e, values in held.values():
        if value := " ".join("".join(values).split()):
            page.blocks.append(Block(value, _placed(e, best, page.subtrees)))
    return page


def _placed(e: _Element, best: int, subtrees: list[Subtree]) -> int:
    """Place of the smallest subtree around an element, each element being looked at once a page.

    Inside an article its containers may be templates, never its paragraphs; elsewhere all blocks of the page may.
    """
    new = []
    while e.place is None and e.parent is not None and not (best and e.parent.where < best):
        new.append(e)
        e = e.parent
    place = -1 if e.place is None else e.place
    for e in reversed(new):
        if e.tag in CONTAINER or (not best and e.tag in BLOCK and e.tag not in ("html", "body")):
            subtrees.append(Subtree(e.digest, place))
            place = len(subtrees) - 1
        e.place = place
    return place


def _digest(e: _Element) -> int:
    """Signed 64 bits of the element's name, its text with single spaces, and the digests of its children."""
    joined = " ".join("".join(e.parts).split())
    return int.from_bytes(hashlib.blake2b(f"{e.tag}\0{joined}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
