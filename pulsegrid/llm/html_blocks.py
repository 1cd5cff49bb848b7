"""Blocks of a web page: its texts between block-level marks, each with the path of elements around it."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
# Formulas stand inside sentences; their parts are told apart by spaces.
FORMULA = set(
    "annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
    "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= FORMULA | {"math"}
# What is inside is no text. Those that are code or a field's value run to the page's end if they are not closed.
TO_END = ("script", "style", "textarea")
SILENT = "script|style|textarea|template|iframe|svg|select"
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split())
# An element that ends an open one of these kinds, unless one of the second kinds stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}

# Attributes up to the end of a tag: only after an equals sign does a quote open a value, and a bare value may hold quotes.
_ATTRIBUTES = r"""(?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?|[^>=])*+"""
_PIECE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({SILENT})(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]|\Z))[^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|[^<]+|<", re.S | re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)", re.I) for name in SILENT.split("|")}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Place:
    """A block-level element and, through `outer`, those around it. `names` are its name and its class, id and role words."""

    __slots__ = ("names", "outer", "depth", "seen")

    def __init__(self, names: tuple[str, ...], outer: Place | None):
        self.names, self.outer, self.seen = names, outer, None
        self.depth = 1 if outer is None else outer.depth + 1


def place_of(path) -> Place | None:
    place = None
    for names in path:
        place = Place(names, place)
    return place


class Block(NamedTuple):
    place: Place | None  # the innermost element around the text; none at the top
    text: str
    linked: int  # characters of the text inside links

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """The names of every element around the text, the outermost first."""
        out, place = [], self.place
        while place is not None:
            out.append(place.names)
            place = place.outer
        return tuple(reversed(out))


def names_of(attributes: str) -> tuple[str, ...]:
    found = (" ".join(m) for m in _NAMES.findall(attributes))
    return tuple("." + w.lower() for value in found for w in _WORD.findall(value))


def blocks_of(html: str) -> list[Block]:
    """All blocks with text, in page order. Any string has blocks; what is not closed ends with the page.

    Character references are decoded, white space inside a block becomes one space; a line break is white space.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place | None]] = []  # open elements, each with the place of a text inside it
    where: dict[str, list[int]] = {}  # the heights at which elements of a name are open
    text: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                out.append(Block(stack[-1][1] if stack else None, said, min(linked, len(said))))
            text.clear()
        linked = 0

    def highest(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def close_kind(kinds, stops=()):
        upto = highest(kinds)
        if upto > highest(stops):
            while len(stack) > upto:
                where[stack.pop()[0]].pop()

    at = 0
    unclosed = set()  # kinds that no end follows, so that each is looked for once
    while at < len(html):
        m = _PIECE.match(html, at)
        at = m.end()
        name = m.group(3)
        if m.group(1):
            silent = m.group(1).lower()
            if not m.group().endswith("/>") and silent not in unclosed:
                end = _END[silent].search(html, at)
                if end:
                    at = end.end()
                elif silent in TO_END:
                    at = len(html)
                else:
                    unclosed.add(silent)
            continue
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if where.get("a"):
                    linked += len(piece)
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name == "br" or name in FORMULA:
            text.append(" ")
        if m.group(2):
            close_kind({name})
        elif name not in VOID:
            if (name in ENDS_P or name == "body") and len(stack) < 3:
                close_kind({"head"})
            if name in ENDS_P:
                close_kind({"p"}, {"td", "th", "table", "button"})
            if name in ENDS:
                close_kind(*ENDS[name])
            if not m.group(4).endswith("/") or name in ENDS_P:
                place = stack[-1][1] if stack else None
                if name not in INLINE:
                    place = Place((name, *names_of(m.group(4))) if m.group(4) else (name,), place)
                where.setdefault(name, []).append(len(stack))
                stack.append((name, place))
    flush()
    return out
