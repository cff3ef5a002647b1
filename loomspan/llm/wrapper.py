"""Main text of web pages by wrappers, union-free regular expressions over tags.

1. Every page becomes a stream of structural tags and text slots in which runs
   of equal groups are folded into one repeated group.
2. The distinct streams of a host are aligned one after another with the host's
   wrapper. Where they differ, a stretch that repeats a group is absorbed by it
   and any other stretch becomes optional. Partial wrappers, made in parallel on
   shares of a host's streams, are merged by the same alignment, level by level.
3. All distinct pages of the host say what its wrapper's slots hold. The innermost
   element with four fifths of their own text (no links, no asides) is the host's
   article, whatever its tag; several article elements are all of them. Slots
   outside it are content if they hold much text that differs from page to page.
4. Each page is aligned with its host's wrapper and what stands in the article's
   slots is read out, without elements that are asides by tag or class. A page of
   another layout is read by its own elements.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, clash_free
from .words import text_slices

#: Elements that hold no content.
ASIDE = frozenset("head title nav footer aside form select button dialog menu header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
MAIN = frozenset(("article", "main"))
#: Elements that may be a host's article.
BOXES = frozenset("html body div article main section td center".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("head title base link meta".split())
#: Words in class, id or role that mark an element as no content, in the languages of the web's templates.
_WORD = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|footer|header|masthead|comments?|respond|disqus|repl(?:y|ies)|shar(?:e|ing)|related|recommend\w*"
    r"|newsletter|subscribe|cookies?|consent|notices?|popup|modal|toolbar|pagination|pager|widget|kommentar\w*|commentaires?|comentarios?|werbung|anzeigen?|publicit\w*|publicidad")
HINT = re.compile(rf"(?:^|[_-])(?:{_WORD})(?:$|[_-])|^social[_-]?(?:links?|media|icons?|bar|buttons?)$", re.I)
NO_HINT = re.compile(r"(?:article|post|entry|story|page|content)[_-]?(?:header|title|body|content)", re.I)
#: Ids are often made from headings, so every part must be such a word or one of layout.
HINT_ID = re.compile(rf"(?:(?:{_WORD}|social|site|page|main|top|bottom|left|right|inner|outer|list|section|box|bar|buttons?|links?|area|block|wrap(?:per)?|container|form|\d+)(?:[_-]|$))+", re.I)

#: Elements whose content is no markup, and those that are drawn.
_RAW = re.compile(r"(script|style|noscript|iframe|textarea)\b", re.I)
_DRAWN = re.compile(r"(svg|math|template|canvas|object)\b", re.I)
_NAME = re.compile(r"(/?)([a-z][^\s/>]*)", re.I)
_MARK = re.compile("[>\"']")
#: Text, or a tag without angle brackets inside; what it can't take is looked at closely.
_PLAIN = re.compile(r"([^<]+)|<(?!(?:script|style|noscript|iframe|textarea|svg|math|template|canvas|object)\b)(/?)([a-z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>", re.I)


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)`` of a page's parts in order: text, open, close, raw (all of such an element) and nothing (comments).

    A tag ends at the first ``>`` outside quotes or, if quotes are left open, at
    the first one at all; a ``<`` without any is text. Whatever the page holds, no
    character is looked at more than a few times.
    """
    at, n = 0, len(page)
    ends: dict[str, re.Pattern] = {}
    missing: set[str] = set()  # elements that have no end tag from here on
    failed: set[int] = set()  # quotes from which no tag's end was found
    last_close = page.rfind(">")

    def tag_end(begin: int) -> int:
        """Place after the tag's ``>``."""
        seen, k = [], begin
        while m := _MARK.search(page, k):
            if m[0] == ">":
                return m.end()
            if m.start() in failed:
                break
            seen.append(m.start())
            k = page.find(m[0], m.end()) + 1
            if not k:
                break
        failed.update(seen)
        return page.find(">", begin) + 1

    def element_end(name: str, begin: int) -> int:
        """Place after the end tag of a raw or drawn element; -1 if there is none."""
        if name in missing:
            return -1
        found = ends.setdefault(name, re.compile(f"</{name}\\s*>", re.I)).search(page, begin)
        if found is None:
            missing.add(name)
            return -1
        return found.end()

    while at < n:
        while m := _PLAIN.match(page, at):
            at = m.end()
            text, close, name, rest = m.groups()
            if text is not None:
                yield "text", "", text
            else:
                yield "close" if close else "open", name.lower(), rest
        if at >= n:
            break
        begin = page.find("<", at)
        begin = n if begin < 0 else begin
        if begin > at:
            yield "text", "", page[at:begin]
            at = begin
            continue
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            end = page.find("-->", at + 4) if page[at + 2] == "-" else page.find("]]>", at + 9)
            at = n if end < 0 else end + 3
            yield "nothing", "", ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at + 2)
            at = n if end < 0 else end + 1
            yield "nothing", "", ""
        elif last_close < at or not (m := _NAME.match(page, at + 1)):
            yield "text", "", "<"
            at += 1
        elif not m[1] and (raw := _RAW.match(page, at + 1)):
            end = element_end(raw[1].lower(), page.find(">", raw.end()) + 1)
            at = n if end < 0 else end
            yield "raw", "", ""
        elif not m[1] and (drawn := _DRAWN.match(page, at + 1)):
            at = page.find(">", drawn.end()) + 1
            if page[at - 2] != "/":
                at = max(at, element_end(drawn[1].lower(), at))
            yield "raw", "", ""
        else:
            at = tag_end(m.end())
            yield "close" if m[1] else "open", m[2].lower(), page[m.end() : at - 1]


_HINTED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def marked(attributes: str) -> bool:
    """Whether class, role or id of an element say that it is no content."""
    for key, value in _HINTED.findall(attributes):
        for word in value.strip("\"'").split():
            if HINT.search(word) and not NO_HINT.search(word) and (key.lower() != "id" or HINT_ID.fullmatch(word)):
                return True
    return False


SLOT = "#"
#: Longest group that is looked for when runs are folded.
GROUP = 12


@dataclass
class Block:
    """The text between two structural tags."""

    pieces: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    known: str | None = None

    def text(self) -> str:
        if self.known is None:
            self.known = " ".join(html.unescape("".join(self.pieces)).split())
        return self.known


def tokens(page: str) -> tuple[list[str], list[Block | None]]:
    """Structural symbols of a page, and the block of each text slot among them.

    A tag is ``name``, ``name!`` if its attributes mark it as no content, or
    ``/name``. Inline tags, comments and raw elements leave no symbol.
    """
    symbols: list[str] = []
    blocks: list[Block | None] = []
    block, link = Block(), False

    def end_block() -> None:
        nonlocal block
        if any(p.strip() for p in block.pieces):
            symbols.append(SLOT), blocks.append(block)
        block = Block()

    for kind, name, rest in scan(page):
        if kind == "text":
            block.pieces.append(rest)
            block.linked += len(rest) if link else 0
        elif not name:
            block.pieces.append(" " if kind == "raw" else "")
        elif name in INLINE:
            if name == "a":
                link = kind == "open"
            if name in ("br", "img", "wbr"):
                block.pieces.append(" " if name == "br" else "")
        else:
            end_block()
            if kind == "close":
                symbol = f"/{name}"
            else:
                aside = name not in MAIN and name not in ("body", "html") and marked(rest)
                symbol = f"{name}!" if aside else name
            symbols.append(symbol), blocks.append(None)
    end_block()
    return symbols, blocks


def fold(symbols: list) -> tuple[list, list[list[int]]]:
    """Folds runs of equal groups into ``("+", group)``; gives for each node the places it covers."""
    nodes, covers = list(symbols), [[k] for k in range(len(symbols))]
    for size in range(1, GROUP + 1):
        out, cover, k, n = [], [], 0, len(nodes)
        while k < n:
            runs = 1
            if k + size < n and nodes[k] == nodes[k + size] and (size > 1 or not isinstance(nodes[k], tuple)):
                group = tuple(nodes[k : k + size])
                while tuple(nodes[k + runs * size : k + (runs + 1) * size]) == group:
                    runs += 1
            if runs > 1:
                out.append(("+", group)), cover.append([p for c in covers[k : k + runs * size] for p in c])
                k += runs * size
            else:
                out.append(nodes[k]), cover.append(covers[k])
                k += 1
        nodes, covers = out, cover
    return nodes, covers


def absorb(nodes: list, covers: list, groups: Iterable[tuple]) -> tuple[list, list]:
    """Lets single runs of known repeated groups count as the group, and joins neighbours of one group."""
    for group in sorted(groups, key=lambda g: -len(g[1])):
        size, out, cover, k = len(group[1]), [], [], 0
        while k < len(nodes):
            if nodes[k] == group or tuple(nodes[k : k + size]) == group[1]:
                width = 1 if nodes[k] == group else size
                places = [p for c in covers[k : k + width] for p in c]
                if out and out[-1] == group:
                    cover[-1] = cover[-1] + places
                else:
                    out.append(group), cover.append(places)
                k += width
            else:
                out.append(nodes[k]), cover.append(covers[k])
                k += 1
        nodes, covers = out, cover
    return nodes, covers


def _groups(nodes: Iterable) -> set:
    return {n for n in nodes if isinstance(n, tuple)}


def align(wrapper: list[tuple], nodes: list) -> Iterator[tuple[int | None, int | None]]:
    """Pairs of places of wrapper and page nodes that correspond; None where one has no counterpart."""
    left = [n for n, _ in wrapper]
    for op, a, b, c, d in SequenceMatcher(None, left, nodes, autojunk=False).get_opcodes():
        if op == "equal":
            yield from zip(range(a, b), range(c, d), strict=True)
        else:
            yield from ((k, None) for k in range(a, b))
            yield from ((None, k) for k in range(c, d))


def generalise(wrapper: list[tuple] | None, other: list[tuple]) -> list[tuple]:
    """The wrapper widened so that it also takes ``other``; both are lists of (node, optional)."""
    if wrapper is None or wrapper == other:
        return other
    both = _groups(n for n, _ in wrapper) | _groups(n for n, _ in other)
    sides = []
    for side in (wrapper, other):
        nodes, covers = absorb([n for n, _ in side], [[k] for k in range(len(side))], both)
        sides.append([(n, any(side[k][1] for k in c)) for n, c in zip(nodes, covers, strict=True)])
    mine, theirs = sides
    out = []
    for a, b in align(mine, [n for n, _ in theirs]):
        if a is not None and b is not None:
            out.append((mine[a][0], mine[a][1] or theirs[b][1]))
        else:
            out.append(((mine[a] if a is not None else theirs[b])[0], True))
    return out


def dump(wrapper: list[tuple]) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def load(text: str) -> list[tuple]:
    def node(n):
        return n if isinstance(n, str) else ("+", tuple(node(x) for x in n[1]))
    return [(node(n), optional) for n, optional in json.loads(text)]


def _symbols(node) -> Iterator[str]:
    if isinstance(node, str):
        yield node
    else:
        for n in node[1]:
            yield from _symbols(n)


@dataclass(slots=True)
class _Open:
    """An open element, with what holds for the text inside it."""

    name: str = ""
    place: int = -1
    serial: int = -1
    hidden: bool = False  # in an aside of the page
    article: bool = False
    main: bool = False
    inside: bool = False  # in a box
    left_out: bool = False  # in an aside of the box
    held: float = 0
    mains: int = 0


@dataclass
class Walked:
    """For each node whether its text is plain, inside a box and in a main element; by serial number of each element what it held; by place what is told of elements that are nodes of their own."""

    plain: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    forms: dict[int, float] = field(default_factory=dict)
    mains: dict[int, int] = field(default_factory=dict)
    held: dict[int, float] = field(default_factory=dict)
    around: dict[int, tuple[bool, bool]] = field(default_factory=dict)  # hidden, in a main element
    marked: list[int] = field(default_factory=list)  # by class words
    every: int = 0  # main elements


def _walk(nodes: list, mass: dict[int, float], boxes: frozenset[int], loose: frozenset[int], layouts: frozenset[int]) -> Walked:
    """One pass over the nodes with a stack of open elements; what holds for an element is handed down, and what it holds is handed up.

    ``boxes`` are places of elements of which each counts as an article. Elements of
    the serial numbers ``loose`` are no asides, and class words of ``layouts`` say
    nothing. Unclosed elements end with their parents.
    """
    out, stack, open_names, serial = Walked(), [_Open()], Counter(), 0

    def pop() -> None:
        x = stack.pop()
        open_names[x.name] -= 1
        stack[-1].held += x.held
        stack[-1].mains += x.mains
        out.mains[x.serial] = x.mains
        if x.name == "form":
            out.forms[x.serial] = x.held
        if x.place >= 0:
            out.held[x.place] = x.held

    for k, n in enumerate(nodes):
        plain = inside = main = False
        for s in (n,) if isinstance(n, str) else _symbols(n):
            if s == SLOT:
                top = stack[-1]
                plain, inside, main = plain or not top.hidden, inside or (top.inside and not top.left_out), main or top.main
            elif s.startswith("/"):
                while open_names[s[1:]]:
                    last = stack[-1].name == s[1:]
                    pop()
                    if last:
                        break
            else:
                name = s.rstrip("!")
                while name not in IN_HEAD and open_names["head"]:  # its end tag may be left out
                    pop()
                if name not in VOID:
                    if name in ("p", "li") and stack[-1].name == name:
                        pop()
                    up = stack[-1]
                    word = s[-1] == "!" and serial not in layouts
                    if word:
                        out.marked.append(serial)
                    out.every += name in MAIN
                    aside = (word or (name in ASIDE and not (name == "header" and up.article))) and serial not in loose
                    here = isinstance(n, str)
                    box = here and k in boxes
                    left_out = False if box or not up.inside else up.left_out or ((word or (name in ASIDE and name != "header")) and serial not in loose)
                    if here:
                        out.around[k] = (up.hidden or aside, up.main)
                    stack.append(_Open(name, k if here else -1, serial, up.hidden or aside, up.article or name == "article", up.main or name in MAIN, up.inside or box, left_out, 0, int(name in MAIN)))
                    open_names[name] += 1
            serial += 1
        if mass.get(k):
            stack[-1].held += mass[k]
        out.plain.append(plain), out.inside.append(inside), out.main.append(main)
    while len(stack) > 1:
        pop()
    return out


def walk(nodes: list, mass: dict[int, float], boxes: frozenset[int] = frozenset()) -> Walked:
    """``_walk``, where a form with half of the text is no aside, and class words on an element that holds all main elements say nothing."""
    found, total = _walk(nodes, mass, boxes, frozenset(), frozenset()), sum(mass.values())
    loose = frozenset(k for k, held in found.forms.items() if total and 2 * held >= total)
    layouts = frozenset(k for k in found.marked if found.every and found.mains[k] == found.every)
    return _walk(nodes, mass, boxes, loose, layouts) if loose or layouts else found


def articles_of(nodes: list, mass: dict[int, tuple[int, int]], share: float = 0.8) -> frozenset[int]:
    """Places of the elements that are the article; empty if only the page is.

    ``mass`` has the characters and linked characters of places. The article is the
    innermost element that holds ``share`` of the text that is neither linked nor in
    an aside; nothing inside an article or main element, nor in a repeated group, is
    chosen. If it is an article or main element itself, all such count.
    """
    own = {k: chars - linked for k, (chars, linked) in mass.items()}
    found = walk(nodes, own)
    shown = {k: n for k, n in own.items() if found.plain[k]}
    if any(shown.values()) and len(shown) < len(own):
        found, own = walk(nodes, shown), shown
    total, best = sum(own.values()), None
    for k, (_, in_main) in found.around.items():
        if not in_main and total and nodes[k].rstrip("!") in BOXES and found.held.get(k, 0) >= share * total:
            best = k
    if best is None:
        return frozenset()
    if nodes[best] in MAIN:
        return frozenset(k for k, (hidden, in_main) in found.around.items() if nodes[k] in MAIN and not hidden and not in_main)
    return frozenset((best,))


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _streams(batches):
    for batch in text_slices(batches, "html"):
        folded = [dump([(n, False) for n in fold(tokens(page or "")[0])[0]]) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(folded, pa.string())], ["host", "stream"])


def _infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each group of rows sorted by group; holds one wrapper at a time."""
    now, name, wrapper = None, None, None
    for frame in frames:
        for group, host_, stream in zip(frame.group, frame.host, frame.stream, strict=True):
            if group != now:
                if wrapper is not None:
                    yield pd.DataFrame({"host": [name], "stream": [dump(wrapper)]})
                now, name, wrapper = group, host_, None
            wrapper = generalise(wrapper, load(stream))
    if wrapper is not None:
        yield pd.DataFrame({"host": [name], "stream": [dump(wrapper)]})


#: Least share of a host's text, and characters a page, that a place outside the article holds if its text is content all the same.
SIDE, SIDE_CHARS = 0.02, 40
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Reader:
    """A host's wrapper with its groups, the places of its articles, the places outside that hold much of its text, and its groups of links."""

    nodes: list[tuple]
    groups: set
    boxes: frozenset[int]
    large: frozenset[int]
    links: frozenset[int]

    @property
    def box(self) -> int | None:
        return min(self.boxes, default=None)


@lru_cache(maxsize=256)
def reader(written: str, mass: tuple[tuple[int, int, int], ...], pages: int = 0, seen: int = 3) -> Reader:
    """``mass`` lists place, characters and linked characters of all slots over the host's ``pages`` distinct pages."""
    wrapper = load(written)
    nodes = [n for n, _ in wrapper]
    total = sum(chars - linked for _, chars, linked in mass)
    large = frozenset(k for k, chars, linked in mass if 2 * linked < chars and chars - linked >= max(SIDE * total, SIDE_CHARS * pages))
    links = frozenset(k for k, chars, linked in mass if pages >= seen and isinstance(nodes[k], tuple) and linked >= 0.9 * chars)
    return Reader(wrapper, _groups(nodes), articles_of(nodes, {k: (c, x) for k, c, x in mass}), large, links)


def _placed(page: str, known: Reader) -> tuple[list[str], list[Block | None], dict[int, int]]:
    """Symbols and blocks of a page, and the wrapper's place of each symbol that has one."""
    symbols, blocks = tokens(page)
    nodes, covers = absorb(*fold(symbols), known.groups)
    return symbols, blocks, {p: a for a, b in align(known.nodes, nodes) if a is not None and b is not None for p in covers[b]}


#: How a block stands to the article.
HEADING, INSIDE, BESIDE = 3, 2, 1


def _read_slots(page: str, known: Reader) -> Iterator[tuple[int | None, int, Block]]:
    """``(wrapper place or None, flag, block)`` of each block: a ``HEADING`` of the article, ``INSIDE`` it, ``BESIDE`` it but perhaps content, or 0.

    A group of links is none of these unless a heading stands before it. A page on
    which the wrapper's articles hold less than half of the plain text, as one of
    another layout, is read by its own elements; without a wrapper the whole page is.
    """
    symbols, blocks, place = _placed(page, known)
    texts = {k: b.text() for k, b in enumerate(blocks) if b is not None}
    mass = {k: (len(t), min(blocks[k].linked, len(t))) for k, t in texts.items()}
    own = {k: chars - linked for k, (chars, linked) in mass.items()}
    boxes = frozenset(k for k, a in place.items() if a in known.boxes)
    found = walk(symbols, own, boxes)
    plain = sum(n for k, n in own.items() if found.plain[k] or found.inside[k])
    if known.nodes and (not boxes or 2 * sum(n for k, n in own.items() if found.inside[k]) < plain):
        boxes = articles_of(symbols, mass)
        found = walk(symbols, own, boxes)
    explicit = not boxes or any(symbols[k] in MAIN for k in boxes)
    regions = known.nodes and not MAIN.isdisjoint(symbols)
    inside = found.inside if boxes else [p and (m or not regions) for p, m in zip(found.plain, found.main, strict=True)]
    group, headed, before = None, False, False
    for k, text in texts.items():
        at, flag, heading = place.get(k), 0, k > 0 and symbols[k - 1].rstrip("!") in HEADINGS
        if at != group:
            group, headed = at, before
        before = heading
        if inside[k]:
            flag = HEADING if heading else INSIDE if at not in known.links or headed else 0
        elif not explicit and found.plain[k] and 2 * mass[k][1] < len(text):
            flag = BESIDE if (at in known.large if at is not None else own[k] >= max(SIDE * plain, SIDE_CHARS)) else 0
        yield at, flag, blocks[k]


def _key(place: int, text: str) -> str:
    return f"{place}:{xxhash.xxh3_64_hexdigest(text)}"


_MASS = pa.list_(pa.struct([("place", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64())]))


def _slots(batches):
    """For each page: a digest of its slots' texts, one key for each, an empty one, and how much text the wrapper's places hold."""
    for batch in text_slices(batches, "html"):
        pages, keys, masses = [], [], []
        for page, w in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper")), strict=True):
            _, blocks, place = _placed(page or "", reader(w, ()))
            found = [(place.get(k), block.text(), block.linked) for k, block in enumerate(blocks) if block is not None]
            pages.append(xxhash.xxh3_128_hexdigest("\0".join(text for _, text, _ in found)))
            keys.append(sorted({""} | {_key(at, text) for at, text, _ in found if at is not None and text}))
            mass: dict[int, list[int]] = {}
            for at, text, linked in found:
                if at is not None:
                    held = mass.setdefault(at, [0, 0])
                    held[0] += len(text)
                    held[1] += min(linked, len(text))
            masses.append([{"place": k, "chars": c, "linked": x} for k, (c, x) in mass.items()])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(pages, pa.string()), pa.array(keys, pa.list_(pa.string())), pa.array(masses, _MASS)], ["host", "page", "keys", "mass"])


def _extract(seen: int):
    def run(batches):
        for batch in text_slices(batches, "html"):
            texts = []
            for page, wrapper, fixed, mass, n in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "fixed", "mass", "n")), strict=True):
                fixed = set(fixed or ())
                known = reader(wrapper, tuple((m["place"], m["chars"], m["linked"]) for m in mass or ()), n or 0, seen)
                found = [(at, flag, t) for at, flag, block in _read_slots(page or "", known) if flag and (t := block.text())]
                told = [(flag, t) for at, flag, t in found if flag == HEADING or at is None or _key(at, t) not in fixed]
                if all(flag == HEADING for flag, _ in told):  # nothing of its own
                    told = [(flag, t) for _, flag, t in found if flag != BESIDE]
                texts.append("\n\n".join(t for _, t in told))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url")), pa.array(texts, pa.string())], ["id", "url", "text"])
    return run


def wrappers(pages: DataFrame, stage: Stage, fan: int = 32) -> DataFrame:
    """``(host, wrapper)`` inferred from all ``pages(host, html)``.

    A host's distinct streams are dealt in shares of about ``fan``, each of which
    becomes one partial wrapper; partial wrappers are dealt likewise until one is left.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = 0
    now = stage.put(pages.select("host", "html").mapInArrow(_streams, "host string, stream string").distinct(), "level-0")
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        if level and not counts.where("n > 1").head(1):
            break
        dealt = now.join(counts.hint("merge"), "host").withColumn("share", F.pmod(F.xxhash64("stream", F.lit(level)), F.ceil(F.col("n") / fan)))
        dealt = dealt.repartition(parts, "host", "share").sortWithinPartitions("host", "share", "stream").select(F.concat_ws(" ", "share", "host").alias("group"), "host", "stream")
        level += 1
        now = stage.put(dealt.mapInPandas(_infer, "host string, stream string"), f"level-{level}")
        stage.drop(f"level-{level - 1}")
    return stage.put(now.withColumnRenamed("stream", "wrapper"), "wrappers")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", seen: int = 3) -> DataFrame:
    """One row per page: ``id_column``, ``url_column``, ``text``: the article's blocks in page order, two line ends between.

    What a slot holds as one text on every page of a host, of at least ``seen`` that
    differ, and groups of links on such hosts, are template text there and left
    out, inside articles too; but headings stay, and so do links under one. A page
    that holds nothing else keeps it. Outside the article, where no article or main
    element marks it, a text is kept if it isn't template and its place holds a
    fiftieth of the host's text, ``SIDE_CHARS`` characters a page, and less than
    half of it linked.

    * null or empty html, and pages without content, give an empty text;
    * a null or odd URL belongs to the empty host;
    * repeated rows stay and are read alike; of equal pages one speaks for the host;
    * other columns are ignored; an empty table gives no rows.
    """
    stage = Stage(pages.sparkSession, "wrapper")
    rows = clash_free(pages, id=id_column, url=url_column, html=html_column).withColumn("host", host(F.col("url")))
    found = wrappers(rows, stage)
    slots = rows.join(stage.small(found, "wrappers"), "host").select("host", "html", "wrapper").mapInArrow(_slots, "host string, page string, keys array<string>, mass array<struct<place:int,chars:bigint,linked:bigint>>")
    slots = stage.put(slots.dropDuplicates(["host", "page"]), "slots")
    counts = stage.put(slots.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")), "counts")
    every = counts.where("key = ''").select("host", "n")
    fixed = counts.where(f"key <> '' AND n >= {seen}").join(every.hint("merge"), ["host", "n"]).groupBy("host").agg(F.collect_list("key").alias("fixed"))  # slots of one wrapper
    mass = slots.select("host", F.explode("mass").alias("m")).groupBy("host", "m.place").agg(F.sum("m.chars").alias("chars"), F.sum("m.linked").alias("linked"))
    mass = mass.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "chars", "linked"))).alias("mass"))  # places of one wrapper
    known = found.join(every.hint("merge"), "host", "left").join(fixed.hint("merge"), "host", "left").join(mass.hint("merge"), "host", "left")
    known = stage.put(known, "known")
    full = rows.join(stage.small(known, "known"), "host").select("id", "url", "html", "wrapper", "fixed", "mass", "n")
    kind = rows.schema["id"].dataType.simpleString()
    out = full.mapInArrow(_extract(seen), f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text")
