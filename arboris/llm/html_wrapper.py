"""Main text of web pages by union-free wrappers of their hosts.

A page's tokens (tags and runs of text with their inline markup) are nested by
their block elements. The wrapper of a host starts as the first of its pages
and is aligned with the next ones, one by one, level by level: equal texts stay
fixed, differing texts become slots, tags that only one side has become optional
groups, and runs of a tag or of a short sequence of tags become repeated groups.
The result is a regular expression without unions: tags, slots, ``?`` and ``+``.

All pages of a host are aligned: in order of a hash of page_id, first in cells
of some thousands of pages (so a host with most of the pages is many tasks'
work), then the cells' wrappers with each other. What moves between the tasks is
a page's expression, in which texts are hashes and repeats are folded, not its
html. A task holds one wrapper at a time.

The wrapper decides what a page's text is (``judged``):

* The article is found by its slots: an ``article`` or ``main`` that holds a
  fair share of the slots' running text, else the innermost element that holds
  most of it. Text that is the same on all pages weighs nothing.
* In it, fixed texts and elements without a slot are template and go; headings
  stay. How likely a text is fixed follows the number of titles (at most TITLES)
  of the pages it stands on and its length: each further title speaks for it,
  each doubling of the length against it. Pages that share a title are versions
  of one document. A short line on two pages is template, a long passage only on
  several; a page alone has no fixed texts.
* Names of elements and lists of links only tip a balance (``speaks``): how often
  such an element stands at this place on pages of other titles, whether running
  text stands on both sides of it, how much running text it holds and what kind of
  element it is count as well. A paragraph or a list of references amid the
  article stays whatever it is called.

Every page is matched with its host's wrapper and read by it. Parts that the
wrapper doesn't have are the page's own: they are judged by the page alone, as are
pages in which the wrapper's article is missing. What HTML itself calls no article
(nav, aside, footer, form, ...) goes; mathematics is text.

A wrapper stays small while it is aligned: of a sequence of more than WIDE items the
optional ones seen under one title become rows, but for those with the least hashes
of their tags. Rows of the same place (the tags around it) and name are united by a
shuffle over all cells of the host; those seen under several titles in all come back
into the wrapper (``restored``), where pages find them by place and name, whatever
their order. So a part gathers all its evidence, however seldom it comes. What is
left out has one title in the whole host: of it the page itself knows as much, and
judges it (``alone``). A host's wrapper is sent once to each cell of its pages.

Defined results: null or empty html gives an empty text; a null url belongs to
the host ``''``; broken and deeply nested markup is read as far as it goes;
repeated rows give equal results and change no wrapper; other columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.llm.common import small_batches, staged

#: Wrappers up to this many bytes in all are broadcast.
BROADCAST_BYTES = 8 << 20
#: Titles that are counted for a text or element.
TITLES = 5
#: Items of a sequence of a wrapper from which those of single titles become rows.
WIDE = 256
#: Expressions that one task aligns with each other before their wrappers meet.
CELL = 512

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>|<[a-zA-Z/][^<>]*+\Z""",
    re.S,
)
_CARES = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg canvas annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div form main section table tbody td tr".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("p blockquote pre figcaption dd dt".split())
#: Elements that never are article, and words that speak against others unless their names begin with one of PARTS; names
#: of several parts speak only if their other parts are of STRUCTURE.
NEVER = frozenset("head title nav footer aside button select menu dialog label input option".split()) | RAW
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager search complementary contentinfo".split()
)
PARTS = frozenset("has no with is without entry post article content page".split())
STRUCTURE = frozenset("area bar block body bottom box center column container content element form group inner item items left line link links list main mobile module outer panel posts right row section site slot small sticky text top unit widget wrap wrapper zone".split())


class Node:
    """An element, or a text chunk (name ``#``). ``gone``: no article by what HTML says; ``named``: words of its attributes speak against it."""

    __slots__ = ("sig", "name", "kids", "text", "gone", "named", "blocks", "core", "size")

    def __init__(self, sig: str, name: str, text: str = "", gone: bool = False, named: bool = False):
        self.sig, self.name, self.kids, self.text, self.gone, self.named = sig, name, [], text, gone, named
        self.blocks = self.core = False
        self.size = 0


def _attributes(name: str, attrs: str) -> tuple[str, bool, bool]:
    """Signature of a tag, whether its words speak against it, and whether it is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    tokens = [w for a in ("class", "id", "role") for w in found.get(a, "").lower().split()]
    named = False
    for t in tokens:
        parts = [p for p in re.split(r"[-_]+", t) if p and not p.isdigit()]
        named |= bool(parts) and parts[0] not in PARTS and not WORDS.isdisjoint(parts) and all(p in WORDS or p in STRUCTURE for p in parts)
    style = found.get("style", "").lower().replace(" ", "")
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    if name in ("html", "body", "article", "main"):
        return f"{name} !" if named and name != "body" else name, named, hidden
    marks = " ".join(f"{a}={found[a]}" for a in ("class", "id", "role") if found.get(a))
    return f"{name} {re.sub(r'[0-9]+', '0', marks)}".strip(), named, hidden  # numbers in names are mostly the page's own


def parse(page: str) -> Node:
    """Tree of a page; missing end tags are supplied, stray ones are skipped."""
    root = Node("", "")
    stack = [root]
    pos = 0
    known: dict[tuple[str, str], tuple[str, bool, bool]] = {}
    open_: Counter[str] = Counter()

    def cut(at: int) -> None:
        for x in stack[at:]:
            open_[x.name] -= 1
        del stack[at:]

    while pos < len(page):
        m = _TAG.search(page, pos)
        text = page[pos : m.start() if m else len(page)]
        if text and (stack[-1].kids or not text.isspace()):
            chunk = Node("#", "#", text if not text.isspace() else " ")
            chunk.size = len(text.strip())
            stack[-1].kids.append(chunk)
        if not m:
            break
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if open_[name]:
                cut(max(i for i, x in enumerate(stack) if x.name == name) if stack[-1].name != name else len(stack) - 1)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if not attrs or not _CARES.search(attrs):
            sig, named, hidden = name, False, False
        else:
            if (name, attrs) not in known:
                known[name, attrs] = _attributes(name, attrs)
            sig, named, hidden = known[name, attrs]
        if open_["p"] and name in CLOSES_P:
            i = max(i for i, x in enumerate(stack) if x.name == "p")
            if not any(x.name in ("td", "th", "button", "object") for x in stack[i:]):
                cut(i)
        if name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ("ul", "ol", "dl", "table", "select"):
                    break
                if stack[i].name in SIBLINGS[name]:
                    cut(i)
        inside = name == "header" and any(x.core and x.name in ("article", "main") for x in stack)
        gone = name in NEVER or hidden or (name == "header" and not inside)
        node = Node(sig, name, gone=gone, named=named and name not in HEADINGS and name not in ("body", "html"))
        stack[-1].kids.append(node)
        if name in BLOCK:
            for x in reversed(stack):
                if x.blocks:
                    break
                x.blocks = True
        if name == "h1" or (name in ("article", "main") and not named):
            # what holds the title or the article isn't told by its name; nav, footer and the like stay what they are
            for x in (node, *reversed(stack)):
                if x.name in NEVER or x.name == "header":
                    break
                x.core, x.gone, x.named = True, x.gone and hidden, False
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(node)
            open_[name] += 1
    order = [root]
    for x in order:
        order.extend(x.kids)
    for x in reversed(order):
        for k in x.kids:
            x.size += k.size
    for x in order:
        if x.name == "form":  # one around the whole page holds its text
            x.gone = x.gone or 2 * x.size < root.size
    return root


def inner_text(node: Node) -> tuple[str, int, int]:
    """Text of an inline node or chunk without what is gone, its length in links, and how many links it has."""
    out, linked, links, stack = [], 0, 0, [(node, False)]
    while stack:
        x, in_link = stack.pop()
        if x.name == "#":
            out.append(x.text)
            linked += len(x.text) if in_link else 0
        elif not x.gone:
            links += x.name == "a"
            out.append(" " if x.name == "br" else "")
            stack.extend((k, in_link or x.name == "a") for k in reversed(x.kids))
    return "".join(out), linked, links


# --- wrappers -----------------------------------------------------------------


class Item:
    """Part of a wrapper: a tag with its content, a group of tags (sig ``()``), or a text (``#``).

    ``text`` is a hash (0: none), ``titles`` the least TITLES hashes of titles of the pages it stands on, ``seen`` how
    often it does, ``verdict`` what ``judged`` makes of it: ``A`` article, ``T`` template, ``N`` no article by its place
    and name, ``M`` no article as a list of links. ``nodes`` are a page's own nodes.

    ``rest`` are parts, by name, that made room in ``kids``, which is ``narrowed`` then; ``after`` names what stood before such a
    part, and a ``spare`` one has come back. ``spares`` are all of a wrapper, by place and name."""

    __slots__ = ("sig", "many", "optional", "slot", "gone", "named", "kids", "text", "titles", "seen", "chars", "linked", "links", "verdict", "nodes", "rest", "after", "narrowed", "spare", "spares")

    def __init__(self, sig: str, gone: bool = False, named: bool = False):
        self.sig, self.gone, self.named, self.seen = sig, gone, named, 1
        self.many = self.optional = self.slot = self.narrowed = self.spare = False
        self.rest: dict[str, Item] | None = None
        self.spares: dict[tuple[str, str], Item] | None = None
        self.after = ""
        self.kids: list[Item] = []
        self.text = self.chars = self.linked = self.links = 0
        self.titles: tuple[int, ...] = ()
        self.verdict = ""
        self.nodes: list[Node] = []

    @property
    def name(self) -> str:
        return self.sig.partition(" ")[0]

    def key(self) -> tuple:
        return (self.sig, *(k.sig for k in self.kids)) if self.sig == "()" else (self.sig,)

    def called(self) -> str:
        """Name of a part at its place; a text that doesn't change is called by itself."""
        return f"# {self.text:x}" if self.sig == "#" and not self.slot else self.sig

    def inside(self, place: str) -> str:
        """Place of what is in it; groups are none."""
        return place if self.sig == "()" else xxhash.xxh3_64_hexdigest(f"{place} {self.sig}".encode("utf-8", "surrogatepass"))

    def __str__(self) -> str:
        return run_deep(self._str())

    def _str(self):
        parts = []
        for kid in self.kids:
            parts.append((yield kid._str()))
        inner = "".join(parts)
        core = ("#" if self.slot else f"{self.text:x}") if self.sig == "#" else inner if self.sig in ("()", "") else f"<{self.sig}>{inner}</>"
        mark = "*" if self.many and self.optional else "+" if self.many else "?" if self.optional else ""
        return f"({core}){mark}" if mark else core


def run_deep(step):
    """Result of a generator that yields generators for what they return: recursion on a stack of its own."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))


def _title(root: Node) -> int:
    """Hash of what a page calls itself: its title, else its first heading, else its whole text."""
    for name in ("title", "h1"):
        stack = [root]
        while stack:
            x = stack.pop()
            if x.name == name and x.size:
                return text_hash("".join(k.text for k in x.kids) or inner_text(x)[0])
            stack.extend(reversed(x.kids))
    return text_hash(inner_text(root)[0])


def expression(root: Node) -> Item:
    """A page as the wrapper of itself alone."""
    out = Item("")
    out.titles = (_title(root),)
    out.kids = run_deep(_items(root, out.titles))
    return out


def _items(node: Node, titles: tuple[int, ...]):
    out: list[Item] = []
    run: list[Node] = []

    def flush() -> None:
        if not run:
            return
        parts = [inner_text(x) if x.name != "#" else (x.text, 0, 0) for x in run]
        whole = "".join(p[0] for p in parts)
        if whole.strip():
            # inline elements are judged by their names only where they stand alone
            item = Item("#", named=all(x.named or not parts[i][0].strip() for i, x in enumerate(run)))
            item.text, item.titles, item.nodes = text_hash(whole), titles, list(run)
            item.chars, item.linked, item.links = len(whole), sum(p[1] for p in parts), sum(p[2] for p in parts)
            out.append(item)
        run.clear()

    for kid in node.kids:
        if kid.name not in BLOCK and not kid.blocks:
            run.append(kid)
            continue
        flush()
        item = Item(kid.sig, kid.gone, kid.named)
        item.nodes, item.titles = [kid], titles
        item.kids = [] if kid.gone else (yield _items(kid, titles))
        out.append(item)
    flush()
    return (yield _folded(out))


def _folded(seq: list[Item]):
    """Runs of one item, then of short sequences of items, made into repeated groups."""
    for width in (1, 2, 3):
        keys = [x.key() for x in seq]
        starts = [i for i in range(len(seq) - 2 * width + 1) if keys[i] == keys[i + width] and keys[i : i + width] == keys[i + width : i + 2 * width]]
        if not starts:
            continue
        out: list[Item] = []
        i = 0
        for start in starts:
            if start < i or (width > 1 and len(set(keys[start : start + width])) == 1):
                continue
            out += seq[i:start]
            j = start + width
            while keys[j : j + width] == keys[start : start + width]:
                j += width
            first = seq[start : start + width]
            for at in range(start + width, j, width):
                pairs, first = list(zip(first, seq[at : at + width])), []
                for a, b in pairs:
                    first.append((yield _merged(a, b)))
            if width == 1:
                first[0].many = True
                out.append(first[0])
            else:
                group = Item("()")
                group.kids, group.many = first, True
                out.append(group)
            i = j
        seq = out + seq[i:]
    return seq


def _merged(a: Item, b: Item, wide: float = WIDE):
    """One item that covers both; sequences of more than ``wide`` items are narrowed."""
    out = Item(a.sig, a.gone and b.gone, a.named and b.named)
    out.seen = a.seen + b.seen
    out.many, out.optional = a.many or b.many, a.optional or b.optional
    out.chars, out.linked, out.links = a.chars + b.chars, a.linked + b.linked, max(a.links, b.links)
    out.titles = tuple(sorted({*a.titles, *b.titles})[:TITLES])
    out.nodes, out.after, out.narrowed = a.nodes + b.nodes, a.after, a.narrowed or b.narrowed
    out.rest = a.rest or b.rest
    if a.rest and b.rest:
        for name, x in b.rest.items():
            a.rest[name] = (yield _merged(a.rest[name], x, wide)) if name in a.rest else x
    if a.sig == "#":
        out.slot, out.text = a.slot or b.slot or a.text != b.text, min(a.text, b.text)
    else:
        out.kids = yield _aligned(a.kids, b.kids, out, wide)
    return out


def _grouped(seq: list[Item], other: list[Item]) -> list[Item]:
    """``seq`` with what ``other`` has as a group of tags made such a group, if it stands there but once."""
    for group in other:
        if group.sig != "()":
            continue
        sigs, i, out = [k.sig for k in group.kids], 0, []
        while i < len(seq):
            if [x.sig for x in seq[i : i + len(sigs)]] == sigs:
                one = Item("()")
                one.kids = seq[i : i + len(sigs)]
                out.append(one)
                i += len(sigs)
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal keys, ascending in both, in memory and time about linear in the lengths.

    What both begin and end with is taken; between, keys that stand once in both are anchors (the longest chain of
    them that ascends) and the gaps are treated alike; a gap without anchors takes each key's next place.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        n, m = Counter(a[i:ie]), Counter(b[j:je])
        place = {k: y for y, k in enumerate(b[j:je], j) if m[k] == 1}
        single = [(x, place[k]) for x, k in enumerate(a[i:ie], i) if n[k] == 1 and k in place]
        if single:
            ends, tails, before = [], [], {}  # longest ascending chain
            for x, y in single:
                at = bisect_left(ends, y)
                before[x, y] = tails[at - 1] if at else None
                ends[at : at + 1], tails[at : at + 1] = [y], [(x, y)]
            chain, p = [], tails[-1]
            while p:
                chain.append(p)
                p = before[p]
            for x, y in [*chain[::-1], (ie, je)]:
                todo.append((i, x, j, y))
                if x < ie:
                    out.append((x, y))
                i, j = x + 1, y + 1
            continue
        places: dict = {}
        for y in range(je - 1, j - 1, -1):
            places.setdefault(b[y], []).append(y)
        last = j - 1
        for x in range(i, ie):
            ys = places.get(a[x], [])
            while ys and ys[-1] <= last:
                ys.pop()
            if ys:
                last = ys.pop()
                out.append((x, last))
    return sorted(out)


def _aligned(a: list[Item], b: list[Item], up: Item, wide: float):
    """Two sequences as one, the kids of ``up``: common items merged, the others optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    out: list[Item] = []
    i = j = 0
    for x, y in [*common([x.key() for x in a], [x.key() for x in b]), (len(a), len(b))]:
        for own in (*a[i:x], *b[j:y]):
            own.optional = True
            out.append(own)
        if x < len(a):
            out.append((yield _merged(a[x], b[y], wide)))
        i, j = x + 1, y + 1
    if len(out) > wide:
        single = sorted((xxhash.xxh3_64_intdigest(x.sig.encode("utf-8", "surrogatepass")), at) for at, x in enumerate(out) if x.optional and len(x.titles) <= 1 and not x.nodes)
        room = {at for _, at in single[int(wide) // 2 :]}
        left, last = [], ""
        for at, x in enumerate(out):
            if at not in room:
                left.append(x)
                last = x.called()
                continue
            up.narrowed, up.rest = True, up.rest or {}
            for one in x.kids if x.sig == "()" else [x]:
                one.after, name = last, one.called()
                up.rest[name] = (yield _merged(up.rest[name], one, wide)) if name in up.rest else one
        out = left
    return out if len(out) == len(a) == len(b) else (yield _folded(out))


def merged(a: Item, b: Item) -> Item:
    """The wrapper of two wrappers' pages."""
    return run_deep(_merged(a, b))


def infer(pages: list[str]) -> Item:
    """Wrapper of some pages of a host."""
    wrapper: Item | None = None
    for page in pages:
        new = load(dump(expression(parse(page))))
        wrapper = new if wrapper is None else merged(wrapper, new)
    return restored(wrapper, sorted(rest_rows(wrapper))) if wrapper is not None else Item("")


def rest_rows(wrapper: Item, place: str = "", depth: int = 0) -> Iterator[tuple[int, str, str, str, str]]:
    """depth, place, name, what stood before, and the part as text, of all that made room in a wrapper or part."""
    todo = [(wrapper, place, depth)]
    while todo:
        x, place, depth = todo.pop()
        inner, deeper = x.inside(place), depth + (x.sig != "()")
        for name, one in (x.rest or {}).items():
            yield deeper, inner, name, one.after, dump(one)
            todo.append((one, inner, deeper))
        todo.extend((k, inner, deeper) for k in x.kids)


def places(wrapper: Item, place: str = "") -> Iterator[tuple[Item, str, Item]]:
    """Each item that is no group, with its place and what it stands in."""
    todo = [(wrapper, place)]
    while todo:
        x, place = todo.pop()
        inner = x.inside(place)
        for k in x.kids:
            if k.sig != "()":
                yield k, inner, x
            todo.append((k, inner))


def restored(wrapper: Item, rows: Iterable[tuple[int, str, str, str, str]]) -> Item:
    """``wrapper`` with the parts in ``rows`` (as ``rest_rows`` has them, ascending, each place and name once) that have several titles in all."""
    at: dict[str, list[Item]] = {}
    names: dict[tuple[str, str], Item] = {}

    def learn(x: Item, place: str) -> None:
        for y, where, up in [(x, place, None), *places(x, place)]:
            if y.sig != "()":
                at.setdefault(y.inside(where), []).append(y)
                if up is not None:
                    names.setdefault((where, y.called()), y)

    for _, place, name, after, part in rows:
        if not at:
            learn(wrapper, "")
        one = load(part, False)
        if (place, name) in names:
            own = names[place, name]
            if len({*own.titles, *one.titles}) > 1:
                new = run_deep(_merged(own, one, math.inf))
                new.optional, new.spare, new.after = own.optional, own.spare, own.after
                for slot in Item.__slots__:
                    setattr(own, slot, getattr(new, slot))
                for y, where, _ in places(own, place):
                    at.setdefault(y.inside(where), []).append(y)
                    names.setdefault((where, y.called()), y)
        elif len(one.titles) > 1 and place in at:
            one.spare = one.optional = True
            ups = at[place]
            up, i = next(((u, i) for u in ups for i, k in enumerate(u.kids) if k.called() == after), (ups[0], -1 if not after else len(ups[0].kids) - 1))
            up.kids.insert(i + 1, one)
            names[place, name] = one
            learn(one, place)
    return _indexed(wrapper)


def _indexed(wrapper: Item) -> Item:
    wrapper.spares = {(place, x.called()): x for x, place, _ in places(wrapper) if x.spare} or None
    return wrapper


def _fixed(x: Item) -> bool:
    """Whether a text that doesn't change is likelier template than the pages' own: odds by titles and by length."""
    if x.sig != "#" or x.slot or len(x.titles) < 2:
        return False
    return -1.5 + (len(x.titles) - 1) + max(-1.0, min(1.0, 0.75 * math.log2(120 * x.seen / max(x.chars, 1)))) > 0


def speaks(x: Item, chars: int, linked: int, links: int, first: bool, last: bool, said: bool) -> float:
    """How much speaks against an element of the article: over 1, it goes. ``first``: no running text before it; ``last``:
    none after it; ``said``: the page says itself which element the article is, so that links at its end are its own."""
    listed = x.name in BLOCK and chars > 0 and linked >= 0.8 * chars and (x.many or links >= 3)
    if not x.named and not listed:
        return 0.0
    kind = 2.5 * (x.name in RUNNING) + (chars - 2 * linked >= 120 * x.seen)
    out = 1.0 + (first or (last and not said)) - 0.5 * said if listed else 0.0
    if x.named:
        out += 2.5 + (first or last) + min(len(x.titles) - 1, 3) * 0.5 - said
    return out - kind


def judged(wrapper: Item) -> Item:
    """``wrapper`` with its article, and what in it is template or no article, marked."""
    rows: list[tuple[Item, int, int]] = []  # item, depth, weight
    sums: dict[int, tuple[int, int, int, int]] = {}

    def walk(x: Item, depth: int, inside: bool):
        """Running text, all text, linked text, most links and whether a slot is below an item; ``inside`` what speaks against itself."""
        x.verdict = ""
        if x.sig == "#":
            fixed = _fixed(x)
            x.verdict = "T" if fixed else ""
            sums[id(x)] = (0 if fixed else x.chars - 2 * x.linked, x.chars, x.linked, x.links)
            return (*sums[id(x)], not fixed)
        weight = chars = linked = links = own = 0
        slots, at = False, len(rows)
        if not inside:
            rows.append((x, depth, 0))
        for kid in x.kids:
            if kid.gone:
                continue
            w, c, ln, n, s = yield walk(kid, depth + 1, inside or kid.named)
            chars, linked, links, slots, own = chars + c, linked + ln, max(links, n), slots or s, own + w
            weight += 0 if kid.named else w
        x.verdict = "T" if chars and not slots and x.name not in HEADINGS else ""
        if not inside:
            rows[at] = (x, depth, 0 if chars and linked >= 0.8 * chars and (x.many or links >= 3) else weight)
        sums[id(x)] = (own, chars, linked, links)
        return weight if not inside else own, chars, linked, links, slots

    run_deep(walk(wrapper, 0, False))
    for x, *_ in rows:
        if x.name in HEADINGS:
            for kid in x.kids:
                kid.verdict = ""
    top = max((w for _, _, w in rows), default=0)
    found, said = None, False
    if top > 0:
        for names in (("article",), ("main",)):
            own = [(w, -i) for i, (x, _, w) in enumerate(rows) if w >= 0.3 * top and (x.name in names or ("main" in names and "role=main" in x.sig))]
            if own and found is None:
                found, said = rows[-max(own)[1]][0], True
        if found is None:
            fit = [(d, -i) for i, (x, d, w) in enumerate(rows) if w >= 0.7 * top and (x.name in CONTAINERS or x is wrapper)]
            found = rows[-max(fit)[1]][0] if fit else None
    for x in [found] if found is not None else [wrapper]:
        _weigh(x, sums, said)
    if found is not None:
        found.verdict = "A"
    return _without_idle(wrapper) if wrapper.spares else wrapper


def _without_idle(wrapper: Item) -> Item:
    """``wrapper`` without spare parts in which nothing is marked, named or linked: without them pages read the same."""

    def idle(x: Item) -> bool:
        todo = [x]
        for y in todo:
            if y.verdict or y.named or y.links:
                return False
            todo.extend(y.kids)
        return True

    todo = [wrapper]
    while todo:
        x = todo.pop()
        x.kids = [k for k in x.kids if not (k.spare and idle(k))]
        todo.extend(x.kids)
    return _indexed(wrapper)


def _weigh(article: Item, sums: dict[int, tuple[int, int, int, int]], said: bool) -> None:
    """Mark elements of the article that more speaks against than for."""
    order: list[tuple[Item, int]] = []  # items in page order, with the running text before them
    ends: dict[int, int] = {}
    before, stack = 0, [(article, False)]
    while stack:
        x, leaving = stack.pop()
        if leaving:
            ends[id(x)] = before
            continue
        order.append((x, before))
        if x.sig == "#":
            before += max(0, sums[id(x)][0]) if not x.named else 0
            ends[id(x)] = before
            continue
        stack.append((x, True))
        if x.name not in HEADINGS:
            stack.extend((k, False) for k in reversed(x.kids) if not k.gone)
    for x, at in order:
        if x is article or x.sig == "()" or not (x.named or x.links or sums[id(x)][3]):
            continue
        _, chars, linked, links = sums[id(x)]
        if speaks(x, chars, linked, links, at <= 0, ends[id(x)] >= before, said) > 1:
            x.verdict = "N" if x.named else "M"


def dump(wrapper: Item) -> str:
    """A wrapper as text: its items in order, each with the number of items in it."""
    out, stack = [], [wrapper]
    while stack:
        x = stack.pop()
        flags = x.many | x.optional << 1 | x.slot << 2 | x.gone << 3 | x.named << 4 | x.spare << 5 | x.narrowed << 6
        out.append([x.sig, flags, x.text, x.seen, x.chars, x.linked, x.links, list(x.titles), x.verdict, len(x.kids)])
        stack.extend(reversed(x.kids))
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def load(text: str, whole: bool = True) -> Item:
    """The wrapper, or, if not ``whole``, part of one, of a text."""
    root = Item("")
    spare = False
    open_: list[tuple[Item, int]] = []
    for i, (sig, flags, hash_, seen, chars, linked, links, titles, verdict, kids) in enumerate(json.loads(text)):
        x = root if i == 0 else Item(sig)
        x.sig = sig
        x.many, x.optional, x.slot, x.gone, x.named, x.spare, x.narrowed = (bool(flags & 1 << k) for k in range(7))
        spare |= x.spare
        x.seen = seen
        x.text, x.chars, x.linked, x.links, x.titles, x.verdict = hash_, chars, linked, links, tuple(titles), verdict
        if open_:
            up, left = open_.pop()
            up.kids.append(x)
            if left > 1:
                open_.append((up, left - 1))
        if kids:
            open_.append((x, kids))
    return _indexed(root) if whole and spare else root


# --- reading pages ------------------------------------------------------------


def matched(page: Item, wrapper: Item) -> tuple[dict[int, str], set[int], set[int]]:
    """Verdicts on a page's nodes (by id), of the parts that its wrapper has; the named ones among these parts; and the
    nodes ``alone``, of parts that the wrapper lacks where some made room and had no second title."""
    out: dict[int, str] = {}
    met: set[int] = set()
    alone: set[int] = set()
    spares = wrapper.spares or {}
    todo = [(page, wrapper, "")]
    while todo:
        own, known, place = todo.pop()
        for node in own.nodes:
            if own.named:
                met.add(id(node))
            if known.verdict and (own.sig != "#" or known.verdict != "T" or known.text == own.text):
                out[id(node)] = known.verdict
        kids = [x for x in known.kids if not x.spare] if spares else known.kids
        inner = own.inside(place) if spares else ""
        a, b = _grouped(own.kids, kids), _grouped(kids, own.kids)
        pairs = common([x.key() for x in a], [x.key() for x in b])
        todo.extend((a[x], b[y], inner) for x, y in pairs)
        if spares or known.narrowed:
            in_order = {x for x, _ in pairs}
            for x in (one for i, y in enumerate(a) if i not in in_order for one in (y.kids if y.sig == "()" else [y])):
                spare = spares.get((inner, x.called()))
                if spare is not None:
                    todo.append((x, spare, inner))
                elif known.narrowed:
                    stack = [x]
                    for y in stack:
                        alone.update(map(id, y.nodes))
                        stack.extend(y.kids)
    return out, met, alone


def verdicts(page: Item) -> dict[int, str]:
    """The same by the page's own expression."""
    out, todo = {}, [judged(page)]
    while todo:
        x = todo.pop()
        out |= {id(node): x.verdict for node in x.nodes if x.verdict}
        todo.extend(x.kids)
    return out


def _articles(root: Node, marks: dict[int, str]) -> list[Node]:
    """Outermost nodes marked as article, in order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if marks.get(id(x)) == "A":
            out.append(x)
        else:
            stack.extend(reversed(x.kids))
    return out


def blocks(node: Node, marks: dict[int, str]) -> list[str]:
    """Texts of the blocks below ``node`` but for what is marked or gone, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        x, leaving = stack.pop()
        if leaving:
            flush()
        elif x is not node and (x.gone or marks.get(id(x)) in ("T", "N", "M")):
            if x.name in BLOCK:
                flush()
        elif x.name == "#":
            run.append(x.text)
        else:
            if x.name in BLOCK:
                flush()
                stack.append((x, True))
            elif x.name == "br":
                run.append(" ")
            stack.extend((k, False) for k in reversed(x.kids))
    flush()
    return out


def extract(page: str | None, wrapper: Item | None) -> str:
    """Main text of a page by its host's judged wrapper; by the page alone without one, or if it has no article there."""
    if not page:
        return ""
    root = parse(page)
    own = expression(root)
    if wrapper is not None:
        marks, met, alone = matched(own, wrapper)
        if wrapper.verdict != "A":
            articles = _articles(root, marks)
        else:
            articles = [root]
        marks |= {k: v for k, v in verdicts(own).items() if k not in marks and ((v == "N" and k not in met) or (v in ("N", "M") and k in alone))}
        found = [b for x in articles for b in blocks(x, marks)]
        if found:
            return "\n".join(found)
    marks = verdicts(own)
    return "\n".join(b for x in _articles(root, marks) or [root] for b in blocks(x, marks))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


_REST = "depth int, place string, name string, after string"


def _merge_cells(rows: DataFrame) -> DataFrame:
    """One wrapper for each host and cell of ``rows`` (host, cell, h, part): a task aligns sorted rows as they come. Rows with
    a place are parts that made room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wrapper, seen = None, None, None
        for b in batches:
            for host, cell, part in zip(*(b.column(i).to_pylist() for i in range(3))):
                if at != (host, cell):
                    if at is not None:
                        yield from _parts(*at, wrapper)
                    at, wrapper = (host, cell), load(part)
                elif part != seen:  # a repeated row changes nothing
                    wrapper = merged(wrapper, load(part))
                seen = part
        if at is not None:
            yield from _parts(*at, wrapper)

    dealt = rows.repartition("host", "cell").sortWithinPartitions("host", "cell", "h", "part").select("host", "cell", "part")
    return small_batches(dealt).mapInArrow(run, f"host string, cell long, part string, {_REST}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "cell", "part", "depth", "place", "name", "after"])


def _parts(host: str, cell: int, x: Item, own: tuple = (None,) * 4) -> Iterator[pa.RecordBatch]:
    """Rows of a wrapper, or of a part (``own``: its depth, place, name and what stood before), and of what made room in it."""
    yield _batch([(host, cell, dump(x), *own)])
    rows: list[tuple] = []
    for depth, place, name, after, part in rest_rows(x, own[1] or "", own[0] or 0):
        rows.append((host, cell, part, depth, place, name, after))
        if len(rows) == 256:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _united(rest: DataFrame) -> DataFrame:
    """``rest`` with one row for each host, place and name, beside rows of what made room in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, own = None, None, None
        for b in batches:
            for host, part, depth, place, name, after in zip(*(b.column(i).to_pylist() for i in range(6))):
                if at != (host, place, name):
                    if at is not None:
                        yield from _parts(at[0], 0, x, own)
                    at, x, own = (host, place, name), load(part, False), (depth, place, name, after)
                else:
                    x = merged(x, load(part, False))
        if at is not None:
            yield from _parts(at[0], 0, x, own)

    dealt = rest.repartition("host", "place", "name").sortWithinPartitions("host", "place", "name", "after", "part")
    return small_batches(dealt.select("host", "part", "depth", "place", "name", "after")).mapInArrow(run, f"host string, cell long, part string, {_REST}")


def _finished(learnt: DataFrame, rest: DataFrame | None) -> DataFrame:
    """host and its judged wrapper, of unjudged ones with the parts (united) that come back into them."""
    rows = learnt.select("host", "part", *(F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in _REST.split(", "))))
    if rest is None:
        dealt = rows
    else:
        back = rest.select(*rows.columns)
        dealt = rows.unionByName(back).repartition("host").sortWithinPartitions("host", F.col("depth").asc_nulls_first(), "place", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hosts() -> Iterator[tuple[str, str, list[tuple]]]:
            at, first, more = None, "", []
            for b in batches:
                for host, part, depth, place, name, after in zip(*(b.column(i).to_pylist() for i in range(6))):
                    if depth is None:
                        if at is not None:
                            yield at, first, more
                        at, first, more = host, part, []
                    else:
                        more.append((depth, place, name, after, part))
            if at is not None:
                yield at, first, more

        for host, part, more in hosts():
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([dump(judged(restored(load(part), more)))])], ["host", "wrapper"])

    return small_batches(dealt).mapInArrow(run, "host string, wrapper string")


def _known(learnt: DataFrame) -> DataFrame:
    """host, place and name of each item of the wrappers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, part in zip(*(b.column(i).to_pylist() for i in range(2))):
                found = sorted({(place, x.called()) for x, place, _ in places(load(part))})
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], ["host", "place", "name"])

    return small_batches(learnt.select("host", "part")).mapInArrow(run, "host string, place string, name string")


def wrappers(pages: DataFrame, cell: int = CELL) -> DataFrame:
    """host and its judged wrapper, as text, from all ``pages`` (page_id, url, html)."""
    rows = pages.where(F.length("html") > 0).select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id").alias("h"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([dump(expression(parse(x.as_py()))) for x in b.column(2)], pa.string())], ["host", "h", "part"])

    cells = 1 << max(0, (-(-pages.count() // cell) - 1).bit_length())
    parts = small_batches(rows).mapInArrow(run, "host string, h long, part string")
    parts = parts.withColumn("cell", F.pmod("h", F.lit(cells)))
    room = []
    while True:
        level = staged(_merge_cells(parts), "cells")
        room.append(level.where("place is not null"))
        parts = level.where("place is null").select("host", "cell", "part")
        if cells == 1:
            break
        cells = -(-cells // cell)
        parts = parts.withColumn("h", F.col("cell")).withColumn("cell", F.pmod("cell", F.lit(cells)))
    rest = reduce(DataFrame.unionByName, room)
    if rest.isEmpty():
        return _finished(parts, None)
    while True:  # what makes room in united parts is deeper each time
        rest = staged(_united(rest), "rest")
        if rest.groupBy("host", "place", "name").count().where("count > 1").isEmpty():
            break
    # parts of one title in the whole host stay out: their pages know as much of them
    several = F.size(F.from_json(F.get_json_object("part", "$[0][7]"), "array<string>")) > 1
    known = _known(parts).withColumn("_known", F.lit(True))
    return _finished(parts, rest.join(known, ["host", "place", "name"], "left").where(several | F.col("_known")).drop("_known"))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, cell: int = CELL) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Wrappers of at most ``broadcast_bytes`` in all are broadcast. Beyond that each goes once to every cell of its host's pages."""
    learnt = staged(wrappers(pages, cell), "wrappers")
    size = learnt.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def read(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in learnt.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, Item | None] = {}
            for b in batches:
                texts = []
                for page, host in zip(b.column(2), b.column(3).to_pylist()):
                    if host not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[host] = load(held.value[host]) if host in held.value else None
                    texts.append(extract(page.as_py(), known[host]))
                yield read(b, texts)

        return small_batches(rows).mapInArrow(run, kind)

    # pages in cells, a hot host in many; a cell's wrapper stands before its pages
    cells = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))
    sent = learnt.join(cells, "host").select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    own = rows.join(cells, "host").withColumn("cell", F.pmod(F.xxhash64("page_id"), F.col("cells")).cast("int")).withColumn("wrapper", F.lit(None).cast("string"))
    both = own.drop("cells").unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("host", "cell").sortWithinPartitions("host", "cell", F.col("wrapper").isNull())

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wrapper = None, None
        for b in batches:
            texts, pages_at = [], []
            for i, (page, host, no, text) in enumerate(zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5))):
                if (host, no) != at:
                    at, wrapper = (host, no), None
                if text.is_valid:
                    wrapper = load(text.as_py())
                    continue
                pages_at.append(i)
                texts.append(extract(page.as_py(), wrapper))
            yield read(b.take(pa.array(pages_at, pa.int64())), texts)

    return small_batches(dealt.select("page_id", "url", "html", "host", "cell", "wrapper")).mapInArrow(in_order, kind)
