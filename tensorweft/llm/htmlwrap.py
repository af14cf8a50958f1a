"""Main text of web pages through wrappers: union-free regular expressions inferred per host.

1. A page becomes a stream of block tags and text slots, nested as its elements are; inline tags, comments, scripts and
   styles are dropped as they are read. A slot is a block: what stands between two block tags.
2. Runs that repeat (list items, paragraphs, a heading and its paragraphs) are folded into repeated groups, (x)+.
3. The streams of all of a host's pages (each that differs from the others once) are held against the wrapper so far, an
   automaton per element. One that doesn't match is aligned with it, element by element: what both have stays, a stretch
   that only one has becomes an optional group, (x)?, and two stretches that differ become two optional groups; no unions
   arise. This goes on in buckets of FAN streams, and the buckets' wrappers are aligned in turn until a host has one.
4. All pages run through their wrapper, and each slot gets a role from what they have there. Strings that differ make their
   slot a free one.
5. The slots' roles decide the pages' blocks. Where an element's content doesn't match, and where a slot's role is open, a
   block is judged by where it stands in its page.

By where it stands a block is main text unless it is under an element, or an element with a class, id or role, of menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments; it also must lie in the page's article
or main element if the page has one. The wrapper says no, also inside article and main, where a slot outside of repeated
groups holds the same text on all pages that have it, or reads a text that most distinct pages of the host have (a
template's own text), and where a slot is mostly links over all pages. Both need EVIDENCE distinct pages.

Wrappers, roles and counts come from all pages of a host, of which equal ones are one (by 64-bit hashes); none is sampled.
Elements with classes that fewer than EVIDENCE distinct pages of a host have are of one kind with such others of their tag;
that the blocks right under such a kind are mostly links says nothing. A list of more than LONGEST unlike children, once
folded, becomes a bag, one repeated group of its kinds, each optional; if the kinds are more than KINDS, elements of one tag
are one kind, whatever their classes, or else all elements. Elements below DEEPEST levels are listed in the one above. None
of this drops text or pages. A null html is empty and gives an empty text; a url without a host shares the empty host. White
space is what Unicode says. Repeated rows get the same text. No rows give no rows. Columns beyond the three are not read,
whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorweft.llm.common import BROADCAST_BYTES, annotate, discard, materialise, quoted, ship, stored_bytes, values

#: Streams or wrappers of a host that are made one in one run of rows.
FAN = 32
#: Distinct pages that a slot's constancy or links must be seen on.
EVIDENCE = 4
#: Share of a host's distinct pages whose text is the template's; share of links of a slot of links.
COMMON, LINKS = 0.5, 0.5
#: Longest repeated group that is looked for; children of an element beyond which their order is given up, and kinds of
#: them beyond which their classes are; levels.
FOLD, LONGEST, KINDS, DEEPEST = 6, 300, 5000, 60
#: Pages of a host that meet its wrapper in one run of rows where wrappers are too many to broadcast.
SALT = 5000

# Element names of HTML by their role.
DROPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video")
OUTSIDE = ("nav", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "fieldset", "dialog", "menu", "head", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
CLOSES_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
#: Words in classes, ids and roles that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended newsletter subscribe signup login search tags copyright".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


#: A class with one of these says what a page has or lacks, not what the element is ("with-sidebar").
QUALIFIERS = frozenset("has have no not with without".split())
#: In a class with one of these a header is that of the article.
CONTENT = frozenset("article body content entry main post story".split())


HIDDEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")


def mark_of(attributes: str) -> bool:
    """Whether an element's attributes say that it isn't the article, or isn't shown."""
    if not attributes or attributes.isspace():
        return False
    low = attributes.lower()
    if ("none" in low or "aria-hidden" in low) and HIDDEN.search(low) or "hidden" in low and "hidden" in VALUES.sub("", low).split():
        return True
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = frozenset(re.split(r"[^a-z]+", name))
            if (found := words & MARKS) and not words & QUALIFIERS and not (found == {"header"} and words & CONTENT):
                return True
    return False


class Node:
    """An element: its label (tag and classes) and its content, elements and numbers of blocks."""

    __slots__ = ("label", "items")

    def __init__(self, label: str):
        self.label, self.items = label, []


class Page:
    """root: the nested block tags; blocks: lists of (raw text, outside, in article, in link)."""

    __slots__ = ("root", "blocks", "has_main")

    def __init__(self, html: str):
        self.root, self.blocks = Node(""), []
        self.has_main = False
        stack: list[tuple[str, bool]] = []
        nodes = [self.root]  # one for each block element of the stack, as far as DEEPEST
        outside = article = linked = 0
        block, last, at, size = 0, -1, 0, len(html)

        def leave(n: int) -> None:
            nonlocal outside, article, linked
            while len(stack) > n:
                name, bad = stack.pop()
                outside -= bad
                article -= name in ("article", "main")
                linked -= name == "a"
                if name not in INLINE:
                    nodes.pop()

        while at < size and (m := TOKEN.match(html, at)):
            at = m.end()
            text = m[4]
            if text is not None:
                if block != last and text.strip():
                    nodes[-1].items.append(len(self.blocks))
                    self.blocks.append([])
                    last = block
                if block == last:
                    self.blocks[-1].append((text, outside > 0, article > 0, linked > 0))
                continue
            if (name := m[2]) is None:
                continue
            name = name.lower()
            block += name not in INLINE
            if m[1]:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == name:
                        leave(n)
                        break
                continue
            if name in DROPPED:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if not m[0].endswith("/>"):
                    at = end.end() if end else size
                continue
            if name in CLOSES_P and any(x == "p" for x, _ in stack[-8:]):
                leave(max(n for n, (x, _) in enumerate(stack) if x == "p"))
            elif name in ENDS_ITSELF:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == name:
                        leave(n)
                        break
                    if stack[n][0] in ENDS_ITSELF[name]:
                        break
            if name in VOID or m[0].endswith("/>"):
                continue
            marked = mark_of(m[3]) or name in OUTSIDE or (name == "header" and not article)
            bad = marked and name not in ("html", "body", "article", "main")
            stack.append((name, bad))
            if name not in INLINE:
                if len(nodes) < DEEPEST:
                    nodes[-1].items.append(node := Node(label_of(name, m[3])))
                    nodes.append(node)
                else:
                    nodes.append(nodes[-1])
            outside += bad
            if name in ("article", "main") and outside == 0:
                self.has_main = True
            article += name in ("article", "main")
            linked += name == "a"

    def stands(self, x: tuple[str, bool, bool, bool]) -> bool:
        """Whether a text is main by where it stands."""
        return not x[1] and (x[2] or not self.has_main)


def label_of(name: str, attributes: str) -> str:
    """Tag and classes; numbers in classes say which page it is, not what the element is."""
    for m in ATTRIBUTE.finditer((attributes or "").replace("\0", "")):
        if m[1].lower() == "class":
            return " ".join([name, *sorted({re.sub(r"[0-9]+", "0", x) for x in (m[2] or m[3] or m[4] or "").lower().split()})])
    return name


# ------------------------------------------------------------- union-free expressions
# An item is [kind, optional, repeated, label, items]: ELEMENT with its content's items, SLOT (a free text), STRING (label
# is the hash of a text that all pages have there) or GROUP of items. A bag is a GROUP labelled BAG, an element's only item.

ELEMENT, SLOT, STRING, GROUP = range(4)
BAG = "*"


def is_bag(item: list) -> bool:
    return item[0] == GROUP and item[3] == BAG


def key(item: list) -> str:
    kind, _, _, label, items = item
    if is_bag(item):
        return "(*)"
    return label if kind == ELEMENT else "#" if kind in (SLOT, STRING) else "(" + "\0".join(map(key, items)) + ")"


def merge(x: list, y: list) -> list:
    """The item that matches what either of two items with one key matches."""
    flags = [x[1] or y[1], x[2] or y[2]]
    if is_bag(x):
        return bag([x, y])
    if x[0] == GROUP:
        return [GROUP, *flags, "", [merge(a, b) for a, b in zip(x[4], y[4])]]
    if x[0] == ELEMENT:
        return [ELEMENT, *flags, x[3], align(x[4], y[4])]
    return [SLOT, *flags, "", []]


def ungrouped(items: list) -> Iterator[list]:
    for x in items:
        if x[0] == GROUP:
            yield from ungrouped(x[4])
        else:
            yield x


def wide(label: str, width: int) -> str:
    """The label that elements of a tag (1) or all elements (2) share."""
    return label if width == 0 else "*" if width == 2 or label == "*" else label.split(" ")[0] + " *"


def widened(item: list, width: int) -> list:
    return [*item[:3], wide(item[3], width), item[4]] if item[0] == ELEMENT else item


def fold(items: list) -> list:
    """Replace runs x x ... by one repeated item or, where x is several items, repeated group; short runs first."""
    for width in range(1, FOLD + 1):
        keys, out, i = list(map(key, items)), [], 0
        while i < len(items):
            x, n = keys[i : i + width], 1
            while len(x) == width and keys[i + n * width : i + (n + 1) * width] == x:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            runs = [items[i + k * width : i + (k + 1) * width] for k in range(n)]
            one = [reduce(merge, column) for column in zip(*runs)]
            out.append([one[0][0], one[0][1], True, *one[0][3:]] if width == 1 else [GROUP, False, True, "", one])
            i += n * width
        items = out
    return items if len(items) <= LONGEST else [bag(items)]


def bag(items: list) -> list:
    """What matches the items' kinds in any order."""
    for width in range(3):
        kinds: dict[str, list] = {}
        for x in ungrouped(items):
            x = widened(x, width)
            kinds[key(x)] = merge(kinds[key(x)], x) if key(x) in kinds else x
        if len(kinds) <= KINDS:
            break
    return [GROUP, False, True, BAG, [[k, True, r, *more] for k, _, r, *more in kinds.values()]]


def align(xs: list, ys: list) -> list:
    """The expression that matches what either matches: common items stay, the others become optional."""
    if [*map(key, xs)] == [*map(key, ys)]:
        return [merge(x, y) for x, y in zip(xs, ys)]
    if any(map(is_bag, (*xs, *ys))):
        return [bag([*xs, *ys])]
    out: list = []
    optional = lambda part: [[x[0], True, *x[2:]] for x in part]
    for op, a, b, c, d in SequenceMatcher(None, [*map(key, xs)], [*map(key, ys)], autojunk=False).get_opcodes():
        out += [merge(x, y) for x, y in zip(xs[a:b], ys[c:d])] if op == "equal" else optional(xs[a:b]) + optional(ys[c:d])
    return out if len(out) <= LONGEST else fold(out)


def expression(node: Node) -> list:
    """A page's own expression, from its root."""
    return fold([[ELEMENT, False, False, x.label, expression(x)] if isinstance(x, Node) else [SLOT, False, False, "", []] for x in node.items])


class Content:
    """The automaton of an element's items. A position is an item that stands for a child; follow: what may come after."""

    __slots__ = ("labels", "follow", "last", "empty", "inner", "slots", "fixed", "wide", "bag", "told")

    def __init__(self, items: list, slots: Iterator[int], fixed: bool, told: bool = True):
        #: Whether the element is of one label.
        self.told = told
        #: "#" or the element's label; the element's Content; the slot's number; whether no repeated group holds it.
        self.labels, self.inner, self.slots, self.fixed = [], [], [], []
        self.follow: dict[int, list[int]] = {-1: []}
        #: Label to position, if the items are a bag.
        self.bag: dict[str, int] | None = None
        if len(items) == 1 and is_bag(items[0]):
            for item in items[0][4]:
                self._one(item, slots, False)
            self.bag = {label: p for p, label in enumerate(self.labels)}
        else:
            self.follow[-1], last, self.empty = self._row(items, slots, fixed)
            self.last = set(last)
        self.wide = any(x.endswith("*") for x in self.labels)

    def _row(self, items: list, slots: Iterator[int], fixed: bool):
        first, last, empty = [], [], True
        for item in items:
            f, z, e = self._one(item, slots, fixed)
            for p in last:
                self.follow[p] += f
            first += f if empty else []
            last = z + (last if e else [])
            empty = empty and e
        return first, last, empty

    def _one(self, item: list, slots: Iterator[int], fixed: bool):
        kind, optional, repeated, label, items = item
        fixed = fixed and not repeated
        if kind == GROUP:
            f, z, e = self._row(items, slots, fixed)
        else:
            p = len(self.labels)
            self.labels.append(label if kind == ELEMENT else "#")
            self.follow[p] = []
            self.inner.append(Content(items, slots, fixed, not label.endswith("*")) if kind == ELEMENT else None)
            self.slots.append(next(slots) if kind != ELEMENT else -1)
            self.fixed.append(fixed)
            f, z, e = [p], [p], False
        if repeated:
            for p in z:
                there = set(self.follow[p])
                self.follow[p] += [x for x in f if x not in there]
        return f, z, e or optional

    def positions(self, children: Sequence, known: dict | None) -> list[int] | None:
        """The position of each child, or None if the content doesn't match.

        known: (content, element) to the positions of its children, found or not; elements must match in depth. None:
        their labels are enough.
        """
        fits = lambda x, q: known is None or not isinstance(x, Node) or self.inner[q].matches(x, known) is not None
        if self.bag is not None:
            found = [next((q for name in self.names(x) if (q := self.bag.get(name)) is not None and fits(x, q)), None) for x in children]
            return None if None in found else found
        steps: list[dict[int, int]] = [{-1: -1}]
        for x in children:
            names, now = self.names(x), {}
            for p in steps[-1]:
                for q in self.follow[p]:
                    if q not in now and self.labels[q] in names and fits(x, q):
                        now[q] = p
            if not now:
                return None
            steps.append(now)
        p = next((p for p in steps[-1] if p in self.last or (p == -1 and self.empty)), None)
        if p is None:
            return None
        out = []
        for now in reversed(steps[1:]):
            out.append(p)
            p = now[p]
        return out[::-1]

    def names(self, x) -> tuple[str, ...]:
        """The labels of positions that a child may take."""
        if not isinstance(x, Node):
            return ("#",)
        return (x.label, wide(x.label, 1), wide(x.label, 2)) if self.wide else (x.label,)

    def matches(self, node: Node, known: dict) -> list[int] | None:
        at = (id(self), id(node))
        if at not in known:
            known[at] = self.positions(node.items, known)
        return known[at]

    def assign(self, node: Node, out: dict[int, tuple[int, bool]], known: dict) -> bool:
        """Number of block to (slot, fixed), as far as the contents match; whether all did."""
        whole = (at := self.matches(node, known)) is not None
        if at is None and (at := self.positions(node.items, None)) is None:
            return False
        for x, p in zip(node.items, at):
            if isinstance(x, Node):
                whole = self.inner[p].assign(x, out, known) and whole
            else:
                out[x] = self.slots[p], self.fixed[p]
        return whole

    def all_slots(self) -> Iterator[tuple[bool, bool]]:
        """Of each slot, in their order, whether no repeated group holds it, and whether its element is of one label."""
        for inner, fixed in zip(self.inner, self.fixed):
            if inner is None:
                yield fixed, self.told
            else:
                yield from inner.all_slots()


class Growing:
    """An expression that grows by the pages it doesn't match yet."""

    def __init__(self):
        self.items: list | None = None
        self.content: Content | None = None

    def meet(self, node: Node) -> None:
        if self.items is not None:
            if self.content is None:
                self.content = Content(self.items, count(), True)
            if self.content.matches(node, {}) is not None:
                return
        self.join(expression(node))

    def join(self, items: list) -> None:
        self.items, self.content = items if self.items is None else align(self.items, items), None


class Wrapper:
    """An expression with the roles of its slots (+ main text, - something else, ? as the page says) and the host's common texts."""

    def __init__(self, items: list, roles: str = "", common: Sequence[str] = ()):
        slots = count()
        self.content = Content(items, slots, True)
        self.roles = roles or "?" * next(slots)
        self.common = frozenset(common)

    def read(self, page: Page) -> tuple[dict[int, tuple[int, bool]], bool]:
        """Each matched block's slot, and whether all of the page matched."""
        out: dict[int, tuple[int, bool]] = {}
        return out, self.content.assign(page.root, out, {})


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def hash_of(block: Sequence[tuple[str, bool, bool, bool]]) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(plain("".join(x[0] for x in block)))


def link_share(block: Sequence[tuple[str, bool, bool, bool]]) -> tuple[int, int]:
    """(code points in links, all)"""
    sizes = [(len(x[0].strip()), x[3]) for x in block]
    return sum(n for n, linked in sizes if linked), sum(n for n, _ in sizes)


def nested(node: Node) -> list:
    return [node.label, [nested(x) if isinstance(x, Node) else x for x in node.items]]


def rebuilt(nested: list) -> Node:
    node = Node(nested[0])
    node.items = [rebuilt(x) if isinstance(x, list) else x for x in nested[1]]
    return node


def shape_of(page: Page) -> str:
    """A page's tags and numbers of blocks, as JSON."""
    return json.dumps(nested(page.root), ensure_ascii=False)


def classes_of(nested: list) -> Iterator[str]:
    """Labels with classes."""
    for x in nested[1]:
        if isinstance(x, list):
            if " " in x[0]:
                yield x[0]
            yield from classes_of(x)


def without(nested: list, rare: frozenset[str]) -> list:
    return [wide(nested[0], int(nested[0] in rare)), [without(x, rare) if isinstance(x, list) else x for x in nested[1]]]


def facts_of(page: Page) -> list[tuple[str, int, int, int]]:
    """Of each block (hash of text, points in links, points, main by standing)."""
    return [(hash_of(x), *link_share(x), int(any(page.stands(t) for t in x if t[0].strip()))) for x in page.blocks]


def sample_of(html: str) -> str:
    """What `infer` needs of a page, as JSON."""
    page = Page(html)
    return json.dumps([shape_of(page), facts_of(page)], ensure_ascii=False)


def infer(samples: Sequence[str], common: Sequence[str] = ()) -> str:
    """The wrapper of some pages as JSON, without Spark: what `wrappers` gives for a host of few pages."""
    read = [(rebuilt(json.loads(shape)), facts) for shape, facts in map(json.loads, samples)]
    if not read:
        return ""
    grown = Growing()
    for node, _ in read:
        grown.meet(node)
    wrapper, seen = Wrapper(grown.items), {}
    for n, (node, facts) in enumerate(read):
        out: dict[int, tuple[int, bool]] = {}
        wrapper.content.assign(node, out, {})
        for block, (slot, _) in out.items():
            seen.setdefault(slot, []).append((n, *facts[block]))
    sums = {k: (len(set(n)), min(text), max(text), sum(links), sum(points), min(stands), max(stands)) for k, (n, text, links, points, stands) in ((k, list(zip(*x))) for k, x in seen.items())}
    return finished(grown.items, sums, common)


def finished(items: list, seen: dict[int, Sequence], common: Iterable[str]) -> str:
    """A wrapper as JSON: its expression, its slots' roles, the hashes of texts that most of its pages have.

    seen: of each slot what its pages have there, as `role` takes it.
    """
    slots = list(Wrapper(items).content.all_slots())
    roles = "".join(role(*x, *seen[k]) if k in seen else "?" for k, x in enumerate(slots))
    strings = (seen[k][1] if k in seen and seen[k][1] == seen[k][2] else None for k in range(len(slots)))
    return json.dumps([list(settled(items, strings)), roles, sorted(common)], ensure_ascii=False)


def settled(items: list, strings: Iterator[str | None]) -> Iterator[list]:
    """The items with each slot a string where all pages have the same there."""
    for kind, optional, repeated, label, inner in items:
        if kind in (ELEMENT, GROUP):
            yield [kind, optional, repeated, label, list(settled(inner, strings))]
        else:
            text = next(strings)
            yield [SLOT if text is None else STRING, optional, repeated, text or "", []]


def role(fixed: bool, told: bool, pages: int, first: str, last: str, links: int, points: int, least: int, most: int) -> str:
    """Of a slot: pages that have it, their texts' first and last hash, points in links, points, whether main by standing."""
    if pages >= EVIDENCE:
        if fixed and first == last:
            return "-"  # a template's own text
        if told and links > LINKS * points:
            return "-"  # links
    return "?" if least != most else "+" if most else "-"


def main_text(html: str, wrapper: Wrapper | None) -> tuple[str, bool, int]:
    """(main text, whether the wrapper matched all of the page, blocks that the wrapper judged unlike where they stand)"""
    page = Page(html)
    slots, whole = wrapper.read(page) if wrapper is not None else ({}, False)
    lines, decided = [], 0
    for k, block in enumerate(page.blocks):
        shown = [x[0] for x in block if not x[1]]
        text = plain("".join(x[0] for x in block if page.stands(x)))
        slot, fixed = slots.get(k, (None, False))
        said = "?" if slot is None else wrapper.roles[slot]
        if wrapper is not None and hash_of(block) in wrapper.common and (fixed or not any(x[2] for x in block)):
            said = "-"
        if said != "?":
            judged = plain("".join(shown)) if said == "+" else ""
            decided += judged != text
            text = judged
        if text:
            lines.append(text)
    return "\n".join(lines), whole, decided


def host(url):
    """Between the first :// and the next /, ?, # or the end, A-Z lowered; empty without one."""
    found = F.regexp_extract(F.coalesce(quoted(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decoded(htmls: Sequence[bytes | None]) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in htmls]


def side(df: DataFrame) -> DataFrame:
    """Of a join: broadcast if its files are known to be small, else shuffled. Plans take what comes out of Python for too small."""
    return F.broadcast(df) if stored_bytes(df) * 4 <= BROADCAST_BYTES else df.hint("merge")


def grown(parts: DataFrame, pages: bool) -> DataFrame:
    """(host, n, place, part): one part for all of a host and place, aligned in the order of rows. pages: parts are shapes, not expressions."""
    ship(parts.sparkSession)
    names = ("host", "n", "place", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, Growing()

        def row() -> tuple:
            return (*at, json.dumps(now.items, ensure_ascii=False))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            done = []
            for host, n, place, part in zip(*(values(batch.column(k)) for k in range(4))):
                if at != (here := (host.decode(), n, place)):
                    if at is not None:
                        done.append(row())
                    at, now = here, Growing()
                if pages:
                    now.meet(rebuilt(json.loads(part)))
                else:
                    now.join(json.loads(part))
            yield batch_of(done)
        if at is not None:
            yield batch_of([row()])

    dealt = parts.select(*names).repartition("host", "place").sortWithinPartitions("host", "place", "part")
    return dealt.mapInArrow(run, "host string, n long, place long, part string")


def telling(shapes: DataFrame, each: DataFrame) -> DataFrame:
    """(host, n, shape), n a host: its shapes without the classes that fewer than EVIDENCE distinct pages have."""
    classes = lambda given: ([sorted(set(classes_of(json.loads(x)))) for x in given],)
    labels = annotate(shapes, ["shape"], classes, "labels array<string>", ["host", "at"]).select("host", "at", F.explode("labels").alias("label"))
    pages = each.groupBy("host", "at").agg(F.count("*").alias("pages"))
    rare = labels.join(pages.hint("merge"), ["host", "at"]).groupBy("host", "label").agg(F.sum("pages").alias("pages")).filter(F.col("pages") < EVIDENCE).select("host", "label")
    gone = labels.join(side(materialise(rare, "rare")), ["host", "label"]).groupBy("host", "at").agg(F.collect_list("label").alias("gone"))

    def run(given, gone):
        return ([x.decode() if not g else json.dumps(without(json.loads(x), frozenset(g)), ensure_ascii=False) for x, g in zip(given, gone)],)

    left = annotate(shapes.join(gone.hint("merge"), ["host", "at"], "left"), ["shape", "gone"], run, "told string", ["host"])
    left = materialise(left.select("host", F.col("told").alias("shape")).distinct(), "telling")
    counts = materialise(left.groupBy("host").agg(F.count("*").alias("n")), "counts")
    return left.join(side(counts), "host")


def expressions(shapes: DataFrame) -> DataFrame:
    """(host, part) of (host, n, shape): an expression for all n shapes of a host, made in levels of FAN."""
    most = shapes.agg(F.max("n")).first()[0] or 0
    parts, size = shapes.select("host", "n", F.xxhash64("shape").alias("place"), F.col("shape").alias("part")), 1
    while size == 1 or size < most:
        pages, size = size == 1, size * FAN
        dealt = parts.withColumn("place", F.pmod("place", F.ceil(F.col("n") / size).cast("long")))
        parts = materialise(grown(dealt, pages), "expressions")
    return parts.select("host", "part")


def beside_wrappers(rows: DataFrame, found: DataFrame, inputs: Sequence[str], fn: Callable[..., Sequence[Sequence]], ddl: str, keep: Sequence[str], broadcast_bytes: int) -> DataFrame:
    """Like annotate, with each row's wrapper as fn's last list. rows have a host; found: written (host, many, wrapper), many rows at most a host."""
    if (found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) * 4 <= broadcast_bytes:
        held = rows.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.select("host", "wrapper").collect()})
        ready: dict[str, Wrapper | None] = {}

        def run(hosts, *given):
            for h in hosts:
                if (name := h.decode()) not in ready:
                    ready[name] = Wrapper(*json.loads(held.value[name])) if held.value.get(name) else None
            return fn(*given, [ready[h.decode()] for h in hosts])

        return annotate(rows, ["host", *inputs], run, ddl, keep)
    # Wrappers travel as rows: a host's rows are dealt by salts, and each salt's rows follow one row with the wrapper.
    salts = F.ceil(F.col("many") / SALT).cast("int")
    names = list(dict.fromkeys(["host", *keep, *inputs]))
    sized = rows.select(*names).join(side(found.select("host", salts.alias("_salts"))), "host")
    dealt = sized.select(*names, F.pmod(F.xxhash64(*inputs, *keep), F.col("_salts")).cast("int").alias("_salt"), F.lit(None).cast("string").alias("_wrapper"), F.lit(1).alias("_place"))
    heads = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    of = lambda c: F.col(c) if c == "host" else F.lit(None).cast(rows.schema[c].dataType).alias(c)
    dealt = dealt.unionAll(heads.select(*map(of, names), "_salt", F.col("wrapper").alias("_wrapper"), F.lit(0).alias("_place")))
    dealt = dealt.repartition("host", "_salt").sortWithinPartitions("host", "_salt", "_place")
    current: dict[str, Wrapper | None] = {}

    def stream(hosts, wrappers, places, *given):
        ws = []
        for h, w, place in zip(hosts, wrappers, places):
            if place == 0:
                current.clear()
                current[h.decode()] = Wrapper(*json.loads(w.decode())) if w else None
            ws.append(current[h.decode()])
        return (*fn(*given, ws), places)

    done = annotate(dealt, ["host", "_wrapper", "_place", *inputs], stream, f"{ddl}, _row int", keep)
    return done.filter("_row = 1").drop("_row")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, many, wrapper), written: inferred from all distinct pages of each host.

    Pages are summed up by shape and host within tasks before they meet, so a host with a third of all pages is no heavy key.
    """
    named = pages.select(host(url).alias("host"), quoted(html).alias("html")).withColumn("page", F.xxhash64("html"))

    def run(htmls):
        read = [Page(x) for x in decoded(htmls)]
        facts = [list(zip(*facts_of(p))) or [()] * 4 for p in read]
        return [shape_of(p) for p in read], *([list(f[k]) for f in facts] for k in range(4))

    read = materialise(annotate(named, ["html"], run, "shape string, text array<string>, links array<int>, points array<int>, stands array<int>", ["host", "page"]), "read")
    facts = ("text", "links", "points", "stands")
    each = read.withColumn("at", F.xxhash64("shape")).groupBy("host", "page").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("at", *facts)))
    each = materialise(each, "pages")
    shapes = materialise(read.groupBy("host", "shape").agg(F.xxhash64("shape").alias("at")), "shapes")
    discard(read)
    hosts = materialise(each.groupBy("host").agg(F.sum("times").alias("many"), F.count("*").alias("distinct")), "hosts")
    # texts that most distinct pages of a host have
    texts = each.select("host", F.explode(F.array_distinct("text")).alias("text")).groupBy("host", "text").agg(F.count("*").alias("n"))
    texts = texts.filter(F.col("n") >= EVIDENCE).join(side(hosts.select("host", "distinct")), "host").filter(F.col("n") > COMMON * F.col("distinct"))
    common = texts.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("common"))
    # what the pages of a shape have in each block, then what all pages have in each slot
    blocks = each.select("host", "at", F.posexplode(F.arrays_zip(*facts)).alias("block", "x")).groupBy("host", "at", "block")
    blocks = blocks.agg(F.count("*").alias("pages"), F.min("x.text").alias("first"), F.max("x.text").alias("last"), F.sum("x.links").alias("links"), F.sum("x.points").alias("points"), F.min("x.stands").alias("least"), F.max("x.stands").alias("most"))
    found = materialise(expressions(telling(shapes, each)).join(hosts.hint("merge"), "host"), "found")
    bare = found.select("host", "many", F.concat(F.lit("["), "part", F.lit("]")).alias("wrapper"))

    def slots(given, ws):
        """Each block's slot, and whether it is its page's first in that slot."""
        out = [], [], []
        for shape, w in zip(given, ws):
            at: dict[int, tuple[int, bool]] = {}
            if shape is not None:
                w.content.assign(rebuilt(json.loads(shape)), at, {})
            seen: set[int] = set()
            out[0].append(list(at))
            out[1].append([slot for slot, _ in at.values()])
            out[2].append([not (slot in seen or seen.add(slot)) for slot, _ in at.values()])
        return out

    placed = beside_wrappers(shapes, bare, ["shape"], slots, "block array<int>, slot array<int>, own array<boolean>", ["host", "at"], broadcast_bytes)
    placed = placed.select("host", "at", F.explode(F.arrays_zip("block", "slot", "own")).alias("x")).select("host", "at", "x.*")
    seen = blocks.join(placed.hint("merge"), ["host", "at", "block"]).groupBy("host", "slot").agg(
        F.sum(F.when(F.col("own"), F.col("pages")).otherwise(0)).alias("pages"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("links").alias("links"), F.sum("points").alias("points"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    seen = seen.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "first", "last", "links", "points", "least", "most")).alias("seen"))
    both = found.join(seen.hint("merge"), "host", "left").join(common.hint("merge"), "host", "left")

    def finish(parts, seen, common):
        return ([finished(json.loads(p), {r["slot"]: [r[c] for c in ("pages", "first", "last", "links", "points", "least", "most")] for r in s or []}, c or []) for p, s, c in zip(parts, seen, common)],)

    return materialise(annotate(both, ["part", "seen", "common"], finish, "wrapper string", ["host", "many"]), "wrappers")


FIELDS = "text string, n_chars long, wrapped boolean, n_decided long"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, wrapped, n_decided), a row for each row of pages.

    wrapped: the wrapper matched all of the page. n_decided: blocks whose standing in the page said otherwise than the wrapper.
    """
    found = wrappers(pages, url, html, broadcast_bytes)
    named = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"), quoted(html).alias("html"), host(url).alias("host"))

    def judged(htmls: Sequence[bytes | None], given: Sequence[Wrapper | None]):
        out = [main_text(h, w) for h, w in zip(decoded(htmls), given)]
        return [x[0] for x in out], [len(x[0]) for x in out], [x[1] for x in out], [x[2] for x in out]

    return beside_wrappers(named, found, ["html"], judged, FIELDS, ["page_id", "url"], broadcast_bytes)
