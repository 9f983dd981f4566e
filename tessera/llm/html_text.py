"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a tree of blocks, whose leaves are texts; markup inside a block is no node of its own.
A wrapper is an expression of the same form in which a node may be optional or repeated and a leaf
is a text slot. It is inferred by aligning pages of one host again and again: children that match by
tag and class are merged, a mismatch of texts makes the slot variable, a child that only one side
has becomes optional, neighbours that repeat become one repeated node, and longer repeats a repeated
group. There are no alternatives, so a wrapper stays as small as the host's layout.

Wrappers are built per task and merged per host in two salted rounds, so a host with a third of all
pages is no bottleneck. The finished wrapper of a host with several pages decides what its article is:
slots that say the same on the host's pages and slots of links weigh nothing, repeated records of
several slots (cards, comments) weigh half, and the article is the node that nearly all of the weight
leads to. Names of tags and classes only settle what slots can't: which of two nodes of like weight it
is, and what inside the article is a notice or a form. Hosts with one or two pages have no slots that
could be compared; there, marked article nodes come first.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import sized, written

# fixed values: elements of HTML by their part in a page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre script section select "
    "style summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
_APART = frozenset("aside button dialog fieldset footer form head header iframe legend menu nav noscript object option script select style svg template textarea title".split())
_ENDS_P = _BLOCK - frozenset("script style template noscript iframe button select option textarea title svg object".split())
# an element that ends an open one of these, up to the nearest of the limits
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of classes and ids that mark what is not the article.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notification popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social comment comments disqus replies respond related recommended "
    "recommendations widget toolbar pagination pager".split()
)
#: Those that also tell of an element that could else be the article.
_ASIDE = frozenset("comment comments replies related recommended promo sponsored advert advertisement".split())
_ARTICLE = frozenset("articlebody article-body article-content article-text post-content post-body entry-content story-body main-content".split())

_STOP = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    return out


@lru_cache(4096)
def _key(tag: str, raw: str) -> str:
    """tag, a mark (- not the article, + the article) and the first class or id without digits."""
    at = _attributes(raw) if raw.strip(" /") else {}
    names = [*at.get("class", "").split(), *at.get("id", "").split(), *at.get("role", "").split()]
    words = {w.lower() for x in names for w in _WORDS.findall(_CAMEL.sub(" ", x))}
    marks = {x.lower() for x in [*names, *at.get("itemprop", "").split()]}
    mark = ""
    whole = tag in ("article", "main") or bool(marks & _ARTICLE) or "main" in at.get("role", "").split()
    apart = words & (_ASIDE if whole else _BOILERPLATE) and tag not in ("html", "body")
    if tag in _APART or apart or "hidden" in at or re.search(r"display\s*:\s*none", at.get("style", ""), re.IGNORECASE):
        mark = "-"
    elif whole:
        mark = "+"
    name = re.sub(r"\d+", "", names[0].lower()) if names else ""
    return f"{tag}{mark}.{name}" if name else f"{tag}{mark}"


# pages nest as deeply as they like; these are frames of Python, which take no stack of the process
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


class Node:
    """A node of a page or a wrapper; the key of a text slot is #, of a repeated group ()."""

    __slots__ = ("chars", "key", "kids", "links", "optional", "pages", "repeated", "text")

    def __init__(self, key: str, kids: list[Node] | None = None, chars: int = 0, links: int = 0, text=None):
        # text: of a page's slot the text; of a wrapper's its hash, or None if it varies
        self.key, self.kids, self.chars, self.links, self.text = key, kids or [], chars, links, text
        self.optional, self.repeated, self.pages = False, False, 1

    def dump(self):
        """A flat list of the nodes in page order, each with the number of its children."""
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            out.append([x.key, x.optional, x.repeated, x.pages, x.chars, x.links, x.text, len(x.kids)])
            open_.extend(reversed(x.kids))
        return out

    @classmethod
    def load(cls, rows) -> Node:
        made: list[Node] = []
        for key, optional, repeated, pages, chars, links, text, kids in reversed(rows):
            node = cls(key, [made.pop() for _ in range(kids)], chars, links, text)
            node.optional, node.repeated, node.pages = optional, repeated, pages
            made.append(node)
        return made[0]

    def regex(self) -> str:
        """The expression, for reading."""
        inner = "#PCDATA" if self.key == "#" else f"{'' if self.key == '()' else '<' + self.key + '>'}{''.join(k.regex() for k in self.kids)}"
        mark = "*" if self.optional and self.repeated else "?" if self.optional else "+" if self.repeated else ""
        return f"({inner}){mark}" if mark else inner


def parse(html: str) -> Node:
    """The tree of blocks of a page; unclosed, wrongly nested and cut markup is taken as browsers do."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    parts: list[tuple[str, bool]] = []
    link = False
    nested = Counter(["html"])
    last = {q: html.rfind(q) for q in "\"'"}

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
            if text:
                stack[-1][1].kids.append(Node("#", None, len(text), sum(len(x) for x, linked in parts if linked), text))
            parts.clear()

    def close(depth: int):
        nonlocal link
        flush()
        nested.subtract(t for t, _ in stack[depth:])
        del stack[depth:]
        link = False

    def opened(tags, limits) -> int:
        if not any(nested[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in limits:
                return 0
        return 0

    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            i = n
        if i > at:
            parts.append((html[at:i], link))
        if i >= n:
            break
        if html.startswith("<!--", i):
            j = html.find("-->", i + 2)
            at = n if j < 0 else j + 3
            continue
        if html[i + 1 : i + 2] in ("!", "?"):
            j = html.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = _NAME.match(html, i + 1)
        if m is None:
            parts.append(("<", link))
            at = i + 1
            continue
        end = m.end()
        while True:
            stop = _STOP.search(html, end)
            if stop is None:
                end = at = n
                break
            if stop[1] is None:
                end, at = stop.start(), stop.end()
                break
            if last[stop[1]] < stop.end():
                j = html.find(">", stop.end())
                end, at = (n, n) if j < 0 else (j, j + 1)
                break
            end = html.index(stop[1], stop.end()) + 1
        tag = m[1].lower()
        if html[i + 1] == "/":
            if tag == "a":
                link = False
            elif tag in _BLOCK:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0) if nested[tag] else 0
                if depth:
                    close(depth)
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            parts.append((" ", link))
        elif tag in _BLOCK:
            flush()
            if tag in _ENDS_P and (d := opened({"p"}, {"td", "th", "table", "button", "object", "template", "html"})):
                close(d)
            if tag in _ENDS and (d := opened(*_ENDS[tag])):
                close(d)
            if tag == "html" or (tag == "body" and nested["body"] > 0):
                continue
            if tag == "body" and (d := opened({"head"}, ())):
                close(d)
            if tag in _VOID:
                continue
            node = Node(_key(tag, html[m.end() : end]))
            stack[-1][1].kids.append(node)
            if tag in _RAW:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = n if found is None else html.find(">", found.end()) + 1 or n
            else:
                stack.append((tag, node))
                nested[tag] += 1
    close(1)
    _sketched(root)
    return root


#: Containers that say nothing by themselves, and how one without a name is told from its neighbours: by what it holds.
_PLAIN = frozenset("div section td th li dd form table".split())
_FLOWING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_LISTS = frozenset("ul ol dl table select menu".split())


def _sketched(root: Node) -> None:
    """Adds to the keys of plain containers without a name whether they hold flowing text, lists, text only or containers."""
    open_ = [root]
    while open_:
        node = open_.pop()
        if node.key in _PLAIN:
            held = {_tag(k.key) for k in node.kids}
            node.key += "~t" if held & _FLOWING else "~l" if held & _LISTS else "~s" if held <= {"#"} else "~n"
        open_.extend(node.kids)


def _digest(text) -> int | None:
    return crc32(text.encode("utf-8", "surrogatepass")) if isinstance(text, str) else text


def wrapper_of(node: Node) -> Node:
    """The wrapper of one page: texts become slots, neighbours that repeat become one."""
    out = Node(node.key, _folded([wrapper_of(k) for k in node.kids]), node.chars, node.links, _digest(node.text))
    return out


def merge(a: Node, b: Node) -> Node:
    """The wrapper of what either of two wrappers with one key fits."""
    out = Node(a.key, _folded(_aligned(a.kids, b.kids)), a.chars + b.chars, a.links + b.links, a.text if a.text == b.text else None)
    out.optional, out.repeated, out.pages = a.optional or b.optional, a.repeated or b.repeated, a.pages + b.pages
    return out


def _both(a: Node, b: Node) -> Node:
    """Neighbours that repeat on one page: as merge, but seen on the pages of one only."""
    out = merge(a, b)
    out.repeated, out.optional, out.pages = True, a.optional and b.optional, max(a.pages, b.pages)
    return out


def _folded(kids: list[Node]) -> list[Node]:
    """Neighbours with one key as one repeated node, then repeats of two to four nodes as groups."""
    out: list[Node] = []
    for kid in kids:
        if out and out[-1].key == kid.key and kid.key != "()":
            out[-1] = _both(out[-1], kid)
        else:
            out.append(kid)
    for period in (2, 3, 4):
        i = 0
        while i + 2 * period <= len(out):
            names = [x.key for x in out[i : i + period]]
            if "()" in names or [x.key for x in out[i + period : i + 2 * period]] != names:
                i += 1
                continue
            group = out[i : i + period]
            j = i + period
            while [x.key for x in out[j : j + period]] == names:
                group = [_both(a, b) for a, b in zip(group, out[j : j + period], strict=True)]
                for x, y in zip(group, out[i : i + period], strict=True):
                    x.repeated = y.repeated
                j += period
            node = Node("()", group)
            node.repeated, node.pages = True, max(x.pages for x in group)
            out[i:j] = [node]
    return out


#: Bits of an alignment's rows that are kept at once; longer lists are halved first.
_BITS = 1 << 28


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each of `a`, a number whose bit j is 0 where one more of `b` makes the longest common subsequence longer."""
    places: dict[str, int] = {}
    for j, key in enumerate(b):
        places[key] = places.get(key, 0) | 1 << j
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for key in a:
        hit = row & places.get(key, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of the longest common subsequence of `a` and each beginning of `b`."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that doesn't grow with the product of the lengths."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > _BITS:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[:half - 1 if half else None:-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> j - 1 & 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


def _aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Children of both sides in order: matching ones merged, others optional."""
    pairs: list[tuple[int, int]] = []
    ka, kb = [x.key for x in a], [x.key for x in b]
    lo, ea, eb = 0, len(a), len(b)
    while lo < min(ea, eb) and ka[lo] == kb[lo]:
        pairs.append((lo, lo))
        lo += 1
    tail = []
    while ea > lo and eb > lo and ka[ea - 1] == kb[eb - 1]:
        ea, eb = ea - 1, eb - 1
        tail.append((ea, eb))
    pairs += [(lo + i, lo + j) for i, j in _common(ka[lo:ea], kb[lo:eb])]
    out, i, j = [], 0, 0
    for x, y in [*pairs, *reversed(tail), (len(a), len(b))]:
        for own in (*a[i:x], *b[j:y]):
            own.optional = True
            out.append(own)
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _flat(kids: list[Node]) -> list[Node]:
    """Children, with those of repeated groups in place of the groups."""
    return [x for k in kids for x in (_flat(k.kids) if k.key == "()" else (k,))]


def _mark(key: str) -> str:
    head = key.partition(".")[0]
    return head[-1] if head[-1] in "+-" else ""


#: A child of at least this share of its parent's weight holds what the parent is for; and what weighs this share of the heaviest is alike.
_SHARE, _ALIKE = 0.7, 0.5
_TEXT = frozenset("p blockquote pre ul ol dl table h1 h2 h3 h4 h5 h6 figure".split())


def _tag(key: str) -> str:
    return key.partition(".")[0].partition("~")[0].rstrip("+-")


class Roles:
    """A wrapper's nodes with a decision for each slot: part of the article or not.

    `varied` pages are enough to tell a slot that says the same everywhere from one that varies; a
    slot of fewer pages than a `share` of the host's is no evidence.
    """

    def __init__(self, wrapper: Node, varied: int = 3, share: float = 0.3):
        self.many = wrapper.pages >= varied
        self.least = max(varied, share * wrapper.pages)
        self.weights: dict[int, float] = {}
        self._weigh(wrapper)
        if self.many and not self._varies(wrapper):
            # all pages say the same but in menus and the like: a host of copies
            self.many = False
            self._weigh(wrapper)
        region = [self._heaviest(wrapper)] if self.many else self._marked(wrapper) or [self._heaviest(wrapper)]
        self.tree = self._decided(wrapper, {id(x) for x in region}, False)

    def _fixed(self, slot: Node) -> bool:
        return self.many and slot.text is not None and slot.pages >= self.least

    def _weigh(self, node: Node) -> float:
        """Characters of varying text without links, on an average page of the host."""
        if node.key == "#":
            weight = 0.0 if self._fixed(node) else max(0, node.chars - 2 * node.links)
        elif not self.many and _mark(node.key) == "-" or _tag(node.key) in _RAW:
            weight = 0.0
        else:
            weight = 0.0
            for kid in node.kids:
                weight += self._weigh(kid)
            if self.many and node.repeated and _tag(node.key) not in _TEXT and self._slots(node) > 1:
                weight /= 2
        self.weights[id(node)] = weight
        return weight

    def _varies(self, node: Node) -> bool:
        """Whether any slot of weight is not in a part that is named as a menu or the like."""
        for kid in node.kids:
            if _mark(kid.key) != "-" and self.weights[id(kid)] and (kid.key == "#" or self._varies(kid)):
                return True
        return False

    def _slots(self, node: Node) -> int:
        """Children of a record that hold text of their own."""
        return sum(kid.key == "#" or self.weights[id(kid)] > 0 for kid in _flat(node.kids))

    def _marked(self, node: Node) -> list[Node]:
        found = []
        for kid in _flat(node.kids):
            mark = _mark(kid.key)
            if mark != "-":
                inner = self._marked(kid)
                # a main part that holds an article is only its frame
                found += inner or ([kid] if mark == "+" and self.weights[id(kid)] else [])
        return found

    def _heaviest(self, node: Node) -> Node:
        while True:
            kids = [k for k in _flat(node.kids) if k.key != "#" and _tag(k.key) not in _TEXT and self.weights[id(k)]]
            most = max((self.weights[id(k)] for k in kids), default=0)
            # of nodes alike in weight, names settle it
            alike = [k for k in kids if self.weights[id(k)] >= _ALIKE * most]
            best = max(alike, key=lambda k: ("- +".index(_mark(k.key) or " "), self.weights[id(k)]), default=None)
            named = sum(self.weights[id(k)] for k in kids if k is not best and _mark(k.key) == "-")
            if best is None or self.weights[id(best)] < _SHARE * (self.weights[id(node)] - named):
                return node
            node = best

    def _decided(self, node: Node, region: set[int], inside: bool):
        inside = inside or id(node) in region
        if node.key == "#":
            return ["#", inside and not self._fixed(node), []]
        if _mark(node.key) == "-" and id(node) not in region:
            # of a header inside the article its headings stay
            heads = [k for k in _flat(node.kids) if inside and node.key.startswith("header") and re.match(r"h[1-6]\b", k.key)]
            return [node.key, False, [self._decided(k, region, True) for k in heads]]
        return [node.key, inside, [self._decided(k, region, inside) for k in _flat(node.kids)]]

    def dump(self):
        """The tree as a flat list of key, decision and number of children."""
        out, open_ = [], [self.tree]
        while open_:
            key, kept, kids = open_.pop()
            out.append([key, kept, len(kids)])
            open_.extend(reversed(kids))
        return out


def _matched(node: Node, tree, out: list[str]) -> None:
    """Adds the texts of a page's node that its wrapper's decisions keep, in page order."""
    at, kids = 0, tree[2]
    for kid in node.kids:
        n = len(kids)
        k = next((x % n for x in range(at, at + n) if kids[x % n][0] == kid.key), None) if n else None
        if k is None:
            # unknown to the wrapper, as in a page that it was not made from
            if tree[1]:
                _matched_all(kid, out)
            continue
        at = k
        if kid.key != "#":
            _matched(kid, kids[k], out)
        elif kids[k][1]:
            out.append(kid.text)


def _matched_all(node: Node, out: list[str]) -> None:
    if node.key == "#":
        out.append(node.text)
    elif _mark(node.key) != "-":
        for kid in node.kids:
            _matched_all(kid, out)


def main_text(html: str, tree=None) -> str:
    """The article of a page by the decisions of its host's wrapper, or else of its own."""
    page, out = parse(html), []
    if tree is not None:
        _matched(page, tree, out)
    if not out:
        _matched(page, Roles(wrapper_of(page)).tree, out)
    return "\n\n".join(out)


@lru_cache(512)
def _loaded(raw: str):
    made: list = []
    for key, kept, kids in reversed(json.loads(raw)):
        made.append([key, kept, [made.pop() for _ in range(kids)]])
    return made[0]


def wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """host and wrapper (JSON) of the columns host and html: partial ones per task, merged twice."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}

        def rows():
            names = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([json.dumps(held[h].dump()) for h in names], pa.string())], ["host", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1), strict=True):
                own = wrapper_of(parse(html.as_py() or ""))
                host = host.as_py()
                held[host] = merge(held[host], own) if host in held else own
            if len(held) > 5000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, node = None, None
        for batch in batches:
            done = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                other = Node.load(json.loads(raw))
                if name == host:
                    node = merge(node, other)
                else:
                    if node is not None:
                        done.append((host, json.dumps(node.dump())))
                    host, node = name, other
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.string()), pa.array([w for _, w in done], pa.string())], ["host", "wrapper"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(node.dump())], pa.string())], ["host", "wrapper"])

    schema = "host string, wrapper string"
    parts = pages.select("host", "html").mapInArrow(partial, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    once = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    # a host's rows with one salt lie together; those with the next salt make another partial wrapper
    once = once.withColumn("host", F.concat_ws("\n", "host", F.col("salt").cast("string"))).select("host", "wrapper").mapInArrow(merged, schema)
    twice = once.withColumn("host", F.expr("substring_index(host, '\\n', 1)")).repartition("host").sortWithinPartitions("host", "wrapper")
    return twice.mapInArrow(merged, schema)


#: Bytes of decisions up to which they are broadcast; above, pages are dealt by host and salt.
BROADCAST_BYTES = 32 << 20


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 32, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of `pages`, repeated rows included.

    text holds the article's blocks in page order with two line feeds between; character references
    are decoded and white space inside a block is one space. Null, empty and text-free pages give an
    empty text. Pages with a null url or one without a host are taken as one host. An empty table
    gives an empty result. Pages are read whole, and all pages of a host make its wrapper.
    """
    spark = pages.sparkSession
    sized(spark)
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#\s]*)", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [json.dumps(Roles(Node.load(json.loads(w.as_py()))).dump()) for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roles, pa.string())], ["host", "roles"])

    roles = written(wrappers(rows, salts).mapInArrow(decide, "host string, roles string"), "wrappers")
    size = roles.agg(F.coalesce(F.sum(F.length("roles") + F.length("host") + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(roles), "host", "left")
    else:
        spread = roles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    kind = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", _loaded(r.as_py()) if r.is_valid else None) for h, r in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "roles").mapInArrow(run, f"page_id {kind[0]}, url {kind[1]}, text string, n_chars long")
