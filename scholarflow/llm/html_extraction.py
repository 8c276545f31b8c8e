"""HTML extraction by wrapper induction.

A page becomes a tree of its block elements; siblings alike in a row are folded
into one node (of a parent with more than WIDE rows of them, all that are
alike), so trees are small. Per host one page's tree is the wrapper; the
distinct trees of the host are aligned with it by simple tree matching (the
largest mapping that keeps roots, parents and the order of siblings). What is
learned of each wrapper node is learned over all texts of the pages, those in
menus and footers too:
  * constant nodes are template: of the pages with text whose tree has the node,
    a text that more than half of them have there, if that is MIN_PAGES pages or
    more that aren't all alike; within a region (below) NEARLY_ALL percent of them
    and more than MIN_PAGES. Other texts there stay.
  * varying slots are content. Where the slot with the most of the host's text
    is in an article element (else the main element) of the wrapper, that is the
    region: pages whose tree has it give what varies in it, and nothing else.
    Without such a region, slots that are links for the most part go, but for
    those below the parent of the slot with the most text.
Nothing is learned of hosts with fewer than MIN_PAGES pages or with one content
only.

The lists below decide where nothing has been learned, and within a region what
varies but isn't the article: comments, asides, adverts, forms. They go by
element, role, or a whole class or id; but nothing that goes by role, class or
id (or is a form) if it holds the page's article, main element or most of its
text. Without a region content is all outermost article elements, else the main
elements or what is named so, else the body; of that, all blocks in page order
that aren't template.

A null or empty html has the text ''; a null url is the host ''. Pages are read
by themselves and joined by host and tree, so null and repeated ids change
nothing. Pages may nest and be as long as they like. Extra columns aren't read.
"""

from __future__ import annotations

import functools
import html as _html
import re
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark as S
from . import _text as X

MIN_PAGES = 3
#: In an article, a text is template if so many percent of the pages with its node have it, and more than MIN_PAGES.
NEARLY_ALL = 90
#: A parent with more rows of like children has one node for all that are alike.
WIDE = 64
#: Trees of a host are aligned in as many tasks.
SALTS = 64

#: Fixed values of HTML: elements without content, with raw text, within lines, and those that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = re.compile(r"</(script|style|textarea|title|noscript|iframe|template|xmp|noembed|noframes)\s*>", re.I)
RAW_NAMES = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("html body table ul ol dl div section article aside nav header footer main form".split())

#: What no page shows.
HIDDEN = frozenset("head script style noscript template iframe textarea object canvas audio video svg".split())
#: What isn't part of an article, by element, role, and word of a class or id.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select svg dialog head textarea object menu canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended search form widget pagination pager toolbar toc".split()
)
#: Words that, beside one of these in a class or id, leave its sense: site-header, related-posts.
PLAIN_WORDS = frozenset("site page main top bottom left right global primary secondary inner outer box bar block area slot unit container wrapper list item items link links button buttons section content body group col column post posts articles stories text title icon icons widgets the id div".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
MAIN_WORDS = frozenset("content main article post entry story".split())

#: A tag with its attributes: quotes count after '=' only, as in HTML; an open one ends with the tag.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "names", "children", "number", "rejected", "dropped", "why")

    def __init__(self, tag: str, names: tuple, why: str):
        self.tag, self.names, self.why, self.children, self.number = tag, names, why, [], -1
        self.rejected = self.dropped = False  # by itself; with what it is in

    def label(self) -> str:
        """The element and its names; words with digits are a page's own."""
        tag = self.tag.replace("(", "%28").replace(")", "%29")
        return f"{tag}.{'.'.join(n for n in self.names if n.isalpha())}"


def stacked(f):
    """f, a generator that yields the arguments of its own calls, run on an explicit stack: pages may nest without bound."""

    @functools.wraps(f)
    def run(*args):
        stack, value = [f(*args)], None
        while stack:
            try:
                args = stack[-1].send(value)
            except StopIteration as done:
                stack.pop()
                value = done.value
            else:
                stack.append(f(*args))
                value = None
        return value

    return run


def _named(rest: str) -> tuple[tuple, set, set]:
    """The words of class and id, the roles, and what is to go by whole classes or ids: a word of DROPPED_WORDS, with none but plain words beside it."""
    names, roles, away = [], set(), set()
    for m in _ATTRIBUTE.finditer(rest) if "=" in rest else ():
        kind = m[1].lower()
        if kind == "role":
            roles.add((m[2] or m[3] or m[4] or "").strip().lower())
        elif kind in ("class", "id"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = _WORD.findall(token)
                names += words
                if all(w in DROPPED_WORDS or w in PLAIN_WORDS or w[0].isdigit() for w in words):
                    away.update(DROPPED_WORDS.intersection(words))
    return tuple(names), roles, away


def parse(html: str, lists: bool = True) -> Node:
    """The tree of a page; strings among children are text, with references decoded. Without lists only what is never shown is rejected."""
    root = Node("#", (), "")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of open elements, by their tags
    bounds = [0]
    n = len(html)

    def shut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()
        while bounds[-1] >= depth and len(bounds) > 1:
            bounds.pop()

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(_html.unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(_html.unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag) and not (tag in ("p", "li") and bounds[-1] > places[tag][-1]):
                shut(places[tag][-1])
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag not in INLINE and tag not in RAW_NAMES:
            # a block ends an open paragraph; an item ends the one before it
            for ends in (("p",), CLOSES.get(tag, ())):
                near = max((places[t][-1] for t in ends if places.get(t)), default=-1)
                if near > bounds[-1]:
                    shut(near)
        names, roles, away = _named(m[3])
        why = ""
        if not lists:
            why = "element" if tag in HIDDEN else ""
        elif tag in DROPPED and tag != "form" or (tag == "header" and not places.get("article")):
            why = "element"
        elif not away.isdisjoint(COMMENT_WORDS) and tag not in ("html", "body", "main"):
            why = "comments"
        elif tag == "form" or roles & DROPPED_ROLES or (away and tag not in ("html", "body", "article", "main")):
            why = "name"
        node = Node(tag, names, why)
        stack[-1].children.append(node)
        if tag in RAW_NAMES:
            end = RAW.search(html, at)
            while end is not None and end[1].lower() != tag:
                end = RAW.search(html, end.end())
            at = n if end is None else end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BOUNDS:
                bounds.append(len(stack))
            stack.append(node)
    _drop(root)
    return root


def _drop(root: Node) -> None:
    """Set rejected on nodes, and dropped on them with all below them, unless they hold the main element, the article or most of the page's text.

    The article is the one with the most text that isn't a comment. Links don't count as text. What goes by its
    element goes unless it holds main; comments never hold the article.
    """
    order, left = [], [(root, -1, False, False, False)]
    while left:
        x, above, out, comments, link = left.pop()
        at = len(order)
        comments = comments or x.why == "comments"
        out = out or x.why == "element" or comments
        link = link or x.tag == "a"
        order.append((x, above, comments, sum(len("".join(c.split())) for c in x.children if isinstance(c, str)) if not out and not link else 0))
        left += [(c, at, out, comments, link) for c in reversed(x.children) if isinstance(c, Node)]
    size, main = [o[3] for o in order], [o[0].tag == "main" for o in order]
    for i in range(len(order) - 1, 0, -1):
        size[order[i][1]] += size[i]
        main[order[i][1]] = main[order[i][1]] or main[i]
    best = max((i for i, (x, _, comments, _) in enumerate(order) if x.tag == "article" and not comments and size[i]), key=lambda i: (size[i], -i), default=0)
    holds = set()
    while best:
        holds.add(best)
        best = order[best][1]
    for i, (x, above, _, _) in enumerate(order):
        kept = not x.why or main[i] and x.tag not in RAW_NAMES or x.why == "name" and (i in holds or 2 * size[i] > size[0])
        x.rejected = not kept
        x.dropped = x.rejected or above >= 0 and order[above][0].dropped


def fold(root: Node) -> tuple[str, list]:
    """The page's tree of block elements with siblings alike as one: as text, and numbers (in page order) set on all nodes."""
    out = [0]

    @stacked
    def shape(nodes: list[Node]):
        blocks = []
        for node in nodes:
            for x in node.children:
                if isinstance(x, Node) and x.tag not in INLINE and x.tag not in VOID:
                    blocks.append(x)
                elif isinstance(x, Node) and x.tag in INLINE:
                    blocks += [y for y in _under(x) if y.tag not in VOID]
        rows: list[tuple[str, list[Node]]] = []
        for b in blocks:
            label = b.label()
            if rows and rows[-1][0] == label:
                rows[-1][1].append(b)
            else:
                rows.append((label, [b]))
        if len(rows) > WIDE:
            alike: dict[str, list[Node]] = {}
            for label, g in rows:
                alike.setdefault(label, []).extend(g)
            rows = list(alike.items())
        made = []
        for label, g in rows:
            number = out[0]
            out[0] += 1
            for b in g:
                b.number = number
            below = yield (g,)
            made.append((label, number, below))
        return made

    tree = shape([root])
    return _text(tree), tree


def _under(node: Node) -> list[Node]:
    """The nearest block elements below an inline one."""
    found, left = [], [node]
    while left:
        x = left.pop()
        if x is node or x.tag in INLINE:
            left += [y for y in reversed(x.children) if isinstance(y, Node)]
        else:
            found.append(x)
    return found


def _text(tree: list) -> str:
    out: list[str] = []
    left: list = [(iter(tree), "")]
    while left:
        rest, end = left[-1]
        item = next(rest, None)
        if item is None:
            left.pop()
            out.append(end)
            continue
        if out and not out[-1].endswith("("):
            out.append(" ")
        out.append(item[0] + "(" if item[2] else item[0])
        if item[2]:
            left.append((iter(item[2]), ")"))
    return "".join(out)


def read_tree(text: str) -> list:
    """The tree that fold() has written, numbered the same way."""
    count, stack = 0, [[]]
    for token in re.findall(r"[^\s()]+\(?|\)", text):
        if token == ")":
            stack.pop()
        else:
            below: list = []
            stack[-1].append((token.rstrip("("), count, below))
            count += 1
            if token.endswith("("):
                stack.append(below)
    return stack[0]


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two forests: the size of the largest mapping, and its pairs of numbers."""
    kinds: dict[tuple, int] = {}
    kind_a, size_a = _kinds(a, kinds)
    kind_b, _ = _kinds(b, kinds)

    @stacked
    def matched(a: list, b: list):
        # equal trees at the ends are best matched with each other
        total, ends, starts, lo, hi = 0, [], [], 0, 0
        while hi < min(len(a), len(b)) and kind_a[a[-1 - hi][1]] == kind_b[b[-1 - hi][1]]:
            ends += _whole(a[-1 - hi][1], b[-1 - hi][1], size_a)
            hi += 1
        while lo < min(len(a), len(b)) - hi and kind_a[a[lo][1]] == kind_b[b[lo][1]]:
            starts += _whole(a[lo][1], b[lo][1], size_a)
            lo += 1
        total = len(ends) + len(starts)
        a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
        both = {x[0] for x in a} & {x[0] for x in b}
        a, b = [x for x in a if x[0] in both], [x for x in b if x[0] in both]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        found: dict[tuple[int, int], tuple[int, list]] = {}
        for i, (name, number, below) in enumerate(a, 1):
            for j, (other, its, under) in enumerate(b, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1])
                if name == other:
                    size, pairs = yield below, under
                    found[i, j] = (size + 1, [(number, its), *pairs])
                    best[i][j] = max(best[i][j], best[i - 1][j - 1] + size + 1)
        i, j = len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                ends += found[i, j][1]
                i, j = i - 1, j - 1
        return total + best[len(a)][len(b)], ends + starts

    return matched(a, b)


def _kinds(forest: list, kinds: dict[tuple, int]) -> tuple[dict[int, int], dict[int, int]]:
    """By number of each node: a number of its whole tree (equal trees have one), and how many nodes it has."""
    kind, size, left = {}, {}, [(x, False) for x in forest]
    while left:
        (label, number, below), done = left.pop()
        if done:
            key = (label, *(kind[x[1]] for x in below))
            kind[number] = kinds.setdefault(key, len(kinds))
            size[number] = 1 + sum(size[x[1]] for x in below)
        else:
            left.append(((label, number, below), True))
            left += [(x, False) for x in below]
    return kind, size


def _whole(number: int, its: int, size: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs of two equal trees: numbers follow the same order in both."""
    return [(number + i, its + i) for i in range(size[number])]


NONE = -2


class Block(NamedTuple):
    node: int
    text: str
    cut: int  # the nearest node that the lists reject, or NONE
    kind: int  # 3: in an article that isn't dropped, 2: main, 1: what is named so
    comment: bool
    links: int  # characters in links


def blocks_of(root: Node) -> list[Block]:
    """All blocks that a page shows, in page order."""
    out: list[tuple] = []
    runs: list = []  # the strings of the block at hand, and if each is a link

    def flush(state: tuple) -> None:
        text = " ".join("".join(t for t, _ in runs).split())
        if text:
            number, cut, kind, comment = state
            out.append(Block(number, text, cut, kind, comment, sum(len(t.strip()) for t, link in runs if link)))
        runs.clear()

    @stacked
    def walk(x: Node, number: int, cut: int, kind: int, comment: bool, link: bool):
        for c in x.children:
            if isinstance(c, str):
                runs.append((c, link))
            elif c.tag == "br":
                runs.append((" ", False))
            elif c.tag in HIDDEN or c.tag in RAW_NAMES:
                if c.tag not in INLINE:
                    flush((number, cut, kind, comment))
            elif c.tag in INLINE:
                if not c.rejected:
                    yield c, number, cut, kind, comment, link or c.tag == "a"
            else:
                flush((number, cut, kind, comment))
                below = c.number if c.rejected else cut
                within = kind
                if not c.dropped:
                    within = max(kind, 3 if c.tag == "article" else 2 if c.tag == "main" else 1 if c.tag not in ("html", "body", "p") and not MAIN_WORDS.isdisjoint(c.names) else 0)
                state = (c.number, below, within, comment or c.why == "comments")
                yield c, *state, link
                flush(state)

    walk(root, root.number, NONE, 0, False, False)
    flush((root.number, NONE, 0, False))
    return out


def listed(blocks: list[Block]) -> list[bool]:
    """For each block, if it is in the page's article by the lists alone."""
    most = max((b.kind for b in blocks if b.cut == NONE), default=0)
    return [b.cut == NONE and (not most or b.kind == most) for b in blocks]


def content(root: Node) -> list[tuple[int, str]]:
    """Node and text of the blocks of the page's article, by the lists alone."""
    blocks = blocks_of(root)
    return [(b.node, b.text) for b, kept in zip(blocks, listed(blocks), strict=True) if kept]


def region(tree: list, chars: dict[int, int]) -> list[int]:
    """The wrapper's nodes that hold the article, by the varying characters of each node: outermost articles, or mains, of which one holds the most."""
    if not chars:
        return []
    heavy = max(chars, key=lambda i: (chars[i], -i))
    found: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
    ends: dict[int, int] = {}
    order, left = [], [(x, frozenset()) for x in reversed(tree)]
    while left:
        (label, number, below), inside = left.pop()
        tag, *names = label.split(".")
        order.append((number, below))
        if tag in found and tag not in inside:
            found[tag].append(number)
            inside = inside | {tag}
        if tag not in DROPPED and COMMENT_WORDS.isdisjoint(names):
            left += [(x, inside) for x in reversed(below)]
    sums = {}
    for number, below in reversed(order):
        ends[number] = max([number + 1, *(ends[x[1]] for x in below if x[1] in ends)])
        sums[number] = chars.get(number, 0) + sum(sums.get(x[1], 0) for x in below)
    for roots in found.values():
        if any(r <= heavy < ends[r] for r in roots):
            return [r for r in roots if sums[r]]
    return []


def around(tree: list, chars: dict[int, int]) -> tuple[int, int]:
    """The parent of the wrapper's node with the most varying characters, and the node after its last: lists of links between the two may be content."""
    heavy = max(chars, key=lambda i: (chars[i], -i), default=None)
    best, last, left = (0, 0), 0, [(x, None) for x in reversed(tree)]
    parent: dict[int, int | None] = {}
    while left:
        (_, number, below), above = left.pop()
        parent[number], last = above, max(last, number)
        left += [(x, number) for x in reversed(below)]
    if heavy in parent:
        at = heavy if parent[heavy] is None else parent[heavy]
        inside = {at}
        for i in sorted(parent):  # parents come before what they hold
            if parent[i] in inside:
                inside.add(i)
        best = (at, max(inside) + 1)
    return best


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parsed(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, host, tree, blocks (node, text, cut, kept by the lists), slots (node, hash of its texts, characters that vary out of links and comments, in links)."""
    block = pa.struct([("node", pa.int32()), ("text", pa.string()), ("cut", pa.int32()), ("kept", pa.bool_())])
    slot = pa.struct([("node", pa.int32()), ("h", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
    kinds = (pa.string(), pa.string(), pa.list_(block), pa.list_(slot))

    def run(batches):
        for b in S.slices(batches, 64):
            columns: list[list] = [[] for _ in kinds]
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                root = parse(page or "", lists)
                tree, _ = fold(root)
                blocks = blocks_of(root)
                by: dict[int, list[Block]] = {}
                for x in blocks:
                    by.setdefault(x.node, []).append(x)
                codes, offsets = X.code_points(["\n".join(x.text for x in of) for of in by.values()])
                hashes = X.span_hashes(codes, offsets[:-1], offsets[1:]).view(np.int64).tolist()
                sums = [(0, 0) if of[0].comment else (sum(len(x.text) for x in of), sum(x.links for x in of)) for of in by.values()]
                made = [{"node": x.node, "text": x.text, "cut": x.cut, "kept": kept} for x, kept in zip(blocks, listed(blocks) if lists else [True] * len(blocks), strict=True)]
                slots = [{"node": i, "h": h, "chars": max(0, n - k), "links": k} for i, h, (n, k) in zip(by, hashes, sums, strict=True)]
                for c, v in zip(columns, (host_of(url), tree, made, slots), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", "url", "host", "tree", "blocks", "slots"])

    made = T.StructType.fromDDL("host string, tree string, blocks array<struct<node: int, text: string, cut: int, kept: boolean>>, slots array<struct<node: int, h: long, chars: long, links: long>>")
    rows = pages.select("page_id", "url", "html")
    read = rows.mapInArrow(run, T.StructType([rows.schema["page_id"], rows.schema["url"], *made.fields]))
    return read.withColumn("shape", F.xxhash64("tree")).withColumn("page", F.xxhash64(F.expr("transform(filter(blocks, x -> x.kept), x -> x.text)")))


def templates(read: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """What the wrappers say of each host's trees: host, shape, constant (keys of nodes of that tree and texts that are template), regions (first node and the one after the last), menus (nodes)."""
    with S.scope(read.sparkSession) as run:
        return run.hand_on(_templates(read, min_pages), "templates")


def _templates(read: DataFrame, min_pages: int) -> DataFrame:
    read = read.where(F.size("blocks") > 0)
    hosts = read.groupBy("host").agg(F.count("*").alias("pages"), F.min("page").alias("lo"), F.max("page").alias("hi")).where(f"pages >= {min_pages} and lo <> hi").select("host")
    shapes = read.groupBy("host", "shape").agg(F.first("tree").alias("tree"), F.count("*").alias("n"))
    shapes = S.save(shapes.join(hosts, "host", "left_semi").withColumn("salt", F.expr(f"cast(pmod(shape, {SALTS}) as int)")), "shapes")
    wrapper = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", "shape")).alias("wrapper"))

    def align(batches):
        for b in S.slices(batches):
            rows = []
            for h, s, n, t, w in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                tree = read_tree(t)
                size = _kinds(tree, {})[1]
                rows += [(h, s, n, i, i + size[i], j) for i, j in match(tree, read_tree(w))[1]]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["host", "shape", "pages", "node", "end", "own"])

    # a host's trees are aligned in several tasks, each with the wrapper
    dealt = shapes.select("host", "salt").distinct().join(wrapper, "host")
    aligned = shapes.select("host", "salt", "shape", "n", "tree").join(dealt, ["host", "salt"]).select("host", "shape", "n", "tree", "wrapper").mapInArrow(align, "host string, shape long, pages long, node int, end int, own int")
    aligned = S.save(aligned, "aligned")
    having = aligned.groupBy("host", "own").agg(F.sum("pages").alias("pages"))
    slots = read.join(hosts, "host", "left_semi").select("host", "shape", "page", F.explode("slots").alias("x"))
    stats = slots.groupBy("host", "shape", "x.node", "x.h").agg(F.count("*").alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum("x.chars").alias("chars"), F.sum("x.links").alias("links"))
    stats = S.save(stats, "stats")
    # texts of single pages go first: a node of a large host has one for each of its pages
    often = stats.groupBy("host", "h").agg(F.sum("n").alias("n")).where(f"n >= {min_pages}").select("host", "h")
    place = aligned.select("host", "shape", "node", "own")
    known = stats.join(often, ["host", "h"], "left_semi").join(place, ["host", "shape", "node"])
    same = known.groupBy("host", "own", "h").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(having, ["host", "own"])
    # in a region a node with several texts varies: there nearly all of its pages must have the text
    same = same.where(f"n >= {min_pages} and lo <> hi and 2 * n > pages").select("host", "own", "h", F.expr(f"n > {min_pages} and 100 * n >= {NEARLY_ALL} * pages").alias("sure"))
    fixed = S.save(known.join(same, ["host", "own", "h"]), "fixed")
    key = F.xxhash64("node", "h")
    constant = fixed.groupBy("host", "shape").agg(F.collect_set(key).alias("constant"), F.collect_set(F.when(F.col("sure"), key)).alias("sure"))  # nodes of one tree
    every = stats.groupBy("host", "shape", "node").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).join(place, ["host", "shape", "node"]).select("host", "own", "chars", "links")
    varying = every.union(fixed.select("host", "own", -F.col("chars"), -F.col("links"))).groupBy("host", "own").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    # nodes of one wrapper
    sums = varying.groupBy("host").agg(F.collect_list(F.struct("own", "chars", "links")).alias("sums")).join(wrapper, "host")

    def judge(batches):
        for b in S.slices(batches):
            rows = []
            for h, sums, w in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                tree, chars = read_tree(w), {x["own"]: x["chars"] for x in sums if x["chars"] > 0}
                roots = region(tree, chars)
                first, end = around(tree, chars)
                rows += [(h, r, False) for r in roots] or [(h, x["own"], True) for x in sums if x["links"] > x["chars"] and not first < x["own"] < end]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.bool_()), strict=True)], ["host", "own", "menu"])

    judged = S.save(sums.select("host", "sums", "wrapper").mapInArrow(judge, "host string, own int, menu boolean"), "judged")
    marked = aligned.join(judged, ["host", "own"]).groupBy("host", "shape").agg(
        F.collect_list(F.when(~F.col("menu"), F.struct("node", "end"))).alias("regions"), F.collect_list(F.when(F.col("menu"), F.col("node"))).alias("menus")
    )
    return constant.join(marked, ["host", "shape"], "full")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages. Without lists the wrappers alone decide."""
    # the parsed pages are what the result reads: they go with the caller's scope, what is learned of them is small
    read = S.save(parsed(pages, lists), "pages")
    return _texts(read, templates(read, min_pages))


def _texts(read: DataFrame, learned: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of parsed pages, by what the wrappers say of their trees."""
    out = read.drop("tree").join(learned, ["host", "shape"], "left")
    out = out.withColumn("gone", F.expr("transform(filter(slots, x -> array_contains(case when size(regions) > 0 then sure else constant end, xxhash64(x.node, x.h))), x -> x.node)"))
    inside = "exists(regions, r -> x.node >= r.node and x.node < r.end and x.cut <= r.node)"
    kept = f"(case when size(regions) > 0 then {inside} else x.kept end) and not coalesce(array_contains(menus, x.node), false) and not coalesce(array_contains(gone, x.node), false)"
    text = F.expr(f"array_join(transform(filter(blocks, x -> {kept}), x -> x.text), '\\n')")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(S.table(spark, sf_dir, "pages"))
