"""Main text of web pages by wrapper induction.

All pages of a host are counted: a text that the same place, a path of tags, has in enough of them is a candidate. The page with the
least hash that has it is its example, and the DOM tree of every page of the host is aligned with the examples by simple tree matching,
a dynamic programme over the children of nodes with equal tags. Candidates that are aligned with equal text in enough of all distinct
pages of the host are its template; the slots whose text varies are content. Pages are then read with the wrapper of their host:
template nodes, and elements that HTML itself or their names mark as menus, headers, footers, sidebars, notices, adverts, forms or
reader comments, are left out, and the blocks of the rest are joined in page order.

The template decides everywhere, in main and article elements too (there over blocks alone, so no sentence loses a phrase). Of main,
the articles and the page outside them, the part with the most words that are neither template nor marked is read. A name marks an
element only if no other word stands beside it, as in related-work, or else if most of the element is links; and never what holds
main or, comments aside, the larger part of the page's words.

Equal pages count once. A host full of near copies shows no template: where pages lose so much to the candidates, on the average, that
they could be copies of each other, all of them keep their text. Nothing of this hangs on a sample, and no task holds the pages of a
host: they are counted by partial aggregates and meet the examples, and later the wrapper, in joins that split a host with many pages.
Trees of any depth are walked without recursion.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Staging, parted

#: Fixed lists: elements without end tag, elements that end a block, elements without main text, and names that mark such parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav footer aside script style noscript template iframe svg math canvas object button select textarea input label head title menu dialog audio video map".split())
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars rail aside related recommended recommendations trending share sharing social breadcrumb breadcrumbs menu menus "
    "navbar nav navigation topbar toolbar masthead header footer copyright comment comments commentlist disqus reply replies respond widget widgets pagination pager "
    "skip hidden".split()
)
#: Marks that the larger part of a page's words may have, words that may stand beside a mark in a name, and names that need confirming.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
BESIDE = frozenset(
    "left right top bottom main site page post box boxes section area block blocks wrapper wrap container inner content list item items link links button buttons bar inline text "
    "title label icon icons form module panel unit slot posts articles article stories news global primary secondary mobile desktop".split()
)
UNSURE = frozenset(["discussion"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What an open element of the left kind is closed by.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Induction:
    """share: of all distinct pages of a host that must agree on a template node. support: how many of them at least. same: share of
    the words from which pages that have them in common count as copies."""

    share: float = 0.75
    support: int = 3
    same: float = 0.5

    def least(self, pages: int) -> int:
        return max(self.support, math.ceil(self.share * pages))


_CLOSERS = frozenset().union(*CLOSED_BY.values())


class Node:
    """words and links: words below, and those of them in links, without what weigh() leaves out; known: of the template; path: a hash
    of the tags from the root."""

    __slots__ = ("tag", "attrs", "children", "parent", "path", "words", "links", "known", "holds")

    def __init__(self, tag: str, attrs=(), parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent
        self.path = zlib.crc32(f"/{tag}".encode("utf-8", "replace"), parent.path) if parent else 0
        self.words, self.links, self.known, self.holds = 0, 0, False, frozenset()


class _Tree(HTMLParser):
    """Elements and strings, with the end tags that HTML lets authors omit."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_through("p")
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self.at = self.at.parent
        node = self.at
        while tag in _CLOSERS and node is not self.root and node.tag not in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
            if tag in CLOSED_BY.get(node.tag, ()):
                self.at = node.parent
                break
            node = node.parent
        child = Node(tag, attrs, self.at)
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def close_through(self, tag: str) -> None:
        """Closes the nearest open p, unless a block stands between."""
        node = self.at
        while node is not self.root and (node.tag == tag or node.tag not in BLOCKS):
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag not in BLOCKS and node.tag in BLOCKS:  # a stray end tag of a phrase does not close blocks
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        """A broken section is a comment up to the next >, as in HTML."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or len(self.rawdata)


def tree_of(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def marked(node: Node, inside: bool) -> bool:
    """Whether HTML itself says that the element is no main text; inside: of an article, where a header holds the article's title."""
    if node.tag in LEFT_OUT or node.tag == "header" and not inside:
        return True
    attrs = node.attrs
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", ""):
        return True
    return (attrs.get("role") or "").lower() in ROLES


def marks_of(node: Node, inside: bool) -> tuple[set[str], bool]:
    """Marks in the element's names, and whether a name is made of marks, and words that go with them, alone."""
    if not node.attrs or node.tag in ("html", "body", "main"):
        return set(), False
    found, sure = set(), False
    for name in f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}".lower().split():
        parts = name.replace("-", " ").replace("_", " ").split()
        of = {p for p in parts if (p in MARKS or p in UNSURE) and not (p == "header" and inside)}
        found |= of
        sure |= bool(of - UNSURE) and all(p in of or p in BESIDE or p == "header" or p.isdigit() for p in parts)
    return found, sure


def named(node: Node, inside: bool, total: int) -> bool:
    """Whether its names, or that it is a form, confirmed by what it holds, tell that the element is no main text. total: words of
    the page."""
    if node.tag == "form":  # some sites have all of a page in one
        return "main" not in node.holds and 2 * node.words <= total
    found, sure = marks_of(node, inside)
    if not found or "main" in node.holds:
        return False
    if sure:
        return bool(found & COMMENTS) or 2 * node.words <= total
    return 2 * node.links > node.words or bool(found & UNSURE) and "comments" in node.holds


def weigh(root: Node, template: dict[int, frozenset[str]]) -> None:
    """Fills in words, links, known and holds of all elements that are not marked."""
    order, left = [], [(root, False, False)]
    while left:
        node, inside, linked = left.pop()
        order.append(node)
        texts = template.get(node.path)
        node.words, node.links, node.holds = 0, 0, frozenset()
        node.known = bool(texts and (node.tag in BLOCKS or not inside) and digest(own_text(node)) in texts)
        within, linked = inside or node.tag in ("article", "main"), linked or node.tag == "a"
        if not node.known:
            node.words = sum(len(c.split()) for c in node.children if isinstance(c, str))
            node.links = node.words if linked else 0
        left.extend((c, within, linked) for c in (blocks_below(node) if node.known else elements(node)) if not marked(c, within))
    for node in reversed(order):
        holds = node.holds
        if node.tag == "main":
            holds |= {"main"}
        if marks_of(node, False)[0] & COMMENTS:
            holds |= {"comments"}
        if (up := node.parent) is not None:
            up.words, up.links, up.holds = up.words + node.words, up.links + node.links, up.holds | holds
        node.holds = holds


def digest(text: str) -> str:
    """128 bits that stand for a text in a template."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def own_text(node: Node) -> str:
    """White-space normalized text of a node's own strings and phrases, without blocks below it."""
    out, left = [], node.children[::-1]
    while left:
        c = left.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in BLOCKS and c.tag not in LEFT_OUT:
            left.extend(reversed(c.children))
    return " ".join("".join(out).split())


def blocks_below(node: Node) -> list[Node]:
    """The nearest blocks below a node: what own_text() does not hold."""
    out, left = [], node.children[::-1]
    while left:
        c = left.pop()
        if isinstance(c, str) or c.tag in LEFT_OUT:
            continue
        if c.tag in BLOCKS:
            out.append(c)
        else:
            left.extend(reversed(c.children))
    return out


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


#: A candidate: its path and the digest of its text.
Slot = tuple[int, str]


def shapes_of(root: Node, known: dict[tuple, int], slot_of: dict[Node, Slot]) -> dict[Node, int]:
    """A number for each element of a tree, equal for equal trees of tags and candidates. known: numbers by tag, candidate and numbers
    of the children."""
    out: dict[Node, int] = {}
    left = [(root, False)]
    while left:
        node, ready = left.pop()
        if ready:
            out[node] = known.setdefault((node.tag, slot_of.get(node), tuple(out[c] for c in elements(node))), len(known))
        else:
            left.append((node, True))
            left.extend((c, False) for c in elements(node))
    return out


def aligned(left: tuple[int, ...], right: tuple[int, ...], worth) -> tuple[int, list[tuple[int, int]]]:
    """Greatest sum of worth(x, y) over places of two sequences that keep their order, and the places. Equal ends are aligned first:
    nothing is worth more than an equal. Sequences that would need a large table are halved, as linear space allows."""
    first = 0
    while first < min(len(left), len(right)) and left[first] == right[first]:
        first += 1
    last = 0
    while last < min(len(left), len(right)) - first and left[-1 - last] == right[-1 - last]:
        last += 1
    a, b = left[first : len(left) - last], right[first : len(right) - last]
    pairs = [(i, i) for i in range(first)]
    if a and b:
        middle = _halved(a, b, worth) if len(a) * len(b) > 1 << 22 else _tabled(a, b, worth)
        pairs += [(first + i, first + j) for i, j in middle]
    pairs += [(len(left) - k, len(right) - k) for k in range(last, 0, -1)]
    return sum(worth(left[i], right[j]) for i, j in pairs), pairs


def _rows(a: Sequence[int], b: Sequence[int], worth) -> Iterator[np.ndarray]:
    """Rows of the alignment's table: best sums of the first so many of a against each start of b."""
    kinds, of = np.unique(np.array(b), return_inverse=True)
    row = np.zeros(len(b) + 1, np.int64)
    known: dict[int, np.ndarray] = {}
    yield row
    for x in a:
        if x not in known:
            known[x] = np.array([worth(x, int(k)) for k in kinds], np.int64)[of]
        new = row.copy()
        np.maximum(new[1:], row[:-1] + known[x], out=new[1:])
        row = np.maximum.accumulate(new)
        yield row


def _tabled(a: Sequence[int], b: Sequence[int], worth) -> list[tuple[int, int]]:
    table, pairs, i, j = np.stack(list(_rows(a, b, worth))), [], len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _halved(a: Sequence[int], b: Sequence[int], worth) -> list[tuple[int, int]]:
    if len(a) < 2 or not b:
        return _tabled(a, b, worth) if b else []
    middle = len(a) // 2
    for forward in _rows(a[:middle], b, worth):
        pass
    for backward in _rows(a[:middle - 1 : -1], b[::-1], worth):
        pass
    cut = int(np.argmax(forward + backward[::-1]))
    step = lambda x, y: _halved(x, y, worth) if len(x) * len(y) > 1 << 22 else _tabled(x, y, worth)
    return step(a[:middle], b[:cut]) + [(middle + i, cut + j) for i, j in step(a[middle:], b[cut:])]


#: An aligned candidate is worth more than all nodes of a page.
WORTH = 1 << 32


def match(a: Node, b: Node, slot_of: dict[Node, Slot] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the greatest matching that keeps order and ancestors, and the matched pairs. slot_of: nodes that are
    candidates; as many equal ones as can be are matched, and WORTH each. Sizes hang on tags and candidates alone, so each two shapes
    are matched once, however often they occur."""
    if a.tag != b.tag:
        return 0, []
    known: dict[tuple, int] = {}
    of = shapes_of(a, known, slot_of or {}) | shapes_of(b, known, slot_of or {})
    tags, slot, below = zip(*known, strict=True)
    sizes: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def worth(x: int, y: int) -> int:
        return sizes[x, y] if tags[x] == tags[y] else 0

    open_pairs = [(of[a], of[b], False)]
    while open_pairs:
        x, y, ready = open_pairs.pop()
        if (x, y) in sizes:
            continue
        if not ready:
            open_pairs.append((x, y, True))
            open_pairs.extend((u, v, False) for u in set(below[x]) for v in set(below[y]) if tags[u] == tags[v] and (u, v) not in sizes)
            continue
        inner, chosen[x, y] = aligned(below[x], below[y], worth)
        sizes[x, y] = 1 + inner + (WORTH if slot[x] and slot[x] == slot[y] else 0)
    out, left = [], [(a, b)]
    while left:
        u, v = left.pop()
        out.append((u, v))
        children, others = elements(u), elements(v)
        left.extend((children[i], others[j]) for i, j in reversed(chosen[of[u], of[v]]) if children[i].tag == others[j].tag)
    return sizes[of[a], of[b]], out


#: Phrases below more phrases than this are no slots, so that the texts of a page's slots are at most so many times the page.
NESTED = 50


def slots(root: Node) -> Iterator[tuple[Node, str]]:
    """What may be of a template, with its own text: blocks, and outside of articles phrases with strings, that are not marked."""
    left = [(root, False, 0)]
    while left:
        node, inside, depth = left.pop()
        block = node.tag in BLOCKS
        if block or not inside and depth <= NESTED and any(isinstance(c, str) and c.strip() for c in node.children):
            text = own_text(node)
            if text:
                yield node, text
        within, depth = inside or node.tag in ("article", "main"), 0 if block else depth + 1
        left.extend((c, within, depth) for c in elements(node) if not marked(c, within))


def key_of(host: str, node: Node, text: str) -> bytes:
    """128 bits that stand for a text at a place of a host's pages."""
    return hashlib.blake2b(f"{host}\0{node.path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


#: An example's tree and those of its nodes that are candidates.
Example = tuple[Node, dict[Node, Slot]]

#: What a page loses is counted in these parts of its words.
PARTS = 1 << 20


def example_of(host: str, root: Node, keys: set[bytes]) -> Example:
    return root, {node: (node.path, digest(text)) for node, text in slots(root) if key_of(host, node, text) in keys}


def agreement(root: Node, examples: Sequence[Example]) -> tuple[set[Slot], int]:
    """Candidates that a page is aligned with, and how much of the page they are."""
    wanted = template_of(slot for _, slot_of in examples for slot in slot_of.values())
    own = {node: (node.path, text) for node, whole in slots(root) if node.path in wanted and (text := digest(whole)) in wanted[node.path]}
    found: set[Slot] = set()
    for example, slot_of in examples if own else ():
        for x, y in match(example, root, slot_of | own)[1]:
            if x in slot_of and slot_of[x] == own.get(y):
                found.add(slot_of[x])
    weigh(root, {})
    total = root.words
    weigh(root, template_of(found))
    return found, (total - root.words) * PARTS // total if total else 0


def template_of(found: Iterable[Slot]) -> dict[int, frozenset[str]]:
    out: dict[int, set[str]] = {}
    for path, text in found:
        out.setdefault(path, set()).add(text)
    return {path: frozenset(texts) for path, texts in out.items()}


def induce(pages: list[str], how: Induction = Induction()) -> dict[int, frozenset[str]]:
    """The wrapper of a few pages of one host, as wrappers() makes it of all: digests of the texts of the template nodes of each path."""
    trees = [tree_of(page) for page in sorted(set(pages))]
    least, having, chosen = how.least(len(trees)), {}, {}
    for i, tree in enumerate(trees):
        for key in {key_of("", node, text) for node, text in slots(tree)}:
            having.setdefault(key, []).append(i)
    for key, among in having.items():
        if len(among) >= least:
            chosen.setdefault(among[0], set()).add(key)
    examples = [example_of("", trees[i], keys) for i, keys in chosen.items()]
    agreed, lost = Counter(), 0
    for tree in trees if examples else ():
        found, part = agreement(tree, examples)
        agreed.update(found)
        lost += part
    if lost > how.share * how.same * PARTS * len(trees):
        return {}
    return template_of(slot for slot, n in agreed.items() if n >= least)


def tops_of(root: Node) -> list[Node]:
    """What is read of a page: its main elements, its articles, or all of it; in doubt the first of them."""
    articles: list[Node] = []
    mains: list[Node] = []
    left = [(root, False, False)]
    while left:  # in page order
        node, inside, within = left.pop()
        for c in reversed(elements(node)):
            if not marked(c, inside) and not named(c, inside, root.words):
                left.append((c, inside or c.tag == "main", within or node.tag == "article"))
        if node.tag == "article" and not within:
            articles.append(node)
        if node.tag == "main" and not inside_main(node):
            mains.append(node)
    in_mains, apart = sum(m.words for m in mains), [a for a in articles if not inside_main(a)]
    in_articles = sum(a.words for a in apart)
    if mains and in_mains >= in_articles:
        return mains
    if apart and in_articles >= root.words - in_articles - in_mains:
        return apart
    return [root]


def inside_main(node: Node) -> bool:
    node = node.parent
    while node is not None and node.tag != "main":
        node = node.parent
    return node is not None


def extract_text(html: str | None, template: dict[int, frozenset[str]] | None = None) -> str:
    """The main text of a page: white space within a block is one space, and one space stands between blocks."""
    root = tree_of(html)
    weigh(root, template or {})
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    for top in tops_of(root):
        left: list = [(c, top is not root) for c in reversed(blocks_below(top) if top.known else top.children)]
        while left:
            c, inside = left.pop()
            if c is None:
                end()
            elif isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif not marked(c, inside) and not named(c, inside, root.words):
                if c.tag in BLOCKS:
                    end()
                    left.append((None, inside))
                within = inside or c.tag in ("article", "main")
                left.extend((x, within) for x in reversed(blocks_below(c) if c.known else c.children))
        end()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty for null and relative ones."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _texts_at_places(pages: DataFrame) -> DataFrame:
    """a, b (the key of a text at a place of a host) and mark of every page that has it. pages: host, mark, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            marks: list[np.ndarray] = []
            for host, mark, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = {key_of(host, node, text) for node, text in slots(tree_of(page.as_py()))}
                found += own
                marks.append(np.full(len(own), mark, np.int64))
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (halves[:, 0], halves[:, 1], np.concatenate(marks or [np.empty(0, np.int64)]))], ["a", "b", "mark"])

    return pages.mapInArrow(run, "a long, b long, mark long")


def _agreements(pages: DataFrame) -> DataFrame:
    """host, path and text of the candidates that pages are aligned with; and a row for each page, with null path and text, of how much
    of it they are. pages: host, html and examples, an array of html and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Example]] = {}
        held = 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, host in enumerate(batch.column(0).to_pylist()):
                if host not in known:
                    given = batch.column(2)[i].as_py()
                    if held > 1 << 22:
                        known, held = {}, 0
                    held += sum(len(x["html"]) for x in given)
                    known[host] = [example_of(host, tree_of(x["html"]), {k["a"].to_bytes(8, "little", signed=True) + k["b"].to_bytes(8, "little", signed=True) for k in x["keys"]}) for x in given]
                found, part = agreement(tree_of(batch.column(1)[i].as_py()), known[host])
                for row in [(None, None, part), *((*x, None) for x in found)]:
                    for column, x in zip(out, (host, *row), strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["host", "path", "text", "part"])

    return pages.mapInArrow(run, "host string, path long, text string, part long")


def wrappers(pages: DataFrame, how: Induction = Induction()) -> DataFrame:
    """A table with host and template (JSON, path and digest of each template node) of each host that shows one. pages: host, html.

    All pages of a host are counted and aligned. Pages are told apart by 64 bits of hash, which only counts hang on.
    """
    spark = pages.sparkSession
    told = pages.select("host", "html").filter("html != ''").withColumn("mark", F.xxhash64("host", "html"))
    least = F.greatest(F.lit(how.support), F.ceil(F.lit(how.share) * F.col("pages")))
    with Staging(spark, "induction") as staging:
        marks = staging.save(told.groupBy("host", "mark").agg(F.count("*").alias("rows")), "marks")
        sizes = staging.save(marks.groupBy("host").agg(F.count("*").alias("pages")), "sizes")
        repeated, others = parted(told, F.col("mark"), marks.filter("rows > 1").select("mark"))
        told = others.unionAll(repeated.dropDuplicates(["mark"])).select("host", "mark", "html")
        counts = _texts_at_places(told).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("mark").alias("mark"))
        counts = staging.save(counts.filter(F.col("n") >= how.support), "counts")
        candidates = staging.save(counts.join(marks, "mark").join(sizes, "host").filter(F.col("n") >= least).select("host", "mark", "a", "b"), "candidates")
        lists = candidates.groupBy("host", "mark").agg(F.collect_list(F.struct("a", "b")).alias("keys"))
        some, _ = parted(told, F.col("mark"), candidates.select("mark"))
        chosen = some.join(lists, ["host", "mark"])
        examples = staging.save(chosen.groupBy("host").agg(F.collect_list(F.struct("html", "keys")).alias("examples")), "examples")
        agreed = staging.save(_agreements(told.join(examples, "host").select("host", "html", "examples")), "agreed", batch_rows=500)
        votes = agreed.filter("path is not null").groupBy("host", "path", "text").agg(F.count("*").alias("n"))
        parts = agreed.filter("path is null").groupBy("host").agg(F.sum("part").alias("part"))
        apart = sizes.join(parts, "host").filter(F.col("part") <= F.lit(how.share * how.same * PARTS) * F.col("pages"))
        nodes = votes.join(apart, "host").filter(F.col("n") >= least)
        template = F.to_json(F.sort_array(F.collect_list(F.struct("path", "text"))))
        return Staging(spark, "wrappers").save(nodes.groupBy("host").agg(template.alias("template")), "templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", how: Induction = Induction()) -> DataFrame:
    """page_id, url and text of every row; null and empty pages have an empty text.

    Repeated rows are extracted as often as they occur. Pages without a host share the wrapper of the empty host. Other columns
    are not read, whatever their names. An empty input has no rows. Very long pages and pages of any depth are read whole. Templates are
    made at once, from all pages, and stay in the shared folder as a table, small against the pages.
    """
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    joined = named.join(wrappers(named, how), "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict[int, frozenset[str]]] = {None: {}}
        for batch in batches:
            texts = []
            for page, template in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if template not in known:
                    if len(known) > 1000:
                        known = {None: {}}
                    known[template] = template_of((x["path"], x["text"]) for x in json.loads(template))
                texts.append(extract_text(page.as_py(), known[template]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {pages.schema[key].dataType.simpleString()}, url string, text string")
