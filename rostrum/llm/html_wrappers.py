"""Main text of web pages by wrappers that are inferred from each host's own pages.

A wrapper is a union-free regular expression over the tags of a page: a sequence
of elements and text slots in which groups may be optional or repeated. Pages
of a host are aligned into it one after another. Where two sequences differ,
what only one of them has becomes optional; neighbours that come again become a
repeated group; texts in which pages differ make a slot, and the texts that all
pages share there stay constants of the template. Merging wrappers is the same
operation, so a host's pages are folded in the tasks that read them, and then in
rounds of bounded groups by host: a host with a third of all pages never meets
in one task, and what is moved grows with templates, not with pages.

Extraction matches a page's tags against its host's expression, element by
element, and takes the text of slots that belong to the article: those below the
``article`` or ``main`` elements if the wrapper has any with text, else those
below the element in which most of its slot text gathers. Outside the article,
elements whose name, class, id or role says menu, header, footer, sidebar,
notice, advert, form or comments are passed over; inside it only tags, and words
that are exactly such a name (``ad``, ``comments``), are. A block all of whose
text is constant on at least :data:`LEAST_PAGES` pages is a notice of the
template and goes, unless such blocks are half of the page's article (then the
host's pages are copies of each other, and the text is theirs). A page of another
template has its text elsewhere: if the host's places hold none of it, the same
rule is applied to the page's own expression, and if another single element holds
most of it, that element is kept as well.

Defined results: null or empty html gives an empty text; a null or odd url is a
host of its own (the empty one); repeated rows get equal results; unclosed
tags end with their parents, at any depth; very long pages are read whole; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.html_tokens import BLOCK, Element, tree
from rostrum.llm.shared import join_spread, kept

#: Wrappers that one task folds at once.
FOLD = 64
#: Bytes of all wrappers up to which they are sent to every task; beyond, pages and wrappers are joined by host and salt.
BROADCAST_BYTES = 32 << 20
LONGEST_GROUP = 4
#: Share of the letters that an element must hold to be followed.
MOST = 0.6
#: Pages that must agree on a text before it counts as the template's.
LEAST_PAGES = 3
SKIPPED_TAGS = set("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu title".split())
#: Words of a class, id or role that mark what is not the article, outside of it.
SKIPPED_WORDS = re.compile(
    r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|side-?bar|aside|widget\w*|cookie\w*|consent|notices?|gdpr|popup|modal|alert|newsletter|subscri\w*|sign-?up|login|search|share|sharing|social|related|recommend\w*|comments?|replies|respond|disqus\w*|complementary|contentinfo|navigation|site-header|site-footer|page-header|page-footer|pagination|pager|skip-?link\w*|form)([-_].*)?$|[-_](ads?|nav|menu|sidebar|footer|comments?|banner)$"
)
#: The words that mark it inside the article, where longer names are names of its own parts.
INNER_WORDS = set("ad ads advert adverts advertisement sponsored banner sidebar navigation complementary contentinfo cookie cookies cookie-notice notice newsletter comments comment-list disqus_thread".split())
MAIN_TAGS = ("article", "main")
WHITE = re.compile(r"\s+")


def skipped(key: str, inside: bool = False) -> bool:
    tag, *words = key.split(".")
    if inside:
        return tag in SKIPPED_TAGS or any(w in INNER_WORDS for w in words)
    return tag in SKIPPED_TAGS or tag == "header" or any(SKIPPED_WORDS.search(w) for w in words)


@dataclass
class Node:
    """An element of a wrapper. pages: on how many it has text of its own; same: hashes of the texts that all of those hold;
    most: distinct texts of a page here, at most; mass: letters of all its texts."""

    key: str
    groups: list[Group] = field(default_factory=list)
    pages: int = 0
    same: frozenset[int] = frozenset()
    most: int = 0
    mass: int = 0
    folded: bool = False

    @property
    def constant(self) -> bool:
        """Whether all its text is the template's."""
        return self.pages >= LEAST_PAGES and len(self.same) == self.most


@dataclass
class Group:
    """Elements in a row. loose: in each repeat, any of them may be missing."""

    nodes: list
    optional: bool = False
    repeated: bool = False
    loose: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(n.key for n in self.nodes)


@dataclass
class Pair:
    """A node to be: what the pages of either side have in its place."""

    key: str
    left: list[Node]
    right: list[Node] = field(default_factory=list)


def _beside(a: Pair, b: Pair) -> Pair:
    """Two places of the same pages as one."""
    return Pair(a.key, a.left + b.left, a.right + b.right)


def _across(a: Pair, b: Pair) -> Pair:
    """A place of the left side's pages, and the same of the right side's."""
    return Pair(a.key, a.left, b.left)


def _merged(a: Group, b: Group, how) -> Group:
    return Group([how(x, y) for x, y in zip(a.nodes, b.nodes, strict=True)], a.optional or b.optional, a.repeated or b.repeated, a.loose or b.loose)


def align(a: list[Group], b: list[Group], how=_beside) -> list[Group]:
    """Longest common subsequence by keys; groups of one side only become optional, then repeats are folded."""
    head, n, m = 0, len(a), len(b)
    x, y = [g.keys for g in a], [g.keys for g in b]
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    out = [_merged(g, h, how) for g, h in zip(a[:head], b[:head], strict=True)]
    if head + tail < max(n, m):
        out += _align_middle(a[head : n - tail], b[head : m - tail], how)
    out += [_merged(g, h, how) for g, h in zip(a[n - tail :], b[m - tail :], strict=True)]
    return fold(out)


def _align_middle(a: list[Group], b: list[Group], how) -> list[Group]:
    right_only = lambda g: Group([Pair(p.key, [], p.left) for p in g.nodes] if how is _across else g.nodes, True, g.repeated, g.loose)
    n, m = len(a), len(b)
    x, y = [g.keys for g in a], [g.keys for g in b]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_merged(a[i], b[j], how))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(Group(a[i].nodes, True, a[i].repeated, a[i].loose))
            i += 1
        else:
            out.append(right_only(b[j]))
            j += 1
    return out


def fold(groups: list[Group]) -> list[Group]:
    """Neighbouring groups, or sequences of up to LONGEST_GROUP elements, that come again become one repeated group."""
    out: list[Group] = []
    for g in groups:
        out.append(g)
        again = True
        while again:
            again = False
            if len(out) > 1 and out[-1].keys == out[-2].keys:
                b, a = out.pop(), out.pop()
                out.append(Group(_merged(a, b, _beside).nodes, a.optional and b.optional, True, a.loose or b.loose))
                again = True
                continue
            for width in range(2, min(LONGEST_GROUP, len(out)) + 1):
                tail = out[-2 * width :]
                if len(tail) == 2 * width and [x.keys for x in tail[:width]] == [x.keys for x in tail[width:]] and all(len(x.nodes) == 1 for x in tail):
                    del out[-2 * width :]
                    nodes = [_beside(x.nodes[0], y.nodes[0]) for x, y in zip(tail[:width], tail[width:], strict=True)]
                    out.append(Group(nodes, all(x.optional for x in tail), True, any(x.optional or x.repeated for x in tail)))
                    again = True
                    break
                if width < len(out) and out[-width - 1].repeated and out[-width - 1].keys == tuple(k for x in out[-width:] for k in x.keys):
                    last = out[-width:]
                    del out[-width:]
                    out[-1] = _merged(out[-1], Group([n for x in last for n in x.nodes], False, True, any(x.optional or x.repeated for x in last)), _beside)
                    again = True
                    break
    return out


def _one_side(nodes: list[Node]) -> tuple[list[Group], int, frozenset[int], int, int]:
    """What places of the same pages have together: groups, pages, texts of all pages, most texts of a page, letters."""
    groups: list[Group] | None = None
    for n in nodes:
        g = [Group([Pair(c.key, [c]) for c in x.nodes], x.optional, x.repeated, x.loose) for x in n.groups]
        g = g if n.folded else fold(g)
        groups = g if groups is None else align(groups, g)
    pages, same = max((n.pages for n in nodes), default=0), frozenset().union(*(n.same for n in nodes))
    if pages > 1 and any(0 < n.pages < pages for n in nodes):  # a place that only some of the pages have proves nothing for all
        same = frozenset().union(*(n.same for n in nodes if n.pages == pages))
    return groups or [], pages, same, sum(n.most for n in nodes), sum(n.mass for n in nodes)


def _resolved(root: Pair) -> Node:
    """The wrapper of a pair, without recursion: a page may be as deep as it likes."""
    out = Node(root.key, folded=True)
    todo = [(root, out)]
    while todo:
        pair, node = todo.pop()
        groups, node.pages, node.same, node.most, node.mass = _one_side(pair.left)
        if pair.right:
            other, pages, same, most, mass = _one_side(pair.right)
            groups = align(groups, other, _across) if pair.left else other
            node.same = node.same & same if node.pages and pages else node.same | same
            node.pages, node.most, node.mass = node.pages + pages, max(node.most, most), node.mass + mass
        for g in groups:
            fresh = [Node(p.key, folded=True) for p in g.nodes]
            todo += zip(g.nodes, fresh, strict=True)
            node.groups.append(Group(fresh, g.optional, g.repeated, g.loose))
    return out


def merge_nodes(a: Node, b: Node) -> Node:
    """The wrapper of the pages of both."""
    return _resolved(Pair(a.key, [a], [b]))


def wrapper_of(e: Element) -> Node:
    """The wrapper of one page."""
    root = Node(e.key)
    todo = [(e, root)]
    while todo:
        e, node = todo.pop()
        texts = set()
        for c in e.children:
            if isinstance(c, str):
                if not c.isspace() and c:
                    texts.add(_stable_hash(c))
                    node.mass += len(c)
            else:
                child = Node(c.key)
                node.groups.append(Group([child]))
                todo.append((c, child))
        if texts:
            node.pages, node.same, node.most = 1, frozenset(texts), len(texts)
    return _resolved(Pair(root.key, [root]))


def _stable_hash(text: str) -> int:
    """64 bits of a text, white space folded; equal in every process."""
    return int.from_bytes(blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def packed(root: Node) -> bytes:
    """The wrapper as flat rows, parents first, so that depth does not matter."""
    rows, todo = [], [root]
    while todo:
        n = todo.pop()
        rows.append((n.key, n.pages, sorted(n.same), n.most, n.mass, [(len(g.nodes), g.optional, g.repeated, g.loose) for g in n.groups]))
        todo += [c for g in reversed(n.groups) for c in reversed(g.nodes)]
    return pickle.dumps(rows)


def unpacked(b: bytes) -> Node:
    first = Node("")
    todo = [first]
    for key, pages, same, most, mass, groups in pickle.loads(b):
        n = todo.pop()
        n.key, n.pages, n.same, n.most, n.mass, n.folded = key, pages, frozenset(same), most, mass, True
        n.groups = [Group([Node("") for _ in range(k)], *flags) for k, *flags in groups]
        todo += [c for g in reversed(n.groups) for c in reversed(g.nodes)]
    return first


def _letters(root: Node) -> dict[int, int]:
    """By id of a node: letters of slots in it and below it, without links and what is passed over."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        n, parent = todo.pop()
        order.append((n, parent))
        todo += [(c, n) for g in n.groups for c in g.nodes if not skipped(c.key) and c.key.split(".")[0] != "a"]
    out = {id(n): 0 if n.constant else n.mass for n, _ in order}
    for n, parent in reversed(order):
        if parent is not None:
            out[id(parent)] += out[id(n)]
    return out


def marked_places(root: Node) -> list[Node]:
    """The outermost elements with text of the first of MAIN_TAGS that has any."""
    letters = _letters(root)
    for tag in MAIN_TAGS:
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.key.split(".")[0] == tag and letters.get(id(n)):
                found.append(n)
            else:
                todo += [c for g in n.groups for c in g.nodes if not skipped(c.key)]
        if found:
            return found
    return []


def gathered_place(root: Node) -> Node:
    """The element in which the slot text gathers."""
    letters, at = _letters(root), root
    while True:
        inner = [(c, letters.get(id(c), 0)) for g in at.groups for c in g.nodes]
        c, mass = max(inner, key=lambda x: x[1], default=(None, 0))
        if c is None or c.key.split(".")[0] in ("p", "h1", "h2", "h3", "li", "pre", "blockquote") or mass < MOST * letters[id(at)] or not mass:
            return at
        at = c


def places(root: Node) -> set[int]:
    """Ids of the nodes of a wrapper that hold the article."""
    return {id(n) for n in marked_places(root) or [gathered_place(root)]}


def matched(page: Element, wrapper: Node) -> dict[int, Node]:
    """By id of an element: the node of the expression that it is an instance of."""
    out, index = {id(page): wrapper}, {}
    todo = [(page, wrapper)]
    while todo:
        e, n = todo.pop()
        if id(n) not in index:
            flat = [(c, g, k) for g in n.groups for k, c in enumerate(g.nodes)]
            where: dict[str, list[int]] = {}
            for i, (c, _, _) in enumerate(flat):
                where.setdefault(c.key, []).append(i)
            index[id(n)] = flat, where
        flat, where = index[id(n)]
        at = 0  # the next place of the sequence
        for c in e.children:
            if isinstance(c, str) or c.key not in where:
                continue
            all_ = where[c.key]
            begin = at
            if at and flat[at - 1][1].repeated:  # the group may come again
                last = flat[at - 1]
                begin = at - 1 - last[2] if at == len(flat) or flat[at][1] is not last[1] else at
            k = bisect_left(all_, begin)
            i = all_[k] if k < len(all_) else all_[0]
            at = i + 1
            out[id(c)] = flat[i][0]
            todo.append((c, flat[i][0]))
    return out


def _walk(root: Element, roots: set[int]) -> Iterable[tuple[str, object, bool]]:
    """(kind, value, inside): texts and block bounds in page order, without what is passed over."""
    todo: list[tuple[str, object, bool]] = [("open", root, False)]
    while todo:
        kind, e, inside = todo.pop()
        if kind != "open":
            yield kind, e, inside
            continue
        inside = inside or id(e) in roots
        if e.tag in BLOCK:
            yield "bound", e, inside
            todo.append(("bound", e, inside))
        elif e.tag in ("td", "th"):
            yield "gap", e, inside
        for c in reversed(e.children):
            if isinstance(c, str):
                todo.append(("text", (c, e), inside))
            elif c.tag == "br":
                todo.append(("gap", c, inside))
            elif not skipped(c.key, inside or id(c) in roots) or id(c) in roots:
                todo.append(("open", c, inside))


def _outside(root: Element, roots: set[int]) -> tuple[int, int]:
    """Letters outside and inside of the places, without links and what is passed over."""
    letters = [0, 0]
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or id(e) in roots
        for c in e.children:
            if isinstance(c, str):
                if not c.isspace():
                    letters[inside] += len(c)
            elif c.tag != "a" and not skipped(c.key, inside):
                todo.append((c, inside))
    return letters[0], letters[1]


def _covered(root: Element, inner: set[int], outer: set[int]) -> bool:
    """Whether an element of inner lies in, or holds, one of outer."""
    todo = [(root, False, False)]
    while todo:
        e, in_a, in_b = todo.pop()
        in_a, in_b = in_a or id(e) in inner, in_b or id(e) in outer
        if in_a and in_b:
            return True
        todo += [(c, in_a, in_b) for c in e.children if not isinstance(c, str)]
    return False


class Wrapper:
    """A host's expression with its places, to be applied to many pages."""

    def __init__(self, root: Node):
        self.root, self.places = root, places(root)

    def text(self, page: str | None) -> str:
        """The blocks of the article, in page order, joined by an empty line."""
        root = tree(page or "")
        node = matched(root, self.root)
        roots = self._roots(root, node)
        blocks: list[tuple[str, bool]] = []
        parts: list[str] = []
        constant = True

        def flush() -> None:
            nonlocal constant
            text = WHITE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                blocks.append((text, constant))
            constant = True

        for kind, value, inside in _walk(root, roots):
            if kind == "bound":
                flush()
            elif kind == "gap":
                parts.append(" ")
            elif inside:
                text, e = value
                parts.append(text)
                if constant and not text.isspace():
                    n = node.get(id(e))
                    constant = n is not None and n.pages >= LEAST_PAGES and _stable_hash(text) in n.same
        flush()
        fixed = sum(len(t) for t, c in blocks if c)
        if 2 * fixed < sum(len(t) for t, _ in blocks):
            blocks = [b for b in blocks if not b[1]]
        return "\n\n".join(t for t, _ in blocks)

    def _roots(self, root: Element, node: dict[int, Node]) -> set[int]:
        """Elements that hold this page's article: the host's places, and the page's own where its text is not in those."""
        host = {e for e, n in node.items() if id(n) in self.places}
        outside, inside = _outside(root, host)
        if outside < MOST * (outside + inside) or not outside:
            return host
        own = wrapper_of(root)
        mine = matched(root, own)
        if not inside:
            chosen = places(own)
            return host | {e for e, n in mine.items() if id(n) in chosen}
        place = gathered_place(own)
        more = {e for e, n in mine.items() if n is place}
        return host if _covered(root, more, host) else host | more


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def fold_all(all_packed: Iterable[bytes]) -> Node:
    whole = None
    for b in all_packed:
        n = unpacked(b)
        whole = n if whole is None else merge_nodes(whole, n)
    return whole


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): one row per host."""

    def infer(batches):
        for batch in batches:
            found: dict[str, tuple[Node, int]] = {}
            for host, page in zip(*(batch.column(k) for k in range(2)), strict=True):
                host, one = host.as_py(), wrapper_of(tree(page.as_py() or ""))
                whole, n = found.get(host, (None, 0))
                found[host] = (one if whole is None else merge_nodes(whole, one), n + 1)
            if found:
                yield pa.record_batch([pa.array(list(found)), pa.array([n for _, n in found.values()]), pa.array([packed(w) for w, _ in found.values()], pa.binary())], ["host", "pages", "wrapper"])

    def fold_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("wrapper")
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "pages": [rows["pages"].sum()], "wrapper": [packed(fold_all(rows["wrapper"]))]})

    schema = "host string, pages bigint, wrapper binary"
    part = kept(pages.select(host_of().alias("host"), "html").mapInArrow(infer, schema))
    most = part.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:  # a host's wrappers meet FOLD by FOLD
        most = -(-most // FOLD) if most > FOLD else 1
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(most))
        part = part.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(fold_group, schema)
        part = kept(part) if most > 1 else part
    return kept(part)


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array, wrapper: pa.Array) -> pa.Array:
    known: dict[bytes, Wrapper] = {}
    out = []
    for page, w in zip(pages, wrapper, strict=True):
        w = w.as_py()
        if w not in known:
            known[w] = Wrapper(unpacked(w) if w is not None else Node("#"))
        out.append(known[w].text(page.as_py()))
    return pa.array(out, pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """pages with a column ``__text``: the main text."""
    of_host = wrappers(pages)
    size = of_host.agg(F.sum(F.length("wrapper")).alias("bytes"), F.sum("pages").alias("pages")).first()
    right = of_host.select(F.col("host").alias("__h"), F.col("wrapper").alias("__w"))
    left = pages.withColumn("__h", host_of())
    if (size.bytes or 0) <= BROADCAST_BYTES:
        joined = left.join(F.broadcast(right), "__h", "left")
    else:
        joined = join_spread(left, right, "__h", size.pages or 0, by=F.xxhash64("html"))
    return joined.withColumn("__text", _extract("html", "__w")).drop("__h", "__w")


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    done = extract(pages)
    return done.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
