"""Main text of web pages by wrapper induction.

Pages of one host fall into classes by the tags that they use; a class of ``CLASS_PAGES`` pages or more has a
pivot of its own (its smallest page id), other pages are aligned with that of the host's largest class. A page is
aligned with its pivot by simple tree matching: the largest common top-down subtree, children in
order. Over all pages of the class, the share of aligned pages that repeat a pivot
node's own text decides what the node is: constant nodes are template, varying ones
are slots of content. The counts are sums per class and node, so that a host with a third
of all pages is counted in every task that has some. A page's text is that of its
slots: of those in its ``main`` elements, else in its ``article`` elements, unless these are cards beside a longer text, else
in its body; outside articles without lists of links; always without template nodes (a word
marked up inside a varying text is part of that, and an article of which the template
would leave less than half is content) and without
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and comments of
readers, known by element, role, and what a class or id calls the element itself; a
named element or form that wraps the page's content stays.

Defined results: null and empty pages have an empty text; broken markup is
read leniently, with the implied ends of paragraphs and items; a page without or
with an invalid URL belongs to the host ``""``; equal pages don't make
each other template; pages of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.llm.common import slices, stored, table, text_column

#: A node is template if this many aligned pages, and this share of them, repeat its text.
LEAST_PAGES, LEAST_SHARE = 2, 0.5
#: Pages of a class that has a pivot of its own.
CLASS_PAGES = 3
#: Bytes of pivots and templates that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Characters of attributes whose meaning is remembered.
SHORT = 256
#: Share of a block's text in links from which on the block is a list of links.
LINK_SHARE = 0.5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
SCOPES = frozenset("ul ol dl table tbody thead article section div main aside nav body html td th blockquote".split())
DROPPED = frozenset("head nav header footer aside script style noscript template iframe object embed svg button select textarea input dialog menu title noembed noframes canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

READERS = frozenset("comment comments disqus replies reply respond".split())
#: Words of a class that say what an element has or lacks, not what it is.
ABOUT = frozenset("has have is no non not with without hide show enable disable enabled disabled".split())
#: Last words of a class that name no more than a container of what stands before.
HOLDERS = frozenset("area bar block body box col column container content group holder inner item items list outer panel section unit wrap wrapper".split())
#: Why an element is dropped: whatever it holds, or unless it wraps the page's content.
ALWAYS, NAMED, COMMENTS = 1, 2, 3

#: A comment, a declaration or a tag; where quotes aren't closed, a tag ends with the next ``>``. Nothing is
#: tried twice, and no tag is looked for behind the last ``>`` of a page.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element: ``children`` holds its texts and elements in order, ``inner`` the elements alone."""

    __slots__ = ("children", "dropped", "inner", "own", "shape", "size", "tag")

    def __init__(self, tag: str, dropped: int) -> None:
        self.tag, self.dropped = tag, dropped
        self.children: list[Node | str] = []
        self.inner: list[Node] = []
        self.own: str | None = None
        self.shape, self.size = 0, 1

    def elements(self) -> list[Node]:
        return self.inner

    def own_text(self) -> str:
        if self.own is None:
            texts = [c for c in self.children if c.__class__ is str] if self.inner else self.children
            self.own = " ".join("".join(texts).split())
        return self.own


def _name(token: str) -> str | None:
    """The word of ``NAMES`` that a class or id says the element is: the whole token, or
    its last word (before those of ``HOLDERS``) where it isn't about another element."""
    if token.lower() in NAMES:
        return token.lower()
    words = [w.lower() for w in _PARTS.findall(token)]
    while words and (words[-1] in HOLDERS or words[-1].isdigit()):
        words.pop()
    return words[-1] if words and words[-1] in NAMES and not ABOUT.intersection(words) else None


def drop_reason(tag: str, attributes: str) -> int:
    """0 if an element stays, else ``ALWAYS``, ``NAMED`` or ``COMMENTS``."""
    if tag in DROPPED:
        return ALWAYS
    found = NAMED if tag == "form" else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return found
    return (_reason_of if len(attributes) <= SHORT else _reason_of.__wrapped__)(tag, attributes, found)


@lru_cache(maxsize=1 << 14)
def _reason_of(tag: str, attributes: str, found: int) -> int:
    """The same of a tag with attributes; pages of a site share most of them."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return ALWAYS
        if name not in ("class", "id", "role", "style", "aria-hidden"):
            continue
        value = value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return ALWAYS
        if name == "role" and value.lower() == "form":
            found = max(found, NAMED)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return ALWAYS
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in filter(None, map(_name, value.split())):
                found = max(found, COMMENTS if word in READERS else NAMED)
    return found


def _keep_wrappers(root: Node, named: list[Node]) -> None:
    """Takes back the drop of elements that have ``main``, the page's only ``article`` or
    most of its text; readers' comments stay only where they have ``main``."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.inner if c.dropped != ALWAYS]
    sums: dict[int, tuple[int, int, int]] = {}
    for node in reversed(order):
        size = mains = articles = 0
        for c in node.children:
            if c.__class__ is str:
                size += len(c.strip())
            elif id(c) in sums:
                n = sums[id(c)]
                size, mains, articles = size + n[0], mains + n[1], articles + n[2]
        sums[id(node)] = size, mains + (node.tag == "main"), 1 if node.tag == "article" else articles
    total = sums[id(root)]
    for node in named:
        size, mains, articles = sums.get(id(node), (0, 0, 0))
        if mains or node.dropped == NAMED and (articles == total[2] == 1 or 2 * size > total[0]):
            node.dropped = 0


def parse(page: str, reasons: bool = True) -> Node:
    """A lenient tree of a page; without ``reasons`` of its elements only, none of which is marked as dropped."""
    root, named = Node("#root", 0), []
    stack, at, n = [root], 0, len(page)
    last, last_data, open_ = page.rfind(">") + 1, page.rfind("]]>"), {}
    search, unescape = _TAG.search, entities.unescape

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = search(page, at, last) if at < last else None
        if m is None:
            comment = page.find("<!--", at)
            stack[-1].children.append(unescape(page[at : n if comment < 0 else comment]))
            break
        start, end = m.span()
        if start > at:
            text = page[at:start]
            stack[-1].children.append(unescape(text) if "&" in text else text)
        at = end
        closing, tag, attributes, closing_, tag_, attributes_ = m.groups()
        if tag is None:
            closing, tag, attributes = closing_, tag_, attributes_
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                break  # a comment that isn't closed
            if m[0].startswith("<![CDATA[") and start < last_data:
                at = page.find("]]>", start) + 3
                stack[-1].children.append(page[start + 9 : at - 3])
            continue
        tag = tag.lower()
        if closing:
            if stack[-1].tag == tag and len(stack) > 1:
                stack.pop()
                open_[tag] -= 1
            elif open_.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        for closed in ENDS.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1) if open_.get(closed) else ():
                if stack[k].tag == closed:
                    close(k)
                    break
                if stack[k].tag in SCOPES and stack[k].tag != tag and (closed == "p" or stack[k].tag in ("ul", "ol", "dl", "table")):
                    break
        # what is pressed inside a paragraph is a word of it
        node = Node(tag, 0 if not reasons or tag == "button" and open_.get("p") else drop_reason(tag, attributes))
        if node.dropped > ALWAYS:
            named.append(node)
        above = stack[-1]
        above.children.append(node)
        above.inner.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+>", re.IGNORECASE).search(page, at, last)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    if named:
        _keep_wrappers(root, named)
    return root


def numbered(root: Node) -> list[Node]:
    """All elements, parents first; sets each one's ``size``, and ``shape``, equal for equal trees of tags."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.elements())
    for node in reversed(order):
        inner = node.inner
        if inner:
            node.shape, node.size = hash((node.tag, *[c.shape for c in inner])), 1 + sum([c.size for c in inner])
        else:
            node.shape = hash((node.tag,))
    return order


def match(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> int:
    """Size of the largest common top-down subtree (simple tree matching) of numbered
    trees; ``sizes`` gets those of the pairs below whose shapes differ."""
    todo = [(a, b, False)]
    while todo:
        p, q, ready = todo.pop()
        if p.tag != q.tag or p.shape == q.shape or (id(p), id(q)) in sizes:
            continue
        if ready:
            sizes[id(p), id(q)] = 1 + sum(w for _, _, w in _children(p, q, sizes))
            continue
        todo.append((p, q, True))
        _, x, y = _ends(p, q)
        todo += [(c, d, False) for c in x for d in y]
    return _size(a, b, sizes)


def _size(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> int:
    if a.tag != b.tag:
        return 0
    return a.size if a.shape == b.shape else sizes[id(a), id(b)]


def _ends(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """The equal trees at either end of the children, and the other children of both."""
    x, y = a.elements(), b.elements()
    head = 0
    while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    equal = [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
    return equal, x[head : len(x) - tail], y[head : len(y) - tail]


def _children(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> list[tuple[Node, Node, int]]:
    """The matched children with their weights, after ``match``. Equal trees at either end
    are matched first, which no other matching beats."""
    equal, x, y = _ends(a, b)
    pairs = [(p, q, p.size) for p, q in equal]
    if not x or not y:
        return pairs
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    weight = [[_size(p, q, sizes) for q in y] for p in x]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + weight[i - 1][j - 1])
    i, j = len(x), len(y)
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            pairs.append((x[i - 1], y[j - 1], weight[i - 1][j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def align(pivot: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs (pivot's node, page's node) of the largest common top-down subtree."""
    sizes: dict[tuple[int, int], int] = {}
    match(pivot, page, sizes)
    out, todo = [], [(pivot, page)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        if a.shape == b.shape:
            todo += zip(a.inner, b.inner, strict=True)
        else:
            todo += [(p, q) for p, q, w in _children(a, b, sizes) if w]
    return out


def _links(roots: list[Node]) -> dict[int, tuple[int, int]]:
    """By element below ``roots``: (characters in links, characters) of its subtree."""
    order, todo = [], list(roots)
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.elements()
    found: dict[int, tuple[int, int]] = {}
    for x in reversed(order):
        linked, total = 0, len(x.own_text())
        for c in x.inner:
            below = found[id(c)]
            linked, total = linked + below[0], total + below[1]
        found[id(x)] = (total if x.tag == "a" else linked), total
    return found


def _outermost(root: Node, tag: str) -> list[Node]:
    """The elements of a tag that aren't dropped or inside another one, in order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        if node.tag == tag:
            found.append(node)
        else:
            todo += reversed(node.elements())
    return found


def _whole_blocks(root: Node, template: set[int]) -> set[int]:
    """``template`` without the inline elements inside a text that stays."""
    cut, todo = set(), [(root, False)]
    while todo:
        x, flowing = todo.pop()
        flowing = flowing and x.tag in INLINE
        if id(x) in template and not flowing:
            cut.add(id(x))
        elif x.own_text():
            flowing = True
        todo += [(c, flowing) for c in x.elements()]
    return cut


def _text_size(nodes: list[Node], template: set[int]) -> int:
    """Characters of the texts below ``nodes`` that are neither dropped nor template."""
    size, todo = 0, list(nodes)
    while todo:
        x = todo.pop()
        if not x.dropped:
            size += 0 if id(x) in template else len(x.own_text())
            todo += x.elements()
    return size


def _are_cards(articles: list[Node], around: list[Node], template: set[int]) -> bool:
    """Whether articles, several or mostly of links, hold less than half of the text around them."""
    if len(articles) == 1:
        linked, total = _links(articles)[id(articles[0])]
        if linked < LINK_SHARE * total:
            return False
    return 2 * _text_size(articles, template) < _text_size(around, template)


def main_text(root: Node, template: set[int]) -> str:
    """The text of a page; ``template`` has the ids (Python's) of template nodes."""
    if template:
        template = _whole_blocks(root, template)
    mains, articles = _outermost(root, "main"), _outermost(root, "article")
    chosen = mains
    if articles and (not mains or not _inside(articles, mains)) and not _are_cards(articles, mains or [root], template):
        chosen = articles
    if chosen and template and 2 * _text_size(chosen, template) < _text_size(chosen, set()):
        template = set()
    out: list[str] = []
    links = _links(chosen or [root])
    todo: list[tuple[Node | str, bool]] = [(x, False) for x in reversed(chosen or [root])]
    while todo:
        x, article = todo.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        if x.dropped:
            out.append("" if x.tag in INLINE else " ")
            continue
        article = article or x.tag == "article"
        if not article and x.tag in ("ul", "ol", "table", "div", "p"):
            linked, total = links[id(x)]
            if total and linked >= (1 if x.tag == "p" else LINK_SHARE) * total:
                out.append(" ")
                continue
        children = x.elements() if id(x) in template else x.children
        edge = "" if x.tag in INLINE else " "
        todo.append((edge, article))
        todo += [(c, article) for c in reversed(children)]
        out.append(edge)
    return " ".join("".join(out).split())


def _inside(nodes: list[Node], roots: list[Node]) -> bool:
    """Whether all nodes are below the roots."""
    below, todo = set(), list(roots)
    while todo:
        x = todo.pop()
        below.add(id(x))
        todo += x.elements()
    return all(id(n) in below for n in nodes)


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Pivots:
    """Parsed pivots of a task, by host."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, Node, dict[int, int]]] = {}

    def of(self, host: str, page: str) -> tuple[str, Node, dict[int, int]]:
        """The pivot's HTML, tree, and its nodes' numbers by Python id."""
        found = self.known.get(host)
        if found is None:
            if len(self.known) > 200:
                self.known.clear()
            root = parse(page)
            found = self.known[host] = (page, root, {id(x): i for i, x in enumerate(numbered(root))})
        return found


def sites(rows: DataFrame) -> DataFrame:
    """Rows (page_id, html, host, ...) with ``host`` made the name of their class of pages on that host."""
    shape = F.xxhash64(F.array_distinct(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))))
    shaped = rows.withColumn("shape", shape)
    classes = shaped.filter("trim(html) <> ''").groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    large = classes.filter(F.col("n") >= CLASS_PAGES).select("host", "shape", F.col("shape").alias("site"))
    main = classes.groupBy("host").agg(F.max(F.struct("n", F.struct((-F.col("first")).alias("first"), "shape").alias("which"))).alias("most")).select("host", F.col("most.which.shape").alias("rest"))
    named = shaped.join(_small(stored(large, "classes"), F.lit(64)), ["host", "shape"], "left").join(_small(stored(main, "classes"), F.lit(64)), "host", "left")
    return named.withColumn("host", F.concat_ws(" ", "host", F.coalesce("site", "rest").cast("string"))).drop("shape", "site", "rest")


def pivots_of(rows: DataFrame) -> DataFrame:
    """(host, pivot) of rows (page_id, html, host): the HTML of each host's pivot."""
    ids = rows.filter("trim(html) <> ''").groupBy("host").agg(F.min("page_id").alias("page_id"))
    found = rows.join(_small(ids, F.lit(64)), ["host", "page_id"]).filter("trim(html) <> ''")
    return stored(found.groupBy("host").agg(F.min("html").alias("pivot")), "pivots")


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` to be broadcast, if its rows' sizes add up to no more than ``BROADCAST_BYTES``;
    otherwise Spark joins by shuffling, and splits hosts with many pages."""
    n = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def induce(paired: DataFrame) -> DataFrame:
    """(host, node): the pivots' template nodes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, seen = Pivots(), {}

        def result() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in keys], pa.string()), "node": pa.array([k[1] for k in keys], pa.int32()), "pages": pa.array([seen[k][0] for k in keys], pa.int64()), "equal": pa.array([seen[k][1] for k in keys], pa.int64())})

        for part in slices(batches, "html"):
            for host, page, pivot in zip(*(part.column(c).to_pylist() for c in ("host", "html", "pivot")), strict=True):
                source, tree, place = pivots.of(host, pivot)
                if page == source or not page:
                    continue
                root = parse(page, reasons=False)
                numbered(root)
                for a, b in align(tree, root):
                    if a.own_text():
                        n = seen.setdefault((host, place[id(a)]), [0, 0])
                        n[0] += 1
                        n[1] += a.own_text() == b.own_text()
            if len(seen) > 100_000:
                yield result()
                seen.clear()
        if seen:
            yield result()

    counts = paired.select("host", "html", "pivot").mapInArrow(count, "host string, node int, pages long, equal long")
    total = counts.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"))
    return total.filter((F.col("equal") >= LEAST_PAGES) & (F.col("equal") >= LEAST_SHARE * F.col("pages"))).select("host", "node")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_column(html_col).alias("html"))
    hosted = sites(rows.withColumn("host", F.coalesce(_host("url"), F.lit(""))))
    pivots = pivots_of(hosted)
    nodes = induce(hosted.join(_small(pivots, F.octet_length("pivot")), "host")).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))
    # only hosts with a template need their pivot again
    wrappers = stored(pivots.join(nodes, "host"), "wrappers")
    paired = hosted.join(_small(wrappers, F.octet_length("pivot") + 4 * F.size("template")), "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots()
        for part in slices(batches, "html"):
            texts = []
            for host, page, pivot, nodes in zip(*(part.column(c).to_pylist() for c in ("host", "html", "pivot", "template")), strict=True):
                root, constant = parse(page), set()
                if nodes:
                    _, tree, place = pivots.of(host, pivot)
                    numbered(root)
                    wanted = set(nodes)
                    constant = {id(b) for a, b in align(tree, root) if place[id(a)] in wanted and a.own_text() == b.own_text()}
                texts.append(main_text(root, constant))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return paired.select("page_id", "url", "host", "html", "pivot", "template").mapInArrow(work, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
