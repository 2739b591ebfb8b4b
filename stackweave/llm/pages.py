"""Main text of web pages, with removal of site templates.

Site templates: every element subtree is hashed (tag, attributes that name it, text and children). Spark counts, per
host, on how many different pages each hash occurs; a subtree on many pages of its host is a template and is deleted. A
subtree that recurs within one page only counts once.
A host's pages are told apart by their main content, so thousands of copies of one page count as one. Templates per host are
few: a subtree must be on a set share of the pages, so at most (subtrees of a page / share) of them exist.

The text is what remains of the article (article, else main, else body) without elements that say what they are:
navigation, page headers and footers, asides, forms, notices, adverts, comments, scripts and styles. Articles are copied
between pages, so a paragraph, quotation or other running text of an article counts at most once per page and once per distinct pair of
neighbours: copies and near copies do not add up, a notice amid different texts does. Headings, list items, table
cells, terms and definitions of an article are never taken for templates, as one short label ("Yes", "Summary") means
something else on every page; where a page has no article, any recurring subtree goes.

Character references are decoded, white space (ASCII) becomes one space, blocks are joined by one space. A null html is
empty, so is the text of a page without content. A null url is a host of its own. Repeated rows and null ids are kept.
Broken or truncated markup is read as far as it goes: open elements end with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stackweave.llm.common import pieces, stored

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option caption".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption".split())
LABELS = TEXT_BLOCKS - {"p", "blockquote", "pre", "figcaption", "caption"}
CLOSES_P = BLOCKS - {"br", "body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "option", "caption"} | {"p"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div body main".split())
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg dialog menu title xmp object canvas audio video math".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal newsletter "
                  "subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond share sharing social related "
                  "recommended widget toolbar pagination pager search login signup masthead topbar alert".split())
TOPICS = frozenset("alert login related search share social".split())  # inside an article also names of its content
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "names", "role", "children", "hash")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.hash = tag, [], 0
        self.names: list[str] = []
        self.role = ""
        if attributes and ("=" in attributes):
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                if name.lower() in ("class", "id"):
                    self.names += value.split()
                elif name.lower() == "role":
                    self.role = value


def parse(page: str) -> Node:
    root = Node("html")
    stack, at = [root], 0
    for _ in range(len(page) + 1):
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag not in ("tr",):
                        break
                elif stack[i].tag in FENCES:
                    break
        node = Node(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCKS | {"article"}:  # a slash means nothing on these
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _walk(root: Node, inside: bool = False) -> Iterator[tuple[Node, bool]]:
    """(node, inside an article) of all nodes, parents first, without recursion."""
    todo = [(root, inside)]
    while todo:
        node, inside = todo.pop()
        yield node, inside
        inner = inside or node.tag == "article"
        todo += [(c, inner) for c in reversed(node.children) if isinstance(c, Node)]


def hash_subtrees(root: Node) -> None:
    for node in reversed([n for n, _ in _walk(root)]):
        parts = [_SPACE.sub(" ", c).strip() if isinstance(c, str) else f"<{c.hash}>" for c in node.children]
        body = "".join(p for p in parts if p)
        node.hash = xxhash.xxh64_intdigest(f"{node.tag}\0{' '.join(node.names)}\0{body}") - (1 << 63) if body else 0


def is_boilerplate(node: Node, inside: bool) -> bool:
    """The element says itself that it is not main text."""
    if node.tag in NOT_TEXT or node.role in ROLES or (node.tag == "header" and not inside):
        return True
    if node.tag in ("article", "main", "body", "html"):
        return any(n in ("comment", "comments") for n in node.names)
    for name in node.names:
        parts = re.split(r"[-_]+", name)
        if inside:  # a part of a name says too little there ("search-results", "related-work")
            if name in NAMES - TOPICS or all(p in NAMES for p in parts) and len(parts) > 1:
                return True
        elif name in NAMES or any(p in NAMES for p in parts) or (not inside and "header" in parts):
            return True
    return False


def content_roots(root: Node) -> list[Node]:
    """Outermost articles outside boilerplate, else main, else the body or all."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if is_boilerplate(node, False):
            continue
        kind = "main" if node.role == "main" else node.tag
        if kind in found:
            found[kind].append(node)
        if kind != "article":
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found["article"] or found["main"][:1] or found["body"][:1] or [root]


def _around(node: Node) -> dict[int, int]:
    """For each child element by id, a hash of its nearest neighbours with text."""
    shown = [(id(c), str(c.hash)) if isinstance(c, Node) else (None, _SPACE.sub(" ", c).strip()) for c in node.children]
    shown = [(i, h) for i, h in shown if h not in ("", "0")]
    sides = ["", *(h for _, h in shown), ""]
    return {i: xxhash.xxh64_intdigest(f"{sides[k]}\0{sides[k + 2]}") - (1 << 63) for k, (i, _) in enumerate(shown) if i is not None}


def candidates(root: Node) -> list[tuple[int, int | None]]:
    """(hash, neighbours) of the subtrees that may be a template: elements with text. Only text blocks of an article or
    main have neighbours; its labels and data (LABELS) are left out."""
    roots = content_roots(root)
    chosen = {id(r) for r in roots}
    safe = roots[0].tag in ("article", "main") or roots[0].role == "main"
    out, todo = set(), [(root, False, 0)]
    while todo:
        node, inside, around = todo.pop()
        inside = inside or (safe and id(node) in chosen)
        if node.hash and id(node) not in chosen and node.tag in BLOCKS and not (inside and node.tag in LABELS):
            out.add((node.hash, around if inside and node.tag in TEXT_BLOCKS else None))
        beside = _around(node) if inside else {}
        todo += [(c, inside, beside.get(id(c), 0)) for c in node.children if isinstance(c, Node)]
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def main_text(root: Node, templates: frozenset[int]) -> str:
    parts: list[str] = []
    roots = content_roots(root)
    safe = roots[0].tag in ("article", "main") or roots[0].role == "main"
    for top in roots:
        todo: list = [top]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
                continue
            if node is not top:
                if is_boilerplate(node, True):
                    continue
                if node.hash in templates and node.tag in BLOCKS and not (safe and node.tag in LABELS):
                    continue
            if node.tag in BLOCKS:
                parts.append(" ")
                todo.append(" ")
            todo += reversed(node.children)
        parts.append(" ")
    return _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")


def page_host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """(host, templates): hashes of subtrees on at least `share` of a host's different pages, and on `least` of them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            hosts, contents, hashes = batch.column("host").to_pylist(), [], []
            for text in texts.to_pylist():
                root = parse(text)
                hash_subtrees(root)
                contents.append(xxhash.xxh64_intdigest(main_text(root, frozenset())) - (1 << 63))
                hashes.append(candidates(root))
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(contents, pa.int64()), 
                                              pa.array([[{"hash": h, "around": a} for h, a in x] for x in hashes], pa.list_(pa.struct([("hash", pa.int64()), ("around", pa.int64())])))], ["host", "content", "hashes"])

    found = stored(pages.select(page_host().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(find, "host string, content long, hashes array<struct<hash:bigint,around:bigint>>"))
    different = found.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = found.select("host", "content", F.inline("hashes")).distinct()
    counted = seen.groupBy("host", "hash", F.col("around").isNull().alias("outside")).agg(
        F.count_distinct("content").alias("pages_with"), F.count_distinct(F.coalesce("around", "content")).alias("places"))  # copied articles are one place
    counted = counted.withColumn("n", F.least("pages_with", "places")).filter(F.col("n") >= least)
    return counted.join(different, "host").filter(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_set("hash").alias("templates"))


def extract_pages(pages: DataFrame, share: float = 0.3, least: int = 5) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    templates = stored(site_templates(pages, share, least)).withColumnRenamed("host", "h")
    plain = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", page_host())
    marked = plain.join(templates, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "templates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            out = []
            for text, known in zip(texts.to_pylist(), batch.column("templates").to_pylist()):
                root = parse(text)
                if known:
                    hash_subtrees(root)
                out.append(main_text(root, frozenset(known or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return marked.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op2_html_extraction(spark, folder):
    from stackweave.llm.common import read
    return extract_pages(read(spark, folder, "pages"))
