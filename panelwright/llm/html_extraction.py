"""Main text of web pages by a site style tree: the DOMs of a host are merged and low-importance branches are removed.

A node of the tree is a host and a path of tags with their classes. Over the host's pages its presentation (the children's tags)
and its content (its texts) have distributions; the entropy of each, in units of its maximum, is the node's importance, so what
a site repeats on its pages has little and what differs from page to page has much. Copies of one page count once.

What a tag or class names outright (menus, footers, scripts, adverts, comments and the like) is no main text whatever its
entropy. Where a page marks its article, all of it stays but such branches and unnamed boxes that the site repeats; where it
marks none, the importance of the branches decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm.shared import Workspace
from panelwright.llm.url_filters import host_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
# Element names and class words.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option svg math canvas audio video object dialog menu label".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BOXES = frozenset("div section span ul ol table aside td dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul body html".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dfp disclaimer disqus footer "
    "menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion related replies reply respond sharing sidebar signup "
    "sitemap skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
HEADERS = frozenset("header masthead topbar".split())
MODIFIERS = frozenset("has no not non with without free".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
ARTICLE_WORDS = frozenset("articlebody".split())


class Block(NamedTuple):
    path: str
    boxed: bool  # its own element is a box, not a paragraph
    inside: bool  # inside the page's article
    text: str


class _Open(NamedTuple):
    tag: str
    path: str
    dropped: bool
    article: bool
    soft: bool = False  # dropped, but only as a form or for a word of a class, so that an article below can come back


def _names(attributes: str) -> tuple[frozenset[str], str, bool, bool]:
    """Words of class, id and role; the path's part; whether it is hidden; whether it marks the article."""
    words, shown, hidden, article = set(), [], False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "itemprop":
            article |= value == "articlebody"
        else:
            for token in value.split():
                said = _NAME.findall(token)
                if not MODIFIERS.intersection(said):  # has-sidebar and ad-free name what is elsewhere
                    words.update(said)
            article |= name == "role" and value in ("main", "article")
            if name == "class":
                shown += sorted(value.split())
    return frozenset(words), "".join(f".{x}" for x in shown), hidden, article


def parse_page(html: str | None) -> tuple[list[Block], list[tuple[str, str]], bool]:
    """Blocks of text in page order (those that no tag or class rules out), ``(path, child's tag)`` pairs, and whether an article is marked.

    If all articles of a page lie in branches that were ruled out only as a form or for a class word other than that of comments, they
    count: the whole page can be a form, or a layout that is named for one of its parts.
    """
    blocks, children, marked, lost = _parse(html or "", False)
    return _parse(html or "", True)[:3] if lost and not marked else (blocks, children, marked)


def _parse(html: str, comes_back: bool) -> tuple[list[Block], list[tuple[str, str]], bool, bool]:
    """As :func:`parse_page`, and whether an article was left out that ``comes_back`` would keep."""
    lost = False
    stack: list[_Open] = [_Open("", "", False, False)]
    blocks: list[Block] = []
    children: list[tuple[str, str]] = []
    text: list[str] = []
    owner = stack[0]
    marked = False

    def flush() -> None:
        nonlocal owner
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said and not owner.dropped:
                blocks.append(Block(owner.path, owner.tag in BOXES, owner.article, said))
            text.clear()
        owner = stack[-1]

    def block_of() -> _Open:
        return next((x for x in reversed(stack) if x.tag not in INLINE), stack[0])

    def close_to(depth: int) -> None:
        if any(x.tag not in INLINE for x in stack[depth:]):
            flush()
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        said = html[at : m.start() if m else n]
        if said:
            if not stack[-1].dropped:
                if not text:
                    owner = block_of()
                text.append(said)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                close_to(depth)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in PARAGRAPH_ENDS:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", *HEADINGS) or stack[i].tag not in INLINE), 0)
            if depth and stack[depth].tag == "p":
                close_to(depth)
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            ends = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ("ul", "ol", "table", "dl", "select"):
                    break
                if stack[i].tag in ends and not any(x.tag in ("ul", "ol", "table", "dl", "select") for x in stack[i + 1 :]):
                    close_to(i)
                    if tag != "tr":
                        break
        if tag == "body":
            close_to(1)
        words, shown, hidden, article = _names(m[3]) if m[3] else (frozenset(), "", False, False)
        up = stack[-1]
        article = article or tag in ("article", "main")
        words_drop = bool(words & BOILERPLATE) and tag not in ("body", "html") and not (article or tag in HEADINGS)
        header = (tag == "header" or bool(words & HEADERS)) and not up.article and tag not in ("body", "html", *HEADINGS) and not article
        dropped = up.dropped or tag in DROPPED or hidden or words_drop or header
        if article and up.soft and not hidden and tag not in DROPPED and not words & COMMENTS:
            lost, dropped = True, not comes_back
        soft = dropped and (up.soft or not up.dropped) and not hidden and not words & COMMENTS and (tag == "form" or tag not in DROPPED)
        inside = not dropped and (up.article or article)
        marked |= inside
        path = up.path if tag in INLINE else f"{up.path}>{tag}{shown}"
        if tag not in INLINE:
            flush()
            if not dropped:
                children.append((up.path, tag + shown))
        stack.append(_Open(tag, path, dropped, inside, soft))
        if tag not in INLINE:
            owner = stack[-1]
        if m[3].endswith("/"):
            stack.pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            stack.pop()
    flush()
    return blocks, children, marked, lost


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "replace")) - (1 << 63)


def node_rows(pages: DataFrame) -> DataFrame:
    """``node, kind, value, page``: hashes of each page's tree nodes with what they show (0: children, 1: text), once per page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int, int, int]] = set()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, children, _ = parse_page(html.as_py())
                page = _hash(*[b.text for b in blocks])
                shape: dict[str, list[str]] = {}
                for path, child in children:
                    if not shape.get(path) or shape[path][-1] != child:
                        shape.setdefault(path, []).append(child)
                out.update((_hash(host, p), 0, _hash(*c), page) for p, c in shape.items())
                out.update((_hash(host, b.path), 1, _hash(b.text), page) for b in blocks)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sorted(out), strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["node", "kind", "value", "page"])

    return pages.select("host", "html").mapInArrow(rows, "node bigint, kind int, value bigint, page bigint")


def node_importance(rows: DataFrame, *, gamma: float = 0.9, least_pages: int = 6) -> DataFrame:
    """``node, importance`` of nodes that at least so many pages have.

    With ``m`` uses of a node and shares ``p`` of what it shows, importance is ``-sum(p log p) / log m``; content counts
    ``gamma``, presentation the rest, where a node has both.
    """
    uses = rows.distinct().groupBy("node", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c")
    by_kind = uses.groupBy("node", "kind").agg(F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("s"))
    by_kind = by_kind.where(F.col("m") >= least_pages).select("node", "kind", (1 - F.col("s") / (F.col("m") * F.log("m"))).alias("h"))
    h = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("h")))
    both = by_kind.groupBy("node").agg(h(0).alias("presentation"), h(1).alias("content"))
    return both.where("content is not null").select("node", F.coalesce(gamma * F.col("content") + (1 - gamma) * F.col("presentation"), F.col("content")).alias("importance"))


def extract_text(spark: SparkSession, pages: DataFrame, *, threshold: float = 0.4, repeated: float = 0.2, broadcast_nodes: int = 500_000, workspace: Workspace | None = None) -> DataFrame:
    """``page_id, url, text, blocks`` of every row of ``pages(page_id, url, html)``: blocks joined by newlines, spaces single.

    Branches of less importance than ``threshold`` are removed from pages that mark no article, boxes of less than ``repeated``
    from articles; a branch that too few of the host's pages have is kept. Removed nodes are broadcast while there are at most
    ``broadcast_nodes`` of them (8 bytes each); beyond that they come to their pages by joins.

    A null or empty html gives an empty text, a null URL is a host of its own, malformed markup is read as far as it goes.
    Repeated rows are extracted each; an empty table gives no row; other columns are not read.
    """
    ws = workspace or Workspace(spark, "html-extraction")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    weak = ws.save(node_importance(node_rows(rows)).where(F.col("importance") < threshold), "weak")
    few = weak.limit(broadcast_nodes + 1).count() <= broadcast_nodes
    if few:
        nodes = spark.sparkContext.broadcast({r.node: r.importance for r in weak.collect()})
        source = rows.select("page_id", "url", "host", "html", F.lit(None).cast("map<bigint,double>").alias("nodes"))
    else:
        nodes = None

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = {(p, _hash(host, b.path)) for p, host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for b in parse_page(html)[0]}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["page_id", "node"])

        found = rows.select("page_id", "host", "html").mapInArrow(paths, "page_id bigint, node bigint").join(weak, "node")
        found = found.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("node", "importance"))).alias("nodes")).withColumnRenamed("page_id", "_page")
        source = rows.join(found, rows["page_id"].eqNullSafe(found["_page"]), "left").select("page_id", "url", "host", "html", "nodes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for host, html, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                blocks, _, marked = parse_page(html.as_py())
                low = nodes.value if nodes is not None else dict(own or ())
                kept = []
                for b in blocks:
                    if marked and not b.inside:
                        continue
                    if not (marked and not b.boxed) and low.get(_hash(host, b.path), 1.0) < (repeated if marked else threshold):
                        continue
                    kept.append(b.text)
                texts.append("\n".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["page_id", "url", "text", "blocks"])

    kinds = dict(rows.dtypes)
    return source.mapInArrow(extract, f"page_id {kinds['page_id']}, url string, text string, blocks int")
