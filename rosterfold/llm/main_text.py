"""Main text of web pages, with the site's template removed.

A page is parsed into elements. The text is taken from ``article`` elements if the page has any, else from ``main``, else
from the whole body. Every block-level element in it is hashed with all its markup, and so is text that stands beside other
blocks without an element of its own. Spark counts on how many pages of each host a hash occurs. Containers on at least
``LEAST_PAGES`` pages and ``SHARE`` of the host's pages are cut out, unless they hold more than half of a page's text (then
the page is a copy, not a frame). Paragraphs, headings, items, whole articles and bare text inside an article or ``main``
are cut only from ``PROSE_SHARE`` of the pages on, so that articles that quote the same passage keep it, and never when
nothing would be left of the page.

As a supplement, navigation, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
go by their tag, role or name, whatever their count; what these or the choice of article take out is not counted. A name is
a whole token of the class or the whole id, never a piece of a compound one. Names take out no body, ``main`` or outer
``article``, and nothing that holds one, unless the page has another that no name is around. Inside an article, ids of headings and
prose say nothing, and other ids only when they tell reader comments.

A block is the text between two block-level tags; its references are decoded, white space becomes one space, and blocks
are joined by an empty line.

Defined cases: null and empty html give empty text; tags, comments and references cut off at the end of a page are
handled as a browser would, an unfinished tag is left out; a null or odd url counts as one host of its own; repeated pages
are pages of their own; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterfold.llm.shared import pinned, table
from rosterfold.llm.words import pieces

LEAST_PAGES, SHARE, PROSE_SHARE = 5, 0.1, 0.5

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADING | frozenset("p li dd dt td th tr tbody thead blockquote pre figcaption".split())
_DROPPED = frozenset("nav aside footer form head script style noscript template iframe svg math object canvas button select textarea input dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_READERS = frozenset("comment comments commentlist comment-list comments-area comment-respond disqus disqus_thread replies reply respond".split())
_NAMES = _READERS | frozenset("ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget cookie-banner cookie-notice newsletter-signup related-articles related-posts share-box share-buttons site-footer social-share".split())
# An opening tag ends an open element of the same group, up to the nearest container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table body html article section div td th main".split())


class _Node:
    __slots__ = ("tag", "dropped", "named", "region", "hash", "start")

    def __init__(self, tag: str, dropped: bool, named: int, region: int, start: int):
        self.tag, self.dropped, self.named, self.region, self.start, self.hash = tag, dropped, named, region, start, None


def _unwanted(tag: str, attributes: str, region: int) -> tuple[bool, int]:
    """Whether tag, role or style tell that an element goes; and its name: 1 a name of ``_NAMES``, 2 one of reader comments."""
    if tag in _DROPPED or tag == "header" and region < 2:
        return True, 0
    if not attributes or tag in ("html", "body"):
        return False, 0
    named = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            if tag == "main" or tag == "article" and region < 2:
                continue
            names = value.split() if name == "class" else [value.strip()]
            if name == "id" and region == 2:
                names = [] if tag in _PROSE else _READERS.intersection(names)
            if not _READERS.isdisjoint(names):
                named = 2
            elif not _NAMES.isdisjoint(names) or region < 2 and "header" in names:
                named = max(named, 1)
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, 0
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0
    return False, named


def _hashed(markup: str, prose: bool) -> int:
    """A hash whose lowest bit tells prose, which takes a higher share of pages to be cut."""
    return int.from_bytes(blake2b(markup.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) & -2 | prose


def blocks(html: str) -> list[tuple[str, list[int]]]:
    """The blocks of the main text in page order, each with the hashes of the elements around it."""
    found: list[tuple[int, list[str], list[_Node]]] = []  # region, pieces of text, containers around it
    marks: list[int] = []  # for each of them the name around its article or main
    names: list[tuple[int, int]] = []  # region and name of the open elements that have one
    stack: list[_Node] = []
    text: list[str] = []
    # Regions: 0 the body, 1 main, 2 an article.
    dropped, region = 0, 0

    def flush() -> None:
        if text:
            found.append((region, text.copy(), [n for n in stack if n.tag in _BLOCK]))
            marks.append(max((k for _, k in names), default=0))
            text.clear()

    def hidden() -> bool:
        """A name hides what is in its element, up to an article or main in it."""
        return dropped > 0 or bool(names) and names[-1][0] == region

    def close(k: int, end: int) -> None:
        nonlocal dropped, region
        while len(stack) > k:
            node = stack.pop()
            dropped -= node.dropped
            if node.named:
                names.pop()
            region = stack[-1].region if stack else 0
            node.hash = (node.start, end)

    at = 0
    n = len(html)
    while at < n:
        match = _TOKEN.search(html, at)
        stop = match.start() if match else n
        if stop > at and not hidden():
            text.append(html[at:stop])
        if not match:
            break
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            continue
        tag = tag.lower()
        attributes = match[3] or match[6] or ""
        block = tag in _BLOCK
        if match[1] or match[4]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), -1)
            if k >= 0:
                if block:
                    flush()
                close(k, at)
            elif block:
                flush()
            continue
        if block:
            flush()
            if stack and tag not in ("html", "body"):
                group = _ENDS.get(tag)
                for k in range(len(stack) - 1, -1, -1):
                    open_ = stack[k].tag
                    if open_ == "p" or group and open_ in group:
                        close(k, match.start())
                        if open_ != "p":
                            break
                    elif open_ in _HOLDS:
                        break
        elif tag == "br":
            if not hidden():
                text.append(" ")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        gone, named = _unwanted(tag, attributes, region)
        inner = 2 if tag == "article" else max(region, 1) if tag == "main" else region
        if named:
            names.append((inner, named))
        stack.append(_Node(tag, gone, named, inner, match.start()))
        dropped += gone
        region = inner
    flush()
    close(0, n)

    if any(marks):
        # Articles with no name around them come first, then all but reader comments.
        shown = [(run, mark) for run, mark in zip(found, marks) if "".join(run[1]).strip()]
        if any(run[0] and not mark for run, mark in shown):
            found = [run for run, mark in shown if not mark]
        elif any(mark < 2 for _, mark in shown):
            found = [run for run, mark in shown if mark < 2]
    top = max((r for r, *_ in found), default=0)
    found = [run for run in found if run[0] == top]
    runs = Counter(node.hash for _, _, around in found for node in around)
    out, hashes = [], {}
    for _, parts, around in found:
        clean = " ".join(unescape("".join(parts)).split())
        if clean:
            up = []
            for node in around:
                if node.tag in ("html", "body") or node.region < top:
                    continue
                if node.hash not in hashes:
                    a, b = node.hash
                    hashes[node.hash] = _hashed(html[a:b], node.tag in ("article", "main") or top > 0 and node.tag in _PROSE)
                up.append(hashes[node.hash])
            if not up or runs[around[-1].hash] > 1:
                up.append(_hashed("text " + clean, True))
            out.append((clean, up))
    return out


def _joined(parsed: list[tuple[str, list[int]]], doomed: set[int]) -> str:
    """The blocks outside the containers in ``doomed`` that hold at most half of the text, and outside its prose if any are left."""
    frames = {h for h in doomed if not h & 1}
    if frames:
        total = sum(len(text) for text, _ in parsed)
        held: dict[int, int] = {}
        for text, up in parsed:
            for h in set(up):
                held[h] = held.get(h, 0) + len(text)
        frames = {h for h in frames if 2 * held.get(h, 0) <= total}
    kept = [b for b in parsed if frames.isdisjoint(b[1])]
    prose = {h for h in doomed if h & 1}
    own = [b for b in kept if prose.isdisjoint(b[1])]
    return "\n\n".join(text for text, _ in own or kept)


def parse(pages: DataFrame) -> DataFrame:
    """page (a hash of url and html), host, and the distinct hashes of each page's elements."""
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            trees = [list({h for _, up in blocks(html or "") for h in up}) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(trees, pa.list_(pa.int64()))], names=["page", "host", "trees"])

    return pages.select(_page(), host.alias("host"), "html").mapInArrow(run, "page bigint, host string, trees array<bigint>")


def _page() -> Column:
    return F.xxhash64("url", "html").alias("page")


def recurring(parsed: DataFrame) -> DataFrame:
    """page and doomed: which hashes of each page are to be cut; pages without any have no row."""
    held = parsed.select("page", "host", F.explode("trees").alias("tree"))
    held = held.select("page", "host", F.col("tree").bitwiseAND(F.lit(-2)).alias("tree"), F.col("tree").bitwiseAND(F.lit(1)).alias("prose"))
    sizes = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    counts = held.groupBy("host", "tree").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    shares = counts.join(sizes, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    often = pinned(shares.select("host", "tree", (F.col("n") >= PROSE_SHARE * F.col("pages")).alias("often")), "templates")
    doomed = held.join(often, ["host", "tree"]).filter("often or prose = 0")
    return pinned(doomed.groupBy("page").agg(F.collect_set(F.col("tree") + F.col("prose")).alias("doomed")), "doomed")  # a page's own elements


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are parsed once to count and once more to cut, so that no blocks are written or shuffled.
    """
    doomed = recurring(pinned(parse(pages), "pages"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [_joined(blocks(html or ""), set(d or ())) for html, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", _page()).join(doomed, "page", "left").select("page_id", "url", "html", "doomed")
    return rows.mapInArrow(cut, f"page_id {id_type}, url string, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
