"""HTML extraction: page structure, and nearest-URL page differencing.

A page is cut into blocks of text.  Elements that are no main text by their
name, role or class (menus, footers, adverts, forms, scripts, comments ...) are
left out.  Where the page marks its article (``article``, ``main``), the blocks
within make the text.  Where it marks none, what is left is differenced: pages
are sorted by host and URL path, each is paired with the neighbour of another
path that has the longer common path prefix, the lines of both are aligned by
longest common subsequence, and the shared ones are deleted.

Differencing is confined to lines outside a marked article, because copies of
one article under neighbouring URLs would delete each other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import join_bounded, map_batches
from factloom.llm.durable import durable

#: Pages with deleted lines up to which those are broadcast; beyond, joined by shuffle.
DELETED_BOUND = 100_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*+)>""", re.S
)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "math", "select", "object", "canvas")}
_OUT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "audio", "video"}
_MAIN = {"article", "main"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "caption", "ul",
}
#: Elements that are tracked as open; others may go unclosed without harm.
_HELD = (_BLOCK - {"p", "li", "dt", "dd", "option", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "tr", "tbody", "thead", "tfoot"}) | _OUT
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "side", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "comment", "comments", "disqus", "respond", "reply", "replies", "discussion", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup",
    "login", "search", "footer", "header", "masthead", "topbar", "toolbar", "pagination", "pager", "widget", "copyright", "legal", "disclaimer", "skip", "contentinfo",
    "complementary", "form",
}
_SPLIT = re.compile(r"[^a-z0-9]+")
_KEPT_HEADER = {"header", "masthead"}


def _words(attrs: str) -> set[str]:
    out: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            out.add("popup")
        elif name != "style":
            out |= {w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}
    return out


def blocks(page: str | None) -> tuple[list[str], list[str], bool]:
    """(blocks within the marked article, blocks outside it, whether one is marked)."""
    main: list[str] = []
    rest: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (name, out, main) of open held elements
    out = inside = marked = False
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text and not out:
                (main if inside else rest).append(text)
            buffer.clear()

    page, at = page or "", 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:-3]))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            if not m[3].endswith("/"):
                end = _RAW[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            buffer.append(" ")
        if name in _VOID or name not in _HELD and (closing or not m[3]):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    break
            out, inside = any(s[1] for s in stack), any(s[2] for s in stack)
        elif name in _HELD and not m[3].endswith("/"):
            flush()
            words = _words(m[3]) if m[3] else set()
            noise = words & _NOISE
            if inside or name in ("body", "html"):
                noise -= _KEPT_HEADER
            bad = name in _OUT or name == "header" and not inside or bool(noise)
            is_main = not bad and (name in _MAIN or "main" in words and "role" in m[3].lower())
            if is_main and not out:
                marked = True
            stack.append((name, bad, is_main))
            out, inside = out or bad, inside or is_main
        elif name in ("p", "li", "dd", "dt") and _words(m[3]) & (_NOISE - {"notice", "alert", "side", "legal", "form", "header"}):
            end = re.compile(rf"</?{name}\b[^>]*>", re.I).search(page, at)  # such a block ends at the next of its kind
            at = end.start() if end else len(page)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return main, rest, marked and bool(main)


def location(url: str | None) -> tuple[str, str]:
    """(host, path) without scheme, port, query, fragment, letter case of the host, final slash or extension."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return "", url or ""
    return host, re.sub(r"(?:\.html?|/)+$", "", parts.path)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tops: list[int] = []  # the least end in b of a common subsequence of each length
    nodes: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tops, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                nodes.append(node)
            else:
                tops[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def page_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, h, host, path, marked, lines): hashed lines outside a marked article."""

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("host", "path", "marked", "lines")}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            _, rest, marked = blocks(page)
            host, path = location(url)
            for k, v in (("host", host), ("path", path), ("marked", marked), ("lines", [_hash(t) for t in rest])):
                out[k].append(v)
        return {"page_id": batch.column("page_id"), "h": batch.column("h"), **out}

    columns = {
        "page_id": F.col(id_col).cast("long"), "h": F.xxhash64(F.col(url_col).cast("string"), F.col(html_col).cast("string")),
        "url": F.col(url_col).cast("string"), "html": F.col(html_col).cast("string"),
    }
    return map_batches(pages, columns, fn, "page_id bigint, h bigint, host string, path string, marked boolean, lines array<bigint>")


def nearest(paths: DataFrame) -> DataFrame:
    """(host, path, other): the lines of the page nearest by URL path within the host.

    ``paths`` (host, path, lines) has one row per path.  They are range-sorted,
    so that a host of any size is spread; the rows on either side of each
    partition's bounds, as many as partitions, are handed over by the driver.
    """
    done = durable(paths.repartitionByRange("host", "path").sortWithinPartitions("host", "path"))
    ends = done.select(F.spark_partition_id().alias("pid"), F.struct("host", "path", "lines").alias("r")).groupBy("pid")
    edge = sorted((r.pid, tuple(r.a), tuple(r.b)) for r in ends.agg(F.min("r").alias("a"), F.max("r").alias("b")).collect())
    around = {e[0]: [None, None] for e in edge}
    for left, right in pairwise(edge):
        around[left[0]][1], around[right[0]][0] = right[1], left[2]
    shared = paths.sparkSession.sparkContext.broadcast(around)

    def run(batches):
        before, after = shared.value.get(TaskContext.get().partitionId(), (None, None))
        held = None  # (previous row, this row), until the next row is known

        def pair(last, row, nxt):
            best = None
            for other in (last, nxt):
                if other and other[0] == row[0] and (best is None or _common(row[1], other[1]) > _common(row[1], best[1])):
                    best = other
            return (row[0], row[1], best[2] if best else [])

        for batch in batches:
            made = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("host", "path", "lines")]):
                if held:
                    made.append(pair(*held, row))
                held = (held[1] if held else before, row)
            if made:
                yield _batch(made)
        if held:
            yield _batch([pair(*held, after)])

    def _batch(rows):
        host, path, other = map(list, zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(other, pa.list_(pa.int64()))], names=["host", "path", "other"])

    return done.mapInArrow(run, "host string, path string, other array<bigint>")


def deleted_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, h, gone): positions of shared lines of each page without a marked article."""
    lines = page_lines(pages, id_col, url_col, html_col)
    one = lines.groupBy("host", "path").agg(F.min_by("lines", "h").alias("lines"))
    unmarked = lines.where(~F.col("marked") & (F.size("lines") > 0)).select("page_id", "h", "host", "path", "lines").distinct()
    paired = unmarked.join(nearest(one), ["host", "path"])

    def fn(batch: pa.RecordBatch) -> dict:
        both = zip(batch.column("lines").to_pylist(), batch.column("other").to_pylist())
        return {"page_id": batch.column("page_id"), "h": batch.column("h"), "gone": [shared_lines(a, b) for a, b in both]}

    found = map_batches(paired, {c: F.col(c) for c in ("page_id", "h", "lines", "other")}, fn, "page_id bigint, h bigint, gone array<bigint>")
    return found.where(F.size("gone") > 0)


def main_text(page: str | None, gone: list[int] | None = None) -> str:
    """The text of one page, given the positions of its deleted lines."""
    main, rest, marked = blocks(page)
    drop = set(gone or ())
    return "\n\n".join(main if marked else [t for i, t in enumerate(rest) if i not in drop])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have empty text; a null URL has an empty host and
    path; repeated rows are extracted alike and do not delete each other's
    lines, nor do pages whose URLs differ only in scheme, query or fragment;
    an only page of its host loses no line.  Other columns are not read.
    """
    gone = durable(deleted_lines(pages, id_col, url_col, html_col)).select(F.col("page_id").alias("__id"), F.col("h").alias("__h"), "gone")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumns({"__h": F.xxhash64("url", "html"), "__id": F.coalesce("page_id", F.lit(-1))})
    gone = gone.withColumn("__id", F.coalesce("__id", F.lit(-1)))
    joined = join_bounded(rows, gone, ["__id", "__h"], "left", DELETED_BOUND)

    def fn(batch: pa.RecordBatch) -> dict:
        text = [main_text(h, g) for h, g in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist())]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": [len(t) for t in text]}

    return map_batches(joined, {c: F.col(c) for c in ("page_id", "url", "html", "gone")}, fn, "page_id bigint, url string, text string, n_chars bigint")

