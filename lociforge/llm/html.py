"""Main text of web pages: site templates go by their recurrence, what is left of the furniture by its markup.

Every page is parsed into blocks of text. Element subtrees get a hash of their tags and text,
and those beside the text of the page also one of their structure alone: tags, classes,
depth, share of links. Spark counts on how many pages of a host each hash occurs, and
subtrees that recur on many of them are deleted from those pages. Menus and adverts whose
words vary from page to page recur by structure; on pages without an article this goes for lists of links only. Tags, roles, classes and the article element tell what
is left of menus, adverts, forms and the like, and decide alone on hosts of a few pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.llm.shared import staged

#: A subtree is of the template if it is on so many pages of its host, and on such a share.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Pages of a host that are many at any size of the host: no share is needed then.
MANY = 100
#: Recurring subtrees (host and hash) up to which their keys are sent to all tasks.
MAX_BROADCAST = 500_000
#: Tasks over which the pages with a subtree are spread where they are not.
SALTS = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas"} | _RAW
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "area", "param", "source", "track",
}
#: Elements that are never deleted as a template: the page and what holds the text.
_CORE = {"html", "body", "article", "main"}
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "tbody", "dd", "dt", "figcaption"}
#: Elements that end an open p, and those that end an open element of their own kind.
_ENDS_SELF = {"li", "dt", "dd", "tr", "td", "th", "option"}
#: Words of classes and ids that mark furniture.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disclaimer|footer|masthead|menu|modal|nav\w*|newsletter|notices?|"
    r"pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}


class _Element:
    __slots__ = ("tag", "name", "furniture", "core", "index", "parts", "kids", "size", "linked")

    def __init__(self, tag: str, name: str, furniture: bool, core: str, index: int):
        self.tag, self.name, self.furniture, self.core, self.index = tag, name, furniture, core, index
        self.parts, self.kids, self.size, self.linked = [tag], set(), 0, 0


def _furniture(tag: str, attributes: str) -> bool:
    if tag in _FURNITURE:
        return True
    if tag in _CORE and tag != "article":
        return False
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in _ROLES or name in ("class", "id") and _MARKED.search(value):
            return True
    return False


_NAME = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return (h - (1 << 64) if h >> 63 else h) or 1  # 0 stands for no hash


Node = tuple[int, int | None, int | None]


def parse(page: str | None) -> tuple[list[tuple[str, int, bool]], list[Node]]:
    """Blocks (text, least node around it or -1, whether markup tells that it is furniture), and the nodes of the page.

    A node is an element that may be furniture: the node around it or -1, the hashes of its text and of its structure,
    if these tell about it. By markup furniture is also what lies outside of the articles of a page, or else
    of its main elements. Time and memory grow with the page, however deep its elements are.
    """
    page = page or ""
    stack = [_Element("html", "", False, "", 0)]
    parents, sizes, texts, shapes = [-1], [0], [None], [None]  # by element
    linked: dict[int, bool] = {}  # elements whose text is links for the most part
    opened: dict[str, int] = {}
    blocks: list[tuple[str, int, str, bool]] = []  # text, element, core element around it, furniture
    buffer: list[str] = []
    at, size = 0, len(page)

    def text(s: str) -> None:
        if s:
            s = html.unescape(s)
            buffer.append(s)
            if s := s.strip():
                e = stack[-1]
                e.parts.append(s)
                e.size += len(s)

    def flush() -> None:
        if buffer:
            s = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if s:
                e = stack[-1]
                blocks.append((s, e.index, e.core, e.furniture))

    def close() -> None:
        e, up = stack.pop(), stack[-1]
        opened[e.tag] -= 1
        h = _signed("\0".join(e.parts))
        up.parts.append(f"\1{h}")
        up.size += e.size
        up.linked += e.size if e.tag == "a" else e.linked
        sizes[e.index] = e.size
        if e.tag in _INLINE:
            up.kids.add(e.tag)
            return
        if e.tag not in _CORE:
            if not (e.core and e.tag in _PARAGRAPHS):
                texts[e.index] = h
            links = 0 if not e.linked else 1 if 2 * e.linked < e.size else 2
            shape = _signed(f"\2{e.name}\0{len(stack)}\0{links}\0" + "\0".join(sorted(e.kids)))
            if e.tag not in _PARAGRAPHS:
                shapes[e.index], linked[e.index] = shape, links == 2
            up.kids.add(str(shape))

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if m[1]:
            if opened.get(tag):
                while True:
                    done = stack[-1].tag == tag
                    close()
                    if done:
                        break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            stack[-1].parts.append(f"{tag}{page[at : end.start() if end else size]}" if tag != "title" else tag)
            at = end.end() if end else size
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _CORE:
            continue
        if tag not in _INLINE and (opened.get("p") or tag in _ENDS_SELF and opened.get(tag)):  # a block ends an open paragraph, a list item the one before it
            for k in range(len(stack) - 1, 0, -1):
                kind = stack[k].tag
                if kind == "p" or kind == tag and tag in _ENDS_SELF:
                    while len(stack) > k:
                        close()
                    break
                if kind not in _INLINE:
                    break
        up = stack[-1]
        name = f"{tag} {' '.join(''.join(x) for x in _NAME.findall(m[3]))}" if m[3] and tag not in _INLINE else tag
        stack.append(_Element(tag, name, up.furniture or _furniture(tag, m[3]), tag if tag in ("article", "main") else up.core, len(parents)))
        parents.append(up.index)
        for x in (sizes, texts, shapes):
            x.append(None)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    while len(stack) > 1:
        close()
    sizes[0] = stack[0].size
    core = next((c for c in ("article", "main") if any(b[2] == c for b in blocks)), "")
    judged = _beside_text(parents, sizes, {b[1] for b in blocks if core and b[2] == core})
    # without an article text and furniture may look alike, so there only lists of links are told by their structure
    shapes = [h if h is not None and judged[i] and (core or linked[i]) else None for i, h in enumerate(shapes)]
    nodes, at = [], {-1: -1}
    for i, up in enumerate(parents):  # parents come before their children
        at[i] = at[up]
        if texts[i] is not None or shapes[i] is not None:
            at[i] = len(nodes)
            nodes.append((at[up], texts[i], shapes[i]))
    return [(s, at[i], furniture or kind != core) for s, i, kind, furniture in blocks], nodes


def all_around(blocks: list[tuple[str, int, bool]], nodes: list[Node]) -> set[int]:
    """Hashes of nodes that together hold all blocks but those that markup tells to be furniture (all blocks, if it tells so of each)."""
    own = [k for _, k, marked in blocks if not marked] or [k for _, k, _ in blocks]
    held = [0] * len(nodes)
    for k in own:
        if k >= 0:
            held[k] += 1
    of: dict[int, int] = {}
    for k in range(len(nodes) - 1, -1, -1):
        up, *hashes = nodes[k]
        if up >= 0:
            held[up] += held[k]
        for h in hashes:
            if h is not None:
                of[h] = of.get(h, 0) + held[k]
    return {h for h, n in of.items() if n >= len(own) > 0}


def without(texts: list[str], around: list[int], marked: list[bool] | None, nodes: list[tuple[int, bool]]) -> str:
    """The blocks outside of deleted nodes and not marked, joined. nodes: node around it, whether it is deleted."""
    gone: list[bool] = []
    for up, hit in nodes:
        gone.append(hit or up >= 0 and gone[up])
    return "\n".join(t for i, (t, k) in enumerate(zip(texts, around, strict=True)) if not (k >= 0 and gone[k]) and not (marked is not None and marked[i]))


def _beside_text(parents: list[int], sizes: list[int | None], core: set[int]) -> list[bool]:
    """Which elements neither hold nor lie in the text of the page: its core blocks, or else the smallest element with over half of all text."""
    n = len(parents)
    if not core:
        at, total = 0, sizes[0] or 0
        for i in range(1, n):  # parents come before their children
            if parents[i] == at and 2 * (sizes[i] or 0) > total:
                at = i
        core = {at}
        inside = [i == at for i in range(n)]
        for i in range(1, n):
            inside[i] = inside[i] or inside[parents[i]]
    else:
        inside = [False] * n
    holds = [False] * n
    for i in core:
        while i >= 0 and not holds[i]:
            holds[i] = True
            i = parents[i]
    return [not a and not b for a, b in zip(inside, holds, strict=True)]


_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
_PARSED = T.StructType([
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("around", _INTS), T.StructField("marked", T.ArrayType(T.BooleanType())),
    T.StructField("up", _INTS), T.StructField("words", _LONGS), T.StructField("shapes", _LONGS), T.StructField("subtrees", _LONGS),
])


@F.pandas_udf(_PARSED)
def parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Blocks and nodes of each page, and the distinct hashes of its nodes; a node has only hashes for which it may be deleted."""

    def one(page: str | None) -> tuple:
        blocks, nodes = parse(page)
        every = all_around(blocks, nodes)
        may = lambda c: [0 if n[c] is None or n[c] in every else n[c] for n in nodes]
        texts, around, marked = zip(*blocks, strict=True) if blocks else ((), (), ())
        return list(texts), list(around), list(marked), [n[0] for n in nodes], may(1), may(2), sorted({h for n in nodes for h in n[1:] if h is not None})

    for part in pages:
        rows = [one(x) for x in part]
        yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype="object") for k, c in enumerate(_PARSED.names)})


def _left(known: np.ndarray | None, markup: bool):
    """The main text of parsed pages; known has the keys of recurring subtrees, or else each page brings those of its own."""

    @F.pandas_udf(T.StringType())
    def left(pages: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in pages:
            out = []
            for r in part.itertuples(index=False):
                if known is None:
                    hit = set() if r.hits is None else set(r.hits.tolist())
                elif len(known) and r.keys is not None and len(r.keys):
                    k = np.searchsorted(known, r.keys)
                    hit = set(np.asarray(r.subtrees)[known[np.minimum(k, len(known) - 1)] == r.keys].tolist())
                else:
                    hit = set()
                nodes = [(u, w in hit or x in hit) for u, w, x in zip(r.up.tolist(), r.words.tolist(), r.shapes.tolist(), strict=True)]
                out.append(without(r.texts, r.around, r.marked if markup else None, nodes))
            yield pd.Series(out, dtype="object")

    return left


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree): hashes of the subtrees that recur on a host's pages, from pages (host, body, subtrees).

    Pages of one body count once. A subtree recurs on min_pages and on min_share of the
    host's pages or MANY of them.
    """
    pages = pages.filter("host is not null").dropDuplicates(["host", "body"])
    seen = pages.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    often = seen.filter(F.col("n") >= min_pages).join(total, "host")
    return often.filter(F.col("n") >= F.least(min_share * F.col("pages"), F.lit(float(MANY)))).select("host", "subtree")


def main_text(
    pages: DataFrame, url: str = "url", page: str = "html", into: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
    max_broadcast: int = MAX_BROADCAST, markup: bool = True,
) -> DataFrame:
    """The columns of pages but for the page itself, and ``into``: blocks of the main text in page order, joined by \\n.

    Pages are parsed once; their blocks are stored. What recurs is told to the tasks as sorted keys if there are few (max_broadcast),
    else joined by host and subtree. Pages may be as deep as they are long. markup=False leaves everything to the templates.
    Null and empty pages have an empty text; pages whose URL has no host keep what markup
    doesn't tell to be furniture; repeated rows are pages of their own; an empty table gives
    an empty result; a column of pages named as ``into`` is replaced; other columns may have any name.
    """
    other = [c for c in pages.columns if c not in (page, into)]
    row = F.struct(*[F.col(f"`{c}`") for c in other] or [F.lit(True).alias("none")])
    rows = pages.select(row.alias("row"), host_of(F.col(url)).alias("host"), parsed(F.col(page)).alias("p"), F.monotonically_increasing_id().alias("page"))
    rows = staged(rows, "blocks")
    found = staged(templates(rows.select("host", F.xxhash64("p.texts").alias("body"), "p.subtrees"), min_pages, min_share), "templates")
    parts = [F.col(f"p.{c}").alias(c) for c in _PARSED.names]
    no_keys, no_hits = F.lit(None).cast("array<bigint>").alias("keys"), F.lit(None).cast("array<bigint>").alias("hits")
    if found.limit(max_broadcast + 1).count() <= max_broadcast:
        known = np.sort(found.select(F.xxhash64("host", "subtree").alias("key")).toArrow()["key"].to_numpy())  # max_broadcast numbers at most
        keys = F.when(F.col("host").isNotNull(), F.transform("p.subtrees", lambda x: F.xxhash64(F.col("host"), x))).alias("keys")
        rows = rows.select("row", _left(known, markup)(F.struct(*parts, keys, no_hits)).alias("text"))
    else:  # each page gets the recurring ones of its own; a subtree of a large host is on many pages, so it goes to several tasks
        own = rows.select("page", "host", F.explode("p.subtrees").alias("subtree")).withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
        spread = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
        hits = own.join(found.withColumn("salt", spread), ["host", "subtree", "salt"]).groupBy("page").agg(F.collect_list("subtree").alias("hits"))
        rows = rows.join(hits, "page", "left").select("row", _left(None, markup)(F.struct(*parts, no_keys, "hits")).alias("text"))
    return rows.select(*[F.col("row")[c].alias(c) for c in other], F.col("text").alias(into))
