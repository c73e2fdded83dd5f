"""HTML extraction (operator 10): consensus paths of hosts.

1. Each page's containers are scored by the text of their blocks, less link text and what boilerplate elements hold.
   The page votes for the path of its best container: the tags from the root down with their classes, digits removed.
2. Spark counts the votes of each host; the path with most votes (then the longest text, then the smallest path) wins.
3. Each page is read again with its host's path. Where the path is absent, or holds less text than the page's own best
   container, that container is used.

The text of a container is its blocks in page order, without menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments; character references are decoded, white space in a block becomes one
space, and blocks are joined by two line feeds.

Cases: null or empty html gives empty text; a null url has no host, so such pages do not vote together; an unclosed
comment, script, style or CDATA section runs to the end of the page, as browsers have it; of pages with one page_id each
is read by itself. A page of any length and depth of nesting is one row of work, in time proportional to its length.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import parts, table, tidy, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td center".split())
NEST = (BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd hr tr".split())) | frozenset("td th svg button select audio video object canvas map label".split())
DROPPED = frozenset("head nav footer aside form button select svg audio video object canvas map menu dialog".split())
#: A word of a class, id or role that marks what is not the article.
UNWANTED = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb"
    " breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended comment comments commentlist respond reply replies disqus widget widgets pagination pager search toolbar complementary contentinfo skip masthead".split()
)
#: Words of the above that also name parts of articles: within one their element goes only if it is mostly links.
AMBIGUOUS = frozenset("search share sharing social related recommended widget widgets alert banner respond reply replies promo promotion skip toolbar overlay complementary contentinfo".split())
#: A word that marks a page's header; inside an article it belongs to the article.
HEADING = frozenset(["header", "topbar"])
SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Node:
    """An element that can hold others. ``mark`` is the hash of its path; the path itself is made where it is asked for."""

    __slots__ = ("tag", "name", "mark", "parent", "dropped", "suspect", "in_article", "total", "inside")

    def __init__(self, tag: str, name: str, parent: Node | None, dropped: bool, suspect: Node | None, in_article: bool):
        self.tag, self.name, self.parent, self.dropped, self.suspect, self.in_article = tag, name, parent, dropped, suspect, in_article
        self.mark = _mark(parent.mark, name) if parent else 0
        self.total, self.inside = 0, False

    @property
    def path(self) -> str:
        names, node = [], self
        while node.parent is not None:
            names.append(node.name)
            node = node.parent
        return "".join(f">{n}" for n in reversed(names))


def _mark(above: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name, above)


def _path_mark(path: str) -> int:
    out = 0
    for name in path.split(">")[1:]:
        out = _mark(out, name)
    return out


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def _unwanted(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is not the article's, and whether that is to be judged by its links."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    if not attributes:
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    if tag in ("html", "body", "article", "main"):
        names = attributes.get("class", "") if tag == "article" else ""
    else:
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
    found = UNWANTED.intersection(w.lower() for w in SPLIT_NAME.split(names) if w)
    if not found and not in_article:
        found = HEADING.intersection(w.lower() for w in SPLIT_NAME.split(names) if w)
    unsure = bool(found) and in_article and found <= AMBIGUOUS
    return bool(found) and not unsure, unsure


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """The page's blocks (innermost element, text, characters in links) that are not dropped, and all elements in page order."""
    root = Node("", "", None, False, None, False)
    stack, nodes, out, held = [root], [root], [], []
    opened: dict[str, int] = {}
    links = link_chars = at = 0
    length = len(page)

    def end_block() -> None:
        nonlocal link_chars
        if held:
            text = SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            if text:
                out.append((stack[-1], text, link_chars))
            held.clear()
        link_chars = 0

    def leave(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def take(text: str) -> None:
        nonlocal link_chars
        if text and not stack[-1].dropped:
            held.append(text)
            if links:
                link_chars += len(text)

    while at < length:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                take(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            found = re.compile(rf"</{tag}\s*[^>]*>", re.IGNORECASE).search(page, at)
            at = found.end() if found else length
            continue
        if tag == "br" or tag in ("td", "th"):
            take(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCK:
            end_block()
            # A paragraph marked as unwanted ends where the next block begins.
            while stack[-1].tag in ("p", "li", "dt", "dd", "tr", "h1", "h2", "h3", "h4", "h5", "h6") and (not closing or stack[-1].tag == tag or tag in NEST):
                if stack[-1].tag == "li" and not closing and tag != "li":
                    break
                ended = stack[-1].tag
                leave(len(stack) - 1)
                if closing and ended == tag:
                    break
        if closing:
            if tag in NEST or any(n.tag == tag and n.dropped for n in stack[-4:]):
                if opened.get(tag):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                    end_block()
                    leave(k)
            continue
        if tag in VOID or raw.endswith("/"):
            continue
        top = stack[-1]
        attributes = _attributes(raw)
        unwanted, unsure = _unwanted(tag, attributes, top.in_article)
        dropped = top.dropped or unwanted
        if tag in NEST or (dropped and not top.dropped):
            if not dropped or tag in BLOCK:
                end_block()
            name = ".".join([tag, *sorted({c for c in re.sub(r"[\d>]+", "", attributes.get("class", "")).split() if c})])
            node = Node(tag, name, top, dropped, None, top.in_article or tag in ("article", "main"))
            node.suspect = top.suspect or (node if unsure else None)
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            nodes.append(node)
    end_block()
    if any(n.suspect for n, _, _ in out):
        excess: dict[int, int] = {}
        for node, text, in_links in out:
            if node.suspect:
                excess[id(node.suspect)] = excess.get(id(node.suspect), 0) + 2 * in_links - len(text)
        out = [b for b in out if not b[0].suspect or excess[id(b[0].suspect)] < 0]
    return out, nodes


def best(found: list[tuple[Node, str, int]], nodes: list[Node]) -> Node:
    """The container to take: an article or main part with much of the text, else the deepest that leaves only links outside."""
    for node, text, in_links in found:
        node.total += max(0, len(text) - 2 * in_links)
    # Children come after their parents: from the last to the first every total is complete when it is passed on.
    for node in reversed(nodes[1:]):
        node.parent.total += node.total
    root = nodes[0]
    containers = [n for n in nodes[1:] if n.tag in CONTAINER and not n.dropped]
    marked = [n for n in containers if n.in_article and n.tag in ("article", "main") and n.total >= 0.3 * root.total]
    if marked and root.total:
        top = max(n.total for n in marked)
        return next(n for n in reversed(marked) if n.total >= 0.95 * top)
    # The deepest container with all of the text: the last one in page order.
    return next((n for n in reversed(containers) if n.total == root.total), root) if root.total else root


def host(url: str | None) -> str | None:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower().removeprefix("www.") if m else None


def vote(page: str | None) -> tuple[str, int]:
    node = best(*blocks(page or ""))
    return node.path, node.total


def text_of(page: str | None, path: str | None) -> str:
    """The page's text by ``path``, or by its own best container."""
    found, nodes = blocks(page or "")
    own = best(found, nodes)
    wanted = _path_mark(path) if path is not None else None
    chosen = [n for n in nodes if n.mark == wanted and n.tag in CONTAINER and not n.dropped]
    if not chosen or sum(n.total for n in chosen) < own.total:
        chosen = [own]
    for node in chosen:
        node.inside = True
    for node in nodes[1:]:
        node.inside |= node.parent.inside
    return "\n\n".join(text for node, text, _ in found if node.inside)


def paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the winning path of each host."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            votes = [vote(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string()), pa.array([p for p, _ in votes], pa.string()), pa.array([t for _, t in votes], pa.int64())],
                names=["host", "path", "chars"],
            )

    counted = pages.select("url", "html").mapInArrow(run, "host string, path string, chars long").where("host IS NOT NULL AND chars > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    best_first = F.min(F.struct((-F.col("votes")).alias("votes"), (-F.col("chars")).alias("chars"), "path"))
    return counted.groupBy("host").agg(best_first.alias("b"), F.max("votes").alias("votes")).select("host", "b.path", "votes")


#: Hosts up to which the winning paths are sent to every executor; beyond, pages and paths are joined by a shuffle.
SENT_HOSTS = 50_000
#: Then each host's pages are dealt out to so many tasks.
SALTS = 64


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path (the host's, if any) for every row of ``pages`` (page_id, url, html)."""
    winners = written(paths(pages).select("host", "path"), "host-paths")
    few = winners.count() <= SENT_HOSTS
    winners = F.broadcast(winners.withColumn("salt", F.lit(0))) if few else winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = pages.select("page_id", "url", "html").withColumn("host", F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "html"):
            texts = [text_of(page, path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")], names=["page_id", "url", "text", "n_chars", "path"])

    # Pages without a host have a salt that no winner has, so none of them meets another by it.
    salt = F.lit(0) if few else F.pmod(F.xxhash64("page_id", "url"), F.when(F.col("host") == "", 1 << 30).otherwise(SALTS)).cast("int")
    return named.withColumn("salt", salt).join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
