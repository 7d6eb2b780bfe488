"""Main text of web pages: site templates found by counting element subtrees per host, then the article's blocks.

A subtree's hash covers its tags, texts and order. Subtrees of whole pages are counted, menus and footers included; those
that stand on several distinct pages of a host are its template and are deleted, wherever on the page they stand. Only then
is the main part chosen: the articles, or the main element, if they hold most of the running text that is left, else the
page. What never recurs (a host of few pages, a menu that differs from page to page) is left to tags, roles and names.

Pages are read twice: once to count, once to delete and extract. The templates of all hosts go to the tasks as sorted hashes
if they are at most MOST_TEMPLATES; beyond that, pages meet their own templates in a join.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, use_workers, written
from plumbline.llm.urls import host_of

#: A subtree is part of a site's template if so many distinct pages of the host hold it. Templates that are broadcast at
#: most: 16 MB.
LEAST_PAGES, MOST_TEMPLATES = 5, 1 << 21
#: Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
#: Prose of an article, which is never template, and what stands within lines of text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody thead figcaption".split())
INLINE = frozenset("b i em strong a span code q cite small sub sup u s mark abbr time".split())
NO_TEXT = frozenset(
    "script style nav footer aside form button select input textarea noscript iframe svg canvas template object embed audio video dialog menu head title search label fieldset map noframes noembed xmp".split()
)
NO_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
#: Names of what is no part of an article, whatever it says; and of what is none unless it holds running text.
NAMES = frozenset(
    "ad ads adbox adslot adunit adblock adwrap adwrapper adcontainer adbanner adspace advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos banner banners nav navbar navigation subnav sidenav menubar topbar masthead footer footers sidebar sidebars breadcrumb breadcrumbs cookie cookies cookiebar consent gdpr notice notices alert alerts newsletter subscribe subscription comment comments commentlist respond replies disqus related recommended popup modal pagination pager toolbar skiplink hidden sharebar".split()
)
UNLESS_PROSE = frozenset("header login signup share sharing social widget widgets overlay menu menus".split())
#: A comment of these is the article's own if it is running text; and what a heading over readers' comments is named.
OWN_COMMENT = frozenset("story article articles entry text main".split())
COMMENT_HEADINGS = frozenset("comments commentlist respond replies disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What such names are joined with (site-header, post-comments); a name with any other part says something else.
JOINED = frozenset(
    "site page top bottom main global bar box list wrapper wrap container links link section block inner outer left right primary secondary area zone unit slot space post posts article articles entry story user users reader readers blog btn button buttons group item items icon icons count thread body text title row col column panel sticky fixed mobile desktop the js skip side sr only".split()
)
NO_WHOLE = frozenset("side-bar skip-link sr-only visually-hidden screen-reader-text top-bar".split())
#: Names that tell of a neighbour (with-sidebar) or of an article's own heading (post-header).
NEIGHBOUR = re.compile(r"(?:^|[-_])(?:has|with|no|without)[-_]", re.I)
OWN_HEADER = re.compile(r"^(?:article|post|entry|story|content|headline|h)[-_]+header$", re.I)
#: Words outside links and fields from which an element counts as running text.
PROSE_WORDS = 8
FIELDS = frozenset("a button select option input textarea label nav script style".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Open elements that a tree may have one in another, and frames of Python's stack that walking it may take.
DEEPEST, FRAMES = 5000, 20_000

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element: its name, attributes and children (elements and texts in order)."""

    __slots__ = ("tag", "attrs", "children", "mark")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.mark = tag, attrs, [], None

    def attributes(self) -> dict[str, str]:
        return {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(self.attrs)} if self.attrs else {}


def parse(html: str) -> Node:
    """The tree of any text taken as HTML; missing and stray end tags are repaired as browsers do in the common cases.

    Elements below DEEPEST open ones stand beside their contents, as browsers have it, so no tree outgrows the stack.
    """
    root = Node("html", "")
    flat: Counter[str] = Counter()
    stack = [root]
    at, n = 0, len(html)
    scan = TAG.search
    while at < n:
        m = scan(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "p" and all(x.tag != "p" for x in stack):
                stack[-1].children.append(Node("p", ""))  # a stray end of a paragraph still ends the line
                continue
            if flat[tag]:
                flat[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        elif tag in CLOSES:
            shut, within = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in shut:
                    del stack[i:]
                    if tag != "tr":
                        break
                    if stack[-1].tag not in shut:
                        break
        node = Node(tag, m[3].strip())
        stack[-1].children.append(node)
        if tag in RAW and not node.attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag in ("textarea", "title"):
                node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (node.attrs.endswith("/") and tag not in BLOCK):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                flat[tag] += 1
    return root


def below(node: Node) -> Iterator[Node | str]:
    """Everything below the node, in any order, whatever its depth."""
    todo = list(node.children)
    while todo:
        c = todo.pop()
        yield c
        if not isinstance(c, str):
            todo.extend(c.children)


def prose_words(node: Node) -> int:
    """Words outside links and fields."""
    n, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                n += len(c.split())
            elif c.tag not in FIELDS:
                todo.append(c)
    return n


def length(node: Node) -> int:
    """Characters of words below the node, scripts and styles left out."""
    n, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                n += len("".join(c.split()))
            elif c.tag not in ("script", "style"):
                todo.append(c)
    return n


def holds(node: Node, tags: tuple[str, ...]) -> bool:
    return any(isinstance(c, Node) and c.tag in tags for c in below(node))


def framed(root: Node) -> int:
    """Characters of a page with a form, which may be its frame; 0 for others."""
    return length(root) if holds(root, ("form", "fieldset")) else 0


def named_outside(names: str, node: Node, in_article: bool) -> bool:
    """Whether a class or id attribute names something that is no part of an article.

    Every part of the name must say so or be a word that such names are joined with: market-share and chapter-header name
    an article's own parts. A paragraph, item or other prose element of an article is never outside for its name if it is
    running text, nor is a menu or a story-comment that is.
    """
    for token in names.lower().split():
        if token in NO_WHOLE:
            return True
        if NEIGHBOUR.search(token) or OWN_HEADER.match(token):
            continue
        parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
        said = [p for p in parts if p in NAMES]
        soft = [p for p in parts if p in UNLESS_PROSE]
        if not said and not soft or any(p not in NAMES and p not in UNLESS_PROSE and p not in JOINED for p in parts):
            continue
        if said:
            own = in_article and node.tag in PROSE or said == ["comment"] and any(p in OWN_COMMENT for p in parts)
            if not own or prose_words(node) < PROSE_WORDS:
                return True
            continue
        if soft == ["header"] and not in_article:
            return not holds(node, ("article", "main"))
        if not (in_article and holds(node, ("h1", "h2"))) and prose_words(node) < PROSE_WORDS:
            return True
    return False


def is_outside(node: Node, in_article: bool, page: int = 0) -> bool:
    """Whether tag, role, name or visibility say that this element is no part of the article.

    A form round an article, or round half of the page's characters and more, is a frame and stays.
    """
    if node.tag in ("form", "fieldset"):
        if not holds(node, ("article", "main")) and not (page and 2 * length(node) >= page):
            return True
    elif node.tag in NO_TEXT:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in NO_ROLES and node.tag not in ("form", "fieldset"):
        return True
    if node.tag in ("article", "main"):
        return bool(re.search(r"(?:^|[\s_-])(?:comments?|related|recommended|sponsor[a-z]*|promo[a-z]*|ads?)(?:$|[\s_-])", f"{a.get('class', '')} {a.get('id', '')}", re.I))
    return named_outside(a.get("class", ""), node, in_article) or named_outside(a.get("id", ""), node, in_article)


def heads_comments(node: Node) -> bool:
    """Whether this is a heading over readers' comments, by its name."""
    if node.tag not in HEADINGS or not node.attrs:
        return False
    a = node.attributes()
    for token in f"{a.get('id', '')} {a.get('class', '')}".lower().split():
        parts = re.split(r"[-_]+", token)
        if not COMMENT_HEADINGS.isdisjoint(parts) and all(p in COMMENT_HEADINGS or p in JOINED or p in HEADINGS or p in ("heading", "header") for p in parts):
            return True
    return False


def kept(node: Node, in_article: bool, page: int) -> Iterator[tuple[Node | str, bool]]:
    """The node's children, each with whether it is part of the article: what a heading over readers' comments heads, up to
    the next heading of its rank, is none."""
    rank = None
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in HEADINGS and rank is not None and c.tag <= rank:
                rank = None
            if rank is None and heads_comments(c):
                rank = c.tag
            yield c, rank is None and not is_outside(c, in_article, page)
        else:
            yield c, rank is None


def running_words(node: Node, in_article: bool, page: int) -> int:
    """Words outside links and fields of what is part of the article."""
    n = 0
    for c, part in kept(node, in_article, page):
        if part:
            n += len(c.split()) if isinstance(c, str) else 0 if c.tag in FIELDS else running_words(c, in_article, page)
    return n


def outermost(node: Node, is_one, page: int) -> list[Node]:
    """The outermost elements below the node that are one, and that nothing declares to be outside."""
    found: list[Node] = []
    for c, part in kept(node, False, page):
        if part and isinstance(c, Node):
            if is_one(c):
                found.append(c)
            else:
                found += outermost(c, is_one, page)
    return found


def is_article(node: Node) -> bool:
    return node.tag == "article"


def is_main(node: Node) -> bool:
    return node.tag == "main" or "main" in node.attrs.lower() and node.attributes().get("role", "").lower() == "main"


def main_roots(root: Node) -> tuple[list[Node], bool]:
    """The outermost articles, or else main elements, whichever first hold half of the running text or more, or else the
    page; and whether they are such elements. Within main elements, articles are chosen in the same way."""
    page = framed(root)
    whole = running_words(root, False, page)
    words = lambda nodes: sum(running_words(x, True, page) for x in nodes)
    articles = outermost(root, is_article, page)
    if articles and 2 * words(articles) >= whole:
        return articles, True
    mains = outermost(root, is_main, page)
    held = words(mains)
    if mains and 2 * held >= whole:
        within = [x for m in mains for x in outermost(m, is_article, page)]
        return (within, True) if within and 2 * words(within) >= held else (mains, True)
    return [root], False


def signature(node: Node, out: list[tuple[Node, int]] | None) -> bytes:
    """The subtree's hash; every element with text is put in out with its hash."""
    h = hashlib.blake2b(node.tag.encode("utf-8", "surrogatepass"), digest_size=8)
    some = False
    for c in node.children:
        if isinstance(c, str):
            words = " ".join(c.split())
            if words:
                h.update(b"\x01" + words.encode("utf-8", "surrogatepass"))
                some = True
        else:
            d = signature(c, out)
            if d:
                h.update(b"\x02" + d)
                some = True
    if not some:
        return b""
    d = h.digest()
    if out is not None:
        out.append((node, int.from_bytes(d, "little", signed=True)))
    return d


def candidates(root: Node) -> list[tuple[Node, Node, int]]:
    """Subtrees of the whole page that may be template: parent, element and hash.

    Of article and main elements, prose is none, nor are such elements themselves or what holds them, but for the articles
    of a page with several. An element within a line of text is part of that line, and a table's cell without elements is a
    value: neither is counted by itself.
    """
    page = framed(root)
    found: list[tuple[Node, int]] = []
    signature(root, found)
    hashes = {id(n): d for n, d in found}
    articles = outermost(root, is_article, page)
    mains = {id(x) for x in outermost(root, lambda n: is_article(n) or is_main(n), page)} | {id(x) for x in articles}
    several = {id(x) for x in articles} if len(articles) > 1 else set()
    out: list[tuple[Node, Node, int]] = []

    def walk(node: Node, article: bool, prose: bool) -> bool:
        """Whether a main element is below; prose tells that the block around is an article's prose."""
        holds_main = False
        alone = not any(isinstance(c, str) and not c.isspace() for c in node.children)
        for c in node.children:
            if not isinstance(c, Node) or id(c) not in hashes:
                continue
            own_main = id(c) in mains
            within = article or own_main
            inline = c.tag in INLINE
            own_prose = prose if inline else within and c.tag in PROSE
            deeper = walk(c, within, own_prose)
            holds_main |= own_main or deeper
            if id(c) in several:
                out.append((node, c, hashes[id(c)]))
            if own_main or deeper or own_prose or inline and not alone:
                continue
            if c.tag in CELLS and not any(isinstance(x, Node) and id(x) in hashes for x in c.children):
                continue
            out.append((node, c, hashes[id(c)]))
        return holds_main

    walk(root, False, False)
    return out


def pruned(root: Node, is_template) -> int:
    """Delete the subtrees whose hashes are the template's, and say how many stood on the page; a block leaves the end of a
    line.

    Where every article of a page is template, their recurrence tells nothing and they stay.
    """
    may = candidates(root)
    told = is_template([h for _, _, h in may])
    articles = [t for (_, c, _), t in zip(may, told) if is_article(c)]
    spared = bool(articles) and all(articles)
    gone = {id(c): (parent, c) for (parent, c, _), t in zip(may, told) if t and not (spared and is_article(c))}
    for parent in {id(p): p for p, _ in gone.values()}.values():
        parent.children = [c if isinstance(c, str) or id(c) not in gone else Node("hr" if c.tag in BLOCK else "wbr", "") for c in parent.children]
    return len(gone)


def lines_of(roots: list[Node], sure: bool, page: int) -> str:
    """The roots' lines of text, joined by an empty line; what is outside is left out."""
    done: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join("".join(line).split())
        if text:
            done.append(text)
        line.clear()

    def walk(node: Node) -> None:
        for c, part in kept(node, sure, page):
            if isinstance(c, str):
                if part:
                    line.append(unescape(c) if "&" in c else c)
            elif c.tag == "br":
                line.append("\n")
            elif c.tag == "hr" or not part:
                if c.tag in BLOCK:
                    close()
            elif c.tag in CELLS:
                line.append(" ")
                walk(c)
                line.append(" ")
            elif c.tag in BLOCK:
                close()
                walk(c)
                close()
            else:
                walk(c)

    for r in roots:
        walk(r)
        close()
    return "\n\n".join(done)


def deep(of):
    """of, run where trees as deep as DEEPEST can be walked: only Python functions call themselves here, which takes frames
    but none of the machine's stack."""

    def run(*args):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, FRAMES))
        try:
            return of(*args)
        finally:
            sys.setrecursionlimit(before)

    return run


@deep
def page_hashes(html: str) -> list[int]:
    """The hashes of all subtrees of a page that may be template."""
    return sorted({h for _, _, h in candidates(parse(html))})


@deep
def extracted(html: str, is_template) -> tuple[str, int]:
    """The main text without template and surroundings, and how many subtrees were deleted as template."""
    root = parse(html)
    deleted = pruned(root, is_template)
    roots, sure = main_roots(root)
    return lines_of(roots, sure, framed(root)), deleted


def main_text(html: str, template: set[int]) -> str:
    """The article's blocks, joined by an empty line."""
    return extracted(html, lambda hashes: [h in template for h in hashes])[0]


def counted_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, doc, hashes) of each page: a hash that tells distinct pages apart, and those of its subtrees."""
    text = F.col(html).cast("string")
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(text).alias("doc"), text.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                hashes = [page_hashes(value) if value else [] for value in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(hashes, pa.list_(pa.int64()))], names=["host", "doc", "hashes"])

    return written(rows.mapInArrow(run, "host string, doc long, hashes array<bigint>"), "pages")


def templates_of(read: DataFrame, least_pages: int) -> DataFrame:
    each = read.select("host", "doc", F.explode("hashes").alias("hash"))
    return each.groupBy("host", "hash").agg(F.count_distinct("doc").alias("pages")).where(F.col("pages") >= least_pages)


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, pages): subtrees on so many distinct pages of a host.

    Null and empty pages have no subtrees; repeated rows are one page; rows without a host are pages of one site; an empty
    table has no templates. Other columns are ignored.
    """
    use_workers(pages.sparkSession)
    return templates_of(counted_pages(pages, url, html), least_pages)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(key, url, text, n_chars, n_deleted) of every page: the main text without template and surroundings, "" if there is
    none, its code points, and how many subtrees of the page were deleted as template.

    A null page has no text. Pages without a host count as one site. Repeated rows are pages of their own, but count once
    for templates. Columns other than the three named are dropped. Paragraphs, headings, list items and cells of an article
    are never template, however often they recur; a whole list or table may be, and of several articles on a page those
    that other pages hold too. On hosts with fewer than least_pages pages nothing recurs often enough: there tags, roles
    and names alone decide. A page is one value in one task; an empty table gives none.
    """
    spark = pages.sparkSession
    use_workers(spark)
    text = F.col(html).cast("string")
    site = F.xxhash64(host_of(F.col(url)))
    # a template is told by its host's hash and its own, in one number
    templates = written(templates_of(counted_pages(pages, url, html), least_pages).select(F.xxhash64("host").bitwiseXOR(F.col("hash")).alias("template")), "templates")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), site.alias("site"), text.alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"key {kinds['key']}, url {kinds['url']}, text string, n_deleted long"

    def texts(b: pa.RecordBatch, known) -> pa.RecordBatch:
        done = [extracted(h, known(i, s)) if h else ("", 0) for i, (h, s) in enumerate(zip(b.column("html").to_pylist(), b.column("site").to_pylist()))]
        return pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["key", "url", "text", "n_deleted"])

    if templates.count() <= MOST_TEMPLATES:
        shared = spark.sparkContext.broadcast(np.sort(templates.toArrow().column("template").to_numpy()))  # at most 16 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value

            def known(_: int, site: int):
                def told(hashes: list[int]) -> list[bool]:
                    if not len(table) or not hashes:
                        return [False] * len(hashes)
                    own = np.array(hashes, np.int64) ^ np.int64(site)
                    return (table[np.minimum(np.searchsorted(table, own), len(table) - 1)] == own).tolist()

                return told

            for whole in batches:
                for b in slices(whole, "html"):
                    yield texts(b, known)

        done = rows.mapInArrow(run, schema)
    else:
        done = joined_texts(rows, templates, texts, schema)
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")


def joined_texts(rows: DataFrame, templates: DataFrame, texts, schema: str) -> DataFrame:
    """The texts of pages that meet their templates in a join, where those are too many to be broadcast."""
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "pages")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                row, site = b.column("row").to_pylist(), b.column("site").to_pylist()
                found = [(r, h ^ s) for r, s, page in zip(row, site, b.column("html").to_pylist()) if page for h in page_hashes(page)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], names=["row", "template"])

    # both sides are plain rows of written tables, so adaptive execution may split a menu that stands on a third of all pages
    subtrees = written(numbered.select("row", "site", "html").mapInArrow(each, "row long, template long"), "subtrees")
    own = subtrees.join(templates.hint("merge"), "template", "left_semi").groupBy("row").agg(F.collect_set("template").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                sets = [set(x or ()) for x in b.column("own").to_pylist()]
                yield texts(b, lambda i, site, sets=sets: lambda hashes: [h ^ site in sets[i] for h in hashes])

    return numbered.join(own, "row", "left").select("key", "url", "site", "html", "own").mapInArrow(run, schema)
