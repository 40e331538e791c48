"""Main text of web pages: what is a site's template is told by element subtrees that recur across its pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._shared import release, small_batches, stash

# Element names of HTML, and what its writers call the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg object canvas audio video annotation annotation-xml".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr
    math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mfenced""".split()
)
CHROME = frozenset("nav footer aside form menu dialog button select fieldset datalist head input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice
    notices overlay pagination popup promo promoted recommended related replies respond share sharing sidebar sitemap
    skip social sponsor sponsored subscribe subscription toolbar widget""".split()
)
#: Of these, those that tell wherever they stand in a name; the others only do first or last in it.
TELLING = frozenset("ads advert adverts advertisement advertising comment comments cookie cookies gdpr newsletter sidebar sponsored".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th article section main div aside nav footer header form blockquote body html select".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|(?P<comment>.*?)(?:--!?>|$))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Elements that may be a template's within an article, too; paragraphs and the like never are.
BOXES = frozenset("div section ul ol dl table figure center".split())
#: A box in an article whose paragraphs hold so many characters isn't deleted for a weak name alone.
PROSE = 60


class Node:
    __slots__ = ("attrs", "digest", "heading", "kids", "main", "name", "prose", "size")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.kids = name, attrs, []  # kids: nodes and texts
        self.digest, self.size, self.prose, self.heading, self.main = b"", 0, 0, False, name == "main"


def parse(html: str) -> Node:
    """The element tree of a page, as browsers would see it in the usual cases: unclosed and wrongly closed elements,
    void and raw-text elements, comments, and pages that end anywhere. Elements may be nested to any depth."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    opened: Counter[str] = Counter()

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.name] -= 1
        del stack[k:]

    while at < n:
        tag = html.find("<", at)
        if tag != at:
            stack[-1].kids.append(html[at:tag] if tag > 0 else html[at:])
            if tag < 0:
                break
        m = _TOKEN.match(html, tag)
        at = m.end() if m else tag + 1
        if not m:
            stack[-1].kids.append("<")
            continue
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                if name in INLINE and stack[k].name not in INLINE or name == "p" and stack[k].name in SCOPES:
                    break
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in SCOPES:
                    break
        if (closed := CLOSED_BY.get(name)) and any(opened[c] for c in closed):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closed:
                    close(k)
                    break
                if stack[k].name in SCOPES and stack[k].name not in closed:
                    break
        node = Node(name, m["attrs"])
        stack[-1].kids.append(node)
        if name in VOID or m["attrs"].endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[name] += 1
    _sum_up(root)
    return root


def _sum_up(root: Node) -> None:
    """From the leaves up, once for each element: a digest of it with all below it, whatever its white space and
    attributes; the length of its text, and of that in paragraphs; whether it holds the page's first main heading, or a main element."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    if first := next((x for x in order if x.name == "h1"), None):
        first.heading = True
    for node in reversed(order):
        h = blake2b(b"<" + node.name.encode(), digest_size=8)
        for kid in node.kids:
            if isinstance(kid, str):
                text = _SPACE.sub(" ", kid)
                node.size += len(text.strip())
                h.update(text.encode("utf-8", "surrogatepass"))
            else:
                node.size += kid.size
                node.prose += kid.prose
                node.heading |= kid.heading
                node.main |= kid.main
                h.update(b"<" + kid.digest)
        if node.name == "p":
            node.prose = node.size
        node.digest = h.digest()


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attrs)}


def is_chrome(node: Node, in_article: bool, total: int) -> bool:
    """Whether an element by its name, role, class or id is not part of an article. total is the length of the page's
    text: a form, or an element with a weak name, that holds most of it is a wrapper, and so is one with a telling name
    that holds the main heading, too. In an article a weak name alone deletes no paragraphs: that takes a telling one, or
    that the box recurs on its host."""
    if node.name == "form":
        return 2 * node.size <= total
    if node.name in CHROME or node.name in RAW or (node.name == "header" and not in_article):
        return True
    if not node.attrs or node.name in ("main", "body", "html"):
        return False
    a = attributes(node)
    if a.get("role", "").lower() in CHROME_ROLES or a.get("aria-hidden") == "true" or "hidden" in a:
        return 2 * node.size <= total or not node.heading
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+|\d+$", name) if w]
        if words and not {"has", "with", "no"} & {*words} and (CHROME_WORDS & {words[0], words[-1]} or TELLING & {*words}):
            telling = bool(TELLING & {*words})
            if in_article and not telling and (words[-1] == "header" or node.prose >= PROSE):
                continue
            if not (2 * node.size > total and (node.heading or not telling)):
                return True
    return False


def blocks(node: Node, gone: frozenset[bytes], inside: bool, total: int) -> list[str]:
    """Texts of the blocks of an element, without the subtrees in gone, and without what isn't part of an article."""
    out: list[list[str]] = [[]]
    todo = [(iter(node.kids), inside, False)]
    while todo:
        kids, inside, block = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
            if block:
                out.append([])
        elif isinstance(kid, str):
            out[-1].append(unescape(kid) if "&" in kid else kid)
        elif kid.name == "br":
            out[-1].append(" ")
        elif kid.digest in gone and kid.name not in INLINE and (not inside or kid.name in BOXES) or is_chrome(kid, inside, total):
            continue
        elif kid.name in INLINE:
            todo.append((iter(kid.kids), inside, False))
        else:
            out.append([])
            todo.append((iter(kid.kids), inside or kid.name in ("article", "main"), True))
    return [t for parts in out if (t := _SPACE.sub(" ", "".join(parts)).strip())]


def articles(root: Node) -> list[Node]:
    """The elements that hold a page's content: its outermost articles, or main elements where these hold paragraphs or
    headings beside the articles, or else nothing in particular (none): where the page has more prose outside of them
    than within, its articles are cards, and the whole page counts."""
    found = named(root, ("article", "main"))
    mains = named(root, ("main",)) if root.main and found and found[0].name == "article" else []
    if mains and beside(mains, found, root.size):
        found = mains
    prose = sum(x.prose for x in found)
    return [] if found and 2 * prose < root.prose and prose < prose_outside(root, found) else found


def beside(mains: list[Node], inner: list[Node], total: int) -> bool:
    """Whether main elements hold headings or paragraphs that are neither in their articles nor in what isn't content."""
    own, todo = {id(x) for x in inner}, [x for m in mains for x in m.kids]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or id(node) in own or is_chrome(node, False, total):
            continue
        if node.name in ("p", "h1", "h2") and node.size:
            return True
        todo.extend(node.kids)
    return False


def prose_outside(root: Node, inner: list[Node]) -> int:
    """The length of the paragraphs outside of elements and of what isn't content."""
    own, todo, n = {id(x) for x in inner}, [root], 0
    while todo:
        node = todo.pop()
        if isinstance(node, str) or id(node) in own or node is not root and is_chrome(node, False, root.size):
            continue
        n += node.size if node.name == "p" else 0
        todo.extend(node.kids if node.name != "p" else ())
    return n


def named(root: Node, names: tuple[str, ...]) -> list[Node]:
    """The outermost elements of a page with the first of the names that it has, in page order: outside of what isn't
    content, or anywhere if there is none outside."""
    for name in names:
        for strict in (True, False):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.name == name and not is_chrome(node, False, root.size):
                    found.append(node)
                elif node.name not in RAW and not (strict and node.name not in ("#root", "form") and is_chrome(node, False, root.size)):
                    todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
            if found:
                return found
    return []


def template_candidates(root: Node) -> tuple[bytes, list[bytes]]:
    """A digest of the page's own content, and those of the block subtrees that may be its template's."""
    inside = articles(root)
    own, out, todo = {id(x) for x in inside}, set(), [(root, False)]
    while todo:
        node, within = todo.pop()
        for kid in node.kids:
            if isinstance(kid, str) or kid.name in INLINE or kid.name in RAW or kid.name in VOID:
                continue
            todo.append((kid, within or id(kid) in own))
            if kid.name in BOXES if within else id(kid) not in own and kid.name not in ("html", "body", "head"):
                out.add(kid.digest)
    content = b"\n".join(t.encode("utf-8", "surrogatepass") for x in inside for t in blocks(x, frozenset(), True, root.size)) if inside else root.digest
    return blake2b(content, digest_size=8).digest(), sorted(out)


def main_text(root: Node, gone: frozenset[bytes]) -> str:
    inside = articles(root)
    if not inside:
        return "\n".join(blocks(root, gone, False, root.size))
    out = []
    for x in inside:
        whole = blocks(x, frozenset(), True, root.size)
        left = blocks(x, gone, True, root.size) if gone else whole
        # What holds most of an article is no template, however often it recurs.
        out += left if 2 * sum(map(len, left)) >= sum(map(len, whole)) else whole
    return "\n".join(out)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, own, subtrees = [], [], []
        for host, html in zip(*batch.columns, strict=True):
            content, found = template_candidates(parse(html.as_py() or ""))
            found = [None, *found]  # none: the page itself
            hosts += [host.as_py()] * len(found)
            own += [int.from_bytes(content, "little", signed=True)] * len(found)
            subtrees += [None if x is None else int.from_bytes(x, "little", signed=True) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(own, pa.int64())], names=["host", "subtree", "content"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, gone in zip(batch.column(2), batch.column(3), strict=True):
            texts.append(main_text(parse(html.as_py() or ""), frozenset(x.to_bytes(8, "little", signed=True) for x in gone.as_py() or ())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 2, share: float = 0.1) -> DataFrame:
    """(id, url, text) of each page: the text of its article, a line for each block.

    Site templates: the block subtrees of all pages are hashed and counted for each host, once for each different
    content, so that copies of one page don't make a template of it; subtrees that stand around more than
    `least` + `share` * n of a host's n contents are deleted, whatever they are called. So a box must recur on three pages of
    a small host, and on a tenth of a large one. What hardly recurs by its nature, such as reader comments and adverts, or
    stands on a host of few pages, goes by its element, role, class or id, unless it wraps most of a page.
    If a page has an article (or main) element, its text is that of these, and only boxes in them are deleted for
    recurring, no paragraphs of their own, since articles may share passages; none is deleted from an article that
    would lose more than half of its text by that.

    Counting pairs of subtree and content is combined before the shuffle and keyed on host and subtree, so that a host
    with a third of all pages is spread. The subtrees to delete reach a host's pages by a join on host, which adaptive
    execution splits where a host is hot. Each of them stands around `share` of the contents at least: a host has at most
    1 / `share` times as many as a page has on average.

    Nulls: a null html or one without text gives an empty text; a null url counts as a host of its own with no pages
    in common. Elements may be nested to any depth. Rows stand alone and may repeat; other columns are ignored. An empty
    table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    base = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    pairs = base.where("host <> ''").select("host", "html").mapInArrow(_subtrees, "host string, subtree long, content long").distinct()
    counts = stash(pairs.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("subtree").isNull() | (F.col("n") > least)), "counts")
    contents = counts.where("subtree is null").select("host", F.col("n").alias("contents"))
    often = counts.where("subtree is not null").join(contents, "host").where(F.col("n") > least + share * F.col("contents"))
    # Written, so that its size is known to the join with the pages, which can be split then.
    gone = stash(often.groupBy("host").agg(F.collect_list("subtree").alias("gone")), "templates")
    release(counts)
    rows = base.join(gone, "host", "left").select("id", "url", "html", "gone")
    out = rows.mapInArrow(_extracted, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
