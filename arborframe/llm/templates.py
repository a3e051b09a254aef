"""Main text of HTML pages by removal of site templates.

A page is read into a tree that forgives missing end tags.  Every element subtree is hashed; per host, Spark
counts the pages of different text that hold each hash, and subtrees on many of the host's pages (LEAST of them and
SHARE of all, copies of a page counting once) are its template.  A page's text is what its article (or main part, or
else body) keeps after the template, elements of menus, headers, footers, asides, forms, scripts and the like, and
elements named as such by class, id or role are taken out.

What an article says is never taken out for being said elsewhere: in an article or main part only recurring elements
without paragraphs, headings, lists, quotes or tables in them (bare notices) count as template, and there a name must
consist of such words altogether.  On a page without one, a recurring paragraph or heading stays if it stands in an element that does
not recur.

Edge cases: a null or empty page, or one without text, gives an empty text; a null or odd url belongs to the
host named by an empty string; copies of a page each get its text; cut-off tags and comments end with the
page; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from arborframe.llm.common import settle_memory, stored, table

LEAST, SHARE = 5, 0.3
#: Template hashes that may be broadcast; with more, they are joined by host.
BROADCAST = 200_000
#: A template that holds no element, hashed or not.
_NONE = frozenset((None,))

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("head script style noscript template iframe object embed nav header footer aside form button input select textarea dialog menu svg math canvas audio video title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
STOPS = frozenset("ul ol dl table tr article section div body main menu select".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|cookies?|consent|notice|banner|ads?|advert|adverts|advertisement|sponsor(?:ed)?|promo|promotion|comments?|disqus|replies|related|recommended|share|sharing|social|newsletter|subscribe|subscription|signup|login|search|popup|modal|overlay|pagination|pager|toolbar)(?:$|[\s_-])|^(?:navigation|banner|contentinfo|complementary|search|dialog|alertdialog|form)$", re.I)
#: Elements that hold what a text says.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure table tr td th".split())
#: In articles: words of names for what is no part of them, and words that may go with them.
JUNK = frozenset("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget cookie cookies consent notice banner ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus replies related recommended share sharing social newsletter subscribe subscription signup login search popup modal overlay pagination pager toolbar".split())
WITH = frozenset("site page main top bottom left right global primary secondary wrap wrapper container inner outer area block box section bar panel list item items links link posts post articles button buttons form icons icon header text title".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "hash")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.hash = tag, attributes, [], 0


def parse(html: str) -> Node:
    root = Node("", "")
    stack, at = [root], 0
    for_end = len(html)
    find = _TAG.search
    while at < for_end:
        m = find(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        same = SAME.get(name, ("p",) if name in CLOSES_P else ())
        for k in range(len(stack) - 1, 0, -1) if same else ():
            if stack[k].tag in same:
                del stack[k:]
                if name != "tr":
                    break
            elif stack[k].tag in STOPS:
                break
        node = Node(name, m.group(3))
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(html, at)
            node.children.append(html[at : end.start()])
            close = html.find(">", end.start())
            at = for_end if close < 0 else close + 1
            continue
        stack.append(node)
    return root


def _post_order(root: Node):
    todo = [(root, False)]
    while todo:
        node, seen = todo.pop()
        if seen:
            yield node
            continue
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def hashed(root: Node) -> set[int]:
    """Sets every element's hash; returns those of elements that a template may hold."""
    out = set()
    for node in _post_order(root):
        parts = [node.tag, node.attributes.strip()]
        parts += [str(c.hash) if isinstance(c, Node) else " ".join(c.split()) for c in node.children]
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        if node.tag not in VOID and node.tag not in ("", "html", "body", "head", "main", "article"):
            out.add(node.hash)
    return out


def _named(name: str) -> bool:
    """Whether a name says, and says only, that the element is no part of the article."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w and not w.isdigit()]
    return any(w in JUNK for w in words) and all(w in JUNK or w in WITH for w in words)


def _junk(node: Node, inside: bool) -> bool:
    # an article's own header holds its title
    if node.tag in DROP and not (node.tag == "header" and inside):
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    names = [(m[0].lower(), m[1] or m[2] or m[3]) for m in _NAMES.findall(node.attributes)]
    if node.tag == "article":
        return any(re.search(r"comment|repl(?:y|ies)|related|teaser|promo|advert", x, re.I) for _, x in names)
    if any(kind == "hidden" for kind, _ in names):
        return True
    if inside:
        return any(map(_named, (w for kind, x in names for w in (x.split() if kind == "class" else [x]))))
    return any(NAMED.search(x) for _, x in names)


def _holds_content(node: Node) -> bool:
    return any(n.tag in CONTENT for n in _post_order(node))


def _recurring(node: Node, parent: Node, inside: bool, template) -> bool:
    """Whether the node goes as a part of the site's template."""
    if node.hash not in template:
        return False
    if inside:
        return node.tag not in INLINE and parent.tag not in CONTENT and not _holds_content(node)
    return node.tag not in CONTENT or parent.tag in ("", "html", "body") or parent.hash in template


def _parts(root: Node, template: frozenset) -> list[Node]:
    """The articles; without one the main parts, or else the page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        # an article that recurs is an article all the same; copies of it say so
        if _junk(node, False) or node.tag not in ("article", "main") and node.hash in template and not any(n.tag in ("article", "main") for n in _post_order(node)):
            continue
        if node.tag == "article":
            found["article"].append(node)
            continue
        if node.tag == "main" or 'role="main"' in node.attributes:
            found["main"].append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found["article"] or found["main"][:1] or [root]


def main_text(root: Node, template=frozenset()) -> str:
    out: list[str] = []
    for part in _parts(root, template):
        inside = part.tag in ("article", "main")
        todo: list = [(part, part)]
        while todo:
            node, parent = todo.pop()
            if isinstance(node, str):
                out.append(entities.unescape(node) if "&" in node else node)
                continue
            if node is not part and (_junk(node, inside) or _recurring(node, parent, inside, template)):
                out.append(" ")
                continue
            if node.tag not in INLINE:
                out.append(" ")
                todo.append((" ", node))
            todo.extend((c, node) for c in reversed(node.children))
    return " ".join("".join(out).split())


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and its template's subtree hashes.  Hash 0 stands for the page itself, so it counts the host's pages.

    Pages whose main text before any template is equal are copies and count once, so no article becomes a template by
    its own copies.
    """

    def run(batches):
        for batch in batches:
            hosts, hashes, contents = [], [], []
            for h, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                root = parse(body or "")
                found = [0, *hashed(root)]
                contents += [xxhash.xxh64_intdigest(main_text(root, _NONE).encode("utf-8", "surrogatepass")) - (1 << 63)] * len(found)
                hosts += [h] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], names=["host", "hash", "content"])

    seen = pages.select(host(pages[url]).alias("host"), pages[html].alias("html")).mapInArrow(run, "host string, hash bigint, content bigint")
    counts = stored(seen.groupBy("host", "hash").agg(F.count_distinct("content").alias("count")).where(F.col("count") >= LEAST))
    whole = counts.where("hash = 0").select("host", F.col("count").alias("pages"))
    often = counts.where("hash <> 0").join(whole, "host").where(F.col("count") >= SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))


def extract(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Columns `keep` of every page with its main text."""
    found = stored(site_templates(pages, url, html))
    small = (found.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST
    columns = [f"_k{i}" for i in range(len(keep))]
    now = pages.select(*[pages[c].alias(k) for c, k in zip(keep, columns)], host(pages[url]).alias("_host"), pages[html].alias("_html"))
    if small:  # BROADCAST hashes at most
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["template"]) for r in found.collect()})
    else:
        now = now.join(found, F.col("_host") == F.col("host"), "left").select(*columns, "template", "_html")

    def run(batches):
        for batch in batches:
            out, last = [], (None, _NONE)
            for at, body in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                body = body.as_py()
                if not body:
                    out.append("")
                    continue
                if small:
                    template = held.value.get(at.as_py())
                else:
                    if last[0] != at:  # rows of a host come one after another
                        last = at, frozenset(at.as_py() or ())
                    template = last[1]
                root = parse(body)
                if template:
                    hashed(root)
                out.append(main_text(root, template or _NONE))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=[*columns, "text"])
        settle_memory()

    schema = T.StructType([T.StructField(k, pages.schema[c].dataType) for c, k in zip(keep, columns)] + [T.StructField("text", T.StringType())])
    out = now.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(columns, keep)], "text")


def op2(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
