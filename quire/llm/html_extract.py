"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree whose nodes are element paths (tag and classes). A node's
presentation importance is the entropy of the child sequences it occurs with, its content importance
the entropy of its texts, both relative to the pages of the host that have it. A node whose pages
nearly all look and read alike is template, and its branch is removed from each page, outside of articles and inside.
Pages with one and the same article count once, so an article that many pages repeat is no template.

Entropy can't tell a teaser or an advert that differs from page to page from an article. So elements that markup names as menus, headers,
footers, sidebars, notices, adverts, forms and comments go as well. A class or an id alone doesn't drop what holds the page's article or most
of its text. After ``UNBALANCED`` tags with an odd number of quotes a page's quotes are no longer looked at, so that an attribute with ``>`` in it ends
there. Inside ``article`` or ``main`` the tree decides on boxes and lists with a class of their own, not on plain paragraphs,
headings or words.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

#: Markup; the second alternative and LOOSE don't look at quotes.
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
LOOSE = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed applet button select input textarea dialog svg math canvas audio video noembed noframes title menu search datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name what is not the article.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond replies disqus share sharing social newsletter subscribe subscription signup login related recommended widget pagination pager".split())
OUTSIDE_NAMES = NAMES | frozenset("header masthead topbar toolbar search".split())
MIN_PAGES, LOW = 5, 0.3
#: Characters of a path above which its upper part is written as a hash: paths of any depth have a bounded length.
LONG_PATH = 120
#: Texts of a branch are a range of the page's; their hash comes from running ones, with this base and modulus.
_BASE, _MODULUS = 0x9E3779B97F4A7C15, (1 << 61) - 1
#: What the tree may take out of an article if it has a class.
BOXES = frozenset("div section ul ol dl table figure p blockquote details address pre".split())
#: After so many tags with unbalanced quotes the quotes of a page are no longer looked at, which bounds the work on it.
UNBALANCED = 50


class Node:
    __slots__ = ("tag", "key", "kids", "dropped", "main", "named")

    def __init__(self, tag: str, key: str, dropped: bool = False, main: int = 0, named: int = 0):
        """named: dropped by nothing but a name, 2 if all words of one are in NAMES, 1 if it is a word among others or a form."""
        self.tag, self.key, self.kids, self.dropped, self.main, self.named = tag, key, [], dropped, main, named


class _Open:
    """The open elements, with the places of each tag's, so that none has to be looked for."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Closes all from place ``i`` on."""
        for node in self.stack[i:]:
            self.at[node.tag].pop()
        del self.stack[i:]

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)


def parse(page: str | None) -> Node:
    """The tree of a page; texts are strings among a node's ``kids``. Stray and missing end tags are mended.

    The work grows with the page's length, whatever is nested or left open in it."""
    root = Node("html", "html")
    opened, at, page = _Open(root), 0, page or ""
    stack, size, token, unbalanced = opened.stack, len(page), TOKEN, 0
    while at < size:
        m = token.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if token is TOKEN and not m[2]:
            close, tag, attrs = m[4], m[5], m[6]
            unbalanced += bool(tag)
            if unbalanced > UNBALANCED:
                token = LOOSE
        else:
            close, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if i := opened.last((tag,)):
                opened.cut(i)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                opened.cut(1)
            continue
        if tag in ENDS_P and (i := opened.last("p")) > opened.last(("table", "td", "th", "button", "object")):
            opened.cut(i)
        if ends := SAME_ENDS.get(tag):
            scope = opened.last(SCOPE[tag])
            while (i := opened.last(ends)) > scope:
                opened.cut(i)
        node = _node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        opened.push(node)
    _mend(root)
    return root


def _node(tag: str, attrs: str, parent: Node) -> Node:
    dropped, key, main = tag in DROPPED and tag != "form", tag, {"main": 1, "article": 2}.get(tag, 0)
    inside, named = parent.main, int(tag == "form")
    if tag == "header" and not inside:
        dropped = True
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if name == "class":
                    key = f"{tag}.{'.'.join(sorted(value.split()))}"
                names = NAMES if inside else OUTSIDE_NAMES
                for token in value.split():
                    words = set(re.findall("[a-z]+", token))
                    if not words.isdisjoint(names):
                        named = max(named, 2 if words <= names else 1)
            elif name == "role":
                dropped |= value in ROLES
                main = max(main, {"main": 1, "article": 2}.get(value, 0))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                dropped = True
    return Node(tag, key, dropped or named > 0, max(main, inside), 0 if dropped else named)


def _main(node: Node) -> int:
    """2 if the page has an article, 1 if it has a main part, else 0."""
    todo, found = [node], 0
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node) and not k.dropped:
                found = max(found, k.main)
                todo.append(k)
    return found


def _mend(root: Node) -> None:
    """Takes back what a name alone drops and yet holds the page's article or main part, or most of its text.

    Without an article or main part outside of dropped elements, that is the outermost named element with the one that has the
    most text. Else it is one that a word among others names, with over half of the text of the article, or of the
    main part, or of the page if it has neither. If nothing is left, the named elements stay.
    """
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node) and (not k.dropped or k.named)]
    if not any(n.named for n in order):
        return
    size: dict[int, int] = {}
    holds: dict[int, int] = {}  # the most text of an article or main part in it
    for n in reversed(order):
        kids = [k for k in n.kids if isinstance(k, Node) and id(k) in size]
        size[id(n)] = sum(size[id(k)] for k in kids) + sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
        holds[id(n)] = max([size[id(n)] if n.main else 0, *(holds[id(k)] for k in kids)])
    while True:
        found, scope, outer, todo = _main(root), 0, [], [(root, False)]
        while todo:
            n, inside = todo.pop()
            if not inside and n.main >= found:
                inside = True
                scope += size[id(n)]
            for k in n.kids:
                if isinstance(k, Node) and id(k) in size:
                    if not k.dropped:
                        todo.append((k, inside))
                    elif k.named:
                        outer.append((k, inside))
        best = max((k for k, _ in outer), key=lambda k: holds[id(k)], default=None)
        if found or best is None or not holds[id(best)]:
            best = next((k for k, inside in outer if inside and k.named == 1 and 2 * size[id(k)] > scope), None)
        if best is None:
            break
        best.dropped, best.named = False, 0
    todo = [root]
    while todo:
        n = todo.pop()
        if any(isinstance(k, str) and not k.isspace() for k in n.kids):
            return
        todo += [k for k in n.kids if isinstance(k, Node) and not k.dropped]
    for n in order:
        if n.named:
            n.dropped = False


def below(path: str, node: Node) -> str:
    """The path of a node under ``path``, however deep."""
    own = f"{path}/{node.key}"
    return own if len(own) <= LONG_PATH else f"#{xxhash.xxh3_64_hexdigest(path)}/{node.key}"


def blocks(root: Node, low: frozenset[str] | None = None) -> list[str]:
    """The texts of the page's blocks that stay: all outside of dropped elements and of the branches ``low``, unless these are all
    that the page has. In ``article`` or ``main``, only boxes with a class are branches.

    low: the host's template branches. None: of a page alone, without a style tree, only ``article`` if there is one, else ``main``."""
    least, out, text = 0 if low is not None else _main(root), [], []

    def flush():
        if text:
            s = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if s:
                out.append(s)

    todo: list = [(root, "", False, False, False)]
    while todo:
        node, path, closing, gone, inside = todo.pop()  # inside: of article or main
        if closing:
            flush()
            continue
        if isinstance(node, str):
            text.append(node)
            continue
        if node.tag == "br":
            text.append(" ")
            continue
        block = node.tag in BLOCK
        if block:
            flush()
        if node.dropped:
            continue
        own = below(path, node)
        template = bool(low) and own in low and node is not root
        if node.main:
            gone = inside and (gone or template and "." in node.key and node.tag in BOXES)
        else:
            gone = gone or template
        if block:
            todo.append((node, own, True, False, False))
        for k in reversed(node.kids):
            if isinstance(k, Node) or node.main >= least and not gone:
                todo.append((k, own, False, gone, node.main > 0))
    flush()
    return out if out or not low else blocks(root, frozenset())


def extract(page: str | None, low: frozenset[str] | None = None) -> str:
    return "\n".join(blocks(parse(page), low)) if page else ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_nodes(page: str | None) -> tuple[int, list[tuple[str, int, int]]]:
    """(hash of the page's article, [(path, hash of the child sequence, hash of the text)]) of a page, one row per path."""
    if not page:
        return 0, []
    seen: dict[str, list] = {}
    h = xxhash.xxh3_64_intdigest
    root, upto = parse(page), [0]  # running hash of the page's texts
    todo: list = [(root, "", None)]
    while todo:
        node, path, began = todo.pop()
        if isinstance(node, str):
            if flat := " ".join(node.split()):
                upto.append((upto[-1] * _BASE + h(flat)) % _MODULUS)
        elif began is not None:  # all of the branch has been seen
            texts = (upto[-1] - upto[began] * pow(_BASE, len(upto) - 1 - began, _MODULUS)) % _MODULUS
            style, body = seen.setdefault(path, [[], []])
            style.append(",".join(dict.fromkeys(k.key for k in node.kids if isinstance(k, Node) and k.tag not in ("br", "script", "style"))))
            body.append(f"{texts:x}")
        else:
            own = below(path, node)
            if node.tag not in VOID and node.tag in BLOCK:
                todo.append((node, own, len(upto) - 1))
            todo += [(k, own, None) for k in reversed(node.kids)]
    return h("\n".join(blocks(root))) >> 1, [(p, h("|".join(s)) >> 1, h("|".join(b)) >> 1) for p, (s, b) in seen.items()]


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, path, n_pages, presentation, content, importance): the merged trees of all hosts.

    With m pages that have the node, an importance is -sum p log p / log m over the distinct child
    sequences or texts, and 1 if m is 1. A node is as important as the greater of the two. Pages with the same article and the same
    child sequence or text of the node count once.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, p in zip(b.column("_host"), b.column("_html")):
                article, found = style_nodes(p.as_py())
                rows += [(u.as_py(), article, *n) for n in found]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["host", "article", "path", "style", "text"])

    n = pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html")).mapInArrow(nodes, "host string, article long, path string, style long, text long")
    # one pass: a row for the child sequence and one for the text, counted with combining before the shuffle
    both = n.select("host", "path", "article", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("text").alias("v")))).alias("x"))
    once = both.select("host", "path", "article", "x.kind", "x.v").distinct()
    c = once.groupBy("host", "path", "kind", "v").agg(F.count("*").alias("c"))
    t = c.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("cl"))
    entropy = F.when(F.col("m") == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("cl") / (F.col("m") * F.log(F.col("m").cast("double")))))
    by = t.select("host", "path", "kind", "m", entropy.alias("h")).groupBy("host", "path")
    return by.agg(F.max("m").alias("n_pages"), F.max(F.when(F.col("kind") == 0, F.col("h"))).alias("presentation"), F.max(F.when(F.col("kind") == 1, F.col("h"))).alias("content")).withColumn("importance", F.greatest("presentation", "content"))


def report(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW, key: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 4 << 20) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has an empty text; a null url is a host of its own; the work on a page grows with its length; repeated pages are treated
    alike; other columns are not looked at; an empty table gives no rows. A branch goes as template only where at least
    ``min_pages`` pages with different articles have its node and its importance is below ``low``. Up to ``broadcast_bytes`` of branches
    of all hosts are sent to the executors; more are joined with each page's own.
    """
    template = shared.written(style_tree(pages, url_col, html_col).filter((F.col("importance") < low) & (F.col("n_pages") >= min_pages)).select("host", "path"), "template")
    host = host_of(F.col(url_col))
    p = pages.select(F.col(key).alias("_key"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("host"))
    key_type = pages.schema[key].dataType
    sent = None
    if template.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 60), F.lit(0))).first()[0] <= broadcast_bytes:
        by_host: dict[str, set[str]] = {}
        for r in template.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["path"])
        sent = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
        p = p.withColumn("low", F.lit(None).cast("array<string>"))
    else:

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(h.as_py(), i.as_py(), n[0]) for h, i, x in zip(b.column("host"), b.column("_id"), b.column("_html")) for n in style_nodes(x.as_py())[1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.string(), pa.string()))], names=["host", "_id", "path"])

        # pages of one host and content have the same branches
        p = p.withColumn("_id", F.sha2(F.coalesce("_html", F.lit("")), 256))
        own = p.select("host", "_id", "_html").mapInArrow(nodes, "host string, _id string, path string").join(template, ["host", "path"])
        own = shared.written(own.groupBy("host", "_id").agg(F.collect_set("path").alias("low")), "page-templates")
        p = p.join(own, ["host", "_id"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows = (frozenset(x.as_py() or ()) for x in b.column("low")) if sent is None else (sent.value.get(x.as_py(), frozenset()) for x in b.column("host"))
            out = [extract(h.as_py(), x) for h, x in zip(b.column("_html"), lows)]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[key, "url", "text", "n_chars"])

    return p.select("_key", "_url", "_html", "host", "low").mapInArrow(texts, f"`{key}` {key_type.simpleString()}, url string, text string, n_chars long")
