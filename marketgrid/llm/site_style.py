"""Main text of HTML pages by a site style tree (operator 3)."""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import kind
from .common import Scratch, flat_map_rows, map_rows, read

#: Weight of structure against content, and the share of the site's best content node below which a node goes.
GAMMA, LEAST_SHARE = 0.9, 0.2
#: So many low nodes (some tens of MB) go to every task; more of them meet the pages by a shuffled join.
BROADCAST_NODES = 200_000

# Elements by what they do to the text around them.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "select", "dialog", "button", "fieldset", "head", "search", "label", "legend"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "banner", "alert", "popup", "modal", "overlay",
    "comment", "comments", "disqus", "reply", "replies", "respond", "newsletter", "subscribe", "signup", "login",
    "search", "form", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "masthead",
    "toolbar", "skip",
}
# What a menu's, advert's or notice's name may add without meaning something else.
PLAIN_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "col", "column", "container", "content", "group", "head", "holder", "icons",
    "inner", "item", "items", "left", "line", "link", "links", "list", "main", "message", "outer", "page", "panel", "post", "posts",
    "primary", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "tag", "thread", "title", "top", "unit", "wrap", "wrapper",
}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"""=\s*(["'])""")
# Names start at the beginning of a run of their characters, so no run is read twice.
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'])([^\s=/"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"']+)""")
_WORD = re.compile(r"[a-z]+")
#: Elements that set a part of an article apart even without a class; lists, tables and paragraphs are its text.
APART = {"div", "section", "header", "article", "details", "figure", "address", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Names of furniture that holds no articles of its own: around the page's article it is no more than a wrapper, as a form is.
FURNITURE = {"menu", "nav", "navbar", "navigation", "search", "banner", "skip", "toolbar", "share", "social", "form", "header"}
#: Elements that are the article; one of them inside a form or a named wrapper keeps the wrapper.
ARTICLES = ("article", "main")
# An element that ends an open one of its kind, and the elements beyond which it doesn't look.
_LIKE = {"li": {"li"}, "tr": {"tr"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_EDGES = {"ul", "ol", "menu", "table", "dl", "select", "tbody", "thead"}


def _named_noise(value: str, in_article: bool) -> bool:
    """Whether one of an attribute's names says menu, advert or the like, and nothing else: ``search-results-of-study`` doesn't."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip("\"'")).split():
        words = set(_WORD.findall(name.lower()))
        noise = words & NOISE_WORDS or not in_article and words & {"header"}
        if noise and words <= NOISE_WORDS | PLAIN_WORDS | {"header"}:
            return True
    return False


def _noisy(tag: str, attributes: str, in_article: bool) -> str:
    """Whether an element's presentation alone says that it is not the article: ``no``, ``yes``, or ``around`` if it may be a wrapper of it."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return "around" if tag == "form" and not in_article else "yes"
    if not attributes or attributes.isspace():
        return "no"
    if "hidden" in _ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split():
        return "yes"
    said = "no"
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _UNSEEN.search(value):
            return "yes"
        if name in ("class", "id"):
            if "hidden" in value.lower().split():
                return "yes"
            if tag in ("html", "body", *ARTICLES) and not in_article:
                continue
            if _named_noise(value, in_article):
                words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
                if in_article or words & NOISE_WORDS - FURNITURE or tag == "li":
                    return "yes"
                said = "around"
        elif name == "role" and value.lower() in NOISE_ROLES:
            return "yes"
    return said


def tags(source: str):
    """(start, end, closing, name, attributes) of each tag, comment (name None) or declaration; linear in the source.

    A quoted value may hold ``>``; a quote that is never closed is an ordinary character.
    """
    at, last = 0, source.rfind(">")
    while True:
        found = _OPENING.search(source, at)
        if found is None:
            return
        start, name = found.start(), found[2]
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, False, None, ""
        elif last < found.end() - 1:
            at = source.find("<!--", start)  # nothing but a comment can follow
            if at < 0:
                return
        elif name is None:
            at = source.find(">", start) + 1
            yield start, at, False, None, ""
        else:
            first = end = source.find(">", found.end())
            look = found.end()
            while (quote := _QUOTED.search(source, look, end)) is not None:
                look = source.find(quote[1], quote.end()) + 1
                end = source.find(">", look) if 0 < look <= last else -1
                if end < 0:
                    end = first
                    break
            at = end + 1
            yield start, at, bool(found[1]), name.lower(), source[found.end() : end]


class Page:
    """Blocks of a page in order, as (node, text, inside an article, in a noisy branch).

    A node is a place in the style tree, the path of element names with their classes from the root:
    ``keys`` has its digest, ``parents`` the node above, ``tags`` its element and ``apart`` whether
    it lies in an element, below the article's own, with a class or one of ``APART``.
    """

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.keys, self.parents, self.tags, self.apart = [0], [-1], [""], [False]
        self.children: dict[int, list[str]] = {}
        self.inside: set[int] = set()  # nodes in an article
        under, known = [False], {}
        # tag, node, in article, noisy (-1: yes, or the number of what may be a wrapper), number of the element
        stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, 0)]
        opened: dict[str, list[tuple[int, int]]] = {}  # places in the stack by tag, perhaps outdated ones above
        unclosed: set[str] = set()
        wrappers: set[int] = set()  # elements that looked like noise and hold the article
        text: list[str] = []
        source = source or ""
        at = number = 0
        muted, level, depth = "", 0, 0  # inline element whose text goes, blocks open around it, elements of its name in it

        def flush() -> None:
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if joined:
                    _, node, article, noisy, _ = stack[-1]
                    self.blocks.append((node, joined, article, noisy))

        def last_open(names: set[str]) -> int:
            """Place of the innermost open element of these names, 0 for none."""
            best = 0
            for name in names:
                places = opened.get(name, [])
                while places and (places[-1][0] >= len(stack) or stack[places[-1][0]][4] != places[-1][1]):
                    places.pop()
                if places:
                    best = max(best, places[-1][0])
            return best

        for start, end, closing, tag, attributes in tags(source):
            if start < at:
                continue  # in a raw element
            if not muted:
                text.append(source[at:start])
            at = end
            if tag is None:
                continue
            if muted and tag == muted:
                depth += -1 if closing else 1
                muted = muted if depth else ""
                continue
            if closing:
                if tag in BLOCKS:
                    flush()
                    if place := last_open({tag}):
                        del stack[place:]
                        muted = muted if len(stack) >= level else ""  # an inline element that is never closed ends with its block
                continue
            if tag in RAW:
                ending = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if ending is None:
                    unclosed.add(tag)
                at = ending.end() if ending else len(source) if tag in ("script", "style") else at
                continue
            if tag == "br":
                text.append(" ")
            if tag in VOID or tag not in BLOCKS:
                if tag == "hr":
                    flush()
                elif tag not in VOID and not muted and _noisy(tag, attributes, stack[-1][2]) != "no":
                    text.append(" ")
                    muted, level, depth = tag, len(stack), 1
                continue
            flush()
            # A block ends an open paragraph; a list item, cell or row ends the one before it.
            if stack[-1][0] == "p":
                stack.pop()
            if tag in _LIKE:
                place = last_open(_LIKE[tag])
                if place > last_open(_EDGES | {"tr"} if tag in ("td", "th") else _EDGES):
                    del stack[place:]
            _, parent, article, noisy, _ = stack[-1]
            number += 1
            if tag in ARTICLES and noisy > 0 and not muted:
                wrappers.add(noisy)
                noisy = 0
            if noisy >= 0:
                said = "yes" if muted else _noisy(tag, attributes, article)
                noisy = -1 if said == "yes" else noisy or (number if said == "around" else 0)
            name = tag
            if "class" in attributes:
                name += "." + next((v.strip("\"'") for n, v in _ATTRIBUTE.findall(attributes) if n.lower() == "class"), "")
            self.children.setdefault(parent, []).append(name)
            node = known.get((parent, name))
            if node is None:
                node = known[parent, name] = len(self.keys)
                self.keys.append(_digest(f"{self.keys[parent]}/{name}"))
                self.parents.append(parent)
                self.tags.append(tag)
                self.apart.append(under[parent] and (self.apart[parent] or "." in name or tag in APART))
                under.append(under[parent] or tag in ("article", "main"))
            article = article or tag in ARTICLES and not noisy
            if article:
                self.inside.add(node)
            opened.setdefault(tag, []).append((len(stack), number))
            stack.append((tag, node, article, noisy, number))
        if not muted:
            text.append(source[at:])
        flush()
        # Without an article, a form around the main heading is the page.
        if not self.inside:
            wrappers |= {b[3] for b in self.blocks if b[3] > 0 and self.tags[b[0]] == "h1"}
        self.blocks = [(node, joined, inside, noisy < 0 or noisy > 0 and noisy not in wrappers) for node, joined, inside, noisy in self.blocks]

    def article(self) -> str | None:
        """What copies of the page's article have in common, also edited ones: the longest block of its fullest node."""
        nodes: dict[int, list[str]] = {}
        for node, text, inside, noisy in self.blocks:
            if inside and not noisy:
                nodes.setdefault(node, []).append(text)
        return max(max(nodes.values(), key=lambda x: sum(map(len, x))), key=len) if nodes else None

    def text(self, low: set[int] | frozenset[int] = frozenset()) -> str:
        """Blocks outside low-importance branches and those that presentation rules name as noise.

        Outside articles a low node takes its branch with it.  In an article each node stands for
        itself, and only nodes in an element that is set apart can go.  The main heading stays, others
        stay with the text around them, and if no other text would be left, all stay.
        """
        branch = [False] * len(self.keys)
        for node in range(1, len(self.keys)):
            branch[node] = self.keys[node] in low or branch[self.parents[node]]
        kept = [b for b in self.blocks if not b[3] and (b[2] or not branch[b[0]])]
        gone = {b[0] for b in kept if b[2] and self.keys[b[0]] in low and self.apart[b[0]]}
        body = {b[0] for b in kept if b[2] and b[0] not in gone and self.tags[b[0]] not in HEADINGS}
        if gone and body:
            above: set[int] = set()  # nodes that hold kept text
            for node in body:
                while node >= 0 and node not in above:
                    above.add(node)
                    node = self.parents[node]
            kept = [
                b for b in kept
                if b[0] not in gone or self.tags[b[0]] == "h1" or self.tags[b[0]] in HEADINGS and self.parents[b[0]] in above
            ]
        return "\n".join(b[1] for b in kept)


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _digest(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63)


def style_nodes(frame: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, kind, digest, n, width) of the style tree: on how many pages of a host a node has a content or a structure.

    Kind 0 counts pages, 1 contents (blocks) and 2 structures (sequences of child elements).  Pages
    of equal text count once, and in an article so do the copies of it (:meth:`Page.article`), so
    copies don't make their article look like a template.
    """

    def make():
        def row(url, source):
            host, page = host_of(url), Page(source)
            whole = _digest("\n".join(f"{page.keys[p]}\t{t}" for p, t, _, _ in page.blocks))
            article = page.article()
            copy = whole if article is None else _digest(article)
            of = lambda p: (host, copy if p in page.inside else whole, page.keys[p])
            nodes = {b[0] for b in page.blocks} | set(page.children)
            out = [(*of(p), 0, 0, 0) for p in nodes]
            out += [(*of(p), 1, d, 0) for p, d in {(b[0], _digest(b[1])) for b in page.blocks}]
            out += [(*of(p), 2, _digest(" ".join(c)), len(set(c))) for p, c in page.children.items()]
            return out

        return row

    rows = flat_map_rows(
        frame, [url_col, html_col], "host string, page long, path long, kind int, digest long, width int", make
    )
    once = rows.groupBy("host", "path", "kind", "digest", "page").agg(F.max("width").alias("width"))
    return once.groupBy("host", "path", "kind", "digest").agg(F.count("*").alias("n"), F.max("width").alias("width"))


def low_nodes(nodes: DataFrame) -> DataFrame:
    """(host, path) whose importance is under ``LEAST_SHARE`` of the best content node's on that host.

    Content counts by how few pages share it, structure by the entropy of its variants (base: the
    pages with the node); a node on one page has importance 1.
    """
    n = F.col("n").cast("double")
    by_node = nodes.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.avg(F.when(F.col("kind") == 1, F.ln(n))).alias("shared"),
        F.sum(F.when(F.col("kind") == 2, n)).alias("variants"),
        F.sum(F.when(F.col("kind") == 2, n * F.ln(n))).alias("folded"),
        F.coalesce(F.avg(F.when(F.col("kind") == 2, F.col("width"))), F.lit(0.0)).alias("width"),
    )
    content = F.when(F.col("pages") <= 1, 1.0).otherwise(1 - F.col("shared") / F.ln("pages"))
    structure = F.when(F.col("pages") <= 1, 1.0).otherwise(
        F.coalesce((F.ln("variants") - F.col("folded") / F.col("variants")) / F.ln("pages"), F.lit(0.0))
    )
    weight = F.pow(F.lit(GAMMA), F.col("width"))
    scored = by_node.filter("shared IS NOT NULL").select(
        "host", "path", ((1 - weight) * structure + weight * content).alias("importance")
    )
    best = scored.groupBy("host").agg(F.max("importance").alias("best"))
    return scored.join(best, "host").filter(F.col("importance") < F.col("best") * LEAST_SHARE).select("host", "path")


def extract(frame: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of each page.

    Pages of one host are merged into a style tree by counting (host, node, content) and (host,
    node, structure), never by gathering a host.  Branches go whose importance is low on their host,
    also nodes in an article, and, as what differs from page to page is important to the tree, those
    whose element, role or name says menu, advert, reader comments and the like; what is left is the
    text, one line for each block.  Null html gives the empty text; a null url is a
    host of its own; repeated rows come out alike; an empty table gives no rows.
    """
    low = low_nodes(style_nodes(frame, url_col, html_col))
    by_host = low.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__low"))
    # Written first, so that the join below stands alone and Spark can split a host that has many pages.
    by_host = Scratch(frame.sparkSession).write(by_host, "low")
    n_low = by_host.agg(F.coalesce(F.sum(F.size("__low")), F.lit(0))).first()[0]
    if n_low <= BROADCAST_NODES:
        by_host = F.broadcast(by_host)
    joined = frame.select(id_col, url_col, html_col, _host(F.col(url_col)).alias("__of")).join(
        by_host, F.col("__of") == F.col("__host"), "left"
    )

    def make():
        def row(ident, url, source, paths):
            text = Page(source).text(set(paths or ()))
            return ident, url, text, len(text)

        return row

    ddl = f"{id_col} {kind(frame, id_col)}, {url_col} string, text string, n_chars long"
    return map_rows(joined, [id_col, url_col, html_col, "__low"], ddl, make, chunk=200)


def _host(url):
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.coalesce(F.regexp_extract(found, r"([^@]*)$", 1), F.lit("")))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
