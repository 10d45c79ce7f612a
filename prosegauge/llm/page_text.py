"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their own paragraphs, less what is link
text. All vote, by their share of the page's score, for their generalised path (tags with
classes, digits and hash-like endings removed) and Spark sums the votes by host. Every page is
then extracted with the winning paths of its host: the one with most votes that the page has,
whatever scores best on the page itself. Ancestors of a path with more votes are no winners, as
they get a share of their children's votes. A page that has no winning path uses its own best
container. From there the text is widened to the outermost article or main around it, or else to
the highest ancestor below body that adds text which isn't mostly links; headings that stand
directly in body are kept.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out wherever they stand. Names tell them if all their words are such words or
usual additions; ids of headings and anchors, and of sections inside articles, tell nothing, as
they are often made from titles. A block's white space becomes single blanks; two
or more <br> in a row end a block. Null pages count as empty and give an empty text; pages
without a host share one. Repeated rows each give their text; rows without an id do so too. An
empty table gives no rows. Columns besides id, url and html don't matter.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import checkpointed, map_batches

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|[!?/][^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content isn't markup, without an end tag, of the text's inside, of its blocks.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr br ins del".split())
FORMAT = INLINE - {"a", "span", "label"}
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select textarea head title dialog menu object canvas audio video math".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element (left) ends when one of the others begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in class names and ids of what isn't the article, and what may stand beside them.
_NOISE = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adsense|banners?|promos?|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|footers?|headers?|masthead|topbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|"
    r"signup|login|popup|modal|overlay|widgets?|pagination|pager|toolbar|search|skip|copyright|taglist|tagslist|toc",
    re.I,
)
_BESIDE = re.compile(
    r"\w{0,2}|\w*\d\w*|site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|sticky|fixed|floating|mobile|desktop|box|bar|block|bloc|area|list|wrap|wrapper|container|inner|outer|section|"
    r"content|contents|post|posts|article|articles|story|stories|entry|news|blog|item|items|link|links|button|buttons|btn|icon|icons|form|field|input|panel|pane|unit|slot|zone|space|row|column|col|module|"
    r"component|group|holder|text|title|heading|message|msg|info|legal|privacy|policy|google|facebook|twitter|user|users|reader|readers|thread|feed|media|tags|tag|dropdown|toggle|trigger|drawer|tray|overview|"
    r"email|mail|sign|up|back|to|the|no|js|wp|widget|custom|dynamic|sponsored|display|leaderboard|skyscraper|rectangle|footer|header|more|also|popular|latest|recent|table|of|contents|results?|bottombar|home",
    re.I,
)
_WANTED = re.compile(r"(?:with|has|no|without)[-_].*|(?:article|post|entry|story|page|content)[-_]?(?:header|headline)|(?:.*[-_])?(?:header|nav)[-_](?:fixed|sticky|offset)", re.I)
_COMMENT = re.compile(r"(?:.*[-_])?(?:comments?|repl(?:y|ies)|disqus|respond)(?:[-_].*)?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BREAK = re.compile(r"\0(?:\s*\0)+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("html", "body", "main", "article"))
#: Share of its host's votes that a winning path has at least; so a host has ten at most.
LEAST_SHARE = 0.1
#: Host paths up to which the winners are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 100_000


class Node:
    """An element that can hold blocks: its generalised path, own text length and pieces."""

    __slots__ = ("tag", "path", "noise", "parts", "own", "links", "parent")

    def __init__(self, tag: str, path: str, noise: bool, parent: Node | None):
        self.tag, self.path, self.noise, self.parent = tag, path, noise, parent
        self.parts: list = []
        self.own = self.links = 0


def _general(name: str) -> str:
    """A class name without digits and hash-like endings."""
    name = re.sub(r"[-_]+[A-Za-z]*\d\w*$|__\w{4,}$", "", name)
    return re.sub(r"\d+", "", name).lower()


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _names_noise(name: str) -> bool:
    words = re.split(r"[-_ ]+", name)
    return any(_NOISE.fullmatch(w) for w in words) and all(_NOISE.fullmatch(w) or _BESIDE.fullmatch(w) for w in words)


def _is_noise(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    names = attributes.get("class", "").split()
    if tag not in HEADINGS and tag != "a" and not (tag == "section" and inside_article):
        names.append(attributes.get("id", ""))
    test = _COMMENT.fullmatch if tag in WHOLE else _names_noise
    if any(n and test(n) and not _WANTED.fullmatch(n) for n in names):
        return True
    if tag in WHOLE:
        return False
    return attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))


def parse(page: str) -> Node:
    """The page's tree; a part of a node is a text, a node, or None where a block ends."""
    page = page.replace("\0", " ")
    root = Node("#root", "", False, None)
    stack, at, links, articles = [root], 0, 0, 0
    low = None

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(piece)
            if not piece.isspace():
                n = len(piece)
                node = stack[-1]
                while node.tag in INLINE:
                    node = node.parent
                node.own += n
                if links:
                    node.links += n

    def close(depth: int) -> None:
        nonlocal links, articles
        while len(stack) > depth:
            node = stack.pop()
            links -= node.tag == "a"
            articles -= node.tag in ("article", "main")
            if node.tag not in INLINE:
                stack[-1].parts.append(None)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in FORMAT and tag != "br":
            continue
        if tag == "br":
            stack[-1].parts.append("\0")
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag in INLINE and stack[depth].tag not in INLINE:
                    break
            else:
                if tag == "p":
                    stack[-1].parts.append(None)
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag not in INLINE:
                    break
        if tag in VOID:
            if tag == "hr":
                stack[-1].parts.append(None)
            continue
        for depth in range(len(stack) - 1, 0, -1):
            if tag in ENDED_BY.get(stack[depth].tag, ()):
                close(depth)
                break
            if stack[depth].tag in ("ul", "ol", "table", "dl", "select", "div", "body"):
                break
        attributes = _attributes(m[3])
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
        parent = stack[-1]
        noise = parent.noise or _is_noise(tag, attributes, articles > 0)
        names = sorted({g for c in attributes.get("class", "").split() if (g := _general(c))})
        node = Node(tag, parent.path if tag in INLINE else f"{parent.path}/{'.'.join([tag, *names])}", noise, parent)
        if tag not in INLINE:
            parent.parts.append(None)
        parent.parts.append(node)
        stack.append(node)
        links += tag == "a"
        articles += tag in ("article", "main")
    return root


def _nodes(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]


def scores(root: Node) -> dict[str, float]:
    """Score of each generalised container path of the page, noise left out.

    A paragraph gives its text's length to the container it stands in and half to that one's
    parent; link text counts against; article and main count double.
    """
    out: dict[str, float] = {}
    for node in _nodes(root):
        if node.noise or not node.own or node.tag in INLINE:
            continue
        gain = max(0.0, node.own - 2.0 * node.links)
        holder = node.parent if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td", "dd", "dt") and node.parent is not None else node
        while holder.tag in INLINE:
            holder = holder.parent
        if holder.tag in ("ul", "ol", "dl", "tr", "blockquote") and holder.parent is not None:
            holder = holder.parent
        for k, share in enumerate((1.0, 0.5)):
            if holder is None:
                break
            out[holder.path] = out.get(holder.path, 0.0) + gain * share * (2.0 if holder.tag in ("article", "main") and not k else 1.0)
            holder = holder.parent
    return out


def best_paths(root: Node) -> list[tuple[str, float]]:
    """The page's container paths with their share of its score, best first."""
    found = scores(root)
    total = sum(found.values())
    return [(p, s / total) for p, s in sorted(found.items(), key=lambda x: (-x[1], x[0])) if s > 0]


def decisive(paths: list[str]) -> list[str]:
    """Of paths with most votes first, those that aren't ancestors of an earlier one."""
    out: list[str] = []
    for path in paths:
        if not any(p.startswith(path + "/") for p in out):
            out.append(path)
    return out


def widened(root: Node, path: str) -> set[int]:
    """Ids of the nodes that hold the whole article whose best container has that path (see above)."""
    nodes = [n for n in _nodes(root) if not n.noise and n.tag not in INLINE]
    sums = {id(n): max(0, n.own) - 2 * n.links for n in nodes}
    for n in reversed(nodes):
        up = n.parent
        while up is not None and up.tag in INLINE:
            up = up.parent
        if up is not None:
            sums[id(up)] += sums[id(n)]
    chosen = set()
    for n in nodes:
        if n.path != path:
            continue
        top, last = n, sums[id(n)]
        whole = n if n.tag in ("article", "main") else None
        up = n.parent
        while up is not None and up.tag not in ("html", "body", "#root"):
            if up.tag not in INLINE:
                if up.tag in ("article", "main"):
                    whole = up
                if sums[id(up)] > last:
                    top, last = up, sums[id(up)]
            up = up.parent
        chosen.add(id(whole or top))
    return chosen | {id(n) for n in nodes if n.tag in HEADINGS and n.parent.tag in ("html", "body", "#root")}


def text_under(root: Node, chosen: set[int]) -> str:
    """Text of the outermost of these elements: blocks joined by line feeds, in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            for part in _BREAK.split("".join(run)):
                words = html.unescape(part.replace("\0", " ")).split()
                if words:
                    blocks.append(" ".join(words))
            run.clear()

    todo: list[tuple] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if isinstance(item, Node):
            if item.noise:
                if item.tag not in INLINE:
                    todo.append((None, inside))
                continue
            within = inside or id(item) in chosen
            if within and not inside:
                flush()
            todo += [(x, within) for x in reversed(item.parts)]
        elif item is None:
            flush()
        elif inside:
            run.append(item)
    flush()
    return "\n".join(blocks)


def extract(page: str | None, winners: list[str] | None = None) -> str:
    """The page's main text by the first of its host's winning paths that it has, or by its own best path."""
    if not page:
        return ""
    root = parse(page)
    own = best_paths(root)
    has = {p for p, _ in own}
    for path in [p for p in decisive(winners or []) if p in has] + [p for p, _ in own[:1]]:
        said = text_under(root, widened(root, path))
        if said:
            return said
    return ""


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_column: str = "url", html_column: str = "html", least: float = LEAST_SHARE) -> DataFrame:
    """(host, paths): the paths with at least that share of their host's votes, best first."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            votes: dict[tuple[str, str], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, share in best_paths(parse(page or "")):
                    votes[host, path] = votes.get((host, path), 0.0) + share
            host, path = zip(*votes, strict=True) if votes else ((), ())
            return {"host": pa.array(host, pa.string()), "path": pa.array(path, pa.string()), "vote": pa.array(votes.values(), pa.float64())}

        return work

    rows = pages.select(_host(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))
    sums = map_batches(rows, make, "host string, path string, vote double").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
    sums = checkpointed(sums)
    total = sums.groupBy("host").agg(F.sum("vote").alias("total"))
    won = sums.join(total, "host").where(F.col("vote") >= least * F.col("total"))
    # at most 1 / least paths a host are left
    return won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("vote")).alias("v"), "path"))).alias("w")).select("host", F.col("w.path").alias("paths"))


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    winners = checkpointed(host_paths(pages, url_column, html_column))
    small = winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), _host(F.col(url_column)).alias("host"))
    rows = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("id", "url", "html", "paths")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            said = [extract(page, paths) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return {id_column: batch.column(0), "url": batch.column(1), "text": pa.array(said, pa.string()), "n_chars": pa.array([len(t) for t in said], pa.int64())}

        return work

    kind = pages.schema[id_column].dataType.simpleString()
    return map_batches(rows, make, f"{id_column} {kind}, url string, text string, n_chars long")
