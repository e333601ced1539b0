"""HTML extraction with site style trees.

The DOMs of a host's pages, articles included, are merged into one tree of styles: a node is a path of tags with their
classes. Navigation, adverts, forms and the like have importance 0. The remaining nodes are judged by the entropy of their
contents over the different pages of the host: a node whose content is everywhere the same is template, one that differs
from page to page is content. Being in an article and the share of its text in links are factors of a block's importance.
Low branches are cut from each page; in an article a block goes by its own content only, so that a rare paragraph among
recurring ones stays. On hosts of few pages all blocks stay but those outside articles that are mostly links.
"""

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.helpers import hinted
from moneytrail.scratch import materialize, materialize_counted

#: Nodes below this importance go.
LEAST = 0.3
#: Different pages a host must have for entropy to tell anything.
MIN_PAGES = 5
#: Factor of the importance of a block in an article.
ARTICLE = 1.5
#: The same outside the articles of a page that has one.
OUTSIDE = 0.8
#: What a block wholly within links loses of its importance.
LINKED = 0.4
#: Importance, outside articles, of a node on fewer than MIN_PAGES pages: enough for text, too little for menus.
UNKNOWN = 0.4

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same kind ends.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CONTENT = {"article", "main"}
NOISE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "label", "object", "canvas", "video", "audio"} | RAW
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar", "form"}
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promos?|promotions?|cookies?|consent|gdpr|notices?|popups?|modals?|overlays?"
    r"|newsletters?|subscribe|subscription|sidebars?|menus?|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|replies|respond"
    r"|related|recommended|share|sharing|social|widgets?|pager|pagination|toolbars?|login|signup)(?:$|[\s_-])", re.I
)
#: Names that tell how a part is laid out, not what it is: a page that has a menu is none.
STATE_NAMES = re.compile(r"(?<!\S)(?:no|not|has|have|with|without|hide|show|is)[_-]\S*", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|topbar)(?:$|[\s_-])", re.I)


class Node:
    """An open element: its path of styles, whether it is cut, whether it is in an article, and its names."""

    __slots__ = ("tag", "path", "noise", "content")

    def __init__(self, tag: str, parent: "Node | None", attributes: dict[str, str]):
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        kinds = STATE_NAMES.sub("", names)
        style = re.sub(r"\d+", "0", ".".join(sorted(names.split())))
        self.tag = tag
        self.path = f"{parent.path if parent else ''}/{tag}{'.' + style if style else ''}"
        inside = bool(parent and parent.content)
        self.noise = bool(parent and parent.noise) or self._is_noise(tag, kinds, attributes, inside)
        self.content = inside or (tag in CONTENT and not self.noise)

    @staticmethod
    def _is_noise(tag: str, names: str, attributes: dict[str, str], inside: bool) -> bool:
        if tag in NOISE or (tag == "header" and not inside) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        if attributes.get("role", "").lower() in NOISE_ROLES or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
            return True
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return bool(COMMENT_NAMES.search(names))
        return bool(NOISE_NAMES.search(names) or (not inside and HEADER_NAMES.search(names)))


def blocks_of(page: str) -> list[tuple[str, bool, str, int]]:
    """(path, in an article, text, characters inside links) of every block that is not cut by its presentation, in page order.

    Markup may be broken: elements end where their parents do, paragraphs where a block starts.
    """
    out, stack, pieces, linked = [], [], [], 0
    at, end, links = 0, len(page), 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            node = stack[-1] if stack else None
            while node and node.tag not in BLOCKS and len(stack) > 1:
                node = next((n for n in reversed(stack) if n.tag in BLOCKS), None)
            out.append((node.path if node else "", bool(node and node.content), text, linked))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1].noise):
            text = html.unescape(raw)
            pieces.append(text)
            linked += len(text) if links else 0

    def close(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            if stack[-1].tag in BLOCKS:
                flush()
            links -= stack[-1].tag == "a"
            stack.pop()

    while at < end:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["close"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if place is not None and (tag in BLOCKS or not any(n.tag in BLOCKS for n in stack[place + 1:])):
                close(place)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        for i in range(len(stack) - 1, -1, -1):
            if tag in ENDED_BY.get(stack[i].tag, ()):
                close(i)
                break
            if stack[i].tag in ("div", "article", "main", "section", "table", "ul", "ol", "body") and stack[i].tag != tag:
                break
        if tag in VOID or found["rest"].endswith("/") and tag not in BLOCKS:
            continue
        attributes = {a.lower(): html.unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(found["rest"])}
        node = Node(tag, stack[-1] if stack else None, attributes)
        stack.append(node)
        links += tag == "a"
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = ending.end() if ending else end
            close(len(stack) - 1)
    close(0)
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def factor(inside: bool, article: bool, linked: float) -> float:
    """Factor of the importance of a block: in an article or not, on a page with one or not, by its share of characters in links."""
    return (ARTICLE if inside else OUTSIDE if article else 1.0) * (1 - LINKED * linked)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and the blocks of each page: codes of node and content, whether in an article, factor, text."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for page in batch["html"]:
                blocks = blocks_of(page or "")
                article = any(b[1] for b in blocks)
                found.append([
                    {"path": p, "article": a, "factor": factor(a, article, min(1.0, linked / len(t))), "text": t} for p, a, t, linked in blocks
                ])
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "host": batch["url"].map(host_of), "blocks": found})

    coded = F.transform("blocks", lambda b: F.struct(
        F.xxhash64(b["path"]).alias("node"), F.xxhash64(b["path"], b["text"]).alias("content"), b["article"].alias("article"),
        b["factor"].alias("factor"), b["text"].alias("text"),
    ))
    return pages.select("page_id", "url", "html").mapInPandas(
        rows, "page_id bigint, url string, host string, blocks array<struct<path:string,article:boolean,factor:double,text:string>>"
    ).withColumn("blocks", coded)


def low_branches(rows: DataFrame, least: float, min_pages: int) -> DataFrame:
    """For each host the nodes and contents whose importance is too low for a block that has them: array of (code, importance).

    A content on n of a node's N different pages has importance 1 - log n / log N; that of the node is the mean over its
    contents, which is their entropy over log N, or UNKNOWN on few pages. Pages with the same blocks count once. What is on
    few of the pages is not listed, so that a host's array is small.
    """
    page = F.xxhash64(F.transform("blocks", lambda b: b["content"]))
    outside = F.min(F.when(~F.col("article"), F.col("factor")))  # within an article only contents count
    # the page's code is made before its blocks become rows, or it would be made again for each of them
    coded = rows.select("host", page.alias("page"), "blocks")
    seen = coded.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.node", "b.content", "b.article", "b.factor")
    seen = seen.groupBy("host", "page", "node", "content").agg(outside.alias("outside"), F.min("factor").alias("factor"))
    contents = seen.groupBy("host", "node", "content").agg(F.count("*").alias("n"), F.min("outside").alias("outside"), F.min("factor").alias("factor"))
    shared = contents.groupBy("host", "node").agg(F.sum(F.col("n") * F.log("n")).alias("shared"), F.sum("n").alias("sum"), F.min("outside").alias("outside"))
    pages = seen.select("host", "node", "page").distinct().groupBy("host", "node").agg(F.count("*").alias("pages"))
    entropy = F.when(F.col("pages") >= min_pages, 1 - F.col("shared") / F.log("pages") / F.col("sum")).otherwise(UNKNOWN)
    matters = (F.col("pages") >= min_pages) | (F.col("outside") * UNKNOWN < least)
    nodes, many = materialize_counted(shared.join(pages, ["host", "node"]).where(matters).withColumn("importance", entropy), "style-nodes")
    low_nodes = nodes.where(F.col("outside") * F.col("importance") < least).select("host", F.col("node").alias("code"), "importance")
    known = nodes.where(F.col("pages") >= min_pages).select("host", "node", "pages")
    several = contents.where("n > 1").select("host", "node", "content", "n", "factor").join(hinted(known, many), ["host", "node"])
    low_contents = several.withColumn("importance", 1 - F.log("n") / F.log("pages")).where(F.col("factor") * F.col("importance") < least)
    low = low_nodes.unionByName(low_contents.select("host", F.col("content").alias("code"), "importance"))
    return low.groupBy("host").agg(F.collect_list(F.struct("code", "importance")).alias("low"))


def extract(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    ``pages`` has page_id, url and html; other columns are ignored. Blocks are joined in page order by one line feed, white
    space within a block is one space, character references are decoded. One row per input row; a null or empty html
    and a page without main text give an empty text; a null or broken url belongs to the host without a name.
    """
    rows = materialize(parsed(pages), "parsed-pages")
    low, hosts = materialize_counted(low_branches(rows, least, min_pages), "low-branches")

    def is_low(b: Column) -> Column:
        return F.exists("low", lambda x: (
            ((x["code"] == b["content"]) | (x["code"] == b["node"]) & ~b["article"]) & (b["factor"] * x["importance"] < least)
        ))

    stays = F.when(F.col("low").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~is_low(b)))
    text = rows.join(hinted(low, hosts), "host", "left").select("page_id", "url", F.array_join(F.transform(stays, lambda b: b["text"]), "\n").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
