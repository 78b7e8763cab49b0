"""Main text of web pages by site style trees.

The container elements of all pages of a host are merged by their path of tags, classes and ids. Over the pages of the host a
node has a presentation importance, the entropy of the ways its children are laid out, and a content importance, one minus
how evenly its content spreads over the pages: what every page repeats tells nothing. A node's importance weighs both.
Elements that state their role are given it: article and main elements are important, and menus, headers, footers, asides,
forms and the like, or containers one of whose classes says nothing else, are not. Among the others, also those whose class
only contains such a word, branches of low importance are removed. A class never makes a body, a main element or a page's
article unimportant.

A page with an article (else a main element, else a container named as content) is its text; other pages are all their text
outside removed branches. Text is cut into blocks at block-level tags and line breaks.

Defined cases: a null or empty html has the empty text. Unclosed and stray tags are tolerated. Pages without a host form one
site. Repeated rows count as pages of their own. Other columns are not used, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import shipped, small_batches, stored

shipped(__name__)

#: Weight of content against presentation, least pages a node is judged on, and the importance below which it goes.
CONTENT_SHARE = 0.9
LEAST_PAGES = 3
LOW_IMPORTANCE = 0.2

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
#: Elements whose content is not text of the page.
OPAQUE = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select option button xmp noembed noframes datalist head".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
    """.split()
)
#: A start tag of the first kind ends an open element of the others.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
}
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot pre blockquote figure figcaption caption html body".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog header fieldset".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended share sharing social cookie
    cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search comment
    comments disqus reply replies respond responses discussion pagination pager copyright legal skip toolbar teaser outbrain
    taboola complementary contentinfo
    """.split()
)
CONTENT_WORDS = frozenset("article articlebody post entry story content main body".split())
WORD = re.compile("[a-z0-9]+")


#: Elements that hold a page's text whatever words their classes contain.
HOLDERS = frozenset("html body main article".split())


def _attributes(text: str) -> tuple[str, list[frozenset[str]], bool]:
    """A style key, the words of each class, id and role, and whether the element is hidden."""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)] if text else []
    names = " ".join(value for name, value in found if name in ("class", "id"))
    tokens = [frozenset(WORD.findall(token)) for token in " ".join(value for _, value in found).lower().split()]
    hidden = any(name == "hidden" for name, _ in found)
    return re.sub(r"\d{2,}", "0", names.lower()), tokens, hidden


def _role(tag: str, tokens: list[frozenset[str]], hidden: bool, inside: bool, nested: bool) -> tuple[str, bool]:
    """content, noise or unknown, and whether a class contains a noise word besides others.

    ``inside`` an article its own header is content; ``nested`` is an article in another, or in a container with such a class.
    """
    own_header = inside or any(token & {"article", "entry", "post", "story"} for token in tokens)
    noise_words = NOISE_WORDS - {"header"} if own_header else NOISE_WORDS
    noise = [token & noise_words for token in tokens]
    holder = tag in HOLDERS and not (tag == "article" and nested)
    whole = any(n and all(word in n or word.isdigit() for word in token) for n, token in zip(noise, tokens, strict=True))
    if hidden or (not holder and (whole or frozenset({"hidden"}) in tokens)):
        return "noise", False
    if tag in NOISE_TAGS and not (tag == "header" and own_header):
        return "noise", False
    if tag in ("article", "main") or any(token & CONTENT_WORDS and not n for n, token in zip(noise, tokens, strict=True)):
        return "content", False
    return "unknown", any(noise) and not holder


class _Open:
    __slots__ = ("children", "content", "doubted", "judged", "kind", "path", "region", "role", "tag", "weighed")

    def __init__(self, tag, path, role, kind, region, judged, weighed=True, doubted=False):
        self.tag, self.path, self.role, self.kind, self.region, self.judged = tag, path, role, kind, region, judged
        self.weighed, self.doubted = weighed, doubted
        self.children, self.content = [], xxhash.xxh64()


def read_page(html: str) -> tuple[list[tuple[str, int, list[int]]], list[tuple[int, int, int]]]:
    """Blocks (text, kind of region, judged nodes around it) outside noise, and nodes (path, layout, content)."""
    blocks: list[tuple[str, int, list[int]]] = []
    nodes: list[tuple[int, int, int]] = []
    root = _Open("", "", "unknown", 0, 0, ())
    stack, said, at, length = [root], [], 0, len(html)

    def flush() -> None:
        text = " ".join(markup.unescape("".join(said)).split())
        said.clear()
        if text:
            for element in stack:
                element.content.update(text)
            top = stack[-1]
            if top.role != "noise":
                blocks.append((text, top.region, list(top.judged)))

    def close() -> None:
        flush()
        done = stack.pop()
        if done.weighed:
            nodes.append((_hash(done.path), _hash(",".join(done.children)), done.content.intdigest() - 2**63))

    while at < length:
        match = TAG.search(html, at)
        if not match:
            said.append(html[at:])
            break
        said.append(html[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in BLOCK and any(element.tag == tag for element in stack):
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag in BLOCK:
                flush()
            continue
        if tag in OPAQUE:
            if tag in RAW or tag not in ("option", "head"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if not match[3].endswith("/"):
                    at = end.end() if end else (length if tag in RAW else at)
            continue
        if tag in ("br", "hr"):
            said.append(" ")
            continue
        if tag in VOID or tag not in BLOCK:
            continue
        if any(element.tag == "p" for element in stack):
            while stack[-1].tag != "p":
                close()
            close()
        for other in ENDS.get(tag, ()):
            # Only within the nearest list or table.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ("ul", "ol", "dl", "table", "menu"):
                    break
                if stack[depth].tag == other:
                    while len(stack) > depth:
                        close()
                    break
        flush()
        style, tokens, hidden = _attributes(match[3])
        above = stack[-1]
        role, doubted = _role(tag, tokens, hidden, above.region > 0, above.region == 3 or above.doubted)
        if above.role == "noise":
            role, doubted = "noise", False
        kind = 0
        if role == "content":
            kind = 3 if tag == "article" else 2 if tag == "main" or any("main" in token for token in tokens) else 1
        path = f"{above.path}/{tag}.{style}"
        judged = above.judged
        if role == "unknown" and (doubted or tag not in LEAF and (style or not above.region)):
            judged = (*judged, _hash(path))
        above.children.append(f"{tag}.{style}")
        stack.append(_Open(tag, path, role, kind, max(above.region, kind), judged, doubted or tag not in LEAF, doubted or above.doubted))
    while stack:
        close()
    best = max((region for _, region, _ in blocks), default=0)
    return [block for block in blocks if block[1] == best or (best and block[1] > best)], nodes


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


PAGE = (
    "row long, page_id long, url string, host string, blocks array<struct<text string, within array<long>>>, "
    "nodes array<struct<path long, layout long, content long>>, judged boolean"
)


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row, page_id, url, html in frame[["row", "page_id", "url", "html"]].itertuples(index=False, name=None):
            blocks, nodes = read_page(html or "")
            shown = [{"text": text, "within": within} for text, _, within in blocks]
            tree = [{"path": path, "layout": layout, "content": content} for path, layout, content in nodes]
            rows.append((row, page_id, url, host_of(url), shown, tree, any(within for _, _, within in blocks)))
        out = pd.DataFrame(rows, columns=["row", "page_id", "url", "host", "blocks", "nodes", "judged"])
        yield out.astype({"page_id": "Int64"})


def importance(read: DataFrame) -> DataFrame:
    """The style tree: host, path, pages, presentation, content, importance. A node on one page is fully important."""
    each = read.select("host", F.explode("nodes").alias("n")).select("host", "n.path", "n.layout", "n.content")

    def spread(what: str) -> DataFrame:
        """Per node the pages, and the sums of k log k over what k pages share and of log k over each kind of it."""
        shared = each.groupBy("host", "path", what).agg(F.count("*").alias("k"))
        return shared.groupBy("host", "path").agg(
            F.sum("k").alias("pages"), F.count("*").alias("kinds"),
            F.sum(F.col("k") * F.log("k")).alias("within"), F.sum(F.log("k")).alias("logs"),
        )

    layout = spread("layout").select("host", "path", "pages", F.col("within").alias("layout_within"))
    content = spread("content").select("host", "path", "kinds", "logs")
    several = F.col("pages") > 1
    log = F.log("pages")
    presentation = F.when(several, (log - F.col("layout_within") / F.col("pages")) / log).otherwise(1.0)
    told = F.when(several, 1 - F.col("logs") / F.col("kinds") / log).otherwise(1.0)
    tree = layout.join(content, ["host", "path"]).select("host", "path", "pages", presentation.alias("presentation"), told.alias("content"))
    return tree.withColumn("importance", F.greatest((1 - CONTENT_SHARE) * F.col("presentation") + CONTENT_SHARE * F.col("content"), F.lit(0.0)))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    own = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    )
    read = stored(own.mapInPandas(_read, PAGE))
    low = importance(read).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW_IMPORTANCE)).select("host", "path")

    plain = read.filter("not judged").select("page_id", "url", "blocks")
    open_pages = read.filter("judged")
    around = open_pages.select("row", "host", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["within"])))).alias("path"))
    removed = around.join(low, ["host", "path"]).groupBy("row").agg(F.collect_set("path").alias("removed"))
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["within"], F.col("removed")), F.lit(False)))
    # A page all of whose branches are low keeps its text: a site of copies has no more important part.
    judged = open_pages.join(removed, "row", "left").withColumn("kept", kept)
    judged = judged.select("page_id", "url", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("blocks")).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), " ")
    return plain.union(judged).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
