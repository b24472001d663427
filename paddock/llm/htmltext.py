"""Main text of web pages by paths that a host's pages agree on.

Every page is read once for its containers and votes for the path of the best one; votes are summed by host in Spark;
every page is read again and its text taken from the container at the host's winning path.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]+))?""")

WORD, HUMP = re.compile(r"[^\W_]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())  # their content has no tags
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article blockquote body center div dl fieldset figure form header main ol section table tbody td tr ul".split())
OUTSIDE = set("aside button canvas dialog footer form frameset head iframe input menu nav noscript object script search select style svg template textarea title math map audio video".split())
# opening one closes an open element of the set, unless one of the second set is between them
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
# Words of classes, ids and roles.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline-share comment comments complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion recommendations recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar trending widget alert disclaimer teaser".split()
)
CONTENT = set("article articlebody body content entry main post story text".split())
NEGATION = set("has no with without".split())
LOSS, HEADED, NAMED = 0.8, 1.3, 1.5  # score left one container further up; of one that holds a first heading; of articles


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


@lru_cache(4096)
def described(tag: str, rest: str) -> tuple[bool, str]:
    """Whether an element is no part of an article, by its attributes, and its step of a path."""
    found = attributes(rest)
    names = sorted({re.sub(r"\d+", "0", w) for w in found.get("class", "").lower().split()})
    return boilerplate(tag, found), ".".join([tag, *names])


def boilerplate(tag: str, found: dict[str, str]) -> bool:
    """Whether a name of an element (its classes, id and role) keeps it out of the article.

    A name of words of content only ("main-content") keeps the element in, whatever its other names; else one word of
    boilerplate is enough ("article-comments"), unless a negation stands before it ("no-sidebar"). "header" alone counts
    where no word of content is with it ("site-header", but not "entry-header").
    """
    if "hidden" in found:
        return True
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split()
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(set(WORD.findall(n.lower())) & {"comment", "comments", "teaser"} for n in names)
    out = False
    for name in names:
        words = WORD.findall(HUMP.sub("-", name).lower())
        if words and CONTENT.issuperset(words):
            return False
        out |= any(w in BOILERPLATE and not (k and words[k - 1] in NEGATION) for k, w in enumerate(words)) or "header" in words and CONTENT.isdisjoint(words)
    return out


class Page:
    """The blocks of a page and its containers: (parent, step of the path, first block, end, score, has a first heading, depth)."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.nodes: list[list] = []
        self.piece: list[str] = []
        self.open: list[tuple[str, int | None, bool]] = []  # tag, container, whether it is outside the article
        self.holders: list[int | None] = [None]  # the open containers
        self.inside: Counter = Counter()
        self.skipped = self.linked = self.link_chars = 0
        self.read(html)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            found = TAG.search(html, at)
            self.text(html[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if found[1]:
                self.close(tag)
            elif tag:
                self.start(tag, found[3])
                if tag in RAW:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else end
        while self.open:
            self.pop()
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.skipped:
            text = unescape(raw)
            self.piece.append(text)
            if self.linked:
                self.link_chars += len(text.strip())

    def flush(self) -> None:
        """End the block; its characters outside links count for the innermost container."""
        if not self.piece:
            return
        block = " ".join("".join(self.piece).split())
        self.piece.clear()
        if block:
            self.blocks.append(block)
            if (holder := self.holders[-1]) is not None:
                self.nodes[holder][4] += max(0, len(block) - self.link_chars)
        self.link_chars = 0

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.flush()
            if tag != "html" and self.inside["p"] and tag not in ("td", "th", "li", "dt", "dd", "tr", "tbody", "caption", "option", "head", "body"):
                self.closed({"p"}, {"td", "th", "button", "caption", "table"})
        elif tag == "br":
            self.piece.append(" ")
        if tag in CLOSES:
            self.closed(*CLOSES[tag])
        if tag in VOID:
            return
        named, step = described(tag, rest) if rest else (False, tag)
        out, node = named or tag in OUTSIDE or tag == "header" and not (self.inside["article"] or self.inside["main"]), None
        if tag in CONTAINER and not out and not self.skipped:
            parent = self.holders[-1]
            node = len(self.nodes)
            self.nodes.append([parent, step, len(self.blocks), 0, 0.0, False, len(self.holders)])
            self.holders.append(node)
        if tag == "h1" and not self.skipped and self.holders[-1] is not None:
            self.nodes[self.holders[-1]][5] = True
        self.open.append((tag, node, out))
        self.inside[tag] += 1
        self.skipped += out
        self.linked += tag == "a"

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.inside[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def closed(self, tags: set[str], bounds: set[str]) -> None:
        for tag, _, _ in reversed(self.open):
            if tag in tags:
                self.close(tag)
                return
            if tag in bounds:
                return

    def pop(self) -> None:
        tag, node, out = self.open[-1]
        if tag in BLOCK:
            self.flush()
        self.open.pop()
        self.inside[tag] -= 1
        self.skipped -= out
        self.linked -= tag == "a"
        if node is not None:
            self.holders.pop()
            self.nodes[node][3] = len(self.blocks)
            parent = self.nodes[node][0]
            if parent is not None:
                self.nodes[parent][4] += LOSS * self.nodes[node][4]
                self.nodes[parent][5] |= self.nodes[node][5]

    def path(self, node: int | None) -> str:
        steps = []
        while node is not None:
            steps.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return "/".join(reversed(steps))

    def best(self) -> int | None:
        """The container of the best score; of equal ones the outermost."""
        score = lambda n: n[4] * (HEADED if n[5] else 1) * (NAMED if n[1].split(".")[0] in ("article", "main") else 1)
        scores = [score(n) for n in self.nodes]
        top = max(scores, default=0)
        return scores.index(top) if top > 0 else None

    def at(self, path: str) -> list[int]:
        """The containers at a path, in page order; compared step by step from the last."""
        steps = path.split("/")
        out = []
        for k, node in enumerate(self.nodes):
            if node[6] != len(steps) or node[1] != steps[-1]:
                continue
            up, left = k, len(steps)
            while up is not None and left and self.nodes[up][1] == steps[left - 1]:
                up, left = self.nodes[up][0], left - 1
            if up is None and not left:
                out.append(k)
        return out

    def under(self, nodes: list[int]) -> str:
        return "\n".join(b for n in nodes for b in self.blocks[self.nodes[n][2] : self.nodes[n][3]])


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vote a page for the path of its best container, summed over the slice."""
    for batch in text_slices(batches, "html"):
        found: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            if (best := page.best()) is not None:
                found[host, page.path(best)] += 1
        hosts, paths = [k[0] for k in found], [k[1] for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(found.values()), pa.int64())], ["host", "path", "n"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text at the first of the host's paths that the page has; a page with none of them gives its own best container."""
    for batch in text_slices(batches, "html"):
        texts, paths = [], []
        for html, winners in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True):
            page = Page(html or "")
            nodes, path = [], None
            for path in winners or []:
                if nodes := page.at(path):
                    break
            else:
                best = page.best()
                nodes, path = ([], None) if best is None else ([best], page.path(best))
            texts.append(page.under(nodes))
            paths.append(path)
        columns = [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(paths, pa.string()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "path", "text"])


def host_of(url: Column) -> Column:
    """Host of a URL without user and port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(host, winners): the paths that a `share` of the host's voting pages chose at least, most votes first (ties: the smaller path).

    There are 1 / `share` of them a host at most.
    """
    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(votes, "host string, path string, n long")
    counted = written(cast.groupBy("host", "path").agg(F.sum("n").alias("n")), "votes")
    total = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(total, "host").where(F.col("n") >= share * F.col("total"))
    return won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).getField("path").alias("winners"))


def main_text(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(page_id, url, host, path, text) of every page: the main text and the path of the container that it is from.

    Blocks are joined by one newline, white space in a block is one space, character references are decoded. NULL and
    empty pages have an empty text and, unless the host's path fits, no path; a NULL url belongs to the empty host;
    repeated rows vote and come out again; an empty table gives an empty result; other columns are left out whatever
    their names. A long page is read whole by one task, tag by tag. Pages meet their host's paths in a join that Spark
    broadcasts while the written paths are small and else splits at hot hosts.
    """
    winners = written(host_paths(pages, share), "winners")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html").join(winners, "host", "left").select("page_id", "url", "host", "winners", "html")
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url string, host string, path string, text string")


def page_texts(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
