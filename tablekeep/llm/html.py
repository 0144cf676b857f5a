"""Main text of web pages by composite text density.

Each page becomes a small tree of its block elements. Every node gets the characters per tag of its
subtree, adjusted for link text; a node's density sum adds up its children's densities. The node
with the largest sum holds the content; the smallest density on the way from it up to the body is
the threshold above which other parts of the page are searched in the same way.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.words import slices, take

# Element names by their role in HTML, and names that mark page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "script style head title noscript template nav footer aside button select option textarea iframe object embed svg math canvas "
    "audio video menu dialog input label".split()
)
MARKED = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar comment comments "
    "disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget "
    "skip disclaimer".split()
)
KEPT_WHOLE = {"html", "body", "main", "article", "h1"}  # never dropped for a name
# What the measures must say of a subtree that a part of a name marks, to drop it: link share from, characters below, characters a tag below (of the page's).
LINKED, FEW, SPARSE = 1 / 3, 80, 0.5
NO, HINT, NAMED, CERTAIN = range(4)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# An implied end tag does not reach beyond these.
SCOPES = set("html body article section div main table ul ol dl td th aside nav form blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    # Attributes: quoted values whole, a lone quote only where no closing one follows; nothing is read twice. A tag
    # that has no end this way ends at the next angle bracket.
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+(?=>|\Z)|[^<>]*+)(?:>|\Z|(?=<))""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def furniture(tag: str, attributes: str, in_article: bool) -> int:
    """CERTAIN for elements that are not content, by tag or hidden; NAMED for forms and for whole names that
    mark furniture, HINT for parts of names ("has-header"): candidates that the measures decide on."""
    if tag in DROPPED or tag == "header" and not in_article:
        return CERTAIN
    if not attributes or tag in KEPT_WHOLE:
        return NAMED if tag == "form" else NO
    found = NAMED if tag == "form" else NO
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return CERTAIN
        if name in ("class", "id", "role"):
            if MARKED.intersection(value.split()):
                found = NAMED
            elif MARKED.intersection(re.split(r"[^a-z]+", value)):
                found = max(found, HINT)
    return found


class Page:
    """Block elements of a page in page order, without furniture, and the text between them."""

    def __init__(self, source: str):
        self.parent, self.tags, self.links, self.chars, self.link_chars = [-1], [0], [0], [0], [0]
        self.body = 0
        self.marked: dict[int, int] = {}  # candidates: HINT or NAMED by node
        self.titles: list[int] = []  # nodes of h1
        self.texts: list[tuple[int, str]] = []  # (node, text of one block)
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []  # (tag, its node or the one around it)
        self.inside: Counter = Counter()  # open elements by tag
        self.skipping = 0  # open elements when a dropped one began, else 0
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[3]:
                (self.end if m[2] else self.start)(m[3].lower(), m[4])
        if at < len(source):
            self.text(source[at:])
        self.flush()
        self.drop_furniture()

    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def text(self, raw: str) -> None:
        if not self.skipping:
            text = html.unescape(raw)
            n = len("".join(text.split()))
            node = self.node()
            self.chars[node] += n
            if n and self.inside["a"]:
                self.link_chars[node] += n
            self.pieces.append(text)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.texts.append((self.node(), text))
            self.pieces = []

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.imply("p", {"p"})
        if tag in CLOSES:
            self.imply(tag, CLOSES[tag])
        if self.skipping:
            if tag not in VOID:
                self.push(tag, self.node())
            return
        block = tag in BLOCKS
        if block:
            self.flush()
        node = self.node()
        if tag == "br":
            self.pieces.append("\n")
        if tag in VOID:
            self.tags[node] += 1
            return
        mark = furniture(tag, attributes, self.inside["article"] + self.inside["main"] > 0)
        if mark == CERTAIN:
            self.flush()
            self.push(tag, node)
            self.skipping = len(self.open)
            return
        if block or mark:
            self.flush()
            self.parent.append(node)
            for column in (self.tags, self.links, self.chars, self.link_chars):
                column.append(0)
            node = len(self.parent) - 1
            self.tags[node] = 1
            self.links[node] = int(tag == "a")
            if tag == "body":
                self.body = node
            if tag == "h1":
                self.titles.append(node)
            if mark:
                self.marked[node] = mark
        else:
            self.tags[node] += 1
            self.links[node] += tag == "a"
        self.push(tag, node)

    def push(self, tag: str, node: int) -> None:
        self.open.append((tag, node))
        self.inside[tag] += 1

    def imply(self, tag: str, closed: set[str]) -> None:
        """End tags that a start tag implies: up to the innermost of ``closed`` within its scope."""
        if not any(self.inside[t] for t in closed):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in closed:
                return self.close(i)
            if self.open[i][0] in SCOPES:
                return None

    def end(self, tag: str, attributes: str) -> None:
        if not self.inside[tag]:
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self.close(i)
            if tag not in BLOCKS and self.open[i][0] in SCOPES:
                return None

    def close(self, keep: int) -> None:
        if not self.skipping and any(t in BLOCKS or n in self.marked for t, n in self.open[keep:]):
            self.flush()
        self.inside.subtract(t for t, _ in self.open[keep:])
        del self.open[keep:]
        if self.skipping > keep:
            self.skipping = 0

    def drop_furniture(self) -> None:
        """Takes the candidates out that are furniture: their counts and texts.

        A candidate stays if it holds the node of the largest density sum or most of the page's text, and is
        not mostly links; with a whole name only if it holds several blocks, or all the text there is. Otherwise a whole name is enough, and a part of a name where the subtree has no
        title and is short, mostly links or sparse.
        """
        if not self.marked:
            return
        n = len(self.parent)
        chars, links, tags = self.chars[:], self.link_chars[:], self.tags[:]
        for i in range(n - 1, 0, -1):
            for column in (chars, links, tags):
                column[self.parent[i]] += column[i]
        _, sums = self.density_sums()
        holds, titled = set(), set()
        top = max(range(n), key=sums.__getitem__)
        for nodes, above in (([top], holds), (self.titles, titled)):
            for node in nodes:
                while node >= 0 and node not in above:
                    above.add(node)
                    node = self.parent[node]
        inner = [0] * n  # nodes with text in each subtree
        for node in {node for node, _ in self.texts}:
            inner[node] = 1
        for i in range(n - 1, 0, -1):
            inner[self.parent[i]] += inner[i]
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]]
            if gone[i] or i not in self.marked:
                continue
            linked = links[i] >= LINKED * max(chars[i], 1)
            wraps = self.marked[i] == HINT or inner[i] > 1 or chars[i] == chars[0]
            if (i in holds or 2 * chars[i] > chars[0]) and not linked and wraps:
                continue
            sparse = chars[i] * tags[0] < SPARSE * chars[0] * tags[i]
            gone[i] = self.marked[i] == NAMED or i not in titled and (linked or sparse or chars[i] < FEW)
        for i in range(n):
            if gone[i]:
                self.chars[i] = self.link_chars[i] = self.tags[i] = self.links[i] = 0
        self.texts = [(node, text) for node, text in self.texts if not gone[node]]

    def density_sums(self) -> tuple[list[float], list[float]]:
        """(composite text density, density sum) of every node."""
        n = len(self.parent)
        chars, links = self.chars[:], self.link_chars[:]
        tags, link_tags = self.tags[:], self.links[:]
        for i in range(n - 1, 0, -1):
            for column in (chars, links, tags, link_tags):
                column[self.parent[i]] += column[i]
        ratio = links[self.body] / max(chars[self.body], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, t = chars[i], max(tags[i], 1)
            if c:
                lc, lt = max(links[i], 1), max(link_tags[i], 1)
                base = math.log(c / max(c - links[i], 1) * links[i] + ratio * c + math.e)
                density[i] = c / t * max(math.log(max(c * t / (lc * lt), 1.0)) / math.log(max(base, 1.0 + 1e-9)), 0.0) if base > 1 else c / t
            sums[i] = sums[i] or density[i]  # a leaf counts itself
            if i:
                sums[self.parent[i]] += density[i]
        return density, sums

    def content(self) -> list[str]:
        """Texts of the content blocks in page order."""
        density, sums = self.density_sums()
        children: list[list[int]] = [[] for _ in self.parent]
        best = list(range(len(self.parent)))  # node of the largest sum below each node
        for i in range(len(self.parent) - 1, 0, -1):
            p = self.parent[i]
            children[p].append(i)
            if sums[best[i]] > sums[best[p]] or sums[best[i]] == sums[best[p]] and best[p] != p:
                best[p] = best[i]
        at = best[self.body]
        threshold = density[at]
        while at != self.body and at > 0:
            at = self.parent[at]
            threshold = min(threshold, density[at])
        content, todo = set(), [self.body]
        while todo:
            node = todo.pop()
            if density[node] >= threshold:
                content.add(best[node])
                if best[node] != node:
                    todo += children[node]
        inside = [i in content for i in range(len(self.parent))]
        for i in range(1, len(self.parent)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return [text for node, text in self.texts if inside[node]]


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).content()) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text.

    text is the article's: blocks in page order joined by \\n, character references decoded, white
    space inside a block as one space. Menus, page headers, footers, sidebars, notices, adverts,
    forms, comments, scripts and styles are left out, by element; by class, id or role only where the
    measures agree, see ``Page.drop_furniture``.
    A null or empty page, or one without content, has the empty text. Cut or unbalanced markup is
    read as far as it goes. Repeated pages are extracted each; other columns are ignored; an empty
    table gives none. Page ids are bigint and may be null.
    """
    pages = take(pages, id_col, url_col, html_col).toDF("page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string")
