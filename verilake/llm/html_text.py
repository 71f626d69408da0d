"""Main text of web pages by composite text density.

For every node of a page the density is its characters per tag, adjusted by the share of
characters and tags inside links. The node whose children's densities add up to the
most is the core of the article; it is widened to the parents that add text without a
link, such as a heading beside the paragraphs. The smallest density on the way from the
core up to the body is the threshold: from every node at least as dense, the part of
the largest density sum is kept as well.

Density can't tell a dense advert or comment from a paragraph. So elements that a page
itself names as such are left out beforehand: those whose kind is never article text,
and those whose whole class, id or role consists of such names. A class that says more,
like "content with-sidebar", is no such name. A form or header that holds most of a
page's text is kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.llm.common import bounded_batches, table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)[^>]*>""",
    re.I | re.S,
)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end the block before them and begin one of their own.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no article text, and those that hold none unless most of the page is in them.
APART = frozenset("aside button dialog fieldset footer head label menu nav object select".split())
UNLESS_MOST = frozenset("form header".split())
#: Names that mark such an element, if its class, id or role has no other; and names of places that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
PLACES = frozenset("area bar block bottom box container inner item left list main outer right section top unit wrap wrapper".split())
#: What an opening element closes implicitly, and what such closing doesn't pass.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())


def _apart(tag: str, attrs: str) -> bool:
    if tag in APART:
        return True
    if attrs and tag not in ("body", "html"):
        for found in _CLASS.findall(attrs):
            parts = {*_PART.findall(found.lower())}
            if parts - PLACES and parts - PLACES <= MARKS:
                return True
    return False


class Page:
    """Nodes in page order with their parents, and the page's text as (node, text) with None for the end of a block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.apart = ["#page"], [-1], [False]
        self.events: list[tuple[int, str | None]] = []
        stack, at = [0], 0
        for token in _TOKEN.finditer(source):
            if token.start() > at:
                self.events.append((stack[-1], source[at : token.start()]))
            at = token.end()
            tag = token["tag"] or token["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                self.events.append((stack[-1], None))
            if token["end"] or token["end2"]:
                self._close(stack, tag)
            elif tag not in VOID:
                self._open(stack, tag, token["attrs"] or "")
        if at < len(source):
            self.events.append((stack[-1], source[at:]))

    def _close(self, stack: list[int], tag: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[depth]]
            if own == tag:
                del stack[depth:]
                return
            if own in FENCES and tag not in FENCES:
                return

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        closes = CLOSES.get(tag, {"p"} if tag in BLOCKS else ())
        for depth in range(len(stack) - 1, 0, -1) if closes else ():
            own = self.tags[stack[depth]]
            if own in closes or own == "p" and tag in BLOCKS:
                del stack[depth:]
            elif own in FENCES:
                break
        self.tags.append(tag)
        self.parents.append(stack[-1])
        self.apart.append(self.apart[stack[-1]] or _apart(tag, attrs))
        stack.append(len(self.tags) - 1)

    def _leave_out(self) -> None:
        """Set forms and headers apart that don't hold most of the text outside of links."""
        asked = [i for i, tag in enumerate(self.tags) if tag in UNLESS_MOST and not self.apart[i]]
        if not asked:
            return
        chars = [0] * len(self.tags)
        linked = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            linked[i] = linked[self.parents[i]] or self.tags[i] == "a"
        for node, text in self.events:
            if text and not self.apart[node] and not linked[node]:
                chars[node] += len("".join(text.split()))
        for i in range(len(self.tags) - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
        for i in asked:
            self.apart[i] = 2 * chars[i] < chars[0]
        for i in range(1, len(self.tags)):
            self.apart[i] = self.apart[i] or self.apart[self.parents[i]]

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """Density and sum of the children's densities of each node, and its characters inside links; 0 for what is left out."""
        n = len(self.tags)
        chars, links, inner, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parents[i]] or self.tags[i] == "a"
        for node, text in self.events:
            if text and not self.apart[node]:
                size = len("".join(text.split()))
                chars[node] += size
                links[node] += size * in_link[node]
        for i in range(n - 1, 0, -1):
            if not self.apart[i]:
                up = self.parents[i]
                chars[up] += chars[i]
                links[up] += links[i]
                inner[up] += inner[i] + 1
                anchors[up] += anchors[i] + (self.tags[i] == "a")
        body = self.body()
        share = links[body] / max(chars[body], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.apart[i]:
                c, t = chars[i], max(inner[i], 1)
                # The base of the logarithm grows with the links; without any it is e.
                base = math.log(links[i] * c / max(c - links[i], 1) + share * c + math.e)
                plain = c / max(links[i], 1) * t / max(anchors[i], 1)
                density[i] = c / t * math.log(max(plain, 1.0)) / math.log(max(base, 1.0) + 1)
        for i in range(1, n):
            sums[self.parents[i]] += density[i]
        for i in range(n):
            if not sums[i]:
                sums[i] = density[i] * 0.999  # a leaf counts for itself, just below its parent
        return density, sums, links

    def body(self) -> int:
        return next((i for i, tag in enumerate(self.tags) if tag == "body"), 0)

    def kept(self) -> list[bool]:
        """Whether each node belongs to the main text."""
        self._leave_out()
        n, body = len(self.tags), self.body()
        density, sums, links = self.densities()
        # The node of the largest sum in each subtree; the earlier node wins a tie.
        best = [*range(n)]
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            a, b = best[i], best[up]
            if not self.apart[i] and (sums[a], -a) > (sums[b], -b):
                best[up] = a
        core = best[body]
        threshold, at = density[core], core
        while at > 0 and at != body:  # the body's own density also counts what isn't article
            threshold = min(threshold, density[at])
            at = self.parents[at]
        while (up := self.parents[core]) > 0 and up != body and links[up] == links[core]:
            core = up  # what stands beside the core without a link, such as its heading, goes with it
        marked, visited = [False] * n, [False] * n
        marked[core] = visited[body] = True
        for i in range(body + 1, n):
            if visited[self.parents[i]] and not self.apart[i] and density[i] >= threshold:
                visited[i] = marked[best[i]] = True
        out = [False] * n
        for i in range(n):
            out[i] = not self.apart[i] and (marked[i] or i > 0 and out[self.parents[i]])
        return out


def main_text(source: str | None) -> str:
    """Blocks of the article, one a line, white space folded and character references decoded; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    kept, blocks, own = page.kept(), [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            if own:
                if block := " ".join(html.unescape("".join(own)).split()):
                    blocks.append(block)
                own = []
        elif kept[node]:
            own.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col="page_id", html_col="html", keep=("url",)) -> DataFrame:
    """id, the columns keep, text and n_chars of every page.

    Null and empty pages, and pages without article, have an empty text. Repeated rows
    stay; other columns are ignored.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [main_text(source) for source in batch]
            yield pd.DataFrame({"text": own, "n_chars": [len(t) for t in own]})

    bounded_batches(pages.sparkSession)
    made = F.pandas_udf(texts, "text string, n_chars long")
    return pages.select(id_col, *keep, made(html_col).alias("f")).select(id_col, *keep, "f.*")


def op2_html(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
