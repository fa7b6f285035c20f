"""Main text of web pages by composite text density.

Every element gets the characters and tags below it, in all and inside links. Its composite density
is its characters per tag, times a logarithm that grows with the characters and tags outside links
and whose base grows with the share of link text, on the page and in the element. An element's
density sum adds up the densities of its children; runs of its own text count as children. The
element of the largest sum is the core of the text.

If the core lies in an ``article`` or ``main`` element, the outermost one is the text; if the core holds
such elements, the one of the largest density sum is. Otherwise the core is, with its neighbours on the way up to the body whose density reaches the threshold, which is
the smallest density on that way; a neighbour that is a container must hold two blocks of text, as a
lone one beside the core is a notice. In either case parts go that links alone fill: blocks with two
links or more whose density is zero when link text is taken off.

Left out before anything is counted are elements that the HTML language defines as no main text:
navigation, menus, footers, asides, forms, dialogs, headers outside an article, articles inside an
article (readers' comments), scripts, styles and content that is not shown. No name in ``class``,
``id`` or ``role`` is looked at.

Defined results: a null or empty page gives the empty text. Character references are decoded; white
space inside a block becomes one space; blocks are joined in page order by an empty line. Broken
markup is read like a browser would: open paragraphs end at the next block, unknown end tags are
skipped, an unended comment or script takes the rest of the page. A page is read in one piece, in
memory of some ten times its size. Repeated rows give repeated results. An empty table gives an empty
result. Extra columns are not read and may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import small_batches

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes template textarea title svg object select canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left ends an open element on the right, unless one of the walls is between.
ENDS_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table body article main section div".split())

# Elements that are no main text by what the language says of them.
NO_TEXT_TAGS = frozenset("nav menu footer aside form dialog".split())
TEXT_ROOTS = frozenset({"article", "main"})
#: Neighbours of the core that need no second block in them to be text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")

def density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite density of an element."""
    if chars == 0:
        return 0.0
    tags, link_tags, plain, link_chars = max(tags, 1), max(link_tags, 1), max(chars - link_chars, 1), max(link_chars, 1)
    base = math.log(chars / plain * link_chars + page_share * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / link_chars * tags / link_tags)) / math.log(base)


class Page:
    """Elements in page order with their counts, and the page's text runs and block ends."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends = ["html"], [-1], [0]
        self.skipped, self.link = [False], [False]
        self.runs: list[tuple[int, str | None]] = []  # element and text; None ends a block
        self._read(source)

    def _open(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(0)
        self.link.append(self.link[parent] or tag == "a")
        self.skipped.append(self.skipped[parent] or tag in NO_TEXT_TAGS or (tag in ("header", "article") and self._is_apart(tag, parent)))
        return len(self.tags) - 1

    def _is_apart(self, tag: str, node: int) -> bool:
        """A header is one of the page if no article or main is around it; an article is a comment if
        another article is."""
        around = TEXT_ROOTS if tag == "header" else {"article"}
        while node > 0:
            if self.tags[node] in around:
                return tag == "article"
            node = self.parents[node]
        return tag == "header"

    def _read(self, source: str) -> None:
        stack, at, n, runs = [0], 0, len(source), self.runs
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                runs.append((stack[-1], source[at:lt]))
            if lt == n:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(source, lt) or LOOSE_TAG.match(source, lt)
            if not m:
                if re.match(r"</?[a-zA-Z]", source[lt : lt + 3]):  # cut off inside a tag
                    break
                runs.append((stack[-1], "<"))
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(stack, tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
            elif tag in VOID:
                runs.append((stack[-1], None if tag == "hr" else " "))
            elif tag not in ("html", "head"):
                self._start(stack, tag)
        while stack:
            self.ends[stack.pop()] = len(self.tags)
        runs.append((0, None))

    def _start(self, stack: list[int], tag: str) -> None:
        if tag in BLOCKS:
            self._pop_to(stack, {"p"}, WALLS)
        if tag in ENDS_ITEM:
            self._pop_to(stack, ENDS_ITEM[tag], WALLS - ENDS_ITEM[tag])
        node = self._open(tag, stack[-1])
        stack.append(node)
        if tag in BLOCKS:
            self.runs.append((node, None))

    def _close(self, stack: list[int], tag: str) -> None:
        # An inline end tag reaches no further than the block around it.
        walls = WALLS if tag == "p" else frozenset() if tag in BLOCKS else BLOCKS
        self._pop_to(stack, {tag}, walls)

    def _pop_to(self, stack: list[int], tags: set[str], walls: frozenset[str] | set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                for node in stack[k:]:
                    self.ends[node] = len(self.tags)
                    if self.tags[node] in BLOCKS:
                        self.runs.append((node, None))
                del stack[k:]
                return
            if tag in walls:
                return

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density and density sum of each element."""
        count = len(self.tags)
        chars, tags, link_chars, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
        own = [0] * count
        for node, text in self.runs:
            if text and not self.skipped[node]:
                size = len(text.strip())
                own[node] += size
                chars[node] += size
                if self.link[node]:
                    link_chars[node] += size
        for node in range(count - 1, 0, -1):
            if self.skipped[node]:
                continue
            up = self.parents[node]
            chars[up] += chars[node]
            link_chars[up] += link_chars[node]
            tags[up] += tags[node] + 1
            link_tags[up] += link_tags[node] + (self.tags[node] == "a")
        page_share = link_chars[0] / max(1, chars[0])
        dense = [density(*x, page_share) for x in zip(chars, tags, link_chars, link_tags)]
        total = [density(own[k], 1, own[k] if self.link[k] else 0, 1, page_share) for k in range(count)]
        for node in range(1, count):
            if not self.skipped[node]:
                total[self.parents[node]] += dense[node]
        return dense, total

    def _drop_link_blocks(self) -> None:
        """Skips the largest blocks whose words are all in links, two or more."""
        count = len(self.tags)
        plain, links = [0] * count, [0] * count
        for node, text in self.runs:
            if text and not self.link[node] and not self.skipped[node]:
                plain[node] += sum(map(str.isalnum, text))
        for node in range(count - 1, 0, -1):
            if not self.skipped[node]:
                plain[self.parents[node]] += plain[node]
                links[self.parents[node]] += links[node] + (self.tags[node] == "a")
        for node in range(1, count):
            up = self.parents[node]
            self.skipped[node] = self.skipped[node] or self.skipped[up] or (self.tags[node] in BLOCKS and plain[node] == 0 and links[node] > 1)

    def _text_blocks(self) -> list[int]:
        """Blocks of text that start in each element."""
        found, open_ = [0] * len(self.tags), False
        for node, text in self.runs:
            if text is None:
                open_ = False
            elif text.strip() and not open_ and not self.skipped[node]:
                found[node], open_ = found[node] + 1, True
        for node in range(len(found) - 1, 0, -1):
            found[self.parents[node]] += found[node]
        return found

    def main_text(self) -> str:
        dense, total = self.densities()
        core = max(range(len(total)), key=lambda k: (total[k], -k))
        way = [core]
        while way[-1] > 0:
            way.append(self.parents[way[-1]])
        root = next((k for k in reversed(way) if self.tags[k] in TEXT_ROOTS), None)
        if root is None:  # the core may hold the article and what stands around it
            inside = [k for k in range(core, self.ends[core]) if self.tags[k] in TEXT_ROOTS and not self.skipped[k] and total[k] > 0]
            root = max(inside, key=lambda k: (total[k], -k), default=core)
        spans = [(root, self.ends[root])]
        threshold = min(dense[k] for k in way)
        if self.tags[root] not in TEXT_ROOTS and threshold > 0:
            blocks = self._text_blocks()
            for child, up in zip(way, way[1:]):
                node = up + 1
                while node < self.ends[up]:
                    kind = self.tags[node] in TEXT_BLOCKS or (self.tags[node] in BLOCKS and blocks[node] > 1)
                    if node != child and kind and not self.skipped[node] and dense[node] >= threshold:
                        spans.append((node, self.ends[node]))
                    node = self.ends[node]
        self._drop_link_blocks()
        return self._blocks(sorted(spans))

    def _blocks(self, spans: list[tuple[int, int]]) -> str:
        blocks, run = [], []
        for node, text in self.runs:
            if text is None:
                if run:
                    block = " ".join("".join(run).split())
                    if block:
                        blocks.append(block)
                    run = []
            elif not self.skipped[node] and any(a <= node < b for a, b in spans):
                run.append(html.unescape(text))
        if run and (block := " ".join("".join(run).split())):
            blocks.append(block)
        return "\n\n".join(blocks)


def main_text(source: str) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` for every row."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    small_batches(pages.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(scan, f"id {id_type}, url {url_type}, text string")
