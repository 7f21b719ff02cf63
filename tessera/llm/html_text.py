"""Operator 3: main text of web pages from flat text blocks classified by a decision tree.

A page is read tag by tag into flat blocks of text: block-level tags part them, inline tags don't, and a
line break is white space.  Each block has its words and link density, those of its neighbours before and
after, and what its ancestors say (article, page furniture by element, role, class or id, heading, hidden).  Forms and hints of class or id
around an article or main element don't count in it, but for comments, teasers and advertisements around an article.
A decision tree, grown from the labelled blocks of TRAINING, says which blocks are main text.  Hints are weak: where with
them nothing of a page is main text, the blocks are judged again without them, but for those of comments, teasers and
advertisements.  Hidden and advertising elements inside a line of text are left out of it.

Defined results: a null, empty or text-free page gives an empty text and 0 characters.  Unclosed and
stray tags are tolerated; an incomplete tag at the end of a page is dropped.  Character references are
decoded; white space inside a block becomes one space, blocks are trimmed and joined by one line feed in
page order.  An option without end tag ends at the next one or with its parent; of other elements whose content is no text, a
script or style without end tag runs to the end of the page, others without one are empty.  A page of any length is read in time in
proportion to it, whole.  Rows are handled one by one; extra columns pass through, but for those named like the results.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import slices, small_batches

#: Tags inside a line of text; all other tags part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe object textarea select svg canvas audio video head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of a class or id that mark page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget related "
    "recommended recommendations teaser teasers comment comments commentlist reply replies respond discussion disqus nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager footer header masthead search toolbar skip legal copyright disclaimer".split()
)
#: Hints on what holds articles of their own, as readers' comments and teasers; other hints and forms around an article say
#: nothing about it.  A class such as has-sidebar names the state of a wrapper.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted related recommended "
    "recommendations teaser teasers comment comments commentlist reply replies respond discussion disqus".split()
)
#: Hints that leave words out of a line.
LINE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted".split())
#: Words that make a hint the name of what it found, as search-results.
FOUND = frozenset("result results".split())
_STATE = re.compile(r"(?:has|no|with|without)[-_]")
#: Where the text of an option ends: at its end tag, another option or its parent's end.
_OPTION_END = re.compile(r"</?(?:option|optgroup)\b|</([a-zA-Z][^\s/>]*)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_HEADING = re.compile(r"h[1-6]\Z")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "furniture", "heading", "header")


class Block:
    __slots__ = ("parts", "linked", "article", "furniture", "hard", "heading", "header", "text", "words", "density")

    def __init__(self, article: bool, furniture: bool, hard: bool, heading: bool, header: bool):
        self.parts: list[str] = []
        self.linked = 0
        #: hard: furniture by more than weak hints
        self.article, self.furniture, self.hard, self.heading, self.header = article, furniture, hard, heading, header


def _hints(value: str) -> set[str]:
    """Hints in a class or id."""
    found = set()
    for name in value.split():
        words = set(re.split(r"[^a-z]+", name))
        if not _STATE.match(name) and FOUND.isdisjoint(words):
            found |= words & HINTS
    return found


def _silent(attributes: str) -> bool:
    """Whether an element inside a line of text is hidden or an advertisement."""
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "") or name in ("class", "id") and not LINE.isdisjoint(_hints(value)):
            return True
    return False


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """Whether an element is an article, furniture, a heading, a header; whether it is furniture by hints or as a form only,
    and whether by those of PARTS."""
    article, furniture = tag in ("article", "main"), tag in FURNITURE and tag != "form"
    soft, part = tag == "form", False
    if attributes and tag not in ("html", "body"):
        for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                furniture = True
            elif name == "role":
                article, furniture = article or value in ("article", "main"), furniture or value in ROLES
            elif name in ("class", "id") and not article:
                hints = _hints(value)
                soft, part = soft or bool(hints), part or not PARTS.isdisjoint(hints)
    return article, furniture or soft, bool(_HEADING.match(tag)), tag == "header", soft and not furniture, part


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*(?:>|\Z)", re.I)


def blocks(html: str) -> list[Block]:
    """Flat text blocks in page order; those without text are left out."""
    out: list[Block] = []
    # tag; articles, furniture, headings, headers open, and of the furniture what an article, and what a main element, sets aside
    stack: list[tuple[str, int, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0, 0)]
    links, block, at, n = 0, None, 0, len(html)
    opened: Counter[str] = Counter()  # of each tag on the stack
    endless: set[str] = set()  # tags without an end tag from here on
    silent: list[str] = []  # tags of a line that are open since one that is left out

    def closed(i: int) -> None:
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def put(text: str) -> None:
        nonlocal block
        if silent:
            return
        if block is None:
            _, article, furniture, heading, header, loose, parts = stack[-1]
            block = Block(article > 0, furniture > 0, furniture > loose or parts > 0, heading > 0, header > 0)
            out.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(unescape(text).split())

    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            put(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in INLINE:
            if silent and tag not in VOID:
                if not closing:
                    silent.append(tag)
                elif tag in silent:
                    while silent.pop() != tag:
                        pass
            elif not closing and tag not in VOID and _silent(m[3] or m[6] or ""):
                silent.append(tag)
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br" and block is not None and not silent:
                block.parts.append(" ")
            continue
        block, links = None, 0
        silent.clear()
        if closing:
            if opened[tag] > 0:
                closed(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                end = None if tag in endless else _raw_end(tag).search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    endless.add(tag)
            continue
        if tag == "option":
            end = next((m for m in _OPTION_END.finditer(html, at) if not m[1] or m[1].lower() not in INLINE), None)
            at = end.start() if end else n
            continue
        if tag in VOID:
            continue
        if tag == "p" or _HEADING.match(tag):  # these don't nest
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or _HEADING.match(stack[i][0]):
                    closed(i)
                break
        _, article, furniture, heading, header, loose, parts = stack[-1]
        own = _marks(tag, m[3] or m[6] or "")
        if own[0] and not article and (tag == "main" or not parts):
            furniture, loose, parts = furniture - loose, 0, 0
        opened[tag] += 1
        stack.append((tag, article + own[0], furniture + own[1], heading + own[2], header + own[3], loose + own[4], parts + own[5]))
    kept = []
    for b in out:
        words = unescape("".join(b.parts)).split()
        if words:
            b.text, b.words, b.density = " ".join(words), len(words), min(1.0, b.linked / len(words))
            kept.append(b)
    return kept


def features(page: list[Block], hints: bool = True) -> list[tuple[float, ...]]:
    """FEATURES of each block; hints: whether weak ones make furniture."""
    rows = []
    for i, b in enumerate(page):
        before, after = page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None
        rows.append((
            b.words, b.density, before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0,
            float(b.article), float(b.furniture if hints else b.hard), float(b.heading), float(b.header),
        ))
    return rows


# Labelled blocks, invented: FEATURES, then 1 for main text.  Within an article that isn't furniture all text counts, however
# short; a header counts by its heading; without an article, long unlinked blocks and short ones between such do.
TRAINING = (
    (6, 1.0, 0, 0.0, 5, 1.0, 0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0, 0), (80, 0.0, 4, 0.0, 60, 0.0, 0, 1, 0, 0, 0),
    (9, 0.2, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (30, 0.1, 70, 0.0, 12, 0.0, 1, 1, 0, 0, 0), (5, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 0), (4, 0.0, 90, 0.0, 3, 0.0, 1, 1, 1, 0, 0),
    (150, 0.0, 3, 0.0, 2, 0.0, 1, 1, 0, 0, 0), (2, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 0, 0.0, 30, 0.0, 0, 1, 1, 0, 0), (45, 0.6, 20, 0.5, 10, 1.0, 0, 1, 0, 0, 0),
    (9, 0.0, 10, 0.0, 50, 0.0, 1, 0, 1, 0, 1), (60, 0.0, 9, 0.0, 55, 0.1, 1, 0, 0, 0, 1), (1, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 0, 1),
    (8, 1.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0, 1), (25, 0.3, 8, 1.0, 9, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 40, 0.0, 7, 0.3, 1, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 0, 1),
    (300, 0.0, 5, 0.0, 8, 0.2, 1, 0, 0, 0, 1), (6, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (14, 0.5, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 1), (5, 0.0, 3, 1.0, 40, 0.0, 1, 0, 0, 0, 1),
    (7, 0.0, 0, 0.0, 5, 0.0, 1, 0, 1, 1, 1), (4, 0.0, 6, 0.0, 3, 0.0, 1, 0, 1, 1, 1), (5, 0.2, 7, 0.0, 50, 0.0, 1, 0, 0, 1, 0), (3, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0, 1, 0),
    (3, 0.0, 0, 0.0, 6, 1.0, 0, 0, 1, 1, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 1, 0), (15, 0.1, 3, 0.0, 6, 1.0, 0, 0, 0, 1, 0), (22, 0.0, 2, 0.5, 40, 0.0, 0, 0, 0, 1, 0),
    (40, 0.0, 6, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (55, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 55, 0.1, 48, 0.0, 0, 0, 0, 0, 1), (90, 0.2, 12, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 45, 0.0, 70, 0.0, 0, 0, 1, 0, 1), (4, 0.0, 60, 0.0, 52, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 33, 0.1, 41, 0.0, 0, 0, 0, 0, 1),
    (4, 1.0, 6, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (2, 0.5, 8, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (20, 0.9, 15, 0.8, 12, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (8, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (9, 0.3, 70, 0.0, 3, 0.5, 0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 4, 1.0, 0, 0, 1, 0, 0),
    (6, 0.0, 40, 0.0, 4, 1.0, 1, 0, 0, 0, 1), (30, 0.1, 50, 0.0, 6, 1.0, 1, 0, 0, 0, 1), (2, 0.0, 9, 0.0, 2, 1.0, 1, 0, 0, 0, 1), (9, 1.0, 20, 0.0, 5, 0.8, 1, 0, 0, 0, 1),
    (12, 0.0, 3, 1.0, 3, 0.7, 1, 0, 1, 0, 1), (1, 1.0, 2, 1.0, 1, 1.0, 1, 0, 0, 0, 1), (20, 0.4, 1, 1.0, 2, 0.5, 1, 0, 0, 0, 1), (3, 0.7, 0, 0.0, 30, 0.5, 1, 0, 0, 0, 1),
    (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (120, 0.0, 5, 1.0, 3, 1.0, 0, 0, 0, 0, 1), (35, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (22, 0.1, 40, 0.0, 2, 0.9, 0, 0, 0, 0, 1), (17, 0.0, 25, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (14, 0.8, 5, 1.0, 6, 0.9, 0, 0, 0, 0, 0), (60, 0.9, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (30, 0.7, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 80, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (7, 0.0, 3, 0.3, 0, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 0),
)


class Tree:
    """A binary decision tree grown by Gini impurity; leaves hold the commoner label."""

    def __init__(self, rows, depth: int = 8):
        self.root = self._grown([tuple(map(float, r)) for r in rows], depth)

    @staticmethod
    def _impurity(rows) -> float:
        p = sum(r[-1] for r in rows) / len(rows)
        return 2 * p * (1 - p) * len(rows)

    def _grown(self, rows, depth: int):
        ones = sum(r[-1] for r in rows)
        if not depth or ones in (0, len(rows)):
            return int(2 * ones > len(rows))
        best = None
        for f in range(len(rows[0]) - 1):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                cut = (a + b) / 2
                low, high = [r for r in rows if r[f] < cut], [r for r in rows if r[f] >= cut]
                # equal gains: what the ancestors say first, then the block itself, then its neighbours
                key = (round(self._impurity(low) + self._impurity(high), 9), -(f >= 6), f, cut)
                if best is None or key < best[0]:
                    best = key, f, cut, low, high
        if best is None:
            return int(2 * ones > len(rows))
        _, f, cut, low, high = best
        return f, cut, self._grown(low, depth - 1), self._grown(high, depth - 1)

    def label(self, row) -> int:
        node = self.root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node


def main_text(html: str | None, tree: Tree) -> str:
    """Main text of a page."""
    if not html:
        return ""
    page = blocks(html)
    for hints in (True, False):
        kept = [b.text for b, row in zip(page, features(page, hints), strict=True) if tree.label(row)]
        if kept:
            break
    return "\n".join(kept)


def extract(pages: DataFrame, column: str = "html", training=TRAINING) -> DataFrame:
    """pages' columns but the html's, with text and n_chars (code points)."""
    small_batches(pages.sparkSession)
    tree = Tree(training)
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    keep = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])

    def run(batches):
        for part in slices(batches, column):
            texts = [main_text(h, tree) for h in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, column).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
