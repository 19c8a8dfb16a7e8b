"""Main text of web pages from flat text blocks and a decision tree.

A page is read once as a flat sequence of text blocks.  A block is described by
its words and link density, by those of the blocks before and after it, and by
the kind of the element around it; a decision tree, trained on the small table
below, keeps or drops it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayside.llm.arrow import with_columns

#: What a block's place says: outside of the page's content element, inside it, in an element of page furniture; no hint in a page without content element.
INSIDE, UNKNOWN, OUTSIDE, FURNITURE = 1.0, 0.0, -0.5, -1.0

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "place"]
#: Labelled blocks: the features in this order, then 1 for main text.  Missing neighbours count as 0 words.
LABELLED = [
    # paragraphs of an article, long and short, between other paragraphs
    (120, 0.00, 95, 0.00, 80, 0.00, INSIDE, 1),
    (60, 0.05, 8, 0.00, 120, 0.00, INSIDE, 1),
    (14, 0.00, 60, 0.00, 22, 0.00, INSIDE, 1),
    (1, 0.00, 40, 0.00, 30, 0.00, INSIDE, 1),
    (2, 0.00, 3, 0.00, 1, 0.00, INSIDE, 1),
    (5, 0.00, 0, 0.00, 0, 0.00, INSIDE, 1),
    (1, 0.00, 0, 0.00, 12, 0.00, INSIDE, 1),
    (30, 0.40, 50, 0.00, 45, 0.10, INSIDE, 1),
    (9, 0.00, 1, 1.00, 80, 0.00, INSIDE, 1),
    (25, 0.00, 40, 0.00, 6, 0.00, INSIDE, 1),
    (4, 0.00, 70, 0.00, 8, 0.30, INSIDE, 1),
    (12, 0.00, 2, 0.00, 3, 0.00, INSIDE, 1),
    (3, 0.33, 2, 0.00, 2, 0.00, INSIDE, 1),
    (40, 0.90, 60, 0.00, 60, 0.00, INSIDE, 1),
    # headings of an article
    (8, 0.00, 7, 0.00, 130, 0.00, INSIDE, 1),
    (4, 0.00, 6, 1.00, 3, 0.00, INSIDE, 1),
    # short blocks before links, and lists of links, are text of the article, too
    (8, 0.00, 60, 0.00, 4, 1.00, INSIDE, 1),
    (3, 0.00, 40, 0.00, 2, 1.00, INSIDE, 1),
    (3, 1.00, 60, 0.00, 3, 1.00, INSIDE, 1),
    (2, 1.00, 2, 1.00, 2, 1.00, INSIDE, 1),
    (4, 1.00, 3, 1.00, 9, 0.00, INSIDE, 1),
    # a linked word that stands alone in running text
    (1, 1.00, 40, 0.00, 50, 0.00, INSIDE, 1),
    (3, 1.00, 25, 0.00, 30, 0.00, INSIDE, 1),
    # menus, adverts, footers, forms, notices and comments in elements that say so
    (1, 1.00, 1, 1.00, 1, 1.00, FURNITURE, 0),
    (2, 1.00, 0, 0.00, 1, 1.00, FURNITURE, 0),
    (7, 0.00, 1, 1.00, 9, 0.00, FURNITURE, 0),
    (45, 0.00, 2, 0.00, 70, 0.00, FURNITURE, 0),
    (150, 0.02, 60, 0.00, 90, 0.00, FURNITURE, 0),
    (12, 0.00, 80, 0.00, 0, 0.00, FURNITURE, 0),
    (30, 0.20, 100, 0.00, 4, 1.00, FURNITURE, 0),
    (3, 0.00, 90, 0.00, 60, 0.00, FURNITURE, 0),
    (60, 0.00, 0, 0.00, 0, 0.00, FURNITURE, 0),
    # text outside of the content element of a page that has one
    (10, 0.00, 1, 1.00, 8, 0.00, OUTSIDE, 0),
    (5, 0.60, 70, 0.00, 3, 1.00, OUTSIDE, 0),
    (35, 0.00, 60, 0.00, 5, 0.00, OUTSIDE, 0),
    (90, 0.00, 12, 0.00, 80, 0.00, OUTSIDE, 0),
    (1, 0.00, 0, 0.00, 7, 0.00, OUTSIDE, 0),
    (18, 1.00, 20, 1.00, 22, 1.00, OUTSIDE, 0),
    # pages without a content element: running text has words and few links, or stands among such text
    (80, 0.00, 60, 0.00, 75, 0.00, UNKNOWN, 1),
    (45, 0.10, 6, 0.00, 50, 0.00, UNKNOWN, 1),
    (25, 0.00, 8, 0.00, 30, 0.00, UNKNOWN, 1),
    (18, 0.00, 40, 0.00, 35, 0.05, UNKNOWN, 1),
    (22, 0.25, 60, 0.00, 3, 1.00, UNKNOWN, 1),
    (100, 0.00, 2, 1.00, 4, 1.00, UNKNOWN, 1),
    (30, 0.00, 0, 0.00, 0, 0.00, UNKNOWN, 1),
    (16, 0.00, 0, 0.00, 0, 0.00, UNKNOWN, 1),
    (6, 0.00, 50, 0.00, 60, 0.00, UNKNOWN, 1),
    (8, 0.00, 30, 0.00, 45, 0.00, UNKNOWN, 1),
    (2, 0.00, 70, 0.00, 55, 0.00, UNKNOWN, 1),
    (7, 0.00, 3, 1.00, 60, 0.00, UNKNOWN, 1),
    (5, 0.00, 4, 0.50, 90, 0.00, UNKNOWN, 1),
    # and furniture there: short blocks away from text, and blocks of links
    (1, 1.00, 0, 0.00, 1, 1.00, UNKNOWN, 0),
    (3, 1.00, 2, 1.00, 40, 0.00, UNKNOWN, 0),
    (2, 1.00, 70, 0.00, 3, 1.00, UNKNOWN, 0),
    (15, 0.90, 6, 1.00, 9, 0.80, UNKNOWN, 0),
    (40, 0.85, 20, 0.90, 30, 0.90, UNKNOWN, 0),
    (6, 0.00, 2, 1.00, 3, 1.00, UNKNOWN, 0),
    (4, 0.00, 0, 0.00, 2, 1.00, UNKNOWN, 0),
    (3, 0.00, 3, 0.00, 2, 0.00, UNKNOWN, 0),
    (9, 0.00, 4, 0.00, 5, 0.00, UNKNOWN, 0),
    (7, 0.30, 60, 0.00, 0, 0.00, UNKNOWN, 0),
    (5, 0.00, 80, 0.00, 2, 1.00, UNKNOWN, 0),
    (8, 0.00, 90, 0.00, 0, 0.00, UNKNOWN, 0),
    (10, 0.50, 5, 1.00, 6, 1.00, UNKNOWN, 0),
]

#: Elements that hold no text of the page: up to their end tag or the end of the page, and those that count only with an end tag.  What a head may hold is silent by itself.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for t in ("script", "style", "textarea", "title")}
_SILENT = {"noscript", "template", "svg", "math", "iframe", "object", "select", "button", "canvas", "audio", "video"}
_CONTENT_TAGS = {"article", "main"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_BLOCK_TAGS = {
    *_CONTENT_TAGS, *_FURNITURE_TAGS, "address", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose nesting is followed; the others do not change a block's place.
_NESTED = {*_CONTENT_TAGS, *_FURNITURE_TAGS, "header", "div", "section", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "p", "span", "h1", "h2", "h3", "td", "li"}
#: Words of class, id and role that mark furniture and content.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification overlay pagination popup promo promoted related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
_CONTENT_WORDS = frozenset("article articlebody content entry main maincontent post postbody story storybody".split())
#: Last parts of a name that say what holds the furniture named before, and parts that say a page has or lacks furniture.
_HOLDERS = _CONTENT_WORDS | set("area bar block body box button buttons container icons inner item items links list posts section slot unit wrap wrapper".split())
_MODIFIERS = frozenset("has hide hides no not with without".split())
#: Elements and words around other articles than the page's: an article in them is no main text.
_APART_TAGS = {"nav", "aside", "footer"}
_APART_WORDS = frozenset("comment comments discussion disqus related replies reply respond sponsored teaser".split())
#: Block elements that leave an open paragraph open.
_IN_PARAGRAPH = {"br", "body", "html"}
#: By closable element, the elements that may be open in it when it is closed without end tag; a paragraph holds no blocks.
_PASSED = {"p": {"span"}, "li": {"div", "p", "span"}, "td": _NESTED - {"table"}}
#: By element, the open element that it closes.
_CLOSES = {"li": "li", **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), "td")}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^<>]*>|<(?P<loose>/?[a-zA-Z][^<>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_UNQUOTED = re.compile(r"[\s\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _words(rest: str) -> tuple[set[str], set[str]]:
    """(furniture words, content words) of class, id and role.

    A furniture word is a whole name, its last part, or the part before a last
    part that only holds it; names that say a page has or lacks it do not count.
    """
    furniture: set[str] = set()
    content: set[str] = set()
    if "=" not in rest:
        return furniture, content
    for m in _NAMES.finditer(rest):
        for name in next(g for g in m.groups() if g is not None).split():
            parts = [w.lower() for w in _SPLIT.split(name) if w]
            if not parts:
                continue
            named = parts[-2] if len(parts) > 1 and parts[-1] in _HOLDERS else parts[-1]
            if named in _FURNITURE_WORDS and _MODIFIERS.isdisjoint(parts):
                furniture.add(named)
            elif not _MODIFIERS.isdisjoint(parts) or _FURNITURE_WORDS.isdisjoint(parts):
                content.update(_CONTENT_WORDS.intersection(parts))
    return furniture, content


def _hint(tag: str, rest: str, around: float, apart: bool) -> tuple[float, bool]:
    """The place of what stands in an element and whether an article in it is none of the page's, given both of the element."""
    if tag in _FURNITURE_TAGS or (tag == "header" and around != INSIDE):
        return FURNITURE, apart or tag in _APART_TAGS
    furniture, content = _words(rest)
    if tag in _CONTENT_TAGS:
        return (FURNITURE, True) if apart or furniture & (_APART_WORDS | {"ad"}) else (INSIDE, False)
    if furniture:
        return FURNITURE, apart or not furniture.isdisjoint(_APART_WORDS)
    if content and around != FURNITURE:
        return INSIDE, apart
    return around, apart


@dataclass
class Open:
    """An open element; ``closable`` has the depths of the open p, li and td that a tag in it may close."""

    tag: str
    place: float
    apart: bool
    closable: dict[str, int]


@dataclass
class Block:
    place: float
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, is end tag, attributes) of the page's tags in order; comments have no tag, silent elements are one token without tag."""
    found: list[tuple[int, int, str, bool, str]] = []
    open_at: dict[str, list[int]] = {}
    silent: dict[int, int] = {}
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag, rest = m["tag"], m["rest"] or ""
        ending = m["end"] == "/" or (m["loose"] or "").startswith("/")
        named = not rest or rest[0] in "/ \t\r\n\f"
        if m["loose"]:
            tag = re.split(r"[\s/>]", m["loose"].lstrip("/"), maxsplit=1)[0]
        tag = (tag or "").lower()
        drawn = tag == "title" and (open_at.get("svg") or open_at.get("math"))
        if named and tag in _RAW and not ending and not drawn:
            if not _closes_itself(rest):
                end = _RAW[tag].search(page, at)
                at = end.end() if end else len(page)
            tag = ""
        elif named and tag in _SILENT:
            if not ending:
                if _closes_itself(rest):
                    tag = ""
                else:
                    open_at.setdefault(tag, []).append(len(found))
            elif open_at.get(tag):
                silent[open_at[tag].pop()] = len(found)
        found.append((m.start(), at, tag, ending, rest))
    out, i = [], 0
    while i < len(found):
        last = silent.get(i, i)
        out.append(found[i] if last == i else (found[i][0], found[last][1], "", False, ""))
        i = last + 1
    return out


def _closes_itself(rest: str) -> bool:
    """Whether attributes end in a slash that is not part of an unquoted value."""
    return rest.endswith("/") and "=" not in _UNQUOTED.split(rest)[-1]


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """(text, words, linked words, place) of the page's text blocks in order."""
    done: list[tuple[str, int, int, float]] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()  # of the stack, so that a stray end tag costs nothing
    current = Block(UNKNOWN)
    in_link = False

    def close() -> None:
        nonlocal current
        text = " ".join(html.unescape("".join(current.parts)).split())
        if text:
            done.append((text, text.count(" ") + 1, len(html.unescape(" ".join(current.linked)).split()), current.place))
        current = Block(stack[-1].place if stack else UNKNOWN)

    def add(text: str) -> None:
        if text:
            current.parts.append(text)
            if in_link:
                current.linked.append(text)

    def imply(tag: str | None) -> None:
        """Closes the open ``tag`` whose end tag is left out."""
        if tag and stack and tag in stack[-1].closable:
            depth = stack[-1].closable[tag]
            opened.subtract(x.tag for x in stack[depth:])
            del stack[depth:]

    at = 0
    for start, end, tag, ending, rest in _tokens(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            in_link = not ending
            continue
        if tag in _BLOCK_TAGS:
            close()
            if not ending:
                imply(_CLOSES.get(tag))
                imply("p" if tag not in _IN_PARAGRAPH else None)
        if tag in _NESTED:
            if not ending:
                around = stack[-1] if stack else Open("", UNKNOWN, False, {})
                # a list item ends within its list, a cell within its table
                ends = {t: d for t, d in around.closable.items() if tag in _PASSED[t]} | ({tag: len(stack)} if tag in _PASSED else {})
                stack.append(Open(tag, *_hint(tag, rest, around.place, around.apart), ends))
                opened[tag] += 1
            elif opened[tag]:
                gone = ""
                while gone != tag:
                    gone = stack.pop().tag
                    opened[gone] -= 1
        if tag in _BLOCK_TAGS:
            current.place = stack[-1].place if stack else UNKNOWN
    add(page[at:])
    close()
    return done


def describe(found: list[tuple[str, int, int, float]]) -> np.ndarray:
    """The features of each block; in a page with a content element, what has no hint lies outside."""
    words = np.array([b[1] for b in found], dtype=float)
    links = np.array([b[2] for b in found], dtype=float) / np.maximum(words, 1)
    place = np.array([b[3] for b in found])
    if (place == INSIDE).any():
        place[place == UNKNOWN] = OUTSIDE
    before, after = (lambda x: np.concatenate(([0.0], x[:-1]))), (lambda x: np.concatenate((x[1:], [0.0])))
    return np.column_stack([words, np.minimum(links, 1), before(words), before(links), after(words), after(links), place])


class Tree:
    """A classification tree by Gini impurity; ties go to the earlier feature and the smaller threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.value = float(np.mean(y) >= 0.5) if len(y) else 0.0
        self.feature: int | None = None
        best = self._impurity(y) * len(y) - 1e-9
        if depth == 0 or best <= 0:
            return
        for j in range(x.shape[1]):
            levels = np.unique(x[:, j])
            for t in (levels[:-1] + levels[1:]) / 2:
                left = x[:, j] <= t
                if min(left.sum(), (~left).sum()) < least:
                    continue
                cost = self._impurity(y[left]) * left.sum() + self._impurity(y[~left]) * (~left).sum()
                if cost < best:
                    best, self.feature, self.threshold = cost, j, float(t)
        if self.feature is not None:
            left = x[:, self.feature] <= self.threshold
            self.low, self.high = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return float(2 * p * (1 - p))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.threshold
        out = np.empty(len(x))
        out[left], out[~left] = self.low(x[left]), self.high(x[~left])
        return out


def train(table: list[tuple] = LABELLED) -> Tree:
    rows = np.array(table, dtype=float)
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks of a page, joined by a space; empty for null, empty and blockless pages."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree(describe(found)) > 0.5
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, table: list[tuple] = LABELLED, drop: tuple[str, ...] = ("html",)) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, the main text of ``html`` and its code points.

    Columns of these names are replaced; each row is worked out on its own, so
    rows that repeat give equal results.
    """

    def make():
        tree = train(table)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return with_columns(pages, make, "text string, n_chars long", drop)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
