"""Which selectors of a list match a page, answered in one walk over its tags.

Selectors know tags, classes, attributes (present, or holding a text), children
(``>``), descendants and comma lists.  The walk keeps the open elements only:
each step of a selector is a bit, an element knows the bits it fulfils and those
of all elements around it, so the cost is linear in the page's tags, however
deep they nest.  Comments, scripts and other raw text hold no elements; end tags
that may be left out are implied; stray end tags are passed over.  Elements that
a browser would move (text in tables, overlapping formatting) stay in place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of HTML
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW_TEXT = {"iframe", "noembed", "noframes", "script", "style", "textarea", "title", "xmp"}
#: A start tag ends the nearest open one of the first set, unless one of the second set is open inside of that.
IMPLIED_ENDS = {
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "li": ({"li"}, {"ol", "ul"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
}
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "dd", "details", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}

_PART = re.compile(r"(?P<tag>[A-Za-z][\w-]*)|\.(?P<name>[\w-]+)|\[(?P<attr>[\w-]+)(?:\*=(?P<quote>['\"])(?P<text>.*?)(?P=quote))?\]")


@dataclass(frozen=True)
class Step:
    """One element of a selector; ``child`` says how it hangs on the step before."""

    tag: str | None
    classes: frozenset[str]
    attrs: tuple[tuple[str, str | None], ...]
    child: bool = False

    @staticmethod
    def of(text: str, child: bool) -> Step:
        parts = list(_PART.finditer(text))
        if not parts or "".join(m.group() for m in parts) != text:
            raise ValueError(f"unsupported selector step {text!r}")
        tag = next((m["tag"].lower() for m in parts if m["tag"]), None)
        classes = frozenset(m["name"] for m in parts if m["name"])
        return Step(tag, classes, tuple((m["attr"].lower(), m["text"]) for m in parts if m["attr"]), child)

    def fits(self, attr: dict[str, str], classes: set[str]) -> bool:
        held = all(name in attr and (text is None or (text != "" and text in attr[name])) for name, text in self.attrs)
        return held and self.classes <= classes


def steps_of(selector: str) -> list[list[Step]]:
    """The alternatives of a selector, each a list of steps from the outside in."""
    found = []
    for alternative in selector.split(","):
        words = alternative.replace(">", " > ").split()
        if not words or words[0] == ">" or words[-1] == ">" or (">", ">") in zip(words, words[1:], strict=False):
            raise ValueError(f"unsupported selector {selector!r}")
        found.append([Step.of(w, i > 0 and words[i - 1] == ">") for i, w in enumerate(words) if w != ">"])
    return found


class SelectorList:
    """Labelled selectors, compiled to bits."""

    def __init__(self, selectors: list[tuple[str, str]]):
        self.labels = [label for label, _ in selectors]
        #: per tag (None: any) the steps as (bit, bit of the step before or 0, step, label that it completes or None)
        self.by_tag: dict[str | None, list[tuple[int, int, Step, int | None]]] = {}
        bit = 1
        for at, (_, selector) in enumerate(selectors):
            for steps in steps_of(selector):
                before = 0
                for i, step in enumerate(steps):
                    self.by_tag.setdefault(step.tag, []).append((bit, before, step, at if i == len(steps) - 1 else None))
                    before, bit = bit, bit << 1

    def missing(self, html: str | None) -> list[str]:
        """Labels whose selector matches nothing of the page; null counts as an empty page."""
        walk = _Walk(self)
        try:
            walk.feed(html or "")
            walk.close()
        except _AllFound:
            pass
        return [label for at, label in enumerate(self.labels) if at in walk.wanted]


class _AllFound(Exception):
    """Ends a walk that has nothing left to look for."""


class _Walk(HTMLParser):
    def __init__(self, selectors: SelectorList):
        super().__init__(convert_charrefs=True)
        self.steps = selectors.by_tag
        self.wanted = set(range(len(selectors.labels)))
        self.open: list[tuple[str, int, int]] = []  # tag, own bits, bits of it and all around it
        self.places: dict[str, list[int]] = {}  # where each tag is open

    def _last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop()[0]].pop()

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] in RAW_TEXT:
            return
        ended, within = IMPLIED_ENDS.get(tag, (set(), set()))
        at = self._last(ended)
        if at >= 0 and at > self._last(within):
            self._close(at)
        if tag in ENDS_PARAGRAPH:
            at = self._last({"p"})
            if at >= 0 and at > self._last({"button", "table"}):
                self._close(at)
        _, parent, around = self.open[-1] if self.open else ("", 0, 0)
        own = 0
        steps = self.steps.get(tag, []) + self.steps.get(None, [])
        if steps:
            attr = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
            classes = set(attr.get("class", "").split())
            for bit, before, step, label in steps:
                if (before == 0 or (parent if step.child else around) & before) and step.fits(attr, classes):
                    own |= bit
                    if label is not None:
                        self.wanted.discard(label)
            if not self.wanted:
                raise _AllFound
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, own, around | own))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] in RAW_TEXT and self.open[-1][0] != tag:
            return
        if self.places.get(tag):
            self._close(self.places[tag][-1])


def missing_labels(html: Column, key: Column, lists: dict[str, list[tuple[str, str]]]) -> Column:
    """Per page the labels without a match, of the list that ``key`` names; empty for a key without a list.

    One walk per page, in Arrow batches, whatever the number of lists.
    """
    compiled = {name: SelectorList(selectors) for name, selectors in lists.items()}

    @F.pandas_udf("array<string>")
    def judge(pages: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([compiled[k].missing(p) if k in compiled else [] for p, k in zip(pages, keys, strict=True)], dtype=object)

    # other pages need not be sent
    return judge(F.when(key.isin(*lists), html), key)
