"""A page as nested elements, for the few lookups that need nesting. Runs inside tasks.

Elements and strings are kept in page order; an element knows the ranges of both that lie
in it, so walks and texts need no recursion however deep a page is nested. An element that
is never closed goes on to the end of the one around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = ("script", "style")
# Tags as most are written; all others, and those whose content is read in a way of its own, are left to the parser.
PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*)>')
PLAIN_ATTRS = re.compile(r' ([a-zA-Z][a-zA-Z0-9_-]*)="([^"&]*)"')
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
OWN_CONTENT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class Page:
    """Elements in page order, their places by tag, strings in page order, and which of those are not text."""

    __slots__ = ("elements", "places", "strings", "hidden")

    def __init__(self):
        self.elements, self.strings, self.hidden = [], [], []
        self.places: dict[str, list[int]] = {}


@lru_cache(maxsize=8192)
def _fits(pattern: str, value: str) -> bool:
    """Whether a class attribute, or one of its words, meets a pattern; pages of a shop share their classes."""
    return any(re.search(pattern, v) for v in {*value.split(), value} if v)


class Element:
    __slots__ = ("tag", "attrs", "parent", "page", "first", "last", "start", "end")

    def __init__(self, page: Page, tag: str, attrs=None, parent=None):
        self.page, self.tag, self.attrs, self.parent = page, tag, dict(attrs or ()), parent
        page.places.setdefault(tag, []).append(len(page.elements))
        page.elements.append(self)
        self.first, self.start = len(page.elements), len(page.strings)
        self.close()

    def close(self):
        self.last, self.end = len(self.page.elements), len(self.page.strings)

    def walk(self) -> list["Element"]:
        """All elements below this one, in page order."""
        return self.page.elements[self.first : self.last]

    def strings(self) -> list[str]:
        page = self.page
        return [page.strings[i] for i in range(self.start, self.end) if not page.hidden[i]]

    def text(self, sep: str = " ") -> str:
        return sep.join(s.strip() for s in self.strings() if s.strip())

    def tidy_text(self) -> str:
        return re.sub(r"\s+", " ", self.text()).strip()

    def has_class(self, pattern: str | None) -> bool:
        if pattern is None:
            return True
        value = self.attrs.get("class")
        return bool(value) and _fits(pattern, value)

    def tagged(self, tag: str) -> list["Element"]:
        """Elements of that tag below this one, in page order."""
        places = self.page.places.get(tag)
        if not places:
            return []
        elements = self.page.elements
        return [elements[i] for i in places[bisect_left(places, self.first) : bisect_left(places, self.last)]]

    def find_all(self, tag: str, class_pattern: str | None = None) -> list["Element"]:
        return [e for e in self.tagged(tag) if e.has_class(class_pattern)]

    def find(self, tag: str, class_pattern: str | None = None) -> "Element | None":
        return next((e for e in self.tagged(tag) if e.has_class(class_pattern)), None)

    def path(self, *steps: tuple[str, str | None]) -> "Element | None":
        """First element under the given ancestors, outermost first."""
        *outer, (tag, pattern) = steps
        for e in self.find_all(tag, pattern):
            up, left = e.parent, list(outer)
            while up is not None and up is not self and left:
                if up.tag == left[-1][0] and up.has_class(left[-1][1]):
                    left.pop()
                up = up.parent
            if not left:
                return e
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = [Element(self.page, "")]
        self.counts: dict[str, int] = {}

    def updatepos(self, i, j):
        """Line numbers are not asked for."""
        return j

    def parse_starttag(self, i):
        found = PLAIN_START.match(self.rawdata, i)
        if found is None or self.cdata_elem is not None:
            return super().parse_starttag(i)
        tag, attrs = found.groups()
        tag = tag.lower()
        if tag in OWN_CONTENT:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(n.lower(), v) for n, v in PLAIN_ATTRS.findall(attrs)] if attrs else ())
        return found.end()

    def parse_endtag(self, i):
        found = PLAIN_END.match(self.rawdata, i)
        if found is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(found.group(1).lower())
        return found.end()

    def handle_starttag(self, tag, attrs):
        e = Element(self.page, tag, attrs, self.open[-1])
        if tag not in VOID:
            self.open.append(e)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.counts.get(tag):  # an end without a start is nothing
            e = self.open.pop()
            e.close()
            self.counts[e.tag] -= 1
            if e.tag == tag:
                break

    def handle_data(self, data):
        self.page.strings.append(data)
        self.page.hidden.append(self.open[-1].tag in HIDDEN)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    for e in builder.open:
        e.close()
    return builder.open[0]
