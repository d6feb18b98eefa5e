"""A page's elements as they nest: one pass with a stack of open elements.

End tags close the innermost open element of their name and all within it; those of no open element do nothing; elements
that are still open end with the page. Only places are kept: an element's text is a range of the page's text, which is
written down once, each string without white space around it. So a page takes memory in proportion to its length, however
its links nest.

How elements nest follows from the sequence of tags alone. A page of plain tags and text only is cut up by one regular
expression, and what a sequence of tags says (`layout`) is kept, since pages of one source are mostly built alike. Every
other page goes through the library's parser; both give the same."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache, partial
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

#: Elements without content.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
#: Elements whose strings are no text.
SILENT = frozenset(["script", "style", "template"])
#: Elements whose content is no text, or is no plain markup in some version of the parser.
APART = SILENT | frozenset("iframe noembed noframes noscript plaintext textarea title xmp".split())
#: An end tag's name; a start tag's name, attributes and the slash that ends its element at once; the text up to the next tag.
#: What is neither is taken together with all that follows, as the last group.
PLAIN = re.compile(r"""(?s)<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9:_-]*=(?:"[^"&]*"|'[^'&]*'))*)[ \t\r\n]*(/?))>([^<]*)|(<.*)""")
ONLY_HREF = re.compile(r"""\s+href="([^"]*)"\s*""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Longer sequences of tags are not kept, nor more of them.
KEPT_TAGS = KEPT_LAYOUTS = 256
#: Pages of more tags go through the parser, which takes them one by one.
MOST_TAGS = 10_000
#: The texts around so many links are searched one by one; around more, what is found in the whole page is looked up.
FEW_LINKS = 50
YEAR, NUMBER = re.compile(r"\((\d{4})\)"), re.compile(r"Proposition\s+(\d+)")


class Nesting(HTMLParser):
    """text: all strings; links: [pos, href, start, end, start and end of what it stands in (None: the page)]. pos counts
    links and headers of the second and third level."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # name, start, end
        self.names: dict[str, int] = {}
        self.links: list[tuple[int, str | None, list, list | None]] = []
        self.pieces: list[str] = []
        self.size, self.pos, self.silent, self.said = 0, 0, 0, []

    def flush(self) -> None:
        if self.said:
            piece = "".join(self.said).strip()
            self.said = []
            if piece and not self.silent:
                self.pieces.append(piece)
                self.size += len(piece)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        own = [tag, self.size, None]
        if tag in ("a", "h2", "h3"):
            if tag == "a":
                href = {k: v or "" for k, v in attrs}.get("href")
                self.links.append((self.pos, href, own, self.open[-1] if self.open else None))
            self.pos += 1
        if tag in VOID:
            own[2] = self.size
            return
        self.open.append(own)
        self.names[tag] = self.names.get(tag, 0) + 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.names.get(tag):
            return
        while True:
            last = self.open.pop()
            last[2] = self.size
            self.names[last[0]] -= 1
            self.silent -= last[0] in SILENT
            if last[0] == tag:
                return

    def handle_data(self, data: str) -> None:
        self.said.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def finish(self) -> str:
        self.close()
        self.flush()
        for x in self.open:
            x[2] = self.size
        return "".join(self.pieces)


def layout(ended: tuple[str, ...], begun: tuple[str, ...], at_once: tuple[str, ...]) -> list[tuple[int, ...]] | None:
    """The links of a page of plain tags: (pos, start, end, start and end of what it stands in). A place n is before the n-th
    tag; 0 is the page's start, one more than there are tags its end. None: the page is not for this."""
    opened: list[list] = []  # name, start, end
    names: dict[str, int] = {}
    links: list[tuple[int, list, list]] = []
    end, pos = len(begun) + 1, 0
    page = ["", 0, end]
    for place, (closing, tag, slash) in enumerate(zip(ended, begun, at_once), 1):
        if tag:
            tag = tag.lower()
            if tag in APART:
                return None
            own = [tag, place, end]
            if tag in ("a", "h2", "h3"):
                if tag == "a":
                    links.append((pos, own, opened[-1] if opened else page))
                pos += 1
            if slash or tag in VOID:
                own[2] = place
            else:
                opened.append(own)
                names[tag] = names.get(tag, 0) + 1
        elif names.get(closing.lower()):
            while True:
                last = opened.pop()
                last[2] = place
                names[last[0]] -= 1
                if last[0] == closing.lower():
                    break
    return [(pos, *own[1:], *outer[1:]) for pos, own, outer in links]


kept_layout = lru_cache(KEPT_LAYOUTS)(layout)


def plain_links(html: str) -> tuple[str, list[tuple]] | None:
    """A page's text and its links as (pos, href, start, end, start and end of what it stands in); None: it is not plain."""
    if not 0 < html.count("<") <= MOST_TAGS:
        return None
    begin = html.find("<")
    tags = PLAIN.findall(html, begin)
    if tags[-1][5]:
        return None
    ended, begun, attributes, at_once, texts, _ = zip(*tags)
    links = (kept_layout if len(tags) <= KEPT_TAGS else layout)(ended, begun, at_once)
    if links is None:
        return None
    texts = (html[:begin], *texts)
    pieces = list(map(str.strip, map(unescape, texts) if "&" in html else texts))
    at = list(accumulate(map(len, pieces), initial=0))
    return "".join(pieces), [(pos, href_of(attributes[start - 1]), at[start], at[end], at[first], at[last]) for pos, start, end, first, last in links]


def href_of(attributes: str) -> str | None:
    if only := ONLY_HREF.fullmatch(attributes):
        return only[1]
    return {name.lower(): one or other for name, one, other in ATTRIBUTE.findall(attributes)}.get("href")


def nested_links(html: str) -> tuple[str, list[tuple]]:
    """The same of any page."""
    page = Nesting()
    page.feed(html)
    text = page.finish()
    return text, [(pos, href, *own[1:], *(outer[1:] if outer else (0, len(text)))) for pos, href, own, outer in page.links]


class Finder:
    """The first match of a pattern in ranges of a text."""

    def __init__(self, pattern: re.Pattern, text: str) -> None:
        self.pattern, self.text = pattern, text
        self.found = list(pattern.finditer(text))
        self.begins = [m.start() for m in self.found]

    def search(self, start: int, end: int) -> re.Match | None:
        i = bisect_left(self.begins, start)
        if i == len(self.found) or self.begins[i] >= end:
            return None
        if self.found[i].end() <= end:
            return self.found[i]
        return self.pattern.match(self.text, self.begins[i], end)  # what the range's end leaves of it


def repository_links(html: str, path: str, least_slashes: int, most: int) -> list[tuple]:
    """(pos, nth, href, title, year, number) of the first links to a path of some depth that have a text."""
    text, links = plain_links(html) or nested_links(html)
    if min(most, len(links)) <= FEW_LINKS:
        find_year, find_number = partial(YEAR.search, text), partial(NUMBER.search, text)
    else:
        find_year, find_number = Finder(YEAR, text).search, Finder(NUMBER, text).search
    out: list[tuple] = []
    for pos, href, start, end, first, last in links:
        if len(out) == most:
            break
        if href is None or path not in href or href.count("/") < least_slashes:
            continue
        title = text[start:end]
        if not title:
            continue
        year, number = find_year(first, last), find_number(first, last)
        out.append((pos, len(out) + 1, href, title, year and year[1], number and number[1]))
    return out
