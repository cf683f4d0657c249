"""Web pages and links: titles, headings, text, resources, URL resolution, crawl admission."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, functions as F

#: Fixed extensions and schemes that a crawl skips.
SKIP_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".mp4", ".mp3", ".pdf", ".zip", ".gz"]
SKIP_PREFIXES = ["mailto:", "javascript:", "tel:", "#", "data:"]
RESOURCES = {"a": "href", "img": "src", "script": "src", "link": "href", "form": "action", "iframe": "src", "frame": "src"}
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var".split())
_SILENT = frozenset(("script", "style", "head", "title", "noscript", "template"))


class PageReader(HTMLParser):
    """Collects title, metadata, headings, links, resources and the body's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.headings, self.links, self.resources, self.meta = "", [], [], [], [], {}
        self._silent, self._in_title, self._heading = [], False, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        if tag not in _INLINE:
            self.text.append(" ")
        if tag == "title":
            self._in_title = True
        if tag in _SILENT:
            self._silent.append(tag)
        if re.fullmatch(r"h[1-6]", tag):
            self._heading = (tag, [])
        if tag == "meta" and (name := values.get("name") or values.get("property")):
            self.meta[re.sub(r"[^a-z0-9_]+", "_", name.lower())] = values.get("content") or ""
        if tag in RESOURCES and (target := values.get(RESOURCES[tag])):
            self.resources.append((tag, target))
            if tag == "a" and not target.startswith("#"):
                self.links.append(target)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.text.append(" ")
        if tag == "title":
            self._in_title = False
        if tag in self._silent:
            while self._silent.pop() != tag:
                pass
        if self._heading and tag == self._heading[0]:
            self.headings.append((tag, " ".join("".join(self._heading[1]).split())))
            self._heading = None

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if self._heading:
            self._heading[1].append(data)
        if not self._silent:
            self.text.append(data)


def read_page(html: str) -> PageReader:
    reader = PageReader()
    reader.feed(html)
    reader.close()
    return reader


def resolve_url(base: str, href: str) -> str:
    """A link as an absolute URL."""
    if href.startswith(("http://", "https://")):
        return href
    scheme, _, rest = base.partition("://")
    if href.startswith("//"):
        return f"{scheme}:{href}" if rest else f"https:{href}"
    if href.startswith("/"):
        return f"{scheme}://{rest.split('/')[0]}{href}" if rest else f"https://localhost{href}"
    if href[:1] in ("?", "#"):
        return base
    cut = base.rfind("/")
    folder = base[:cut + 1] if cut > 8 else base
    if href.startswith("./"):
        return folder + href[2:]
    while href.startswith("../"):
        up = folder[:-1].rfind("/")
        folder = folder[:up + 1] if up >= 0 else folder
        href = href[3:]
    return folder + href


def domain(url: Column) -> Column:
    """The host and port of an http(s) URL, or null."""
    found = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    return F.when(url.rlike("^https?://"), found)


def admitted(url: Column, allowed: list[str] | None = None, follow_external: bool = False, skip: list[str] | None = None) -> Column:
    """Whether a crawl takes a URL: not by extension or scheme, and within the allowed domains."""
    out = F.lit(True)
    for ending in SKIP_EXTENSIONS if skip is None else skip:
        out = out & ~url.endswith(ending)
    for start in SKIP_PREFIXES:
        out = out & ~url.startswith(start)
    if allowed and not follow_external:
        host = domain(url)
        inside = F.lit(False)
        for d in allowed:
            inside = inside | (host == d) | host.endswith(f".{d}")
        out = out & (host.isNull() | inside)
    return out


def priority(depth: Column) -> Column:
    return F.when(depth <= 1, "high").when(depth == 2, "medium").when(depth == 3, "low").otherwise("background")


def links(html: Column) -> Column:
    """Targets of anchors, without fragments of the page, by pattern and in the JVM."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(found, lambda x: (x != "") & ~x.startswith("#"))


def resources(html: Column) -> dict[str, Column]:
    """Targets of the tags that name a resource, by tag and in the JVM; empty targets are left out, null pages give null.

    An attribute's value may not hold a ``<`` before the one asked for, so that unclosed tags end at the next tag.
    """

    def targets(tag: str, attribute: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}(?:\s[^<>]*?)?\s{attribute}\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
        return F.filter(found, lambda x: x != "")

    return {tag: targets(tag, attribute) for tag, attribute in RESOURCES.items()}
