"""Main text of web pages by host consensus.

Each page's containers are scored by the text of the blocks right below them,
links counting against them, and the page votes for the generalised tag-class
path of its best one. Votes are summed by host and path in Spark. Then every
page is extracted again at its host's winning path; a page without such an
element uses its own best container, and one without any the body.

The text of an element is that of its blocks, without the subtrees of menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments, as told by tag, role, class and id. Character references are decoded,
white space within a block becomes one space, and blocks are joined by newlines
in page order.

Pages are read in one pass without backtracking, whatever their markup, and
paths are digests of one size, so neither unclosed tags nor deep nesting or long
classes cost more than their length.

Defined cases: a null or empty page and a page without text give an empty
string; a url without host belongs to the host ``""``; equal rows are extracted
row by row; ties between paths go to the one that sorts first; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessella.llm.store import written

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/>"']+)""")
_NUMBERS = re.compile(r"\d+")
_TOKEN = re.compile(r"[a-z]+")

# Fixed names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg canvas object".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption html body".split())
_CONTAINER = frozenset("article body div main section td center blockquote fieldset".split())
_SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table td th ul ol dl article section main div".split())
_NOISE_TAG = frozenset("head nav aside footer form button select menu dialog fieldset".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_NAME = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byads comment comments commentlist consent
    cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices
    notification pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip
    social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split())
_OWN_NAME = frozenset("article content entry main post story text".split())


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b", re.I)


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """The markup of a page as (start, end, tag, attributes, whether it ends an element); a comment or declaration has no tag.

    One pass: a tag ends at the first ">" outside quotes. If a quote is never
    closed, tags up to it end at their first ">", and a last tag without one is
    left out as a comment is. What follows the start of a
    raw element is skipped to its end.
    """
    at, size, last = 0, len(html), html.rfind(">")
    naive = 0  # tags that start before this end at their first ">"
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", "", False
            continue
        m = _NAME.match(html, start)
        declared = m is None and html.startswith(("<!", "<?"), start)
        if m is None and not declared:
            at = start + 1
            continue
        if start > last:
            yield start, size, "", "", False
            return
        if declared:
            at = html.find(">", start) + 1
            yield start, at, "", "", False
            continue
        end = m.end()
        while start >= naive:
            stop = _STOP.search(html, end)
            if stop is None:
                naive = size
            elif stop[0] == ">":
                end = stop.end()
                break
            else:
                end = html.find(stop[0], stop.end()) + 1
                if not end:
                    naive = stop.end()
        else:
            end = html.find(">", m.end()) + 1
        ends, tag, attributes = html[start + 1] == "/", m[1].lower(), html[m.end():end - 1]
        at = end
        if tag in _RAW and not ends and not attributes.rstrip().endswith("/"):
            close = _raw_end(tag).search(html, at)
            at = html.find(">", close.end()) + 1 if close else 0
            at = at or size
        yield start, at, tag, attributes, ends


class Page:
    """A parsed page: elements with parent, path and whether they are noise, and blocks of text by element.

    A path is held as a digest of fixed size of the generalised tags and classes
    from the root; ``names`` spells it out.
    """

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.kinds: list[str] = []
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.noise: list[bool] = []
        self.in_article: list[bool] = []
        self.holders: list[int] = []  # the nearest element, itself included, that may hold an article
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names, role, hidden, article = "", "", False, tag in ("article", "main")
        kind = tag
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name = (m[1] or m[5]).lower()
                value = m[2] or m[3] or m[4] or ""
                if name == "class":
                    names += " " + value
                    kind += "".join(sorted({"." + _NUMBERS.sub("0", c) for c in value.split()}))
                elif name == "id":
                    names += " " + value
                elif name == "role":
                    role = value.strip().lower()
                elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
        tokens = set(_TOKEN.findall(names.lower()))
        inside = parent >= 0 and self.in_article[parent]
        noise = (
            parent >= 0 and self.noise[parent] or hidden or tag in _NOISE_TAG or role in _NOISE_ROLE or tag == "header" and not inside
            or tag not in ("html", "body") and not article and bool(tokens & _NOISE_NAME) or not article and "header" in tokens and not tokens & _OWN_NAME
            or article and bool(tokens & {"comment", "comments", "reply", "teaser", "related", "ad", "promo"})
        )
        self.tags.append(tag)
        self.kinds.append(kind)
        above = self.paths[parent] if parent >= 0 else ""
        self.paths.append(xxhash.xxh3_128_hexdigest(f"{above}>{kind}"))
        self.in_article.append(inside or tag == "article")
        self.holders.append(len(self.tags) - 1 if tag in _CONTAINER or parent < 0 else self.holders[parent])
        self.parents.append(parent)
        self.noise.append(noise)
        return len(self.tags) - 1

    def names(self, element: int) -> str:
        """The path of an element in words."""
        out = []
        while element >= 0:
            out.append(self.kinds[element])
            element = self.parents[element]
        return "".join(f">{k}" for k in reversed(out))

    def _parse(self, html: str) -> None:
        stack: list[int] = []
        places: dict[str, list[int]] = defaultdict(list)  # by tag, where in the stack its open elements are
        blocks: list[int] = []  # where the open blocks are
        text: list[str] = []
        linked = 0

        def push(tag: str, attributes: str) -> None:
            places[tag].append(len(stack))
            if tag in _BLOCK:
                blocks.append(len(stack))
            stack.append(self._open(tag, attributes, stack[-1] if stack else -1))

        def close_to(i: int) -> None:
            while len(stack) > i:
                tag = self.tags[stack.pop()]
                places[tag].pop()
                if tag in _BLOCK:
                    blocks.pop()

        def end_implied(ended: tuple[str, ...]) -> None:
            i = max((places[t][-1] for t in ended if places[t]), default=0)
            if i and i >= max((places[t][-1] for t in _SCOPE if places[t]), default=0):
                close_to(i)

        def add(piece: str) -> None:
            nonlocal linked
            if piece and not self.noise[stack[-1]]:
                text.append(piece)
                if places["a"]:
                    linked += len(piece)

        def flush() -> None:
            nonlocal linked
            if text:
                joined = "".join(text)
                words = (unescape(joined) if "&" in joined else joined).split()
                if words:
                    self.blocks.append((stack[-1], " ".join(words), linked))
                text.clear()
            linked = 0

        push("html", "")
        at = 0
        for start, end, tag, attributes, ends in tags(html):
            add(html[at:start])
            at = end
            if not tag or tag in _RAW and not ends:
                continue
            if ends:
                if not places[tag] or not places[tag][-1]:
                    continue
                i = places[tag][-1]
                if tag in _BLOCK:
                    flush()
                elif blocks[-1] >= i:
                    continue  # an inline end tag does not close blocks
                if tag != "body":
                    close_to(i)
            elif tag == "br":
                text.append(" ")
            elif tag in _VOID:
                if tag == "hr":
                    flush()
            elif tag not in ("html", "body") or not places[tag]:
                if tag in _BLOCK:
                    flush()
                if tag in _CLOSES_P:
                    end_implied(("p",))
                if tag in _SAME_ENDS:
                    end_implied(_SAME_ENDS[tag])
                if tag == "body" and len(stack) > 1 and self.tags[stack[1]] == "head":
                    close_to(1)
                push(tag, attributes)
        add(html[at:])
        flush()

    def best(self) -> tuple[str, float] | None:
        """The path and the score of the best container."""
        scores: dict[int, float] = {}
        for element, text, linked in self.blocks:
            worth = len(text) - 3 * linked
            holder = self.holders[element]
            scores[holder] = scores.get(holder, 0) + worth
            if self.parents[holder] >= 0:
                outer = self.holders[self.parents[holder]]
                scores[outer] = scores.get(outer, 0) + worth / 2
        if not scores:
            return None
        best, score = max(scores.items(), key=lambda s: (s[1], -s[0]))
        up = best
        while up > 0:
            if self.tags[up] in ("article", "main"):
                best = up
                break
            up = self.parents[up]
        return self.paths[best], score

    def text(self, path: str | None) -> str:
        """The blocks below the elements of this path, or of the best container where there is none."""
        found = {i for i, p in enumerate(self.paths) if p == path and not self.noise[i]}
        if not found and path is not None:
            own = self.best()
            return self.text(own[0]) if own and own[0] != path else "\n".join(t for _, t, _ in self.blocks)
        inside: dict[int, bool] = {-1: False}
        for i, parent in enumerate(self.parents):
            inside[i] = i in found or inside[parent]
        return "\n".join(t for e, t, _ in self.blocks if inside[e])


def hosts(pages: DataFrame, url: str) -> DataFrame:
    """Adds ``host``: the url's host in lower case without port, or "" if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("host", host)


def votes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes, score): pages that vote for a path, and their scores' sum, by host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, b) for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (b := Page(t.as_py() or "").best())]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, (p, _) in found], pa.string()), pa.array([round(s) for _, (_, s) in found], pa.int64())], names=["host", "path", "score"])

    own = hosts(pages, url).select("host", F.col(html).cast("string"))
    return own.mapInArrow(vote, "host string, path string, score long").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winners(voted: DataFrame) -> DataFrame:
    """(winner_host, path): the path with most votes of each host; then the higher score, then the path that sorts first."""
    rank = F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path")
    return voted.groupBy(F.col("host").alias("winner_host")).agg(F.min(rank)["path"].alias("path"))


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, host, path, text) of every page row; path is that of its host.

    The winners, one row a host, are joined to the pages: broadcast by Spark if
    their size allows, else shuffled with both sides plain tables, so that the
    partition of a host with a third of all pages can be split.
    """
    won = written(winners(votes(pages, url=url, html=html)), "maintext")
    own = hosts(pages, url).select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), "host", F.col(html).cast("string").alias("html"))
    joined = own.join(won, own.host == won.winner_host, "left").select("key", "url", "host", "path", "html")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py() or "").text(p) for p, h in zip(batch.column(3).to_pylist(), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], names=[key, "url", "host", "path", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{key}` {kind}, url string, host string, path string, text string")
