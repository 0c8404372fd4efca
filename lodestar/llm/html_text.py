"""Main text of web pages by consensus of each host's pages on the path of the container that holds it.

1. Every page is read into blocks of text under a tree of elements; each page votes for one container: from the
   root downwards as long as one child container holds most of the good text (text outside links and outside
   boilerplate elements).
2. Votes are for generalised paths of tags, classes and ids (runs of digits become N). Spark counts them per
   host; the path with the most votes wins, then the one with the greater score, then the greater string.
3. Pages are read again, and the blocks below the host's winning path are the text; a page without that path
   uses its own container.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts) is known by
tag, role or the words of class and id, and is dropped below the container; a wrapper that holds most of a
page's text isn't boilerplate, whatever its classes say.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, written

DESCEND, WRAPPER = 0.7, 0.6
"""A child container is gone into if it holds this share of its parent's good text; an element with that share of the page's text is no boilerplate."""
MAX_BROADCAST = 200_000
"""Winning paths of more hosts than this are joined by host and salt instead of being broadcast."""
SALTS = 32
LONGEST_PATH = 400

# Kinds of HTML elements, and words that mark boilerplate in classes, ids and roles.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CONTAINER = frozenset("html body main article section div td center table tbody tr".split())
_DROPPED = frozenset("head nav footer aside form button select script style noscript template svg math iframe object canvas audio video dialog menu textarea title fieldset".split())
_TRUSTED = frozenset("html body main article".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert menu menubar form".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion outbrain taboola menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidenav footer masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login widget pagination pager skip hidden".split()
)
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


def _short(path: str) -> str:
    """A path of up to LONGEST_PATH characters; of a longer one a hash of the whole and its end, so that paths stay apart."""
    return path if len(path) <= LONGEST_PATH else f"{xxhash.xxh64_hexdigest(path)}~{path[17 - LONGEST_PATH :]}"


class Page:
    """A page's elements and blocks. tags, paths, parents, bad: by element; blocks: (element, text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.paths, self.parents, self.bad = ["#root"], [""], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, text, linked, in_link, at = [0], [], 0, False, 0

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join("".join(text).split())
                if joined:
                    self.blocks.append((stack[-1], joined, min(linked, len(joined))))
                text, linked = [], 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece)
                text.append(piece)
                if in_link:
                    linked += len(piece)

        end = len(source)
        while at < end:
            m = _TAG.search(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name, closing, attrs = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
            if name in _INLINE:
                if name == "a":
                    in_link = not closing
                continue
            if name == "br":
                text.append(" ")
                continue
            flush()
            if closing:
                in_link = False
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in _RAW:
                close = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = source.find(">", close.start()) + 1 if close else end
                at = at or end
                continue
            if name in _VOID:
                continue
            in_link = False
            if self.tags[stack[-1]] == "p":
                stack.pop()
            if name in _CLOSES:
                ends, within = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] in within:
                        break
                    if self.tags[stack[k]] in ends:
                        del stack[k:]
                        break
            stack.append(self._element(name, attrs, stack[-1]))
        flush()

    def _element(self, name: str, attrs: str, parent: int) -> int:
        label, bad = name, 2 if name in _DROPPED else 0
        if attrs.strip(" /\n\t\r"):
            values = {}
            for k, v in _ATTR.findall(attrs):
                values.setdefault(k.lower(), html.unescape(v.strip("\"'")))
            words: list[str] = []
            for kind, sign in (("class", "."), ("id", "#")):
                for part in sorted(set(values.get(kind, "").split())):
                    label += sign + _DIGITS.sub("N", part.lower())
                    words += [w.lower() for w in _WORD.findall(part)]
            style = values.get("style", "").replace(" ", "").lower()
            if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
                bad = 2
            elif name not in _TRUSTED and not bad and (values.get("role", "").lower() in _ROLES or not _MARKS.isdisjoint(words)):
                bad = 1
        if name == "header":
            bad = max(bad, 1)
        self.tags.append(name)
        self.paths.append(_short(f"{self.paths[parent]}/{label}"))
        self.parents.append(parent)
        self.bad.append(bad)
        return len(self.tags) - 1

    def weigh(self) -> tuple[list[int], list[int]]:
        """Characters of text, and of good text, below each element; marks of wrappers are taken back."""
        n = len(self.tags)
        every, good = [0] * n, [0] * n
        for node, text, linked in self.blocks:
            every[node] += len(text) - linked
        for i in range(n - 1, 0, -1):
            every[self.parents[i]] += every[i]
        for i in range(1, n):
            if self.bad[i] == 1 and every[i] > WRAPPER * every[0]:
                self.bad[i] = 0
        shut = [False] * n
        for i in range(1, n):
            shut[i] = shut[self.parents[i]] or self.bad[i] > 0
        for node, text, linked in self.blocks:
            if not shut[node] and 2 * linked <= len(text):
                good[node] += len(text) - linked
        for i in range(n - 1, 0, -1):
            good[self.parents[i]] += good[i]
        return every, good

    def container(self) -> tuple[int, int]:
        """The element that this page votes for, and its good characters."""
        _, good = self.weigh()
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tags)):
            children.setdefault(self.parents[i], []).append(i)
        at = 0
        while True:
            inner = [i for i in children.get(at, ()) if self.tags[i] in _CONTAINER]
            best = max(inner, key=lambda i: good[i], default=None)
            if best is None or not good[at] or good[best] < DESCEND * good[at]:
                return at, good[at]
            at = best

    def text(self, path: str | None) -> str:
        """The blocks below elements with the path, or below this page's own container."""
        own, _ = self.container()
        n = len(self.tags)
        inside, shut = [False] * n, [False] * n
        found = path is not None and path in self.paths
        for i in range(n):
            up = self.parents[i]
            starts = self.paths[i] == path if found else i == own
            inside[i] = starts or (i > 0 and inside[up])
            shut[i] = inside[i] and i > 0 and not (starts and not inside[up]) and (shut[up] or self.bad[i] > 0)
        keep = [t for node, t, _ in self.blocks if inside[node] and (not shut[node] or self._heading(node, inside))]
        return "\n".join(keep)

    def _heading(self, node: int, inside: list[bool]) -> bool:
        """A heading in a header within the container stays: it's the article's own."""
        if len(self.tags[node]) != 2 or self.tags[node][0] != "h" or not self.tags[node][1].isdigit():
            return False
        up, seen = self.parents[node], False
        while up > 0 and inside[up]:
            if self.bad[up]:
                if self.tags[up] != "header" or self.bad[up] == 2:
                    return False
                seen = True
            up = self.parents[up]
        return seen


def hosts(url):
    """The host of a URL, in lower case; empty for none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def winners(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, path: of each host the path with the most votes. Votes are summed before they are shuffled."""

    def vote(batch: pa.RecordBatch) -> Iterator[dict]:
        got = []
        for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(s or "")
            at, score = page.container()
            if score:
                got.append((h, page.paths[at], score))
        if got:
            yield {k: pa.array(v) for k, v in zip(("host", "path", "score"), zip(*got, strict=True), strict=True)}

    votes = arrow_map(pages.select(hosts(F.col(url)).alias("host"), source), "host string, path string, score long", vote)
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("best")).select("host", "best.path")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text of every row; null html is empty, a page without good text has an empty one.

    Pages with a null url share the empty host. Repeated rows are pages of their own (and vote each). Other
    columns are not read. The winning paths, at most LONGEST_PATH characters each, are broadcast up to
    MAX_BROADCAST hosts; beyond, pages are joined with them by host and one of SALTS salts, so that a host with
    most of the pages is dealt over as many tasks.
    """
    best = written(winners(pages, url, source), "paths")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), hosts(F.col(url)).alias("host"))
    if best.count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html", "key"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        text = [Page(s).text(p) if s else "" for s, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield {"key": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string())}

    kind = pages.schema[key].dataType.simpleString()
    out = arrow_map(joined.select("key", "url", "html", "path"), f"key {kind}, url string, text string", cut)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")
