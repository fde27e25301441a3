"""HTML extraction by consensus of a host's pages.

Every page scores its containers by the prose in them and votes for their generalised tag-class
paths, one vote in all; votes are summed per host in Spark, and every page is extracted again at
its host's winning path: all elements there, and articles that stand beside them. Where a page has
no such element, or one with at most MINOR of the prose at its own best path, it is extracted there.
The page itself is a container, so that text outside all others has a place.

A page is read once by one scanner that never goes back, in time linear in its length. A path is
written as the tag and a 64-bit hash of the whole path, so deep pages don't have long ones.

Defined results: null html counts as empty and gives empty text; text without tags is one block; a
null or odd url belongs to the host ''; equal sums of votes go to the smaller path; very long and
deep pages are read whole; repeated rows are pages of their own; an empty table gives an empty
table; other columns pass through, whatever their names; one named as the result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import bounded, others
from weftline.session import materialize

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
STOP = re.compile("[\"'>]")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page's. Only scripts and styles take all that follows if nothing ends them.
CODE = frozenset(("script", "style"))
RAW = frozenset("script style noscript template textarea iframe svg math select object".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
#: Weights of containers by their tag.
PRIOR = {"article": 1.5, "main": 1.25}
ASIDE_TAGS = frozenset("aside button footer head menu nav title".split())
#: These are asides, by tag or name, up to MOST of the page's prose; one that holds more is what the page is about, as a form
#: around a whole page.
SHARED_TAGS = frozenset("dialog fieldset form".split())
SHARED_NAMES = frozenset("dialog form modal search widget".split())
MOST = 0.5
#: Never asides by name, whatever their classes tell of the page's layout or the article's topic.
NEVER_ASIDE = frozenset("html body main article".split())
#: An element whose names just begin or end with an aside's is one up to this share of the page's prose.
MINOR = 0.2
#: Names of what isn't the article, in class, id or role.
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts alert author-box banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu nav navbar navigation newsletter notice pager pagination popup promo related share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
HEADER_NAMES = frozenset(("header", "topbar"))
#: An opening tag ends an open element of these before it.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option"}
SCOPE = frozenset("html body div article section main td th table ul ol dl blockquote aside nav form footer header".split())


RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}


def step_of(tag: str, names: str) -> str:
    """tag.class generalised: lower case, runs of digits as #, names sorted."""
    parts = sorted({re.sub(r"[0-9]+", "#", n) for n in names.lower().split()})
    return ".".join([tag, *parts])


def deeper(key: int, step: str) -> int:
    """The hash of a path that is longer by a step."""
    raw = step.encode("utf-8", "surrogatepass")
    return (crc32(raw, key >> 32) << 32 | crc32(raw, key & 0xFFFFFFFF ^ 0x9E3779B9)) & (1 << 64) - 1


def path_of(readable: str) -> str:
    """The path as voted on, from one written out: /html/body/div.post."""
    key, tag = 0, ""
    for step in filter(None, readable.split("/")):
        key, tag = deeper(key, step), step.split(".")[0]
    return f"{tag}@{key:016x}"


def is_aside(tag: str, names: str, within_article: bool) -> float:
    """Up to which share of the page's prose the element is an aside: 1 by its tag or a whole name, MOST for what may hold
    a whole page as well, MINOR if a name just begins or ends with an aside's, 0 for all others."""
    if tag in ASIDE_TAGS or tag == "header" and not within_article:
        return 1.0
    if tag in NEVER_ASIDE:
        return 0.0
    known = ASIDE_NAMES if within_article else ASIDE_NAMES | HEADER_NAMES
    whole = names.lower().split()
    if not known.isdisjoint(whole):
        return 1.0
    if tag in SHARED_TAGS or not SHARED_NAMES.isdisjoint(whole):
        return MOST
    for name in whole:
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if parts and not (known | SHARED_NAMES).isdisjoint((parts[0], parts[-1])):
            return MINOR
    return 0.0


@dataclass
class Page:
    """A page's elements in the order of their opening tags, number 0 the page itself, and its blocks of
    text: (innermost element, [(element, text)], length of the text in links)."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    key: list[int] = field(default_factory=lambda: [0])
    aside: list[float] = field(default_factory=lambda: [0.0])
    blocks: list[tuple[int, list[tuple[int, str]], int]] = field(default_factory=list)
    texts: list[tuple[int, str, float]] = field(default_factory=list)

    def path(self, i: int) -> str:
        return f"{self.tag[i]}@{self.key[i]:016x}"

    def settle(self) -> None:
        """Decides the elements that are asides if they hold little, then joins the texts of what isn't one:
        (innermost element, text, prose in it)."""
        held = [0.0] * len(self.tag)
        if any(0 < share < 1 for share in self.aside):
            for owner, parts, linked in self.blocks:
                held[owner] += max(0.0, sum(len(t) for _, t in parts) - 2.0 * linked)
            for i in range(len(held) - 1, 0, -1):
                held[self.parent[i]] += held[i]
        for i in range(1, len(self.tag)):
            if self.aside[self.parent[i]]:
                self.aside[i] = 1.0
            elif 0 < self.aside[i] < 1:
                self.aside[i] = float(held[i] <= self.aside[i] * held[0])
        for owner, parts, linked in self.blocks:
            if not self.aside[owner]:
                text = " ".join(unescape("".join(t for i, t in parts if not self.aside[i])).split())
                if text:
                    self.texts.append((owner, text, max(0.0, len(text) - 2.0 * linked)))

    def containers(self) -> dict[int, float]:
        """Scores: a block's prose counts for its container, half for the one around that, and so on."""
        above = [0] * len(self.tag)  # the nearest container around each element, itself included
        for i in range(1, len(self.tag)):
            above[i] = i if self.tag[i] in CONTAINERS and not self.aside[i] else above[self.parent[i]]
        scores: dict[int, float] = {}
        for owner, _, gain in self.texts:
            i = above[owner]
            while gain >= 1:
                scores[i] = scores.get(i, 0.0) + gain
                gain *= 0.5
                if not i:
                    break
                i = above[self.parent[i]]
        return {i: x * PRIOR.get(self.tag[i], 1.0) for i, x in scores.items()}

    def ballots(self) -> dict[str, float]:
        """The scores summed by path."""
        found: dict[str, float] = {}
        for i, x in self.containers().items():
            found[self.path(i)] = found.get(self.path(i), 0.0) + x
        return found

    def at(self, path: str) -> tuple[list[str], float]:
        """The texts of all elements at the path, and of articles beside them; the prose in them."""
        taken = [False] * len(self.tag)
        within = set()
        for i in range(len(self.tag)):
            if (not i or self.tag[i] in CONTAINERS) and not self.aside[i] and self.path(i) == path:
                taken[i] = True
                if self.tag[i] == "article":
                    within.add(self.parent[i])
        for i in range(1, len(self.tag)):
            taken[i] = not self.aside[i] and (taken[i] or taken[self.parent[i]] or self.tag[i] == "article" and self.parent[i] in within)
        kept = [(text, prose) for owner, text, prose in self.texts if taken[owner]]
        return [text for text, _ in kept], sum(prose for _, prose in kept)


def tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends the tag, or -1. Quotes that nothing closes are plain characters;
    last: where each of them occurs last."""
    while True:
        m = STOP.search(html, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        if last[m[0]] >= at:
            at = html.index(m[0], at) + 1


def parse(html: str) -> Page:
    page = Page()
    stack, within = [0], [False]  # open elements; whether each lies in an article or main
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    scopes: list[int] = []
    parts: list[tuple[int, str]] = []
    links = 0
    last = {q: html.rfind(q) for q in "\"'"}
    quoted = True  # until a tag has no end outside of quotes
    endless: set[str] = set()  # raw elements that nothing ends from here on

    def flush() -> None:
        nonlocal links, parts
        if parts:
            page.blocks.append((stack[-1], parts, links))
            parts, links = [], 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and page.aside[stack[-1]] < 1:
            parts.append((stack[-1], raw))
            if any(page.tag[i] == "a" for i in stack[-3:]):
                links += len(raw)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = page.tag[stack.pop()]
            within.pop()
            open_at[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    def innermost(tags, ignored=()) -> int:
        """The place of the innermost open element of these tags that no scope closes off, or 0."""
        at = max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        scope = next((s for s in reversed(scopes) if page.tag[stack[s]] not in ignored), 0)
        return at if at >= scope else 0

    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            break
        text(html[at:begin])
        at = begin
        if html.startswith("<!--", at) or html.startswith("<![CDATA[", at):
            mark = "-->" if html[at + 2] == "-" else "]]>"
            end = html.find(mark, at + 4)
            at = size if end < 0 else end + len(mark)
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            if end < 0:
                break
            at = end + 1
            continue
        closing = html.startswith("/", at + 1)
        named = NAME.match(html, at + 1 + closing)
        if not named:
            text("<")
            at += 1
            continue
        end = tag_end(html, named.end(), last) if quoted else -1
        if end < 0:
            quoted = False
            end = html.find(">", named.end())
            if end < 0:
                break
        inside, at, tag = html[named.end() : end], end + 1, named[0].lower()
        if closing:
            depth = (open_at.get(tag) or [0])[-1] if tag in BLOCKS else innermost((tag,))
            if depth:
                if tag in BLOCKS:
                    flush()
                pop_to(depth)
            continue
        if tag == "br":
            text("\n")
            continue
        if tag in BLOCKS:
            flush()
            ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
            depth = innermost(ends, ("td", "th") if tag in ("tr", "td", "th") else ()) if ends else 0
            if depth:
                pop_to(depth)
        if tag in VOID:
            continue
        empty = inside.rstrip().endswith("/")
        if tag in RAW:
            if empty and tag not in CODE:
                continue
            close = None if tag in endless else RAW_END[tag].search(html, at)
            end = html.find(">", close.end()) if close else -1
            if end >= 0:
                at = end + 1
            elif tag in CODE and not empty:
                at = size
            else:
                endless.add(tag)
            continue
        if empty and tag not in BLOCKS:
            continue
        names = " ".join(a or b or c for a, b, c in NAMED.findall(inside)) if inside else ""
        up = stack[-1]
        aside = 1.0 if page.aside[up] == 1 else is_aside(tag, names, within[-1])
        page.tag.append(tag)
        page.parent.append(up)
        page.key.append(deeper(page.key[up], step_of(tag, names)) if tag in BLOCKS else page.key[up])
        page.aside.append(aside)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(len(page.tag) - 1)
        within.append(within[-1] or tag in ("article", "main"))
    text(html[at:])
    flush()
    page.settle()
    return page


def best(ballots: dict[str, float]) -> str | None:
    return min(ballots, key=lambda p: (-ballots[p], p)) if ballots else None


def votes_of(html: str) -> list[tuple[str, float]]:
    """The page's paths with their shares of its score, best first; a page has one vote in all."""
    found = parse(html).ballots()
    total = sum(found.values())
    return [(p, x / total) for p, x in sorted(found.items(), key=lambda x: (-x[1], x[0]))]


def text_at(html: str, path: str | None) -> str:
    """The text at the path, or, if that holds nothing or but a minor share, at the page's own best."""
    page = parse(html)
    there, prose = page.at(path) if path is not None else ([], 0.0)
    own = best(page.ballots())
    if own is None:  # nothing but links and lone characters
        return "\n".join(there) or "\n".join(text for _, text, _ in page.texts)
    if own != path:
        mine, more = page.at(own)
        if not there or prose <= MINOR * more:
            there = mine
    return "\n".join(there)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, path, votes: one row a host."""

    @F.arrow_udf("array<struct<path:string,share:double>>")
    def vote(column: pa.Array) -> pa.Array:
        rows = [[{"path": p, "share": s} for p, s in votes_of(x or "")] for x in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64())])))

    cast = bounded(pages).select(host_of(F.col(url)).alias("host"), F.explode(vote(F.col(html))).alias("v")).select("host", "v.path", F.round(F.col("v.share") * 1_000_000).cast("long").alias("share"))
    counted = cast.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    first = F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("first")
    return counted.groupBy("host").agg(first).select("host", F.col("first.path").alias("path"), (-F.col("first.less")).alias("votes"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", name: str = "text") -> DataFrame:
    """pages plus the main text. The winners, one row a host, are written first, so that the join
    is planned by their real size: broadcast while it is small, by shuffle beyond that."""
    winners = materialize(winning_paths(pages, html, url).select("host", "path"), "paths")

    @F.arrow_udf("string")
    def extracted(column: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([text_at(x or "", p) for x, p in zip(column.to_pylist(), paths.to_pylist())], pa.string())

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"), F.struct("*").alias("row"))
    joined = rows.join(winners, "host", "left")
    return joined.select(*others(pages, name, prefix="row."), extracted(F.col("html"), F.col("path")).alias(name))
