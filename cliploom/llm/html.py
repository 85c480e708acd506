"""HTML extraction by consensus host paths (operator 10).

1. Spark counts each block of text over the pages of its host. Blocks on `LEAST_PAGES` pages or more and
   `LEAST_SHARE` of the host's pages repeat: they say nothing about where articles are.
2. Each page scores its containers by their fresh text: blocks that do not repeat, less what is in links. It votes
   for the deepest container that holds `MOST` of that, or for what encloses it: the `article` it is in, or the
   containers that add headings or blocks of their own. A vote is for the container's generalised path of tags and
   classes and weighs as much as its fresh text. Spark sums the votes of each host; the path with most wins.
3. Every page is read again with the winning path. A page whose winner holds less than half of its fresh text, or is
   not there, takes the container it voted for.

Elements that are known not to be the article (menus, forms, and classes named so) take no part at any step, but a header
inside an `article` is its own. Names that may as well name a part of an article ("share", "promotion") only say that an
element casts no vote: inside the chosen container it stays if it is prose (`PROSE_WORDS` words, no more than a third
in links) that does not repeat on the host. All other blocks of the chosen containers stay, repeated ones too. Null and empty pages give an empty text. Null and odd urls
share a host "-". Pages are read one by one, so repeated rows do no harm; what a host with a third of all pages holds
is summed in parts before the shuffle. Votes are whole numbers, ties go to the greater path number. Paths are numbers
made from the parent's, and containers are ranges of blocks, so memory is linear in the page however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import stash, table

#: A block repeats on a host from so many pages on, which are so much of its pages.
LEAST_PAGES = 3
LEAST_SHARE = 0.3
#: Share of the page's fresh text that the voted container holds, in tenths.
MOST = 7
#: Numbers of hosts and of their repeated blocks that are broadcast at most; beyond, pages are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe svg math object select option button textarea canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SIDE = frozenset("nav header footer aside form menu dialog".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of an article rather than containers of one.
PARTS = HEADINGS | frozenset("html body p li ul ol dl dt dd blockquote pre figure figcaption address table caption thead tbody tfoot tr th hr".split())
#: Words in a class or id that mark what is not the article, wherever they stand in a name ...
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu "
    "nav navbar navigation newsletter pagination pager sidebar sidebars signup sponsor sponsored subscribe".split()
)
#: ... where all other words of the name are of these kinds or say no more than place and shape ...
SIDE_NAMES = frozenset(
    "dialog header masthead modal notice notices notification popup recommended related replies reply respond search skip subscription toolbar topbar widget".split()
)
#: ... and likewise, but for prose inside the chosen container.
LOOSE_NAMES = frozenset("banner commentary discussion links privacy promo promoted promotion share sharing social tags tracking".split())
PLACES = frozenset(
    "area article bar block body bottom box button buttons card cards col column container content count entry fixed form global group holder icon icons inner inline "
    "item items left list main module outer page panel post primary region right row secondary section site slot sticky story strip text thread title top unit "
    "wrap wrapper zone".split()
)
OWN = frozenset("article entry post story".split())
#: Words from which on an element is prose.
PROSE_WORDS = 20
#: Names that say how the page is laid out around an element ("has-sidebar"), not what the element is.
LAYOUT = re.compile(r"(?:has|with|no|without)[-_]")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|$)|</?[A-Za-z][^>]*(?:>|$)|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe")}


class Page:
    """A page as blocks of text in page order, and elements as ranges of blocks."""

    def __init__(self):
        self.blocks: list[str] = []
        self.links: list[int] = []  # characters in links, for each block
        self.owner: list[int] = []  # innermost element of each block
        self.loose: list[int] = []  # 1 for prose in a loosely named element, 2 for other text in one, else 0
        self.tag, self.path, self.parent, self.side, self.first, self.last = [""], [0], [-1], [0], [0], [0]

    def open(self, tag: str, name: str, side: int, parent: int) -> int:
        number = xxhash.xxh3_64_intdigest(f"{self.path[parent]} {name}") - (1 << 63)
        for column, value in ((self.tag, tag), (self.path, number), (self.parent, parent), (self.side, max(side, self.side[parent])), (self.first, len(self.blocks)), (self.last, -1)):
            column.append(value)
        return len(self.tag) - 1

    def close(self, node: int) -> None:
        self.last[node] = len(self.blocks)
        if self.side[node] == 1 and self.side[self.parent[node]] == 0:
            span = range(self.first[node], self.last[node])
            prose = sum(len(self.blocks[b].split()) for b in span) >= PROSE_WORDS and 3 * sum(self.links[b] for b in span) <= sum(len(self.blocks[b]) for b in span)
            for b in span:
                self.loose[b] = 1 if prose else 2

    def text(self, node: int, repeated: set[int]) -> list[str]:
        """The blocks of a container; of loosely named elements, only prose that is the page's own."""
        span = range(self.first[node], self.last[node])
        return [self.blocks[b] for b in span if not self.loose[b] or (self.loose[b] == 1 and node and block_key(self.blocks[b]) not in repeated)]


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(tag)}


def is_side(name: str, found: dict[str, str], in_article: bool = False) -> int:
    """2 for what is not the article, 1 for what is not unless it turns out to be its prose, else 0."""
    if name in SIDE and not (name == "header" and in_article) or found.get("role", "").lower() in ROLES or "hidden" in found.get("aria-modal", ""):
        return 2
    if name in ("html", "body", "main", "article"):
        return 0
    kind = 0
    for n in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split():
        if LAYOUT.match(n):
            continue
        words = {w for w in re.split(r"[^a-z]+", n) if w}
        if words & SIDE_WORDS:
            return 2
        said = words & (SIDE_NAMES | LOOSE_NAMES)
        if said and all(w in said or w in PLACES or len(w) < 3 for w in words) and not (said == {"header"} and (words & OWN or in_article)):
            kind = max(kind, 1 if said <= LOOSE_NAMES else 2)
    return kind


def general(name: str, found: dict[str, str]) -> str:
    """The tag with its classes, digits in them generalised."""
    classes = sorted({re.sub(r"\d+", "#", x) for x in found.get("class", "").lower().split()})
    return ".".join([name, *classes])


def parse(page: str) -> Page:
    found, stack, at, end = Page(), [0], 0, len(page)
    depth_of: dict[str, int] = {}  # open elements by name
    text: list[str] = []
    linked = unseen = in_links = 0

    def close_block() -> None:
        nonlocal in_links
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block and found.side[stack[-1]] < 2:
                found.blocks.append(block)
                found.links.append(min(in_links, len(block)))
                found.owner.append(stack[-1])
                found.loose.append(0)
        in_links = 0

    def pop() -> str:
        node = stack.pop()
        found.close(node)
        depth_of[found.tag[node]] -= 1
        return found.tag[node]

    while at < end:
        m = TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or len(token) == 1:
            if not unseen:
                plain = html.unescape(token)
                text.append(plain)
                in_links += len(plain) if linked else 0
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        closing = token[1] == "/"
        if name in UNSEEN:
            if name in RAW_END and not closing:
                over = RAW_END[name].search(page, at)
                at = over.end() if over else end
            elif not token.endswith("/>"):
                unseen = max(0, unseen + (-1 if closing else 1))
            if name not in ("button", "select", "option"):
                close_block()
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                linked = 0 if closing else 1
            continue
        if unseen and closing:
            unseen = 0
        close_block()
        if name in VOID:
            continue
        if closing:
            if depth_of.get(name):
                while pop() != name:
                    pass
                linked = 0
            continue
        if found.tag[stack[-1]] == "p" and name in CLOSES_P:
            pop()
        if name in ("li", "tr", "td", "th", "dt", "dd") and found.tag[stack[-1]] == name:
            pop()
        attrs = attributes(token) if "=" in token else {}
        stack.append(found.open(name, general(name, attrs), is_side(name, attrs, bool(depth_of.get("article"))), stack[-1]))
        depth_of[name] = depth_of.get(name, 0) + 1
        linked = 0
    close_block()
    while len(stack) > 1:
        pop()
    found.last[0] = len(found.blocks)
    return found


def block_key(block: str) -> int:
    return xxhash.xxh3_64_intdigest(block) - (1 << 63)


def fresh(page: Page, repeated: set[int]) -> list[int]:
    """Running sums of the blocks' fresh text. A page that has none counts all its text."""
    for weigh in (
        lambda b, n: 0 if block_key(b) in repeated else max(0, len(b) - 2 * n),
        lambda b, n: max(0, len(b) - 2 * n),
        lambda b, n: len(b),
    ):
        sums = [0]
        for b, n, loose in zip(page.blocks, page.links, page.loose):
            sums.append(sums[-1] + (0 if loose else weigh(b, n)))
        if sums[-1]:
            break
    return sums


def best_container(page: Page, sums: list[int]) -> int:
    """The element that the page votes for; 0, the whole page, where no container holds enough."""
    best = 0
    for node in range(1, len(page.tag)):
        if page.tag[node] not in PARTS and 10 * (sums[page.last[node]] - sums[page.first[node]]) >= MOST * sums[-1]:
            best = node  # those that hold so much lie inside each other; the last one is the deepest
    up = best
    while up and page.tag[up] != "article":
        up = page.parent[up]
    if up:
        return up
    while best:
        parent = page.parent[best]
        if page.tag[parent] in PARTS or not parent:
            break
        more = [*range(page.first[parent], page.first[best]), *range(page.last[best], page.last[parent])]
        more = [b for b in more if not page.loose[b]]
        own = [b for b in more if container(page, page.owner[b]) == parent]
        if len(own) < len(more) and not any(page.tag[page.owner[b]] in HEADINGS for b in own):
            break
        best = parent
    return best


def container(page: Page, node: int) -> int:
    while node and page.tag[node] in PARTS:
        node = page.parent[node]
    return node


def ballot(html_: str, repeated: list[int]) -> tuple[int, int] | None:
    """The page's vote: a path and its weight."""
    page = parse(html_)
    sums = fresh(page, set(repeated))
    best = best_container(page, sums) if sums[-1] else 0
    return (page.path[best], sums[page.last[best]] - sums[page.first[best]]) if best else None


def read_text(html_: str, path: int | None, repeated: list[int]) -> tuple[str, bool]:
    """The text of the outermost containers with that path, if they hold half of what is fresh, or of the page's own choice."""
    page, often = parse(html_), set(repeated)
    sums = fresh(page, often)
    chosen, end = [], 0
    for node in range(1, len(page.tag)) if path is not None else ():
        if page.path[node] == path and page.first[node] >= end and page.last[node] > page.first[node]:
            chosen.append(node)
            end = page.last[node]
    by_host = bool(chosen) and 2 * sum(sums[page.last[x]] - sums[page.first[x]] for x in chosen) >= sums[-1]
    if not by_host:
        chosen = [best_container(page, sums)] if sums[-1] else [0]
    return "\n\n".join(b for x in chosen for b in page.text(x, often)), by_host


def host_of(url) -> F.Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("-"))


def repeating(pages: DataFrame) -> DataFrame:
    """The blocks that repeat on each host (host, repeated): at most 1 / LEAST_SHARE times the blocks of a mean page."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                keys = {block_key(b) for b in parse(page.as_py() or "").blocks}
                yield pa.RecordBatch.from_pydict({"host": pa.array([host] * len(keys), pa.string()), "block": pa.array(list(keys), pa.int64())})

    size = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    counts = pages.select("host", "html").mapInArrow(blocks, "host string, block long").groupBy("host", "block").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= LEAST_PAGES).join(size, "host").where(F.col("n") >= LEAST_SHARE * F.col("n_pages"))
    lists = often.groupBy("host").agg(F.collect_list("block").alias("repeated"))
    return size.select("host").join(lists, "host", "left").select("host", F.coalesce("repeated", F.array().cast("array<long>")).alias("repeated"))


def with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    held = hosts.agg(F.sum(F.size("repeated") + 2)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if held <= BROADCAST_NUMBERS else hosts, "host", "left")


def vote(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """The winning path of each host that has one (host, path)."""

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, int], int] = {}
            for host, page, repeated in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("repeated")):
                cast = ballot(page.as_py() or "", repeated.as_py() or [])
                if cast:
                    rows[host, cast[0]] = rows.get((host, cast[0]), 0) + cast[1]
            keys = list(rows)
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.int64()),
                "n": pa.array(list(rows.values()), pa.int64()),
            })

    cast = with_hosts(pages, hosts).select("host", "html", "repeated").mapInArrow(ballots, "host string, path long, n long")
    summed = cast.groupBy("host", "path").agg(F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of `pages` (page_id, url, html); by_host tells whether it is from the host's path."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    hosts = stash(repeating(pages), "repeated")
    hosts = stash(hosts.join(vote(pages, hosts), "host", "left"), "paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                read_text(page.as_py() or "", path, repeated.as_py() or [])
                for page, path, repeated in zip(batch.column("html"), batch.column("path").to_pylist(), batch.column("repeated"))
            ]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(list(map(len, texts)), pa.int64()), "by_host": pa.array([b for _, b in found], pa.bool_()),
            })

    schema = "page_id long, url string, text string, n_chars long, by_host boolean"
    return with_hosts(pages, hosts).select("page_id", "url", "html", "path", "repeated").mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
