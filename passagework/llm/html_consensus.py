"""Main text of pages by paths that a host's pages agree on, without what a host repeats.

A block is a run of text between block elements. Blocks that stand at the same path with
the same text on a large share of a host's pages are boilerplate: every page's blocks are
hashed with their path of tags and classes (digits generalised), Spark counts on how many
pages of the host each stands, and what ``REPEATED_SHARE`` of them have adds no text and no
score. Pages are told apart by their three longest blocks, so an article that a host has
many times, exactly or nearly, isn't taken for boilerplate. A repeated heading stays if
text of its own container follows it, and inside an ``article`` or ``main`` element a
repeated block goes only with its whole container, so a sentence that articles share stays.

Each page's containers are then scored: the share of the page's text, less its links, plus
a little for depth, more for names of articles, less for words of boilerplate in a name.
The page votes for its best container's path, Spark counts the votes per host, and paths
with at least ``LEAST_SHARE`` of a host's votes win, at most 1/share of them. Every page is
extracted again by the first winning path that it has, and by its own best container if it
has none. So a page whose own best container is a wrong one, as a long list of links or a
short article make it, is mended by the others of its host.

Menus, forms, adverts and the like are left out by tag, or by a class, id or role that says
nothing else: ``site-header`` and ``relatedPosts`` do, ``notice-board`` and ``social-history``
don't. A page of which names leave nothing is read without them. A path is a chain of
digests, so depth costs no memory.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sliced

LEAST_SHARE = 0.05
#: A block on that share of a host's pages, and on that many, is boilerplate.
REPEATED_SHARE, REPEATED_PAGES = 0.5, 4
#: What is known of up to this many hosts is broadcast, with up to this many hashes of blocks.
BROADCAST_HOSTS, BROADCAST_KEYS = 100_000, 2_000_000
SALTS = 64

# Names of elements.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas math select option".split())
DROPPED = frozenset("nav header footer aside form button dialog menu fieldset".split())
CONTAINERS = frozenset("body div article main section td center table content".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | DROPPED | HEADINGS | frozenset("p ul ol li dl dt dd tr th tbody thead tfoot caption blockquote pre figure figcaption hr br address details summary html head".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar social share sharing "
    "related recommended popup modal overlay widget login search skip tags contentinfo complementary navigation "
    "comment comments commentlist reply replies disqus respond discussion".split()
)
#: Words beside which a name of boilerplate still is one.
NEUTRAL = frozenset(
    "site page main content body text inner outer top bottom left right center middle first last col column columns row box bar block strip list lists item items link links icon icons button buttons btn "
    "container wrapper wrap section area region panel slot unit zone holder group module component card field form input title heading label message msg policy info primary secondary tertiary global local "
    "mobile desktop sticky fixed floating small large big wide full dark light active hidden open closed default post posts article articles story stories news reading media user reader readers author "
    "thread count counter number js css id bg ui the and of a my your our us by for in on to".split()
)
ARTICLE = frozenset("article articlebody post entry story content main text body".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s>/]*)[^>]*>?|<([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _reads(value: str) -> tuple[bool, bool, int]:
    """Of a class, id or role: is one of its names boilerplate, is one an article's, and how
    many words of boilerplate are in the others."""
    drop, article, words_of_it = False, False, 0
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        bad = sum(w in BOILERPLATE for w in words)
        if bad and all(w in BOILERPLATE or w in NEUTRAL for w in words):
            drop = True
        elif bad:
            words_of_it += bad
        else:
            article = article or not ARTICLE.isdisjoint(words)
    return drop, article, words_of_it


class Page:
    """The kept blocks of a page in order, and for each container its path, the range of
    its blocks and how deep it is. What names say is boilerplate is left out, if they
    count, and blocks with a key in ``repeated``."""

    def __init__(self, source: str, repeated: frozenset = frozenset(), names: bool = True):
        self.blocks: list[str] = []
        self.links: list[int] = []
        self.keys: list[int] = []
        self.found: list[list] = []  # [path, first block, last block + 1, depth, bonus]
        self._marks: list[tuple[bool, bool, bool, bytes]] = []  # per block: repeated, a heading, in an article, its container
        self._read(source or "", repeated, names)
        if any(m[0] for m in self._marks):
            self._without_repeated()

    def _read(self, source: str, repeated: frozenset, by_names: bool) -> None:
        stack: list[tuple[str, bytes, bool, int]] = []  # tag, path, dropped, index in found or -1
        opened: Counter[str] = Counter()
        parts: list[str] = []
        linked, in_link, dropped, heading, lower = 0, False, 0, False, None

        def flush() -> None:
            nonlocal linked
            if parts:
                if text := " ".join("".join(parts).split()):
                    path = stack[-1][1] if stack else b""
                    key = int.from_bytes(hashlib.blake2b(path + text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                    self.blocks.append(text)
                    self.links.append(min(linked, len(text)))
                    self.keys.append(key)
                    self._marks.append((key in repeated, heading, bool(opened["article"] or opened["main"]), path))
                parts.clear()
            linked = 0

        def close() -> None:
            nonlocal dropped
            tag, _, drop, k = stack.pop()
            opened[tag] -= 1
            dropped -= drop
            if k >= 0:
                self.found[k][2] = len(self.blocks)

        position, size = 0, len(source)
        while position < size:
            m = TOKEN.search(source, position)
            end = m.start() if m else size
            if end > position and not dropped:
                text = source[position:end]
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text)
            if not m:
                break
            position = m.end()
            if (tag := m[1]) is not None:
                tag = tag.lower()
                if tag in BLOCKS and not dropped:
                    flush()
                    heading = heading and tag not in HEADINGS
                if tag == "a":
                    in_link = False
                elif opened[tag]:
                    flush()
                    while stack[-1][0] != tag:
                        close()
                    close()
            elif (tag := m[2]) is not None:
                tag = tag.lower()
                if tag in BLOCKS:
                    if not dropped:
                        flush()
                    heading = tag in HEADINGS
                    if stack and stack[-1][0] == "p":
                        close()
                if tag in RAW:
                    if not m[0].rstrip(">").endswith("/") or tag in ("script", "style", "textarea", "title"):
                        lower = source.lower() if lower is None else lower
                        skip = lower.find(f"</{tag}", position)
                        position = size if skip < 0 else skip
                    continue
                if tag == "a":
                    in_link = True
                if tag in VOID:
                    continue
                container = tag in CONTAINERS
                drop, classes, bonus = tag in DROPPED, "", 0.0
                if m[3]:
                    named = article = False
                    for a in ATTRIBUTE.finditer(m[3]):
                        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                        if key == "class":
                            classes = "".join(f".{re.sub(r'[0-9]+', '#', c)}" for c in value.split())
                        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                            drop = True
                        elif key != "style":
                            bad, good, words = _reads(value)
                            named, article, bonus = named or bad, article or good, bonus - 0.1 * words
                    drop = drop or by_names and named and not article and tag not in ("html", "body", "main", "article")
                    bonus += 0.2 * article
                if not container and not drop:
                    continue
                path = hashlib.blake2b((stack[-1][1] if stack else b"") + f">{tag}{classes}".encode(), digest_size=8).digest()
                k = -1
                if container and not drop and not dropped:
                    k = len(self.found)
                    self.found.append([path, len(self.blocks), None, len(stack), bonus + (0.5 if tag in ("article", "main") else 0)])
                if drop and not dropped:
                    flush()
                dropped += drop
                stack.append((tag, path, drop, k))
                opened[tag] += 1
        flush()
        while stack:
            close()

    def _without_repeated(self) -> None:
        n = len(self.blocks)
        upto = list(accumulate((m[0] for m in self._marks), initial=0))
        gone = [False] * n
        for _, start, end, *_ in self.found:  # containers with nothing else
            if 0 < end - start == upto[end] - upto[start] < n:
                gone[start:end] = [True] * (end - start)
        after = None
        for k in range(n - 1, -1, -1):
            again, heading, article, path = self._marks[k]
            gone[k] = gone[k] or again and not article and (not heading or after != path)
            after = after if gone[k] else path
        upto = list(accumulate((not g for g in gone), initial=0))
        for x in self.found:
            x[1], x[2] = upto[x[1]], upto[x[2]]
        self.blocks, self.links, self.keys = ([v for v, g in zip(x, gone, strict=True) if not g] for x in (self.blocks, self.links, self.keys))

    def best(self) -> bytes | None:
        """The path of the best container, or None without text."""
        upto = list(accumulate(map(len, self.blocks), initial=0))
        links = list(accumulate(self.links, initial=0))
        top, path = None, None
        for where, start, end, depth, bonus in self.found:
            if own := upto[end] - upto[start]:
                share = own / upto[-1]
                score = (own - links[end] + links[start]) / upto[-1] + (0.01 * min(depth, 20) + (bonus * (share > 0.3) if bonus > 0 else bonus))
                if top is None or score > top:
                    top, path = score, where
        return path

    def text(self, paths: list[bytes]) -> str:
        """The blocks of the outermost containers of the first path that has any."""
        for path in paths:
            out, last = [], 0
            for where, start, end, *_ in self.found:
                if where == path and start >= last:
                    out += self.blocks[start:end]
                    last = end
            if out:
                return " ".join(out)
        return ""


def parse(source: str, repeated: frozenset = frozenset()) -> Page:
    """A page all of whose blocks repeat is read with them, and one of which names leave
    nothing without names."""
    page = Page(source, repeated)
    if not page.blocks and repeated:
        page = Page(source)
    return page if page.blocks else Page(source, names=False)


def _keys(batches):
    """Per page: the host, what tells it apart, the keys of its blocks."""
    for batch in sliced(batches):
        marks, keys = [], []
        for source in batch.column(1).to_pylist():
            page = parse(source)
            longest = sorted(set(zip(map(len, page.blocks), page.keys, strict=True)), reverse=True)[:3]
            marks.append(hash(tuple(k for _, k in longest)))
            keys.append(sorted(set(page.keys)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["host", "mark", "keys"])


def _vote(batches):
    for batch in sliced(batches):
        paths = [parse(s, frozenset(r or ())).best() for s, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary())], ["host", "path"])


def _extract(batches):
    for batch in sliced(batches, 2):
        texts = []
        for source, repeated, paths in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            page = parse(source, frozenset(repeated or ()))
            texts.append(page.text(paths or []) or (" ".join(page.blocks) if not page.found else page.text([page.best()])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def repeated_blocks(pages: DataFrame, share: float = REPEATED_SHARE, least: int = REPEATED_PAGES) -> DataFrame:
    """host, repeated: the keys of blocks that ``share`` of a host's pages have, and ``least``
    of them. As each is on that share, a host has at most 1/share times the blocks of a page."""
    found = pages.select("host", "html").mapInArrow(_keys, "host string, mark long, keys array<long>")
    single = materialise(found.groupBy("host", "mark").agg(F.max("keys").alias("keys")), "page-blocks")
    on = single.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    often = on.join(single.groupBy("host").agg(F.count("*").alias("pages")), "host").filter(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("repeated"))


def _beside(pages: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """Pages with what is known of their host; a large table of hosts is joined by salts, so
    that a hot host is dealt to ``SALTS`` parts."""
    if small:
        return pages.join(F.broadcast(known), "host", "left")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return salted.join(known.withColumn("salt", salts), ["host", "salt"], "left")


def winning_paths(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, paths of (host, html, repeated): most voted first. A page without text has no vote."""
    votes = pages.select("host", "html", "repeated").mapInArrow(_vote, "host string, path binary").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    ranked = votes.withColumn("share", share).filter(F.col("share") >= least_share)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame, least_share: float = LEAST_SHARE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty html, or one without text, has an empty text; a null url or one
    without a host counts as one host of its own; repeated rows are kept, vote each and
    count as one page of their host's blocks; an empty table gives no rows; other columns
    are ignored. Page texts are shuffled only if there are more than ``broadcast_hosts``
    hosts; a hot one is then dealt to ``SALTS`` parts.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    df = pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    repeated = materialise(repeated_blocks(df), "page-repeated")
    hosts, keys = repeated.agg(F.count("*"), F.coalesce(F.sum(F.size("repeated")), F.lit(0))).first()
    winners = materialise(winning_paths(_beside(df, repeated, hosts <= broadcast_hosts and keys <= BROADCAST_KEYS), least_share), "page-winners")
    known = winners.join(repeated, "host", "full")
    joined = _beside(df, known, max(hosts, winners.count()) <= broadcast_hosts and keys <= BROADCAST_KEYS)
    out = joined.select("page_id", "url", "html", "repeated", "paths").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
