"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold, and the page votes for the path of its best one; Spark counts
votes per host and path. A path is the container's tags and classes from the body down, generalised: digits in class
names go, equal neighbours become one. Each page is then read again with the paths its host agreed on, and its text is
taken from the container with most votes. So a page whose comments or adverts outweigh its article still follows the
other pages of its host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import BROADCAST_BYTES, stage

# Kinds of elements of the HTML language, and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
CONTAINERS = frozenset("body main article section div td th center".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption dd details dialog dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li menu nav ol optgroup option p pre search summary table tbody tfoot thead tr ul".split()
)
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog footer head iframe menu nav noframes noscript object script search select style svg template textarea title video xmp".split()
)
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising advertorial adunit banner banners breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation navi newsletter "
    "notice notices notification overlay pager pagination paginator popup promo promos promotion recommended recommendations related replies reply "
    "respond responses search share sharebar sharing sidebar sidebars signin signup social sponsor sponsored sponsors subscribe subscription toolbar "
    "topbar widget widgets".split()
)
ADVERTS = frozenset("ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising adunit sponsor sponsored sponsors".split())
COMMENTS = frozenset("comment comments commentlist replies reply respond responses".split())
STATES = frozenset("has have with without no not is layout enabled disabled open closed template theme".split())
CONTENT = frozenset("article blog body content entry main post story text".split())
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
CLOSES_UP_TO = frozenset("ul ol dl table body article section div main td th".split())

LEAST_SHARE = 16  # a path counts for its host from one vote in so many, so a host has this many paths at most
_STEPS, _STEP_CHARS = 12, 80  # a path names its last steps; a longer step is named by its digest
_HEAVY_HOSTS, _HEAVY_BYTES = 4096, 8192

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_KEEP, _FORM, _DROP = 0, 1, 2


@dataclass(slots=True)
class Container:
    """An element that may hold the main text. ``own`` is the weight of the text directly in it."""

    parent: int
    tag: str
    steps: tuple[str, ...]
    worth: float
    own: float = 0.0

    @property
    def path(self) -> str:
        return "/".join(self.steps)


@dataclass(slots=True)
class Page:
    containers: list[Container] = field(default_factory=lambda: [Container(-1, "", (), 1.0)])
    blocks: list[tuple[int, int, str]] = field(default_factory=list)  # container, level, text

    def shares(self) -> dict[str, float]:
        """Each path's best score as a share of the page's text."""
        around, within = [c.own for c in self.containers], [c.own for c in self.containers]
        for k in range(len(self.containers) - 1, 0, -1):
            up = self.containers[k].parent
            around[up] += around[k] / 2
            within[up] += within[k]
        whole, best = within[0], {}
        for c, near, full in zip(self.containers, around, within, strict=True):
            score = 2.0 * full if c.tag == "article" else 1.6 * full if c.tag == "main" else near * c.worth
            best[c.path] = max(best.get(c.path, 0.0), score / whole if whole else 0.0)
        return best

    def text(self, path: str) -> str:
        """Blocks below the containers of ``path``, one a line. Text in forms counts only where there is no other."""
        inside: list[bool] = []
        for c in self.containers:
            inside.append(c.path == path or (c.parent >= 0 and inside[c.parent]))
        own = [(level, text) for at, level, text in self.blocks if inside[at]]
        least = min((level for level, _ in own), default=_KEEP)
        return "\n".join(text for level, text in own if level == least)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]))
    return found


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)}


def _level(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """Whether an element's text may be main text."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return _DROP
    if tag in ("body", "html", "main"):
        return _KEEP
    if "-" in tag and _words(tag) & BOILERPLATE:
        return _DROP
    if not attributes:
        return _FORM if tag == "form" else _KEEP
    kinds = COMMENTS if tag == "article" else BOILERPLATE if tag in BLOCKS or "-" in tag else ADVERTS
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = _words(name)
        if words & kinds and not words & STATES:
            return _DROP
        if "header" in words and not in_article and tag in BLOCKS and not words & (CONTENT | STATES):
            return _DROP
    if tag != "article" and attributes.get("role", "").strip().lower() in OUTSIDE_ROLES:
        return _FORM if tag == "form" else _DROP
    return _FORM if tag == "form" else _KEEP


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes of one element, without digits."""
    names = sorted({re.sub(r"[\d_-]+$", "", re.sub(r"\d+", "", c.lower())) for c in attributes.get("class", "").split()} - {""})
    step = ".".join([tag, *names]).replace("/", "|")
    return step if len(step) <= _STEP_CHARS else f"{tag}.{hashlib.sha256(step.encode('utf-8', 'replace')).hexdigest()[:16]}"


class _Reader:
    """Reads one page's tags into containers and blocks; unclosed and misplaced tags end where browsers would end them."""

    def __init__(self) -> None:
        self.page = Page()
        # open elements: tag, container, level, in an article (or what is called one), in a link
        self.open: list[tuple[str, int, int, bool, bool]] = [("", 0, _KEEP, False, False)]
        self.named: Counter[str] = Counter()
        self.chunks: list[str] = []
        self.where = (0, _KEEP)  # container and level of the block that is being read
        self.linked = 0

    def text(self, source: str) -> None:
        _, at, level, _, in_link = self.open[-1]
        if level < _DROP:
            chunk = html.unescape(source) if "&" in source else source
            if not self.chunks:
                self.where = at, level
            self.chunks.append(chunk)
            if in_link:
                self.linked += len(chunk)

    def flush(self) -> None:
        if self.chunks:
            text = " ".join("".join(self.chunks).split())
            if text:
                at, level = self.where
                self.page.blocks.append((at, level, text))
                if level == _KEEP:
                    self.page.containers[at].own += max(len(text) - 0.9 * self.linked, 0.1)
            self.chunks, self.linked = [], 0

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.named[self.open.pop()[0]] -= 1

    def start(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.named["p"]:
                self.end_before("p", CONTAINERS | {"button"})
            for other in CLOSES.get(tag, ()):
                if self.named[other]:
                    self.end_before(other, CLOSES_UP_TO - {other})
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        _, at, level, in_article, in_link = self.open[-1]
        attributes = _attributes(source) if "=" in source else {}
        level = max(level, _level(tag, attributes, in_article))
        in_article = in_article or tag == "article"
        if tag in CONTAINERS and level < _DROP:
            steps, step = self.page.containers[at].steps, _step(tag, attributes)
            worth = 1.5 if attributes and _words(f"{attributes.get('class', '')} {attributes.get('id', '')}") & CONTENT else 1.0
            in_article = in_article or (worth > 1 and tag not in ("body", "main"))
            if attributes.get("role", "").strip().lower() in ("main", "article"):
                worth = 2.0
            self.page.containers.append(Container(at, tag, steps if steps[-1:] == (step,) else (*steps, step)[-_STEPS:], worth))
            at = len(self.page.containers) - 1
        self.open.append((tag, at, level, in_article, in_link or tag == "a"))
        self.named[tag] += 1

    def end_before(self, tag: str, bounds: frozenset[str]) -> None:
        """Ends the innermost open ``tag`` unless one of ``bounds`` was opened inside it."""
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.close(depth)
                return
            if self.open[depth][0] in bounds:
                return

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not self.named[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.close(depth)
                return
            if tag not in BLOCKS and self.open[depth][0] in BLOCKS:
                return


def read_page(source: str) -> Page:
    """Containers and text blocks of a page, in page order."""
    reader, at, quoted, size = _Reader(), 0, True, len(source)
    while at < size:
        sign = source.find("<", at)
        if sign < 0:
            reader.text(source[at:])
            break
        if sign > at:
            reader.text(source[at:sign])
        if source.startswith("<!--", sign):
            end = source.find("-->", sign + 2)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(source, sign + 1)
        if name is None:
            if source[sign + 1 : sign + 2] in ("!", "?", "/"):
                end = source.find(">", sign)
                at = size if end < 0 else end + 1
            else:
                reader.text("<")
                at = sign + 1
            continue
        tag = name[1].lower()
        rest = _REST.match(source, name.end()) if quoted else None
        if rest is None:  # an open quote: from here on tags end at the next sign
            quoted = False
            end = source.find(">", name.end())
            if end < 0:
                break  # cut off inside a tag
            at = end + 1
        else:
            at = rest.end()
        if source[sign + 1] == "/":
            reader.end(tag)
            continue
        reader.start(tag, source[name.end() : at - 1])
        if tag in RAW:
            end_tag = _RAW_END[tag].search(source, at)
            at = end_tag.start() if end_tag else size
    reader.flush()
    return reader.page


def best_path(shares: dict[str, float]) -> str:
    """The page's own choice; of equal ones the first in the page."""
    return max(shares, key=shares.__getitem__)


def _votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vote of each page with text: its host and its best path."""
    for batch in batches:
        hosts, paths = [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            shares = read_page(source.as_py() or "").shares()
            path = best_path(shares)
            if shares[path]:
                hosts.append(host)
                paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])


def chosen_path(page: Page, votes: dict[str, int]) -> str:
    """Of the page's paths the one with most votes, equal ones by their score; the page's own best has one vote at least.

    A path inside that one is taken instead if it has at least half as many votes: pages of a host that are bare text
    vote for the body, which every page has.
    """
    shares = page.shares()
    own = best_path(shares)
    standing = {p: (max(votes.get(p, 0), int(p == own)), share) for p, share in shares.items()}
    chosen = max(standing, key=standing.__getitem__)
    while inner := [p for p in standing if p != chosen and p.startswith(f"{chosen}/" if chosen else "") and standing[p][0] * 2 >= standing[chosen][0] > 0]:
        chosen = max(inner, key=standing.__getitem__)
    return chosen


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for source, paths in zip(part.column("html"), part.column("paths").to_pylist(), strict=True):
                page = read_page(source.as_py() or "")
                texts.append(page.text(chosen_path(page, {p["path"]: p["votes"] for p in paths or ()})))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit("")))


PATHS = "array<struct<votes:bigint,path:string>>"


def host_paths(pages: DataFrame, least_share: int = LEAST_SHARE) -> DataFrame:
    """(host, pages, paths) of each host: its paths with at least one vote in ``least_share``, most votes first."""
    own = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).filter("host <> ''")
    votes = stage(own.mapInArrow(_votes, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "html-votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("pages"))
    agreed = votes.join(totals, "host").filter(F.col("votes") * least_share >= F.col("pages"))
    listed = F.sort_array(F.collect_list(F.struct("votes", "path")), asc=False).cast(PATHS).alias("paths")
    return agreed.groupBy("host", "pages").agg(listed)


def _with_paths(own: DataFrame, agreed: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``own`` (host, html, ...) with its host's paths.

    Within the broadcast bound one join does. Beyond it the hosts with over 1 / 4096 of all pages (so fewer than 4 096, of
    at most 8 kB each) are broadcast, pages without host need none, and the other pages are joined by a shuffle in which no
    host is large.
    """
    rows, size, pages = agreed.agg(F.count(F.lit(1)), F.sum(_path_bytes()), F.sum("pages")).first()
    paths = agreed.select("host", "paths")
    if 64 * rows + (size or 0) <= broadcast_bytes:
        return own.join(F.broadcast(paths), "host", "left")
    heavy = F.broadcast(agreed.filter((F.col("pages") * _HEAVY_HOSTS > pages) & (_path_bytes() <= _HEAVY_BYTES)).select("host", "paths"))
    alone = own.filter("host = ''").withColumn("paths", F.lit(None).cast(PATHS))
    light = own.filter("host <> ''").join(heavy, "host", "left_anti").join(paths, "host", "left")
    return own.join(heavy, "host").unionByName(light).unionByName(alone)


def _path_bytes() -> Column:
    return F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["path"]) + 16)


def main_texts(pages: DataFrame, least_share: int = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``, repeated rows as often as they come.

    Null and empty pages, and pages without main text, have the empty text. A page without host, and one whose host agrees
    on no path that it has, takes its own best container. A block is the text between two block-level tags; <br> is white
    space. Nothing is capped: n_chars counts all code points of the text.
    """
    agreed = stage(host_paths(pages, least_share), "html-paths")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    found = _with_paths(own, agreed, broadcast_bytes).select("page_id", "url", "html", "paths").mapInArrow(_texts, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
