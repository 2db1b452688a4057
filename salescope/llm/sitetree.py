"""HTML extraction (operator 4) with site style trees.

The pages of a host are merged by the paths of their elements. An element of
the merged tree matters if its pages show it in different ways: the entropy of
its child sequences (presentation) and of its texts (content) over the pages
is its importance. Branches of low importance are removed from each page, as
are elements that say themselves that they are menus, footers or the like.
Single blocks are judged too, inside the article as elsewhere: one that most of
the host's distinct pages show in the same place is removed. What is left of the
article, or else of the body, is the text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .urlfilter import url_host

#: Elements of less importance are removed; hosts with fewer pages are not judged.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 4
#: A block on more than this share of its host's distinct pages is removed.
MOST = 0.5
#: Weight of content against presentation.
GAMMA = 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_KNOWN_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu "
    "meta nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title "
    "tr ul script style iframe template".split()
)
#: Elements that are no main text, wherever they stand.
_DROPPED = frozenset(
    "head script style noscript template textarea title iframe nav footer aside form button select option dialog svg "
    "canvas audio video object menu noembed noframes xmp math".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
_HINTS = frozenset(
    "ad ads adslot adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted promotion related replies respond share sharing sidebar "
    "signup social sponsor sponsored sponsors subscribe toolbar widget".split()
)
_ROOTS = frozenset(("html", "body", "main", "article"))
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
#: Plain text elements of an article are not judged as elements, but by the block.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def _is_inline(tag: str) -> bool:
    """Unknown elements are inline, as browsers show them."""
    return tag in _INLINE or tag not in _KNOWN_BLOCKS


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _hidden(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_main):
        return True
    if not attributes or tag in _ROOTS:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if named == " " or tag in _PROSE - {"ul", "ol", "table"} and in_main and "comment" not in named.lower():
        return False
    return any(t in _HINTS for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))


def _hash(*parts: str) -> int:
    raw = "\0".join(parts).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


class Page:
    """The blocks of a page, and its elements that the site may judge."""

    def __init__(self, source: str):
        # text, inside the article, judged paths, path of the element that holds it
        self.blocks: list[tuple[str, bool, tuple[str, ...], str]] = []
        self.children: dict[str, list[str]] = {}
        self._buffer: list[str] = []
        # tag, dropped, inside the article, path, judged paths from the body on
        self._stack: list[tuple[str, bool, bool, str, tuple[str, ...]]] = [("", False, False, "", ())]
        self._parse(source)
        self._flush()

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                _, _, in_main, path, judged = self._stack[-1]
                self.blocks.append((text, in_main, judged, path))

    def _open(self, tag: str, raw: str) -> None:
        if tag in _CLOSES_P and any(f[0] == "p" for f in self._stack):
            self._close("p")
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            for frame in reversed(self._stack):
                if frame[0] in within:
                    break
                if frame[0] in ends.split():
                    self._close(frame[0])
                    break
        inline = _is_inline(tag)
        if not inline:
            self._flush()
        if tag in _VOID:
            return
        _, dropped, in_main, path, judged = self._stack[-1]
        attributes = _attributes(raw)
        if not inline:
            here = f"{path}/{tag}"
            if attributes:
                here += "".join(f".{x}" for x in sorted(re.sub("[0-9]{2,}", "0", f"{attributes.get('class', '')} {attributes.get('id', '')}").split()))
            self.children.setdefault(path, []).append(here[len(path) + 1 :])
        else:
            here = path
        dropped = dropped or _hidden(tag, attributes, in_main)
        in_main = in_main or tag in ("article", "main") or attributes.get("role") == "main"
        if not (dropped or inline or tag in _ROOTS or (in_main and tag in _PROSE)):
            judged = (*judged, here)
        self._stack.append((tag, dropped, in_main, here, judged))

    def _close(self, tag: str) -> None:
        if not _is_inline(tag):
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                self._flush() if any(not _is_inline(f[0]) for f in self._stack[i:]) else None
                del self._stack[i:]
                return
            if self._stack[i][0] in _ROOTS and tag in _INLINE:
                return

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            end = m.start() if m else n
            if end > at and not self._stack[-1][1]:
                self._buffer.append(source[at:end])
            if not m:
                return
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            raw = m[3] if m[2] else m[6]
            self._open(tag, raw or "")
            if tag in _RAW:
                stop = re.compile(rf"</{tag}", re.I).search(source, at)
                at = stop.start() if stop else n

    def text(self, low: frozenset[str] = frozenset(), repeated: frozenset[int] = frozenset()) -> str:
        """The blocks that are not repeated and outside branches of low importance
        (all, if none is left), inside the article if the page has one."""
        kept = [b for b in self.blocks if not low.intersection(b[2])]
        if repeated:
            kept = [b for b in kept if _hash(b[3], b[0]) not in repeated]
        kept = kept or self.blocks
        kept = [b for b in kept if b[1]] or kept
        return "\n".join(b[0] for b in kept)

    def elements(self) -> dict[str, tuple[int, list[int]]]:
        """path -> (hash of the child sequence, hashes of the texts of the branch)."""
        out: dict[str, tuple[int, list[int]]] = {}
        for text, _, judged, _ in self.blocks:
            h = zlib.crc32(text.encode("utf-8", "replace"))
            for path in judged:
                if path not in out:
                    out[path] = (zlib.crc32(" ".join(self.children.get(path, [])).encode("utf-8", "replace")), [])
                if h not in out[path][1]:
                    out[path][1].append(h)
        return out


SHOWN = (
    "page_key string, host string, shown long, blocks array<long>, "
    "elements array<struct<path: string, style: bigint, texts: array<bigint>>>"
)


def site_pages(pages: DataFrame) -> DataFrame:
    """page_key, host, shown, blocks and elements of the pages that have text: a hash
    of all that the page shows, one of each (place, text) of it, and path, style and
    texts of its elements that can be judged."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        element = pa.struct([("path", pa.string()), ("style", pa.int64()), ("texts", pa.list_(pa.int64()))])
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(element)]
        names = ["page_key", "host", "shown", "blocks", "elements"]
        for batch in batches:
            rows = []
            for key, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_key", "host", "html")), strict=True):
                page = Page(source or "")
                found = [_hash(b[3], b[0]) for b in page.blocks]
                if found:
                    elements = [{"path": p, "style": s, "texts": t} for p, (s, t) in page.elements().items()]
                    rows.append((key, host, _hash(*map(str, found)), list(dict.fromkeys(found)), elements))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return pages.select("page_key", "host", "html").mapInArrow(parse, SHOWN)


def distinct_pages(seen: DataFrame) -> DataFrame:
    """host, blocks and elements; the pages of a host that show the same are one."""
    one = seen.groupBy("host", "shown").agg(F.min("blocks").alias("blocks"), F.min("elements").alias("elements"))
    return one.select("host", "blocks", "elements")


def repeated_blocks(distinct: DataFrame, most: float, pages: int) -> DataFrame:
    """(host, block) that more than ``most`` of the host's distinct pages show."""
    hosts = distinct.groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") >= pages)
    counts = distinct.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("c"))
    # m is at least ``pages``, so most counts go before the join
    return counts.where(F.col("c") > most * pages).join(hosts, "host").where(F.col("c") > most * F.col("m")).select("host", "block")


def unimportant(elements: DataFrame, gamma: float, least: float, pages: int) -> DataFrame:
    """(host, path) of the merged elements of less importance than ``least``.

    With m pages that hold the element, presentation is the entropy of its child
    sequences to the base m; content is one less the mean, over the texts shown,
    of the entropy of a text over the pages, log(pages with it) / log(m).
    """
    key = ["host", "path"]
    styles = elements.groupBy(*key, "style").agg(F.count("*").alias("c"))
    shown = styles.groupBy(*key).agg(
        F.sum("c").alias("m"), (F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h")
    )
    texts = elements.select(*key, F.explode("texts").alias("t")).groupBy(*key, "t").agg(F.count("*").alias("c"))
    content = texts.groupBy(*key).agg((F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("same"))
    importance = (1 - gamma) * F.col("h") / F.log("m") + gamma * (1 - F.col("same") / F.log("m"))
    return shown.where(F.col("m") >= pages).join(content, key).where(importance < least).select(*key)


def extract(
    pages: DataFrame, gamma: float = GAMMA, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, most: float = MOST
) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks are joined by line breaks; white space inside a block is one space.
    Null and empty html give an empty text. Plain text elements of an article go
    by the block, where most distinct pages of the host show it; where all text of a
    page is of low importance it is kept. Repeated rows are extracted each; pages of a
    host that show the same count once. Elements on fewer than ``least_pages`` distinct
    pages, and blocks of hosts with fewer, are not judged.

    Statistics are aggregated by (host, path, value) with map-side combination, so
    a host with a third of all pages is many small groups. Pages learn of their
    unimportant elements by a join on the page, not on the host.
    """
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        url_host(F.col("url")).alias("host"),
        F.sha2(F.concat_ws("\u0001", F.col("page_id").cast("string"), "url", "html").cast("binary"), 256).alias("page_key"),
    )
    seen = write_table(site_pages(keyed), "seen")
    elements = seen.select("page_key", "host", F.explode("elements").alias("e")).select("page_key", "host", "e.*")
    distinct = write_table(distinct_pages(seen), "distinct")
    judged = distinct.select("host", F.explode("elements").alias("e")).select("host", "e.*")
    low = write_table(unimportant(judged, gamma, least, least_pages), "low")
    repeated = write_table(repeated_blocks(distinct, most, least_pages), "repeated")
    blocks = seen.select("page_key", "host", F.explode("blocks").alias("block"))
    marks = (
        elements.join(low, ["host", "path"]).select("page_key", "path", F.lit(None).cast("long").alias("block"))
        .unionAll(blocks.join(repeated, ["host", "block"]).select("page_key", F.lit(None).cast("string"), "block"))
    )
    marked = write_table(
        marks.groupBy("page_key").agg(F.collect_set("path").alias("low"), F.collect_set("block").alias("repeated")), "marked"
    )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                Page(source or "").text(frozenset(low or ()), frozenset(repeated or ()))
                for source, low, repeated in zip(*(batch.column(c).to_pylist() for c in ("html", "low", "repeated")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(found, pa.string()),
                    pa.array([len(t) for t in found], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    # the marked pages are a written table, so their size is known when this join is planned
    return (
        keyed.join(marked, "page_key", "left")
        .select("page_id", "url", "html", "low", "repeated")
        .mapInArrow(texts, "page_id long, url string, text string, n_chars long")
    )
