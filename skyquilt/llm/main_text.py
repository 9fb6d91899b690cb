"""Main text of HTML pages, by the substrings that the pages of a host share.

Pages are read into blocks. Menus, headers, footers, sidebars, notices, adverts, forms and comment sections are left
out by their markup; scripts, styles and markup comments are no blocks at all. What remains of a page is two token
streams, its article and the text outside of it. The suffixes of all streams of a host are dealt out by the hash of
host and first RUN tokens, which brings equal heads together as sorting a suffix array would, for a host of any size;
each head is counted by the distinct pages that hold it. A run of tokens under heads that stand on enough pages is
boilerplate: outside an article two pages and OUTSIDE_SHARE of the host's pages, inside an article more than
ARTICLE_SHARE of the host's different articles (ARTICLE_PAGES at least), so that copied articles survive. A block of
which COVERED is such a run is left out; unique runs are kept.

Outside of articles all suffixes are counted; of an article's those at both ends of a block, and those with the least
hash among SPACING neighbours, which lie at the same places in equal text. Between two neighbouring counted suffixes
that are both common, all tokens are.

The heads that are boilerplate are at most 1 / share times the suffixes of a page, for each host. They are joined to
the pages by broadcast where all hosts have at most BROADCAST_HEADS together, else by a shuffle.

Defined results: null and empty html, and pages without a block, give empty text; a null url counts as an
empty host; markup that breaks off ends the page; repeated rows give repeated rows and count as one page; the result
does not depend on how rows are dealt to tasks; ids pass as they are; an empty table gives an empty result; only
page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .similar import WordHashes, mixed

RUN = 8
SPACING = 16
HOST_BITS = 44
COVERED = 0.8
ARTICLE_PAGES = 10
ARTICLE_SHARE = 0.5
OUTSIDE_SHARE = 0.01
BROADCAST_HEADS = 500_000
# Elements without main text, elements that do not break a line of text, and words in class or id.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select svg menu dialog object canvas textarea head title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent banner notice sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies related share social newsletter subscribe popup modal widget".split())
MAIN = frozenset(("article", "main"))
RAW = re.compile(r"<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*)?((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
START = re.compile(r"<(?:[a-zA-Z/!?])")
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, is furniture, is in the article) of each block, in page order."""
    page = RAW.sub(" ", page)
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    at = 0

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, *state()))

    while True:
        found = START.search(page, at) if at < len(page) else None
        if found is None:
            parts.append(page[at:])
            break
        parts.append(page[at : found.start()])
        m = MARKUP.match(page, found.start())
        if m is None or m.end() == m.start():  # a quote that never ends
            stop = page.find(">", found.start())
            at = len(page) if stop < 0 else stop + 1
            continue
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if closing in ("!", "?") or not name or name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name not in VOID and not (m[3] or "").endswith("/"):
            furniture, article = state()
            named = {w for g in NAMED.findall(m[3] or "") for w in re.split(r"[\s_-]+", "".join(g).lower())}
            furniture = furniture or name in DROPPED or (name == "header" and not article) or (name not in MAIN | {"body", "html"} and bool(named & FURNITURE))
            if name in ("p", "li") and stack and stack[-1][0] == name:
                stack.pop()
            stack.append((name, furniture, article or name in MAIN))
    flush()
    return out


def heads(words: list[str], host: int, hashes: WordHashes) -> np.ndarray:
    """A hash of the host and the first RUN tokens of each suffix that has so many."""
    n = len(words) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter((hashes[t.encode("utf-8", "surrogatepass")] for t in words), np.uint64, len(words))
    h = np.full(n, host, np.uint64)
    for i in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mixed(h)


def spaced(h: np.ndarray) -> np.ndarray:
    """Positions of the least hash of every SPACING neighbours."""
    if len(h) <= SPACING:
        return np.array([h.argmin()] if len(h) else [], np.int64)
    window = np.lib.stride_tricks.sliding_window_view(h, SPACING)
    return np.unique(window.argmin(axis=1) + np.arange(len(window)))


class Page:
    """The blocks of a page that are no furniture, in two streams: inside (True) and outside (False) the article."""

    def __init__(self, html: str, host: int, hashes: WordHashes):
        self.blocks = [(text, text.count(" ") + 1, main) for text, furniture, main in blocks(html) if not furniture]
        self.size, self.heads, self.places = {}, {}, {}
        for main in (True, False):
            words = [w for text, _, m in self.blocks if m == main for w in text.split(" ")]
            h = heads(words, host + main, hashes)
            ends = np.cumsum([n for _, n, m in self.blocks if m == main] or [0])
            anchors = np.concatenate([[0], ends[:-1], ends - RUN])
            self.size[main], self.heads[main] = len(words), h
            self.places[main] = np.unique(np.concatenate([spaced(h), anchors[(anchors >= 0) & (anchors < len(h))]])) if main else np.arange(len(h))

    def counted(self, main: bool) -> np.ndarray:
        return self.heads[main][self.places[main]]

    def stream(self, main: bool) -> int:
        """A hash of a whole stream, of 32 bits."""
        h = self.heads[main]
        factors = 2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1)
        return int(mixed(np.array([self.size[main]], np.uint64) + (h * factors).sum(dtype=np.uint64))[0]) & 0x7FFFFFFF

    def text(self, common: np.ndarray) -> str:
        """The blocks that common heads do not cover."""
        covered = {}
        for main in (True, False):
            places, here = self.places[main], np.zeros(self.size[main] + 1, np.int64)
            hit = np.isin(self.counted(main), common)
            stop = places + RUN
            stop[:-1][hit[:-1] & hit[1:]] = np.maximum(stop[:-1], places[1:])[hit[:-1] & hit[1:]]
            np.add.at(here, places[hit], 1)
            np.add.at(here, stop[hit], -1)
            covered[main] = np.cumsum(here)[:-1] > 0
        at, kept = {True: 0, False: 0}, []
        for text, size, main in self.blocks:
            if covered[main][at[main] : at[main] + size].mean() < COVERED:
                kept.append(text)
            at[main] += size
        return " ".join(kept)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    number = F.shiftrightunsigned(F.xxhash64(host), 64 - HOST_BITS).bitwiseAND(F.lit((1 << HOST_BITS) - 2))
    return pages.select("page_id", "url", number.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def common_heads(pages: DataFrame) -> DataFrame:
    """(host, heads array<long>): the boilerplate heads of each host that has any. pages: host (long) and html."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                page = Page(html.as_py(), host, hashes)
                for main in (True, False):
                    if page.size[main]:
                        found = np.concatenate([np.zeros(1, np.uint64), np.unique(page.counted(main))])  # zero stands for the stream itself
                        for column, values in zip(columns, (np.full(len(found), host + main, np.int64), found.view(np.int64), np.full(len(found), page.stream(main), np.int64))):
                            column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["stream_of", "head", "stream"])

    rows = pages.select("host", "html").mapInArrow(emitted, "stream_of long, head long, stream long")
    counted = cut(rows.groupBy("stream_of", "head").agg(F.countDistinct("stream").alias("n")).filter("n >= 2"))
    sizes = counted.filter("head = 0").select("stream_of", F.col("n").alias("every"))
    article = F.col("stream_of") % 2 == 1
    enough = F.when(article, (F.col("every") >= ARTICLE_PAGES) & (F.col("n") > ARTICLE_SHARE * F.col("every"))).otherwise(F.col("n") >= OUTSIDE_SHARE * F.col("every"))
    found = counted.filter("head <> 0").join(sizes, "stream_of").filter(enough)
    return found.groupBy((F.col("stream_of") - F.col("stream_of") % 2).alias("host")).agg(F.collect_list("head").alias("heads"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = []
            for host, html, common in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("heads")):
                if common.is_valid:
                    texts.append(Page(html.as_py(), host, hashes).text(common.values.to_numpy().view(np.uint64)))
                else:
                    texts.append(" ".join(text for text, furniture, _ in blocks(html.as_py()) if not furniture))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    dealt = _with_host(pages)
    found = cut(common_heads(dealt))
    total = found.agg(F.sum(F.size("heads"))).first()[0] or 0
    numbered = dealt.join(F.broadcast(found) if total <= BROADCAST_HEADS else found, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return numbered.select("page_id", "url", "host", "html", "heads").mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir):
    """op10: main text of the whole of pages."""
    return main_text(table(spark, sf_dir, "pages"))
