"""HTML extraction: markup roles, and a suffix array over each host's page token streams.

A page is read into blocks of text with roles told by its markup: **main** inside an
article (or the page's main element), **chrome** inside menus, headers, footers, sidebars,
forms, adverts, notices and reader comments, **open** elsewhere. All the blocks' words make
the page's token stream: the words outside the article, then those inside, with a cut
between. Streams of a host are concatenated and their suffixes sorted: a string of at least
``LONG`` words that stands outside the article on two different pages of the host is
boilerplate, and every word it covers on any page, in an article or not, is repeated. What
repeated words leave is the text the suffix array proposes.

An exact check by the markup follows. It puts back what is repeated inside an article, as
an article that uses a phrase of the footer is to be kept whole, and takes away unique words
of chrome, which repeat no string where they differ from page to page. So a page with an
article keeps all of it and nothing else; one without keeps what repeated words leave of its
open blocks. Articles have no vote on what is boilerplate: an unmarked page that holds an
article's text would lose it.

A host may hold most pages, so no task gets a host. The smallest hash of the six-word
strings in each window of ``LONG`` words is the window's anchor, and every string of
``LONG`` words holds one wherever it stands. Pages tell their anchors, which are stored, and of those
outside articles the pages are combined before they are shuffled; only anchors that stand there on
different pages can hold boilerplate, and pages hear which of theirs do. A segment, the words around such an
anchor that its windows can reach, goes to the anchor's task; equal segments of a host are one
row before that, whatever the number of pages. A task sorts the suffixes of its segments, and
runs of suffixes that share ``LONG`` words and come from different pages are the repeated
strings. An anchor with over ``SEGMENTS`` different segments is dealt out by single windows
instead, as grouped minima and maxima. Pages whose whole words are the same count as one
page, so a page served twice doesn't erase itself. Texts travel twice, as compressed blocks:
to the anchors heard, and to the repeated strings.

Defined results: null or empty html gives an empty text; a page of any length is read
whole; repeated rows each return a row; an empty table gives an empty result; a null url
is a host of its own (""), and so is one without a host. Other columns may have any name.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mixed, prefix_hash, sliced, span_hash, stored, table, word_spans

LONG, ANCHOR, SEGMENTS = 12, 6, 20_000
MAIN, CHROME, OPEN = 2, 1, 0

# Elements of the HTML standard by what they are to a reader.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_UNSEEN = frozenset("head template noscript svg math object audio video canvas map datalist select button".split())
_CHROME = frozenset("nav footer aside form menu dialog search fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An element that starts ends an open one of these, if nothing in the second set is between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}
#: Words of class and id names, and roles, that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets related recommended recommendations share sharing social footer header masthead topbar toolbar comment comments reply replies disqus respond pagination pager login search skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_INSIDE = MARKS - {"header", "masthead", "rail", "skip"}  # an article has headings of its own
_WITHOUT = frozenset("has with without no is".split())  # has-sidebar is no sidebar
_COMMENTS = frozenset("comment comments reply replies disqus respond ad ads advert sponsored promo teaser related".split())

_PIECE = re.compile(
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"  # comments and what counts as such
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|[\"'][^>]*(?:>|\Z))"  # a tag, perhaps with a quote left open
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME_WORDS, _LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[A-Za-z]+")


@dataclass(slots=True)
class _Open:
    name: str
    role: int | None  # None: not seen at all


@dataclass(slots=True)
class Page:
    """Blocks of a page in order: texts with single spaces, and their roles."""

    texts: list[str] = field(default_factory=list)
    roles: list[int] = field(default_factory=list)

    def main(self) -> list[str]:
        return [t for t, r in zip(self.texts, self.roles) if r == MAIN]


def _marked(names: str, marks: frozenset[str]) -> bool:
    for one in names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(one) + _LETTERS.findall(one)]  # siteNav: site, nav, sitenav
        if words and words[0] not in _WITHOUT and not marks.isdisjoint(words):
            return True
    return False


@functools.lru_cache(maxsize=4096)
def _role(name: str, attributes: str, above: int | None) -> int | None:
    """What an element is, inside one of role ``above``."""
    if above is None or name in _UNSEEN or name in _RAW:
        return None
    if above == CHROME or name in _CHROME or name == "header" and above != MAIN:
        return CHROME
    if attributes and not attributes.isspace():
        given = {k.lower(): references.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
            return None
        role = given.get("role", "").lower()
        if role in _ROLES:
            return CHROME
        names = f"{given.get('class', '')} {given.get('id', '')}"
        if name in ("article", "main"):
            if _COMMENTS & {w.lower() for w in names.split()}:
                return CHROME
        elif name not in ("html", "body") and _marked(names, _INSIDE if above == MAIN else MARKS):
            return CHROME
        if role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody":
            return MAIN
    return MAIN if name in ("article", "main") else above


def read(source: str) -> Page:
    """The blocks of a page. Never fails: what isn't well formed is read as browsers do, roughly."""
    page, stack, part, at = Page(), [_Open("", OPEN)], [], 0

    def flush(role: int | None) -> None:
        if part and role is not None:  # what stands before something unseen goes on behind it
            text = " ".join("".join(part).split())
            part.clear()
            if text:
                page.texts.append(text)
                page.roles.append(role)

    def close(to: int) -> None:
        for e in reversed(stack[to:]):
            if e.name in _BLOCK or e.role != stack[to - 1].role:
                flush(e.role)
            stack.pop()

    lower, size = None, len(source)
    while at < size:
        start = source.find("<", at)
        end = size if start < 0 else start
        if end > at and stack[-1].role is not None:
            part.append(references.unescape(source[at:end]))
        if start < 0:
            break
        m = _PIECE.match(source, start)
        if not m:  # a plain "<", as in a < b
            if stack[-1].role is not None:
                part.append("<")
            at = start + 1
            continue
        at, name = m.end(), m[1]
        if name is None:
            continue
        name = name.lower()
        if source[start + 1] == "/":
            block = name in _BLOCK
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if not block and stack[k].name in _BLOCK:
                    break
            else:
                if block:
                    flush(stack[-1].role)
            continue
        if name in _VOID:
            if name == "hr":
                flush(stack[-1].role)
            elif name == "br":
                part.append(" ")
            continue
        if name in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in _BLOCK:
                    break
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in bounds:
                    break
                if stack[k].name in ends:
                    close(k)
                    if name != "tr":
                        break
        above = stack[-1].role
        role = _role(name, m[2], above)
        if name in _BLOCK or role not in (above, None):
            flush(above)
        if name in _RAW:  # text up to its own end tag, whatever stands in it
            lower = source.lower() if lower is None else lower
            if len(lower) == size:
                stop = lower.find(f"</{name}", at)
            else:  # a letter that has two in lower case
                e = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(source, at)
                stop = e.start() if e else -1
            if stop < 0:
                break
            at = source.find(">", stop) + 1 or size
            continue
        if m[2].endswith("/") and name not in _BLOCK and name not in _UNSEEN:
            continue  # <x/>: nothing inside
        if name == "body":
            close(1)  # whatever of the head is still open
            role = _role(name, m[2], OPEN)
        stack.append(_Open(name, role))
    flush(stack[-1].role)
    return page


def packed(page: Page) -> bytes:
    return zstandard.compress(bytes(page.roles) + b"\n" + "\n".join(page.texts).encode(errors="replace"), 3)


def unpacked(body: bytes) -> Page:
    roles, _, texts = zstandard.decompress(body).partition(b"\n")
    return Page(texts.decode().split("\n") if roles else [], list(roles))


def streams(pages: list[Page], hosts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends): a hash for each word of the pages, another one on each host, and where pieces end.

    A page has two pieces, its words outside the article and those inside.
    """
    pieces = [" ".join(t for t, r in zip(p.texts, p.roles) if (r == MAIN) == inside).encode(errors="replace") for p in pages for inside in (False, True)]
    buf = np.frombuffer(b" ".join(pieces), np.uint8)
    begin, end = word_spans(buf)
    ends = np.searchsorted(begin, np.cumsum([len(p) + 1 for p in pieces]))
    seeds = np.repeat(np.array([xxhash.xxh64_intdigest(h.encode()) for h in hosts], np.uint64), 2)
    return mixed(span_hash(prefix_hash(buf), begin, end) ^ np.repeat(seeds, np.diff(ends, prepend=0))), ends


def strings(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each string of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out


def anchors(words: np.ndarray, ends: np.ndarray, long: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and pieces of the smallest anchor of each window of ``long`` words in a piece, each once."""
    grams, width = strings(words, anchor), long - anchor + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first = np.flatnonzero(np.arange(len(windows)) + long <= ends[piece[: len(windows)]])
    at = np.unique(first + windows[first].argmin(axis=1))
    return at, grams[at], piece[at]


def suffix_order(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes sorted by their first ``depth`` words, and whether one shares all of them with that before it.

    ``ends[i]`` is where the segment of place i ends; a suffix that is cut off before
    ``depth`` words shares them with none. Ranks are doubled until they cover the depth.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        inside = np.arange(n) + step < ends
        pair = rank * np.int64(n + 2) + np.where(inside, after, 0)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    order = np.argsort(rank, kind="stable")
    whole = np.arange(n) + depth <= ends
    same = np.zeros(n, bool)
    same[1:] = (rank[order[1:]] == rank[order[:-1]]) & whole[order[1:]] & whole[order[:-1]]
    return order, same


def repeated(segments: list[bytes], low: np.ndarray, high: np.ndarray, long: int) -> list[bytes]:
    """For each segment a byte a word, 1 where a string of ``long`` words starts that different pages have.

    ``low`` and ``high`` are the smallest and largest page that votes for a segment; low is above high if none does.
    """
    words = np.concatenate([np.frombuffer(s, "<u4") for s in segments])
    size = np.array([len(s) // 4 for s in segments])
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    order, same = suffix_order(words, stop[owner], long)
    begin = np.flatnonzero(~same)
    least, most = np.minimum.reduceat(low[owner[order]], begin), np.maximum.reduceat(high[owner[order]], begin)
    whole = np.arange(len(words)) + long <= stop[owner]
    several = np.zeros(len(words), np.uint8)
    several[order] = np.repeat(least < most, np.diff(np.append(begin, len(words))))
    several &= whole
    return [several[b - n : b].tobytes() for b, n in zip(stop, size)]


_BLOCKS = "page long, stream long, host string, body binary"


def _blocks(kinds: str = "", *passed: str):
    """(page, stream, host, body, passed columns) for pages (row, host, html, passed columns): its blocks.

    ``stream`` is a hash of the words and the host, ``page`` its first half and one half of the row's hash.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, out = batch.column(0).to_numpy(), batch.column(1).to_pylist(), []
            for host, source in zip(hosts, batch.column(2)):
                got = read(source.as_py() or "")
                out.append((_stream(got, host), packed(got)))
            stream = np.array([x for x, _ in out], np.uint64)
            columns = [pa.array(_page(stream, rows)), pa.array(stream.view(np.int64)), batch.column(1), pa.array([x for _, x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(3 + i) for i in range(len(passed)))], names=["page", "stream", "host", "body", *passed])

    return work, _BLOCKS + kinds


def _stream(page: Page, host: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(page.texts).encode(errors="replace"), xxhash.xxh32_intdigest(host.encode()))


def _page(stream: np.ndarray, row: np.ndarray) -> np.ndarray:
    return ((stream >> np.uint64(32) << np.uint64(32)) | (row.view(np.uint64) & np.uint64(0xFFFFFFFF))).view(np.int64)


def _paired(number: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(mixed(number.astype(np.uint64)) + h)


def _anchors(batches: Iterator[pa.RecordBatch], long: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each page's words, each once in and once outside its article."""
    for batch in batches:
        rows, hosts, sources = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for some in sliced(sources):
            pages = [read(x or "") for x in sources[some]]
            page = _page(np.array([_stream(p, h) for p, h in zip(pages, hosts[some])], np.uint64), rows[some])
            _, h, piece = anchors(*streams(pages, hosts[some]), long, anchor)
            once = np.sort(np.unique(_paired(piece, h), return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(page[piece[once] >> 1]), pa.array((piece[once] & 1).astype(bool))], names=["anchor", "page", "inside"])


_SEGMENT = "page long, stream long, start int, anchor long, inside boolean, seg binary"


def _streams(batches: Iterator[pa.RecordBatch], long: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The segments of each page's stream, all of its words, around the anchors it has heard of: (page, stream, host, body, anchors)."""
    reach = long - anchor
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        bodies = batch.column(3).to_pylist()
        for some in sliced(bodies, 1 << 20):
            part = batch.slice(some.start, some.stop - some.start)
            words, ends = streams([unpacked(x) for x in bodies[some]], part.column(2).to_pylist())
            at, h, piece = anchors(words, ends, long, anchor)
            heard = part.column(4)
            told = np.repeat(np.arange(len(heard)), heard.value_lengths().to_numpy())
            live = np.isin(_paired(piece >> 1, h), _paired(told, heard.flatten().to_numpy().view(np.uint64)))
            at, h, piece = at[live], h[live], piece[live]
            begin = np.maximum(at - reach, np.append(0, ends)[piece])
            end = np.minimum(at + anchor + reach, ends[piece])
            raw = (words >> np.uint64(32)).astype("<u4").tobytes()
            columns = (
                part.column(0).to_numpy()[piece >> 1], part.column(1).to_numpy()[piece >> 1], begin - np.append(0, ends)[piece & ~1], h.view(np.int64), (piece & 1).astype(bool),
                [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist())],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page", "stream", "start", "anchor", "inside", "seg"])


def _sorted_out(segments: DataFrame, long: int, rows: int) -> DataFrame:
    """(name, starts) for segments (anchor, name, seg, low, high): where repeated strings start in each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        starts = repeated(t["seg"].to_pylist(), t["low"].to_numpy(), t["high"].to_numpy(), long)
        yield from pa.table({"name": t["name"].combine_chunks(), "starts": pa.array(starts, pa.binary())}).to_batches(max_chunksize=10_000)

    tasks = max(1, -(-rows // 40_000))
    votes = (F.coalesce("low", F.lit((1 << 63) - 1)).alias("low"), F.coalesce("high", F.lit(-(1 << 63))).alias("high"))  # none, if only articles have it
    return segments.select("anchor", "name", "seg", *votes).repartition(tasks, "anchor").select("name", "seg", "low", "high").mapInArrow(work, "name binary, starts binary")


def _by_windows(segments: DataFrame, long: int) -> DataFrame:
    """As _sorted_out, for anchors with very many segments: each window is a row of its own, combined before it is shuffled."""
    n = (F.octet_length("seg") / 4).cast("int") - long + 1
    each = segments.withColumn("n", n).filter("n > 0").select("name", "low", "high", "n", "seg", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    each = each.select("name", "low", "high", "n", "k", F.md5(F.substring("seg", F.col("k") * 4 + 1, F.lit(4 * long))).alias("window"))
    several = each.groupBy("window").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).filter("_low <> _high").select("window")
    hit = each.join(several, "window").groupBy("name").agg(F.first("n").alias("n"), F.collect_set("k").alias("ks"))  # at most a segment's words
    marks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(F.array_contains("ks", i), "01").otherwise("00"))
    return hit.select("name", F.unhex(F.array_join(marks, "")).alias("starts"))


def heard(pages: DataFrame, long: int, anchor: int) -> DataFrame:
    """(page, anchors): for pages (row, host, html) the anchors that stand outside articles on different pages of the host; stored."""
    told = stored(pages.mapInArrow(lambda batches: _anchors(batches, long, anchor), "anchor long, page long, inside boolean"))
    # an anchor of most pages is combined before it is shuffled
    stream = F.shiftright("page", 32)
    several = told.filter(~F.col("inside")).groupBy("anchor").agg(F.min(stream).alias("low"), F.max(stream).alias("high")).filter("low <> high")
    several = stored(several.select("anchor"))
    answers = stored(told.join(several, "anchor").groupBy("page").agg(F.collect_set("anchor").alias("anchors")))  # at most a page's words
    dropped(told, several)
    return answers


def covered(pages: DataFrame, long: int = LONG, anchor: int = ANCHOR, limit: int = SEGMENTS) -> DataFrame:
    """(page, runs): for pages (row, host, html) where in its stream strings of ``long`` words start that are boilerplate of the host."""
    answers = heard(pages, long, anchor)
    blocks = pages.mapInArrow(*_blocks())
    cut = blocks.join(answers.hint("merge"), "page").select("page", "stream", "host", "body", "anchors").mapInArrow(lambda batches: _streams(batches, long, anchor), _SEGMENT)
    cut = stored(cut.withColumn("name", F.unhex(F.md5("seg"))))
    vote = F.when(~F.col("inside"), F.col("stream"))
    distinct = cut.groupBy("anchor", "name").agg(F.min(vote).alias("low"), F.max(vote).alias("high"), F.first("seg").alias("seg"))
    distinct = stored(distinct)
    # an anchor that one page only has outside its article repeats nothing
    sizes = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("anchor", "n"))
    rows, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    found = _sorted_out(distinct.join(sizes.filter(F.col("n") <= limit), "anchor"), long, rows)
    if most > limit:
        found = found.unionByName(_by_windows(distinct.join(sizes.filter(F.col("n") > limit), "anchor"), long))
    found = found.filter(F.locate("01", F.hex("starts")) > 0)
    hit = cut.select("page", "start", "name").join(found, "name")
    return hit.groupBy("page").agg(F.collect_set(F.struct("start", "starts")).alias("runs"))  # at most a page's words


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def cover(n: int, runs: list[tuple[int, bytes]], long: int) -> np.ndarray:
    """Which of a stream's n words repeated strings cover."""
    edge = np.zeros(n + 1, np.int64)
    for start, marks in runs:
        at = np.unique(start + np.flatnonzero(np.frombuffer(marks, np.uint8)))
        edge[at] += 1
        edge[np.minimum(at + long, n)] -= 1
    return np.cumsum(edge[:n]) > 0


def text_of(page: Page, hit: np.ndarray) -> str:
    """What repeated strings leave of a page's words outside the article, ``hit`` in the stream's order, checked by its markup.

    Chrome goes, repeated or not; main blocks are put back whole, and where there are any nothing else stays. Joined by line breaks.
    """
    article, at, kept = MAIN in page.roles, 0, []
    for text, role in zip(page.texts, page.roles):
        if role == MAIN:
            kept.append(text)
            continue
        words = text.split()
        left = hit[at : at + len(words)]
        at += len(words)
        if role == OPEN and not article:
            kept.append(" ".join(w for w, gone in zip(words, left) if not gone) if left.any() else text)
    return "\n".join(t for t in kept if t)


def extracted(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", long: int = LONG, anchor: int = ANCHOR, limit: int = SEGMENTS, inside: str | None = None
) -> DataFrame:
    """(key, url, text, n_chars, n_repeated, inside) for each row; n_repeated: the words outside the article that the host repeats.

    A column named ``inside``, if asked for, has the article's words that are boilerplate elsewhere and were put back.
    """
    own = (F.xxhash64(F.col(key), F.col(url), F.col(html)).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    runs = covered(pages.select(*own), long, anchor, limit)
    narrow = pages.select(*own, F.col(key).alias("k"), F.col(url).alias("u"))
    kinds = dict(narrow.dtypes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeats, put_back = [], [], []
            for body, found in zip(batch.column(2), batch.column(3)):
                page = unpacked(body.as_py())
                n, outside = (sum(len(t.split()) for t, r in zip(page.texts, page.roles) if r in roles) for roles in ((OPEN, CHROME, MAIN), (OPEN, CHROME)))
                hit = cover(n, [(r["start"], r["starts"]) for r in found.as_py() or []], long)
                texts.append(text_of(page, hit))
                repeats.append(int(hit[:outside].sum()))
                put_back.append(int(hit[outside:].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in ([len(t) for t in texts], repeats, put_back))],
                names=["k", "u", "text", "n_chars", "n_repeated", "n_inside"],
            )

    passed = f", k {kinds['k']}, u {kinds['u']}"
    joined = narrow.mapInArrow(*_blocks(passed, "k", "u")).select("page", "k", "u", "body").join(runs.hint("merge"), "page", "left").select("k", "u", "body", "runs")
    out = joined.mapInArrow(finish, f"{passed[2:]}, text string, n_chars long, n_repeated long, n_inside long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars", "n_repeated", *([F.col("n_inside").alias(inside)] if inside else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), inside="n_repeated_inside")
