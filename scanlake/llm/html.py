"""Main text of web pages by a host suffix array, with markup as a prior.

A page becomes blocks of text in page order. What can never be text (scripts, styles, forms, menus, hidden elements) is not
read at all; all other blocks make the page's token stream, each with what its markup suggests: inside the article, furniture
(headers, footers, asides, adverts, notices ...), doubtful (a name that holds such a word, inside the article) or open.

The token streams of a host's pages are joined and their suffixes sorted by the first `run` tokens; neighbours that agree on
all of them are one run, and overlaps make up the long ones (a block shorter than `run` counts as a run of its own). Runs on
enough of the host's distinct pages are its boilerplate, copies and near copies counting as one page: on a tenth of them for
open and doubtful blocks (least_pages), half and ten at least for whole blocks of the article (most_pages), and without the prior on a hundredth for marked
blocks (marked_pages). Covered blocks and stretches go. What the suffix array leaves is decided by the prior: unique furniture goes, unique doubtful blocks of
`run` words or more stay, and open blocks stay where the page has no article or holds more words outside of it.

Pages are parsed once and written as blocks. Equal pages of a host count once, whatever their number. Hosts are split by hash into groups of
bounded number and size, so that a host with a third of all pages is many groups. A group counts the distinct pages of each
run. In a host of one group these are the host's counts. In others a run may be on one page in each of many groups, so groups first
add up counts of slots that run hashes fall into, which no run's count exceeds; a second pass over the pages then counts exactly the runs of
slots that reach the least number asked for, by the pages that lead their copies. So results do not depend on how pages are dealt, but for near copies in several groups, which count once in each.

Cases: null html is empty; null url is a host of its own; pages without text give an empty string; repeated rows are
pages of their own (one page repeated does not make its text furniture: equal streams count once); an empty table gives an
empty table; unclosed, misnested and unknown tags are tolerated; a page of any size is read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, small_side, table
from .words import trim, word_hashes

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML by what they mean here.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"nav", "form", "menu", "button", "dialog", "search", "head"}
DROP = {"aside", "footer"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
DROP_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
ARTICLE_NAMES = {"articlebody", "article-body", "article-content", "entry-content", "post-content", "post-body", "main-content", "story-body"}
END = "\x00"  # no word: white space and references of HTML never give it
NONE, FURNITURE, DOUBT, OPEN, ARTICLE = -1, 0, 1, 2, 3
#: A run is furniture on this share of a host's distinct pages; pages that share this part of their runs are copies of one.
SHARE, COPIES = 0.1, 0.7
ARTICLES = 10  # and on this many pages at least where a whole block of an article is to go
SLOTS = 20  # so that a slot has a twentieth of a host's pages on average, half of what SHARE asks for
MARKED = 0.01  # as SHARE, for blocks that markup marks as furniture or doubtful


def _kind(name: str, attrs: str, now: int) -> int:
    """What an element is, from its tag and what it stands in. Names of inline elements say nothing."""
    if now == NONE or name in NEVER:
        return NONE
    inside = now in (ARTICLE, DOUBT)
    if now == FURNITURE or name in DROP or (name == "header" and not inside):
        now, inside = FURNITURE, False
    kind = ARTICLE if name in ("article", "main") and now != FURNITURE else now
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, *values in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), unescape("".join(values)).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                return NONE
            if now == FURNITURE:
                continue
            if key == "role":
                if value in DROP_ROLES and name not in ("html", "body"):
                    return FURNITURE
                kind = ARTICLE if value in ("main", "article") else kind
            elif key == "itemprop" and value == "articlebody":
                kind = ARTICLE
            elif key in ("class", "id") and name in BLOCK:
                for x in value.split():
                    if x in ARTICLE_NAMES:
                        kind = ARTICLE
                    parts = re.split(r"[-_]+", x)
                    if name not in ("html", "body", "main", "article") and parts[0] not in ("has", "no", "with", "without", "not"):
                        if x in DROP_NAMES:
                            return FURNITURE
                        if DROP_NAMES & set(parts):
                            if not inside:
                                return FURNITURE
                            kind = DOUBT
    return kind


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; white space is one space, trimmed, empty blocks left out."""
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = OPEN

    def flush():
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text and kind != NONE:
                out.append((kind, text.replace(END, "\ufffd")))

    at = 0
    while True:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            piece.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "br":
            piece.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        elif name in ("img", "input"):
            piece.append(" ")
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not block:
                        if any(k != stack[i][1] for _, k in stack[i:]):
                            flush()
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and (not block or name == "p") and stack[i][0] != "p":
                    break  # a stray end tag does not close the blocks around it
        else:
            if block and stack and name in ("p", "li", "dt", "dd", "tr", "td", "th"):  # closes one of its own kind that is still open
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            now = _kind(name, attrs, stack[-1][1] if stack else OPEN)
            if not block and now != (stack[-1][1] if stack else OPEN):
                flush()
            if not attrs.endswith("/"):
                stack.append((name, now))
        kind_now = stack[-1][1] if stack else OPEN
        if kind_now != kind:
            flush()
            kind = kind_now
    flush()
    return out


def _runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of at least `run` tokens in order of their first `run`, ties in text order; where each distinct run begins there).

    tokens: the joined streams as numbers; page: non-decreasing page numbers. The suffix array is built by prefix
    doubling up to `run` tokens; a suffix never reads past its page.
    """
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < run:
        return none, none
    rank = (tokens if tokens.max() <= n else np.unique(tokens, return_inverse=True)[1]).astype(np.int64) + 1
    ends = np.searchsorted(page, page, "right")
    have = 1
    while have < run:
        step = min(have, run - have)  # prefixes may overlap, the last time
        nxt = np.zeros(n, np.int64)
        at = np.arange(n)
        ok = at + step + have <= ends
        nxt[ok] = rank[at[ok] + step]
        key = np.where(ok & (rank > 0), rank * (n + 2) + nxt, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if key.min() > 0:
            rank += 1
        have += step
    order = np.argsort(rank, kind="stable")
    order = order[rank[order] > 0]
    return order, np.flatnonzero(np.diff(rank[order], prepend=-1))


def _spread(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of n tokens the runs that begin at starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a substring of at least `run` tokens that two distinct pages share."""
    order, first = _runs(tokens, page, run)
    if not len(order):
        return np.zeros(len(tokens), bool)
    low, high = page[order[first]], page[order[np.append(first[1:], len(order)) - 1]]
    return _spread(order[np.repeat(low != high, np.diff(np.append(first, len(order))))], len(tokens), run)


def removed(covered: np.ndarray, run: int) -> np.ndarray:
    """What of an open block goes: all if all is covered, else covered stretches of at least twice `run` tokens (shorter ones are
    phrases that texts have in common, or the ends of a neighbour's run)."""
    if covered.all():
        return covered
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        out[a:b] = b - a >= 2 * run
    return out


def run_hashes(tokens: pa.DictionaryArray, run: int) -> np.ndarray:
    """64-bit hash of the run of `run` tokens from each on (only where so many follow)."""
    n = len(tokens) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = word_hashes(tokens.dictionary)[tokens.indices.to_numpy()]
    out = np.zeros(n, np.uint64)
    for i in range(run):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return out.view(np.int64)


def stream_hashes(streams: list[list[str]], run: int) -> list[np.ndarray]:
    """run_hashes of each stream, all of whose tokens are hashed together."""
    hashes = run_hashes(pa.array([w for s in streams for w in s], pa.string()).dictionary_encode(), run)
    out, at = [], 0
    for s in streams:
        out.append(hashes[at : at + max(0, len(s) - run + 1)])
        at += len(s)
    return out


def _held(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where hashes are in known, which is sorted."""
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)


def stream(page: list[tuple[int, str]], run: int) -> list[str]:
    """The words of all blocks; shorter blocks than a run are filled up with END, so that they are runs as a whole."""
    out = []
    for _, t in page:
        mine = t.split(" ")
        out += mine
        out += [END] * (run - len(mine))
    return out


def _leaders(page: np.ndarray, of: np.ndarray, pages: int) -> np.ndarray:
    """Each page's leader: the first that leads and shares COPIES of the runs of both. (page, of): the distinct runs of each page."""
    size = np.bincount(page, minlength=pages)
    several = np.bincount(of)[of] > 1
    page, of = page[several], np.unique(of[several], return_inverse=True)[1]
    both = np.zeros((pages, pages), np.int64)
    for low in range(0, int(of.max(initial=-1)) + 1, 1 << 16):  # a bit a run, 8 kB a page at a time
        at = (of >= low) & (of < low + (1 << 16))
        m = np.zeros((pages, 1 << 16), bool)
        m[page[at], of[at] - low] = True
        bits = np.packbits(m, axis=1).view(np.uint64)
        for i in range(1, pages):
            both[i, :i] += np.bitwise_count(bits[i] & bits[:i]).sum(axis=1, dtype=np.int64)
    leader = np.arange(pages)
    leading: list[int] = []
    for i in range(pages):
        near = [j for j in leading if both[i, j] > 0 and both[i, j] >= COPIES * (size[i] + size[j] - both[i, j])]
        if near:
            leader[i] = near[0]
        else:
            leading.append(i)
    return leader


def page_runs(parsed: list[list[tuple[int, str]]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each page's leader, itself or a page of which it is a copy or near copy, -1 for pages without text; hashes of the distinct runs; on how
    many leaders' pages each is)."""
    numbers: dict[tuple, int] = {}
    first_of, stream_of = [], []
    for i, p in enumerate(parsed):
        x = tuple(stream(p, run))
        if x and x not in numbers:
            numbers[x] = len(numbers)
            first_of.append(i)
        stream_of.append(numbers[x] if x else -1)
    stream_of, first_of = np.array(stream_of, np.int64), np.array(first_of, np.int64)
    none = np.zeros(0, np.int64)
    if not numbers:
        return stream_of, none, none
    words = pa.array([w for s in numbers for w in s], pa.string()).dictionary_encode()
    tokens = words.indices.to_numpy()
    sizes = np.array([len(s) for s in numbers])
    page = np.repeat(np.arange(len(sizes)), sizes)
    order, first = _runs(tokens, page, run)
    leader, n, hashes = np.arange(len(sizes)), none, none
    if len(order):
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        pairs = of * len(sizes) + page[order]  # rising, as ties are in text order
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        of, on = pairs // len(sizes), pairs % len(sizes)
        leader = _leaders(on, of, len(sizes))
        if (leader != np.arange(len(sizes))).any():
            of = np.unique(of * len(sizes) + leader[on]) // len(sizes)
        n = np.bincount(of, minlength=len(first))
        hashes = run_hashes(words, run)[order[first]]
    return np.where(stream_of < 0, -1, first_of[leader[np.maximum(stream_of, 0)]]), hashes, n


def marked_pages(pages: int) -> int:
    """Of a host's distinct pages, how many have a run that is furniture where markup says so too: MARKED of them, two at least."""
    return max(2, math.ceil(MARKED * pages))


def least_pages(pages: int) -> int:
    """Of a host's distinct pages, how many have a run that is furniture: SHARE of them, three at least, of two both."""
    return max(2, min(pages, max(3, math.ceil(SHARE * pages))))


def most_pages(pages: int) -> int:
    """Of a host's distinct pages, how many have a run that is furniture even inside an article: half of them, ARTICLES at least, as the articles
    of few pages may well share a sentence."""
    return max(ARTICLES, math.ceil(pages / 2))


def page_text(page: list[tuple[int, str]], hashes: np.ndarray, known: list[np.ndarray], run: int, prior: bool = True) -> str:
    """The main text of a page, by the hashes of its runs and those of its host's runs on few, several and most of its pages (sorted).

    prior: whether markup decides what the runs leave, and few pages count as several; else all that they leave is text.
    """
    lengths = [t.count(" ") + 1 for _, t in page]
    total = sum(max(run, n) for n in lengths)
    hit = [_held(hashes, x) for x in known]
    levels = [_spread(h, total, run) if len(h) else None for h in hit]
    lines, at, size = [], 0, {ARTICLE: 0, OPEN: 0}
    for (k, t), n in zip(page, lengths):
        here = slice(at, at + n)
        at += max(run, n)
        level = levels[{OPEN: 1, ARTICLE: 2}.get(k, 0)]
        covered = level[here] if level is not None else None
        whole = covered is not None and covered.all()
        if (whole and (k != ARTICLE or n >= run)) or (prior and (k == FURNITURE or k == DOUBT and n < run)):
            continue
        gone = removed(covered, run) if covered is not None and k in (OPEN, FURNITURE) else None
        if gone is not None and gone.any():
            if gone.all():
                continue
            t = " ".join(w for w, g in zip(t.split(" "), gone) if not g)
            n -= int(gone.sum())
        k = OPEN if k in (OPEN, FURNITURE) else ARTICLE
        lines.append((k, t))
        size[k] += n
    return "\n".join(t for k, t in lines if k == ARTICLE or not prior or size[OPEN] > size[ARTICLE])


def main_texts(pages: list[str | None], run: int = 8, prior: bool = True) -> list[str]:
    """The main text of each page of one host."""
    parsed = [blocks(h or "") for h in pages]
    leader, hashes, counts = page_runs(parsed, run)
    n = len(np.unique(leader[leader >= 0]))
    known = [np.sort(hashes[counts >= least]) for least in (least_pages(n) if prior else marked_pages(n), least_pages(n), most_pages(n))]
    return page_texts(parsed, [known] * len(parsed), run, prior)


def page_texts(parsed: list[list[tuple[int, str]]], known: list[list[np.ndarray]], run: int, prior: bool) -> list[str]:
    """page_text of each page, whose tokens are hashed together."""
    return [page_text(page, h, k, run, prior) for page, h, k in zip(parsed, stream_hashes([stream(p, run) for p in parsed], run), known)]


def written_blocks(page: list[tuple[int, str]]) -> tuple[bytes, str, int]:
    """(blocks, MD5 of their texts, bytes of these): compressed, as pages cross the network and lie on disk as blocks; blocks hold no line ends."""
    text = "\n".join(t for _, t in page).encode()
    return zstandard.compress(len(page).to_bytes(4, "little") + bytes(k for k, _ in page) + text, 3), hashlib.md5(text).hexdigest(), len(text)


def read_blocks(blocks: bytes) -> list[tuple[int, str]]:
    x = zstandard.decompress(blocks)
    n = int.from_bytes(x[:4], "little")
    return list(zip(x[4 : 4 + n], x[4 + n :].decode().split("\n"))) if n else []


def extract(pages: DataFrame, run: int = 8, group_pages: int = 256, group_bytes: int = 16 << 20, prior: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    group_pages and group_bytes (of text) bound a host's group (a page longer than that is a group's only one, about). prior: see page_text.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("_host", host)
    kinds = dict(pages.dtypes)

    def parse(batches):
        for b in batches:
            found = [written_blocks(blocks(h) if isinstance(h, str) else []) for h in b["html"]]
            yield b.drop(columns="html").assign(blocks=[x for x, _, _ in found], _same=[x for _, x, _ in found], b=[x for _, _, x in found])
            trim()

    # numbers that may be null must not become floats
    sent = rows.withColumn("page_id", F.col("page_id").cast("string"))
    parsed = sent.mapInPandas(parse, "page_id string, url string, _host string, blocks binary, _same string, b long")
    parsed = materialize(parsed.withColumn("page_id", F.col("page_id").cast(kinds["page_id"])).withColumn("_row", F.monotonically_increasing_id()), "html-blocks")

    # pages with equal blocks are one, by its first row
    distinct = parsed.where("b > 0").groupBy("_host", "_same").agg(F.min("_row").alias("_row"), F.first("b").alias("b"))
    distinct = materialize(distinct.select("_host", "_row", "b"), "html-pages")
    hosts = distinct.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    groups = F.greatest(F.ceil(F.col("n") / group_pages), F.ceil(F.col("b") / group_bytes), F.lit(1))
    slots = F.greatest(F.lit(1024), F.ceil(SLOTS * F.col("b") / F.col("n") / 6))  # SLOTS times a page's words, about
    hosts = materialize(hosts.select("_host", groups.alias("_n"), slots.cast("long").alias("_slots")), "html-hosts")
    dealt = distinct.join(small_side(hosts), "_host").select("_row", "_n", "_slots", F.pmod(F.xxhash64("_row"), F.col("_n")).alias("_group"))
    dealt = parsed.select("_row", "_host", "blocks").join(small_side(materialize(dealt, "html-dealt")), "_row")

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leader, hashes, n = page_runs([read_blocks(x) for x in group["blocks"]], run)
        row, pages_ = group["_row"].to_numpy(), len(np.unique(leader))
        if group["_n"].iloc[0] == 1:
            several = n > 1
            parts = [(TOTAL, [0], [pages_]), (COUNT, hashes[several], n[several])]
        else:
            size = int(group["_slots"].iloc[0])
            sums = np.bincount((hashes.view(np.uint64) % np.uint64(size)).astype(np.int64), weights=n, minlength=size)
            full = np.flatnonzero(sums)
            parts = [(TOTAL, [0], [pages_]), (SLOT, full, sums[full]), (LEADER, row, row[leader])]
        trim()
        return pd.concat([pd.DataFrame({"_host": key[0], "what": what, "a": np.asarray(a, np.int64), "n": np.asarray(x, np.int64)}) for what, a, x in parts], ignore_index=True)

    # groups are dealt by themselves: a host is many tasks
    counted = dealt.repartition("_host", "_group").groupBy("_host", "_group").applyInPandas(count, "_host string, what int, a long, n long")
    counted = materialize(counted, "html-runs")
    total = counted.where(F.col("what") == TOTAL).groupBy("_host").agg(F.sum("n").alias("_total"))
    least = F.greatest(F.lit(2), F.least(F.col("_total"), F.greatest(F.lit(3), F.ceil(F.lit(SHARE) * F.col("_total")))))  # as least_pages
    most = F.greatest(F.lit(ARTICLES), F.ceil(F.col("_total") / 2))  # as most_pages
    marked = least if prior else F.greatest(F.lit(2), F.ceil(F.lit(MARKED) * F.col("_total")))  # as marked_pages
    enough = F.col("n") >= F.least(marked, least)  # at most 1 / MARKED times a page's runs
    found = counted.where(F.col("what") == COUNT).select("_host", F.col("a").alias("h"), "n")

    asked = counted.where(F.col("what") == SLOT).groupBy("_host", "a").agg(F.sum("n").alias("n")).join(total, "_host").where(enough)
    asked = materialize(asked.groupBy("_host").agg(F.sort_array(F.collect_list("a")).alias("_asked")).join(hosts.select("_host", "_slots"), "_host"), "html-slots")
    if asked.limit(1).count():
        leaders = materialize(counted.where(F.col("what") == LEADER).select(F.col("a").alias("_row"), F.col("n").alias("_leader")), "html-leaders")
        again = parsed.select("_row", "_host", "blocks").join(small_side(leaders), "_row").join(small_side(asked), "_host")

        def held(batches):
            for b in batches:
                pick, found = [], []
                hashed = stream_hashes([stream(read_blocks(x), run) for x in b["blocks"]], run)
                for i, (h, slot, size) in enumerate(zip(hashed, b["_asked"], b["_slots"])):
                    h = np.unique(h[_held((h.view(np.uint64) % np.uint64(size)).astype(np.int64), np.asarray(slot, np.int64))])
                    pick.append(np.full(len(h), i))
                    found.append(h)
                pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
                yield pd.DataFrame({"_host": b["_host"].to_numpy()[pick], "_leader": b["_leader"].to_numpy()[pick], "h": np.concatenate(found) if found else pick})
                trim()

        exact = again.mapInPandas(held, "_host string, _leader long, h long").distinct().groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(exact)
    found = found.join(total, "_host").where(enough)
    level = lambda x: F.sort_array(F.collect_list(F.when(F.col("n") >= x, F.col("h"))))
    levels = {"_runs": least, "_wide": most} | ({} if prior else {"_marked": marked})
    furniture = materialize(found.groupBy("_host").agg(*[level(x).alias(c) for c, x in levels.items()]), "html-furniture")

    def texts(batches):
        for b in batches:
            known = [[np.zeros(0, np.int64) if r is None else np.asarray(r, np.int64) for r in b[c]] for c in ("_runs" if prior else "_marked", "_runs", "_wide")]
            text = page_texts([read_blocks(x) for x in b["blocks"]], list(zip(*known)), run, prior)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    out = parsed.withColumn("page_id", F.col("page_id").cast("string")).join(small_side(furniture), "_host", "left").drop("_host", "_row", "_same", "b")
    out = out.mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kinds["page_id"]))


#: What a row of a group's counts is: its distinct pages, a run's pages, a slot's, a page's leader.
TOTAL, COUNT, SLOT, LEADER = range(4)


def op4_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
