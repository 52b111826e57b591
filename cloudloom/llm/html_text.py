"""Operator 5, HTML extraction by host suffix arrays.

Each page is parsed into blocks of text. Blocks inside elements that are never main text (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) go at once; of the rest, those inside ``article`` (or
``main``) are the page's own text where it has one, and every other block is open.

Open blocks are decided per host: their tokens, page after page, are concatenated (a separator of its own between pages), a
suffix array is built by prefix doubling, and adjacent suffixes of different pages that share at least ``least`` tokens mark
what they share as boilerplate. Tokens so covered go; unique runs stay. The suffix array of a host of more than
``group_tokens`` tokens is dealt out: suffixes that begin with the same ``least`` tokens are neighbours in it, so each such
interval is a group by host and hash of these tokens, of which only the first and the last page are needed. A token is covered
if an interval of two pages or more begins at most ``least`` tokens before it. Both ways mark the same tokens, and no task
holds a large host.

Text inside an ``article`` isn't cut even where another page of the host repeats it: that would drop main text, which near
copies and quoted passages share.

Defined cases: a null or empty html gives an empty text; broken markup is read leniently (unclosed elements end with their
parent); a null url is a host of its own; repeated rows are extracted alike; an empty table gives an empty result; columns
besides ``page_id, url, html`` are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import _text as T
from cloudloom.llm._common import Workspace, row_id

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe math object canvas".split())
BANNED = frozenset("nav header footer aside form script style head title noscript template svg iframe button select option textarea dialog menu canvas object math audio video".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
# Parts of a class or an id. A name is that of a part to drop if one of its parts is bad and all others only say where or how it lies.
BAD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe subscription sidebar sidebars widget widgets menu menus nav navbar navigation footer header masthead toolbar share sharing social related recommended promo promos promotion promotions sponsor sponsored "
    "sponsors login signup search pagination pager skip hidden disclaimer".split()
)
PLACE = frozenset(
    "site page main top bottom left right side global primary secondary mobile desktop sticky fixed small large block blocks box boxes bar bars list lists item items wrap wrapper inner outer container content area zone slot unit row col "
    "column panel section group link links button buttons btn icon icons form field thread title text label post posts article articles story stories stack js is has the id no overlay dialog message policy accept toggle".split()
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    # a quoted value ends where white space or the tag's end follows; a tag whose quotes don't match ends at the first ">"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+|[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


def banned(name: str, attributes: str, inside: bool) -> bool:
    if name in BANNED and not (name == "header" and inside):
        return True
    if not attributes or attributes.isspace():
        return False
    found = {m[0].lower(): (m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    return any(bad_name(x) for x in (*found.get("class", "").split(), found.get("id", "")))


def bad_name(name: str) -> bool:
    parts = [p for p in re.split(r"[\W\d_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    lower = [p.lower() for p in parts]
    return any(p in BAD for p in lower) and all(p in BAD or p in PLACE for p in lower)


def blocks(html: str) -> list[tuple[bool, str]]:
    """(in an article or main, text) of each block that may be main text, in page order."""
    out: list[tuple[bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, banned, inside an article or main
    at, n = 0, len(html)

    def flush(inside: bool) -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((inside, text))

    while at < n:
        m = TAG.search(html, at)
        end = m.start() if m else n
        top = stack[-1] if stack else ("", False, False)
        if end > at and not top[1]:
            parts.append(unescape(html[at:end]))
        if not m:
            break
        at = m.end()
        if m[1] is not None and not top[1]:
            parts.append(m[1])
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCK:
                flush(top[2])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush(top[2])
                    del stack[i:]
                    break
            continue
        if name in BLOCK:
            flush(top[2])
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                del stack[i:]
                break
            if stack[i][0] in ("ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "aside", "nav", "footer"):
                break
        if name in VOID or m[4].endswith("/"):
            continue
        top = stack[-1] if stack else ("", False, False)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        stack.append((name, top[1] or banned(name, m[4], top[2]), top[2] or name in ("article", "main")))
    flush(stack[-1][2] if stack else False)
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


def parsed(batches):
    """(rid, page_id, url, html) → (rid, page_id, url, host, text, open): own text, or the open blocks of pages without it."""
    for batch in T.slices(batches, "html"):
        texts, opened, hosts = [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = blocks(html or "")
            own = [t for inside, t in found if inside]
            texts.append(" ".join(own) if own else None)
            opened.append(None if own else [t for _, t in found])
            hosts.append(host_of(url))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("page_id"), batch.column("url"), pa.array(hosts), pa.array(texts, pa.string()), pa.array(opened, pa.list_(pa.string()))],
            ["rid", "page_id", "url", "host", "text", "open"],
        )


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of integers in order, by prefix doubling, and each suffix's common prefix with the one before."""
    n = len(x)
    ranks = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    order = np.argsort(ranks[0], kind="stable")
    while n and len(np.unique(ranks[-1])) < n:
        k, rank = 1 << (len(ranks) - 1), ranks[-1]
        second = np.full(n, -1, np.int64)
        second[: max(0, n - k)] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        ranks.append(rank)
    common = np.zeros(n, np.int64)
    i, j = order[1:], order[:-1]
    for level in range(len(ranks) - 1, -1, -1):  # equal ranks of a level mean 2^level equal tokens
        u, v = i + common[1:], j + common[1:]
        inside = (u + (1 << level) <= n) & (v + (1 << level) <= n)
        same = inside & (ranks[level][np.minimum(u, n - 1)] == ranks[level][np.minimum(v, n - 1)])
        common[1:] += same.astype(np.int64) << level
    return order, common


def repeated(streams: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each page's tokens, whether they lie in a run of at least ``least`` tokens that another page has too."""
    if not streams:
        return []
    tokens = np.concatenate([np.concatenate([s, [-1 - i]]) for i, s in enumerate(streams)]).astype(np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order, common = suffix_array(tokens)
    n = len(tokens)
    of = page[order].tolist()
    longest = np.zeros(n, np.int64)
    for way in (1, -1):
        lcp = common.tolist() if way == 1 else [0, *common[1:][::-1].tolist()]
        pages = of if way == 1 else of[::-1]
        found = [0] * n
        # the last suffix seen of any page, and the last one of another page than that: page and shared length so far
        p1, v1, v2 = pages[0], n, 0
        for r in range(1, n):
            c = lcp[r]
            v1, v2 = min(v1, c), min(v2, c)
            if pages[r] == p1:
                found[r], v1 = v2, n
            else:
                found[r], v2, p1, v1 = v1, v1, pages[r], n
        longest[order] = np.maximum(longest[order], found if way == 1 else found[::-1])
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + longest[at], -1)
    marked = np.cumsum(cover[:-1]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [marked[e - len(s) - 1 : e - 1] for e, s in zip(ends, streams, strict=True)]


def token_hash(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t) >> 1


def unique_runs(opened: list[list[str]], least: int) -> list[str]:
    """What is left of each page's open blocks."""
    words = [[w for b in page for w in b.split(" ")] for page in opened]
    marks = repeated([np.array([token_hash(w) for w in page], np.int64) for page in words], least)
    return [" ".join(w for w, m in zip(page, mark, strict=True) if not m) for page, mark in zip(words, marks, strict=True)]


def group_texts(least: int):
    def run(pdf):
        pdf = pdf.sort_values("rid")
        out = pdf[["rid"]].copy()
        out["found"] = unique_runs([list(x) for x in pdf["open"]], least)
        return out

    return run


def windows(least: int):
    """(rid, host, open) → (host, window, rid): hashes of the windows of ``least`` tokens, each once a page."""

    def run(batches):
        for batch in batches:
            for rid, host, page in zip(*(batch.column(c).to_pylist() for c in ("rid", "host", "open")), strict=True):
                h = np.unique(page_windows(page, least))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(h)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), rid))], ["host", "window", "rid"])

    return run


def page_windows(page: list[str], least: int) -> np.ndarray:
    words = [w for b in page for w in b.split(" ")]
    return T.window_hashes(np.array([token_hash(w) for w in words], np.uint64), np.array([0, len(words)]), least)[0]


def cut_pages(least: int):
    """(rid, open, shared) → (rid, found): the page without the tokens of its shared windows."""

    def run(batches):
        for batch in batches:
            out = []
            for page, shared in zip(batch.column("open").to_pylist(), batch.column("shared"), strict=True):
                words = [w for b in page for w in b.split(" ")]
                own = page_windows(page, least)
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(np.isin(own, shared.values.to_numpy().view(np.uint64))) if shared.is_valid and len(shared) else np.empty(0, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + least, -1)
                out.append(" ".join(w for w, m in zip(words, np.cumsum(cover[:-1]) > 0, strict=True) if not m))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.string())], ["rid", "found"])

    return run


def unique_of_large(ws: Workspace, waiting: DataFrame, least: int) -> DataFrame:
    """(rid, found) of pages of hosts that are too large for one task."""
    every = waiting.mapInArrow(windows(least), "host string, window long, rid long")
    pages = every.groupBy("host", "window").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("host", "window")
    shared = every.join(ws.table(pages), ["host", "window"], "left_semi").groupBy("rid").agg(F.collect_list("window").alias("shared"))  # at most a page's windows
    return waiting.select("rid", "open").join(ws.table(shared), "rid", "left").mapInArrow(cut_pages(least), "rid long, found string")


def extract(ws: Workspace, pages: DataFrame, least: int = 12, group_tokens: int = 200_000) -> DataFrame:
    """One row per row of ``pages``: rid, page_id, url, text, n_chars."""
    rows = ws.table(pages.select(row_id().alias("rid"), "page_id", "url", "html").mapInArrow(parsed, "rid long, page_id long, url string, host string, text string, open array<string>"))
    waiting = rows.where("text is null and size(open) > 0").select("rid", "host", "open")
    if ws.is_empty(waiting):
        out = rows.withColumn("text", F.coalesce("text", F.lit("")))
    else:
        size = F.aggregate("open", F.lit(0).cast("long"), lambda a, b: a + F.size(F.split(b, " ")))
        per_host = ws.table(waiting.groupBy("host").agg(F.sum(size).alias("tokens")))
        small = per_host.where(F.col("tokens") <= group_tokens).select("host")
        large = ws.table(waiting.join(per_host.where(F.col("tokens") > group_tokens).select("host"), "host"))
        few = waiting.join(small, "host").groupBy("host").applyInPandas(group_texts(least), "rid long, found string")
        found = few.unionByName(unique_of_large(ws, large, least)) if not ws.is_empty(large) else few
        out = rows.join(found, "rid", "left").withColumn("text", F.coalesce("text", "found", F.lit("")))
    return out.select("rid", "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
