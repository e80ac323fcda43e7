"""Main text of web pages: markup zones, and a suffix array of each host's page texts.

A tolerant tag scan cuts a page into text blocks and gives each a zone: *main* (in
article or main), *chrome* (menus, headers, footers, sidebars, notices, adverts, forms,
comments, by tag, role, class or id) or *open* (neither).  Scripts, styles and comments
never become text.  A header inside an article is the article's own (title, byline) and
stays.

A page's text is its main blocks.  A page without any has to be judged by its host:
the tokens of all its pages outside main are concatenated, page by page, and sorted by
a suffix array (prefix doubling to ``RUN`` tokens deep).  A run of ``RUN`` tokens or more
that stands on two distinct pages is boilerplate; open blocks lose the covered tokens
and keep their unique runs.  A repeated run inside main is kept: an article that is
copied to another page is still that page's text.

A host may hold any share of all pages, so none is ever gathered.  Each Arrow batch has
a suffix array of its own for each host in it and yields a row for each distinct run
(host, run hash, first and last page); Spark combines these by host and run.  Runs of
pages that need them are joined back by (host, run) and page.

Defined edge cases: null or empty html has an empty text; a null url has the host
""; rows that repeat a page_id are one page to the suffix array, and each is
extracted; pages without page_id never share a run with each other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.kernels import mix, prefix_hash, span_hash
from gleaner.llm.session import prepare, written

#: Tokens of a repeated run, at least: a power of two, the depth of the suffix array.
RUN = 8

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    # without an end tag only the tag itself goes, not the rest of the page
    r"|<(?P<inner>noscript|template|svg|math|iframe|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>(?:.*?</(?P=inner)\s*>)?)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
_SPACE = re.compile(r"\s+")
_HINT_SPLIT = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Closed by their next sibling or parent as often as by their own end tag.
_LOOSE = frozenset("p li dt dd td th tr tbody thead tfoot option".split())
_CHROME_TAGS = frozenset("head nav footer aside form menu dialog button fieldset".split())
#: May be laid around a whole page, the article included.
_WRAPPERS = frozenset("form fieldset dialog".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_CHROME_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus disclaimer dropdown footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: These count only outside main, where an article's own header may stand.
_OUTER_WORDS = frozenset("header top topbar bottom".split())

OPEN, MAIN, CHROME = 0, 1, 2


#: How far class and id are believed: everywhere, not on article and main, only inside main.
ALL_HINTS, NOT_ON_MAIN, INSIDE_MAIN = 0, 1, 2


def _zone(name: str, attrs: str, outer: int, hints: int) -> int:
    if outer == CHROME or (name == "header" and outer != MAIN):
        return CHROME
    if name in _CHROME_TAGS and not (name in _WRAPPERS and outer == OPEN and hints == INSIDE_MAIN):
        return CHROME
    shell = name in ("html", "body")
    zone = MAIN if name in ("article", "main") else outer
    believed = not shell and (outer == MAIN or hints == ALL_HINTS or (hints == NOT_ON_MAIN and zone != MAIN))
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                if not believed:
                    continue
                words = set(_HINT_SPLIT.split(value))
                if words & _CHROME_WORDS or (outer != MAIN and zone != MAIN and words & _OUTER_WORDS):
                    return CHROME
            elif key == "role":
                if value in _CHROME_ROLES and not shell:
                    return CHROME
                zone = MAIN if value in ("main", "article") else zone
            elif shell:
                continue
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return CHROME
    return zone


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's text blocks in order; text has single spaces.

    A page that a class or id on article or main, or around them, or a form laid around
    them, left without main blocks is read again without believing those.
    """
    found = _blocks(page, ALL_HINTS)
    zones = {z for z, _ in found}
    if found and MAIN not in zones:
        for hints in (NOT_ON_MAIN, INSIDE_MAIN) if OPEN not in zones or _ARTICLE.search(page) else (NOT_ON_MAIN,):
            again = _blocks(page, hints)
            if any(z == MAIN for z, _ in again):
                return again
    return found


def _blocks(page: str, hints: int) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}  # tags on the stack, so that a stray end tag costs no search
    zone, at = OPEN, 0

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((zone, text))
            parts.clear()

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                parts.append(m["cdata"])
            continue
        name = name.lower()
        if name in _BLOCK:
            close()
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[i][0] == name:
                    if stack[i][1] != zone or any(z != zone for _, z in stack[i:]):
                        close()
                    for inner, _ in stack[i:]:
                        opened[inner] -= 1
                    del stack[i:]
                    break
                if name not in _BLOCK and stack[i][0] in _BLOCK:
                    break  # an inline end tag doesn't reach out of its block
            new = stack[-1][1] if stack else OPEN
            if new != zone:
                close()
                zone = new
            continue
        attrs = m["attrs"]
        if attrs.endswith("/") and name not in _BLOCK:
            continue
        if stack and stack[-1][0] == "head":
            # its own tags are void or raw: any other one ends it
            close()
            opened[stack.pop()[0]] -= 1
            zone = stack[-1][1] if stack else OPEN
        new = _zone(name, attrs, zone, hints)
        if name not in _LOOSE or new != zone:
            if new != zone:
                close()
            stack.append((name, new))
            opened[name] = opened.get(name, 0) + 1
            zone = new
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def page_tokens(texts: list[str]) -> np.ndarray:
    """Hashes of the words of some blocks; each block ends with a mark."""
    raw = " \x00 ".join(texts) + " \x00" if texts else ""
    words = raw.encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lens)
    return span_hash(prefix_hash(data), ends - lens, ends)


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of the RUN tokens from each place on."""
    if len(tokens) < RUN:
        return np.zeros(0, np.uint64)
    n = len(tokens) - RUN + 1
    h = tokens[:n].copy()
    for j in range(1, RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : n + j]
    return mix(h)


def suffix_ranks(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a token stream, sorted to RUN tokens deep.

    Suffixes of one rank share at least RUN tokens.  Each round sorts by the ranks of
    two halves and so doubles the depth.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    order, depth = np.argsort(rank, kind="stable"), 1
    while depth < RUN:
        second = np.full(len(rank), -1, np.int64)
        second[:-depth] = rank[depth:] if depth < len(rank) else second[:-depth]
        key = rank * (len(rank) + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        depth *= 2
    return order, rank


def host_runs(pages: list[tuple[int, np.ndarray]]):
    """(run hash, first page, last page) of each distinct run in a host's pages."""
    stream, page, start = [], [], []
    for i, (number, tokens) in enumerate(pages):
        # a separator of its own ends each page, so no run goes over it
        stream += [tokens, mix(np.array([i + 1], np.uint64))]
        page.append(np.full(len(tokens) + 1, number, np.int64))
        start.append(np.arange(len(tokens), -1, -1))
    tokens, page, left = np.concatenate(stream), np.concatenate(page), np.concatenate(start)
    order, rank = suffix_ranks(tokens)
    order = order[left[order] >= RUN]
    if not len(order):
        return np.zeros(0, np.uint64), order, order
    ranks = rank[order]
    heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
    hashes = np.zeros(len(tokens), np.uint64)
    own = run_hashes(tokens)
    hashes[: len(own)] = own
    return hashes[order[heads]], np.minimum.reduceat(page[order], heads), np.maximum.reduceat(page[order], heads)


def _host(url: str) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""



_PARSED = "page_id bigint, url string, text string, host string, runs array<bigint>, blocks array<string>"


def _parse(pages: DataFrame) -> DataFrame:
    """Text of pages with main blocks; runs and open blocks of the others."""

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("text", "host", "runs", "blocks")}
            urls = batch.column(1).to_pylist()
            for url, page in zip(urls, batch.column(2).to_pylist()):
                found = blocks(page or "")
                main = [t for z, t in found if z == MAIN]
                rest = [t for z, t in found if z == OPEN]
                settled = bool(main) or not rest
                rows["text"].append("\n".join(main) if settled else None)
                rows["host"].append(_host(url))
                rows["runs"].append(None if settled else np.unique(run_hashes(page_tokens(rest))).view(np.int64).tolist())
                rows["blocks"].append(None if settled else rest)
            columns = [
                batch.column(0),
                pa.array(urls, pa.string()),
                pa.array(rows["text"], pa.string()),
                pa.array(rows["host"], pa.string()),
                pa.array(rows["runs"], pa.list_(pa.int64())),
                pa.array(rows["blocks"], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "host", "runs", "blocks"])

    return pages.mapInArrow(run, _PARSED)


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(host, run) of runs outside main that stand on two distinct pages of a host."""

    def run(batches):
        for batch in batches:
            hosts: dict[str, list] = {}
            for number, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number is not None:
                    texts = [t for z, t in blocks(page or "") if z != MAIN]
                    hosts.setdefault(_host(url), []).append((number, page_tokens(texts)))
            names, parts = [], []
            for host, own in hosts.items():
                found = host_runs(own)
                names += [host] * len(found[0])
                parts.append(found)
            if not names:
                continue
            hashes, low, high = (np.concatenate([p[i] for p in parts]) for i in range(3))
            columns = [pa.array(names, pa.string()), pa.array(hashes.view(np.int64)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, ["host", "run", "low", "high"])

    found = pages.mapInArrow(run, "host string, run bigint, low bigint, high bigint")
    both = found.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return both.where("low < high").select("host", "run")


def unique_text(texts: list[str], repeated: set[int]) -> str:
    """The blocks without the tokens that repeated runs cover."""
    tokens = page_tokens(texts)
    covered = np.zeros(len(tokens) + RUN, bool)
    for i in np.flatnonzero([h in repeated for h in run_hashes(tokens).view(np.int64).tolist()]):
        covered[i : i + RUN] = True
    out, at = [], 0
    for text in texts:
        words = text.split(" ")
        kept = [w for w, c in zip(words, covered[at : at + len(words)].tolist()) if not c]
        at += len(words) + 1  # and the block's mark
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


def extract_pages(df: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    prepare(df.sparkSession)
    pages = df.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).alias("html"))
    parsed = _parse(pages)
    open_pages = written(parsed.where("blocks IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    runs = open_pages.select("row", "host", F.explode("runs").alias("run"))
    hits = runs.join(repeated_runs(pages), ["host", "run"]).groupBy("row").agg(F.collect_list("run").alias("hits"))

    @F.udf("string")
    def strip(texts, repeated):
        return unique_text(list(texts), set(repeated or ()))

    judged = open_pages.join(hits, "row", "left").select("page_id", "url", strip("blocks", "hits").alias("text"))
    settled = parsed.where("blocks IS NULL").select("page_id", "url", "text")
    return settled.unionByName(judged).withColumn("n_chars", F.length("text").cast("bigint"))
