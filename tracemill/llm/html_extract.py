"""Main-text extraction by consensus paths of a host.

1. Each page is cut into blocks of text, each with its path of generalised tags (`tag.class`, digits dropped, generic
   numbering and ids left out). Containers (all prefixes of the paths) are scored on the page: characters of prose less
   those in links and boilerplate, with punctuation as a sign of sentences; the best container is the page's vote.
2. Spark sums the votes of each host's pages by path, in two steps so that a host with a third of all pages is summed
   in many tasks first; the path with the most score wins, ties to the shorter and then smaller path. Paths that hold
   main text and aren't inside one another (an article in two parts) win together if close in score.
3. Each page is read again with its host's paths. A page on which they match nothing, or little beside its own best
   container (less than a quarter of its score), takes its own containers.

Blocks of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are told by tag, role
and class words and never count as main text, whatever their container. A class or id that says what its element has
or lacks (has-sidebar, layout-sidebar-right, no-ads) is no such word; what <main> or a page's only <article> holds isn't
dropped by the names of what is around it; and an element dropped by name that holds nearly all prose of a page is kept,
unless it is named for comments.

Defined cases: a null or empty html gives the empty text; a null url is a host of its own; pages that repeat vote each;
an unclosed tag ends with its parent; characters after `<` that form no tag are text; columns other than page_id, url
and html aren't read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, stage_table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "iframe"}  # hold text, not tags
_ODD = {"noscript", "template", "svg", "math", "object", "canvas", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_DROP_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head", "input", "option"} | _RAW | _ODD
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
_DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion menu nav navbar navigation navi breadcrumb breadcrumbs "
    "sidebar sidebox aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus replies reply respond discussion related recommended recommendations teaser share sharing social pagination pager tags tagcloud search copyright legal disclaimer hidden toc skip".split()
)
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption"}
_KIN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KIN_STOP = {"ul", "ol", "dl", "table", "select", "menu"}
#: A name with one of these words tells of an element's surroundings or contents, not what it is.
_QUALIFIERS = {"has", "have", "is", "no", "not", "non", "without", "with", "layout"}
#: Words of an article's parts; dropped outside of articles only.
_PARTS = {"header", "discussion"}
_READERS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
#: How drops are told: by a name, by a name of readers' text, or by tag, role or style.
_BY_NAME, _BY_READERS, _SURE = 1, 2, 3
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


_ARTICLE = re.compile(r"<article[\s>]", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return re.sub(r":\d*$", "", (m[1] if m else "").rpartition("@")[2].lower())


def _is_dropped(tag: str, attrs: dict[str, str], inside: set[str]) -> int:
    """0, or how the drop is told."""
    if tag in _DROP_TAGS or attrs.get("role", "").lower() in _DROP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return _SURE
    if tag == "header":  # of the page; an article's own header holds its title
        return 0 if inside else _SURE
    if tag in ("html", "body", "main", "article"):
        return 0
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return _SURE
    return _named(attrs, bool(inside))


def _named(attrs: dict[str, str], inside: bool) -> int:
    found: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _SPLIT.findall(name)}
        if not words & _QUALIFIERS:
            found |= words & _DROP_WORDS
    if inside:
        found -= _PARTS
    return _BY_READERS if found & _READERS else _BY_NAME if found else 0


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes, generalised: digits dropped, sorted."""
    classes = sorted({re.sub(r"\d+", "", c).strip("-_") for c in attrs.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


@lru_cache(maxsize=50_000)
def _facts(tag: str, raw: str) -> tuple[str, int, int, bool]:
    """(step, drop in an article, drop elsewhere, named as dropped) of a start tag; a page's header is dropped, an article's isn't."""
    attrs = {k.lower(): html_lib.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}
    return _step(tag, attrs), _is_dropped(tag, attrs, {"article"}), _is_dropped(tag, attrs, set()), _named(attrs, True) > 0


def _raw_end(tag: str, page: str, at: int) -> int | None:
    """Where a raw element's end tag ends; None if it is unclosed, which shows by the start tag of another one or of the body."""
    found = _raw_pattern(tag).search(page, at)
    return found.end() if found and found[0].startswith("</") else None


@lru_cache
def _raw_pattern(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>" + ("" if tag in ("script", "style") else rf"|<{tag}[\s>]|<body[\s>]|</head\s*>"), re.I)


def _plain(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = html_lib.unescape(text)
    return " ".join(text.split())


#: Prose that an element dropped by name must have, and its multiple of all that is kept, to be kept after all.
SPARE_CHARS, SPARE_TIMES = 200, 10


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """(path, text, characters in links, dropped) of each block of text, in page order; the path ends at the block's container."""
    spared: set[int] = set()
    while True:
        found, origin = _parsed(page, spared)
        kept, by = 0, defaultdict(int)
        for (_, text, links, dropped), at in zip(found, origin, strict=True):
            prose = max(0, len(text) - 2 * links)
            if not dropped:
                kept += prose
            elif at >= 0:
                by[at] += prose
        top = max(by, key=lambda k: (by[k], -k), default=-1)
        if top < 0 or by[top] < SPARE_CHARS or by[top] < SPARE_TIMES * kept:
            return found
        spared.add(top)


def _parsed(page: str, spared: set[int]) -> tuple[list[tuple[str, str, int, bool]], list[int]]:
    """blocks() where the elements that start at the places `spared` aren't dropped by name; and of each block the place of
    the outermost element by whose name alone it is dropped, or -1."""
    out: list[tuple[str, str, int, bool]] = []
    origin: list[int] = []
    stack: list[tuple[str, str, int, int]] = []  # tag, path, drop, where it began
    one_article = len(_ARTICLE.findall(page)) == 1
    parts: list[str] = []
    links = linked = 0
    at, n = 0, len(page)
    find, match = page.find, _TOKEN.match

    def flush() -> None:
        nonlocal links
        text = _plain(parts)
        if text:
            out.append((stack[-1][1] if stack else "", text, min(links, len(text)), bool(stack and stack[-1][2])))
            origin.append(stack[-1][3] if stack and stack[-1][2] == _BY_NAME else -1)
        parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal linked
        while len(stack) > depth:
            if parts and stack[-1][0] not in _INLINE:
                flush()
            if stack.pop()[0] == "a":
                linked -= 1

    while at < n:
        i = find("<", at)
        if i != at:
            parts.append(page[at:] if i < 0 else page[at:i])
            if linked:
                links += len(parts[-1])
            if i < 0:
                break
        m = match(page, i)
        if not m:
            parts.append("<")
            at = i + 1
            continue
        at = m.end()
        end, tag, raw = m.groups()
        if not tag:
            if page.startswith("<![CDATA[", i):
                parts.append(html_lib.escape(page[i + 9 : at - 3]))
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if end:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    close(d)
                    break
            else:
                if tag == "p" and parts:
                    flush()
            continue
        if tag in _CLOSES_P:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    close(d)
                    break
                if stack[d][0] not in _INLINE:
                    break
        elif tag in _KIN:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in _KIN_STOP:
                    break
                if stack[d][0] in _KIN[tag]:
                    close(d)
                    if tag != "tr":
                        break
        if tag in _RAW or tag in _ODD:
            parts.append(" ")
            if raw.endswith("/") and tag not in ("script", "style"):
                continue
        if tag in _RAW and (closing := _raw_end(tag, page, at)):
            at = closing
            continue
        if tag == "body":  # an unclosed head or title ends here
            close(next((d for d in range(len(stack)) if stack[d][0] in ("head", "title")), len(stack)))
        inline = tag in _INLINE
        if parts and not inline:
            flush()
        if tag in _VOID or (raw.endswith("/") and tag not in _CLOSES_P):
            continue
        _, above, dropped, began = stack[-1] if stack else ("", "", 0, -1)
        step, within, outside, named = _facts(tag, raw)
        if dropped < _SURE and (tag == "main" or (tag == "article" and one_article)) and not named:
            dropped_here = outside  # ends a drop by name
        else:
            own = outside if outside == within or not any(t in ("article", "main") for t, *_ in stack) else within
            dropped_here = max(dropped, 0 if own == _BY_NAME and i in spared else own)
        if bool(dropped_here) != bool(dropped) and parts:
            flush()
        stack.append((tag, above if inline else f"{above}>{step}" if above else step, dropped_here, began if dropped else i))
        linked += tag == "a"
    close(0)
    if parts:
        flush()
    return out, origin


_NAMED = {"article": 1.5, "main": 1.3}


@lru_cache(maxsize=50_000)
def _containers(path: str) -> tuple[tuple[str, float], ...]:
    """Containers of a path, from the inside, and what a character of the path's block counts in each."""
    steps = path.split(">") if path else []
    out = []
    for depth in range(len(steps), 0, -1):
        tag = steps[depth - 1].partition(".")[0]
        if tag not in _LEAVES:
            out.append((">".join(steps[:depth]), 0.97 ** (len(steps) - depth) * _NAMED.get(tag, 1.0)))
    return tuple(out)


def scores(found: list[tuple[str, str, int, bool]]) -> dict[str, float]:
    """Score of every container of a page: prose of the blocks in it, those far below it counting less, less what is boilerplate."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for path, text, links, dropped in found:
        sums[path][dropped] += len(text) - (0.0 if dropped else 2.0 * links)
    by: dict[str, float] = defaultdict(float)
    for path, (prose, boilerplate) in sums.items():
        for top, weight in _containers(path):
            by[top] += prose * weight - boilerplate
    return by


def best_container(found: list[tuple[str, str, int, bool]]) -> tuple[str | None, float]:
    """The container with the highest score; ties to the shallower, then the smaller path."""
    own = scores(found)
    best = min(own, key=lambda k: (-own[k], k.count(">"), k), default=None)
    return (best, own[best]) if best is not None and own[best] > 0 else (None, 0.0)


#: A container outside the best one is main text too from this share of its score; so many at most.
CLOSE, ALSO = 0.5, 3


def main_containers(found: list[tuple[str, str, int, bool]]) -> tuple[list[str], float]:
    """The best container and those disjoint from it and each other that are close in score, and the best score."""
    own = scores(found)
    ranked = sorted((k for k in own if own[k] > 0), key=lambda k: (-own[k], k.count(">"), k))
    tops: list[str] = []
    for k in ranked:
        if own[k] < CLOSE * own[ranked[0]] or len(tops) > ALSO:
            break
        if not any(f"{k}>".startswith(f"{t}>") or f"{t}>".startswith(f"{k}>") for t in tops):
            tops.append(k)
    return tops, own[ranked[0]] if ranked else 0.0


def extract(found: list[tuple[str, str, int, bool]], winner: str | None) -> str:
    """The text below the winning containers, one a line (else the page's own), in page order, without dropped blocks."""

    def below(tops: list[str]) -> list[str]:
        inside = tuple(f"{t}>" for t in tops)
        return [t for p, t, _, dropped in found if not dropped and f"{p}>".startswith(inside)]

    text = below(winner.split("\n")) if winner else []
    own, score = main_containers(found)
    if not text or 4 * sum(map(len, text)) < score:
        text = below(own) if own else text or [t for _, t, _, dropped in found if not dropped]
    return " ".join(text)


def _votes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, also): votes for a best container, with an empty also, and for each that is close to it."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("also", pa.string()), ("votes", pa.int64()), ("score", pa.int64())])
    for batch in it:
        votes: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            tops, score = main_containers(blocks(page.as_py() or ""))
            for also in ["", *tops[1:]] if tops else ():
                v = votes[host_of(url.as_py()), tops[0], also]
                v[0] += 1
                v[1] += int(score)
        if votes:
            yield batch_of(schema, *[[k[i] for k in votes] for i in range(3)], [v for v, _ in votes.values()], [s for _, s in votes.values()])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container with most votes of each host, ties to more score, then the shorter and smaller path; with
    it, each on a line of its own, those close to it on half of the pages that voted for it (a bounded number)."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, also string, votes long, score long")
    votes = stage_table(votes.groupBy("host", "path", "also").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score")), "host-votes")
    rank = F.struct("votes", "score", (-F.length("path")).alias("l"), F.col("path").alias("p"))
    won = votes.filter("also = ''").groupBy("host").agg(F.max_by("path", rank).alias("path"), F.max("votes").alias("most"))
    also = votes.filter("also <> ''").join(won, ["host", "path"]).filter("2 * votes >= most").groupBy("host").agg(F.array_sort(F.collect_list("also")).alias("also"))
    return won.join(also, "host", "left").select("host", F.concat_ws("\n", "path", "also").alias("path"))


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        text = [extract(blocks(p.as_py() or ""), w.as_py()) for p, w in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])


#: Winning paths that a broadcast may hold; more are joined by host in a shuffle.
BROADCAST_HOSTS = 200_000


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text of every page."""
    won = stage_table(winning_paths(pages), "host-paths").select(F.col("host").alias("__h"), "path")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)), r"^.*@", ""), r":\d*$", "")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    both = pages.withColumn("__host", host)
    both = both.join(F.broadcast(won) if won.count() <= broadcast_hosts else won, F.col("__host") == F.col("__h"), "left")
    return both.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string")


def op4_html_extraction(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
