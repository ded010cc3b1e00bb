"""HTML main text by nearest-URL page differencing.

Every page is read into text lines, one per block, each with what its place in the markup
says about it.  Pages of a host are put in URL path order; a page is compared with its
neighbour in that order, the lines of both are aligned by longest common subsequence, and
shared lines are deleted as template text, inside a marked article and outside.  Article
marks are a check only: where the neighbour is a copy of the page, marked lines stay.  Lines
in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
are never text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, drop_cut
from riskframe.llm.urls import host_and_path

#: Fixed values of HTML: elements without content, elements of raw text, elements that start a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noframes", "noembed", "xmp", "title", "svg", "math", "object", "canvas", "audio", "video", "select", "button"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
         "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose open tag ends an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, roles and words of class or id that mark template parts.
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar",
         "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "share", "sharing",
         "social", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
         "comment", "comments", "disqus", "replies", "pagination", "pager", "copyright", "legal", "disclaimer", "toolbar", "skip"}
#: Those that mark template parts wherever they stand.
STRONG = {"ad", "ads", "advert", "advertisement", "comment", "comments", "notice"}
#: Classes that mark the text itself.
BODY_WORDS = {"article", "post", "entry", "story", "content", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)|([^\s=/>\"']+)")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def _attributes(raw: str) -> dict[str, str]:
    return {(a or c).lower(): unescape(b.strip("\"'")) if b else "" for a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t\r") else {}


def _marks(name: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """(template part, article part) of an open tag; ``inside`` an article a header is its own."""
    a = _attributes(raw)
    words = {w for key in ("class", "id") for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a.get(key, "")).lower())}
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower())
    article = name in ("article", "main") or a.get("role") in ("main", "article")
    template = bool(name in CHROME or a.get("role") in ROLES or hidden)
    if not article and name not in ("html", "body"):
        template = template or bool(words & WORDS and not (inside and name in ("span", "b", "i", "em", "strong", "a", "p", "h1", "h2", "h3")
                                                            and not words & STRONG))
    elif name == "article" or a.get("role") == "article":
        classes, ident = set(a.get("class", "").lower().split()), a.get("id", "").lower()
        strong = {_SPLIT.split(c)[0] for c in classes} | {ident.rstrip("0123456789").rstrip("-_")}
        template = template or bool((classes | {ident}) & WORDS or strong & STRONG and not classes & BODY_WORDS)
    return template, article


def lines_of(html: str) -> list[tuple[str, bool]]:
    """(text, in article) of every block of the whole page outside template parts, in order.

    Character references are decoded after the markup is taken apart, white space inside
    a block becomes one space.  Markup left open at the end is closed there.
    """
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []      # name, template, article
    template = article = 0
    held: list[str] = []

    def flush():
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text and not template:
                out.append((text, article > 0))

    def pop_to(depth: int):
        nonlocal template, article
        while len(stack) > depth:
            _, t, a = stack.pop()
            template -= t
            article -= a

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at:m.start()]))
        at = m.end()
        if m.group(2) is None:
            continue
        name, closing = m.group(2).lower(), bool(m.group(1))
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCK:
                flush()
            elif name == "br":
                held.append(" ")
            if depth is not None:
                if any(t for _, t, _ in stack[depth:]) or any(s[0] in BLOCK for s in stack[depth + 1:]):
                    flush()
                pop_to(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not m.group(3).endswith("/"):
                at = end.end() if end else n
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            elif name == "br":
                held.append(" ")
            continue
        is_template, is_article = _marks(name, m.group(3), article > 0)
        if name in BLOCK or is_template or is_article:
            flush()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(name, ()):
                pop_to(i)
                break
            if stack[i][0] in BLOCK:
                break
        stack.append((name, is_template, is_article))
        template += is_template
        article += is_article
    flush()
    return out


#: Pairs of equal lines that are listed one by one; more are aligned in bits, in linear space.
MATCHES = 4_000_000


def _lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``xs`` and each prefix of ``ys``: a bit vector over ``ys``, a step for each x."""
    at: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        at.setdefault(y, []).append(j)
    bits, full = {}, (1 << len(ys)) - 1
    for x in set(xs):
        mask = np.zeros(len(ys), np.uint8)
        mask[at.get(x, [])] = 1
        bits[x] = int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")
    v = full
    for x in xs:
        u = v & bits[x]
        v = ((v + u) | (v - u)) & full
    up = np.unpackbits(np.frombuffer(v.to_bytes((len(ys) + 7) // 8, "little"), np.uint8), count=len(ys), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - up.astype(np.int64))))


def _aligned(xs: list[str], ys: list[str]) -> list[int]:
    """Places in ``xs`` of a longest common subsequence with ``ys``, by halving (Hirschberg)."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and xs[a] == ys[c]:
            out.append(a)
            a, c = a + 1, c + 1
        while a < b and c < d and xs[b - 1] == ys[d - 1]:
            b, d = b - 1, d - 1
            out.append(b)
        if a == b or c == d:
            continue
        if b - a == 1:
            if xs[a] in ys[c:d]:
                out.append(a)
            continue
        mid = (a + b) // 2
        split = c + int(np.argmax(_lengths(xs[a:mid], ys[c:d]) + _lengths(xs[mid:b][::-1], ys[c:d][::-1])[::-1]))
        todo += [(a, mid, c, split), (mid, b, split, d)]
    return out


def unshared(lines: list[str], other: list[str]) -> list[bool]:
    """False for the lines that a longest common subsequence shares with ``other``.

    Lines are compared as wholes.  Common ends go first; what is left is aligned by a
    table of its common lines only, so its size follows what the pages share.
    """
    keep = [True] * len(lines)
    lo, a, b = 0, len(lines), len(other)
    while lo < min(a, b) and lines[lo] == other[lo]:
        keep[lo] = False
        lo += 1
    while a > lo and b > lo and lines[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
        keep[a] = False
    common = set(lines[lo:a]) & set(other[lo:b])
    xs = [i for i in range(lo, a) if lines[i] in common]
    places: dict[str, list[int]] = {}
    for j in range(b - 1, lo - 1, -1):
        if other[j] in common:
            places.setdefault(other[j], []).append(j)
    if sum(len(places[lines[i]]) for i in xs) > MATCHES:               # equal lines in great numbers
        for i in _aligned([lines[i] for i in xs], [x for x in other[lo:b] if x in common]):
            keep[xs[i]] = False
        return keep
    ends: list[int] = []
    last: list[tuple] = []
    for i in xs:                                   # longest increasing chain of matched places
        for j in places[lines[i]]:
            k = bisect_left(ends, j)
            node = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k] = j
                last[k] = node
    node = last[-1] if last else None
    while node:
        keep[node[0]] = False
        node = node[1]
    return keep


def main_text(lines: list[tuple[str, bool]], other: list[str] | None) -> str:
    """The page's text: its marked article, and of the other lines those its neighbour does not share.

    Lines inside article marks stay, also where the neighbour holds them too (a licence
    line, a short paragraph): two articles may share a line.  The neighbour's longest
    common subsequence decides on all other lines.  Without a neighbour the marks alone
    decide.  A page without article marks whose every line is shared, or that has no
    neighbour, keeps its lines.
    """
    texts = [t for t, _ in lines]
    marked = [t for t, article in lines if article]
    if other is None:
        return "\n".join(marked or texts)
    keep = [k or article for k, (_, article) in zip(unshared(texts, other), lines)]
    return "\n".join(t for t, k in zip(texts, keep) if k) if any(keep) else "\n".join(texts)


#: Twice the pages of a part, the pages that one task compares.
HOST_PAGES = 1024
#: Parts at most, besides those that ranges add: more pages make larger parts, so that the list of starts stays small.
PARTS = 50_000

_ORDER = ("host", "path", "page_id", "mark")


def _place(host: bytes, path: bytes, page: int | None, mark: int) -> tuple:
    """A page's place in Spark's order of its columns, null first."""
    return host, path, -(1 << 63) - 1 if page is None else page, mark


def _hashed(rows: DataFrame) -> DataFrame:
    """(host, path, page_id, mark, same) of every row; ``same`` is a hash of its lines."""
    def run(batches):
        for batch in batches:
            same = [xxhash.xxh128_digest("\n".join(t for t, _ in lines_of(h))) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ORDER), pa.array(same, pa.binary())], [*_ORDER, "same"])
    return rows.mapInArrow(run, "host binary, path binary, page_id long, mark long, same binary")


_EDGES = ("first", "first_other", "last", "last_other")


def _edges(ordered: DataFrame, step: int) -> DataFrame:
    """For every ``step`` pages in order: the first page, the next of its host with other lines, the last, and the one before with other lines."""
    names = (*_ORDER, "same")

    def run(batches):
        part, n = None, 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if part is None or n >= step and row[:4] != part[2][:4]:       # equal places stay together
                    if part:
                        out.append(part)
                    part, n = [row, None, row, None], 1
                    continue
                first, _, last, _ = part
                if part[1] is None and row[0] == first[0] and row[4] != first[4]:
                    part[1] = row
                if row[0] != last[0]:
                    part[3] = None
                elif row[4] != last[4]:
                    part[3] = last
                part[2] = row
                n += 1
            if out:
                yield batch_of(out)
        if part:
            yield batch_of([part])

    kind = pa.struct([("host", pa.binary()), ("path", pa.binary()), ("page_id", pa.int64()), ("mark", pa.int64()), ("same", pa.binary())])

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array([x and dict(zip(names, x)) for x in c], kind) for c in zip(*parts)], list(_EDGES))
    one = "struct<host: binary, path: binary, page_id: bigint, mark: bigint, same: binary>"
    return ordered.mapInArrow(run, ", ".join(f"{e} {one}" for e in _EDGES))


def _guests(parts: list[tuple]) -> dict[tuple, list[int]]:
    """place -> parts that need this page of another part as a neighbour.

    These are the last page of the host before the part, the one before that with other
    lines, and the first page of the host behind the part with lines other than its last.
    """
    out: dict[tuple, list[int]] = {}

    def invite(page, p):
        out.setdefault(_place(*page[:4]), []).append(p)
    last = other = None
    for p, (first, _, end, end_other) in enumerate(parts):
        if last is not None and last[0] == first[0]:
            for page in (last, other):
                if page is not None:
                    invite(page, p)
        if end_other is None and last is not None and last[0] == first[0] == end[0]:
            other = last if last[4] != end[4] else other
        else:
            other = end_other
        last = end
    behind = None                                              # for part p + 1: what follows its last page
    for p in range(len(parts) - 2, -1, -1):
        end, (first, first_other, next_end, _) = parts[p][2], parts[p + 1]
        if first[0] != end[0]:
            behind = None
        elif first[4] != end[4]:
            behind = first
        elif first_other is not None:
            behind = first_other
        elif next_end[0] != end[0]:
            behind = None
        if behind is not None:
            invite(behind, p)
    return out


def _dealt(rows: DataFrame, starts: list[tuple], guests: dict[tuple, list[int]]) -> DataFrame:
    """The lines of every row with its part; pages that other parts need go there too, as guests."""
    def run(batches):
        for batch in batches:
            got = [lines_of(h) for h in batch.column("html").to_pylist()]
            at, part, guest = [], [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in _ORDER))):
                place = _place(*row)
                for p in (bisect_right(starts, place) - 1, *guests.get(place, ())):
                    guest.append(bool(at and at[-1] == i))
                    at.append(i)
                    part.append(p)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("page_id", "url", *_ORDER[:2], "mark")), pa.array(part, pa.int32()),
                 pa.array(guest, pa.bool_()), pa.array([[t for t, _ in got[i]] for i in at], pa.list_(pa.string())),
                 pa.array([[a for _, a in got[i]] for i in at], pa.list_(pa.bool_()))],
                ["page_id", "url", "host", "path", "mark", "part", "guest", "line", "article"])
    return rows.mapInArrow(run, "page_id long, url string, host binary, path binary, mark long, part int, guest boolean, "
                                "line array<string>, article array<boolean>")


def _difference(batches):
    """Rows sorted by part and place: each page but guests against the nearest one with other lines."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64())])
    out, known = [], [None, None, 0]

    def finish(page, url, line, article, other):
        if known[0] != article:
            known[:] = article, main_text(list(zip(line, article)), other), unshared(line, other).count(False) if other is not None else 0
        out.append((page, url, known[1], len(known[1]), known[2]))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    group, now, before, early, weight = None, None, None, [], 0
    for batch in batches:
        for page, url, host, part, guest, line, article in zip(*(c.to_pylist() for c in batch.columns)):
            new = (host, part) != group
            if new or line != now:
                known[0] = None
                for p, u, a in early:                          # a host's first lines: against the next ones
                    finish(p, u, now, a, None if new else line)
                early, known[0] = [], None
                before, now = None if new else now, line
                group = host, part
            if guest:
                continue
            if before is None:
                early.append((page, url, article))
            else:
                finish(page, url, line, article, before)
                weight += len(known[1])
            if weight > 8_000_000:
                yield batch_of(out)
                out.clear()
                weight = 0
    known[0] = None
    for p, u, a in early:
        finish(p, u, now, a, None)
    if out:
        yield batch_of(out)


def extract(pages: DataFrame, host_pages: int = HOST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of ``pages`` (page_id, url, html).

    Null html is the empty page with empty text; a null url has the empty host and path.
    Pages of a host are ordered by path, then page_id, and a page's neighbour is the page
    before it (the one after, for the first) whose lines differ; repeated pages are one
there and still get a row each.  Pages are cut in that order into parts of half
    ``host_pages``, so that no task sorts a whole large host; the neighbours that lie in
    other parts are copied there, so the cuts do not change results.  Other
    columns are ignored; an empty table gives no rows.  ``n_shared`` counts the lines a
    page shares with its neighbour.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .select("page_id", "url", host.cast("binary").alias("host"), path.cast("binary").alias("path"), F.xxhash64("html").alias("mark"), "html")
    hashed = cut(_hashed(rows), "pages-order")
    step = max(1, host_pages // 2, -(-hashed.count() // PARTS))
    found = _edges(hashed.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER), step).collect()
    drop_cut(hashed)
    parts = sorted((tuple(e and tuple(bytes(v) if isinstance(v, bytearray) else v for v in e) for e in r) for r in found),
                   key=lambda p: _place(*p[0][:4]))
    return _dealt(rows, [_place(*p[0][:4]) for p in parts], _guests(parts)) \
        .repartition("part").sortWithinPartitions("part", *_ORDER) \
        .select("page_id", "url", "host", "part", "guest", "line", "article") \
        .mapInArrow(_difference, "page_id long, url string, text string, n_chars long, n_shared long")
