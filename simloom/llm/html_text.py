"""HTML extraction with a suffix array for each host.

A page is split into blocks of its main part (an article or main element, or the body where there is none). Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments go by their elements, roles and names: ``html``, ``body``, ``main``
and ``article`` never go, nor does an element that holds an article or main element; a class or id that is made of such names alone
decides by itself, one that only contains such a name needs links as half of the element's text. An unwanted element that is never
closed ends where an article or main element begins.

Boilerplate without such marks is found over a host's pages. Their token streams are concatenated and sorted into a suffix array; with
the lengths of common prefixes it tells, for any piece of text, how many distinct pages hold it. Pieces of ``MIN_RUN`` tokens or more
count: blocks (a shorter block with its neighbours), and chunks that the tokens themselves delimit; those only that at least half as many
pages have as a piece of their own as must hold them. A block goes as a whole, if one repeated substring covers it that is held by

* at least ``OUTSIDE`` pages and a fifth of the host's, on a page without an article or main element;
* at least ``OUTSIDE`` pages and four fifths of the host's, on a page with one, so that passages that many articles quote stay.

Copies of a page do not count against it: of the pages that hold a block those go off that hold most of the page (the number that hold
its chunks, at the lower fifth of its tokens, less one). So copies and near copies keep their texts, and lose a notice that other pages have.

A host with over ``SHARD_BYTES`` of html is dealt to shards by a hash of the row, so no task holds a whole large host, and the result
does not depend on it: shards count the pages that have a piece of their own, and name the pieces that a twentieth of their pages have. Of a
piece that a tenth of the host's pages have (half of a fifth), shards that do not name it have less than a twentieth, so the sum of the named counts
is a twentieth at least. Pieces with such a sum, a few times as many as a page has, are counted by all shards in their own suffix
arrays, and the sums over all shards decide. Only digests, these pieces, and counts move.

Defined results: null and empty html gives an empty text; a null url is a host of its own; repeated rows give a row each; an empty
table gives no rows; other columns are never read. Cut-off pages and unclosed elements are read as far as they go.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.common import broadcast_if, durable, in_arrow, read_table

MIN_RUN, OUTSIDE, SHARD_BYTES = 4, 5, 1 << 20
SHARE_OUTSIDE, SHARE_INSIDE = 0.2, 0.8
BROADCAST_BYTES = 16 << 20
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S | re.I)
GONE = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "object", "canvas", "head"}
MAIN = {"article", "main"}
NEVER = MAIN | {"html", "body"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "newsletter", "subscribe", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "commentlist", "disqus", "share", "sharing", "social", "related", "widget", "popup", "modal", "overlay", "login", "signup", "search", "pagination", "toolbar"}
#: Parts of a name that say nothing about what the element holds.
NEUTRAL = {"", "site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "wrap", "wrapper", "container", "area", "section", "box", "block", "bar", "inner", "outer", "list", "links", "buttons", "icons", "form", "thread", "mobile", "desktop", "sticky", "fixed"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
UNWANTED, PERHAPS = 2, 1


def verdict(tag: str, attributes: str, inside: bool) -> int:
    """UNWANTED, PERHAPS (if links make up half of its text) or 0, by an element's name and attributes."""
    if tag in NEVER:
        return 0
    if tag in GONE or tag == "header" and not inside:
        return UNWANTED
    out = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            own = NAMES if inside else NAMES | {"header"}
            words = [re.split(r"[_-]+", w) for w in value.split()]
            hits = [w for w in words if any(x in own for x in w)]
            if hits:
                plain = all(x in own or x in NEUTRAL or x.isdigit() for w in words for x in w)
                out = max(out, UNWANTED if plain else PERHAPS)
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return UNWANTED
    return out


def elements(page: str) -> tuple[list, dict[int, int], set[int]]:
    """Marks (start, end, element, whether it closes, attributes); of each opening mark the mark that ends its element; those whose end
    is not written."""
    marks, until, unclosed, stack = [], {}, set(), []

    def pop(at: int) -> None:
        i = stack.pop()
        until[i] = at
        unclosed.add(i)

    for m in TAG.finditer(page):
        tag = (m[3] or m[6] or "").lower()
        closing, attributes, k = bool(m[2] or m[5]), m[4] or m[7] or "", len(marks)
        marks.append((m.start(), m.end(), tag, closing, attributes))
        if not tag or tag in VOID:
            continue
        if closing:
            if any(marks[i][2] == tag for i in stack):
                while marks[stack[-1]][2] != tag:
                    pop(k)
                until[stack.pop()] = k
            continue
        if stack and (marks[stack[-1]][2] == "p" and tag not in INLINE or tag in OPTIONAL_END and marks[stack[-1]][2] == tag):
            pop(k)
        if not attributes.endswith("/"):
            stack.append(k)
    while stack:
        pop(len(marks))
    return marks, until, unclosed


def dropped(page: str, marks: list, until: dict[int, int], unclosed: set[int]) -> dict[int, int]:
    """Opening marks of unwanted elements, and the marks where they end."""
    depth, links, text, mains = 0, [0], [0], [0]
    inside_until, gone_until, out = -1, -1, {}
    perhaps = [i for i in until if (v := marks[i]) and v[4] and v[2] not in NEVER and verdict(v[2], v[4], True) == PERHAPS]
    if perhaps:
        for k, (_, end, tag, closing, _) in enumerate(marks):
            if tag == "a":
                depth = 0 if closing else 1
            n = len(page[end : marks[k + 1][0] if k + 1 < len(marks) else len(page)].strip())
            text.append(text[-1] + n)
            links.append(links[-1] + n * depth)
    for _, _, tag, closing, _ in marks:
        mains.append(mains[-1] + (tag in MAIN and not closing))
    for i in sorted(until):
        _, _, tag, _, attributes = marks[i]
        if i < gone_until:
            continue
        z, inside = until[i], i < inside_until
        if tag in MAIN:
            inside_until = max(inside_until, z)
            continue
        v = verdict(tag, attributes, inside) if attributes or tag in GONE or tag == "header" else 0
        if not v:
            continue
        if mains[z] > mains[i + 1]:  # it holds an article or main element
            if i in unclosed and v == UNWANTED:
                z = next(k for k in range(i + 1, z) if marks[k][2] in MAIN and not marks[k][3])
            elif tag not in GONE - {"form"} and tag != "header":
                continue
        elif v == PERHAPS and (links[z] - links[i]) * 2 < max(text[z] - text[i], 1):
            continue
        out[i] = gone_until = z
    return out


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """(inside an article or main element, text) of each wanted block in page order."""
    page = page or ""
    marks, until, unclosed = elements(page)
    gone_to = dropped(page, marks, until, unclosed)
    out: list[tuple[bool, str]] = []
    text: list[str] = [page[: marks[0][0]] if marks else page]
    inside_until = gone_until = -1

    def end_block(inside: bool) -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((inside, joined))
        text.clear()

    for k, (_, end, tag, closing, _) in enumerate(marks):
        if k >= gone_until:
            if tag == "br":
                text.append(" ")
            elif tag and tag not in INLINE:
                end_block(k <= inside_until)
            if not closing and tag in MAIN and k in until:
                inside_until = max(inside_until, until[k])
            if k in gone_to:
                gone_until = gone_to[k]
        if k >= gone_until:
            text.append(page[end : marks[k + 1][0] if k + 1 < len(marks) else len(page)])
    end_block(len(marks) <= inside_until)
    return out


def main_part(page: list[tuple[bool, str]]) -> list[tuple[bool, str]]:
    return [b for b in page if b[0]] or page


class Suffixes:
    """Suffix array, and lengths of common prefixes, of token streams that are concatenated. Tokens that are in no run of ``MIN_RUN``
    tokens of ``least`` occurrences are left out: no substring of as many occurrences holds them.

    A place is the start of a run; a substring of n tokens is n - MIN_RUN + 1 runs in succession.
    """

    def __init__(self, streams: list[list[str]], least: int = 1, asked: int | None = None):
        """asked: only runs that a stream from this one on has count."""
        sizes = np.array([len(s) for s in streams], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        words = pd.factorize(np.array([w for s in streams for w in s], dtype=object))[0].astype(np.uint64)
        owner = np.repeat(np.arange(len(streams)), sizes)
        n = len(words)
        run = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(MIN_RUN):
                run[: n - j] = (run[: n - j] ^ words[j:]) * np.uint64(0x9E3779B97F4A7C15)
                run ^= run >> np.uint64(29)
        whole = np.zeros(n, bool)
        whole[: max(n - MIN_RUN + 1, 0)] = owner[: max(n - MIN_RUN + 1, 0)] == owner[MIN_RUN - 1 :]
        places = np.flatnonzero(whole)
        rank, times = np.unique(run[places], return_inverse=True, return_counts=True)[1:]
        alive = times[rank] >= least
        if asked is not None:
            wanted = np.zeros(len(times), bool)
            wanted[rank[owner[places] >= asked]] = True
            alive &= wanted[rank]
        self.places, rank = places[alive], np.unique(rank[alive], return_inverse=True)[1].astype(np.int64)
        self.owner, m = owner[self.places], int(alive.sum())
        self.at = np.full(n + 1, -1, np.int64)
        self.at[self.places] = np.arange(m)
        last = np.ones(m, bool)
        last[:-1] = (self.places[1:] != self.places[:-1] + 1) | (self.owner[1:] != self.owner[:-1])
        ends = np.flatnonzero(last)
        self.left = ends[np.searchsorted(ends, np.arange(m))] - np.arange(m) + 1  # runs in succession from here
        ranks, length = [rank], 1
        while m and length < self.left.max():
            after = np.full(m, -1, np.int64)
            more = np.flatnonzero(self.left > length)
            after[more] = rank[more + length]
            new = np.unique(rank * (m + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            if new.max() == rank.max():
                break
            rank, length = new, 2 * length
            ranks.append(rank)
        self.order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[self.order] = np.arange(m)
        self.lcp = self._common(ranks)

    def _common(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Runs that each suffix of the order shares with the one before it; -1 for the first."""
        m = len(self.order)
        shared = np.zeros(m, np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        most = np.minimum(self.left[a], self.left[b]) if m else a
        open_ = np.ones(len(a), bool)
        twice = [*range(len(ranks)), len(ranks) - 1]  # equal to the last rank is equal as far as both go
        for k in reversed(twice):
            i = np.flatnonzero(open_ & (shared[1:] < most))
            same = i[ranks[k][a[i]] == ranks[k][b[i]]]
            while len(same):
                step = np.minimum(1 << k, most[same] - shared[1:][same])
                shared[1:][same] += step
                going = shared[1:][same] < most[same]
                same = same[going]
                a[same] += 1 << k
                b[same] += 1 << k
                if k < len(ranks) - 1:
                    break
                same = same[ranks[k][a[same]] == ranks[k][b[same]]]
        if m:
            shared[0] = -1
        return shared

    @staticmethod
    def _next_below(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each query the first index from ``start`` on whose value is under ``bound`` (the length if there is none), by a tree of minima."""
        size = 1 << int(len(values)).bit_length()
        level = np.full(size, -2, np.int64)
        level[: len(values)] = values
        tree = [level]
        while len(tree[-1]) > 1:
            tree.append(tree[-1].reshape(-1, 2).min(1))
        node, found = start.copy(), np.full(len(start), -1, np.int64)
        for k, low in enumerate(tree):
            i = np.flatnonzero((found < 0) & ((node & 1) == 1) | (found < 0) & (k == len(tree) - 1))
            hit = low[np.minimum(node[i], len(low) - 1)] < bound[i]
            found[i[hit]] = k
            node[i[~hit]] += 1
            up = found < 0
            node[up] >>= 1
        for k in range(len(tree) - 1, 0, -1):
            i = np.flatnonzero(found == k)
            child = 2 * node[i]
            node[i] = np.where(tree[k - 1][child] < bound[i], child, child + 1)
            found[i] = k - 1
        return np.minimum(node, len(values))

    def interval(self, places: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the suffixes in order that begin with so many runs from a place."""
        r, m = self.rank[places], len(self.order)
        hi = self._next_below(self.lcp, r + 1, runs) - 1
        lo = m - 1 - self._next_below(self.lcp[::-1], m - 1 - r, runs)
        return lo, hi

    def pages(self, stream: np.ndarray, start: np.ndarray, length: np.ndarray, least: int = 1, real: int | None = None) -> np.ndarray:
        """How many of the first ``real`` streams hold each substring of ``MIN_RUN`` tokens or more; 0 if under ``least``."""
        out = np.zeros(len(stream), np.int64)
        if not len(self.order):
            return out
        at = self.at[self.first[stream] + start]
        runs = length - MIN_RUN + 1
        alive = np.flatnonzero((at >= 0) & (self.left[at] >= runs))
        lo, hi = self.interval(at[alive], runs[alive])
        wide = hi - lo + 1 >= least
        alive, both = alive[wide], lo[wide] * len(self.order) + hi[wide]
        each, of = np.unique(both, return_inverse=True)
        counts = np.zeros(len(each), np.int64)
        for i, x in enumerate(each.tolist()):
            lo, hi = divmod(x, len(self.order))
            held = np.unique(self.owner[self.order[lo : hi + 1]])
            counts[i] = len(held) if real is None else np.searchsorted(held, real)
        out[alive] = np.where(counts >= least, counts, 0)[of]
        return out

    def maximal_repeats(self, least: int = 2) -> list[tuple[int, int, int]]:
        """(place of a first token, tokens, distinct streams) of every substring of ``MIN_RUN`` tokens or more that ``least`` streams hold
        and that cannot be made longer to the right without losing an occurrence."""
        out, seen = [], set()
        for r in range(1, len(self.order)):
            if self.lcp[r] > 0:
                lo, hi = self.interval(self.order[r : r + 1], self.lcp[r : r + 1])
                key = (int(lo[0]), int(hi[0]))
                if key not in seen:
                    seen.add(key)
                    pages = len(np.unique(self.owner[self.order[key[0] : key[1] + 1]]))
                    if pages >= least:
                        out.append((int(self.places[self.order[r]]), int(self.lcp[r]) + MIN_RUN - 1, pages))
        return out


class Page:
    """Blocks, tokens and pieces of a page's main part. A piece is a start and a length in tokens."""

    def __init__(self, cell: bytes | None):
        self.blocks = main_part(unpacked(cell))
        self.raw = " ".join(t for _, t in self.blocks).encode("utf-8", "surrogatepass")  # one space between tokens, as blocks have them
        self.inside = bool(self.blocks) and self.blocks[0][0]
        self.ends = np.cumsum([0, *(t.count(" ") + 1 for _, t in self.blocks)]).tolist()
        self.n = self.ends[-1]
        data = np.frombuffer(self.raw, np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, stops = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        self.starts, self.stops = starts.tolist(), stops.tolist()
        self.of_block = [self._around(i) for i in range(len(self.blocks))]
        self.chunks = self._chunks(data, starts, stops)

    def tokens(self) -> list[str]:
        return self.raw.decode("utf-8", "surrogatepass").split(" ") if self.n else []

    def _around(self, i: int) -> list[tuple[int, int]]:
        """A block of ``MIN_RUN`` tokens, or the shortest pieces from or up to a shorter one that have as many."""
        a, z = self.ends[i], self.ends[i + 1]
        if z - a >= MIN_RUN:
            return [(a, z - a)]
        up = next((e for e in self.ends[i + 1 :] if e - a >= MIN_RUN), None)
        down = next((e for e in reversed(self.ends[: i + 1]) if z - e >= MIN_RUN), None)
        return ([(a, up - a)] if up is not None else []) + ([(down, z - down)] if down is not None else [])

    def _chunks(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
        """Pieces of ``MIN_RUN`` tokens or more that begin at tokens whose sum of bytes says so, so that equal passages are cut alike."""
        if self.n < MIN_RUN:
            return []
        sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(data, dtype=np.uint32)])
        begins = np.flatnonzero(((sums[stops] - sums[starts]) * np.uint32(2654435761)) >> np.uint32(29) == 0)
        cuts = [0]
        for i in begins.tolist():
            if MIN_RUN <= i - cuts[-1] and i <= self.n - MIN_RUN:
                cuts.append(i)
        return [(a, z - a) for a, z in zip(cuts, [*cuts[1:], self.n])]

    def pieces(self) -> list[tuple[int, int]]:
        return list(dict.fromkeys([*(p for own in self.of_block for p in own), *self.chunks]))

    def text(self, piece: tuple[int, int]) -> bytes:
        return self.raw[self.starts[piece[0]] : self.stops[piece[0] + piece[1] - 1]]

    def plain(self) -> str:
        return "\n".join(t for _, t in self.blocks)

    def kept(self, held: dict[tuple[int, int], int], pages: int) -> str:
        """Its text. held: how many of the host's ``pages`` pages hold a piece, of pieces that enough do."""
        need = needed(pages, SHARE_INSIDE if self.inside else SHARE_OUTSIDE)
        if not any(held.values()):
            return self.plain()
        copies, below = 1, 0
        for n, length in sorted((held.get(c, 1), c[1]) for c in self.chunks):
            copies, below = n, below + length
            if below * 5 > self.n:
                break
        common = [max((held.get(p, 1) for p in own), default=1) - copies + 1 >= need for own in self.of_block]
        return "\n".join(t for (_, t), c in zip(self.blocks, common) if not c)


def pages_of(cells: list[bytes | None]) -> list[Page]:
    return [Page(c) for c in cells]


def needed(pages: int, share: float) -> int:
    return max(OUTSIDE, at_least(pages, share))


def at_least(pages: int, share: float) -> int:
    return int(np.ceil(share * pages - 1e-9))


def own_counts(pages: list[Page]) -> Counter[bytes]:
    """How many pages have each text as a piece of their own."""
    return Counter(t for p in pages for t in {p.text(x) for x in p.pieces()})


def page_counts(pages: list[Page], least: int) -> list[dict[tuple[int, int], int]]:
    """For each page's pieces how many of the pages hold them, where ``least`` do and half as many have them as a piece of their own."""
    times = own_counts(pages)
    own = [[x for x in p.pieces() if times[p.text(x)] * 2 >= least] for p in pages]
    flat = np.array([(i, *x) for i, pieces in enumerate(own) for x in pieces], np.int64).reshape(-1, 3)
    out: list[dict[tuple[int, int], int]] = [{} for _ in pages]
    if len(flat):
        found = Suffixes([p.tokens() for p in pages], least).pages(*flat.T, least=least).tolist()
        for (i, a, n), held in zip(flat.tolist(), found):
            if held:
                out[i][a, n] = held
    return out


def host_texts(cells: list[bytes | None]) -> list[str]:
    """Texts of a host's pages, given their packed blocks."""
    pages = pages_of(cells)
    if len(pages) < OUTSIDE:
        return [p.plain() for p in pages]
    return [p.kept(held, len(pages)) for p, held in zip(pages, page_counts(pages, needed(len(pages), SHARE_OUTSIDE)))]


def checksum(text: bytes) -> bytes:
    return zlib.crc32(text).to_bytes(4, "little")


def digest(text: bytes) -> bytes:
    return checksum(text) + hashlib.blake2b(text, digest_size=16).digest()


def named_pieces(cells: list[bytes | None]) -> list[tuple[bytes, int]]:
    """Digest and count of the pieces that a twentieth of a shard's pages have."""
    pages = pages_of(cells)
    return [(digest(t), n) for t, n in own_counts(pages).items() if n >= at_least(len(pages), SHARE_OUTSIDE / 4)]


def told_pieces(cells: list[bytes | None], asked: set[bytes]) -> dict[str, int]:
    """The pieces of a shard's pages whose digests are asked for, and how many pages have them."""
    sums = {d[:4] for d in asked}
    return {t.decode("utf-8", "surrogatepass"): n for t, n in own_counts(pages_of(cells)).items() if checksum(t) in sums and digest(t) in asked}


def counted_pieces(cells: list[bytes | None], pieces: list[str]) -> list[int]:
    """How many of a shard's pages hold each piece."""
    pages, asked = [[w for _, t in main_part(unpacked(c)) for w in t.split()] for c in cells], [p.split(" ") for p in pieces]
    own = np.arange(len(asked))
    found = Suffixes([*pages, *asked], asked=len(pages)).pages(len(pages) + own, 0 * own, np.array([len(a) for a in asked], np.int64), real=len(pages))
    return found.tolist()


def shard_texts(cells: list[bytes | None], common: dict[str, int], pages: int) -> list[str]:
    """Texts of a shard's pages, given the common pieces of the host and its number of pages."""
    if not common:
        return ["\n".join(t for _, t in main_part(unpacked(c))) for c in cells]
    counts = {t.encode("utf-8", "surrogatepass"): n for t, n in common.items()}
    return [p.kept({x: n for x in p.pieces() if (n := counts.get(p.text(x)))}, pages) for p in pages_of(cells)]


def packed(page: list[tuple[bool, str]]) -> bytes:
    return "\x1e".join(f"{int(i)}{t}" for i, t in page).encode("utf-8", "surrogatepass")


def unpacked(cell: bytes | None) -> list[tuple[bool, str]]:
    return [(x[0] == "1", x[1:]) for x in cell.decode("utf-8", "surrogatepass").split("\x1e")] if cell else []


def bound(cells: list[bytes]) -> bytes:
    """Packed pages of a shard as one cell. Blocks hold neither separator: both are white space."""
    return zlib.compress(b"\x1d".join(cells), 6)


def unbound(cell: bytes) -> list[bytes]:
    return zlib.decompress(cell).split(b"\x1d")


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blocks`` for html: packed and compressed, for they are shuffled next."""
    columns = rows.columns
    names, at = [c for c in columns if c != "html"], columns.index("html")

    def parse(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                cells = pa.array([zlib.compress(packed(blocks(h)), 1) for h in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(c)) for c in names), cells], [*names, "blocks"])

    return in_arrow(rows, parse, rows.select(*names).schema.add("blocks", "binary"))


def large_hosts(rows: DataFrame, large: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts of the pages of large hosts. large: host and shards. A shard is a row from its first pass on, so its pages move once."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "shards")).select("page_id", "url", "html", "host", "shard")
    named_type = T.ArrayType(T.StructType().add("piece", "binary").add("own", "long"))
    kept = T.StructType().add("host", "string").add("shard", "long").add("page_id", T.ArrayType(T.StringType())).add("url", T.ArrayType(T.StringType())).add("blocks", "binary").add("named", named_type)

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [zlib.decompress(x) for x in pdf["blocks"]]
        named = [{"piece": d, "own": n} for d, n in named_pieces(cells)]
        row = {"host": pdf["host"].iloc[0], "shard": pdf["shard"].iloc[0], "page_id": [x if isinstance(x, str) else None for x in pdf["page_id"]], "url": [x if isinstance(x, str) else None for x in pdf["url"]], "blocks": bound(cells), "named": named}
        return pd.DataFrame({k: pd.Series([v], dtype=object if isinstance(v, (list, str, bytes)) else None) for k, v in row.items()})

    shards = durable(parsed(dealt).groupBy("host", "shard").applyInPandas(gathered, kept))
    sizes = durable(shards.groupBy("host").agg(F.sum(F.size("page_id")).alias("pages")).join(large, "host"))
    of_host = broadcast_if(sizes, large.count(), 100_000)
    every = large.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def to_shards(pieces: DataFrame, *columns: str) -> DataFrame:
        """The rows of each host as a list, for each of its shards."""
        whole = pieces.groupBy("host").agg(F.sum(F.octet_length("piece") + 16).alias("bytes")).join(large, "host").agg(F.coalesce(F.sum(F.col("bytes") * F.col("shards")), F.lit(0))).first()[0]
        return broadcast_if(every.join(pieces.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("pieces")), "host"), whole, BROADCAST_BYTES)

    def per_shard(run, pieces: DataFrame) -> DataFrame:
        """host, piece and n, summed over shards. run: from a shard's blocks and its host's pieces to a dict of counts."""

        def count(batches):
            for b in batches:
                for host, cells, asked in zip(*(b.column(i).to_pylist() for i in range(3))):
                    got = run(unbound(cells), [p["piece"] for p in asked])
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(got), pa.string()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["host", "piece", "n"])

        asked = shards.select("host", "shard", "blocks").join(to_shards(pieces, "piece"), ["host", "shard"]).select("host", "blocks", "pieces")
        return in_arrow(asked, count, "host string, piece string, n long").groupBy("host", "piece").agg(F.sum("n").alias("n"))

    need = F.greatest(F.lit(float(OUTSIDE)), F.col("pages") * SHARE_OUTSIDE - 1e-9)
    named = shards.select("host", F.explode("named").alias("x")).groupBy("host", F.col("x.piece").alias("piece")).agg(F.sum("x.own").alias("own"))
    likely = durable(named.join(of_host, "host").where(F.col("own") >= F.col("pages") * SHARE_OUTSIDE / 4 - 1e-9).select("host", "piece"))
    told = durable(per_shard(lambda cells, asked: told_pieces(cells, set(asked)), likely).join(of_host, "host").where(F.col("n") * 2 >= need).select("host", "piece"))
    sums = per_shard(lambda cells, asked: dict(zip(asked, counted_pieces(cells, asked))), told)
    common = durable(sums.join(of_host, "host").where(F.col("n") >= need).select("host", "piece", "n"))

    def texts(batches):
        for b in batches:
            for page_ids, urls, cells, pieces, pages in zip(*(b.column(i).to_pylist() for i in range(5))):
                made = shard_texts(unbound(cells), {p["piece"]: p["n"] for p in pieces or []}, pages)
                for a in range(0, len(made), 256):
                    part = made[a : a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(page_ids[a : a + 256], pa.string()), pa.array(urls[a : a + 256], pa.string()), pa.array(part, pa.string()), pa.array([len(t) for t in part], pa.int64())], [f.name for f in schema])

    known = shards.select("host", "shard", "page_id", "url", "blocks").join(to_shards(common, "piece", "n"), ["host", "shard"], "left").join(of_host, "host")
    return in_arrow(known.select("page_id", "url", "blocks", "pieces", "pages"), texts, schema)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    key = pages.schema["page_id"].dataType
    # Ids travel as text, for pandas would turn integers beside nulls into floats.
    rows = pages.select(F.col("page_id").cast("string"), "url", "html").withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    large = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")).where(F.col("bytes") > SHARD_BYTES)
    large = durable(large.select("host", F.ceil(F.col("bytes") / SHARD_BYTES).cast("long").alias("shards")))
    n_large = large.count()
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def by_host(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = host_texts([zlib.decompress(x) for x in pdf["blocks"]])
        return pd.DataFrame({"page_id": pdf["page_id"].astype(object), "url": pdf["url"].astype(object), "text": np.array(texts, dtype=object), "n_chars": [len(t) for t in texts]})

    names = broadcast_if(large, n_large, 100_000)
    usual = rows if not n_large else rows.join(names, "host", "left_anti").select("page_id", "url", "html", "host")
    out = parsed(usual).groupBy("host").applyInPandas(by_host, schema)
    if n_large:
        out = out.unionByName(large_hosts(rows.join(names, "host"), large, schema))
    return out.withColumn("page_id", F.col("page_id").cast(key))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
