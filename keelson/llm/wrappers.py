"""Main text of web pages by wrapper inference: union-free regular expressions over same-host token streams.

A page is a stream of tags and texts. All of a host's pages count: texts that most of
the pages have are template tokens, all others are slots; tandem repeats in a stream become repeated groups, what is inside an article or main element goes, and the different
streams that are left are aligned, a few at a time, then the wrappers of these, until one is left. What both have stays, and what only one has becomes an optional group. A wrapper so is a
sequence of tokens, slots, optional and repeated groups without unions; with a character a token it compiles to a regular
expression whose groups are possessive, so matching is linear. A page that it doesn't match is followed through all ways of the wrapper together.

The wrapper marks the zone of the main text. An article or main element that every page of the host has is the zone. Elsewhere the
slots decide: the zone is the box that has the most text of its own in all pages, and the boxes around that as
far as they add headings only; template texts inside of the zone are boilerplate and go. Matching a page finds the zone's
tokens. A page that its host's wrapper doesn't match is aligned with it there and then, which generalises the wrapper
for that page. What still doesn't match, and hosts of a single page, are read by the page's own structure: the article or main
element, or else the body, without the host's template texts. Every page is extracted whole.

Text: character references are decoded, white space inside a block is one space, blocks are trimmed and joined by a
newline in page order. Inside the zone menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go, by element and by those names in class, id and role that are made
of hint words only; an article or main element is never taken for one of them.

Wrappers are written, so that Spark can broadcast them where they are small and split a large host's part of the join where they aren't.

Defined cases: null or empty html gives an empty text; a null or odd url has the host ""; unclosed tags, comments and
quotes end with the page; repeated rows are rows of their own; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, materialize, small_batches, table

#: Streams or wrappers that are aligned in one group, pages among which near copies are found, and the share of pages that has a template text.
FIT_PAGES, TOGETHER, TEMPLATE = 8, 32, 0.6
PASSAGE = 8
#: Streams of a greater product of lengths are cut at a longest common subsequence's places before they are compared, into parts of CUT or less.
ALIGNED, CUT = 5_000**2, 1 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "xmp"}
DROPPED = RAW | {"nav", "header", "footer", "aside", "form", "button", "select", "input", "option", "dialog", "head", "menu", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
BOXES = {"div", "section", "ul", "ol", "dl", "table", "article", "p", "figure", "span"}
HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "promo", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "comment", "comments", "cookie", "cookies", "notice", "notices", "consent", "share", "sharing", "social", "related", "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "popup", "modal", "widget", "toolbar", "pagination", "disqus", "replies", "complementary", "contentinfo", "search"}
MAIN = ("article", "main")
#: Elements that may be the zone, headings, and elements whose closing tags are often left out.
ZONES = {"article", "main", "section", "div", "td", "center", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LOOSE = {"p", "li", "td", "th", "tr", "dt", "dd", "option", "b", "i", "a"}
#: A slot; a template text is this sign and the text.
TEXT, CONSTANT = "#", "="

Token = tuple[str, str]


def tokens(page: str) -> list[Token]:
    """(key, text): key is # for text, else the tag with its telling words; comments, declarations and raw elements' contents go."""
    out: list[Token] = []
    at, n, lower = 0, len(page), None
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not (chunk := page[at:end]).isspace():
            out.append((TEXT, chunk))
        elif end > at and out and out[-1][0] == TEXT:
            out[-1] = (TEXT, out[-1][1] + " ")
        elif end > at:
            out.append((TEXT, " "))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name:
            name, closing = name.lower(), bool(m[1] or m[4])
            rest = m[3] or m[6] or ""
            words = ""
            if not closing and name in BOXES and name not in MAIN and "=" in rest:
                named = [_WORD.findall(w.lower()) for a in _ATTRIBUTE.findall(rest) for w in "".join(a).split()]
                found = {w for x in named if HINTS.issuperset(x) for w in x}
                words = "." + sorted(found & HINTS)[0] if found & HINTS else ""
            out.append((("/" if closing else "") + name + words, ""))
            if not closing and name in RAW and not rest.endswith("/"):
                lower = page.lower() if lower is None else lower
                stop = lower.find(f"</{name}", at)
                at = n if stop < 0 else stop
    return out


def plain(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def shape(stream: list[Token], constants: frozenset[str] = frozenset()) -> tuple[list[str], list[int]]:
    """Keys without blank texts, and their places in the stream; template texts have keys of their own."""
    places = [i for i, (k, text) in enumerate(stream) if k != TEXT or not text.isspace()]
    return [CONSTANT + t if k == TEXT and constants and (t := plain(text)) in constants else k for k, text in map(stream.__getitem__, places)], places


def code(text: str) -> int:
    """64 bits of a text, the last one for passages."""
    bits = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return bits | 1 if text.count(" ") + 1 >= PASSAGE else bits & ~1


class Codes(frozenset):
    """Texts by their codes."""

    def __contains__(self, text: object) -> bool:
        return frozenset.__contains__(self, code(text))


def outline(keys: list[str], places: list[int]) -> tuple[list[str], list[int]]:
    """Without what is inside an article or main element, which is taken as a whole."""
    for name in MAIN:
        if name in keys and f"/{name}" in keys:
            first, last = keys.index(name), len(keys) - 1 - keys[::-1].index(f"/{name}")
            if first < last:
                return keys[: first + 1] + keys[last:], places[: first + 1] + places[last:]
    return keys, places


def template_texts(streams: list[list[Token]]) -> frozenset[str]:
    """Texts of at least the share TEMPLATE of several pages, where near copies of one page are one page. Passages of PASSAGE words and more, which articles
    may share, must be on every page of three or more."""
    texts = [{t for k, text in s if k == TEXT and (t := plain(text))} for s in streams]
    groups = _near_copies(texts)
    if len(groups) < 2:
        return frozenset()
    held = Counter(t for group in groups for t in set.union(*(texts[i] for i in group)))
    short, long = max(2, TEMPLATE * len(groups)), max(3, len(groups))
    return frozenset(t for t, n in held.items() if n >= (short if t.count(" ") + 1 < PASSAGE else long))


def _near_copies(texts: list[set[str]]) -> list[list[int]]:
    """Pages in groups: two pages are near copies if half of what one of them has beyond the texts of all pages is the other's too."""
    everywhere = set.intersection(*texts) if texts else set()
    own = [t - everywhere if len(texts) > 2 else t for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            least = min(len(own[i]), len(own[j]))
            if least and 2 * len(own[i] & own[j]) >= least:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [[i for i, g in enumerate(group) if g == k] for k in sorted(set(group))]


def name_of(key: str) -> str:
    return key.lstrip("/").partition(".")[0]


def _lengths(items: list) -> set[int]:
    """Lengths that repeated groups may have: short ones, and the distances of equal items of equal depth."""
    last: dict[tuple, int] = {}
    found, depth = set(range(1, 9)), 0
    for i, x in enumerate(items):
        tag = isinstance(x, str) and x[0] not in TEXT + CONSTANT and name_of(x) not in VOID | LOOSE
        depth -= tag and x[0] == "/"
        if (x, depth) in last:
            found.add(i - last[x, depth])
        last[x, depth] = i
        depth += tag and x[0] != "/"
    return found


def balanced(items: list | tuple) -> bool:
    """Whether tags that are always closed are closed in order of depth."""
    depth = 0
    for x in items:
        if isinstance(x, str) and x[0] not in TEXT + CONSTANT and name_of(x) not in VOID | LOOSE:
            depth += -1 if x[0] == "/" else 1
            if depth < 0:
                return False
    return depth == 0


def _repeats_at(codes: np.ndarray, unit: int) -> bool:
    """Whether some `unit` items (by their codes) are followed by the same."""
    same = codes[unit:] == codes[:-unit]
    if np.count_nonzero(same) < unit:
        return False
    upto = np.cumsum(np.r_[0, same])
    return bool((upto[unit:] - upto[:-unit] == unit).any())


def fold(items: list) -> list:
    """Turns tandem repeats of balanced units into repeated groups, short units first."""
    code: dict = {}
    codes = np.array([code.setdefault(x, len(code)) for x in items])
    todo = sorted(_lengths(items))
    while todo:
        unit = heappop(todo)
        if 2 * unit <= len(items) and _repeats_at(codes, unit):
            out, i, n = [], 0, len(items)
            while i < n:
                part = items[i : i + unit]
                j = i + unit
                while items[j : j + unit] == part and len(part) == unit:
                    j += unit
                if j > i + unit and balanced(part):
                    out.append(part[0] if unit == 1 and isinstance(part[0], tuple) and part[0][0] == "+" else ("+", tuple(part)))
                    i = j
                else:
                    out.append(items[i])
                    i += 1
            items = out
            codes = np.array([code.setdefault(x, len(code)) for x in items])
            todo = sorted({*todo, *(x for x in _lengths(items) if x > unit)})
    return items


def flat(wrapper: list) -> list[tuple]:
    """(item, number of its optional group or None) of a wrapper, whose optional groups aren't nested."""
    out: list[tuple] = []
    for n, x in enumerate(wrapper):
        out += [(y, n) for y in x[1]] if not isinstance(x, str) and x[0] == "?" else [(x, None)]
    return out


def grouped(entries: list[tuple]) -> list:
    """The wrapper of flat entries: neighbours of one number are one optional group."""
    out: list = []
    for number, part in groupby(entries, key=lambda e: e[1]):
        items = [x for x, _ in part]
        out += items if number is None else [("?", tuple(items))]
    return out


def absorb(entries: list[tuple], units: list[tuple]) -> list[tuple]:
    """Single occurrences of units as repeated groups."""
    for unit in units:
        out, i = [], 0
        while i < len(entries):
            part = entries[i : i + len(unit)]
            hit = tuple(x for x, _ in part) == unit and len({n for _, n in part}) == 1
            out.append((("+", unit), part[0][1]) if hit else entries[i])
            i += len(unit) if hit else 1
        entries = out
    return entries


class _Common:
    """The lengths of longest common subsequences of items with every start of a list, which is held as bits: an item takes some operations on integers of as many bits as the list is long."""

    def __init__(self, items: np.ndarray) -> None:
        self.n = len(items)
        self.order = np.argsort(items, kind="stable")
        self.sorted = items[self.order]
        self.often: dict[int, int] = {}

    def _places(self, x: int) -> int:
        """A bit for each place of x; kept for frequent ones, of which there are few."""
        if x in self.often:
            return self.often[x]
        at = self.order[np.searchsorted(self.sorted, x) : np.searchsorted(self.sorted, x, side="right")]
        bits = np.zeros(self.n, dtype=bool)
        bits[at] = True
        mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(at) * 256 > self.n:
            self.often[x] = mask
        return mask

    def lengths(self, items: np.ndarray) -> np.ndarray:
        every = (1 << self.n) - 1
        open_ = every
        for x in items.tolist():
            here = open_ & self._places(x)
            if here:
                open_ = ((open_ + here) | (open_ ^ here)) & every
        bits = np.unpackbits(np.frombuffer(open_.to_bytes(-(-self.n // 8), "little"), np.uint8), count=self.n, bitorder="little")
        return np.r_[0, np.cumsum(bits == 0)]


def _halved(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts (of left from, to, of right from, to) in order, whose longest common subsequences in a row are one of the whole; lengths have a product of `most` or less."""
    todo = [(0, len(left), 0, len(right))]
    while todo:
        i, j, k, m = todo.pop()
        if (j - i) * (m - k) <= most or j - i < 2:
            yield i, j, k, m
            continue
        mid = (i + j) // 2
        upto = _Common(right[k:m]).lengths(left[i:mid])
        after = _Common(right[k:m][::-1]).lengths(left[mid:j][::-1])[::-1]
        cut = k + int((upto + after).argmax())
        todo += [(mid, j, cut, m), (i, mid, k, cut)]


def opcodes(left: list, right: list, whole: int = ALIGNED, most: int = CUT) -> list[list]:
    """difflib's opcodes. Its time grows with the square of the lengths or more, so long lists are cut first, in a time of the square divided by a word's bits, and in little memory."""
    if len(left) * len(right) <= whole:
        return [list(c) for c in SequenceMatcher(None, left, right, autojunk=False).get_opcodes()]
    number: dict = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in items]) for items in (left, right))
    least = min(len(a), len(b))
    first = int(np.r_[np.flatnonzero(a[:least] != b[:least]), least][0])
    last = int(np.r_[np.flatnonzero(a[first:][::-1][: least - first] != b[first:][::-1][: least - first]), least - first][0])
    equal = [(first, first, first)] if first else []
    for i, j, k, m in _halved(a[first : len(a) - last], b[first : len(b) - last], most):
        i, j, k, m = (x + first for x in (i, j, k, m))
        equal += [(x + i + n, y + k + n, n) for x, y, n in SequenceMatcher(None, a[i:j].tolist(), b[k:m].tolist(), autojunk=False).get_matching_blocks() if n]
    equal += [(len(a), len(b), last)]
    out: list[list] = []
    at, to = 0, 0
    for i, k, n in equal:
        if (i - n, k - n) != (at, to):
            kind = "insert" if i - n == at else "delete" if k - n == to else "replace"
            out.append([kind, at, i - n, to, k - n])
        if n and out and out[-1][0] == "equal":
            out[-1][2], out[-1][4] = i, k
        elif n:
            out.append(["equal", i - n, i, k - n, k])
        at, to = i, k
    return out


def _slid(left: list, right: list) -> list[list]:
    """Opcodes from left to right, where a run that only one side has begins and ends with an element's tags if it can be moved so between equal items."""
    codes = opcodes(left, right)
    for c, (kind, i, j, k, m) in enumerate(codes):
        if kind not in ("insert", "delete"):
            continue
        side, a, b = (left, i, j) if kind == "delete" else (right, k, m)
        before, after = (codes[n] if 0 <= n < len(codes) and codes[n][0] == "equal" else None for n in (c - 1, c + 1))
        forward = min(b - a, 64, after[2] - after[1] - 1 if after and before else 0)
        backward = min(b - a, 64, before[2] - before[1] - 1 if after and before else 0)
        ends = lambda t: balanced(side[a + t : b + t])  # noqa: B023, E731
        moves = [0]
        for t in range(forward):
            if side[a + t] != side[b + t]:
                break
            moves.append(t + 1)
        for t in range(backward):
            if side[a - t - 1] != side[b - t - 1]:
                break
            moves.append(-t - 1)
        by = next((t for t in moves if ends(t)), 0)
        if by:
            codes[c] = [kind, i + by, j + by, k + by, m + by]
            before[2], before[4], after[1], after[3] = before[2] + by, before[4] + by, after[1] + by, after[3] + by
    return codes


def align(wrapper: list, page: list) -> list:
    """The wrapper generalised to match the page's folded stream (or another wrapper) too: a unit that one side repeats is a repeated group
    on both, and what only one side has in a row becomes an optional group, as does what is optional on either."""
    left, right = flat(wrapper), flat(page)
    units = sorted({x[1] for x, _ in [*left, *right] if not isinstance(x, str)}, key=lambda u: (-len(u), str(u)))
    left, right = absorb(left, units), absorb(right, units)
    out: list[tuple] = []
    for at, (kind, i, j, k, m) in enumerate(_slid([x for x, _ in left], [x for x, _ in right])):
        if kind == "equal":
            out += [(x, None if number is None and other is None else (number, other)) for (x, number), (_, other) in zip(left[i:j], right[k:m], strict=True)]
        else:
            out += [(x, ("left", at, number)) for x, number in left[i:j]] + [(x, ("right", at, number)) for x, number in right[k:m]]
    return grouped(out)


def fit(pages: list[list[str]]) -> list:
    wrapper: list = []
    for n, keys in enumerate(pages):
        folded = fold(list(keys))
        wrapper = folded if not n else align(wrapper, folded)
    return wrapper


class Matcher:
    """A wrapper as a regular expression of one character a token. The zone is a span of the wrapper's flat entries."""

    def __init__(self, wrapper: list, zone: tuple[int, int] | None = None) -> None:
        self.wrapper, self.code, self.slots, self.steps = wrapper, {}, None, None
        self.entries = flat(wrapper)
        self.zoned = zone or self.main(self.entries)
        self.regex = self.compile({self.zoned[0]}, {self.zoned[1]}) if self.zoned else None

    def _token(self, x: str | tuple) -> str:
        return self.code.setdefault(x, chr(0x4E00 + len(self.code))) if isinstance(x, str) else f"(?:{''.join(map(self._token, x[1]))})++"

    def compile(self, begins: set[int], ends: set[int]) -> re.Pattern:
        """An empty group marks each entry in begins, and each place before an entry in ends. A group matches or is passed over as a whole."""
        out, n = [], len(self.entries)
        for i, (x, number) in enumerate(self.entries):
            if number is not None and (not i or self.entries[i - 1][1] != number):
                out.append("(?:")
            out.append(("()" if i in begins else "") + self._token(x) + ("()" if i + 1 in ends else ""))
            if number is not None and (i + 1 == n or self.entries[i + 1][1] != number):
                out.append(")?+")
        return re.compile("".join(out))

    def line(self, keys: list[str]) -> str:
        """A page's keys as characters; a template text that the wrapper doesn't have is a slot's."""
        other = self.code.get(TEXT, "\0")
        return "".join([self.code.get(k) or (other if k[0] == CONSTANT else "\0") for k in keys])

    @staticmethod
    def main(entries: list[tuple]) -> tuple[int, int] | None:
        """From the first opening token of the main element, which every page must have, to the last closing one."""
        items = [x for x, _ in entries]
        for name in MAIN:
            if (name, None) in entries and f"/{name}" in items:
                first, last = entries.index((name, None)), len(items) - items[::-1].index(f"/{name}")
                if first < last:
                    return first, last
        return None

    def zone(self, keys: list[str]) -> tuple[int, int] | None:
        """The zone among a page's keys; None where the wrapper doesn't match or has no zone."""
        if not self.zoned:
            return None
        if m := self.regex.fullmatch(self.line(keys)):
            return (m.start(1), m.start(2)) if min(m.start(1), m.start(2)) >= 0 else None
        places = self.places(keys)
        if places is None or not {self.zoned[0], self.zoned[1] - 1} <= set(places):
            return None
        return places.index(self.zoned[0]), len(places) - places[::-1].index(self.zoned[1] - 1)

    def _step(self, x: str | tuple, entry: int) -> None:
        """A token to match and its entry, or a choice of two steps (None, first, second)."""
        if isinstance(x, str):
            self.steps.append((self.code[x], entry, 0))
        else:
            start = len(self.steps)
            for y in x[1]:
                self._step(y, entry)
            self.steps.append((None, start, len(self.steps) + 1))

    def places(self, keys: list[str]) -> list[int] | None:
        """The entry of each of a page's keys, where groups may give back what they took; None without a match. All ways through the wrapper go on together, so none is
        tried twice at a key, and of two that meet the one that repeats and takes more stays."""
        if self.steps is None:
            if not self.code:
                self.compile(set(), set())
            self.steps, opened = [], None
            for i, (x, number) in enumerate(self.entries):
                if number is not None and (not i or self.entries[i - 1][1] != number):
                    opened = len(self.steps)
                    self.steps.append(None)
                self._step(x, i)
                if number is not None and (i + 1 == len(self.entries) or self.entries[i + 1][1] != number):
                    self.steps[opened] = (None, opened + 1, len(self.steps))
            self.steps.append(("", -1, 0))
        steps = self.steps

        def reach(at: int, way: tuple | None, ways: dict[int, tuple | None], seen: set[int]) -> None:
            todo = [at]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                token, first, second = steps[at]
                if token is None:
                    todo += [second, first]
                else:
                    ways[at] = way

        ways: dict[int, tuple | None] = {}
        reach(0, None, ways, set())
        for c in self.line(keys):
            after: dict[int, tuple | None] = {}
            seen: set[int] = set()
            for at, way in ways.items():
                if steps[at][0] == c:
                    reach(at + 1, (way, steps[at][1]), after, seen)
            ways = after
            if not ways:
                return None
        if len(steps) - 1 not in ways:
            return None
        out, way = [], ways[len(steps) - 1]
        while way:
            way, entry = way
            out.append(entry)
        return out[::-1]


def box_of(items: list, at: int, end: int) -> tuple[int, int] | None:
    """The innermost zone element around the items from `at` to `end`."""
    depth, first = 0, None
    for i in range(at - 1, -1, -1):
        if isinstance(items[i], str) and name_of(items[i]) in ZONES:
            if items[i][0] == "/":
                depth += 1
            elif depth:
                depth -= 1
            else:
                first = i
                break
    if first is None:
        return None
    name = name_of(items[first])
    for i in range(end, len(items)):
        if isinstance(items[i], str) and name_of(items[i]) == name:
            depth += 1 if items[i][0] != "/" else -1
            if depth < 0:
                return first, i + 1
    return None


def _headings_only(items: list) -> bool:
    """Whether all texts of some items are in headings."""
    inside = False
    for x in items:
        if not isinstance(x, str):
            if any(k[0] in TEXT + CONSTANT for k in _keys(x[1])):
                return False
        elif name_of(x) in HEADINGS:
            inside = x[0] != "/"
        elif x[0] in TEXT + CONSTANT and not inside:
            return False
    return True


def _keys(items: list | tuple) -> list[str]:
    return [k for x in items for k in ([x] if isinstance(x, str) else _keys(x[1]))]


def masses(matcher: Matcher, pages: list[tuple[list[str], list[int]]]) -> np.ndarray:
    """The length of texts in slots by entry of the wrapper, of pages given as keys and lengths of their texts."""
    n = len(matcher.entries)
    if matcher.slots is None:
        matcher.slots = matcher.compile(set(range(n)), set(range(1, n + 1)))
    mass = np.zeros(n)
    for keys, sizes in pages:
        size = [n if k == TEXT else 0 for k, n in zip(keys, sizes, strict=True)]
        if m := matcher.slots.fullmatch(matcher.line(keys)):
            upto = np.cumsum([0, *size])
            at = np.array([m.start(i + 1) for i in range(2 * n)]).reshape(n, 2)
            mass += np.where(at[:, 0] >= 0, upto[at[:, 1]] - upto[at[:, 0]], 0)
        elif (places := matcher.places(keys)) is not None:
            mass += np.bincount(places, size, minlength=n)
    return mass


def box_around(entries: list[tuple], best: int) -> tuple[int, int] | None:
    """The box around an entry, and the boxes around that as far as they add headings only."""
    items = [x for x, _ in entries]
    box = box_of(items, best, best + 1)
    while box and name_of(items[box[0]]) != "body" and (around := box_of(items, *box)) and _headings_only([*items[around[0] + 1 : box[0]], *items[box[1] : around[1] - 1]]):
        box = around
    return box


def heaviest(entries: list[tuple], mass: np.ndarray) -> int:
    """The entry with the most text of those in the box that has the most text of its own, outside of boxes in it."""
    boxes, open_ = [], []
    for i, (x, _) in enumerate(entries):
        boxes.append(open_[-1] if open_ else -1)
        if isinstance(x, str) and name_of(x) in ZONES:
            if x[0] != "/":
                open_.append(i)
            elif open_:
                open_.pop()
    boxes = np.array(boxes) + 1
    own = np.bincount(boxes, mass)
    return int(np.where(boxes == own.argmax(), mass, -1).argmax())


def zone_by_slots(wrapper: list, pages: list[tuple[list[str], list[int]]]) -> tuple[int, int] | None:
    """The box whose groups and slots have the most text in the pages (keys and lengths of their texts)."""
    matcher = Matcher(wrapper)
    mass = masses(matcher, pages)
    return box_around(matcher.entries, heaviest(matcher.entries, mass)) if mass.any() else None


def by_structure(keys: list[str]) -> tuple[int, int]:
    for name in MAIN:
        if name in keys:
            first = keys.index(name)
            last = len(keys) - keys[::-1].index(f"/{name}") if f"/{name}" in keys else len(keys)
            return first, max(first, last)
    return 0, len(keys)


def text_of(stream: list[Token], constants: frozenset[str] = frozenset()) -> str:
    """The text of a zone's tokens, without what belongs to the page around it and without template texts."""
    blocks: list[str] = []
    now: list[str] = []
    skipped, depth = "", 0
    for key, text in stream:
        if key == TEXT:
            if not depth and (not constants or plain(text) not in constants):
                now.append(text)
            continue
        closing = key[0] == "/"
        name = name_of(key)
        if depth:
            if name == skipped and name not in VOID:
                depth += -1 if closing else 1
            if depth:
                continue
        elif not closing and (name in DROPPED or "." in key) and name not in VOID:
            skipped, depth = name, 1
        if name == "br":
            now.append(" ")
        elif name not in INLINE or depth:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(html_lib.unescape(b).split()) for b in blocks) if x)


@lru_cache(maxsize=512)
def _fitted(wrapper: str) -> tuple[Matcher | None, frozenset[str]]:
    found = json.loads(wrapper)
    items = _tuples(found["items"])
    return Matcher(items, tuple(found["zone"]) if found["zone"] else None) if items else None, Codes(found["codes"]) if "codes" in found else frozenset(found["constants"])


@lru_cache(maxsize=512)
def _matcher(items: str) -> Matcher:
    return Matcher(_tuples(json.loads(items)))


def _tuples(items: list) -> list:
    return [x if isinstance(x, str) else (x[0], tuple(_tuples(x[1]))) for x in items]


def _zone_after(old: Matcher, wider: list) -> tuple[int, int] | None:
    """Where the zone's first and last tokens are in a wrapper that was generalised, counted from its ends."""
    before, items = [x for x, _ in old.entries], [x for x, _ in flat(wider)]
    first, last = before[old.zoned[0]], before[old.zoned[1] - 1]
    opens, closes = ([i for i, x in enumerate(items) if x == y] for y in (first, last))
    k, m = before[: old.zoned[0]].count(first), before[old.zoned[1] :].count(last)
    if k < len(opens) and m < len(closes) and opens[k] < closes[-1 - m]:
        return opens[k], closes[-1 - m] + 1
    return None


def extract(page: str, wrapper: str | None) -> tuple[str, str]:
    """The main text, and how it was found: by the wrapper, the generalised wrapper, or the page's structure alone."""
    stream = tokens(page)
    matcher, constants = _fitted(wrapper) if wrapper else (None, frozenset())
    keys, kept = outline(*shape(stream, constants))
    zone, how = None, "structure"
    if matcher and matcher.zoned:
        zone, how = matcher.zone(keys), "wrapper"
        if zone is None:
            wider = align(matcher.wrapper, fold(list(keys)))
            zone, how = Matcher(wider, _zone_after(matcher, wider)).zone(keys), "generalised"
    if zone is None:
        zone, how = by_structure(keys), "structure"
    if zone[0] >= zone[1]:
        return "", how
    part = stream[kept[zone[0]] : kept[zone[1] - 1] + 1]
    # template texts go only where no article or main element tells the text from what is around it
    return text_of(part, frozenset() if name_of(keys[zone[0]]) in MAIN else constants), how


def fitted(pages: list[str]) -> str:
    """The wrapper of a host's pages, as JSON: items, zone and template texts."""
    streams = [s for s in map(tokens, dict.fromkeys(pages)) if s]
    constants = template_texts(streams)
    shaped = []
    for stream in streams:
        keys, places = outline(*shape(stream, constants))
        if keys:
            shaped.append((keys, [len(stream[i][1]) for i in places]))
    items = fit([keys for keys, _ in shaped])
    zone = None if not items or Matcher.main(flat(items)) or len(shaped) < 2 else zone_by_slots(items, shaped)
    return json.dumps({"items": items, "zone": zone, "constants": sorted(constants)})


def _over(rows: DataFrame, function: Callable[[str, dict], tuple | None], schema: str, *columns: str) -> DataFrame:
    """Rows of schema from each page's host and what function makes of its html and other columns; none for None."""
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["host"], *out) for r in batch.to_pylist() if (out := function(r["html"], r)) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return rows.select("host", "html", *columns).mapInArrow(run, schema)


def common_texts(rows: DataFrame) -> DataFrame:
    """host, codes of the texts that template_texts would name, counted over all different pages of the host. Near copies are found among TOGETHER pages or so."""

    def texts(page: str, row: dict) -> tuple | None:
        stream = tokens(page)
        return (row["h"], sorted({code(t) for k, text in stream if k == TEXT and (t := plain(text))})) if stream else None

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sets = [set(map(int, x)) for x in part.sort_values("h").drop_duplicates("h")["codes"]]
        groups = _near_copies(sets)
        held = Counter(t for group in groups for t in set.union(*(sets[i] for i in group)))
        return pd.DataFrame({"host": key[0], "whole": [True, *[False] * len(held)], "code": [0, *held], "n": [len(groups), *held.values()]})

    sizes = rows.select("host", "h").distinct().groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    coded = _over(rows, texts, "host string, h long, codes array<long>", "h").join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    counted = coded.groupBy("host", "part").applyInPandas(count, "host string, whole boolean, code long, n long").groupBy("host", "whole", "code").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "texts")
    groups = counted.where("whole").select("host", F.col("n").alias("groups"))
    least = F.when(F.col("code") % 2 == 0, F.greatest(F.lit(2.0), TEMPLATE * F.col("groups"))).otherwise(F.greatest(F.lit(3), F.col("groups")))
    return counted.where("not whole").join(groups, "host").where((F.col("groups") > 1) & (F.col("n") >= least)).groupBy("host").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def infer(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """host, wrapper (JSON), from all pages of each host. Different folded streams are aligned in groups of fit_pages or so, then the wrappers of the groups, and so on. Written."""
    rows = pages.select("host", "html", F.xxhash64("html").alias("h"))
    constants = materialize(common_texts(rows), "codes")
    rows = rows.join(constants, "host", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<long>")))

    def folded(page: str, row: dict) -> tuple | None:
        keys, _ = outline(*shape(tokens(page), Codes(row["codes"])))
        items = fold(list(keys))
        return (json.dumps(items),) if items else None

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wrapper: list = []
        for x in (_tuples(json.loads(x)) for x in sorted(part["items"])):
            wrapper = align(wrapper, x) if wrapper else x
        return pd.DataFrame({"host": [key[0]], "items": [json.dumps(wrapper)]})

    level = materialize(_over(rows, folded, "host string, items string", "codes").distinct(), "streams")
    while (level.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = level.groupBy("host").agg(F.ceil(F.count("*") / fit_pages).alias("parts"))
        dealt = level.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("items"), F.col("parts")))
        level = materialize(dealt.groupBy("host", "part").applyInPandas(merged, "host string, items string"), "streams")

    def slotted(page: str, row: dict) -> tuple | None:
        matcher = _matcher(row["items"])
        stream = tokens(page)
        keys, places = outline(*shape(stream, Codes(row["codes"])))
        mass = masses(matcher, [(keys, [len(stream[i][1]) for i in places])])
        return ([int(x) for x in mass.nonzero()[0]], [int(x) for x in mass[mass.nonzero()]]) if mass.any() else None

    # hosts of several pages without an element that all of them have
    has_main = F.udf(lambda items: Matcher.main(flat(_tuples(json.loads(items)))) is not None, "boolean")
    several = rows.groupBy("host").agg(F.countDistinct("h").alias("n")).where("n > 1").select("host")
    open_ = materialize(level.join(several, "host").where(~has_main("items")), "open")
    mass = _over(rows.join(open_, "host"), slotted, "host string, places array<int>, sizes array<long>", "codes", "items")
    mass = mass.select("host", F.explode(F.arrays_zip("places", "sizes")).alias("x")).groupBy("host", F.col("x.places").alias("place")).agg(F.sum("x.sizes").alias("size"))
    slots = mass.groupBy("host").agg(F.collect_list(F.struct("place", "size")).alias("slots"))

    def whole(items: str | None, codes: list | None, slots: list | None) -> str:
        found = _tuples(json.loads(items)) if items else []
        entries = flat(found)
        mass = np.zeros(len(entries))
        for place, size in slots or []:
            mass[place] = size
        return json.dumps({"items": found, "zone": box_around(entries, heaviest(entries, mass)) if slots else None, "codes": list(codes or [])})

    hosts = rows.select("host").distinct().join(level, "host", "left").join(constants, "host", "left").join(slots, "host", "left")
    return materialize(hosts.select("host", F.udf(whole, "string")("items", "codes", "slots").alias("wrapper")), "wrappers")


TEXTS = "page_id long, url string, text string, n_chars long, found_by string"


def extract_pages(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """Per page its main text. Wrappers are broadcast where Spark finds them small; else pages are shuffled by host, and AQE splits large hosts."""
    small_batches(pages.sparkSession)
    schema = arrow_schema(pages.sparkSession, TEXTS)
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host)
    wrappers = infer(rows, fit_pages).withColumnRenamed("host", "h")
    met = rows.join(wrappers, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            found = [extract(h, w) for h, w in zip(x["html"], x["wrapper"], strict=True)]
            if found:
                texts = [t for t, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((x["page_id"], x["url"], texts, [len(t) for t in texts], [h for _, h in found]), schema, strict=True)], schema=schema)

    return met.mapInArrow(run, TEXTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
