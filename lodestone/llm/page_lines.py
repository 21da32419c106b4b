"""Lines of a page, where they stand, and the lines that two pages share.

A small reader of HTML: it follows the HTML standard where that decides which text stands where (raw text elements,
comments, tags that close others, references), and runs once over the page, whatever is left open. A tag, comment or
script that the page's end cuts off holds the rest of the page, as the standard has it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import xxhash

#: Where a line stands: in furniture that markup names, loose in the page, in its main part, in an article.
FURNITURE, LOOSE, MAIN, ARTICLE = range(4)

FURNITURE_TAGS = set("nav footer aside form script style noscript template svg iframe object canvas audio video select button textarea datalist dialog menu title".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar".split())
#: The last word of a class or an id that names furniture (`post-comments`), or its first (`ad-slot`) unless HOLDS follows.
FURNITURE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead header comment comments commentlist disqus respond reply replies toolbar skip".split()
)
HOLDS = set("content body main article wrapper container layout page site title heading".split())
DENIED = set("has no not with without is js show hide".split())
#: Never furniture by class or id, as they hold whole pages.
WHOLE_TAGS = {"html", "body", "main"}

BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
#: Start tags that close an open paragraph; what closes its own kind, and where the search for it stops.
ENDS_P = BLOCK_TAGS - {"body", "caption", "head", "html", "dd", "dt", "li", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
SIBLINGS = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
STOPS = {"p": ("td", "th", "caption", "button", "object", "table", "template"), "li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named_furniture(name: str) -> bool:
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in DENIED:
        return False
    return words[-1] in FURNITURE_WORDS or (words[0] in FURNITURE_WORDS and words[-1] not in HOLDS)


@lru_cache(4096)
def standing(tag: str, attributes: str) -> int:
    """What a start tag says about its own content: FURNITURE, MAIN, ARTICLE, or LOOSE if it says nothing."""
    if tag in FURNITURE_TAGS:
        return FURNITURE
    a = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        a.setdefault(name.lower(), next((v for v in values if v), ""))
    role = unescape(a.get("role", "")).strip().lower()
    if "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) or role in FURNITURE_ROLES:
        return FURNITURE
    if tag not in WHOLE_TAGS and any(named_furniture(x) for x in (*unescape(a.get("class", "")).split(), a.get("id", ""))):
        return FURNITURE
    if tag == "article" or role == "article" or "articlebody" in a.get("itemprop", "").lower().split():
        return ARTICLE
    return MAIN if tag == "main" or role == "main" else LOOSE


class Reader:
    def __init__(self):
        self.lines: list[tuple[str, int]] = []
        self.stack: list[tuple[str, int]] = [("", LOOSE)]
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.aside: list[str] = []

    def flush(self) -> None:
        for held, where in ((self.aside, FURNITURE), (self.text, self.stack[-1][1])):
            if held:
                line = " ".join(unescape("".join(held)).split())
                held.clear()
                if line:
                    self.lines.append((line, where))

    def cut(self, depth: int) -> None:
        """Closes all elements from this depth on."""
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_open(self, kind: str) -> None:
        at = self.last(SIBLINGS[kind])
        if at > self.last(STOPS[kind]):
            self.cut(at)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in ENDS_P:
                self.close_open("p")
            if tag in SIBLINGS and tag != "p":
                self.close_open(tag)
        elif tag == "br":
            (self.aside if self.stack[-1][1] == FURNITURE else self.text).append(" ")
        if tag in VOID_TAGS:
            return
        outer, own = self.stack[-1][1], (standing if len(attributes) < 2000 else standing.__wrapped__)(tag, attributes)
        if tag == "header" and own == LOOSE and outer < MAIN:  # of a page; an article's own header belongs to it
            own = FURNITURE
        if tag in ("h1", "h2", "h3", "header") and own == FURNITURE and outer == ARTICLE and "hidden" not in attributes:
            own = LOOSE  # named by the word for headers
        if own > LOOSE and outer != FURNITURE:
            self.flush()
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, FURNITURE if FURNITURE in (outer, own) else max(outer, own)))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
        if self.places.get(tag):
            at = self.places[tag][-1]
            if self.stack[at][1] != self.stack[at - 1][1] and self.stack[at][1] != FURNITURE:
                self.flush()
            self.cut(at)

    def read(self, html: str) -> list[tuple[str, int]]:
        at, size = 0, len(html)
        while at < size:
            tag = html.find("<", at)
            if tag != at:
                piece = html[at : tag if tag >= 0 else size]
                (self.aside if self.stack[-1][1] == FURNITURE else self.text).append(piece)
            if tag < 0:
                break
            nxt = html[tag + 1 : tag + 2]
            if nxt.isascii() and nxt.isalpha() or nxt == "/" and html[tag + 2 : tag + 3].isascii() and html[tag + 2 : tag + 3].isalpha():
                m = TAG.match(html, tag)
                if not m:
                    break
                at, name = m.end(), m[2].lower()
                if m[1]:
                    self.end(name)
                    continue
                self.start(name, m[3])
                if name in RAW_TAGS:
                    end = RAW_TAGS[name].search(html, at)
                    if not end:
                        break
                    at = end.start()
            elif nxt in ("!", "?", "/"):
                comment = html.startswith("<!--", tag)
                end = html.find("-->" if comment else ">", tag + 2)
                if end < 0:
                    break
                at = end + (3 if comment else 1)
            else:
                (self.aside if self.stack[-1][1] == FURNITURE else self.text).append("<")
                at = tag + 1
        self.flush()
        return self.lines


def lines_of(html: str) -> list[tuple[str, int]]:
    """(line, where it stands): the page's blocks in order, references decoded, white space one space each."""
    return Reader().read(html)


def line_key(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Bits of the table of one comparison; beyond, it is split in two.
TABLE_BITS = 1 << 27


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """The bit rows of the longest common subsequence's table: bit j of row i is 0 where b[:j + 1] has one more in common
    with a[:i + 1] than b[:j]. Only the last row, unless they are kept."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        met = row & masks.get(x, 0)
        row = (row + met | row - met) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list, b: list) -> np.ndarray:
    """Of the longest common subsequences of a with b[:0], b[:1], ..."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b, as pairs of places. Memory is bounded by TABLE_BITS and the lists."""
    out, start, n, m = [], 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        out.append((start, start))
        start += 1
    tail = 0
    while tail < min(n, m) - start and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    both = set(a[start : n - tail]) & set(b[start : m - tail])
    ia, ib = ([i for i in range(start, end - tail) if x[i] in both] for x, end in ((a, n), (b, m)))
    out += [(ia[i], ib[j]) for i, j in _middle([a[i] for i in ia], [b[j] for j in ib])]
    return out + [(n - t, m - t) for t in range(tail, 0, -1)]


def _middle(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _middle(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _middle(a[half:], b[cut:])]
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> j - 1 & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]
