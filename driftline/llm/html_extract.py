"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of the page (paragraph, heading, list
item, table row, ...). The distribution is the summed length of BLOCK lines from
each line on. Markup is evidence that changes lengths: lines of elements that
cannot hold article text (navigation, footers, asides, hidden parts, classes and
ids that as a whole name such a role) have length zero, as have BLOCK empty lines
put where such an element stands, and lines that are mostly links have length
zero where nothing marks the article.

Text begins at a surge, a line from which the block reaches the threshold
(MIN_SURGE or, on short pages, a fifth of the fullest block), and ends at a dive,
where the block falls to zero; what lies between is kept whole, link lines too.
A line after a dive that stands in the very element that holds kept lines goes on
without a new surge, so an advert inside the text costs nothing that follows it.

The lengths also decide between the parts of a page: an ``article`` or ``main``
element is believed, and then kept whole, unless the surges outside such elements
hold MARKED times its text (teasers marked as articles beside the real one); of
several, those with less than a SHARE of the fullest go. An element whose name
speaks against it but that holds the marked part and the greater part of the text
is a wrapper and counts as any other, as does a form around nearly all text.

References are decoded, white space inside a block (a line break element too)
becomes one space, empty blocks go, blocks are joined by two line feeds. Of a
header element inside the article its headings and paragraphs stay.

Null and empty pages have the empty text; unclosed elements end where an outer
one does, or with the page; each row is a page of its own. Every step of the
parser is bounded by what it consumes, so deep nesting and stray quotes take
linear time.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 3
MIN_SURGE = 80
MARKED = 2
SHARE = 0.2
#: Element names of HTML.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = frozenset("audio button canvas datalist head iframe map noembed noframes noscript object script select style svg template textarea title video xmp".split())
_HARD = frozenset("aside dialog footer menu nav search".split())
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = frozenset("article aside blockquote body center details dir div dl fieldset figure footer form header html main nav ol section table td th ul".split())
#: Ends of inline elements do not reach over these.
_WALLS = frozenset("article aside div main nav section".split())
#: A start tag of the key closes an open element of the value, as in HTML.
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Words of a class or id that name a role other than the article's.
_HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment commentarea commentbox commentform commentlist comments"
    " commentsection commentthread consent cookie cookies disclaimer disqus dropdown footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices"
    " notification pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " teaser toc toolbar topbar widget widgets".split()
)
#: Words that may stand beside them in one name without changing its meaning.
_BESIDE = frozenset(
    "area article articles bar block bottom box button buttons col column container desktop entry fixed floating form global grid group holder icon icons inner item items latest left link"
    " links list lower main mobile more news outer page panel place popular post posts primary reader recent right row secondary section site slot space sticky stories thread top unit upper"
    " user wrap wrapper zone".split()
)
_HEADER = frozenset("header bar container fixed global inner logo main menu nav page site sticky top wrap wrapper".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)(>?)|<!--|<[!?/]""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


def names_boilerplate(value: str, inside: bool) -> bool:
    """Whether one of the names in a class or id means, as a whole, a part that is not article text."""
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _HINTS and words <= _HINTS | _BESIDE or not inside and "header" in words and words <= _HEADER:
            return True
    return False


def evidence(name: str, attributes: str, inside: bool) -> str:
    """Evidence against an element: never (no text at all), hard, soft or form (these may be wrappers), or nothing."""
    if name in _NEVER:
        return "never"
    if name in _HARD or name == "header" and not inside:
        return "hard"
    soft = False
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                return "never"
            if key == "role" and value.lower() in _ROLES:
                soft = True
            elif key == "class" or key == "id" and name not in _HEADINGS:
                soft = soft or names_boilerplate(value, inside)
    return "soft" if soft else "form" if name == "form" else ""


class Lines:
    """The blocks of a page. rows: (text, characters in links, suspect, part, holder). A suspect is an element with evidence
    against it, by number, 0 none; a part an outermost article or main element; a holder the element that lines stand in."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, int, int, int]] = []
        self.suspects: list[list] = [[0, "", 0, False]]  # the suspect around it, evidence, characters, whether it holds a part
        self.parts = 0
        #: name, never, suspect, part, header of an article, holder; the page itself is at the bottom.
        self._stack: list[tuple[str, bool, int, int, bool, int]] = [("", False, 0, 0, False, 0)]
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._blocks: list[int] = []
        self._walls: list[int] = []
        self._said = 0  # open headings and paragraphs
        self._holders = 0
        self._buffer: list[str] = []
        self._links = 0
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if not m:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at : m.start()])
            if not m[2]:
                close, gap = ("-->", 2) if m[0] == "<!--" else (">", 1)
                end = page.find(close, m.start() + gap)
                at = n if end < 0 else end + len(close)
                continue
            at = m.end()
            if not m[4]:
                break  # the page ends inside a tag
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            self._start(name, m[3])
            if name in _RAW:
                end = _ENDS[name].search(page, at)
                at = end.start() if end else n
        self._flush()

    def _text(self, raw: str) -> None:
        _, never, _, _, header, _ = self._stack[-1]
        if never or header and not self._said:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._buffer.append(text)
        if self._open.get("a"):
            self._links += len(text)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                _, _, suspect, part, _, holder = self._stack[-1]
                self.rows.append((text, self._links, suspect, part, holder))
                self.suspects[suspect][2] += len(text)
            self._buffer, self._links = [], 0

    def _gap(self) -> None:
        self._flush()
        if self.rows and self.rows[-1][0]:
            self.rows += [("", 0, 0, 0, 0)] * BLOCK

    def _start(self, name: str, attributes: str) -> None:
        if self._open.get("head") and name not in _IN_HEAD:
            self._close("head")
        if name in _BLOCKS:
            self._flush()
            p = self._open.get("p")
            if p and p[-1] >= self._blocks[-1]:
                self._close("p")
        elif name in ("br", "td", "th"):
            self._buffer.append(" ")
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            return
        if name in _CLOSES and self._stack[-1][0] in (name, _CLOSES[name]):
            self._close(self._stack[-1][0])
        _, never, suspect, part, header, holder = self._stack[-1]
        if not never:
            against = evidence(name, attributes, part > 0)
            if against == "never":
                if name in _BLOCKS:
                    self._flush()
                never = True
            elif against:
                self._gap()
                self.suspects.append([suspect, against, 0, False])
                suspect = len(self.suspects) - 1
            elif name in ("article", "main"):
                self.suspects[suspect][3] = True
                if not part:
                    self._gap()
                    self.parts += 1
                    part = self.parts
        if name in _HOLDERS:
            self._holders += 1
            holder = self._holders
        k = len(self._stack)
        self._stack.append((name, never, suspect, part, header or name == "header" and part > 0, holder))
        self._open.setdefault(name, []).append(k)
        if name in _BLOCKS:
            self._blocks.append(k)
        if name in _WALLS:
            self._walls.append(k)
        self._said += name in _HEADINGS or name == "p"

    def _close(self, name: str) -> None:
        places = self._open.get(name)
        if not places:
            return
        k = places[-1]
        if name not in _BLOCKS and self._walls and self._walls[-1] > k:
            return  # a stray end of an inline element does not end what holds blocks
        if self._blocks and self._blocks[-1] >= k:
            self._flush()
        below, top = self._stack[k - 1], self._stack[-1]
        if top[2] != below[2] or top[3] != below[3]:
            self._gap()
        while len(self._stack) > k:
            gone = self._stack.pop()[0]
            self._open[gone].pop()
            self._said -= gone in _HEADINGS or gone == "p"
            if gone in _BLOCKS:
                self._blocks.pop()
            if gone in _WALLS:
                self._walls.pop()

    def dropped(self) -> list[bool]:
        """For each suspect whether its lines go."""
        whole = sum(s[2] for s in self.suspects)
        for around, _, chars, part in reversed(self.suspects[1:]):
            self.suspects[around][2] += chars
            self.suspects[around][3] |= part
        out = [False]
        for around, against, chars, part in self.suspects[1:]:
            wrapper = against != "hard" and part and 2 * chars > whole
            # A form of short lines alone is a form.
            around_all = against == "form" and not self.parts and 10 * (whole - chars) < chars and any(len(t) >= MIN_SURGE for t, *_ in self.rows)
            out.append(out[around] or not (wrapper or around_all))
        return out


def surges(lengths: list[int], threshold: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of the runs from a surge to its dive."""
    n = len(lengths)
    blocks = [sum(lengths[i : i + BLOCK]) for i in range(n)]
    if threshold is None:
        threshold = min(MIN_SURGE, max(1, max(blocks, default=0) // 5))
    out, at = [], 0
    while at < n:
        if lengths[at] and blocks[at] >= threshold:
            start = at
            while at < n and blocks[at] > 0:
                at += 1
            out.append((start, at))
        else:
            at += 1
    return out


def keep(lines: Lines) -> list[str]:
    """Texts of the lines that belong to the article."""
    gone = lines.dropped()
    rows = [("" if gone[s] else t, links, part, holder) for t, links, s, part, holder in lines.rows]
    in_part = [0] * (lines.parts + 1)
    for t, _, part, _ in rows:
        in_part[part] += len(t)
    in_part[0] = 0
    free = [0 if part or links > 0.6 * len(t) else len(t) for t, links, part, _ in rows]
    runs = surges(free)
    best = max(in_part)
    if best and sum(sum(free[a:b]) for a, b in runs) <= MARKED * best:
        return [t for t, _, part, _ in rows if t and in_part[part] >= SHARE * best and part]
    kept, holders = set(), {}
    for a, b in runs:
        for i in range(a, b):
            if rows[i][0] and not rows[i][2]:
                kept.add(i)
                holders.setdefault(rows[i][3], i)
    for i, length in enumerate(free):
        if length and holders.get(rows[i][3], len(rows)) < i:
            kept.add(i)
    return [rows[i][0] for i in sorted(kept)]


def main_text(page: str | None) -> str:
    return "\n\n".join(keep(Lines(page or "")))


def extracted(page: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(page)


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages."""
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), extracted(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
