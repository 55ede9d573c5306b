"""HTML extraction by line-block distribution.

A page is stripped to lines: every block-level tag ends a line, scripts, styles, comments, forms
and other elements without prose are set aside, and each line remembers what it stands in.  A line's
*content length* is its text's length, or zero if it stands in a menu, header, footer, sidebar,
notice, advert or reader comments (such a line keeps its place), or if more than half of it is link
text and it stands outside an article or among ``LIST`` such lines in a row.

Class and id names set an element aside by their words; inside an article only if the name is about
nothing else (its head, the last word that isn't a ``GENERIC`` one, is such a word): ``story-tags-note`` is a note, ``tags-list`` a list of tags.

The distribution is the sum of content lengths over a sliding window of ``WIDTH`` lines.  Content is first
parted where the sum is nothing; a part counts if its sum reaches ``SURGE`` of ``WIDTH`` typical lines
somewhere.  The *surge point* of a part is the first line whose strength reaches ``SURGE`` of a typical line, the *dive point* is
behind the last one, and the text kept stands between them.  A line's strength is its content length; a line in an element for prose
(paragraph, list item, quotation, preformatted) has enough of it in any case, a heading as much as the line that follows, and a bare line (in a div, a
table cell) only ``BARE`` of its length, unless it ends a sentence on a page whose prose stands in bare lines.
So short bare lines beside the article (a menu without a name, a box) fall outside, and short ones amid it stay.

The typical line is the one in which the middle character of the content stands, a line counting ``PROSE`` characters at
most, so neither many short lines nor one huge paragraph move it.  An article (or main) element that
holds half of the page's content or more gives its lines the weight ``WEIGHT`` (and strength enough), and windows
don't reach over an article's bounds.

Defined results: a null or empty page gives the empty text; unclosed tags, truncated pages and
stray ``<`` are read as browsers do (a tag cut off by the end is dropped, other stray marks are
text); repeated pages give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

WIDTH, SURGE, LINKS, LIST, BARE = 3, 0.25, 0.5, 3, 0.5
PROSE, WEIGHT = 200, 8
#: What HTML calls void, raw-text and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
DROPPED = frozenset("script style textarea title noscript template iframe noembed noframes xmp head nav footer aside form button select option svg math canvas object audio video menu dialog fieldset datalist map".split())
ARTICLE = frozenset("article main".split())
PROSE_TAGS = frozenset("p li dd dt blockquote pre figcaption summary article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of names that say where something stands, not what it is.
GENERIC = frozenset("section sections box boxes list wrapper wrap container content block area bar bars button buttons link links post posts item items panel left right top bottom inner outer row col column unit slot group main title heading header body text banner form strip card cards zone holder icon icons".split())
SENTENCE_END = re.compile(r"""[.!?\u2026:;][\s"'\u00BB\u201D\u2019)\]]*$""")
#: Words of class, id and role names of what isn't part of the article.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot masthead topbar"
    " sidebar aside side rail related recommended recommendations trending popular newsletter subscribe subscription signup signin login cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer"
    " comment comments commentlist disqus reply replies respond share sharing social toolbar widget skip tags copyright complementary contentinfo search searchbox hidden".split()
)
#: A comment, a tag (possessive, so that no page makes it slow), a declaration, or a tag cut off by the end.
MARK = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z""", re.S)
#: One attribute, its name first, so that nothing inside another one's value counts.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: What stands behind one of these in a name is what an element has, not what it is.
ABOUT = frozenset("has with without no not is show hide".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A new one of these ends an open one: (tag) -> tags it closes, up to the tags that shield it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHIELD = frozenset("ul ol dl table article main section div body html".split())
SCHEMA = "page_id long, url string, text string, n_chars long"


def set_aside(tag: str, attributes: str, in_article: bool = False) -> bool:
    """True if the element isn't part of the article by its tag or by its class, id or role."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in NAME_PART.findall(token)]
                told = parts[: next((k for k, p in enumerate(parts) if p in ABOUT), len(parts))]
                if in_article and name != "role":
                    # the head of the name decides
                    head = next((p for p in reversed(told) if p not in GENERIC and not p.isdigit()), None)
                    told = [p for p in told if p == head]
                if not ASIDE.isdisjoint(told):
                    return True
    return False


class Lines:
    """The lines of a page: (text, length of its link text, set aside, number of the outermost article it stands in or 0).

    ``kinds`` says of each line what it stands in: "p" an element for prose, "h" a heading, "" anything else.
    """

    def __init__(self, html: str):
        self.rows: list[tuple[str, int, bool, int]] = []
        self.kinds: list[str] = []
        self.blocks: list[str] = []
        self.parts: list[str] = []
        self.linked = self.aside = self.article = self.articles = self.links = 0
        self.skipped = False
        self.open: list[tuple[str, int, int]] = []
        # where each tag is open, and where those are that shield what lies outside
        self.places: dict[str, list[int]] = {}
        self.shields: list[int] = []
        at = 0
        while m := MARK.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.close(tag)
                else:
                    at = self.start(tag, m[3], m[3].endswith("/"), html, at)
        self.text(html[at:])
        self.end_line()

    def text(self, raw: str) -> None:
        if raw and not self.aside:
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw.strip())
        elif raw and not raw.isspace():
            self.skipped = True

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.rows.append((text, self.linked, False, self.articles if self.article else 0))
                block = self.blocks[-1] if self.blocks else ""
                self.kinds.append("p" if block in PROSE_TAGS else "h" if block in HEADINGS else "")
        at = self.articles if self.article else 0
        if self.skipped and not (self.rows and self.rows[-1][2:] == (True, at)):  # a run of what is set aside is one line
            self.rows.append(("", 0, True, at))
            self.kinds.append("")
        self.parts, self.linked, self.skipped = [], 0, False

    def start(self, tag: str, attributes: str, empty: bool, html: str, at: int) -> int:
        if tag not in INLINE:
            if tag == "br":
                self.parts.append(" ")
            else:
                self.end_line()
        if tag in VOID:
            return at
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            return end.end() if end else len(html)
        if tag in CLOSES:
            self.close_open(CLOSES[tag])
        if empty and tag in ("svg", "path"):
            return at
        # a header inside the article holds its title
        aside, article = int(set_aside(tag, attributes, self.article > 0) or tag == "header" and not self.article), int(tag in ARTICLE)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SHIELD:
            self.shields.append(len(self.open))
        self.open.append((tag, aside, article))
        if aside:
            self.end_line()
        if tag not in INLINE:
            self.blocks.append(tag)
        self.aside += aside
        self.articles += article and not self.article
        self.article += article
        self.links += tag == "a"
        return at

    def pop(self) -> None:
        tag, aside, article = self.open.pop()
        self.places[tag].pop()
        if tag in SHIELD:
            self.shields.pop()
        if article or aside:
            self.end_line()
        if tag not in INLINE:
            self.blocks.pop()
        self.aside -= aside
        self.article -= article
        self.links -= tag == "a"

    def close_open(self, tags: tuple[str, ...]) -> None:
        self.pop_to(max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1), True)

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if found := self.places.get(tag):
            # an inline end tag doesn't reach out of a block
            self.pop_to(found[-1], tag in INLINE)

    def pop_to(self, place: int, shielded: bool) -> None:
        """Ends all that is open from ``place`` on (none if negative), unless a shield stands in between."""
        if place < 0 or shielded and self.shields and self.shields[-1] > place:
            return
        while len(self.open) > place:
            self.pop()


def stretches(lengths: list[int], width: int, least: float, strengths: list[float] | None = None, strong: float = 0.0) -> Iterator[tuple[int, int]]:
    """(surge, dive) line numbers, end exclusive, of the distribution of ``lengths``."""
    n, start, peak = len(lengths), None, 0
    sums = [sum(lengths[i : i + width]) for i in range(n)] + [0]
    for i in range(n + 1):
        if start is None:
            if i < n and lengths[i] and sums[i]:
                start, peak = i, sums[i]
        elif not sums[i]:
            if peak >= least:
                # from the first to the last line that is strong enough
                strong_ones = [k for k in range(start, i) if strengths is None or strengths[k] >= strong]
                if strong_ones:
                    yield strong_ones[0], strong_ones[-1] + 1
            start = None
        else:
            peak = max(peak, sums[i])


def strengths_of(rows: list[tuple[str, int, bool, int]], kinds: list[str], lengths: list[int], heavy: list[bool], strong: float) -> list[float]:
    """How much each line speaks for prose; see the module's text."""
    tagged = sum(n for n, kind in zip(lengths, kinds) if kind == "p")
    in_prose = 2 * tagged > sum(lengths)
    out = [0.0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if not lengths[i]:
            continue
        if heavy[i] or kinds[i] == "p" or not kinds[i] and not in_prose and SENTENCE_END.search(rows[i][0]):
            out[i] = max(lengths[i], strong)
        elif kinds[i] == "h":
            out[i] = max(lengths[i], next((out[k] for k in range(i + 1, len(rows)) if lengths[k]), 0.0))
        else:
            out[i] = lengths[i] * BARE
    return out


def typical(lengths: list[int]) -> int:
    """The length of the line in which the middle character stands, each line counting ``PROSE`` at most."""
    middle = sum(min(n, PROSE) for n in lengths) / 2
    for n in sorted(lengths):
        middle -= min(n, PROSE)
        if middle <= 0:
            return n
    return 0


def content_lengths(rows: list[tuple[str, int, bool, int]]) -> list[int]:
    """Each line's length; 0 if it is set aside, or link text outside an article or in a list of ``LIST`` such lines."""
    out = [0 if aside else len(text) for text, _, aside, _ in rows]
    for is_link, run in groupby(range(len(rows)), lambda i: not rows[i][2] and rows[i][1] > LINKS * len(rows[i][0])):
        lines = list(run)
        for i in lines if is_link else ():
            if not rows[i][3] or len(lines) >= LIST:
                out[i] = 0
    return out


def extract(html: str | None, width: int = WIDTH, surge: float = SURGE) -> str:
    """The main text of one page."""
    if not html:
        return ""
    lines = Lines(html)
    rows = lines.rows
    lengths = content_lengths(rows)
    held: dict[int, int] = {}
    for n, (*_, article) in zip(lengths, rows):
        held[article] = held.get(article, 0) + n
    total, usual = sum(held.values()), typical(lengths)
    heavy = [bool(article) and 2 * held[article] >= total for *_, article in rows]
    weighted = [n * WEIGHT if h else n for n, h in zip(lengths, heavy)]
    least, strong, out = surge * width * usual, surge * usual, []
    strengths = strengths_of(rows, lines.kinds, lengths, heavy, strong)
    for _, run in groupby(range(len(rows)), lambda i: rows[i][3]):
        part = list(run)
        kept = stretches([weighted[i] for i in part], width, least, [strengths[i] for i in part], strong)
        out += [rows[i][0] for a, b in kept for i in part[a:b] if lengths[i]]
    return " ".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): the main text and its code points."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
