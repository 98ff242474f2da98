"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events; every block element opens
a new line.  Each line has a text-to-tag ratio: its characters outside links
over its number of tags.  The ratios are smoothed by a Gaussian, and lines above
a threshold set from the page's own ratios form clusters.  The article or main
element around the element that holds the clusters' text is the content region,
or else the element around all clusters; short lines within it (a heading, a lead,
a last short paragraph) belong to it.  Lines in elements whose name, role or class
says that they are something else never count.  Within an article a class must say so
as a whole ("share", "related-posts"); a container whose id or class merely holds such a
word goes only if most of its characters are in links, and headings, paragraphs and
text-level elements are never judged by an id, which is often made from a heading's words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

SIGMA = 1.0
THRESHOLD = 0.5   # of the smoothed ratios' standard deviation, from zero
COVER = 0.9       # of the clusters' text that the region's core must hold
LINKED = 0.5      # outside an article, a line with more of its characters in links is a menu
FEED = 1 << 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes
noscript ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: Elements that are never part of the article.
OTHER = frozenset("""script style noscript template head title nav aside footer form button select option textarea
input svg iframe object canvas audio video dialog menu search datalist label""".split())
#: Words of class, id, role and aria-label that name such parts; a word counts if it stands alone between
#: hyphens, underscores, blanks, digits or changes of case.
NAMED = frozenset("""ad ads adbox adslot advert adverts advertisement advertising adverisement sponsor sponsored
sponsors promo promotion promoted banner menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead
topbar footer colophon sidebar aside rail widget widgets complementary contentinfo notice notices notification alert
cookie cookies consent gdpr disclaimer popup modal overlay dialog lightbox newsletter subscribe subscription signup
login register paywall form search share sharing social related recommended recommendations teaser teasers trending
comment comments commentlist respond reply replies discussion disqus reactions pagination pager toolbar toc tags
skip copyright legal""".split())
#: Words that add nothing to a name of NAMED: "comments-list" is as whole a name as "comments".
PLAIN = frozenset("""block box list links section wrapper wrap container content area bar slot unit item items post
posts article articles page site story user reader inline top bottom left right main global btn button buttons icons
module panel group inner outer row col sticky""".split())
#: Of NAMED, words that are as well headings of an article's own sections.
TOPICS = frozenset("discussion legal notice notices search related copyright alert disclaimer promotion reactions".split())
#: The names by which a text-level element within an article goes.
ADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup title caption legend summary".split())
#: Elements that hold other blocks and may be a part of the page by their id alone.
CONTAINERS = frozenset("div section center details dl ul ol form fieldset table header footer aside nav".split())
#: These may name the page's parts or parts of an article; within one they are its own.
OWN = frozenset({"header", "masthead", "banner"})
#: Elements that end a paragraph left open, as the HTML standard has it.
ENDS_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "title", "html", "body"}
#: An element that its like, opening beside it, ends.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _named(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> str:
    """"other" if the attributes say that the element is no part of an article, "doubtful" if its
    text has to tell, else empty.  ``article``: within an article or main element."""
    found = ""
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" \
                or key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return "other"
        if not value or key not in ("class", "id", "role", "aria-label"):
            continue
        if key == "id" and tag not in CONTAINERS or article and tag in HEADINGS:
            continue
        for name in value.split() if key == "class" else (value,):
            words = {w.lower() for w in _WORDS.findall(name)}
            named = words & NAMED - OWN if article else words & NAMED
            if not named:
                continue
            whole = words <= NAMED | PLAIN
            if key == "id":
                sure = (whole or not article and tag != "section") and not named <= TOPICS
            elif not article or key == "role":
                sure = True
            elif tag in CONTAINERS:
                sure = whole
            else:
                sure = len(words) == 1 and (tag in BLOCK or words <= ADS)
            if sure:
                return "other"
            if tag in CONTAINERS:
                found = "doubtful"
    return found


class Lines(HTMLParser):
    """Turns parser events into lines: [text parts, tags, characters in links, container, other].

    Containers are numbered as they open, after their parents; 0 is the page.  ``at`` has the
    places on the stack of each name, so no event looks through the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.stack: list[tuple[str, int, bool]] = []  # block elements: name, number, other
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.parents = [0]
        self.kinds: dict[int, str] = {}  # of article and main elements
        self.doubtful: set[int] = set()
        self.inline_other: list[str] = []
        self.inline_count: defaultdict[str, int] = defaultdict(int)
        self.links = 0
        self.new = True

    def _line(self) -> list:
        if self.new or not self.lines:
            _, number, other = self.stack[-1] if self.stack else ("", 0, False)
            self.lines.append([[], 0, 0, number, other])
            self.new = False
        return self.lines[-1]

    def _last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def _pop(self, to: int) -> None:
        if to < len(self.stack):
            for name, _, _ in reversed(self.stack[to:]):
                self.at[name].pop()
            del self.stack[to:]
            self.inline_other.clear()
            self.inline_count.clear()
            self.links = 0
        self.new = True

    def _close_implied(self, tag: str) -> None:
        if tag in ENDS_P:
            k = self._last("p")
            if k > self._last("td", "th", "caption", "table", "button", "object", "div", "section", "article", "body"):
                self._pop(k)
        if tag in SIBLINGS:
            like, within = SIBLINGS[tag]
            k = self._last(*within)
            nexts = [self.at[n][i] for n in like if (i := bisect_right(self.at[n], k)) < len(self.at[n])]
            if nexts:
                self._pop(min(nexts))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        article = bool(self.at["article"] or self.at["main"])
        judged = attrs and tag not in ("html", "body", "article", "main")
        named = _named(tag, attrs, article) if judged else ""
        block = tag in BLOCK
        if block or named and tag not in VOID and tag != "a":
            if block:
                self._close_implied(tag)
            if tag in VOID:
                self.new = True
                return
            inside = bool(self.stack) and self.stack[-1][2]
            article = bool(self.at["article"] or self.at["main"])
            other = inside or tag in OTHER or tag == "header" and not article or named == "other"
            number = len(self.parents)
            self.parents.append(self.stack[-1][1] if self.stack else 0)
            self.at[tag].append(len(self.stack))
            self.stack.append((tag, number, other))
            if tag in ("article", "main") or ("role", "main") in attrs:
                self.kinds[number] = "article" if tag == "article" else "main"
            if named == "doubtful":
                self.doubtful.add(number)
            self.new = True
            return
        if tag in OTHER and tag not in VOID:
            self.inline_other.append(tag)
            self.inline_count[tag] += 1
            return
        if tag == "br":
            self.handle_data(" ")
        if tag == "a":
            self.links = 1
        if not self.new:
            self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash means nothing on elements of HTML that can have content
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if self.inline_count[tag]:
            while True:
                name = self.inline_other.pop()
                self.inline_count[name] -= 1
                if name == tag:
                    return
        k = self._last(tag)
        cell = tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "article", "main", "body", "html")
        barrier = -1 if cell else self._last("td", "th", "table")
        if k > barrier:
            self._pop(k)
        elif barrier < 0 and tag in BLOCK:
            self.new = True

    def handle_data(self, data: str) -> None:
        if self.inline_other or not data:
            return
        if self.new and not data.strip():
            return
        line = self._line()
        line[0].append(data)
        if self.links:
            line[2] += len(data.strip())


def lines_of(html: str) -> tuple[list[tuple[str, float, float, int, bool]], Lines]:
    """(text, ratio, share of the text in links, container, other) per line, and the
    parser, which has the containers' parents and kinds."""
    parser = Lines()
    for a in range(0, len(html), FEED):
        parser.feed(html[a:a + FEED])
    parser.close()
    out = []
    for parts, tags, linked, number, other in parser.lines:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            linked = min(linked, len(text))
            out.append((text, (len(text) - linked) / (1 + tags), linked / len(text), number, other))
    return out, parser


def _summed(own: list[float], parents: list[int]) -> list[float]:
    """Each container's sum over itself and all within it; parents have smaller numbers."""
    own = list(own)
    for n in range(len(own) - 1, 0, -1):
        own[parents[n]] += own[n]
    return own


def _within(marked, parents: list[int]) -> list[bool]:
    """Whether each container is one of ``marked`` or lies within one."""
    out = [0 in marked]
    for n in range(1, len(parents)):
        out.append(n in marked or out[parents[n]])
    return out


def _linked_parts(lines: list, parser: Lines) -> list[bool]:
    """Containers of a doubtful name whose characters are mostly in links, and what they hold."""
    chars, linked = [0.0] * len(parser.parents), [0.0] * len(parser.parents)
    for text, _, share, number, _ in lines:
        chars[number] += len(text)
        linked[number] += share * len(text)
    chars, linked = _summed(chars, parser.parents), _summed(linked, parser.parents)
    return _within({n for n in parser.doubtful if linked[n] > LINKED * chars[n]}, parser.parents)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; weights are normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        part = [(values[j], weights[j - i + reach]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(v * w for v, w in part) / sum(w for _, w in part))
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line breaks; empty if there are none."""
    if not html:
        return ""
    found, parser = lines_of(html)
    parents, kinds = parser.parents, parser.kinds
    lines = [x for x in found if not x[4]]
    if parser.doubtful:
        gone = _linked_parts(lines, parser)
        lines = [x for x in lines if not gone[x[3]]]
    if not lines:
        return ""
    smooth = smoothed([x[1] for x in lines], SIGMA)
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    limit = min(THRESHOLD * deviation if deviation else 0.0, max(smooth))
    chosen = [i for i, x in enumerate(lines) if smooth[i] >= limit and x[2] <= LINKED]
    if not chosen:
        return ""
    # the innermost element that holds most of the clusters' text
    held: list[float] = [0.0] * len(parents)
    for i in chosen:
        number = lines[i][3]  # a line's own paragraph is no region
        held[number if number in kinds else parents[number]] += len(lines[i][0])
    held = _summed(held, parents)
    total = held[0]
    # those that hold so much lie within each other, so the last number is the innermost
    core = max(n for n, x in enumerate(held) if x >= COVER * total)
    chain = [core]
    while chain[-1]:
        chain.append(parents[chain[-1]])
    # the whole article is wanted however long its core is: climb to the outermost article or main element around it
    outer = next((n for n in reversed(chain) if n in kinds), None)
    region = max(n for n, x in enumerate(held) if x >= total) if outer is None else outer
    article = next((n for n in reversed(chain) if kinds.get(n) == "article"), None)
    first, last = chosen[0], chosen[-1]
    in_region = _within({region}, parents)
    in_article = _within({article}, parents)
    in_any = _within({n for n, kind in kinds.items() if kind == "article"}, parents)
    out = []
    for i, (text, _, linked, number, _) in enumerate(lines):
        if not in_region[number]:
            continue
        if in_article[number]:
            out.append(text)
        elif article is not None and in_any[number]:
            continue  # another article of the page
        elif linked <= LINKED or first < i < last and linked < 1.0:
            out.append(text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty html, and pages without content, have the empty text.  Markup
    may be broken, cut off or nested anyhow; the time is linear in a page's length.  Rows that repeat a page repeat its result.
    An empty table gives an empty result; columns other than page_id, url and
    html are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return map_arrow(narrow, run, "page_id long, url string, text string, n_chars long")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
