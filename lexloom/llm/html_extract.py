"""Operator 1: main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block-level tags split
the page into lines; every line has its characters of text, its tags and the
container it stands in. The ratio of text to tags per line is smoothed with a
Gaussian, and two-means clustering of the smoothed ratios sets a threshold. The
lines above it vote with their characters:

1. Blocks whose class or id names a part that is no content are doubtful. A
   block goes if a whole class, or the last part of one, is a sure name
   (comments, adverts, notices, sidebars and the like; ``reader-comments``).
   Where such a word is another part of a name, or the name is one that content
   may have too, the block goes if its own ratio is below the threshold; names
   of headers do not count inside an article or main, and an article is doubtful
   only inside another, by a sure name. Where no article or main stands outside
   of doubtful blocks, one that holds most votes is content after all.
2. The content is every outermost article or main with a vote, if together they
   have at least half of all votes; else the smallest container that holds all
   votes, and containers around it while they add nothing but headings and
   paragraphs without links. All its lines are kept whatever their length, but for those of blocks
   that go.

Menus, headers, footers, sidebars, forms, scripts and styles that are elements
or roles of their own are left out by the parser. Null and empty pages give an
empty text, so do pages without content. Character references are decoded, white
space inside a block is one space, blocks are trimmed and joined by a line feed.
Rows are independent: repeated rows give repeated results, other columns are
ignored, an empty table gives an empty result. Unclosed and crossed tags are
repaired as browsers do for blocks, marked sections are comments as there. The
time is linear in a page's length, however deep its blocks are nested.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship

#: Element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div body td center".split())
#: Blocks that a class or id can make doubtful.
WHOLE = frozenset("center dd details div dl footer header hgroup li ol section table tbody td tr ul".split())
DROPPED = frozenset(
    "nav footer aside form menu search script style noscript template head title iframe object svg button select option textarea"
    " input label dialog canvas audio video map applet noframes".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
CLOSES_P = BLOCKS - {"body", "html"}


def names(words: str, part: str = "") -> re.Pattern[str]:
    """Classes that are one of the words or end with one; with ``part`` = "any", that have one as any part."""
    front, behind = r"(?:^|[\s_-])", r"(?:$|[\s_-])" if part == "any" else r"(?:$|\s)"
    return re.compile(f"{front}(?:{'|'.join(words.split())}){behind}", re.I)


SURE_NAMES = (
    r"ads? advert\w* sponsor\w* promo\w* breadcrumbs? sidebar cookies? consent gdpr popup modal newsletter subscribe comments? disqus replies respond"
)
SURE = names(SURE_NAMES)
MAYBE = names(
    SURE_NAMES
    + r" banner nav\w* menu\w* side footer notice social share sharing related recommend\w* login signup search widget skip pagination pager toolbar copyright legal",
    "any",
)
HEADER = names("header masthead", "any")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
SPACE = re.compile(r"\s+")


class Line:
    __slots__ = ("parts", "tags", "node", "doubt", "prose")

    def __init__(self, node: int, doubt: int, prose: bool):
        self.parts: list[str] = []
        self.tags = 0
        self.node, self.doubt, self.prose = node, doubt, prose

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


class Reader(HTMLParser):
    """Turns parser events into lines.

    Containers and doubtful blocks are numbered as they open; ``outer`` has the
    number of the next one around each, so a number is above its outer's.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: name, starts something dropped, the container and doubtful block around what follows
        self.stack: list[tuple[str, bool, int, int]] = []
        self.open: Counter = Counter()
        self.depth = 0
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.outer, self.outer_doubt = [0], [0]
        self.articles: set[int] = set()
        self.sure: set[int] = set()
        #: an article or main stands outside of all doubtful blocks
        self.plain = False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def _break(self) -> None:
        self.line = None

    def _now(self) -> Line:
        if self.line is None:
            self.line = Line(*self.stack[-1][2:], self.stack[-1][0] in PROSE) if self.stack else Line(0, 0, False)
            self.lines.append(self.line)
        return self.line

    def _pop(self, at: int) -> None:
        for name, bad, _, _ in self.stack[at:]:
            self.depth -= bad
            self.open[name] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.open["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name == "p":
                    self._pop(i)
                    break
                if name in BLOCKS:
                    break
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option") and self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                name = self.stack[i][0]
                if name == tag:
                    self._pop(i)
                    break
                if name in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag in BLOCKS:
            self._break()
        elif tag == "br" and not self.depth:
            self._now().parts.append(" ")
        if tag in VOID:
            if self.line:
                self.line.tags += 1
            return
        inside = self.open["article"] + self.open["main"] > 0
        bad = tag in DROPPED or tag == "header" and not inside
        sure = maybe = False
        if not bad and attrs and tag not in ("html", "body", "main"):
            for key, value in attrs:
                if value and key in ("class", "id") and (tag in WHOLE or tag == "article" and inside):
                    sure = sure or bool(SURE.search(value))
                    maybe = tag != "article" and (maybe or bool(MAYBE.search(value)) or not inside and bool(HEADER.search(value)))
                elif value and key == "role" and value.lower() in ROLES:
                    bad = True
        _, _, node, doubt = self.stack[-1] if self.stack else ("", False, 0, 0)
        if not bad and not self.depth:
            if tag in CONTAINERS:
                self.outer.append(node)
                node = len(self.outer) - 1
                if tag in ("article", "main"):
                    self.articles.add(node)
                    self.plain = self.plain or not doubt
            if sure or maybe:
                self.outer_doubt.append(doubt)
                doubt = len(self.outer_doubt) - 1
                if sure:
                    self.sure.add(doubt)
        self.stack.append((tag, bad, node, doubt))
        self.open[tag] += 1
        self.depth += bad
        if not self.depth:
            self._now().tags += 1
            if tag == "a":
                self._now().prose = False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    if tag in BLOCKS:
                        self._break()
                    elif self.line and not self.depth:
                        self.line.tags += 1
                    return
                if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                    return
        elif tag == "p":
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.depth and (data.strip() or self.line is not None):
            self._now().parts.append(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with the weights renormalised at both ends."""
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), weights, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                norm += w
        out.append(total / norm)
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """Midpoint of two means; everything passes where the values are alike."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low
    for _ in range(rounds):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(a) / len(a) if a else low, sum(b) / len(b) if b else high)
        if abs(new[0] - low) + abs(new[1] - high) < 1e-9:
            break
        low, high = new
    return (low + high) / 2


def summed(own: list[float], outer: list[int]) -> list[float]:
    """Sums over all that is inside each number; inner numbers are larger."""
    for k in range(len(own) - 1, 0, -1):
        own[outer[k]] += own[k]
    return own


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = [(line, t) for line in reader.lines if (t := line.text())]
    if not lines:
        return ""
    smooth = smoothed([len(t) / max(1, line.tags) for line, t in lines], sigma)
    cut = threshold(smooth)
    voters = [len(t) if s >= cut else 0 for (_, t), s in zip(lines, smooth, strict=True)]
    # doubtful blocks; number 0 is none
    doubts = len(reader.outer_doubt)
    chars, tags, votes = [0.0] * doubts, [0.0] * doubts, [0.0] * doubts
    for (line, t), v in zip(lines, voters, strict=True):
        chars[line.doubt] += len(t)
        tags[line.doubt] += line.tags
        votes[line.doubt] += v
    chars, tags, votes = (summed(x, reader.outer_doubt) for x in (chars, tags, votes))
    out = [False] * doubts
    for d in range(1, doubts):
        few = reader.plain or 2 * votes[d] < votes[0]
        out[d] = out[reader.outer_doubt[d]] or few and (d in reader.sure or chars[d] < cut * max(1, tags[d]))
    # the containers of the content; number 0 is the page
    own = [0.0] * len(reader.outer)
    for (line, _), v in zip(lines, voters, strict=True):
        own[line.node] += 0 if out[line.doubt] else v
    inner = summed(own, reader.outer)
    total = inner[0]
    outermost, top = set(), [False] * len(inner)
    for c in range(1, len(inner)):
        top[c] = top[reader.outer[c]] or c in reader.articles
        if top[c] and not top[reader.outer[c]] and inner[c]:
            outermost.add(c)
    if not outermost or 2 * sum(inner[c] for c in outermost) < total:
        # a container's number is above that of all around it
        best = max(c for c in range(len(inner)) if inner[c] == total)
        # per container: lines that are neither dropped nor prose, so that headings and paragraphs around the content join it
        other = [0.0] * len(inner)
        for line, _ in lines:
            other[line.node] += not (out[line.doubt] or line.prose)
        other = summed(other, reader.outer)
        while best and other[reader.outer[best]] == other[best]:
            best = reader.outer[best]
        outermost = {best}
    inside = [0 in outermost] * len(inner)
    for c in range(1, len(inner)):
        inside[c] = c in outermost or inside[reader.outer[c]]
    return "\n".join(t for line, t in lines if inside[line.node] and not out[line.doubt])


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", sigma: float = 1.0) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), sigma) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=PAGES
            )

    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
