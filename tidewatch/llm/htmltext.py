"""HTML main-text extraction by tree scoring.

A page is read into a tree in one pass.  Elements that are never the article (menus,
footers, forms, scripts and the like) are left out.  Every block of text earns points for
its commas and its length, which go to the elements around it, in full to the nearest
container and in falling parts to those further out; a container's points are discounted
by its link density.  The best container is kept, with those of its siblings that score
well or read like paragraphs.

Words of a class, id or role mark parts as adverts, notices, comments and so on, but a mark
is weighed: a part that holds the article itself (an article, a main or the page's title) is
only a wrapper; words that are said to be absent or are mere tags (``no-sidebar``,
``ad-free``, ``tag-alert``) mark nothing; a part with a doubtful word (``related``,
``header``), or with a word that names a topic here (``share-price-analysis``,
``notice-board-history``), stays if it has prose or a heading and few links.  If nothing is left by the
marks, they are not heeded.

Time is linear in the page, also for unclosed tags, quotes and comments: what is once
looked for in vain up to the page's end is not looked for again, and open elements are
found by their names.

Defined cases: a null or empty page, and one without article text, gives the empty text;
unclosed, misnested and cut-off markup is read as far as it goes; depth and length are not
bounded; repeated rows are read row by row; an empty table gives no rows; the columns that
are asked for pass through whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import as_row, with_row
from .words import pieces

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r">|=\s*[\"']")
_ATTRIBUTES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: Numbers of character references that can't be code points, and leading zeros.
_HUGE, _ZEROS = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
NEVER = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg math canvas button select textarea input label fieldset dialog menu audio video title".split()
)
#: Words of a class, id or role that mark a part as no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal cookie cookies consent gdpr notice notices disclaimer sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments respond disqus replies share sharing social newsletter subscribe signup login skip complementary contentinfo".split()
)
#: Those that topics are named by too: they mark a part if the last words of the label name a piece of a page (``share-buttons``), and may mark one else (``share-price-analysis``).
ORDINARY = frozenset("banner notice notices disclaimer comment comments share sharing social navigation menu promotion consent skip respond".split())
PIECES = frozenset(
    "area author avatar bar block body bottom box btn button buttons card cards closed column container content count counter date dialog entry feed float form group heading icon icons inner input item items "
    "label layout left line link links list lists main media message messages meta module network networks open outer panel policy post posts region right row section slot strip tab text thread title toggle tools top "
    "view wall wrap wrapper zone".split()
)
#: Words that may mark one.
DOUBTFUL = frozenset("header alert overlay aside follow related recommended recommendations widget widgets reply search tags taglist".split())
#: Of an article element, only these are heeded.
OF_ARTICLES = frozenset("comment comments reply replies".split())
#: First parts of a class by which its other parts mark nothing, and such last parts.
ABSENT, ABSENT_AFTER = frozenset("has no not with without hide is tag category".split()), frozenset("free less".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a block's text themselves; their points go to the element around them.
LEAVES = HEADINGS | frozenset("p pre li dt dd td th blockquote figcaption caption summary address".split())
#: Points that an element starts with.
START = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0}
#: An element that starts closes these open ones, up to the given scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Characters from which a block is prose, and the part of links up to which a doubtful or sibling part is kept.
PROSE, LINKS = 60, 0.25


def _marks(name: str, rest: str) -> int:
    """2 for an element that class, id or role mark as no article text, 1 for a doubtful one, else 0."""
    if "=" not in rest or name in ("html", "body", "main"):
        return 0
    worst = 0
    for groups in _ATTRIBUTES.findall(rest):
        for label in "".join(groups).split():
            parts = [w.lower() for w in _PARTS.findall(label)]
            if len(parts) > 1 and (parts[0] in ABSENT or parts[-1] in ABSENT_AFTER):
                continue
            while len(parts) > 1 and parts[-1] in PIECES:
                parts.pop()
            topic = parts and parts[-1] not in MARKS and parts[-1] not in DOUBTFUL and (MARKS if name != "article" else OF_ARTICLES).isdisjoint(w for w in parts if w not in ORDINARY)
            if name == "article":
                worst = max(worst, 2 * (not topic and not OF_ARTICLES.isdisjoint(parts)))
            elif not MARKS.isdisjoint(parts):
                worst = max(worst, 1 if topic else 2)
            elif not DOUBTFUL.isdisjoint(parts) and name not in HEADINGS:
                worst = max(worst, 1)
    return worst


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = _ZEROS.sub(r"\1", _HUGE.sub("\ufffd", text))
    return html.unescape(text) if "&" in text else text


class Page:
    """A page's elements in document order, and its blocks of text with the element each is in."""

    def __init__(self, source: str):
        self.name, self.parent, self.out, self.mark = ["html"], [-1], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._open, self._links = [0], 0
        self._depths: dict[str, list[int]] = defaultdict(list, html=[0])  # of the open elements, by name
        self._holders = [0]  # open elements that hold blocks
        self._parts: list[str] = []
        self._linked = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, n, unclosed = 0, len(source), set()
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                self._text(source[at:begin])
            if begin == n:
                return
            second = source[begin + 1 : begin + 2]
            if source.startswith("<!--", begin):
                close = source.find("-->", begin + 2)
                at = close + 3 if close >= 0 else n
                continue
            named = _NAME.match(source, begin + (2 if second == "/" else 1))
            if named is None:
                if second and second in "!?/":
                    close = source.find(">", begin)
                    at = close + 1 if close >= 0 else n
                else:
                    self._text("<")
                    at = begin + 1
                continue
            end = named.end()
            while (stop := _QUOTE.search(source, end)) and stop.group() != ">":  # a value in quotes may hold anything
                quote, end = source[stop.end() - 1], stop.end()
                if quote not in unclosed:
                    close = source.find(quote, end)
                    if close < 0:
                        unclosed.add(quote)
                    else:
                        end = close + 1
            at, last = (stop.end(), stop.start()) if stop else (n, n)
            name = named.group().lower()
            if second == "/":
                self._end(name)
                continue
            rest = source[named.end() : last]
            self._start(name, rest)
            if name in RAW and not rest.endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else n

    def _text(self, text: str) -> None:
        if not self.out[self._open[-1]]:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(_unescaped("".join(self._parts)).split())
            if text:
                self.blocks.append((self._holders[-1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _close(self, depth: int) -> None:
        """Closes the open elements from this depth on."""
        closing = self._open[depth:]
        if any(self.name[e] in BLOCK for e in closing):
            self._flush()
        for e in closing:
            self._links -= self.name[e] == "a"
            self._depths[self.name[e]].pop()
            if self.name[e] in BLOCK:
                self._holders.pop()
        del self._open[depth:]

    def _deepest(self, names) -> int:
        return max((self._depths[x][-1] for x in names if self._depths.get(x)), default=-1)

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            return self._text(" ")
        if name in ("html", "body") and self._depths.get(name):
            return None
        closed, scope = ({"p"}, {"td", "th", "button", "object"}) if name in BLOCK and name not in CLOSES else CLOSES.get(name, (set(), set()))
        if name in CLOSES and name != "option":
            self._close_open({"p"}, scope | closed)
        self._close_open(closed, scope)
        if name in BLOCK:
            self._flush()
        up, mark = self._open[-1], _marks(name, rest)
        out = self.out[up] or name in NEVER or _HIDDEN.search(rest) is not None or (mark == 2 and name not in BLOCK)
        if name == "header" and not self._depths.get("article") and not self._depths.get("main"):
            out = True
        if name not in VOID and not rest.endswith("/") or name in RAW:
            self.name.append(name)
            self.parent.append(up)
            self.out.append(out)
            self.mark.append(mark if name in BLOCK else 0)
            e = len(self.name) - 1
            self._depths[name].append(len(self._open))
            self._open.append(e)
            self._links += name == "a"
            if name in BLOCK:
                self._holders.append(e)
        return None

    def _close_open(self, names: set[str], scope: set[str]) -> None:
        depth = self._deepest(names)
        if depth > 0 and depth > self._deepest(scope):
            self._close(depth)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        if self._depths.get(name) and self._depths[name][-1] > 0:
            self._close(self._depths[name][-1])

    def _left_out(self, chars: list[int], linked: list[int], heed: bool) -> list[bool]:
        """Which elements are no article text, by their kind and by their marks, weighed."""
        n = len(self.name)
        if not heed:
            return list(self.out)
        holds, prose = [False] * n, [False] * n  # the article or its title; a heading or prose
        for element, text, _ in self.blocks:
            prose[element] = prose[element] or len(text) >= PROSE or self.name[element] in HEADINGS
        for e in range(n - 1, 0, -1):
            up, name = self.parent[e], self.name[e]
            holds[up] = holds[up] or holds[e] or name == "h1" or name in ("article", "main") and self.mark[e] < 2
            prose[up] = prose[up] or prose[e]
        out = list(self.out)
        for e in range(1, n):
            few_links = linked[e] < LINKS * max(chars[e], 1)
            marked = self.mark[e] == 2 or self.mark[e] == 1 and not (prose[e] and few_links)
            out[e] = out[e] or out[self.parent[e]] or marked and not holds[e]
        return out

    def article(self) -> list[str]:
        """The blocks of the best container and of its good siblings, in page order."""
        return self._best(True) or self._best(False)

    def _best(self, heed: bool) -> list[str]:
        n = len(self.name)
        chars, linked = [0] * n, [0] * n
        for element, text, in_links in self.blocks:
            chars[element] += len(text)
            linked[element] += in_links
        total = self._added(chars), self._added(linked)
        out = self._left_out(*total, heed)
        blocks = [b for b in self.blocks if not out[b[0]]]
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        for element, text, in_links in blocks:
            earned = 1 + text.count(",") + min(len(text) / 100, 3)
            chars[element] += len(text)
            linked[element] += in_links
            holder = self.parent[element] if self.name[element] in LEAVES and self.parent[element] >= 0 else element
            if self.name[element] in HEADINGS:
                earned = 0.5
            part = 1
            while holder >= 0 and part < 5:
                points[holder] += earned / part
                holder, part = self.parent[holder], part + 1
        chars, linked = self._added(chars), self._added(linked)
        score = [(points[e] + START.get(self.name[e], 0)) * (1 - linked[e] / chars[e]) if points[e] and chars[e] and not out[e] else 0.0 for e in range(n)]
        best = max(range(n), key=lambda e: (score[e], e))
        if score[best] <= 0:
            return []
        kept = {best}
        bar = score[best] / 5
        own: dict[int, list[str]] = {}
        for element, text, _ in blocks:
            own.setdefault(element, []).append(text)
        for e in range(1, n):
            if e != best and self.parent[e] == self.parent[best] and not out[e] and chars[e]:
                density, text = linked[e] / chars[e], " ".join(own.get(e, []))
                paragraph = self.name[e] in LEAVES and (density < LINKS and len(text) > 80 or not density and (self.name[e] == "h1" or text[-1:] in ".!?…。"))
                if score[e] >= bar or paragraph:
                    kept.add(e)
        inside = [False] * n
        for e in range(n):
            inside[e] = e in kept or self.parent[e] >= 0 and inside[self.parent[e]]
        return [text for element, text, _ in blocks if inside[element]]

    def _added(self, values: list[int]) -> list[int]:
        """The sums over each element and all that it holds."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks joined by two line feeds."""
    return "\n\n".join(Page(source).article()) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources = batch.column("html")
        for a, b in pieces(sources, 8 << 20):
            texts = [main_text(x) for x in sources.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"]
            )


def extract(pages: DataFrame, carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """row (a struct of the carried columns), text and n_chars (code points) of every page."""
    rows = pages.select(as_row(carry), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, with_row(rows, "text string, n_chars long"))
