"""Main text of web pages from streaming parser events and text-to-tag ratios.

``html.parser`` events are folded into lines, one per block of the page; boilerplate
elements never reach a line. Each line has the ratio of its visible characters to its tags.
A Gaussian smooths the ratios along the page, and lines over a share of their standard
deviation form content regions. A region that lies in an article or main element grows to
all lines of that element, so that a short heading isn't lost beside long paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

SCHEMA = "page_id long, url string, text string, n_chars long, n_lines int, n_selected int"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
DROPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas audio video button select option textarea dialog menu map math".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these, if no container lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article aside body div dl footer header html main nav ol section table td th ul form blockquote".split())
#: Words in class, id or role that mark menus, adverts, notices, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar sidebars "
    "comment comments disqus discussion replies reply cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget pagination pager search "
    "complementary contentinfo navigation alertdialog dialog hidden".split()
)
#: Words that may stand beside a mark in a name ("related-posts", "ad_slot_2"); a name with any other word marks nothing.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content desktop element float footer form frame group head header holder icons inner item items label large left "
    "level line link links list main mobile module outer page panel placeholder post posts primary rail region right row section secondary site slot small sticky strip tab tabs text title top unit wrap wrapper zone".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_RAW = re.compile(r"<!--|<(script|style)(?=[\s/>])", re.I)
_OPEN = re.compile(r"<[A-Za-z/!?]")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def settled(html: str) -> str:
    """The page without comments, contents of scripts and styles, and a tag that the page's end cuts off.

    A comment, script or style that never ends reaches to the end of the page. After this no
    construct is unfinished, so the parser looks at every part of the page once.
    """
    parts, at = [], 0
    while m := _RAW.search(html, at):
        parts.append(html[at : m.start()])
        if m.group(1):
            end = re.compile("</" + m.group(1) + r"(?=[\s/>])", re.I).search(html, m.end())
            close = html.find(">", end.end()) if end else -1
        else:
            # A comment may also end at once: <!--> and <!--->.
            close = m.end() + len(e.group()) - 1 if (e := re.compile("-?>").match(html, m.end())) else html.find("-->", m.end())
            close += 2 * (close >= 0 and not e)
        if close < 0:
            return _uncut("".join(parts))
        parts.append(" " if m.group(1) else "")
        at = close + 1
    return _uncut("".join(parts) + html[at:])


def _uncut(html: str) -> str:
    cut = _OPEN.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def _marked(attrs: list) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for one in (value or "").lower().split():
                words = [w for w in _SPLIT.split(one) if w and not w.isdigit()]
                if not MARKS.isdisjoint(words) and all(w in MARKS or w in BESIDE for w in words):
                    return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDING.search(value):
            return True
    return False


class LineEvents(HTMLParser):
    """Folds parser events into lines: text, tags in it, share of link text, and the article they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # name, whether dropped from here on, article
        self.drop, self.article, self.articles = False, 0, 0
        self.parts: list[str] = []
        self.tags, self.links = 0, 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.anchor = 0
        # Open elements by name: in all, and from the innermost container on; what isn't open needs no search.
        self.open: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]

    def updatepos(self, i: int, j: int) -> int:
        return j  # places in lines aren't asked for

    def parse_html_declaration(self, i: int) -> int:
        # What isn't a document type is a comment that ends at the first ">", marked sections too.
        return super().parse_html_declaration(i) if self.rawdata[i : i + 9].lower() == "<!doctype" else self.parse_bogus_comment(i)

    def _line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.links, self.article))
                self.tags, self.links = 0, 0
            self.parts = []

    def _to(self, depth: int) -> None:
        for name, _, _ in reversed(self.stack[depth:]):
            self.anchor -= name == "a"
            self.open[name] -= 1
            if name in CONTAINERS:
                self.scopes.pop()
            else:
                self.scopes[-1][name] -= 1
        del self.stack[depth:]
        self.drop, self.article = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, 0)

    def _close(self, names: set) -> None:
        if not any(self.scopes[-1][n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                self._to(k)
                return
            if self.stack[k][0] in CONTAINERS:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self._line()
            elif tag in ("br", "wbr", "img") and not self.drop:
                self.parts.append(" " if tag != "wbr" else "")
            return
        if tag in BLOCKS:
            self._line()
            self._close({"p"})
            if tag == "body":
                self._close({"head", "title"})
        if tag in CLOSES:
            self._close(CLOSES[tag])
        drop = self.drop or tag in DROPPED or tag == "header" and not self.article or tag not in ("html", "body", "article", "main") and bool(attrs) and _marked(attrs)
        if tag in ("article", "main") and not drop and not self.article:
            self.articles += 1
            self.article = self.articles
        self.drop = drop
        self.anchor += tag == "a"
        self.stack.append((tag, drop, self.article))
        self.open[tag] += 1
        if tag in CONTAINERS:
            self.scopes.append(Counter())
        self.scopes[-1][tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._line()
        if not (self.open[tag] if tag in BLOCKS or tag in DROPPED else self.scopes[-1][tag]):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._to(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.parts.append(data)
            if self.anchor:
                self.links += len(data)

    def finish(self) -> list[tuple[str, int, int, int]]:
        self.close()
        self._line()
        return self.lines


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends only the weights that fall on lines count."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def select(lines: list[tuple[str, int, int, int]], sigma: float, share: float) -> list[str]:
    """Text of the lines in content regions, in page order."""
    if not lines:
        return []
    ratio = np.array([(len(text) - min(links, len(text))) / max(1, tags) for text, tags, links, _ in lines])
    smoothed = smooth(ratio, sigma)
    content = smoothed >= share * smoothed.std()
    content &= smoothed > 0
    if any(line[3] for line in lines):
        article = np.array([line[3] for line in lines])
        chosen = {a for a in np.unique(article[content]) if a}
        if not chosen:  # all lines of the articles are links: the longest still is what the page is about
            chosen = {max(set(article[article > 0].tolist()), key=lambda a: sum(len(x[0]) for x in lines if x[3] == a))}
        content = np.isin(article, list(chosen))
    else:
        at = np.flatnonzero(content)
        for a, b in zip(at, at[1:]):  # a gap of two short lines, such as a heading, belongs to its region
            if b - a <= 3:
                content[a:b] = True
        content &= np.array([5 * links <= 4 * len(text) for text, _, links, _ in lines])  # lines of links alone are menus
    return [line[0] for line, keep in zip(lines, content) if keep]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> tuple[str, int, int]:
    """Main text, lines found, lines selected. Null and empty pages give an empty text."""
    if not html:
        return "", 0, 0
    parser = LineEvents()
    parser.feed(settled(html))
    lines = parser.finish()
    kept = select(lines, sigma, share)
    return "\n".join(kept), len(lines), len(kept)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """One row per page (schema ``SCHEMA``).

    Null or empty html gives an empty text, malformed html what its finished parts hold; null ids and urls stay null; repeated rows give
    repeated results; an empty table gives no rows. Other columns are not read. Whole pages
    are parsed, one at a time, so memory follows the longest page.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), sigma, share) for x in batch.column(2)]
            texts = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[html_col].cast("string")).mapInArrow(run, SCHEMA)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
