"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams its events into lines, one for each block of the page. Each line has a text-to-tag
ratio, of its characters outside links; the ratios are smoothed by a Gaussian, and a two-way threshold clustering of the smoothed values
selects content lines. Clusters grow to neighbours in their region: the article around them if the page declares one, else what lies between
their lines, headings before them and what lies in the same container. What the markup itself declares to be a menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment has ratio 0 and is left out. A name that only speaks of the layout
declares nothing if its container holds the only article, or most of the selected text; nor does one that can be a subject of the article,
if most of what it holds is selected.

Results: one row for each input row, in any number. A null or empty html gives the empty text. Incomplete markup is
read as far as it goes. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names.
SKIPPED = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea",
    "iframe", "svg", "object", "dialog", "menu",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "title",
} | SKIPPED
CONTAINERS = {
    "html", "body", "article", "main", "section", "div", "header", "ul", "ol", "li", "dl", "table", "tbody", "thead", "tfoot", "tr", "td",
    "th", "blockquote", "figure", "details", "fieldset", "center",
} | SKIPPED
# Fixed value: words in class, id and role that declare something other than the article.
DECLARED = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bno)(?<!\bwith)(?<!\bwithout)[_-])(nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|"
    r"sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|comment|"
    r"comments|disqus|reply|replies|share|sharing|social|related|breadcrumb|breadcrumbs|login|signup|search|complementary|"
    r"contentinfo)(?=$|[\s_-])"
)
# Fixed value: of these, the names that wrappers of a whole page bear as well.
LAYOUT = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "banner", "ad", "ads", "social", "share",
    "sharing", "breadcrumb", "breadcrumbs", "search",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Fixed value: of these, the names that articles also use for what they write about.
TOPICS = {"navigation", "search", "share", "sharing", "social"}
_BROKEN_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")  # the page breaks off inside a tag
SIGMA = 2.0
NEAR = 0.4  # of the mean ratio of content lines


class _Lines(HTMLParser):
    """Collects (text, tags, container path, skipped) for each block of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.linked: list[int] = []  # characters inside links, for each line
        self.headings: list[bool] = []
        self.names: dict[int, str] = {0: ""}
        self.declared: dict[int, bool] = {}  # containers with a declared name; whether it is one of the layout only
        self.topics: set[int] = set()  # those inside an article with a name that may be its subject
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.parts: list[str] = []
        self.tags = self.in_links = 0
        self.link = self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, tuple(i for _, i, _ in self.open), self.open[-1][2]))
            self.linked.append(self.in_links)
            self.headings.append(self.heading)
            self.tags = 0
        self.parts.clear()
        self.in_links, self.link = 0, False  # an unclosed link ends with its block

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = tag in HEADINGS
        elif tag == "a":
            self.link = True
        elif tag in ("br", "wbr", "img", "input"):
            self.parts.append(" " if tag != "wbr" else "")
        self.tags += 1
        if tag in CONTAINERS:
            skip = self.open[-1][2] or tag in SKIPPED
            if not skip and tag not in ("html", "body"):
                inside = any(name in ("article", "main") for name, _, _ in self.open)
                skip = tag == "header" and not inside
                words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
                if tag not in ("article", "main") and words and (named := DECLARED.findall(words)):
                    self.declared[len(self.names)] = LAYOUT.issuperset(named)
                    if inside and TOPICS.issuperset(named):
                        self.topics.add(len(self.names))
            self.names[len(self.names)] = tag
            self.open.append((tag, len(self.names) - 1, skip))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in CONTAINERS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = False
        elif tag == "a":
            self.link = False
        self.tags += 1
        if tag in CONTAINERS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data) -> None:
        self.parts.append(data)
        if self.link:
            self.in_links += len("".join(data.split()))


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends only existing lines count."""
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    middle = slice(radius, radius + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters of values: the midpoint of their means, until it stays."""
    cut = float(values.mean())
    for _ in range(50):
        high, low = values[values >= cut], values[values < cut]
        if not len(high) or not len(low):
            break
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _kept_out(parser: _Lines, chosen: list[int], lines: list[int]) -> set[int]:
    """The containers that are left out by their names."""
    weight: dict[int, int] = {}
    for k in chosen:
        for node in parser.declared.keys() & parser.lines[k][2]:
            weight[node] = weight.get(node, 0) + len(parser.lines[k][0])
    total = sum(len(parser.lines[k][0]) for k in chosen)
    around: set[int] = set()  # declared containers that hold an article
    free = False
    for k in lines:
        path = parser.lines[k][2]
        inner = max((at for at, node in enumerate(path) if parser.names[node] in ("article", "main")), default=0)
        named = parser.declared.keys() & path[:inner]
        around |= named
        free |= inner > 0 and not named
    inside: dict[int, int] = {}
    for k in lines:
        for node in parser.declared.keys() & parser.lines[k][2]:
            inside[node] = inside.get(node, 0) + len(parser.lines[k][0])
    return {
        node for node, layout in parser.declared.items()
        if not (layout and not free and (2 * weight.get(node, 0) > total or node in around))
        and not (node in parser.topics and 2 * weight.get(node, 0) > inside.get(node, 0))
    }


def extract(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks, joined by an empty line."""
    parser, html = _Lines(), html or ""
    html = _BROKEN_TAG.sub("", html)
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    own = [k for k, line in enumerate(lines) if not line[3]]
    if not own:
        return ""
    density = np.array([
        0.0 if skipped else len(text) * _free_share(parser, k) / max(1, tags) for k, (text, tags, _, skipped) in enumerate(lines)
    ])
    if parser.declared:
        ratio = smooth(density, sigma)
        cut = threshold(ratio)
        out = _kept_out(parser, [k for k in own if min(ratio[k], density[k]) >= cut], own)
        for k in own:
            if not out.isdisjoint(lines[k][2]):
                density[k] = 0.0
        own = [k for k in own if out.isdisjoint(lines[k][2])]
        if not own:
            return ""
    ratio = smooth(density, sigma)
    cut = threshold(ratio)
    # The smoothed ratio finds clusters; a line of its own ratio below the cut only joins one as a neighbour. On pages of few
    # lines the smoothing levels them, so a line that is content by its own ratio need only come near the cut.
    alone = NEAR * density[density >= threshold(density)].mean()
    chosen = [k for k in own if density[k] >= cut <= ratio[k] or (density[k] >= alone and 2 * ratio[k] >= cut)] or [k for k in own if ratio[k] >= cut] or own
    kept = _grown(parser, chosen, own)
    return "\n\n".join(lines[k][0] for k in own if k in kept)


def _free_share(parser: _Lines, k: int) -> float:
    """The share of a line's characters outside links."""
    return 1 - min(1.0, parser.linked[k] / max(1, len(parser.lines[k][0].replace(" ", ""))))


def _article(parser: _Lines, k: int) -> int | None:
    return next((n for n in reversed(parser.lines[k][2]) if parser.names[n] in ("article", "main")), None)


def _grown(parser: _Lines, chosen: list[int], own: list[int]) -> set[int]:
    """The chosen lines with their neighbours inside the same region.

    An article's lines are one region, brought in whole by its first chosen line. Elsewhere a line joins if it lies between chosen
    lines of their container, if it is in the innermost container of one, or if it is a heading right before one; links do not join.
    """
    kept, paths = set(chosen), {k: parser.lines[k][2] for k in own}
    articles = {n for k in chosen if (n := _article(parser, k)) is not None}
    kept |= {k for k in own if _article(parser, k) in articles and articles}
    loose = [k for k in chosen if _article(parser, k) is None]
    place = {k: i for i, k in enumerate(own)}

    def text(k: int) -> bool:
        return _article(parser, k) is None and _free_share(parser, k) > 0.5

    def beside(k: int, other: int) -> bool:
        return paths[k][-1] in paths[other] and parser.names[paths[k][-1]] not in ("", "html", "body")

    for before, k, following in zip([None, *loose], loose, [*loose[1:], None]):
        first, last = (0 if before is None else place[before] + 1), (len(own) if following is None else place[following])
        headed = True
        for other in reversed(own[first : place[k]]):
            headed = headed and parser.headings[other]
            if text(other) and (headed or beside(k, other)):
                kept.add(other)
        shared = None if following is None else max(n for n in paths[k] if n in paths[following])
        for other in own[place[k] + 1 : last]:
            if text(other) and (shared in paths[other] or beside(k, other)):
                kept.add(other)
    return kept


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", sigma: float = SIGMA
) -> DataFrame:
    """Rows (id_column, url_column, text), one for each page."""
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h.as_py(), sigma) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string")
    return made.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text")
