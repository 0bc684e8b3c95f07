"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams its events once per page. They are cut
into lines, one for each block of text, with the number of tags that go with
it. The ratio of text to tags per line is smoothed with a Gaussian, and lines
above a threshold (the ratios' spread) form the content cluster. The cluster
votes for regions: the articles, if they hold most of it, or else the least
container that holds all of it. All lines of the chosen region are kept, short
ones too, except for those inside elements that are never article text, and
those marked as furniture by a name that the cluster does not favour.

Defined results: a null or empty page, and one without any text, gives an empty
text. Unclosed and misnested tags are repaired as far as blocks go. Character
references are decoded; white space inside a block becomes one space. Repeated
rows get a row each; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img svg math".split()
)
UNSEEN = frozenset(
    "script style template noscript head title iframe object canvas svg math textarea".split()
)
FURNITURE = frozenset(
    "nav header footer aside form menu dialog button select fieldset".split()
)
ARTICLE = frozenset(("article", "main"))
# Words that mark an element as furniture in its class, id or role.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager header "
    "masthead footer comment comments reply replies disqus respond related recommended share "
    "sharing social widget toolbar search login complementary contentinfo".split()
)
# A mark on these names a state of the page rather than a part of it.
WHOLE = frozenset(("html", "body", "article", "main"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RADIUS = 2


@dataclass
class Line:
    text: str
    tags: int
    path: tuple[int, ...]
    furniture: bool


@dataclass
class _Open:
    name: str
    key: int
    hidden: bool
    furniture: bool


@dataclass
class Blocks(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    lines: list[Line] = field(default_factory=list)
    kinds: dict[int, str] = field(default_factory=dict)
    # Elements with a mark; true where a whole name is made of such words.
    marks: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.tags = 0

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(o.key for o in self.stack if o.key)
            self.lines.append(
                Line(text, self.tags, path, bool(self.stack) and self.stack[-1].furniture)
            )
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._line()
        if tag in VOID:
            return
        if tag == "p" or tag == "li":
            self._close(tag, within=("ul", "ol", "menu", "div", "article", "section", "td"))
        if tag in ARTICLE:  # an element of furniture that was never closed ends here
            while self.stack and self.stack[-1].furniture:
                self.stack.pop()
        above = self.stack[-1] if self.stack else _Open("", 0, False, False)
        key, mark = 0, None if tag in WHOLE else _mark(attrs)
        if tag not in INLINE or mark is not None:
            key = len(self.kinds) + 1
            self.kinds[key] = tag
            if mark is not None:
                self.marks[key] = mark
        self.stack.append(
            _Open(
                tag,
                key,
                above.hidden or tag in UNSEEN or _hidden(attrs),
                above.furniture or tag in FURNITURE,
            )
        )

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section that the parser does not know is a comment up to
        the next angle bracket, as browsers have it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name == tag:
                self._line()
                del self.stack[i:]
                return
            if name in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self._line()
            self._close(tag)
        elif any(o.name == tag for o in self.stack[-8:]):
            # Inline elements never close a block around them.
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == tag:
                    del self.stack[i]
                    break

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1].hidden):
            self.parts.append(data)

    def finish(self) -> None:
        self.close()
        self._line()


def _hidden(attrs) -> bool:
    return any(
        name == "hidden"
        or (name == "aria-hidden" and value == "true")
        or (name == "style" and value and "display:none" in value.replace(" ", "").lower())
        for name, value in attrs
    )


def _mark(attrs) -> bool | None:
    """None without a mark, else whether some name consists of marks only."""
    found = None
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for token in (value or "").split():
                marks = [w.lower() in MARKS for w in _WORD.findall(token)]
                if any(marks):
                    found = bool(found) or all(marks)
    return found


def smoothed_ratios(lines: list[Line], radius: int = RADIUS) -> np.ndarray:
    """Text characters per tag of each line under a Gaussian window."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines], dtype=float)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(radius / 2, 1)) ** 2)
    total = np.convolve(ratio, weights, "full")[radius : radius + len(ratio)]
    share = np.convolve(np.ones_like(ratio), weights, "full")[radius : radius + len(ratio)]
    return total / share


def _cluster(lines: list[Line]) -> tuple[list[Line], dict[int, int]]:
    """The lines above the threshold, and their mass in each element."""
    ratios = smoothed_ratios(lines)
    inside = ratios >= min(float(np.std(ratios)), float(ratios.max()))
    cluster = [x for x, y in zip(lines, inside, strict=True) if y]
    return cluster, _mass(cluster)


def _mass(lines: list[Line]) -> dict[int, int]:
    mass: dict[int, int] = {}
    for line in lines:
        for key in line.path:
            mass[key] = mass.get(key, 0) + len(line.text)
    return mass


def _refused(blocks: Blocks, lines: list[Line]) -> set[int]:
    """Marked elements that the cluster does not favour. A name with other
    words in it counts for nothing if most of the element's text is in the
    cluster; a name of marks only, if most of the cluster is in the element and
    none in an article elsewhere."""
    cluster, mass = _cluster(lines)
    whole, total = sum(len(x.text) for x in cluster), _mass(lines)
    out = set()
    for key, plain in blocks.marks.items():
        if plain:
            elsewhere = (x for x in cluster if key not in x.path)
            favoured = 2 * mass.get(key, 0) > whole and not any(
                blocks.kinds[k] in ARTICLE for x in elsewhere for k in x.path
            )
        else:
            favoured = 2 * mass.get(key, 0) > total.get(key, 0)
        if not favoured:
            out.add(key)
    return out


def content_lines(blocks: Blocks) -> list[Line]:
    lines = [x for x in blocks.lines if not x.furniture]
    if lines and blocks.marks:
        refused = _refused(blocks, lines)
        lines = [x for x in lines if refused.isdisjoint(x.path)]
    if not lines:
        return []
    cluster, mass = _cluster(lines)
    whole = sum(len(x.text) for x in cluster)

    # Articles beside each other are one region, whatever their sizes.
    groups: dict[int, set[int]] = {}
    for line in lines:
        for above, key in zip((0, *line.path), line.path):
            if blocks.kinds[key] in ARTICLE:
                groups.setdefault(above, set()).add(key)
    weight = {above: sum(mass.get(k, 0) for k in keys) for above, keys in groups.items()}
    top = max(weight, key=lambda above: (weight[above], -above), default=None)
    if top is not None and 2 * weight[top] > whole:
        chosen = groups[top]
    else:
        # The deepest container that holds all of the cluster.
        holds = [k for k, m in mass.items() if m == whole and _container(blocks.kinds[k])]
        if not holds:
            return lines
        chosen = {max(holds)}
    return [x for x in lines if chosen.intersection(x.path)]


def _container(tag: str) -> bool:
    return tag in ("html", "body", "div", "section", "td", "table", "tbody", "tr", "center")


def main_text(html: str | None) -> str:
    blocks = Blocks()
    blocks.feed(html or "")
    blocks.finish()
    return " ".join(x.text for x in content_lines(blocks))


def extract_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for each page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.selectExpr("page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        extract, f"page_id {id_type}, url string, text string, n_chars bigint"
    )
