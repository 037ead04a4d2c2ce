"""Main text of web pages by text-to-tag ratios.

A streaming pass over the standard library's parser events cuts a page into
lines (one per block element). Each line's ratio of text (outside links) to tags
is smoothed with a Gaussian along the page, and two-means clustering sets the
threshold over which lines are content. The content lines' mass, added up the
element tree, selects the region: the ``article`` or ``main`` element with the
most of it (an article with its sibling articles, since a page can be a row of
them), or else the deepest container that still holds most of it. In the region,
containers that are mostly links and whose content lines hold under half of them go: menus that no name
marks. An article inside an article is what a reader wrote about it, by the HTML
standard, and goes unless it holds most of the outer one. All other blocks of the
region are the text, so short paragraphs beside long ones stay.

Blocks in elements for navigation, footers, asides, dialogs, scripts and the like
never count, nor do those with a class, id or role token that says so (a token
counts as a whole: of ``sidebar-left`` all parts are known, of ``social-theory``
not). A form is left out unless it holds half of the page's content, as where it
wraps the page.

Nulls and edge cases: a null or empty page has empty text; malformed and unclosed
declarations, comments and elements are skipped or closed by their container;
time is linear in a page's length however deep it is; null ids and repeated rows
stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed word lists of the HTML vocabulary and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption tr td th ul ol dl table".split())
CLOSES_P = BLOCKS - {"body", "html"}
NEVER = frozenset("script style head title noscript template iframe canvas select button textarea nav footer aside dialog menu".split())
INLINE = frozenset("p b i em strong span a u font".split())
UNWANTED = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices comment comments respond disqus sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer share sharing related reply replies feedback thread threads discussion responses newsletter subscribe popup modal login signup widget widgets social contentinfo complementary search toolbar masthead".split())
#: Parts that may stand beside an unwanted word in one token.
NEUTRAL = frozenset("left right top bottom main site page list box area bar block container wrapper wrap section inner outer item items links link global primary secondary header head body content the post entry article form thread reply unit slot zone col column row btn buttons icons media".split())
_PARTS, _SPACE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), re.compile(r"\s+")


def is_unwanted(names: str) -> bool:
    """Whether a token of class, id or role names a part that isn't the article."""
    for token in names.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        if any(x in UNWANTED for x in parts) and all(x in UNWANTED or x in NEUTRAL or x.isdigit() for x in parts):
            return True
    return False


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.bad = ["#"], [0], [False]
        self.stack, self.blocks = [0], [0]  # elements open, and the blocks but p among them, by depth
        self.depths: dict[str, list[int]] = {}
        self.lines: list[tuple[int, str, int, int]] = []  # element, text, characters in links, tags
        self.text: list[str] = []
        self.count = self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata[i : i + 9].lower() == "<!doctype":  # an internal subset ends with ]>
            end, subset = self.rawdata.find(">", i), self.rawdata.find("[", i)
            if 0 <= subset < end and (close := re.compile(r"\]\s*>").search(self.rawdata, subset)):
                return close.end()
        return super().parse_html_declaration(i)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((self.stack[-1], text, min(self.linked, len(text)), self.count))
            self.count = 0
        self.text, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.depths[self.tags[e]].pop()
        del self.stack[depth:], self.blocks[depth:]

    def deepest(self, *tags: str) -> int:
        return max((at[-1] for t in tags if (at := self.depths.get(t))), default=0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.count += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close("p", ("article", "section", "div", "main", "td", "body"))
        if tag == "li":
            self.close("li", ("ul", "ol", "menu"))
        own = tag in NEVER
        if not own and tag not in ("body", "html", "article", "main"):
            own = any(v and k in ("class", "id", "role") and is_unwanted(v) for k, v in attrs)
        if tag == "header" and not self.deepest("article"):
            own = True
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.bad.append(own or self.bad[self.stack[-1]])
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        self.blocks.append(self.blocks[-1] + (tag in BLOCKS and tag != "p"))

    def close(self, tag: str, within: tuple[str, ...]) -> None:
        depth = self.deepest(tag)
        if depth and depth > self.deepest(*within):
            self.pop_to(depth)

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag in BLOCKS:
            self.flush()
        depth = self.deepest(tag)
        if depth:
            inside = self.blocks[-1] - self.blocks[depth]  # blocks that opened after it
            if inside or tag in BLOCKS or self.deepest("p") > depth:
                self.flush()
            if inside and tag in INLINE:
                return  # an inline end tag doesn't close the blocks that opened inside
            self.pop_to(depth)

    def handle_data(self, data: str) -> None:
        if not self.bad[self.stack[-1]]:
            self.text.append(data)
            if self.depths.get("a"):
                self.linked += len(data)


def smooth(ratio: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    k = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    return np.convolve(np.pad(ratio, radius), k / k.sum(), "valid")


def threshold(even: np.ndarray, rounds: int = 20) -> float:
    """Two-means clustering of the smoothed ratios: the middle between the clusters."""
    low, high = float(even.min()), float(even.max())
    for _ in range(rounds):
        middle = (low + high) / 2
        over = even >= middle
        if over.all():
            return float(even.min())
        low, high = float(even[~over].mean()), float(even[over].mean())
    return (low + high) / 2


def content_lines(lines: list[tuple[int, str, int, int]]) -> np.ndarray:
    ratio = np.array([(len(t) - a) / max(1, c) for _, t, a, c in lines])
    even = smooth(ratio)
    return even >= threshold(even)


def _summed(own: np.ndarray, parents: list[int]) -> np.ndarray:
    """Each element's number with those of all elements in it."""
    out = own.copy()
    for e in range(len(out) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def _within(p: _Lines, roots: list[int]) -> np.ndarray:
    """Whether an element is one of ``roots`` or in one."""
    inside = np.zeros(len(p.tags), bool)
    inside[roots] = True
    for e in range(1, len(p.tags)):
        inside[e] |= inside[p.parents[e]]
    return inside


def main_text(html: str) -> str:
    p = _Lines()
    p.feed(html)
    if p.rawdata.startswith("<!"):  # a comment or declaration that never ends
        p.rawdata = ""
    HTMLParser.close(p)
    p.flush()
    if not p.lines:
        return ""
    n = len(p.tags)
    on = content_lines(p.lines)
    owner = np.array([x[0] for x in p.lines])
    size = np.array([len(x[1]) for x in p.lines], float)
    linked = np.array([x[2] for x in p.lines], float)
    mass = _summed(np.bincount(owner, size * on, n), p.parents)
    forms = [e for e, t in enumerate(p.tags) if t == "form" and 2 * mass[e] < mass[0]]
    out = _within(p, forms) if forms else np.zeros(n, bool)
    mass = _summed(np.bincount(owner, size * on * ~out[owner], n), p.parents)
    named = [e for e, t in enumerate(p.tags) if t in ("article", "main") and not p.bad[e] and mass[e] > 0]
    if named:
        most = max(mass[e] for e in named)
        region = max(e for e in named if mass[e] >= most)
        roots = [e for e, t in enumerate(p.tags) if t == "article" and not p.bad[e] and p.parents[e] == p.parents[region]] if p.tags[region] == "article" else [region]
    else:
        region, best = 0, {}
        for e in range(1, n):
            if p.parents[e] not in best or mass[e] > mass[best[p.parents[e]]]:
                best[p.parents[e]] = e
        while region in best and mass[best[region]] >= 0.8 * mass[region] > 0 and p.tags[best[region]] in BLOCKS - LEAVES:
            region = best[region]
        roots = [region]
    text, links = (_summed(np.bincount(owner, x, n), p.parents) for x in (size, linked))
    inside = _within(p, roots)
    menus = [e for e, t in enumerate(p.tags) if inside[e] and e not in roots and t in BLOCKS and 2 * mass[e] < text[e] and 2 * links[e] > text[e]]
    out |= _within(p, menus) if menus else False
    # the nearest article around each element
    around = [0] * n
    for e in range(1, n):
        above = p.parents[e]
        around[e] = above if p.tags[above] == "article" else around[above]
    inner = [e for e in range(1, n) if p.tags[e] == "article" and around[e] and e not in roots and 2 * mass[e] < mass[around[e]]]
    out |= _within(p, inner) if inner else False
    keep = inside & ~out
    return "\n".join(x[1] for x in p.lines if keep[x[0]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array([main_text(h) for h in part["html"].to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
