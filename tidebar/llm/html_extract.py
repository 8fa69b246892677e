"""Main text of web pages.

The standard library's parser streams events; block elements end a line. Each line has the
ratio of its text to its tags; ratios smoothed by a Gaussian fall into two clusters, and the
lines above the threshold between them are content. A region (an ``article`` or ``main``
element that isn't mostly links, else the innermost container with content lines) is taken
whole, so that short paragraphs between long ones stay, but for lines in elements that are
something else: menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts.

Names can mislead, so a mark by class, id or form is void where the element holds most of
the page's text outside links, and for an ``article`` or ``main`` below it where the page has none
without a mark. Names that never stand for a layout (``SURE``) are void only where no other text is left.

Null or empty html gives the empty string, as does a page without text. Pages are parsed whole, in
time proportional to their length. Malformed markup never fails: marked sections other than
CDATA end at the next ``>``, a tag or comment that never ends is text. Elements nested
deeper than ``DEEPEST`` count as parts of the one around them, as do marks beyond ``MARKS`` around one element.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 1.0
DEEPEST = 2000
MARKS = 64

#: Elements by role (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
OUTSIDE = set(
    "head nav footer aside form script style noscript template iframe svg button select "
    "textarea dialog menu object canvas audio video math".split()
)
REGIONS = {"article", "main"}
CONTAINERS = REGIONS | {"div", "section", "td", "body", "html"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|"
    r"breadcrumbs?|footer|masthead|topbar|cookies?|consent|notices?|notification|alert|gdpr|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|share|sharing|social|"
    r"related|recommended|recirc|comments?|commentlist|disqus|replies|respond|toolbar|pagination|"
    r"pager|widget|search|skip|legal|copyright|disclaimer)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words that mark an element even if it holds most of the page.
SURE = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|breadcrumbs?|cookies?|consent|gdpr|newsletter|"
    r"subscribe|subscription|paywall|related|recommended|recirc|comments?|commentlist|disqus|replies|"
    r"respond|pagination|pager|copyright)(?:$|[_-]|\d)",
    re.I,
)
#: Classes that say what a layout has, not what the element is.
MODIFIER = re.compile(r"(?:has|have|with|without|no|not)[_-]", re.I)
#: Words that may stand in an id beside one of a kind; others make it the anchor of a heading.
GENERIC = set(
    "left right top bottom main site page primary secondary global header inner outer wrap wrapper "
    "container box block area section content list item items posts post articles article stories links "
    "link bar panel column col region module group form thread feed row unit slot text message the".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
         "alert", "alertdialog", "menu", "menubar", "toolbar"}


def named(tag: str, name: str, value: str, region: bool) -> tuple[bool, bool]:
    """Whether a class or id marks its element as something else, and surely so."""
    if name == "id" and tag in HEADINGS:
        return False, False
    tokens = [t for t in value.split() if NAMED.search(t) and not MODIFIER.match(t)]
    if name == "id":
        words = [re.split(r"[_-]+", t.strip("_-").lower()) for t in tokens]
        tokens = [t for t, w in zip(tokens, words)
                  if all(NAMED.search(x) or x in GENERIC or x.isdigit() for x in w)]
    sure = any(SURE.search(t) for t in tokens)
    return (sure if name == "id" and region else bool(tokens)), sure


class Lines(HTMLParser):
    """Lines of a page: (text, tags, characters in links, container, in region, outside, marks, inherited).

    ``marks`` are places in ``sure``: elements around the line that are named as something else,
    the first ``inherited`` of them around its outermost region.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []
        self.text: list[str] = []
        self.tags = self.linked = self.ids = 0
        self.sure: list[bool] = []
        self.open: Counter = Counter()
        self.deeper = 0
        self.endless = False
        # tag, outside, container, in region, in link, marks, inherited
        self.stack = [("", False, 0, False, False, (), 0)]

    def parse_html_declaration(self, i):
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        found = self.rawdata.find(end, i)
        return -1 if found < 0 else found + len(end)

    def parse_comment(self, i, report=1):
        # Once the end of a comment was searched in vain, later ones have none either.
        if self.endless and not self.rawdata.startswith(("<!-->", "<!--->"), i):
            return -1
        found = super().parse_comment(i, report)
        self.endless = self.endless or found < 0
        return found

    def flush(self):
        text = " ".join("".join(self.text).split())
        _, outside, container, region, _, marks, inherited = self.stack[-1]
        if text or self.tags:
            self.found.append((text, self.tags, self.linked, container, region, outside, marks, inherited))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE and tag != "br":
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.leave({tag}, CONTAINERS - {tag} | {"ul", "ol", "dl", "table", "blockquote"})
        _, outside, container, region, link, marks, inherited = self.stack[-1]
        if tag in CONTAINERS:
            self.ids += 1
            if not region or tag in REGIONS:
                container = self.ids
        inside = tag in REGIONS or region
        if tag in REGIONS and not region:
            inherited = len(marks)
        if not outside and tag not in ("html", "body"):
            outside = tag in OUTSIDE and tag != "form" or tag == "header" and not region
            marked, sure = tag == "form", False
            for name, value in attrs:
                if name in ("class", "id") and value and tag not in REGIONS:
                    found = named(tag, name, value, region)
                    marked, sure = marked or found[0], sure or found[1]
                elif name == "role" and value:
                    marked = marked or value.lower() in ("form", "search")
                    outside = outside or value.lower() in ROLES - {"form", "search"}
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    outside = True
            if marked and len(marks) < MARKS:
                marks = (*marks, len(self.sure))
                self.sure.append(sure)
        if len(self.stack) > DEEPEST:
            self.deeper += 1
            return
        self.open[tag] += 1
        self.stack.append((tag, outside, container, inside, link or tag == "a", marks, inherited))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def leave(self, names: set[str], stop: set[str]) -> None:
        """Ends the innermost open element of ``names``, if no element of ``stop`` lies between."""
        if not any(self.open[name] for name in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                self.open.subtract(x[0] for x in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE and tag != "br":
            self.flush()
        self.tags += 1
        if tag not in VOID and self.deeper:
            self.deeper -= 1
        elif tag not in VOID:
            self.leave({tag}, set() if tag in CONTAINERS | OUTSIDE else CONTAINERS)

    def handle_data(self, data):
        self.text.append(data)
        if self.stack[-1][4]:
            self.linked += len(data)


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of ``values`` (two means)."""
    low, high = values.min(), values.max()
    for _ in range(30):
        border = (low + high) / 2
        above = values > border
        if not above.any() or above.all():
            break
        new = values[~above].mean(), values[above].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach), kernel / kernel.sum(), "valid")


def inside(lines: list[tuple], sure: list[bool]) -> list[int]:
    """Places of the lines with text that aren't in something else."""
    some = [i for i, x in enumerate(lines) if x[0] and not x[5]]
    held, total = [0] * len(sure), 0
    for i in some:
        own = max(0, len(lines[i][0]) - lines[i][2])
        total += own
        for m in lines[i][6]:
            held[m] += own
    holds = [not sure[m] and 2 * held[m] > total for m in range(len(sure))]
    marked = {i: [m for m in lines[i][6] if not holds[m]] for i in some}
    if not any(lines[i][4] and not marked[i] for i in some):
        for i in some:
            if lines[i][4]:
                around = lines[i][6][: lines[i][7]]
                marked[i] = [m for m in marked[i] if sure[m] or m not in around]
    return [i for i in some if not marked[i]] or some


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    # No tag is complete behind the last ">", which spares the parser to look for its end each time.
    end = html.rfind(">") + 1
    parser.feed(html[:end])
    parser.close()
    if parser.cdata_elem is None:
        parser.handle_data(unescape(html[end:]))
    parser.flush()
    lines = parser.found
    if not lines:
        return ""
    ratios = smooth(np.array([len(x[0]) / max(1, x[1]) for x in lines]))
    content = ratios >= threshold(ratios)
    own = inside(lines, parser.sure)
    regional = [i for i in own if lines[i][4]]
    size: dict[int, int] = {}
    good: dict[int, int] = {}
    links: dict[int, int] = {}
    for i in regional or own:
        text, _, linked, container = lines[i][:4]
        size[container] = size.get(container, 0) + len(text)
        links[container] = links.get(container, 0) + linked
        if content[i]:
            good[container] = good.get(container, 0) + len(text) - (0 if regional else linked)
    if regional:
        chosen = set(good) | {c for c in size if 2 * links[c] <= size[c]} or {max(size, key=size.get)}
        return "\n\n".join(lines[i][0] for i in regional if lines[i][3] in chosen)
    chosen = {c for c, n in good.items() if 2 * n > size[c]}
    chosen = chosen or {c for c in size if size[c] == max(size.values())}
    return "\n\n".join(
        lines[i][0] for i in own if lines[i][3] in chosen and 2 * lines[i][2] <= len(lines[i][0]))


def extract(html: Column | str) -> Column:
    """Main text of an html column."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(html)
