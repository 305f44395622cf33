"""HTML extraction by tag-path ratios.

The page is cut into blocks, each with its root-to-leaf path of block elements (names and classes). Per path, the number
of characters and of punctuation marks per block are its two ratios; both are smoothed over the blocks in page order
and fused. Paths whose ratio reaches a threshold of the page's own spread and level are content.

Names and classes of menus, headers, footers, sidebars, notices, adverts, forms and reader comments are evidence: blocks
in such elements are left out as long as the others hold LEFT of the page's text, or an article; else the names say
nothing, as on a page that is one form, and the blocks in one such element count like the others.

The article is the smallest element that holds nearly all content text (an article or main element: half of it), and
what else it holds, headings and short items too, but for elements with such names and for paths that are mostly links.
Outside it only a title of the first order counts, unless the article has its own element. Only scripts, styles, hidden elements, media and inline elements with such names are left out beforehand.

Everything takes time in proportion to the page, whatever its nesting.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

LEFT, FACTOR, LEVEL = 0.02, 0.5, 0.15
LINKS = 0.5  # share of a path's characters in links from which it counts as a menu
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)|<!--|<[!?]")
#: The rest of a tag. Quotes count only where a value begins, so a stray one doesn't swallow what follows.
TAG_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
MEDIA = {"svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "label", "datalist"} | MEDIA
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr", "picture", "map"} | MEDIA
#: An open element that the key closes, and the elements beyond which it doesn't.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
OTHERS = set(), {"button", "td", "th", "table"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOMES = {"article", "main"}
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|related|replies|responses|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])", re.I)
#: Class tokens with such a part tell of a page's layout or state, not of what the element is: has-sidebar, menu-open.
STATES = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|not|is|open|opened|close|closed|enabled?|disabled?|active|inactive|visible|show|shown|hide|layout|expanded|collapsed)(?=$|[_-])", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟¿¡]")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "form", "dialog", "alert"}


def boilerplate(name: str, attributes: str, at_home: bool = False) -> bool:
    """Whether an element's name or attributes tell that it is no content. at_home: in an article or main element, whose header is its own."""
    if name in LEFT_OUT and not (at_home and name == "header"):
        return True
    if "=" not in attributes and "hidden" not in attributes or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value, key = value.strip("\"'").lower(), key.lower()
        if key in ("class", "id") and any(BOILERPLATE.search(t) and not STATES.search(t) for t in value.split()) or key == "role" and value in ROLES or hides(key, value):
            return True
    return False


def hides(key: str, value: str) -> bool:
    return key == "hidden" or key == "aria-hidden" and value == "true"


def hidden(attributes: str) -> bool:
    return "hidden" in attributes and any(hides(k.lower(), v.strip("\"'").lower()) for k, v in ATTRIBUTE.findall(attributes))


@dataclass
class Block:
    said: str
    links: int  # characters of it in links, before white space is joined
    path: int
    element: int
    named: int  # elements around it whose names tell of no content


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])  # of each block element, in page order; 0 is the page
    name: list[str] = field(default_factory=lambda: [""])
    named: list[int] = field(default_factory=lambda: [0])


class Reader:
    """Reads a page's tags into blocks. The stack has block elements, and inline ones that are left out with those in them."""

    def __init__(self) -> None:
        self.page = Page()
        self.paths: dict[tuple[int, str, str], int] = {}
        self.stack: list[tuple[str, int, int, bool, int]] = []  # name, element, path, left out, 1 for boilerplate by name
        self.open: dict[str, list[int]] = defaultdict(list)  # places on the stack by name; "" for all inline ones
        self.text: list[str] = []
        self.dark = self.named = self.links = self.linked = 0

    def top(self) -> tuple[int, int]:
        """(element, path) of the innermost block element."""
        return self.stack[-1][1:3] if self.stack else (0, 0)

    def end_block(self) -> None:
        if self.text:
            said = " ".join(html.unescape("".join(self.text)).split())
            if said:
                element, path = self.top()
                self.page.blocks.append(Block(said, self.linked, path, element, self.named))
            self.text.clear()
        self.linked = 0

    def push(self, name: str, left_out: bool, named: bool, attributes: str = "") -> None:
        element, path = self.top()
        if name in INLINE:
            self.open[""].append(len(self.stack))
        else:
            path = self.paths.setdefault((path, name, attributes), len(self.paths) + 1)
            self.page.parent.append(element)
            self.page.name.append(name)
            self.page.named.append(self.named + named)
            element = len(self.page.name) - 1
        self.open[name].append(len(self.stack))
        self.stack.append((name, element, path, left_out, named))
        self.dark += left_out
        self.named += named

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, _, _, left_out, named = self.stack.pop()
            self.open[name].pop()
            if name in INLINE:
                self.open[""].pop()
            self.dark -= left_out
            self.named -= named

    def say(self, piece: str) -> None:
        if piece and not self.dark:
            self.text.append(piece)
            if self.links:
                self.linked += len(piece)

    def last(self, name: str) -> int:
        """The place of the innermost open element of that name, or -1."""
        return self.open[name][-1] if self.open[name] else -1

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name not in INLINE:
            self.end_block()
        if (k := self.last(name)) >= 0:
            self.pop(k)

    def start(self, name: str, attributes: str) -> None:
        empty = name in VOID or attributes.rstrip().endswith("/")
        if name in INLINE:
            if name == "a":
                if (k := self.last("a")) >= 0:  # links don't nest: the next one ends it
                    self.pop(k)
                self.links = 1
            left_out = boilerplate(name, attributes)
            if (left_out or self.open[""]) and not empty:
                self.push(name, left_out, False)
            return
        self.end_block()
        if name in VOID:
            return
        closes, beyond = CLOSES.get(name, OTHERS)
        wall = max(map(self.last, ("", *beyond)))
        inner = [own[k] for x in (*closes, "p") if (k := bisect_right(own := self.open[x], wall)) < len(own)]
        self.pop(min(inner, default=len(self.stack)))
        self.push(name, hidden(attributes), boilerplate(name, attributes, any(map(self.open.get, HOMES))), classes(attributes))


def classes(attributes: str) -> str:
    return " ".join(v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes) if k.lower() == "class") if "class" in attributes else ""


def read_page(page: str) -> Page:
    """The page's blocks in order, with single spaces, and its block elements."""
    reader, at = Reader(), 0
    raw: dict[str, re.Pattern] = {}
    while m := TAG.search(page, at):
        reader.say(page[at : m.start()])
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            end = page.find("-->" if m[0] == "<!--" else ">", at)
            at = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        rest = TAG_REST.match(page, at)
        end = rest.end() if rest else page.find(">", at) + 1
        if not end:  # no tag ends after this: all of it is text
            at = m.start()
            break
        attributes, at = rest[1] if rest else page[at : end - 1], end
        if m[0][1] == "/":
            reader.close(name)
        elif name in RAW:
            if name not in INLINE:
                reader.end_block()
            if not attributes.rstrip().endswith("/"):
                ends = raw.setdefault(name, re.compile(rf"</{name}\s*+>", re.I)).search(page, at)
                at = ends.end() if ends else len(page)
        else:
            reader.start(name, attributes)
    reader.say(page[at:])
    reader.end_block()
    return reader.page


def smooth(values: list[float]) -> list[float]:
    """Each value with half of its neighbours' in page order."""
    before, after = [values[0], *values[:-1]], [*values[1:], values[-1]]
    return [0.25 * a + 0.5 * x + 0.25 * b for a, x, b in zip(before, values, after, strict=True)]


def path_ratios(blocks: list[Block]) -> tuple[dict[int, float], float]:
    """(smoothed and fused ratio of each path, threshold)."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in blocks:
        chars[x.path] += len(x.said)
        marks[x.path] += len(PUNCTUATION.findall(x.said))
        count[x.path] += 1
    by_chars = smooth([chars[x.path] / count[x.path] for x in blocks])
    by_marks = smooth([marks[x.path] / count[x.path] for x in blocks])
    most = max(by_marks) or 1
    fused = defaultdict(float)
    for x, c, m in zip(blocks, by_chars, by_marks, strict=True):
        fused[x.path] += c * (0.5 + m / most)
    ratio = {p: f / count[p] for p, f in fused.items()}
    n = len(blocks)
    mean = sum(ratio[x.path] for x in blocks) / n
    spread = math.sqrt(sum((ratio[x.path] - mean) ** 2 for x in blocks) / n)
    level = sum(ratio[p] * chars[p] for p in ratio) / sum(chars.values())
    return ratio, max(FACTOR * spread, LEVEL * level)


def home_of(page: Page, kept: list[Block]) -> int:
    """The element that is the article: the smallest that holds nine tenths of the kept text, or an article or main element with half of it."""
    held = [0] * len(page.parent)
    for x in kept:
        held[x.element] += len(x.said)
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    named = [k for k, h in enumerate(held) if page.name[k] in HOMES and 2 * h >= held[0]]
    return max(named or [k for k, h in enumerate(held) if 10 * h >= 9 * held[0] and page.name[k] not in ("p", "pre", "li", "td", "tr", "ul", "ol", *HEADS)])


def within(page: Page, found: Callable[[int], bool]) -> list[bool]:
    """For each element whether it or one around it is found."""
    out: list[bool] = []
    for k, above in enumerate(page.parent):
        out.append(found(k) or k > 0 and out[above])
    return out


def unnamed(page: Page) -> list[Block]:
    """The blocks in the fewest elements with names that tell of no content, so few that they hold LEFT of the text or are in an article."""
    article = within(page, lambda k: page.name[k] in HOMES)
    total, held = sum(len(x.said) for x in page.blocks), 0
    for level in sorted({x.named for x in page.blocks}):
        own = [x for x in page.blocks if x.named == level]
        held += sum(len(x.said) for x in own)
        if held >= LEFT * total or any(article[x.element] for x in own):
            break
    return [x for x in page.blocks if x.named <= level]


def content(page: Page) -> list[Block]:
    """The blocks of content paths, and what else the article holds."""
    blocks = unnamed(page)
    ratio, least = path_ratios(blocks)
    kept = [x for x in blocks if ratio[x.path] >= least]
    home = home_of(page, kept)
    inside = within(page, lambda k: k == home)
    links, chars = defaultdict(int), defaultdict(int)
    for x in blocks:
        links[x.path] += x.links
        chars[x.path] += len(x.said)
    out = []
    for x in blocks:
        name = page.name[x.element]
        own = x.named <= page.named[home] and (links[x.path] <= LINKS * chars[x.path] or name in HEADS)
        title = name == "h1" and not x.links and page.name[home] not in HOMES
        if inside[x.element] and (own or ratio[x.path] >= least) or title:
            out.append(x)
    return out


def main_text(page: str | None) -> str:
    """The content blocks, joined by a space."""
    read = read_page(page or "")
    return " ".join(x.said for x in content(read)) if read.blocks else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points), from the whole html.

    Null or empty html, and pages without content, give an empty text. A header element is left out, but not an
    article's or main element's own. A tag that doesn't end before the page does is text. Character references are decoded, white space
    within a block is one space, blocks are joined by one space in page order. Repeated rows give repeated rows; an
    empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))).mapInArrow(run, SCHEMA)
