"""Main text of web pages by consensus of a host's pages.

First each page is parsed and its containers are scored by the text of their own paragraphs, less links; the best container votes,
with its generalised path (tags and classes from the root, digits dropped), for its page's host. Votes are summed in Spark
(map-side first, so a host with a third of all pages is one row a task), and each host's winning path is sent back to its
pages, which are parsed again and cut at that path. A page that lacks the winning path uses its own best container.

Boilerplate inside a container (menus, forms, asides, comments, adverts, notices, by tag, role or class) is left out. Blocks are joined by one
space, white space inside a block is one space. A null or empty html gives an empty text; a null url has the empty host; markup
that never closes is closed at the end. Pages of any length and depth are parsed whole, in time and memory that grow with their length. Rows that repeat a page_id are pages of their
own, and vote each. An empty table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, keep

# Kinds of HTML elements, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head script style noscript template nav header footer aside form iframe svg math canvas button select option textarea input label dialog menu object audio video map noembed noframes title".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address details summary fieldset center hgroup header footer nav aside form br".split())
CONTAINER = frozenset("body article main section div td center blockquote".split())
CLOSES_P = BLOCK - frozenset("html body br td th tr tbody thead tfoot caption li dt dd".split())
NAMED = re.compile(r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|advertising|banner|promo(?:tion|ted)?|sponsor(?:ed)?|side-?bar|rail|menu|nav(?:bar|igation)?|breadcrumbs?|header|masthead|footer|comments?|comment-?list|disqus|respon(?:d|ses)|discussion|replies|notice|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widget|toolbar|pagination|pager|copyright|disclaimer|skip-?link)(?:$|[-_ 0-9])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
GOOD = re.compile(r"(?:^|[-_ ])(?:article|post|story|entry|content|main|body|text)", re.IGNORECASE)
# Tags, comments and declarations; an attribute's quoted value may hold '>'.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BREAK = "\0"
#: Characters of all hosts' winning paths up to which they are broadcast; parts that a host's pages are dealt to beyond.
BROADCAST_CHARS, SALTS = 32_000_000, 32


class Node:
    """An element: tag, generalised step, whether it is boilerplate, its parent, the container around it, and its text runs and children in page order."""

    __slots__ = ("around", "boiler", "items", "parent", "step", "tag")

    def __init__(self, tag: str, step: str, parent, boiler: bool):
        self.tag, self.step, self.parent, self.boiler, self.items, self.around = tag, step, parent, boiler, [], None

    def path(self) -> str:
        """The steps from the root, made for the few nodes that need it: paths of all nodes would grow with the square of the depth."""
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def _step(tag: str, attributes: dict[str, str]) -> str:
    kinds = sorted({re.sub(r"\d+", "", c).strip("-_").lower() for c in attributes.get("class", "").split()} - {""})
    return tag + "".join("." + c for c in kinds)


def _boiler(tag: str, a: dict[str, str]) -> bool:
    if tag in DROP or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return tag not in ("html", "body", "article", "main") and bool(NAMED.search(a.get("class", "")) or NAMED.search(a.get("id", "")))


def parse(source: str) -> Node:
    root = Node("", "", None, False)
    at, pos, end = root, 0, len(source)
    opened: Counter[str] = Counter()  # tags of `at` and what lies around it

    def closed_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent

    while pos < end:
        m = MARKUP.search(source, pos)
        if m is None:
            at.items.append(source[pos:])
            break
        if m.start() > pos:
            at.items.append(source[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if not opened[tag]:  # nothing to close, however deep the page is
                continue
            node = at
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag closes nothing outside its block
                    node = root
                    break
                node = node.parent
            if node is not root:
                closed_to(node.parent)
            continue
        a = {k.lower(): _html.unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        if tag in CLOSES_P and opened["p"]:
            closed_to(_closed(at, root, ("p",), ("body", "article", "div", "section", "td", "li")))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            if any(opened[x] for x in same):
                closed_to(_closed(at, root, same, ("ul", "ol", "dl", "table", "select") if tag not in ("td", "th") else ("tr", "table")))
        node = Node(tag, _step(tag, a), at, _boiler(tag, a))
        at.items.append(node)
        if tag in RAW or tag in ("script", "style"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, pos)
            pos = close.end() if close else end
        elif tag not in VOID and (not rest.endswith("/") or tag in BLOCK):  # HTML knows no self-closing blocks
            at = node
            opened[tag] += 1
    return root


def _closed(at: Node, root: Node, tags: tuple[str, ...], bounds: tuple[str, ...]) -> Node:
    """The element that stays open once an open one of `tags` inside `bounds` is closed."""
    node = at
    while node is not root and node.tag not in bounds:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return at


class Score(NamedTuple):
    node: Node
    points: float


def text_of(top: Node) -> str:
    """The text below `top` without boilerplate: blocks joined by one space, character references decoded."""
    out: list[str] = []
    stack = [iter(top.items)]
    ends = [True]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                out.append(_html.unescape(x))
            elif not x.boiler:
                block = x.tag in BLOCK
                if block:
                    out.append(BREAK)
                stack.append(iter(x.items))
                ends.append(block)
                break
        else:
            stack.pop()
            if ends.pop():
                out.append(BREAK)
    return " ".join("".join(out).replace(BREAK, " ").split())


def containers(root: Node) -> list[Score]:
    """Containers with points: characters of text in blocks that are theirs or their children's, less what links hold."""
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    stack: list[tuple[Node, Node | None, bool, int]] = [(root, None, False, 0)]
    while stack:
        node, holder, link, depth = stack.pop()
        if node.tag in CONTAINER:
            nodes.setdefault(id(node), node)
            node.around, holder = holder, node
        link = link or node.tag == "a"
        for x in node.items:
            if isinstance(x, str):
                n = len(x.strip())
                if holder is not None and n:
                    gain = -n if link else n + 10 * x.count(",")
                    own, share = holder, 1.0
                    while own is not None and share > 0.2:  # half of it counts for the container around
                        if id(own) in nodes:
                            points[id(own)] = points.get(id(own), 0.0) + share * gain
                        own, share = own.around, share / 2
            elif not x.boiler:
                stack.append((x, holder, link, depth + 1))
    out = []
    for k, p in points.items():
        node = nodes[k]
        factor = 2.0 if node.tag in ("article", "main") else 1.3 if GOOD.search(node.step) else 0.8 if node.tag == "body" else 1.0
        out.append(Score(node, p * factor))
    return out


def best(root: Node) -> Score | None:
    found = [s for s in containers(root) if s.points > 0]
    return max(found, key=lambda s: s.points, default=None)


def vote(source: str | None) -> tuple[str, float] | None:
    """The generalised path of a page's best container and its points, damped so that no long page outvotes many."""
    got = best(parse(source)) if source else None
    return (got.node.path(), min(got.points, 2000.0) ** 0.5) if got else None


def extract(source: str | None, path: str | None) -> str:
    """The text at the host's winning path (all containers with it, in page order), or at the page's own best container."""
    if not source:
        return ""
    root = parse(source)
    found: list[Node] = []
    steps = path.split(">") if path else []
    stack = [(root, 0)] if steps else []
    while stack:  # only below nodes whose steps are the path's so far
        node, k = stack.pop()
        if node.step != steps[k]:
            continue
        if k + 1 == len(steps):
            if node.tag in CONTAINER:
                found.append(node)
        else:
            stack += [(x, k + 1) for x in reversed(node.items) if not isinstance(x, str) and not x.boiler]
    text = " ".join(t for t in map(text_of, found) if t)
    if not text:
        own = best(root)
        text = text_of(own.node if own else root)
    return text


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the largest sum of votes of each host; ties by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if got := vote(source):
                    votes[host, got[0]] = votes.get((host, got[0]), 0.0) + got[1]
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes]), pa.array([p for _, p in votes]), pa.array([round(1000 * v) for v in votes.values()], pa.int64())], ["host", "path", "points"])

    sums = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, points long").groupBy("host", "path").agg(F.sum("points").alias("points"))
    first = sums.groupBy("host").agg(F.max(F.struct(F.col("points"), F.col("path"))).alias("top"))
    return first.select("host", F.col("top.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from .common import small_batches

    small_batches(pages.sparkSession, 500)
    pages = pages.select("page_id", "url", "html")
    paths = keep(host_paths(pages), "host-paths")
    size = paths.agg(F.coalesce(F.sum(F.length("path") + F.length("host") + 64), F.lit(0)).alias("n")).head()["n"]
    pages = pages.withColumn("host", host_of(F.col("url")))
    if size <= BROADCAST_CHARS:
        joined = pages.join(F.broadcast(paths), "host", "left")
    else:  # a host may hold a third of all pages
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int"))
        joined = salted.join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path")

    def run(b: pa.RecordBatch) -> dict:
        texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return by_batch(joined, "page_id long, url string, text string, n_chars long", run, 500)


__all__ = ["best", "extract", "host_of", "host_paths", "main_text", "parse", "text_of", "vote"]
