"""Main text of web pages by consensus host paths.

First pass: in each page, text that is not in a boilerplate element scores for the containers
around it, less what is links, and the page proposes the generalised tag-class path of its
best container. Spark counts the proposals by host. Second pass: pages are read again with
their host's winning path; a page that has no element on that path uses its own best
container. Headings and paragraphs that stand beside the container, directly in an element
around it, belong to the text.

What an element is for is told by its tag, its role, and its class and id. A name that only
hints at boilerplate does not decide inside an article: there its links have to hold half of
its text.

Null and empty pages give an empty text. Broken markup is read leniently: unknown ends are
skipped, open elements end with the page. Pages are read in one pass whose time and memory
follow their length, however deep they nest and whatever is left open. Repeated rows give
repeated results, an empty table an empty one; columns of other names are not read. Ties of a
vote go to the higher score, then the greater path.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.ranks import attach
from kvspace.llm.store import cut
from kvspace.llm.text import extend

#: Hosts whose winning paths are broadcast (about 200 bytes each); with more hosts, they are joined.
MAX_HOSTS = 100_000
#: The least share of a page's score that the proposed container has; of an article or main element.
SHARE, MARKED_SHARE = 0.9, 0.5
#: Links in an element with a hinting name hold at least this share of its text if it is dropped inside an article.
LINKED = 0.5
#: An element whose name speaks of boilerplate among other words is content all the same if it holds this share of the page's text.
WHOLE = 0.8

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg canvas head dialog menu search title option xmp noframes".split())
CONTAINERS = frozenset("article main section div td body center".split())
FRAME = frozenset("h1 h2 h3 h4 h5 h6 p".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
# Words of class names and ids. The first are boilerplate wherever they are, the second hint at it, the third say nothing.
NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar sidebars cookie cookies consent gdpr notice notices notification notifications popup modal overlay"
    " newsletter subscribe subscription signup signin login share sharing social comment comments commentlist disqus respond toolbar"
    " pagination pager".split()
)
# Of these the first are no article's name even among other words; the second name articles too.
SURE = frozenset("comment comments commentlist disqus sidebar sidebars cookie cookies gdpr advert adverts advertisement advertising adsbygoogle".split())
WEAK = frozenset("social notice notices login signin signup share sharing toolbar subscribe subscription promotion sponsor sponsors".split())
HINTS = frozenset(
    "header masthead topbar footer aside rail widget widgets banner banners related recommended recommendations reply replies form"
    " search copyright legal disclaimer skip paywall".split()
)
PLAIN = frozenset("a box boxes wrap wrapper container block section bar area inner outer top bottom left right main site page global list item items link links button buttons icon icons js group row col column unit slot panel content the of".split())
ENDS_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "p": ("p",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "button", "table")}

# every alternative goes on to the end of the page if its own end is missing, so no part of a page is read twice; a quote counts only after an equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I)


def _named(names: str) -> str:
    """"drop" if a name is made of boilerplate words (and words that say nothing), "weak" if articles may have it too,
    "sure" or "hint" if it has other words beside them."""
    found = set()
    for name in names.split():
        words = {w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w}
        rest = words - PLAIN
        if rest & NAMES and rest <= NAMES | HINTS:
            found.add("weak" if rest <= WEAK else "drop")
        elif rest & SURE:
            found.add("sure")
        elif rest & (NAMES | HINTS):
            found.add("hint")
    return next((k for k in ("drop", "weak", "sure", "hint") if k in found), "")


def _kind(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """What an element is by itself: "drop", "weak" (unless it holds the page's text), "hint" (if it is mostly links) or ""."""
    if tag in DROPPED:
        return "drop"
    if tag in ("html", "body", "article", "main"):
        return ""
    if tag == "header" and not in_article:
        return "drop"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return "drop"
    if attrs.get("role", "").lower() in ROLES:
        return "drop"
    named = _named(attrs.get("class", "") + " " + attrs.get("id", ""))
    if not named:
        return ""
    if tag in FRAME:
        return "hint"
    if tag not in BLOCK:
        return "" if named == "hint" and in_article else "drop"
    if in_article:
        return {"sure": "drop"}.get(named, named)
    return "drop" if named == "drop" else "weak"


@dataclass
class Page:
    """Blocks of text and the elements around them; lists of nodes are in page order, so parents come first."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    step: list[str] = field(default_factory=lambda: [""])
    kind: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def sums(self, of: list[float]) -> list[float]:
        """For each node, the sum over the blocks in it."""
        out = [0.0] * len(self.parent)
        for n, v in zip(self.node, of, strict=True):
            out[n] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def below(self, chosen: list[bool]) -> list[bool]:
        """Nodes that are chosen or in a chosen one."""
        out = list(chosen)
        for n in range(1, len(out)):
            out[n] = out[n] or out[self.parent[n]]
        return out

    def path(self, n: int) -> str:
        steps = []
        while n > 0:
            steps.append(self.step[n])
            n = self.parent[n]
        return "/".join(reversed(steps))

    def on_path(self, path: str) -> list[bool]:
        """Nodes whose path is ``path``."""
        steps = path.split("/")
        reached = [0] + [-1] * (len(self.parent) - 1)  # steps that lead to a node, if all agree
        for n in range(1, len(reached)):
            k = reached[self.parent[n]]
            if 0 <= k < len(steps) and steps[k] == self.step[n]:
                reached[n] = k + 1
        return [k == len(steps) for k in reached]


def parse(page: str) -> Page:
    """The page's blocks outside boilerplate."""
    out = Page()
    # of each open element: tag, node, whether it is dropped, node of the block around it, in an article, in a link
    stack: list[tuple[str, int, bool, int, bool, bool]] = [("", 0, False, 0, False, False)]
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    run: list[str] = []
    where = links = 0

    def flush() -> None:
        nonlocal links
        if run:
            text = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
            if text:
                out.text.append(text)
                out.node.append(where)
                out.linked.append(min(links, len(text)))
            run.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal where, links
        if not run:
            where = stack[-1][3]
        run.append(text)
        if stack[-1][5]:
            links += len(text)

    def last(tags) -> int:
        return max((open_at[x][-1] for x in tags if open_at.get(x)), default=0)

    def close(k: int) -> None:
        # what lies inside a dropped element breaks no block around it
        if any(stack[i][0] in BLOCK and not stack[i - 1][2] for i in range(k, len(stack))):
            flush()
        while len(stack) > k:
            open_at[stack.pop()[0]].pop()

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not stack[-1][2]:
            add(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and not stack[-1][2]:
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            elif tag == "p" and not stack[-1][2]:
                flush()
            elif tag == "br" and not stack[-1][2]:
                add(" ")
            continue
        for x in (("p",) if tag in ENDS_P and tag != "p" else ()) + ((tag,) if tag in ENDS else ()):
            k = last(ENDS[x])
            if k > last(BARRIER.get(x, ())):
                close(k)
        if tag == "br":
            if not stack[-1][2]:
                add(" ")
            continue
        if tag in BLOCK and not stack[-1][2]:
            flush()
        if tag in VOID:
            continue
        _, node, above, block, in_article, in_link = stack[-1]
        kind = "drop" if above else ""
        attrs: dict[str, str] = {}
        if not above:
            attrs = {a[0].lower(): _html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip(" /\n\t\r") else {}
            kind = _kind(tag, attrs, in_article)
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK and kind != "drop":
            out.parent.append(node)
            out.tag.append(tag)
            out.step.append(".".join([tag, *sorted({_DIGITS.sub("#", c).replace("/", ":") for c in attrs.get("class", "").lower().split()})]))
            out.kind.append(kind)
            node = block = len(out.parent) - 1
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, kind == "drop", block, in_article or tag in ("article", "main"), in_link or tag == "a"))
    flush()
    return _without_hints(out)


def _without_hints(page: Page) -> Page:
    """The page without elements of a hinting name that are mostly links, or of a weak one that don't hold the page's text."""
    if not any(page.kind):
        return page
    total, links = page.sums([float(len(x)) for x in page.text]), page.sums([float(x) for x in page.linked])
    mostly_links = [b >= LINKED * a for a, b in zip(total, links, strict=True)]
    gone = page.below([k == "hint" and m or k == "weak" and (m or a < WHOLE * total[0]) for k, m, a in zip(page.kind, mostly_links, total, strict=True)])
    kept = [k for k, n in enumerate(page.node) if not gone[n]]
    page.text, page.node, page.linked = ([x[k] for k in kept] for x in (page.text, page.node, page.linked))
    return page


def best_container(page: Page) -> tuple[int, float]:
    """(node, score): an article or main element with half of the page's score, else the deepest container with SHARE of it.

    A block scores by its length outside links, with a tenth more for each comma. Of nested
    articles the deepest with SHARE of the best one's score is taken.
    """
    if not page.text:
        return 0, 0.0
    score = page.sums([max(len(x) - y, 0) * (1 + x.count(",") / 10) + len(x) / 1000 for x, y in zip(page.text, page.linked, strict=True)])
    total = score[0]
    marked = [k for k in range(1, len(score)) if page.tag[k] in ("article", "main") and score[k] >= MARKED_SHARE * total]
    if marked:
        most = max(score[k] for k in marked)
        chosen = max(k for k in marked if score[k] >= SHARE * most)
        return chosen, score[chosen]
    chosen = 0
    for k in range(1, len(score)):
        if page.tag[k] in CONTAINERS and score[k] >= SHARE * total:
            chosen = k
    return chosen, score[chosen]


def propose(page: str | None) -> tuple[str, float]:
    read = parse(page or "")
    node, score = best_container(read)
    return read.path(node), score


def extract(page: str | None, path: str | None) -> str:
    """Text of the elements on the path, else of the page's own best container, with the headings and paragraphs beside it."""
    read = parse(page or "")
    if not read.text:
        return ""
    under = read.below(read.on_path(path)) if path else [False]
    tops = read.on_path(path) if path else []
    if not path or not any(under[n] for n in read.node):
        top, _ = best_container(read)
        tops = [k == top for k in range(len(read.parent))]
        under = read.below(tops)
    around = [False] * len(read.parent)
    for k, is_top in enumerate(tops):
        n = read.parent[k] if is_top and k else -1
        while n >= 0 and not around[n]:
            around[n] = True
            n = read.parent[n]
    beside = lambda n: read.tag[n] in FRAME and around[read.parent[n]]
    return "\n".join(x for x, n in zip(read.text, read.node, strict=True) if under[n] or beside(n))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most of the host's pages propose; ties go to the higher score, then the greater path."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        found = [propose(v) for v in part.column("html").to_pylist()]
        return [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    voted = extend(pages.select("host", "html"), "html", [t.StructField("path", t.StringType()), t.StructField("score", t.DoubleType())], make, keep=["host"])
    votes = voted.filter("score > 0").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.round("score")).alias("score"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("pages", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    winners = cut(host_paths(hosted))
    # every host gets a row, so that the rows of a large host can be dealt to parts
    if winners.count() <= max_hosts:
        joined = hosted.join(F.broadcast(winners), "host", "left")
    else:
        joined = attach(hosted, hosted.select("host").distinct().join(winners, "host", "left"), "host")

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        found = [extract(v, p) for v, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    made = [t.StructField("text", t.StringType()), t.StructField("n_chars", t.LongType())]
    return extend(joined.select("page_id", "url", "html", "path"), "html", made, make).select("page_id", "url", "text", "n_chars")
