"""Main text of web pages by consensus on container paths per host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import written

#: A path is kept for a host if it wins on at least one of so many of the host's pages: at most so many paths a host.
SHARE = 20
#: Winning paths are broadcast up to this many characters; beyond it the join is left to Spark.
BROADCAST_CHARS = 16 * 1024 * 1024

# Fixed values of HTML: elements without an end tag, with raw text, that begin a block, and that end an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")),
    "th": ("td", ("tr", "table")), "option": ("option", ("select",)),
}
#: Elements whose text is never main text, and the words in a class, id or role that mark such elements.
BESIDE = frozenset("nav footer aside form button select dialog menu svg object canvas audio video map head".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion social share sharing related "
    "recommended recommendations pagination pager copyright hidden complementary contentinfo search skip".split()
)
#: Of these words the ones that mark even an article or main element; and beginnings of a class that only tells of a neighbour.
FOREIGN = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies respond".split())
NEIGHBOUR = ("has-", "with-", "no-", "without-")
#: Words in a class or id that speak for main text.
MAIN = frozenset("article content post entry story main body text".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PARTS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
#: Steps of a path.
STEPS = 8


class Block(NamedTuple):
    """A run of main text between block borders, and where it stands."""

    text: str
    container: int
    link_chars: int


class Element(NamedTuple):
    steps: tuple[str, ...]
    parent: int
    good: bool

    @property
    def path(self) -> str:
        """The last steps from the root, so that deep pages have short paths."""
        return "/".join(self.steps)

    @property
    def tag(self) -> str:
        return self.steps[-1].split(".")[0] if self.steps else ""


def _marks(attributes: str, named_part: bool = False) -> tuple[set[str], str]:
    """The words in class, id and role, and the classes for the path, digits generalised.

    The id of a ``named_part``, a heading or a section of an article, is the title of a chapter as often
    as not: of its words only those count that mark even an article.
    """
    words, classes = set(), ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = html.unescape(a or b or c)
            for part in value.split():
                if not part.lower().startswith(NEIGHBOUR):
                    found = {p.lower() for p in _PARTS.findall(part)}
                    words |= found & FOREIGN if named_part and name == "id" else found
            if name == "class":
                classes = "".join("." + w for w in sorted(set(_DIGITS.sub("#", value).split())))
        elif name == "aria-hidden" and (a or b or c) == "true":
            words.add("hidden")
    if _HIDDEN.search(attributes):
        words.add("hidden")
    return words, classes


def read(page: str) -> tuple[list[Element], list[Block]]:
    """The containers of a page and its blocks of possible main text, in page order.

    Forms are no main text, unless a page has all of its text in one.
    """
    found = _read(page, BESIDE)
    return found if found[1] or "<form" not in page.lower() else _read(page, BESIDE - {"form"})


def _read(page: str, besides: frozenset[str]) -> tuple[list[Element], list[Block]]:
    elements = [Element((), -1, False)]
    blocks: list[Block] = []
    # Open elements: tag, container number, whether outside main text, in a link, in an article; and how many of each tag.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, stack[-1][1], min(linked, len(text))))
            pieces.clear()
            linked = 0

    def close(depth: int) -> None:
        if any(x[0] in BLOCK for x in stack[depth:]):
            flush()
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]

    def said(text: str) -> None:
        nonlocal linked
        _, _, beside, link, _ = stack[-1]
        if not beside:
            pieces.append(text)
            linked += len(text) if link else 0

    at, end = 0, len(page)
    while at < end:
        sign = _NEXT.search(page, at)
        if sign is None:
            said(page[at:])
            break
        if sign.start() > at:
            said(page[at : sign.start()])
        at = sign.start()
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[at + 1] in "!?":
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        tag = _TAG.match(page, at)
        if tag is None:
            said("<")
            at += 1
            continue
        at = tag.end()
        closing, name = tag[1] or tag[4], (tag[2] or tag[5]).lower()
        attributes = tag[3] or tag[6] or ""
        if closing:
            if opened[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            said(" ")
            continue
        if name in BLOCK and opened["p"] > 0:
            # A block ends an open paragraph, with what is open in it.
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in ("table", "button", "td", "div", "article")), 0)
            if depth and stack[depth][0] == "p":
                close(depth)
        if name in ENDS:
            _, until = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] == name or (name in ("td", "th") and stack[i][0] in ("td", "th")) or (name in ("dt", "dd") and stack[i][0] in ("dt", "dd")):
                    close(i)
                    break
        if name in VOID:
            if name == "hr":
                flush()
            continue
        _, container, beside, link, article = stack[-1]
        if name in BLOCK:
            flush()
            named_part = name in HEADING or (name == "section" and article)
            words, classes = _marks(attributes, named_part) if attributes.strip() else (set(), "")
            article = article or name in ("article", "main")
            beside = beside or name in besides or (name not in ("body", "html") and bool(words & (FOREIGN if name in ("article", "main") else MARKS)))
            beside = beside or ((name == "header" or "header" in words) and not article and name not in HEADING)
            if name not in ("p", *HEADING) and not beside:
                step = name if name in ("html", "body") else name + classes
                good = name in ("article", "main") or bool(words & MAIN)
                elements.append(Element((*elements[container].steps, step)[-STEPS:], container, good))
                container = len(elements) - 1
        else:
            beside = beside or name in besides or (name != "a" and attributes != "" and bool(_marks(attributes)[0] & MARKS))
            link = link or name == "a"
        if not attributes.rstrip().endswith("/"):
            stack.append((name, container, beside, link, article))
            opened[name] += 1
    close(1)
    flush()
    return elements, blocks


def scores(elements: list[Element], blocks: list[Block]) -> list[float]:
    """How much text stands in each container itself, with half of that in the containers inside it."""
    total = [0.0] * len(elements)
    for block in blocks:
        size = len(block.text)
        total[block.container] += size * (1 - block.link_chars / size) ** 2 + min(size, 20) / 20
    for at in range(len(elements) - 1, 0, -1):  # parents come before their children
        if elements[at].good:
            total[at] *= 1.25
        total[elements[at].parent] += total[at] / 2
    return total


def best(elements: list[Element], blocks: list[Block]) -> tuple[int, float]:
    """The container of the main text and the score it is chosen by.

    The container with the highest score, the first of equals; then the outermost
    article around it, or the outermost main without one, or else the parent of
    several sections of which it is one; or else the outermost container around it that is named
    as main text and adds more text than links, such as a post with its title and lead around the body.
    """
    total = scores(elements, blocks)
    at = max(range(len(total)), key=lambda i: (total[i], -i))
    score = total[at]
    around = [at]
    while elements[around[-1]].parent > 0:
        around.append(elements[around[-1]].parent)
    for kind in ("article", "main"):
        whole = [i for i in around if elements[i].tag == kind]
        if whole:
            return whole[-1], score
    if elements[at].tag == "section":
        # Sections of one parent are parts of one text.
        parent = elements[at].parent
        parts = [i for i, e in enumerate(elements) if e.parent == parent and e.tag == "section" and total[i] > 0]
        at = parent if len(parts) > 1 else at
    named = [i for i in around if elements[i].good and elements[i].tag not in ("body", "html") and i < at]
    if named:
        text, links = [0] * len(elements), [0] * len(elements)
        for block in blocks:
            text[block.container] += len(block.text)
            links[block.container] += block.link_chars
        for i in range(len(elements) - 1, 0, -1):
            text[elements[i].parent] += text[i]
            links[elements[i].parent] += links[i]
        at = next((i for i in reversed(named) if 2 * (links[i] - links[at]) <= text[i] - text[at]), at)
    return at, score


def best_path(page: str) -> tuple[str, float]:
    """The path of the page's container of main text, and its score."""
    elements, blocks = read(page)
    at, score = best(elements, blocks)
    return elements[at].path, score


def extract_text(page: str, winning: list[str]) -> tuple[str, str]:
    """The blocks inside the containers on the first winning path that the page has, and that path.

    A page without any winning path is taken by its own best container.
    """
    elements, blocks = read(page)
    paths = {e.path for e in elements}
    path = next((w for w in winning if w in paths), None)
    if path is None or not blocks:
        path = elements[best(elements, blocks)[0]].path
    inside = [False] * len(elements)
    for at, element in enumerate(elements):
        inside[at] = element.path == path or (element.parent >= 0 and inside[element.parent])
    return "\n".join(b.text for b in blocks if inside[b.container]), path


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without www.; empty without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the container paths that win on a share of a host's pages, most wins first."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(x.as_py() or "") for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["host"], pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["host", "path", "score"]
            )

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, score double")
    counted = votes.filter("score > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("wins"))
    counted = written(counted, "path-votes")
    hosts = counted.groupBy("host").agg(F.sum("wins").alias("pages"))
    strong = counted.join(hosts, "host").filter(F.col("wins") * SHARE >= F.col("pages"))
    ranked = strong.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("wins")).alias("wins"), "path"))).alias("ranked"))
    return ranked.select("host", F.col("ranked.path").alias("paths"))


def extract(pages: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, path.

    Each page votes for its best container; per host the tag-class paths with the
    most votes win; then every page is read again along the winning paths. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    comments are left out; character references are decoded; white space inside a
    block is one space, blocks are joined by a line break.

    A null or empty page has the empty text and path. Pages without a host share
    the votes of the empty host. Repeated rows each get their row; other columns are ignored.
    """
    winners = written(winning_paths(pages), "paths")
    size = winners.agg(F.sum(F.length(F.array_join("paths", "")) + F.length("host"))).first()[0] or 0
    side = F.broadcast(winners) if size <= broadcast_chars else winners
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract_text(x.as_py() or "", w.as_py() or []) for x, w in zip(batch["html"], batch["paths"])]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], ["page_id", "url", "text", "path"]
            )

    return rows.select("page_id", "url", "html", "paths").mapInArrow(apply, f"page_id {kind}, url string, text string, path string")
