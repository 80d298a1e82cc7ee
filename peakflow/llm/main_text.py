r"""Main text of web pages by line-block distribution.

A page becomes lines, one for each block of text, with empty lines where
containers begin and end. A line counts with the length of its text, or with
nothing if most of it is links. Lengths are summed over sliding windows of
lines. Where the sum rises above zero a region surges, where it falls back to
zero it dives; a region is content if its greatest sum reaches ``SHARE`` of the
page's greatest. The text between a surge and its dive is kept.

What elements are called only weighs. Each element whose class or id names a
part that is no content, each ``header`` outside an article and each form is one
level of doubt for the lines in it. The level that is read is the one whose
greatest window sum, times ``DOUBT`` for each level, is greatest; lines of more
doubt count nothing. So a wrapper with such a name loses nothing, and a sidebar
in it is still one. A form that holds a ``main`` or ``article`` or most of the
page's text is no doubt. Lines under a heading such as ``3 comments`` are one
level of doubt more. Text in ``nav``, ``aside``, ``footer``, ``menu``,
``dialog``, in roles that say the same, in controls and in hidden elements is
never read.

Regions show where the content is; its short lines are then taken whole. The
content's element is the deepest that holds ``MOST`` of the regions' text,
widened while what a parent adds is regions too. All lines of it that are not
links and of no more doubt are kept, as are those of sections right before and
after. Where ``main`` or ``article`` elements are marked, their windows weigh
``MARKED`` times; if the greatest is theirs, their text is one region each,
lists of links count in it, and what is outside is left.

White space inside a block becomes one space; blocks are joined by an empty
line; character references are decoded, also those without a semicolon.

Defined cases: null and empty pages, and pages without text, give the empty
string; a page cut off anywhere gives what it holds so far, a tag cut off is
markup; repeated rows are read one by one; text without markup is one block;
comments of readers that neither names nor a heading tell from the article are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; the share of the page's greatest window sum that a region of content reaches.
WINDOW = 3
SHARE = 0.3
#: What a level of doubt leaves of a window's weight, and the window sum that a level above none needs at least.
DOUBT, LEAST = 0.2, 80
#: Weight of windows in marked elements; share of the regions' text that the content's element holds.
MARKED, MOST = 3, 0.75
#: Empty lines where a container begins or ends: between two containers no window reaches over.
APART = 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|title|select|math|canvas)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset("address blockquote body center dd dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li ol p pre table tbody tfoot thead tr ul caption summary legend option".split())
CONTAINERS = frozenset("article aside details dialog div fieldset footer form header main menu nav section table ul ol dl body".split())
CONTENT = ("main", "article")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
WRAPPERS = ("form", "fieldset")
PAGE = ("", "html", "body")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and roles whose text is never read.
NEVER_TAGS = frozenset("nav aside footer menu dialog button label input".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words that name parts which are no content, and beginnings of such words; the second set only outside an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer comment comments disqus reply replies share sharing social related recommended recommendations newsletter subscribe subscription login signup pagination pager toolbar widget widgets skip".split()
)
STARTS = ("comment", "sidebar", "advert", "adslot", "adbox", "adunit", "cookie", "sponsor", "newsletter", "breadcrumb", "navbar", "pagination", "respond", "disqus")
OUTSIDE = frozenset("header masthead topbar".split())
#: Words that may stand beside one of those in a name: any other word makes it the name of something else.
BESIDE = frozenset(
    "site page post posts article articles entry story stories main global top bottom left right upper lower inner outer primary secondary first last box block blocks wrapper wrap container content list item items section area bar row "
    "col column group holder panel mobile desktop fixed sticky button buttons icons link links form text title head body user reader readers thread new more region module unit slot zone center side media policy law up".split()
)
#: Headings over comments of readers, in the languages of the pages; with a number or a request they are nothing else.
_COMMENTS = re.compile(r"(?:(?P<sure>\(?[0-9]+\)? )?(?:reader |readers |user )?(?:comments?|replies|kommentare?|leserkommentare|commentaires?|comentarios?)(?P<more> ?\(?[0-9]+\)?)?|(?P<ask>(?:leave|post|write|add) a (?:comment|reply)|kommentar schreiben|laisser un commentaire|deja un comentario)) ?:?", re.I)


class Line(NamedTuple):
    """A block of text: its characters outside links (none if most are in links), its container, the doubt of a heading over it."""

    text: str
    plain: int
    node: int
    doubt: int


class Page(NamedTuple):
    """Lines in order (None: an empty line), and by container its parent, tag, level of doubt of its own and outermost content element (0: none)."""

    lines: list
    parent: list
    tag: list
    doubt: list
    content: list


def named(value: str, inside: bool) -> bool:
    """Whether a class or id has a name that says no content: of such a word and none but common ones beside it."""
    for token in value.split():
        parts = [x.lower() for x in _PARTS.findall(token)]
        said = [x in NAMES or x.startswith(STARTS) or (not inside and x in OUTSIDE) for x in parts]
        if any(said) and all(s or x in BESIDE for s, x in zip(said, parts, strict=True)):
            return True
    return False


def _judged(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(never read, in doubt) of an element."""
    never = tag in NEVER_TAGS
    doubt = tag in WRAPPERS or (tag == "header" and not inside)
    if not attrs or never or tag in ("html", "body"):
        return never, doubt
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            never = True
        elif name == "role":
            never = never or value.lower() in NEVER_ROLES
        elif name == "style":
            never = never or "display:none" in value.replace(" ", "").lower()
        elif name in ("class", "id") and tag not in CONTENT and (tag in BLOCKS or tag in CONTAINERS):
            doubt = doubt or named(value, inside)
    return never, doubt


def read(html: str) -> Page:
    """The lines of a page and the containers that they are in."""
    page = Page([], [-1], [""], [0], [0])
    open_: list[tuple[str, int, bool]] = []  # open containers and judged elements: (tag, container or -1, never read)
    parts: list[str] = []
    many: dict[str, int] = {}  # how often a tag is in open_
    under: dict[int, bool] = {}  # containers with a heading over comments so far; whether lines of their own are comments too
    linked, in_link, never, node, block = 0, 0, 0, 0, ""

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                doubt = int(under.get(node, False))
                said = _COMMENTS.fullmatch(text) if block in HEADINGS or block in ("p", "div", "b", "strong") else None
                if said and (block in HEADINGS or said["sure"] or said["ask"]):
                    under[node] = under.get(node, False) or bool(said["sure"] or said["more"] or said["ask"])
                    doubt = 1
                page.lines.append(Line(text, len(text) if 2 * linked <= len(text) else 0, node, doubt))
            parts.clear()
        linked = 0

    def leave(depth: int):  # closes what is open beyond
        nonlocal never, node
        while len(open_) > depth:
            tag, k, skip = open_.pop()
            many[tag] -= 1
            never -= skip
            if k >= 0:
                node = page.parent[k]

    last = 0
    for m in _TOKEN.finditer(html):
        if not never and m.start() > last:
            parts.append(html[last : m.start()])
            linked += (m.start() - last) * bool(in_link)
        last = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br" or tag in ("td", "th"):
            parts.append(" ")
        if tag in BLOCKS or tag in CONTAINERS:
            if not never:
                flush()
            in_link = 0
            block = "" if closing else tag
            if open_ and open_[-1][0] == "p" and not (closing and tag == "p"):
                leave(len(open_) - 1)  # a paragraph ends where the next block begins
            if tag in CONTAINERS and not page.content[node]:
                page.lines.extend([None] * APART)
        if closing:
            for depth in range(len(open_) - 1 if many.get(tag) else -1, -1, -1):
                if open_[depth][0] == tag:
                    leave(depth)
                    break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            skip, doubt = _judged(tag, m["attrs"], bool(page.content[node]))
            if skip or doubt or tag in CONTAINERS or (never and many.get(tag)):
                k = -1
                if tag in CONTAINERS or doubt:
                    k = len(page.parent)
                    page.parent.append(node)
                    page.tag.append(tag)
                    page.doubt.append(int(doubt))
                    page.content.append(page.content[node] or (k if tag in CONTENT and not never else 0))
                    if node in under:
                        under[k] = True
                    node = k
                open_.append((tag, k, skip))
                many[tag] = many.get(tag, 0) + 1
                never += skip
    if not never and last < len(html):
        parts.append(html[last:])
    flush()
    return page


def regions(counts: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the lines between each surge and its dive that count as content."""
    sums = [sum(counts[i : i + WINDOW]) for i in range(len(counts))]
    least = SHARE * max(sums, default=0)
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            if max(sums[start:i]) >= least:
                out.append((start, i))
            start = None
    return out


def _greatest(counts: list[int]) -> int:
    return max((sum(counts[i : i + WINDOW]) for i in range(len(counts))), default=0)


def _sums(page: Page, lengths: list[int]) -> list[int]:
    """For each container what its lines and those of all within it add up to."""
    held = [0] * len(page.parent)
    for x, n in zip(page.lines, lengths, strict=True):
        if x:
            held[x.node] += n
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    return held


def _doubts(page: Page) -> list[int]:
    """Levels of doubt of each line; a form around content, or around most of the text, is none."""
    own, marked = list(page.doubt), set()
    held = _sums(page, [x.plain if x else 0 for x in page.lines])
    for k in {c for c in page.content if c}:
        while k >= 0:
            marked.add(k)
            k = page.parent[k]
    for k, tag in enumerate(page.tag):
        if tag in WRAPPERS and (k in marked or 2 * held[k] > held[0]):
            own[k] = 0
    for k in range(1, len(own)):
        own[k] += own[page.parent[k]]
    return [own[x.node] + x.doubt if x else 0 for x in page.lines]


def _element(page: Page, counts: list[int], held: list[bool]) -> int:
    """The deepest container with most of the regions' text, widened while most of what a parent adds is regions too."""
    inside = _sums(page, [n if h else 0 for n, h in zip(counts, held, strict=True)])
    all_ = _sums(page, counts)
    at = 0
    for k in range(1, len(page.parent)):  # in the order in which they begin
        if page.parent[k] == at and inside[k] >= MOST * inside[0]:
            at = k
    while at and page.tag[up := page.parent[at]] not in PAGE and 2 * (inside[up] - inside[at]) >= all_[up] - all_[at] > 0:
        at = up
    return at


def _within(page: Page, which) -> list[bool]:
    """For each container whether it or one around it is such."""
    out = [which(0)]
    for k in range(1, len(page.parent)):
        out.append(out[page.parent[k]] or which(k))
    return out


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = read(html)
    doubts = _doubts(page)
    marked = [bool(x and page.content[x.node]) for x in page.lines]
    plain = [x.plain if x else 0 for x in page.lines]

    def level(p: int, weight: int) -> int:
        return _greatest([n * (weight if m else 1) if d <= p else 0 for n, m, d in zip(plain, marked, doubts, strict=True)])

    levels = sorted(set(doubts))
    read_ = max((p for p in levels if not p or level(p, 1) >= LEAST), key=lambda p: (level(p, MARKED) * DOUBT**p, -p), default=0)
    ok = [x is not None and d <= read_ for x, d in zip(page.lines, doubts, strict=True)]
    counts = [n if o else 0 for n, o in zip(plain, ok, strict=True)]
    in_marked = _greatest([n if m else 0 for n, m in zip(counts, marked, strict=True)])
    if in_marked and MARKED * in_marked >= _greatest([0 if m else n for n, m in zip(counts, marked, strict=True)]):
        runs = regions([n if m else 0 for n, m in zip(counts, marked, strict=True)])
        chosen = {page.content[x.node] for a, b in runs for x in page.lines[a:b] if x and page.content[x.node]}
        keep = [o and m and page.content[x.node] in chosen for x, o, m in zip(page.lines, ok, marked, strict=True)]
    else:
        keep = [False] * len(counts)
        for a, b in regions(counts):
            keep[a:b] = ok[a:b]
        if any(keep):
            at = _element(page, counts, keep)
            inside = _within(page, lambda k: k == at) if page.tag[at] not in PAGE else [k == at for k in range(len(page.parent))]
            section = _within(page, lambda k: page.tag[k] == "section")
            for i, x in enumerate(page.lines):
                if ok[i] and x.plain and inside[x.node]:
                    keep[i] = True
            inner = [i for i, k in enumerate(keep) if k]
            for i in [*range(inner[-1] + 1, len(keep))], [*range(inner[0] - 1, -1, -1)]:
                for j in i:
                    x = page.lines[j]
                    if x and not (ok[j] and x.plain and section[x.node]):
                        break
                    keep[j] = x is not None
    return "\n\n".join(x.text for x, k in zip(page.lines, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points)."""

    def scan(batches):
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(scan, "page_id bigint, url string, text string, n_chars bigint")
