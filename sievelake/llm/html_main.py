"""Main text of web pages by line-block distribution.

Method: markup is stripped so that each block element's text is a line. The
lengths of the text outside links are summed over sliding windows of lines.
The lines under one container form a region; the region in which the sums are
densest is the page's main text. The sums of its windows give the page's own
level: other regions whose sums surge over a share of it (``LEVEL``) belong to
the text too, and those that don't are beside it. The text goes from the first
surge to the last dive, moved out to the bounds of the regions they lie in, so
that short titles and last paragraphs stay; paragraphs between the two stay
too, bare short blocks don't. Headings and paragraphs in containers beside a
kept one stay as well, up to the next furniture.

Tags are hints to this. Page furniture by element, role, or outside articles by
class or id is no text. Sums inside article and main elements weigh ``WEIGHT``
times as much; if the densest region is in one, every line of that article is
kept, as are articles beside it whose text isn't mostly links, and a first
heading before them. List items, table cells and quotations belong to the
region around their list, table or quotation.

Names decide nothing alone inside an article, nor some names elsewhere (notice,
social, related and so on): a block with such a class or id stays if its lines
are as long as the text's own (``LIKE`` times the middle one), outside links,
and aren't readers'. Lines are readers' by what they look like: from a heading
such as Comments, Responses or Discussion on, those that have dates, times,
names that say something or links to reply in at least every fourth line;
from one that counts comments or asks for one, all.

Results: null and empty pages, and pages without text, give the empty string.
White space inside a block becomes one space, blocks are joined by a line
feed, character references are decoded. Of a kept region only lines of links
outside articles, readers' lines and short blocks with the names of furniture
are dropped. Of regions equally dense
the first wins. Unclosed elements end with the page; unclosed quotes in tags
end at the next >. Repeated rows give equal results.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_arrow_columns

WINDOW = 3
#: Share of the main region's middle window sum over which another region surges.
LEVEL = 0.3
#: What a character inside an article or main element counts.
WEIGHT = 3
#: Share of the text's middle line that the lines of a block with a doubtful name have to reach on average.
LIKE = 0.5

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split())
CELLS = frozenset(("td", "th"))
#: Blocks that stand for the text around them: their lines belong to the region above.
WITHIN = frozenset("blockquote caption dd details dl dt figcaption figure li ol pre summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold running text.
SPOKEN = HEADINGS | frozenset("p li blockquote pre dd figcaption".split())
VOID = frozenset("br hr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button datalist map".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = "ads? advert(?:s|isement)? sponsor(?:ed|s)? promo(?:tion)?s? banner cookies? consent gdpr notice popup modal overlay newsletter subscri(?:be|ption) sidebar menu nav navbar navigation breadcrumbs? footer header masthead topbar comments? disqus discussion discuss feedback repl(?:y|ies) respond share sharing social related recommended pagination pager login signup widget toolbar skip"
NAMED = re.compile(rf"(?!(?:with|has|no|without)[-_])(?:[a-z0-9]+[-_])?(?:{'|'.join(NAMES.split())})(?:[-_](?:box|block|wrap|wrapper|container|list|section|area|bar|inner|content|left|right|top|bottom|main|links?|item|form|thread|\d+))*", re.I)
#: Names that text can have as well.
DOUBTFUL = re.compile(r"(?:[a-z0-9]+[-_])?(?:notice|social|related|recommended|feedback|repl(?:y|ies)|respond|discussion|discuss|signup|share|sharing|widget|promo(?:tion)?s?)(?:[-_].*)?", re.I)
#: Names that are readers' even in an article.
COMMENTS = re.compile(r"(?:[a-z0-9]+[-_])?(?:comments?|disqus)(?:[-_].*)?", re.I)
#: A heading after which readers may speak, and one after which they surely do.
READERS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|leave a|add a|post a|your)\s+)?(?:comments?|discussion|replies|responses|kommentare?|commentaires?|comentarios?)(?:\s*[(:]?\s*\d*\s*\)?)", re.I)
SURELY = re.compile(r".*\d.*|(?:reader|user|leave a|add a|post a|your)\s.*", re.I)
#: What shows a line of readers: links to reply, dates and times, and names that say something.
SIGNS = re.compile(r"\b(?:reply|replies|report|upvote|permalink|log in to|ago|says|said|wrote|antworten|répondre|responder|schrieb|a écrit)\b|\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}\b", re.I)
WHOLE = frozenset("html body main article".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Line(NamedTuple):
    text: str
    tag: str
    #: Number of the container that the line belongs to, and of the article or main element around it (0: none).
    region: int
    article: int
    #: The element that is the region's container.
    holder: str
    #: How many article elements are around it.
    depth: int
    #: Characters inside links, and whether any word is outside of them.
    linked: int
    free: bool
    #: The container around the region, the outermost block with a doubtful name (0: none), and how much furniture came before.
    above: int = 0
    doubt: int = 0
    past: int = 0


#: What an element may be besides text.
TEXT, DOUBT, SURE = range(3)


def _furniture(name: str, attributes: str, in_article: bool) -> int:
    if name in FURNITURE or name == "header" and not in_article:
        return SURE
    if name in WHOLE or not attributes.strip():
        return TEXT
    out = TEXT
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        kind = m[1].lower()
        if kind == "role" and value.lower() in ROLES or kind == "aria-hidden" and value.lower() == "true":
            return SURE
        for x in value.split() if kind in ("class", "id") else ():
            if NAMED.fullmatch(x) and not (in_article and x.lower().endswith("header")):
                if name not in BLOCKS or COMMENTS.fullmatch(x) or not in_article and not DOUBTFUL.fullmatch(x):
                    return SURE
                out = DOUBT
    return out


class _Open:
    """The block elements open at a place, as (name, number)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.n = 0
        self.inside: list[int] = []
        #: Numbers of the elements with a doubtful name, and how much furniture was passed.
        self.doubts: set[int] = set()
        self.past = 0

    def enter(self, name: str) -> None:
        if name in VOID:
            return
        if self.stack and self.stack[-1][0] == "p" or name == "li" and self.stack and self.stack[-1][0] == "li":
            self.leave(self.stack[-1][0])
        self.n += 1
        self.stack.append((name, self.n))
        if name in ("article", "main"):
            self.inside.append(self.n)

    def leave(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                for gone, number in self.stack[k:]:
                    if gone in ("article", "main") and self.inside and self.inside[-1] == number:
                        self.inside.pop()
                del self.stack[k:]
                return
            if self.stack[k][0] in ("article", "main", "body") and name not in WHOLE:
                return  # a stray end tag

    def line(self, text: str, linked: int, free: bool) -> Line:
        tag = self.stack[-1][0] if self.stack else ""
        k = len(self.stack) - 1  # the line's own block
        k -= 1
        while k >= 0 and self.stack[k][0] in WITHIN:
            k -= 1
        outer = sum(1 for name, _ in self.stack if name == "article")
        up = k - 1
        while up >= 0 and self.stack[up][0] in WITHIN:
            up -= 1
        doubt = next((number for _, number in self.stack if number in self.doubts), 0)
        return Line(text, tag, self.stack[k][1] if k >= 0 else 0, self.inside[-1] if self.inside else 0, self.stack[k][0] if k >= 0 else "", outer, linked, free, self.stack[up][1] if up >= 0 else 0, doubt, self.past)


def lines(html: str, keep_furniture: bool = False) -> list[Line]:
    """The blocks with text in page order."""
    out: list[Line] = []
    words: list[str] = []
    linked = in_link = at = 0
    free = False
    tag = TAG
    opened = _Open()

    def end() -> None:
        nonlocal linked, free
        text = " ".join("".join(words).split())
        if text:
            out.append(opened.line(text, linked, free))
        words.clear()
        linked, free = 0, False

    def say(raw: str) -> None:
        nonlocal linked, free
        if raw:
            text = unescape(raw) if "&" in raw else raw
            words.append(text)
            if in_link:
                linked += len(text.strip())
            elif not free:
                free = any(map(str.isalnum, text))

    n = len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = n if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            at = n if close < 0 else close + 1
            continue
        m = tag.match(html, lt)
        if not m and tag is TAG and html[lt + 1 : lt + 2].strip("/").isalpha():
            tag = LOOSE
            m = tag.match(html, lt)
        if not m:
            rest = html[lt + 1 : lt + 2]
            if (rest.isalpha() or rest == "/") and html.find(">", lt) < 0:
                break  # a tag that the page's end cuts off
            say("<")
            at = lt + 1
            continue
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        at = m.end()
        empty = attributes.endswith("/")
        kind = TEXT if closing or empty or keep_furniture else _furniture(name, attributes, bool(opened.inside))
        if not closing and not empty and (name in HIDDEN or kind == SURE):
            if name in BLOCKS:
                end()
            opened.past += kind == SURE
            at = _after(html, at, name, tag)
            continue
        if name in BLOCKS:
            end()
            if closing:
                opened.leave(name)
            elif not empty:
                opened.enter(name)
                if kind == DOUBT and name not in VOID:
                    opened.doubts.add(opened.n)
        elif name in CELLS:
            words.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
    end()
    return out


def _after(html: str, at: int, name: str, tag: re.Pattern) -> int:
    """Where the element that has just begun ends."""
    if name in ("script", "style", "textarea", "title"):  # raw text
        m = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
        return m.end() if m else len(html)
    edge = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>" if name not in ("p", "li") else r"<(/?)(?:p|li|div|ul|ol|article|section|main|h[1-6])(?=[\s/>])[^>]*>", re.I)
    depth = 1
    while m := edge.search(html, at):
        if name in ("p", "li"):  # may end without an end tag
            return m.end() if m[1] and m[0][2:].lower().startswith(name) else m.start()
        depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
        at = m.end()
        if not depth:
            return at
    return len(html)


def _readers(found: list[Line]) -> bool:
    """Whether lines look like readers': at least every fourth has a sign of it."""
    return 4 * sum(bool(SIGNS.search(x.text)) for x in found) >= max(len(found), 1)


def _spoken(found: list[Line]) -> list[bool]:
    """Whether each line is of readers: those of a region from a heading that announces them to its next heading of no lower level, if they look like it or the heading leaves no doubt."""
    out, since = [False] * len(found), {}

    def ended(region: int) -> None:
        _, at = since.pop(region)
        if SURELY.fullmatch(found[at[0]].text) or len(at) > 1 and _readers([found[i] for i in at[1:]]):
            for i in at:
                out[i] = True

    for i, x in enumerate(found):
        level = int(x.tag[1]) if x.tag in HEADINGS else 9
        if x.region in since and level <= since[x.region][0]:
            ended(x.region)
        if level < 9 and READERS.fullmatch(x.text):
            since[x.region] = (level, [])
        if x.region in since:
            since[x.region][1].append(i)
    for region in list(since):
        ended(region)
    return out


def sizes(found: list[Line]) -> list[int]:
    """What each line counts: its characters outside links, none if more than half are in links or readers speak; more inside articles."""
    return [0 if speaks or 2 * x.linked > len(x.text) else (len(x.text) - x.linked) * (WEIGHT if x.article else 1) for x, speaks in zip(found, _spoken(found), strict=True)]


def window_sums(size: list[int]) -> list[int]:
    """Sums over WINDOW lines around each; none for an empty line."""
    half = WINDOW // 2
    return [sum(size[max(0, i - half) : i + half + 1]) if n else 0 for i, n in enumerate(size)]


def _doubtful(found: list[Line], text: list[Line]) -> list[bool]:
    """For each line of blocks with a doubtful name whether it stays: the block's lines are as long as the text's, outside links, and aren't readers'."""
    own = sorted(len(x.text) - x.linked for x in text if 2 * x.linked <= len(x.text) and x.tag not in HEADINGS) or [0]
    blocks: dict[int, list[Line]] = {}
    for x in found:
        if x.doubt:
            blocks.setdefault(x.doubt, []).append(x)
    stays = {}
    for k, block in blocks.items():
        told = [x for x in block if x.tag not in HEADINGS]
        free = sum(len(x.text) - x.linked for x in told)
        stays[k] = bool(told) and free >= LIKE * own[len(own) // 2] * len(told) and 2 * sum(x.linked for x in told) <= sum(len(x.text) for x in told) and not _readers(block)
    return [bool(x.doubt) and stays[x.doubt] for x in found]


def main_text(html: str | None) -> str:
    """The blocks between surge and dive points, joined by line feeds."""
    every = lines(html) if html else []
    plain = [x for x in every if not x.doubt]
    if sum(sizes(every)) > 2 * sum(sizes(plain)):  # most of the page stands in blocks with such names, so they say nothing
        return "\n".join(every[i].text for i in _main([x._replace(doubt=0) for x in every]))
    at = [i for i, x in enumerate(every) if not x.doubt]
    out = {at[i] for i in _main(plain)}
    if len(plain) < len(every) and out:
        text = [every[i] for i in out]
        articles, regions = {x.article for x in text if x.article}, {x.region for x in text} | {x.above for x in text}
        for i, stays in enumerate(_doubtful(every, text)):
            x = every[i]
            if stays and (x.article in articles or not articles and (min(out) < i < max(out) or x.above in regions or x.region in regions)):
                out.add(i)
    return "\n".join(every[i].text for i in sorted(out))


def _main(found: list[Line]) -> list[int]:
    """Places of the lines that are the page's text."""
    size = sizes(found)
    regions: dict[int, list[int]] = {}
    for i, x in enumerate(found):
        regions.setdefault(x.region, []).append(i)
    sums = {r: window_sums([size[i] for i in at]) for r, at in regions.items()}
    dense = {r: sum(s) for r, s in sums.items()}
    if not any(dense.values()):
        return [i for i, x in enumerate(found) if x.free]
    best = max(dense, key=lambda r: (dense[r], -regions[r][0]))
    main = sorted(s for s in sums[best] if s)
    level = LEVEL * main[len(main) // 2]
    surging = {r for r, s in sums.items() if max(s) > level}
    head = {r: found[at[0]] for r, at in regions.items()}
    article = head[best].article
    if article:
        # of articles beside it, those with text; what else stands in a main element has to surge
        beside = {x.article for r, x in head.items() if dense[r] and x.depth == 1} | {article}
        kept = {r for r, x in head.items() if x.article in beside or r in surging and x.article and x.depth < 2}
    else:
        kept = surging | {best}
        first, last = min(regions[r][0] for r in kept), max(regions[r][-1] for r in kept)
        for r, at in regions.items():
            # between the first surge and the last dive, paragraphs in containers of their own; sections beside them
            if dense[r] and all(found[i].tag in SPOKEN for i in at) and (first < at[0] < last or head[r].holder == "section"):
                kept.add(r)
        # after it, headings and paragraphs in containers beside a kept one, up to the next furniture or other block
        beside, past = {head[r].above for r in kept}, found[last].past
        for r in sorted((r for r, at in regions.items() if at[0] > last), key=lambda r: regions[r][0]):
            if head[r].past > past or head[r].above not in beside or not all(found[i].tag in SPOKEN - {"li"} for i in regions[r]) or not dense[r]:
                break
            kept.add(r)
    speaks = _spoken(found)
    wanted = [i for r in kept for i in regions[r] if size[i]]
    first, last = min(wanted), max(wanted)
    out = []
    for i, x in enumerate(found):
        if speaks[i] or x.region not in kept:
            continue
        if x.article or size[i] or x.tag in HEADINGS or first <= i <= last and (x.free or x.tag in SPOKEN - {"li"}):
            out.append(i)
    # a title that stands just before the text, outside its region
    title = next((i for i in range(first - 1, -1, -1) if found[i].tag == "h1"), None)
    if title is not None and title not in out and not any(size[i] for i in range(title + 1, first) if i not in out):
        out.append(title)
    return sorted(out)


def visible_text(html: str | None) -> str:
    """All text that a page shows, furniture included, in blocks."""
    return "\n".join(x.text for x in lines(html or "", keep_furniture=True))


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of pages (all if None) with text and n_chars (its code points); columns of these names are replaced."""

    def make():
        def run(col):
            found = [main_text(h) for h in col.to_pylist()]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return run

    return with_arrow_columns(pages, [html], T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), make, keep)
