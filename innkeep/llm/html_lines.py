"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, in page order.  A line
weighs its characters outside links, spaces not counted; lines of elements whose tag, role, class
or id marks them as menus, notices, adverts, comments and the like are blank.
So are a form's controls and labels, and its other lines unless they are in an
article (or main) element inside the form or a window of them alone reaches
``SURGE``.  Inside an article (or main) element a line weighs ``SURGE`` more, so
that short lines count like long ones, and one that is a link counts its
characters; lines outside of it weigh what they do on pages without one.
Two or more lines in a row that are nothing but links are a link list, which
weighs nothing anywhere and is not kept.  Weights are summed over sliding
windows of ``WINDOW`` lines, which end at an article's borders.  A surge point is
the first line with weight where windows rise from zero, the next dive point the
last one before they are back at zero; all lines from the one to the other, but
link lists, are kept if a window between them reaches ``SURGE``.  Beside an
article that is kept, lines outside of it must surge by themselves: a block
there runs from the first line that alone weighs ``SURGE`` to the last such one.

A class or id marks an element if the whole of it is one of the words, or if it
is a compound of such words and of general ones (``comment-list``,
``sidebar-left``); part of another compound (``discussion-paper``) marks nothing.

Defined results: null or empty html, or one without main text, has an empty
text; character references are decoded once, after the markup is gone; white
space of any kind, ``&nbsp;`` and ``<br>`` included, becomes one space inside a
block; markup cut off at the page's end is markup; repeated rows have equal
results; an empty table gives no rows; further columns, whatever their names,
are not carried."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60

# Element names and words of class, id and role attributes -----
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
    pre section summary table tbody tfoot thead tr ul""".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer menu nav select svg video".split())
FORMS = frozenset("fieldset form map object".split())
LABELS = frozenset("label legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
WORDS = frozenset("""ad ads adsense advert adverts advertisement advertising adslot sponsor sponsored promo promos
    promotion promoted banner banners sidebar sidebars sidenav aside rail menu menus nav navbar navigation subnav topnav
    breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices
    notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login paywall
    share sharing sharebar social related recommended recommendations trending widget widgets comment comments
    commentlist disqus respond replies reply discussion copyright skip tagcloud""".split())
TALK = frozenset("comment comments commentlist disqus respond replies reply discussion related recommended".split())
#: words that a compound may have beside those
GENERAL = frozenset("""area bar bars block blocks body bottom box button buttons cloud col column container content count desktop
    entry feed first fixed form foot global group head header heading icon icons info inner item items label large last left line link
    links list lists main message mobile news nav new old outer page pages panel policy popular post posts primary privacy read reader
    readers right row secondary section site slot small social sticky story tab tabs tag tags text title tool tools top trail unit user
    users view wrap wrapper article articles""".split())
HEADS = frozenset("header topheader siteheader pageheader".split())
NOT_ITSELF = frozenset("has with no not without js is".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(/?)([a-zA-Z][^\s/>]*+) ( (?:[^>"']++ | "[^"<]*+" | '[^'<]*+')*+ (?:>|\Z) | [^>]*+(?:>|\Z) )""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


@dataclass
class Line:
    text: str
    weight: int              # characters outside links
    marked: bool             # inside an article or main element
    form: int = 0            # number of the form around it; 0: none, or an article is in between


def _flags(attributes: str) -> tuple[bool, bool, bool, bool]:
    """(unwanted, reader talk or teasers, page header, form) by an element's
    attributes."""
    unwanted = talk = head = form = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            unwanted = True
        elif name == "style":
            unwanted |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "role":
            unwanted |= value.lower() in ROLES
            form |= value.lower() == "form"
        else:
            for one in value.split():
                parts = [w.lower() for w in _WORD.findall(one)]
                if parts and parts[0] not in NOT_ITSELF:
                    named = {w for w in parts if len(w) > 1 and not w[0].isdigit()}
                    if one.lower() in WORDS or named and named <= WORDS | GENERAL:
                        unwanted |= one.lower() in WORDS or not WORDS.isdisjoint(named)
                        talk |= one.lower() in TALK or not TALK.isdisjoint(named)
                    head |= parts[-1] in HEADS and not {"article", "entry", "post", "content", "story"} & set(parts)
    return unwanted, talk, head, form


def page_lines(page: str) -> list[Line]:
    """The page's lines.  Elements may lack end tags: an end tag closes the
    nearest open element of its name and all inside it; a dropped paragraph or
    list item ends with the next block."""
    lines: list[Line] = []
    text: list[str] = []
    links = 0
    stack: list[tuple[str, int, int, int]] = []  # open elements that matter: name; drop, articles and form before
    open_now: dict[str, int] = {}                # how many of each name are on the stack
    drop = articles = in_link = 0                # drop: 2 if for good, 1 if an article inside ends it
    form = forms = 0                             # the form that lines are in; how many there were
    marked_seen = False

    def flush() -> None:
        nonlocal links
        if text:
            raw = "".join(text)
            line = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            lines.append(Line(line, max(0, len(line.replace(" ", "")) - links), articles > 0, form))
            text.clear()
        links = 0

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not drop:
            piece = page[pos:stop]
            text.append(piece)
            if in_link:
                links += len("".join(piece.split()))
        if not m:
            break
        pos = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/>"):
                after = _RAW_END[name].search(page, pos)
                pos = after.end() if after else end
            continue
        block = name in BLOCKS
        if block:
            flush()
        elif not drop and name in ("br", "td", "th", "img"):
            text.append(" ")
        if name == "a":
            in_link = 0 if closing else 1
        if closing:
            if open_now.get(name):
                if name in FORMS:
                    flush()
                while True:
                    inner, drop, articles, form = stack.pop()
                    open_now[inner] -= 1
                    if inner == name:
                        break
            continue
        if name in VOID:
            continue
        if block and stack and stack[-1][0] in ("p", "li") and (name != "p" or stack[-1][0] == "p") and stack[-1][1] < drop:
            if stack[-1][0] == "p" or name == "li":
                inner, drop, articles, form = stack.pop()
                open_now[inner] -= 1
        if name in ("body", "html"):
            continue
        unwanted, talk, head, formlike = _flags(attributes) if "=" in attributes or "hidden" in attributes.lower() else (False,) * 4
        content = name in ("article", "main")
        before = (name, drop, articles, form)
        if content and not unwanted:
            if drop == 1 and not marked_seen:
                drop = 0
            if not drop:
                articles += 1
                marked_seen = True
                form = 0
        elif name in DROPPED or talk or form and name in LABELS:
            drop = 2
        elif unwanted or not articles and (name == "header" or head):
            drop = max(drop, 1)
        if (name in FORMS or formlike) and not content and not drop and not form:
            flush()
            forms += 1
            form = forms
        if content or drop != before[1] or form != before[3] or block and name != "p" and name != "li":
            stack.append(before)
            open_now[name] = open_now.get(name, 0) + 1
    flush()
    return without_forms(lines) if forms else lines


def without_forms(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """``lines`` without those of forms that have no surge among their own."""
    recent: dict[int, list[int]] = {}            # the weights of each form's last lines
    ended = {0}
    for line in lines:
        last = recent.setdefault(line.form, [])
        last.append(line.weight)
        del last[:-window]
        if sum(last) >= surge:
            ended.add(line.form)
    return [line for line in lines if line.form in ended]


def _blocks(weight: list[int], window: int, surge: int, alone: bool) -> list[tuple[int, int]]:
    """(first, last) line of each block that is kept of one stretch of lines.
    ``alone``: a block runs between lines that reach ``surge`` by themselves."""
    out = []
    i, n = 0, len(weight)
    sums, total = [], 0
    for j in range(n):                                       # sums[j]: lines j - window + 1 to j
        total += weight[j] - (weight[j - window] if j >= window else 0)
        sums.append(total)
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        if max(sums[start:i]) >= surge:
            heavy = [j for j in range(start, i) if weight[j] >= (surge if alone else 1)]
            if heavy:
                out.append((heavy[0], heavy[-1]))
    return out


def between_surge_and_dive(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Texts of the lines from each surge point to its dive point."""
    lines = [line for line in lines if line.text]
    linked = [not line.weight for line in lines]
    listed = [one and (linked[i - 1:i] == [True] or linked[i + 1:i + 2] == [True]) for i, one in enumerate(linked)]
    weight = [0 if skip else surge + (line.weight or len(line.text)) if line.marked else line.weight
              for line, skip in zip(lines, listed)]
    stretches: list[tuple[int, int]] = []
    start = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or lines[i].marked != lines[start].marked:
            stretches.append((start, i))
            start = i
    found = {a: _blocks(weight[a:b], window, surge, False) for a, b in stretches}
    if any(found[a] and lines[a].marked for a, _ in stretches):
        found |= {a: _blocks(weight[a:b], window, surge, True) for a, b in stretches if not lines[a].marked}
    return [lines[i].text for a, _ in stretches for first, last in found[a] for i in range(a + first, a + last + 1) if not listed[i]]


def main_text(page: str | None) -> str:
    return "\n".join(between_surge_and_dive(page_lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return (rows.mapInArrow(run, "page_id long, url string, text string")
            .withColumn("n_chars", F.char_length("text").cast("long")))
