"""Operator 6: main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from molsift.llm.common import bounded_batches

# Element names by role.
SKIP = set("script style noscript template svg math iframe object canvas audio video head form button select option "
           "textarea label input nav footer aside menu dialog".split())
RAW = set("script style noscript template svg iframe textarea".split())
BLOCK = set("p div article main section header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
            "blockquote pre figure figcaption address details summary hr center body html fieldset hgroup search".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Elements whose nesting is followed, those that end an open p, and by tag what
# else an opening tag ends and the element it does not look beyond.
NESTED = (BLOCK | SKIP | set("td th optgroup".split())) - VOID
ENDS_P = (BLOCK | set("form nav footer aside menu dialog".split())) - set("body html caption thead tbody tfoot tr".split())
CELL = ("td", "th", "caption")
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
           "optgroup": (("option", "optgroup"), ("select",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tr": (("tr", *CELL), ("table",)), "body": (("head",), ()),
           **{t: (("thead", "tbody", "tfoot", "tr", *CELL), ("table",)) for t in ("thead", "tbody", "tfoot")}}
BOILER_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
BOILER_NAMES = set("ad ads advert adverts advertisement advertisements advertising adsense banner banners promo promos "
                   "promotion sponsor sponsored sponsors sidebar sidebars side aside menu menus nav navbar navigation topnav "
                   "breadcrumb breadcrumbs header masthead topbar footer foot comment comments commentlist disqus replies "
                   "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
                   "login social share sharing related recommended widget widgets toolbar pagination pager skip copyright".split())
# A word that makes a name of the list above harmless: an article's own header.
CONTENT_NAMES = set("article content entry post story main body text".split())
# Words beside one of the list that make it speak of what an element has or
# does, or of where it lies, and not of what it is.
BESIDE = set("with has no without left right top bottom effect effects by".split())

# Attributes as browsers read them: a quote counts only right after the sign of
# equality; anywhere else it is a letter of a name or value.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
ATTRS = rf"""((?:\s++|/|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE})?+)?+|=)*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+){ATTRS}(>|\Z)", re.S)
ATTR = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?+)?+")
NAME_PART = re.compile(r"[a-z]+")
WEAK = re.compile(rf"(?i)(?:class|id)\s*=[^>]*\b(?:{'|'.join(sorted(BESIDE))})\b")
CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def boilerplate(tag: str, attrs: str, inside_article: bool, skipped: set[str] = SKIP, weak: bool = True) -> bool:
    """Whether an element's name or attributes say that it is not main text.

    ``weak`` names, such as with-sidebar or side-effects, say so only outside
    an article, and only as long as they don't take most of a page's text.
    """
    weak = weak and not inside_article
    if tag in skipped or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in ("article", "main", "body", "html") and "role" not in attrs.lower() and "class" not in attrs.lower():
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in BOILER_ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("body", "html"):
            for one in value.split():
                parts = set(NAME_PART.findall(one))
                bad = parts & BOILER_NAMES
                if bad and (parts & BESIDE):
                    if weak:
                        return True
                elif bad and not (parts & CONTENT_NAMES and bad <= {"header", "masthead"}):
                    return True
    return False


class Open:
    """The open elements, outermost first, with the places of each name."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.names))
        self.names.append(tag)

    def cut(self, size: int) -> None:
        while len(self.names) > size:
            self.at[self.names.pop()].pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost of ``tags``, -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def opens(self, tag: str) -> None:
        """End what an opening tag ends: an open p, li, cell, ..."""
        size = len(self.names)
        if tag in ENDS_P and (p := self.last("p")) > self.last("table", "button", "object", *CELL):
            size = p
        if tag in IMPLIED:
            names, within = IMPLIED[tag]
            edge = self.last(*within, "table")
            for name in names:
                size = min([size, *(x for x in self.at.get(name, ())[-1:] if x > edge)])
        self.cut(size)

    def closes(self, tag: str, skip: int) -> None:
        """End the innermost element of the name; one outside a table's cell is not ended from inside it."""
        place = self.last(tag)
        edge = self.last("ul", "ol", *CELL) if tag == "li" else self.last(*CELL)
        if place >= 0 and (place >= skip >= 0 or tag in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") or place >= edge):
            self.cut(place)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's blocks in order: (text, characters in links, inside an article).

    A form is skipped unless it wraps the page: an article in it is let
    through, and without any the form that holds more text than what is
    outside of forms. Elements with weak names are read if they hold more than
    half of the page's text.
    """
    out, form_chars = _lines_of(page, SKIP)
    if form_chars > _chars(out) and not any(inside for _, _, inside in out):
        out, _ = _lines_of(page, SKIP - {"form"})
    if WEAK.search(page):
        more, _ = _lines_of(page, SKIP, False)
        if _chars(more) > 2 * _chars(out):
            out = more
    return out


def _chars(lines: list[tuple[str, int, bool]]) -> int:
    """Characters outside links."""
    return sum(len(text) - link for text, link, _ in lines)


def _lines_of(page: str, skipped: set[str], weak: bool = True) -> tuple[list[tuple[str, int, bool]], int]:
    """``lines_of`` with the element names to skip, and the characters in skipped forms outside their controls."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    link_chars = article = links = form_chars = 0
    nest, skip, found = Open(), -1, False  # skip: the place of the skipped element
    unclosed: set[str] = set()
    pos, end = 0, len(page)

    def flush():
        nonlocal link_chars
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(link_chars, len(text)), article > 0))
        parts.clear()
        link_chars = 0

    while pos < end:
        lt = page.find("<", pos)
        m = None
        while lt >= 0 and (m := TOKEN.match(page, lt)) is None:
            lt = page.find("<", lt + 1)
        if skip < 0:
            chunk = page[pos:lt] if lt >= 0 else re.sub(r"<[/!?]?$", "", page[pos:end])
            if chunk:
                parts.append(chunk)
                if links:
                    link_chars += len(chunk.strip())
        elif nest.names[skip] == "form" and nest.last(*SKIP) == skip:
            form_chars += len(page[pos:lt if lt >= 0 else end].strip())
        if m is None:
            break
        pos = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and skip < 0:
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        closing, tag, attrs = m[1] == "/", m[2].lower(), m[3]
        if m[4] != ">":  # the page ends inside a tag
            break
        if skip >= 0 and not closing and tag in ("article", "main") and not found and nest.names[skip] in ("div", "section", "span", "form") and not boilerplate(tag, attrs, True, skipped, weak):
            skip = -1  # a wrapper whose name speaks of a sidebar or menu, or a form, holds the page's first article
        ended = nest.names[skip] if skip >= 0 else ""
        if closing:
            nest.closes(tag, skip)
        else:
            nest.opens(tag)
        if skip >= 0:
            if len(nest.names) > skip:
                if not closing and (tag in NESTED or tag == nest.names[skip]) and not attrs.rstrip().endswith("/"):
                    close = CLOSERS[tag].search(page, pos) if tag in RAW and tag not in unclosed else None
                    if close:
                        pos = close.end()
                    elif tag in RAW:
                        unclosed.add(tag)
                    else:
                        nest.push(tag)
                continue
            skip = -1
            if closing and tag == ended:
                continue
        if closing:
            if tag in ("article", "main"):
                flush()
                article = max(0, article - 1)
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag == "form":
                flush()
            continue
        if tag not in VOID and boilerplate(tag, attrs, article > 0, skipped, weak):
            if tag in BLOCK or tag in ("nav", "footer", "aside", "form", "menu", "dialog"):
                flush()
            else:
                parts.append(" ")
            if attrs.rstrip().endswith("/") and tag in ("svg", "iframe"):
                continue
            if tag in RAW:
                close = CLOSERS[tag].search(page, pos)
                pos = close.end() if close else end
            elif tag == "head" and not re.search(r"</head\s*>", page[pos:], re.I):
                pass  # an unclosed head: its elements are skipped one by one
            else:
                skip = len(nest.names)
                nest.push(tag)
            continue
        if tag in NESTED and not attrs.rstrip().endswith("/"):
            nest.push(tag)
        if tag in ("article", "main"):
            flush()
            article += 1
            found = True
        elif tag == "title":
            close = page.lower().find("</title", pos)
            pos = close if close >= 0 else end
        elif tag == "a":
            links += 1
        elif tag in ("br", "td", "th", "img", "wbr"):
            parts.append("" if tag == "wbr" else " ")
        elif tag in BLOCK or tag == "form":
            flush()
    flush()
    return out, form_chars


def main_lines(lines: list[tuple[str, int, bool]], window: int = 3, surge: int = 86) -> list[str]:
    """Keep the lines between surge and dive points.

    A line weighs its characters outside links, or nothing if most are in
    links. Sums over ``window`` lines from each line on form the distribution:
    text surges where a sum passes ``surge`` on a line of weight, and dives
    where the following sums fall to nothing. On a page without article
    element the largest sum is enough if it is smaller.

    The border of an article element ends a window. A line of text in one
    weighs ``surge`` more, so that it surges by itself and its span covers the
    article's lines whole; lines outside are judged by their own weights. An
    article with nothing but links is kept only if nothing surges on the page.
    """
    weights = [0 if 2 * link > len(text) else len(text) - link for text, link, _ in lines]
    marked = any(inside for _, _, inside in lines)
    kept, cards = [False] * len(lines), []
    for inside, run in groupby(range(len(lines)), lambda i: lines[i][2]):
        at = list(run)
        if inside:
            if any(weights[i] for i in at):  # with the bonus each line of text surges
                for i in at:
                    kept[i] = True
            else:
                cards += at
            continue
        own = [weights[i] for i in at]
        sums = [sum(own[j:j + window]) for j in range(len(own))]
        level = surge if marked else min(surge, max(sums))
        on = False
        for i, w, total in zip(at, own, sums):
            on = total > 0 if on else level > 0 and w > 0 and total >= level
            kept[i] = on
    if not any(kept):
        for i in cards:
            kept[i] = True
    return [text for (text, _, _), keep in zip(lines, kept) if keep]


def extract(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page or "")))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Main text of every page: ``key``, ``url``, text, n_chars.

    Row-local: pages are parsed in the task that reads them, in Arrow batches,
    with no shuffle. A null or empty page, and one with boilerplate only, gives
    an empty text; null and repeated keys are rows like any other; an empty
    table gives no rows; whole pages are read whatever their length. Other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"])

    bounded_batches(pages)
    rows = pages.select(pages[key], pages[url], pages[body])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
