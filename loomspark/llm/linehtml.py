"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped and every block-level element begins a line. Elements that by their name, role or class
are no article text (menus, forms, adverts, comments, ...) leave no line. Lengths of the others, without
their links, are summed over sliding windows; the text starts where the sums surge and ends where they dive.
Where a page marks its article or main element, lines outside it have no length and any
text without links is a surge inside, unless a run outside holds more text than the whole element, which is
then only a teaser.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.lean import lean

#: Lines of a window; characters that a window needs for a surge, and in a marked element.
WINDOW, SURGE, MARKED = 3, 120, 1
#: Names of HTML elements, roles and usual words in class names.
RAW = "script|style|noscript|template|iframe|svg|canvas|title"
DROPPED = frozenset("nav header footer aside form select textarea button dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices comment comments disqus respond replies reply sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related popup modal newsletter subscribe subscription widget toolbar pagination pager login signup".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*>|[^<]+|<", re.S | re.I
)
_CLOSED = re.compile(r"</[a-zA-Z]+\s*>\Z")
_LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")


def _is_other(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for kind, *values in _LABEL.findall(attributes):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value in ROLES:
                return True
        elif WORDS.intersection(re.split(r"[^a-z]+", value)):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, within article or main) of each line that has text."""
    tokens, open_, ends = [], {}, {}
    # Behind the last > there is no tag, so no search for the end of one runs to the end of the page.
    cut, cut_off = page.rfind(">") + 1, False
    for m in _TOKEN.finditer(page, 0, cut):
        cut_off = m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] is not None and not _CLOSED.search(m[0])
        if m[3] is not None:
            name, i = m[3].lower(), len(tokens)
            if m[2]:
                if open_.get(name):
                    ends[open_[name].pop()] = i
            elif name not in VOID:
                open_.setdefault(name, []).append(i)
            tokens.append((name, m[2], m[4]))
        elif m[1] is None and (m[0][0] != "<" or m[0] == "<"):
            tokens.append((None, "", m[0]))
    if cut < len(page) and not cut_off:
        tokens.append((None, "", page[cut:].split("<!--", 1)[0]))
    cores = [i for i, t in enumerate(tokens) if t[0] in ("article", "main") and not t[1]]
    # The last token before which article or main lasts, if it is closed at all.
    out: list[tuple[str, int, bool]] = []
    text, free, linked, core_end, i = [], 0, 0, -1, 0

    def end_line() -> None:
        nonlocal free
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, free, i <= core_end))
            text.clear()
        free = 0

    at = 0
    while i < len(tokens):
        name, closing, value = tokens[i]
        if name is None:
            text.append(value)
            if not linked:
                free += len(value.strip())
        else:
            if name in BLOCKS:
                end_line()
            if not closing and i in ends:
                if name in ("article", "main"):
                    core_end = max(core_end, ends[i])
                elif _is_other(name, value):
                    while at < len(cores) and cores[at] <= i:
                        at += 1
                    inner = at < len(cores) and cores[at] < ends[i]
                    if not inner and not (name == "header" and i < core_end):
                        end_line()
                        i = ends[i] + 1
                        continue
            if name == "a":
                linked = max(0, linked + (-1 if closing else 1)) if i in ends or closing else linked
        i += 1
    end_line()
    return out


def extract(page: str | None) -> str:
    """The main text; empty if there is none."""
    found = lines(page or "")
    if not found:
        return ""
    weight = [free if 2 * free >= len(text) else 0 for text, free, _ in found]
    inside = [w if marked else 0 for w, (*_, marked) in zip(weight, found, strict=True)]
    outside = _runs([0 if marked else w for w, (*_, marked) in zip(weight, found, strict=True)], SURGE)
    core = sum(inside) > 0 and sum(inside) >= max((size for size, *_ in outside), default=0)
    kept = _runs(inside if core else weight, MARKED if core else SURGE)
    if not kept:
        return ""
    if not core:
        best = max(kept)[0]
        kept = [r for r in kept if 4 * r[0] >= best]
    in_run = {k for _, i, last in kept for k in range(i, last + 1)}
    # Between runs, lines of links are left out.
    return " ".join(found[k][0] for k in range(kept[0][1], kept[-1][2] + 1) if (k in in_run or weight[k]) and (found[k][2] or not core))


def _runs(weight: list[int], least: int) -> list[tuple[int, int, int]]:
    """(characters, first line, last line) of the runs of windows from a surge to the dive after it."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    surge = min(least, (max(sums) + 1) // 2)
    if not surge:
        return []
    runs, i = [], 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        j = i
        while j + 1 < len(sums) and sums[j + 1] > 0:
            j += 1
        while i <= j and not weight[i]:
            i += 1
        last = max(k for k in range(i, j + 1) if weight[k])
        runs.append((sum(weight[i : last + 1]), i, last))
        i = j + 1
    return runs


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    A null or empty html, and a page without main text, has an empty text. Markup that is not closed is read as
    far as it goes, and tags that HTML lets be left out may be. Very long pages are read whole, in time that grows
    as they do. Of runs of equal length all count alike. Repeated rows are repeated, null ids and urls kept; an empty table gives no rows. Other
    columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(_extracted), f"page_id {kind}, url string, text string, n_chars long")
