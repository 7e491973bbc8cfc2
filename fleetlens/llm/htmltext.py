"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block-level element. Lines of menus, notices, adverts and the like are taken
out by their elements; each other line counts with the length of its text, or with nothing if it is made of links, as
lists of links are. Sums over windows of neighbouring lines surge where main text begins and dive to nothing where it
ends. The lines between two dives are main text if some window among them surges; so a short first or last block
beside a long one is kept. Where a page marks its article, tags decide more than lengths: lines outside count with
nothing, lines inside with as much as a surge needs, so that a one-word paragraph is no gap.

Each page is one row and is worked on alone, in time linear in its length; the job is a single pass without a shuffle.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window; length of a window's text that is a surge.
WINDOW, SURGE = 3, 86
#: A line of which links make up more than this share counts with nothing, unless it is one link as long as a surge.
LINKS = 0.5

#: A tag ends at the first ``>`` outside quotes; if another ``<`` or the end comes first, its ``<`` is text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title)\b[^<>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<[!?/][^<>]*+>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that are never main text, and those that are so only outside the article.
NEVER = frozenset("nav footer aside form menu dialog noscript template svg select button textarea iframe object head".split())
OUTSIDE = frozenset(["header"])
#: Names in class, id or role that mark what is not main text; the same outside the article only.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar widget nav navbar navigation "
    "menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies "
    "respond toolbar pagination pager copyright contentinfo complementary search".split()
)
OUTSIDE_MARKS = frozenset(["header", "masthead"])
#: Marks that hold even if the element contains an article.
COMMENTS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that may stand beside such a name without changing what it marks (share-buttons, site-footer).
PLAIN = frozenset(
    "area bar block body bottom box button buttons column container content global group header inner item items left link links "
    "list main outer page panel right row section site small top up wrap wrapper form the".split()
)


def _marks(attributes: str) -> set[str]:
    """Names of a class, id or role; one of several words counts only if all of them are names or plain words, so that
    market-share is no share and search-for-meaning no search."""
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in WORD.findall(token)}
            names = words - PLAIN | words & OUTSIDE_MARKS
            if names <= MARKS | OUTSIDE_MARKS:
                found |= names
    return found


def _covered(n: int, spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each of n places is in any span."""
    change = [0] * (n + 1)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return [c > 0 for c in accumulate(change)]


def _ends(tokens: list[tuple], closes: dict[int, int]) -> list[int]:
    """Where each token's element ends: at its closing tag, or where the element that holds it ends, or with the page."""
    ends, open_ = [], []
    for i in range(len(tokens)):
        while open_ and open_[0] <= i:
            heapq.heappop(open_)
        ends.append(closes.get(i, open_[0] if open_ else len(tokens)))
        if i in closes:
            heapq.heappush(open_, closes[i])
    return ends


def lines(page: str, by_marks: bool = True) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters of it in links, links, in an article, not main text) for each line that has text."""
    tokens, opened, closes = [], {}, {}
    for m in TOKEN.finditer(page):
        name, end = (m[3] or "").lower(), bool(m[2])
        if name and name not in VOID:
            if not end:
                opened.setdefault(name, []).append(len(tokens))
            elif opened.get(name):
                closes[opened[name].pop()] = len(tokens)
        tokens.append((m.start(), m.end(), name, end, m[4] or ""))
    articles, mains, never, marked, outside = [], [], [], [], []
    ends = _ends(tokens, closes)
    for i, (_, _, name, end, attributes) in enumerate(tokens):
        if end or not name or name in VOID:
            continue
        marks = _marks(attributes) if "=" in attributes else set()
        span = (i, ends[i])
        if name in ("article", "main") and not marks & COMMENTS:
            (articles if name == "article" else mains).append(span)
        elif name in NEVER or marks & COMMENTS:
            never.append(span)
        elif name not in ("html", "body"):
            if marks & MARKS and by_marks:
                marked.append(span)
            elif name in OUTSIDE or marks & OUTSIDE_MARKS:
                outside.append(span)
    starts = sorted(a for a, _ in articles + mains)
    inside = _covered(len(tokens), articles or mains)

    def holds_article(span: tuple[int, int]) -> bool:
        k = bisect_right(starts, span[0])
        return k < len(starts) and starts[k] < span[1]

    never += [span for span in marked if not holds_article(span)]
    never += [span for span in outside if not inside[span[0]] and not holds_article(span)]
    skipped = _covered(len(tokens), never)
    found, parts, linked, links, link = [], [], 0, 0, 0
    at, state = 0, (False, False)

    def close() -> None:
        nonlocal parts, linked, links
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            found.append((text, linked, links, *state))
        parts, linked, links = [], 0, 0

    for i, (start, stop, name, end, _) in enumerate(tokens):
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) if link > 0 else 0
        at = stop
        now = (inside[i], skipped[i])
        if name in BLOCKS or now != state:
            close()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if name == "a":
            link = max(0, link + (-1 if end else 1))
            links += not end
        state = now
    if at < len(page):
        parts.append(page[at:])
    close()
    return found


def _kept(rows: list[tuple[str, int, int, bool, bool]]) -> list[str]:
    rows = [row for row in rows if not row[4]]
    marked = any(row[3] for row in rows)
    counts = []
    for text, linked, links, inside, _ in rows:
        menu = linked > LINKS * len(text) and (links > 1 or len(text) < SURGE)
        if marked:
            counts.append(max(len(text), SURGE) if inside else 0)
        else:
            counts.append(0 if menu else len(text))
    sums = [sum(counts[i : i + WINDOW]) for i in range(len(counts))]
    surge, kept, stretch, surges = min(SURGE, max(sums, default=0)), [], [], False
    for i, total in enumerate(sums):
        if total:
            surges |= total >= surge
            stretch += [rows[i][0]] if counts[i] else []
        if not total or i + 1 == len(sums):
            kept += stretch if surges else []
            stretch, surges = [], False
    return kept


def blocks(page: str) -> list[str]:
    """The blocks of the main text, in page order. Names in class or id are passed over if they would leave nothing of an
    article."""
    rows = lines(page)
    if rows and not any(inside and not skipped for _, _, _, inside, skipped in rows) and any(row[3] for row in rows):
        rows = lines(page, by_marks=False)
    return _kept(rows)


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row for each row of ``pages``; other columns are left out.

    A null or empty html, or one without main text, gives an empty text. Pages are read whole, whatever their length; an
    unclosed element ends where the element that holds it does, at the latest where the page does. Repeated rows give
    repeated results, an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, "string"), pa.array(map(len, texts), "int64")],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
