"""Main text of web pages by line-block distribution.

Markup is stripped and each block element's text becomes a line. Parts that are never article (scripts, styles, menus,
page headers and footers, side bars, notices, adverts, forms, reader comments: by element or by a telling class, id or
role) leave an empty line. The lengths of the text outside links are summed over a sliding window of lines. A surge is where the sum
reaches a threshold, a dive is where it falls to 0; all lines between a surge and its dive are kept. Text inside <article> or
<main> weighs more, and its borders are dives, so that what stands beside it needs a surge of its own. The threshold comes from
the page: half of its greatest window, SURGE at most; a page whose lines weigh less than SURGE in all keeps every run.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewell.llm.shared import map_columns

#: Lines in a window; characters that make a surge at most; how many times a character inside <article> or <main> counts.
LINES, SURGE, WEIGHT = 3, 80, 20

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = {n: re.compile(rf"</{n}\b[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "select", "canvas", "xmp")}
_NEVER = frozenset("nav footer aside form button menu dialog head label fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words in a class, id or role that name a part which is not article.
_TELLING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice gdpr newsletter subscribe signup popup modal overlay comment comments discussion disqus replies respond share sharing social "
    "related recommended widget toolbar pagination pager login search copyright complementary contentinfo".split()
)
#: Words beside which a telling word still names such a part.
_BESIDE = frozenset(
    "site page main top bottom left right header box block container inner outer area list items item section sections bar slot unit panel pane row column col region zone group message text link links "
    "buttons button icons icon form articles posts stories news post article user users reader readers global primary secondary mobile desktop sticky fixed small large".split()
)
_LANDMARK = frozenset(("article", "main"))
#: The elements whose start ends a paragraph; the end of one, or of what holds paragraphs, does so too.
_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_HOLDS = _BLOCK - {"p"} | frozenset("body html li dd dt td th tr tbody thead tfoot caption button label".split())
_CELLS, _TABLE = frozenset("td th tr thead tbody tfoot".split()), frozenset(("table",))
#: Elements whose end tag may be left out: the start tags that end them, and the elements whose end ends them and in which others of their kind may be nested (p: any block).
_OPTIONAL = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (_CELLS - {"td", "th"}, _TABLE), "td": (_CELLS, _TABLE), "th": (_CELLS, _TABLE),
}


def _telling(attrs: str, in_landmark: bool) -> bool:
    """Whether a class, id or role as a whole names a part that is not article: telling words, with none but common ones beside them."""
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORD.findall(name)
            if "".join(words) in _TELLING:  # side-bar, sign_up
                return True
            said = [w in _TELLING or not in_landmark and w == "header" for w in words]
            if any(said) and all(x or w in _BESIDE for x, w in zip(said, words)):
                return True
    return False


def _ends(skip: str, name: str, close: str, nested: int) -> bool:
    """Whether a tag ends a dropped element whose own end tag was left out; nested: open lists or tables inside it."""
    if skip == "p":
        return name in (_HOLDS if close else _BLOCK)
    if skip in _OPTIONAL and not nested:
        starts, within = _OPTIONAL[skip]
        return name in within or name in starts and name != skip if close else name in starts
    return False


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length outside links, inside a landmark) of each line. Dropped parts that follow each other give one empty line."""
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    linked = landmark = depth = 0
    skip, nested, inner = "", 0, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, max(0, len(text) - linked), landmark > 0))
            held.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _MARK.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skip:
            held.append(page[at:stop])
            if depth:
                linked += stop - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        close, name = m[1], m[2].lower()
        if skip and _ends(skip, name, close, inner):
            skip = ""
        if skip:
            if skip in _OPTIONAL and name in _OPTIONAL[skip][1]:
                inner += -1 if close else 1
            if name in _LANDMARK and not close and skip not in _LANDMARK and not landmark and not _telling(m[3], True):
                skip = ""  # a part that was never closed
            elif name == "body" and skip == "head":
                skip = ""
            else:
                if name in _RAW and not close and not m[3].endswith("/"):
                    raw = _RAW[name].search(page, at)
                    at = raw.end() if raw else end
                elif name == skip:
                    nested += -1 if close else 0 if m[3].endswith("/") else 1
                    if nested == 0:
                        skip = ""
                continue
        if name in _RAW and not close:
            if not m[3].endswith("/"):
                raw = _RAW[name].search(page, at)
                at = raw.end() if raw else end
            continue
        if not close and name not in ("html", "body") and name not in _VOID and (name in _NEVER or name == "header" and not landmark or m[3] and _telling(m[3], landmark > 0)):
            flush()
            skip, nested, inner = name, 1, 0
            if out and out[-1][0]:
                out.append(("", 0, landmark > 0))
            continue
        if name == "a":
            depth = max(0, depth - 1) if close else depth + 1
        if name in _INLINE:
            continue
        flush()
        depth = 0
        if name in _LANDMARK:
            landmark = max(0, landmark - 1) if close else landmark + 1
    flush()
    return out


def _kept(size: list[int], least: int) -> list[int]:
    """The lines from each surge to its dive."""
    sums = [sum(size[i : i + LINES]) for i in range(len(size))]
    out, i = [], 0
    while i < len(size):
        if size[i] and sums[i] >= least:  # surge
            while i < len(size) and sums[i]:  # until the dive
                out.append(i)
                i += 1
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The kept lines, joined by one space; empty for null and empty pages."""
    if not page:
        return ""
    found: list[tuple[str, int, bool]] = []
    for line in lines(page):
        if found and found[-1][2] != line[2]:
            found += [("", 0, line[2])] * LINES  # the border of a landmark is a dive
        found.append(line)
    # In a landmark a line of links alone is text as well.
    size = [WEIGHT * len(t) if inside else n for t, n, inside in found]
    most = max((sum(size[i : i + LINES]) for i in range(len(size))), default=0)
    least = 1 if sum(size) < SURGE else min(SURGE, -(-most // 2))
    return " ".join(found[i][0] for i in _kept(size, least) if found[i][0] and (size[i] or not any(x for _, _, x in found)))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (empty if none), n_chars (its code points), from the whole html.

    Null and empty pages give the empty text. Repeated rows, null ids and null urls stay; other columns are left out.
    """

    def run(_, ids, urls, pages):
        texts = [main_text(p) for p in pages]
        return [ids, urls, texts, [len(t) for t in texts]]

    return map_columns(df.select(F.col(id_col).cast("bigint"), F.col(url_col), F.col(html_col)), run, f"{id_col} bigint, {url_col} string, text string, n_chars bigint")
