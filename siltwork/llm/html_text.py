"""Main text of web pages by line-block distribution.

A page becomes a list of lines, one for each block of its markup (paragraph, heading, list item, cell ...). Lines in
menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out, as are scripts and styles.
Lines of which more than half is the text of links count as blank, so that a column of links parts what stands around it,
whatever it is called. Over this list the summed text length of a sliding window of lines is taken. Where it rises above a threshold a surge begins, and the text runs on until the sum dives to
zero; the text between is main text. The surge with the longest text tells where the article is: if it lies in an
article or main element, and the surges hold most of the element's text, the element as a whole is taken, with its short
first and last lines, else all runs between surge and dive are.

Parts are told by their element, or by a whole name in class, id or role that says what they are: "sidebar", "site-footer"
and "ad-slot" do, "has-sidebar", "header-fixed" and "entry-header" don't. If nothing surges outside the parts told by a
name or by being a form, and no article or main element stands there, the one of these with the longest text is taken
back if its text is far longer than what is outside, and so on: no page loses its body by a name.

Defined cases: null, empty or textless pages give an empty text; tags that aren't closed end with their parent or the
page; a page without any surge gives its longest run, the first of equal ones; white space is what Unicode counts as
such; very long pages are read whole, in time proportional to them however deep elements nest; pages are handled one by
one, so that repeated rows give equal rows and an empty table none; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltwork.llm.arrow import map_texts

# HTML element names by what they do to the text; fixed values of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside button select svg canvas object audio video math dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: names that tell a part of the page that is no article: by themselves, as first word, as last word of a class or id
ALONE = frozenset("header aside related search notice consent alert respond replies share banner respond toolbar pager login signup subscribe".split())
FIRST = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement adsense sponsor sponsored sponsors promo promos promotion cookie cookies gdpr popup modal nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead comment comments disqus sharing social recommended recommendations newsletter pagination "
    "complementary contentinfo".split()
)
#: words that may follow one of FIRST; with others the name tells what a text is about
TAILS = FIRST | frozenset(
    "area aside bar bars block blocks body bottom box boxes button buttons column container content desktop elements field footer form group header holder icon icons inline inner item items "
    "label left link links list main mobile modal outer overlay panel primary right row secondary section side slot slots small sticky strip tab tabs template text title toggle top unit units "
    "wrap wrapper zone consent banner notice policy message stories story social share global site page sub top article thread reply replies respond count meta nav".split()
)
LAST = FIRST | frozenset("banner notice consent alert widget toolbar discussion responses".split())
#: pairs that tell a part, and first words that turn a name into a statement about something else
PAIRS = frozenset(
    "side-bar skip-link site-header page-header global-header top-header main-header search-form search-box search-bar related-posts related-articles related-links "
    "related-stories related-content related-news related-items share-buttons share-bar share-links login-form signup-form subscribe-form subscribe-box "
    "notice-box feedback-list reader-comments comment-list comment-form user-comments".split()
)
STATES = frozenset("has have no not with without is are hide hides show shows if when".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)", re.S
)
ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in RAW}
WINDOW = 3
SURGE = 40
#: parts that are taken back one after the other, at most; deeper ones hold less text than those around them
MOST_BACK = 20
#: times the text outside that a part's text must have for it
FAR_LONGER = 10


def tells_part(name: str) -> bool:
    """Whether one name in class, id or role says that its element is no part of the article."""
    words = [x for x in re.split(r"[-_]+", name.lower()) if x and not x.isdigit()]
    if not words or words[0] in STATES:
        return False
    if len(words) == 1:
        return words[0] in ALONE or words[0] in LAST
    return words[0] in FIRST and TAILS.issuperset(words[1:]) or words[-1] in LAST or "-".join(words[-2:]) in PAIRS or "-".join(words[:2]) in PAIRS


def _away(name: str, attrs: str, in_main: bool) -> int:
    """2 for a part that is left out in any case, 1 for one told by a name or by being a form, else 0."""
    if name in DROPPED or name == "header" and not in_main:
        return 2
    told = int(name == "form")
    if attrs and ("=" in attrs or "hidden" in attrs):
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" and value != "until-found" or key == "style" and re.search(r"display\s*:\s*none", value):
                return 2
            if key in ("class", "id", "role") and name not in ("body", "html", *MAIN) and any(map(tells_part, value.split())):
                told = 1
    return told


class PageLines:
    """The lines of a page: texts, numbers of the outermost article or main element around each (0: none), and numbers of
    the innermost part around each (0: none); parents and kinds of the parts."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.mains: list[int] = []
        self.inside: list[int] = []
        self.linked: list[bool] = []
        self.parents, self.kinds = [0], [0]
        self._read(page)

    def _read(self, page: str) -> None:
        buf: list[str] = []
        links: list[str] = []  # of what buf holds, that in links
        stack: list[tuple[str, int, int]] = []  # name, part, main element
        opened: Counter[str] = Counter()
        part, main, mains, at, n = 0, 0, 0, 0, len(page)

        def flush() -> None:
            if buf:
                text = " ".join(html.unescape("".join(buf)).split())
                of_links = len(" ".join(html.unescape("".join(links)).split()))
                buf.clear()
                links.clear()
                if text:
                    self.linked.append(2 * of_links > len(text))
                    self.texts.append(text)
                    self.mains.append(main)
                    self.inside.append(part)

        def pop() -> str:
            name = stack.pop()[0]
            opened[name] -= 1
            return name

        while at < n:
            j = page.find("<", at)
            if j < 0:
                buf.append(page[at:])
                break
            if j > at:
                buf.append(page[at:j])
                if opened["a"]:
                    links.append(page[at:j])
            m = TOKEN.match(page, j)
            if m is None:  # a sign, no tag
                buf.append("<")
                at = j + 1
                continue
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or ""
            if name in RAW and not closing:
                end = _RAW_ENDS[name].search(page, at)
                at = end.end() if end else n
                continue
            if name == "br":
                buf.append("\n")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            block = name in BLOCKS or name in DROPPED
            if closing:
                if block:
                    flush()
                if opened[name]:
                    while pop() != name:
                        pass
                    _, part, main = stack[-1] if stack else ("", 0, 0)
                continue
            kind = _away(name, attrs, main > 0)
            if block or kind:
                flush()
            if opened["p"] and (name == "p" or name in BLOCKS and stack[-1][0] == "p"):
                while stack and opened["p"] and stack[-1][0] not in BLOCKS - {"p"}:
                    if pop() == "p":
                        break
                _, part, main = stack[-1] if stack else ("", 0, 0)
            if attrs.endswith("/"):
                continue
            if name in MAIN and not main and not part and not kind:
                mains += 1
                main = mains
            if kind:
                self.parents.append(part)
                self.kinds.append(kind)
                part = len(self.kinds) - 1
            stack.append((name, part, main))
            opened[name] += 1
        flush()

    def lengths(self, back: set[int]) -> np.ndarray:
        """Lengths of the lines; 0 for those in parts, but the ones taken back."""
        out = np.zeros(len(self.kinds), bool)
        for k in range(1, len(self.kinds)):
            out[k] = out[self.parents[k]] or k not in back
        return np.array([0 if out[k] else len(t) for t, k in zip(self.texts, self.inside)], np.int64)

    def longest(self, back: set[int]) -> tuple[int, int]:
        """The part told by a name that has the longest text without being in one that is left out, and that length."""
        own = np.zeros(len(self.kinds), np.int64)
        np.add.at(own, self.inside, [len(t) for t in self.texts])
        for k in range(len(own) - 1, 0, -1):
            if self.kinds[k] < 2:
                own[self.parents[k]] += own[k]
        shut = np.zeros(len(own), bool)
        for k in range(1, len(own)):
            shut[k] = shut[self.parents[k]] or k not in back
        free = [k for k in range(1, len(own)) if k not in back and self.kinds[k] == 1 and not shut[self.parents[k]] and own[k]]
        best = max(free, key=lambda k: (own[k], -k), default=0)
        return best, int(own[best]) if best else 0


def runs_of(lines: PageLines, lengths: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """Runs over the lines that no part holds, as [from, to) of all lines."""
    kept = np.flatnonzero(lengths)
    weights = np.where(np.array(lines.linked, bool)[kept], 0, lengths[kept]) if len(kept) else lengths[kept]
    return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in runs_between(weights, window, surge)]


def runs_between(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[from, to) of the lines from each surge of the windowed length to its dive."""
    n = len(lengths)
    sums = np.convolve(lengths, np.ones(window, np.int64))[window - 1 :] if n else lengths  # of each line and those after it
    out, k = [], 0
    while k < n:
        if lengths[k] == 0 or sums[k] < surge:
            k += 1
            continue
        a = k
        while k < n and sums[k] > 0:
            k += 1
        b = k
        while b > a and lengths[b - 1] == 0:
            b -= 1
        out.append((a, b))
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = PageLines(page or "")
    texts, mains = lines.texts, lines.mains
    back: set[int] = set()
    lengths = lines.lengths(back)
    runs = runs_of(lines, lengths, window, surge)
    while not runs and len(back) < MOST_BACK and not any(m and n for m, n in zip(mains, lengths)):
        part, size = lines.longest(back)
        if size < FAR_LONGER * max(1, int(lengths.sum())):
            break
        back.add(part)
        lengths = lines.lengths(back)
        runs = runs_of(lines, lengths, window, surge)
    runs = runs or runs_of(lines, lengths, window, 1)
    if not runs:
        return ""
    best = max(runs, key=lambda r: (int(lengths[r[0] : r[1]].sum()), -r[0]))
    in_best, in_runs, in_all = (Counter() for _ in range(3))
    for k in range(*best):
        in_best[mains[k]] += int(lengths[k])
    for a, b in runs:
        for k in range(a, b):
            in_runs[mains[k]] += int(lengths[k])
    for m, n in zip(mains, lengths.tolist()):
        in_all[m] += n
    home = max(in_best, key=lambda m: (in_best[m], -m))
    if home and 2 * in_runs[home] >= in_all[home]:
        # an article next to the best one belongs to the text if it surges by itself
        chosen = {home, *(mains[k] for a, b in runs for k in range(a, b) if mains[k] and lengths[k] >= surge)}
        return "\n".join(t for t, m, n in zip(texts, mains, lengths) if m in chosen and n)
    return "\n".join(t for a, b in runs for t, n in zip(texts[a:b], lengths[a:b]) if n)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def make():
        def one(page: str | None) -> tuple:
            text = main_text(page, window, surge)
            return text, len(text)

        return one

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages, ["page_id", "url"], fields, make, "html")
