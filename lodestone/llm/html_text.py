"""Main text of web pages by line-block distribution.

Markup is stripped by one forward scan so that each block-level element is a line, and what it says only adjusts the lines'
lengths. Text that it calls something else than the article (navigation, header, footer, aside, form, advert, notice, comment; by
element, by role, or by class or id of a block-level element) counts 0; so does text outside the article or main element where a page
has one with text, and a line elsewhere that is mostly links. A line inside the article or main element counts SURGE more than it has.
On all pages the same rule then decides: lengths are summed over windows of WINDOW lines; a region begins at a surge, where
the sum reaches the threshold, and ends at a dive, where it falls to nothing, and the text between them is kept. The threshold is SURGE,
or half of the page's largest sum where that is less, so a page of little text keeps it. Outside an article a region begins with a heading
or a line of at least SHORT characters if it has one. If all text counts 0, no mark is believed and all lines count as they are.

Defined results. A null or empty page has an empty text. Unclosed comments and raw elements run to the end of the page, a tag without an
end is text, a quoted value without an end ends with its tag; an unclosed boilerplate element runs to its parent's end or the
next article or main element. Inline elements never end a block. Character references are decoded after the markup is
gone. Pages of any length are read whole, in time in proportion to it; repeated rows give repeated rows; only the id, url and html
columns are read."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

WINDOW, SURGE, SHORT = 5, 86, 25

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
VALUE = re.compile(r"[^\s>]*")

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav header footer aside form head button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of class and id attributes that mark text as something else than the article.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo recommended related replies share sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Words that stand beside them in such names and change nothing; a name with any other word, as in social-science or share-price, is the author's own.
PLAIN = frozenset("area aside bar block body bottom box button card container content fixed footer form global group header holder inline inner item items left link links list local main menu message module nav outer overlay page panel placeholder post posts primary region right row secondary section site slot sticky stories sub text title toggle top unit widget widgets wrap wrapper".split())
INSIDE = frozenset({"html", "body", "main"})
RAW = frozenset("script style noscript template svg textarea select iframe object title".split())
#: a class name that begins so says what an element has or lacks, not what it is
ABOUT = ("has-", "with-", "no-", "without-", "is-", "not-")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset({"comment", "comments", "ad", "advert"})


class Scanner:
    """Tags and texts of a page, front to back; every search goes on from where the last one ended, or is known to fail."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        to = self.page.find(what, at)
        if to < 0:
            self.gone.add(what)
        return to

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """class, id and role of the tag whose name ends at `at`, and the place after its end (-1 if it has none)."""
        out: dict[str, str] = {}
        page = self.page
        while True:
            m = ATTR.match(page, at)
            if not m:
                break
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                to = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if to >= 0:
                    value, at = page[at + 1 : to], to + 1
                else:
                    v = VALUE.match(page, at)
                    value, at = v[0].strip("'\""), v.end()
            name = m[1].lower()
            if name in ("class", "id", "role"):
                out.setdefault(name, value.lower())
        end = self.find(">", at)
        return out, end + 1 if end >= 0 else -1

    def __iter__(self) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
        """(kind, name or text, whether it closes, attributes); kind is `text` or `tag`."""
        page, at, text = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            begin = at
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = end + 3 if end >= 0 else len(page)
                tag = None
            elif (m := NAME.match(page, at + 1 + page.startswith("</", at))) :
                shut = page[at + 1] == "/"
                if ">" in self.gone:
                    break
                marks, end = self.attributes(m.end())
                if end < 0:
                    break
                name = m[0].lower()
                tag = (name, shut, marks)
                if not shut and name in RAW and page[end - 2] != "/":
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, end)
                    to = self.find(">", close.end()) if close else -1
                    end = to + 1 if to >= 0 else len(page)
                    tag = None
            elif page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 2]:
                end = self.find(">", at)
                if end < 0:
                    break
                end, tag = end + 1, None
            else:
                at += 1
                continue
            if begin > text:
                yield "text", page[text:begin], False, {}
            if tag:
                yield "tag", *tag
            at = text = end
        if text < len(page):
            yield "text", page[text:], False, {}


def told_apart(name: str, marks: dict[str, str]) -> bool:
    """Whether a block-level element's tag calls it something else than the article."""
    if name in APART or marks.get("role") in ROLES:
        return True
    marks_here = COMMENTS if name == "article" else MARKS
    for key in ("class", "id"):
        for token in marks.get(key, "").split():
            words = re.findall(r"[a-z]+", token)
            if not token.startswith(ABOUT) and any(w in marks_here for w in words) and all(w in MARKS or w in PLAIN for w in words):
                return True
    return False


Line = tuple[str, int, int, bool, bool, bool]


def lines(page: str) -> list[Line]:
    """(text, length, letters in links, heading, inside article, called boilerplate) of each line in page order."""
    out: list[Line] = []
    parts: list[str] = []
    in_links = link = article = 0
    heading = False
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, whether text in it is boilerplate, whether it counted as an article
    opened: dict[str, int] = {}
    off = False

    def close() -> None:
        nonlocal in_links
        text = " ".join(html.unescape("".join(parts)).split())
        out.append((text, len(text), in_links, heading, article > 0, off))
        parts.clear()
        in_links = 0

    for kind, name, shut, marks in Scanner(page):
        if kind == "text":
            if stack and stack[-1][0] == "button":
                continue
            parts.append(name)
            if link:
                in_links += len(name)
            continue
        block = name in BLOCKS
        if block:
            close()
            heading = name in HEADINGS and not shut
        if name == "a":
            link = 0 if shut else 1
        if name in VOID:
            continue
        if not shut:
            mark = name not in INSIDE and (block or name in APART) and told_apart(name, marks)
            inner = mark or (off and name not in ("article", "main"))
            real = name in ("article", "main") and not inner
            stack.append((name, off, real))
            opened[name] = opened.get(name, 0) + 1
            article += real
            off = inner
        elif opened.get(name):
            while True:
                top, off, real = stack.pop()
                opened[top] -= 1
                article -= real
                if top == name:
                    break
    close()
    return out


def lengths(found: list[Line]) -> list[int]:
    """What each line counts."""
    inside = any(x[4] and x[1] and not x[5] for x in found)

    def count(x: Line) -> int:
        _, n, linked, _, in_article, off = x
        if not n or off or (inside and not in_article) or (not in_article and 2 * linked > n):
            return 0
        return n + SURGE if in_article else n

    sizes = [count(x) for x in found]
    return sizes if any(sizes) else [x[1] for x in found]


def regions(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, end) of the line ranges between a surge and the next dive."""
    n = len(sizes)
    total = [0] * (n + 1)
    for i, s in enumerate(sizes):
        total[i + 1] = total[i] + s
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    least = min(surge, max(sums, default=0) / 2)
    out, i = [], 0
    while i < n:
        if not sums[i] or sums[i] < least:
            i += 1
            continue
        stop = i
        while stop < n and sums[stop]:
            stop += 1
        out.append((i, stop))
        i = stop
    return out


def extract(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    if not page:
        return ""
    found = lines(page)
    sizes = lengths(found)
    kept: list[str] = []
    for i, stop in regions(sizes, window, surge):
        begin = next((j for j in range(i, stop) if sizes[j] and (found[j][3] or found[j][4] or found[j][1] >= SHORT)), i)
        kept += [found[j][0] for j in range(begin, stop) if sizes[j]]
    return "\n".join(kept)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in common.string_chunks(common.filled(b.column(2)), 4 * common.CHUNK_BYTES):
                p = b.slice(at, to - at)
                texts = [extract(x or "") for x in p.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    src = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("h"))
    return common.in_arrow(src, run, f"{id_col} {src.schema[0].dataType.simpleString()}, {url_col} {src.schema[1].dataType.simpleString()}, text string, n_chars long")
