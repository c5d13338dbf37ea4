"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once into flat blocks, the text between block-level tags. A block
knows its words and link density and those of its two neighbours, whether it is a
heading, and whether it closes a sentence. A CART tree (Gini impurity, grown from
TRAINING when first used) keeps or drops it. Link density decides first. Words and
densities can't tell an advert's sentence from an article's, so further down the tree
also asks whether an article element or a boilerplate element (by tag, role, class,
id or hiding) surrounds the block; pages without such marks go by words and links.

Inside a block all white space, line breaks included, becomes one space, after
character references are decoded. Scripts, styles, comments, markup and form
controls never become text; a script, style, textarea or title that doesn't end
hides the rest, another such element only what its enclosing block still holds.

Defined results: null and empty pages, and pages without a kept block, give an
empty text; broken and cut markup is read as far as it goes; plain text without
markup is one block; repeated rows and null ids are read alone; no rows give no
rows; kept columns that clash with a result's name go.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import free_name

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|</?[a-zA-Z!][^<]*+\Z|[^<]++|<""", re.DOTALL)
#: What follows a page's last ">": text, stray brackets, and a tag that is cut off.
_REST = re.compile(r"<!--.*\Z|</?[a-zA-Z!][^<]*+\Z|[^<]++|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z]+")

RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
#: Those whose text runs to the page's end if they aren't closed.
ENDLESS = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
BOILER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu submenu footer sidebar aside widget widgets related recommended recommendations share sharing social"
    " newsletter subscribe subscription signup signin login breadcrumb breadcrumbs pagination pager comment comments commentlist disqus discussion reply replies responses cookie cookies consent gdpr notice notices alert banner"
    " popup modal overlay toolbar topbar masthead copyright disclaimer skip trending".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies response".split())
#: Boilerplate outside an article only: an article's own header is part of it.
OUTER_WORDS = frozenset(("header",))

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler", "heading", "sentence")
#: Labelled blocks: the features in order (links in percent), then 1 for main text.
TRAINING = """
3 0 2 0 4 100 1 0 0 0 1
1 0 1 0 2 100 1 0 0 1 1
5 0 3 0 3 100 1 0 1 0 1
4 0 2 100 2 100 1 0 0 0 1
8 0 4 0 1 100 1 0 0 1 1
6 0 3 0 6 100 1 0 0 0 1
3 0 1 100 9 80 1 0 0 1 1
2 0 4 0 5 90 1 0 0 0 1
4 0 2 0 3 0 1 0 0 0 1
5 0 4 0 2 0 1 0 0 0 1
6 0 1 0 4 0 1 0 1 0 1
3 0 3 0 6 0 1 0 0 1 1
2 0 4 0 1 0 1 0 0 0 1
10 0 3 0 5 0 1 0 0 0 1
1 0 0 0 0 0 1 0 0 1 1
1 0 3 0 9 0 1 0 0 0 1
1 0 90 0 25 0 1 0 0 1 1
1 0 2 100 90 0 1 0 1 1 1
2 0 120 0 12 0 1 0 0 1 1
2 0 4 100 3 0 1 0 0 1 1
3 0 9 0 150 0 1 0 1 0 1
6 0 200 0 18 0 1 0 0 0 1
11 0 70 0 11 50 1 0 0 1 1
25 20 70 0 90 0 1 0 0 0 1
40 0 0 0 0 0 1 0 0 0 1
70 5 1 0 1 0 1 0 0 1 1
150 0 40 0 40 0 1 0 0 0 1
300 0 0 0 0 0 1 0 0 1 1
2 100 40 0 50 0 1 0 0 0 0
9 100 30 0 80 0 1 0 0 1 0
12 90 20 0 8 80 1 0 0 0 0
1 0 0 0 60 0 0 1 0 1 0
1 0 200 0 0 0 0 1 0 0 0
2 0 80 0 120 0 0 1 1 0 0
8 0 120 0 90 0 0 1 0 1 0
14 0 3 0 200 0 0 1 0 1 0
22 5 60 0 40 0 0 1 0 0 0
33 0 0 0 0 0 0 1 0 1 0
50 10 50 10 50 10 0 1 0 1 0
75 0 2 100 9 0 0 1 0 1 0
140 0 90 0 3 0 0 1 0 0 0
250 0 40 0 40 0 0 1 0 1 0
1 0 70 0 80 0 0 0 0 1 1
2 0 90 0 40 0 0 0 0 1 1
12 0 55 0 50 0 0 0 0 1 1
15 0 30 0 4 0 0 0 0 1 1
50 0 3 100 60 0 0 0 0 1 1
70 0 60 0 2 100 0 0 0 0 1
200 0 5 100 4 0 0 0 0 0 1
40 0 30 0 50 0 1 0 0 1 1
2 0 40 0 60 0 1 0 0 1 1
1 0 80 0 0 0 1 0 0 1 1
9 0 6 100 45 0 1 0 1 1 1
6 0 5 100 70 0 1 0 1 0 1
12 0 9 0 70 0 1 0 0 1 1
120 2 60 0 80 3 1 0 0 1 1
55 40 70 0 60 10 1 0 0 1 1
5 0 30 0 4 0 1 0 0 0 1
4 0 5 0 6 0 1 0 0 0 1
15 10 90 0 0 0 1 0 0 1 1
30 0 4 0 12 0 1 0 0 1 1
7 100 60 0 6 100 1 0 0 0 0
4 100 5 100 5 100 1 0 0 0 0
3 100 80 0 0 0 1 0 0 0 0
2 100 2 100 3 100 0 1 0 0 0
1 100 0 0 1 100 0 1 0 0 0
5 0 1 100 9 0 0 1 0 1 0
25 0 6 100 10 0 0 1 0 1 0
60 0 40 0 50 0 0 1 0 1 0
90 0 30 0 70 0 0 1 0 1 0
18 0 60 0 0 0 0 1 0 1 0
3 0 3 100 40 0 0 1 1 0 0
35 0 35 0 30 0 0 1 0 1 0
4 0 8 0 4 0 0 1 0 0 0
10 50 10 50 10 50 0 1 0 0 0
7 0 2 100 50 0 0 1 0 0 0
45 0 20 0 60 0 0 0 0 1 1
60 5 80 0 40 0 0 0 0 1 1
22 0 60 0 70 0 0 0 0 1 1
17 0 40 0 35 0 0 0 0 1 1
80 0 0 0 0 0 0 0 0 1 1
30 0 5 0 0 0 0 0 0 1 1
100 10 3 100 3 100 0 0 0 1 1
26 12 45 0 50 5 0 0 0 1 1
8 0 60 0 70 0 0 0 0 1 1
5 0 50 0 40 0 0 0 0 1 1
7 0 2 100 60 0 0 0 1 0 1
5 0 60 0 55 0 0 0 1 0 1
9 0 0 0 45 0 0 0 1 0 1
3 0 50 0 50 0 0 0 0 0 1
3 100 2 100 2 100 0 0 0 0 0
2 100 60 0 2 100 0 0 0 0 0
1 100 1 100 70 0 0 0 0 0 0
6 80 5 80 6 90 0 0 0 0 0
20 70 3 100 15 60 0 0 0 0 0
30 60 10 50 10 60 0 0 0 0 0
4 0 3 100 3 100 0 0 0 0 0
6 0 2 100 5 0 0 0 0 0 0
5 0 4 0 3 0 0 0 0 0 0
3 0 50 0 2 100 0 0 0 0 0
4 0 6 0 3 100 0 0 1 0 0
3 0 3 0 2 0 0 0 1 0 0
2 0 0 0 3 100 0 0 0 0 0
1 100 0 0 1 100 0 0 0 0 0
1 100 1 100 2 100 0 0 0 0 0
2 100 1 100 1 100 0 0 0 0 0
3 100 2 100 4 100 0 0 0 0 0
1 100 2 100 9 0 0 0 0 0 0
2 100 3 100 7 0 0 0 1 0 0
4 100 60 0 5 100 0 0 0 0 0
5 100 4 100 6 100 0 0 0 0 0
6 100 120 0 7 100 0 0 0 0 0
7 100 5 100 0 0 0 0 0 0 0
8 100 9 100 8 100 0 0 0 0 0
9 100 40 0 11 100 0 0 0 1 0
11 100 8 100 9 100 0 0 1 0 0
12 92 9 100 14 86 0 0 0 0 0
14 86 12 90 11 100 0 0 0 1 0
16 75 9 100 3 100 0 0 0 0 0
10 80 70 0 10 80 0 0 0 0 0
10 70 10 80 10 80 0 0 0 0 0
5 60 5 60 5 60 0 0 0 0 0
8 75 1 100 2 100 0 0 0 0 0
18 66 2 100 2 100 0 0 0 1 0
25 64 3 100 20 70 0 0 0 1 0
3 66 90 0 4 75 0 0 0 0 0
2 100 150 0 0 0 0 0 0 0 0
4 100 80 0 0 0 0 0 0 0 0
1 100 50 0 1 100 0 0 0 0 0
1 100 1 100 1 100 0 0 0 1 0
2 100 2 100 12 0 0 0 1 0 0
3 100 0 0 3 100 0 0 0 0 0
6 83 6 83 6 83 0 0 0 0 0
4 0 2 100 0 0 0 0 0 0 0
7 0 1 100 0 0 0 0 0 0 0
9 11 3 100 0 0 0 0 0 1 0
3 0 4 100 4 100 0 0 0 0 0
2 0 5 100 6 100 0 0 1 0 0
5 20 6 100 7 100 0 0 0 0 0
6 0 3 100 3 100 0 0 0 1 0
14 0 7 0 55 0 0 0 0 1 1
35 8 60 0 2 100 0 0 0 1 1
28 0 1 100 40 0 0 0 0 1 1
45 4 1 100 60 10 0 0 0 1 1
8 0 1 100 45 0 0 0 1 0 1
6 0 2 100 70 0 0 0 1 0 1
10 0 8 0 60 0 0 0 0 1 1
20 25 30 0 30 0 0 0 0 1 1
33 45 50 0 20 0 0 0 0 1 1
4 0 90 0 110 0 0 0 1 0 1
"""


def grow(rows: list[tuple[int, ...]], depth: int = 8):
    """A tree of (feature, threshold, low, high); a leaf is True or False."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return 2 * ones >= len(rows)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            sides = [[r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]]
            impurity = sum(2 * sum(r[-1] for r in s) * (len(s) - sum(r[-1] for r in s)) / len(s) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut, sides
    if best is None:
        return 2 * ones >= len(rows)
    _, f, cut, (low, high) = best
    return f, cut, grow(low, depth - 1), grow(high, depth - 1)


@lru_cache(1)
def tree():
    return grow([tuple(map(int, line.split())) for line in TRAINING.split("\n") if line])


def keeps(features: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while not isinstance(node, bool):
        f, cut, low, high = node
        node = low if features[f] <= cut else high
    return node


def _surroundings(tag: str, attributes: str, article: bool, boiler: bool) -> tuple[bool, bool]:
    """Whether the inside of an element is article text, and whether it is boilerplate."""
    role, words, hidden = "", set(), False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = a or b or c, name.lower()
        if name in ("class", "id"):
            words.update(w.lower() for w in _CAMEL.split(value))
        elif name == "role":
            role = value.lower()
        elif bare or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name in ("hidden", "aria-hidden") and value.lower() != "false"):
            hidden = True
    if tag in ("article", "main") or role in ("main", "article"):
        return (False, True) if hidden or words & COMMENT_WORDS else (True, False)
    if tag in ("html", "body"):
        return article, boiler
    if tag in BOILER_TAGS or role in BOILER_ROLES or hidden or words & BOILER_WORDS or (not article and (tag == "header" or words & OUTER_WORDS)):
        return False, True
    return article, boiler


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, article, boiler, heading) of every block, in page order."""
    out = []
    stack: list[tuple[str, bool, bool]] = []
    article = boiler = heading = False
    parts: list[str] = []
    linked: list[str] = []
    anchors = 0
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def close():
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), article, boiler, heading))
            parts, linked = [], []

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = _TOKEN.match(page, at) if at <= last else _REST.match(page, at)
        name = m[2] if at <= last else None
        at = m.end()
        if name is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                parts.append(m[0])
                if anchors:
                    linked.append(m[0])
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
                continue
            if opened[tag]:  # what is looked through here is left, so all of it takes linear time
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                outside = stack[k - 1][1:] if k else (False, False)
                if tag in BLOCK or outside != (article, boiler):
                    close()
                for x in stack[k:]:
                    opened[x[0]] -= 1
                del stack[k:]
                article, boiler = outside
            elif tag in BLOCK:
                close()
            if tag in ("td", "th"):
                parts.append(" ")
            if tag in HEADINGS:
                heading = False
            if tag in BLOCK:
                anchors = 0
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                if end or tag in ENDLESS:
                    at = end.end() if end else size
                else:
                    unclosed.add(tag)
                    close()
                    article, boiler = False, True
                    stack.append((tag, article, boiler))
                    opened[tag] += 1
            parts.append(" ")
            continue
        if tag == "a":
            anchors = 1
        if tag in BLOCK:
            close()
            anchors = 0
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li"):
                opened[stack.pop()[0]] -= 1
            article, boiler = stack[-1][1:] if stack else (False, False)
            heading = tag in HEADINGS
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag not in VOID and tag != "a" and not m[3].endswith("/"):
            inside = _surroundings(tag, m[3], article, boiler)
            if inside != (article, boiler) and tag not in BLOCK:
                close()
            if inside != (article, boiler) or tag in BLOCK:
                article, boiler = inside
                stack.append((tag, article, boiler))
                opened[tag] += 1
    close()
    return out


def extract(page: str | None) -> str:
    """The main text: kept blocks, joined by empty lines."""
    if not page:
        return ""
    found = blocks(page)
    density = [100 * b[2] // b[1] for b in found]
    kept = []
    for k, (text, words, _, article, boiler, heading) in enumerate(found):
        before = (found[k - 1][1], density[k - 1]) if k else (0, 0)
        after = (found[k + 1][1], density[k + 1]) if k + 1 < len(found) else (0, 0)
        sentence = text.rstrip("\"')]»”’")[-1:] in tuple(".!?…:;。！？")
        if keeps((words, density[k], *before, *after, int(article), int(boiler), int(heading), int(sentence))):
            kept.append(text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages' columns (or those in keep), text and n_chars."""
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    own = free_name(pages, "_html")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(own))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
