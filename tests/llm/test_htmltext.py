import html
import random
import re
import time

import pytest

from treewright.llm import htmltext

NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two words</a></li></ul></nav>'
FOOT = "<footer>&copy; example &middot; All of it is ours, and nothing else is here.</footer>"
LONG = "This is a long sentence that says something about the matter at hand, and then goes on for a good while longer."


def page(article, extra="", after=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{NAV}<!-- ad --><div class="ad">Buy now, it is cheap today.</div>{extra}{article}{after}{FOOT}</body></html>'


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        (page(f"<article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article>"), f"A title\n\n{LONG}\n\nShort."),
        (page(f"<article><h1>A &amp; B</h1><p><b>{LONG}<br><p>And  more\n of&nbsp;it.</article>"), f"A & B\n\n{LONG}\n\nAnd more of it."),
        (page(f"<main><p>{LONG}</p><section class='comments'><p>{LONG} I agree.</p></section></main>"), LONG),
        (page(f"<article><header><h1>Own header</h1></header><p>{LONG}</p><aside>{LONG}</aside><form>Name <input> {LONG}</form></article>"), f"Own header\n\n{LONG}"),
        (page(f"<div><p>{LONG}</p><p>{LONG}</p></div>", extra=f"<header>{LONG}</header><div id='cookie-notice'>{LONG}</div>", after=f"<div class='side-bar sidebar'>{LONG}</div>"), f"{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>Cut &am", f"{LONG}\n\nCut &am"),
        (f"<article><p>{LONG}</p><script>never ends <p>{LONG}", LONG),
        (f"<article><p>{LONG}</p><p cla", LONG),
        (f"<article><p>a < b, {LONG} c > d.</p></article>", f"a < b, {LONG} c > d."),
        (f"<article><p>One<b>two</b> <i>three</i>.</p><ul><li>first item<li>second item</ul><p>{LONG}</p></article>", f"Onetwo three.\n\nfirst item\n\nsecond item\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div>Menu <button>Press <select>one</div><p>{LONG}</p></article>", f"{LONG}\n\nMenu\n\n{LONG}"),
        (f"<article><p>Let <math><mi>x</mi></math> be so. {LONG}</p><video>Not shown.</video></article>", f"Let x be so. {LONG}\n\nNot shown."),
        (f"<p>{LONG} <span class='ad'>Buy this now.</span> {LONG}</p>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_pages(source, text):
    assert htmltext.extract(source) == text


def test_tree_fits_its_table():
    rows = [tuple(map(int, x.split())) for x in htmltext.TRAINING.split("\n") if x]
    assert len(rows) < 200 and all(len(r) == len(htmltext.FEATURES) + 1 for r in rows)
    assert all(htmltext.keeps(r[:-1]) == bool(r[-1]) for r in rows)


def test_tree_is_the_best_split_everywhere():
    """Every node holds the split of least Gini impurity, by exhaustive search; every row takes exactly one path."""
    rows = [tuple(map(int, x.split())) for x in htmltext.TRAINING.split("\n") if x]

    def gini(side):
        return 2 * sum(r[-1] for r in side) * (len(side) - sum(r[-1] for r in side)) / len(side)

    def walk(node, rows, path):
        if isinstance(node, bool):
            yield path, node
            assert all(r[-1] == node for r in rows)
            return
        f, at, low, high = node
        sides = [[r for r in rows if r[f] <= at], [r for r in rows if r[f] > at]]
        for g in range(len(htmltext.FEATURES)):
            for v in {r[g] for r in rows}:
                other = [[r for r in rows if r[g] <= v], [r for r in rows if r[g] > v]]
                assert not all(other) or sum(map(gini, sides)) <= sum(map(gini, other)) + 1e-9
        yield from walk(low, sides[0], [*path, (f, at, False)])
        yield from walk(high, sides[1], [*path, (f, at, True)])

    paths = list(walk(htmltext.tree(), rows, []))
    assert htmltext.FEATURES[htmltext.tree()[0]] == "links"  # the marks of tags and class names don't decide first
    assert {"words", "words_after"} <= {htmltext.FEATURES[f] for p, _ in paths for f, _, _ in p}
    r = random.Random(5)
    for _ in range(2000):
        x = (r.randrange(90), r.randrange(101), r.randrange(90), r.randrange(101), r.randrange(90), r.randrange(101), *(r.randrange(2) for _ in range(4)))
        taken = [keep for path, keep in paths if all((x[f] > at) == high for f, at, high in path)]
        assert taken == [htmltext.keeps(x)]


def test_pages_without_marks(spark):
    """Neither article elements nor telling names: menus, teasers and a footer go by words and links of blocks and neighbours."""
    r = random.Random(11)
    say = lambda k: " ".join("".join(r.choices("abcdeilmnorst", k=r.randrange(2, 9))) for _ in range(k))
    link = lambda k: f'<a href="/{r.random()}">{say(k)}</a>'
    pages, expected = [], {}
    for i in range(120):
        menu = "<ul class='c1'>" + "".join(f"<li>{link(r.randrange(1, 4))}</li>" for _ in range(r.randrange(3, 9))) + "</ul>"
        title = say(r.randrange(4, 10))
        body = [say(r.randrange(15, 120)).capitalize() + "." for _ in range(r.randrange(2, 9))]
        if len(body) > 2:
            body.insert(1, say(r.randrange(2, 8)).capitalize() + ".")  # a short paragraph between long ones
        teasers = "".join(f"<div class='c{k}'>{link(r.randrange(5, 13))}</div>" for k in range(r.randrange(2, 6)))
        pages.append((i, f"<html><body><div class='c7'>{menu}</div><div class='c2'><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class='c3'>{teasers}</div><div class='c9'>{say(5)}</div></body></html>"))
        expected[i] = "\n\n".join([title, *body])
    got = htmltext.extract_text(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {x.page_id: x.text for x in got} == expected


def test_broken_nesting_takes_linear_time():
    start = time.time()
    deep = "<div class=x>" * 40000 + "</section>" * 40000 + f"<p>{LONG}</p>"
    assert htmltext.extract(deep) == LONG
    htmltext.extract("<a" * 200000)
    htmltext.extract("<button>x " * 40000)
    htmltext.extract("<b><i>" * 40000 + "</u></b>" * 40000)
    assert time.time() - start < 20


def test_generated_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = htmltext.extract_text(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    for x in got.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", x.html, re.S)[1]
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert x.text == "\n\n".join(p for p in plain if p)
        assert x.n_chars == len(x.text)


def test_odd_rows(spark):
    rows = [(1, None, "u"), (None, "", "u"), (2, "x " * 300000, "u"), (2, "x " * 300000, "u"), (3, "<" * 5000, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = htmltext.extract_text(pages).collect()
    assert sorted(x.n_chars for x in got)[-2:] == [599999, 599999] and len(got) == 5
    assert htmltext.extract_text(pages.limit(0)).count() == 0
