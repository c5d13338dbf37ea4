import random

import pytest
from graphs import load
from pyspark.sql import functions as F

from treewright.operators import diff as D
from treewright.operators import reach
from treewright.operators.build import edges
from treewright.operators.expand import expand, local_shapes
from treewright.operators.render import as_diff, render, report, with_rails


def forest(spark, graph, depth=9, roots=None, labels=None):
    functions, calls, candidates = load(spark, graph, labels)
    start = spark.createDataFrame([(r,) for r in roots], "sym string") if roots else reach.inferred_roots(functions, edges(calls, candidates, functions))
    return expand(functions, calls, start, depth, candidates)


def prefixed(case, graph):
    mark = lambda t: t if t is None else f"{case}/{t}"
    call = lambda c: {**c, "target": mark(c.get("target")), "options": [(x, mark(y)) for x, y in c.get("options") or []]} if isinstance(c, dict) else (c[0], mark(c[1]))
    return {mark(f): [call(c) for c in made] for f, made in graph.items()}


def merged(side):
    out = {}
    for case, graphs in CASES.items():
        out |= prefixed(case, graphs[side])
    return out


def text(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.root, r.line_no)):
        out.setdefault(r.root, []).append(r.line)
    return {k: "\n".join(v) for k, v in out.items()}


DISPATCH = {
    "send": [{"label": "dyn Post::deliver(letter)", "target": "dyn Post::deliver", "options": [("Van::deliver(letter)", "van"), ("Bike::deliver(letter)", "bike"), ("Walk::deliver(letter)", "walk")]}],
    "van": [("road::drive(letter)", "drive")],
    "bike": [("lane::ride(letter)", "ride")],
    "walk": [],
    "drive": [],
    "ride": [],
}
PARTIAL = {
    "sort": [
        {"label": "g(x)", "tag": "indirect"},
        {"label": "dyn Rule::pick(x)", "target": "dyn Rule::pick", "resolution": "partial", "options": [("Age::pick(x)", "age")]},
        {"label": "dyn Rule::skip()", "target": "dyn Rule::skip", "resolution": "unresolved"},
        ("done()", "done"),
    ],
    "age": [],
    "done": [],
}
LOOP = {"ring": [("dial()", "dial")], "dial": [("ring()", "ring")]}
WEAVE = {"weave": [("row(a)", "row"), ("knot()", "knot"), ("row(b)", "row")], "row": [("thread(x)", "thread")], "thread": [], "knot": [], "trim": []}
CUPS = {k: [] for k in ("boil", "pour", "wipe", "taste", "weigh", "spin")}

#: before, after, and the rendering of each root with a change; the text follows from the format rules.
CASES = {
    "mixed": (
        {"serve": [("boil(water)", "boil"), ("pour(cup)", "pour"), ("wipe()", "wipe"), ("taste(cup)", "taste")], **CUPS},
        {"serve": [("grind(beans, 2)", "grind"), ("pour(cup)", "pour"), ("taste(cup)", "taste")], "grind": [("weigh(beans)", "weigh"), ("spin(2)", "spin")], **CUPS},
        {"serve": "  serve()\n- ├─ boil(water)\n+ ├─ grind(beans, 2)\n+ │  ├─ weigh(beans)\n+ │  └─ spin(2)\n  ├─ pour(cup)\n- ├─ wipe()\n  └─ taste(cup)"},
    ),
    "label": ({"paint": [("coat(red)", "coat"), ("dry()", "dry")], "coat": [], "dry": []}, {"paint": [("coat(blue)", "coat"), ("dry()", "dry")], "coat": [], "dry": []}, {"paint": "  paint()\n- ├─ coat(red)\n+ ├─ coat(blue)\n  └─ dry()"}),
    "unrelated": (
        {"leave": [("lock(door)", "lock"), ("wave()", "wave")], "lock": [], "wave": []},
        {"arrive": [("greet(guest)", "greet")], "greet": []},
        {"leave": "- leave()\n- ├─ lock(door)\n- └─ wave()", "arrive": "+ arrive()\n+ └─ greet(guest)"},
    ),
    "last": (WEAVE, {**WEAVE, "row": [("thread(x)", "thread"), ("trim(x)", "trim")]}, {"weave": "  weave()\n  ├─ row(a)\n  ├─ knot()\n  └─ row(b)\n     ├─ thread(x)\n+    └─ trim(x)"}),
    "dispatch": (DISPATCH, DISPATCH, {}),
    "lost": (
        DISPATCH,
        {**DISPATCH, "bike": []},
        {"send": "  send()\n  └─ dyn Post::deliver(letter)\n     ╠═ Van::deliver(letter)\n     ║  └─ road::drive(letter)\n     ╠═ Bike::deliver(letter)\n-    ║  └─ lane::ride(letter)\n     ╚═ Walk::deliver(letter)"},
    ),
    "partial": (PARTIAL, PARTIAL, {}),
    "loop": (LOOP, LOOP, {}),
    "lambda": ({"start": [("walk<λ#1>()", "walk#{lambda:aa}")], "walk#{lambda:aa}": []}, {"start": [("walk<λ#2>()", "walk#{lambda:bb}")], "walk#{lambda:bb}": []}, {}),
}
ENTRIES = ("serve", "paint", "leave", "arrive", "weave", "send", "sort", "ring", "start")


@pytest.fixture(scope="module")
def both(spark):
    """Both sides' forests and their diff, all cases at once."""
    forests = []
    for side in (0, 1):
        graph = merged(side)
        labels = {f: f"{f.split('/')[1]}()" for f in graph}
        entries = [f for f in graph if f.split("/")[1] in ENTRIES]
        forests.append(forest(spark, graph, roots=entries, labels=labels).cache())
    return *forests, D.diff_trees(*forests).cache()


def test_changed_trees(both):
    found = both[2].join(D.changed_roots(both[2]), "root", "left_semi")
    got = text(render(D.truncate(D.collapse_unchanged(found), 8)))
    assert got == {f"{case}/{root}": lines for case, (_, _, trees) in CASES.items() for root, lines in trees.items()}
    header = report("rust", "old.rs", "new.rs", [got["label/paint"].split("\n")])
    assert header == "rustdiff old.rs → new.rs\n\n" + CASES["label"][2]["paint"] + "\n"


def test_unchanged_trees(both):
    got = text(render(as_diff(both[1].where("split(root, '/')[0] in ('dispatch', 'partial', 'loop')"))))
    assert got["dispatch/send"] == CASES["lost"][2]["send"].replace("-", " ")
    assert got["partial/sort"] == "  sort()\n  ├─ g(x) [indirect]\n  ├─ dyn Rule::pick(x) [partial]\n  │  ╠═ Age::pick(x)\n  │  ╚═ … unresolved targets\n  ├─ dyn Rule::skip() [unresolved]\n  └─ done()"
    assert got["loop/ring"] == "  ring() ◀───────┐\n  └─ dial()      │\n     └─ ring() ──┘"


def plain_rails(texts, anchors, targets):
    """The rule cell by cell: what stands in each row and column."""
    ends = {}
    for e, t in enumerate(targets):
        above = [k for k in range(e) if t is not None and anchors[k] == t]
        if above:
            ends.setdefault(above[-1], []).append(e)
    if not ends:
        return texts
    size = [len(t.rstrip()) for t in texts]
    column = {s: max(size) + 3 + 3 * n for n, s in enumerate(sorted(ends))}

    def cell(row, c):
        if c < size[row]:
            return texts[row][c]
        across = up = ""
        for s, found in ends.items():
            if row == s and c > size[row] and c <= column[s]:
                across = "◀" if c == size[row] + 1 else "┐" if c == column[s] else "─"
            if row in found and c > size[row] and c <= column[s]:
                across = "─" if c < column[s] else "┘" if row == found[-1] else "┤"
            if c == column[s] and s < row < found[-1]:
                up = "│"
        return "┼" if across == "─" and up else across or up or " "

    return ["".join(cell(r, c) for c in range(max(column.values()) + 1)).rstrip() for r in range(len(texts))]


def test_rails_equal_the_rule_with_shared_ends_and_crossings():
    r = random.Random(17)
    seen = ""
    for _ in range(600):
        n = r.randrange(1, 12)
        texts = ["x" * r.randrange(1, 9) for _ in range(n)]
        targets = [r.choice([None, None, "a", "b", "c"]) for _ in range(n)]
        anchors = [None if t else r.choice([None, "a", "b", "c"]) for t in targets]
        got = with_rails(texts, anchors, targets)
        assert got == plain_rails(texts, anchors, targets)
        seen += "".join(got)
    assert set("◀─┐│┤┘┼") <= set(seen)
    shared = with_rails(["one()", "two()", "end", "end", "end"], ["a", "b", None, None, None], [None, None, "a", "b", "a"])
    assert shared == ["one() ◀─┐", "two() ◀─┼──┐", "end ────┤  │", "end ────┼──┘", "end ────┘"]


def test_collapse_keeps_dispatch(both):
    found = D.collapse_unchanged(both[2].where("root = 'dispatch/send'"))
    assert {tuple(r.path) for r in found.collect()} == {(), (0,), (0, 0), (0, 1), (0, 2), (0, 0, 0), (0, 1, 0)}


def test_depth(spark):
    """The depth limit is tested before recursion, hidden changes get a marker, and a shared DAG stays small."""
    dag = {f"n{k}": [(f"n{k + 1}()", f"n{k + 1}")] * 3 if k < 30 else [] for k in range(31)}
    before = {**LOOP, "p": [("q()", "q")], "q": [("r()", "r")], "r": [], "s": [], **dag}
    after = {**before, "r": [("s()", "s")]}
    short = forest(spark, before, depth=2, roots=["ring", "n0"]).cache()
    assert {(tuple(r.path), r.relation) for r in short.where("root = 'ring'").collect()} == {((), "call"), ((0,), "call"), ((0, 0), "call")}
    assert short.where("root = 'n0'").count() < 50
    found = D.diff_trees(forest(spark, before, 3, ["p"]), forest(spark, after, 3, ["p"]))
    assert text(render(D.truncate(D.collapse_unchanged(found), 2))) == {"p": "  p()\n  └─ q()\n     └─ r()\n+       └─ … changed below max depth"}


def test_alignment_equals_brute_force():
    import itertools

    r = random.Random(5)
    for _ in range(150):
        node = lambda: {"key": r.choice("abc"), "label": r.choice(["x", "y", "λ#1", "λ#2"]), "relation": "call", "below": [{"key": r.choice("pq"), "label": "l", "below": []} for _ in range(r.randrange(3))]}
        b, a = [node() for _ in range(r.randrange(5))], [node() for _ in range(r.randrange(5))]
        got = D.align(b, a)
        assert [i for i, _ in got if i is not None] == list(range(len(b))) and [j for _, j in got if j is not None] == list(range(len(a)))
        total = sum(D.weight(b[i], a[j]) for i, j in got if i is not None and j is not None)
        most = 0
        for n in range(min(len(a), len(b)) + 1):
            for x in itertools.combinations(range(len(b)), n):
                for y in itertools.combinations(range(len(a)), n):
                    w = [D.weight(b[i], a[j]) for i, j in zip(x, y)]
                    most = max(most, sum(w)) if all(w) else most
        assert total == most


def test_local_change(spark):
    f, before, _ = load(spark, {"a": [("b()", "b")], "b": []})
    _, after, _ = load(spark, {"a": [("b(1)", "b")], "b": []})
    got = D.locally_changed(local_shapes(before, f), local_shapes(after, f))
    assert [r.sym for r in got.collect()] == ["a"]


def test_roots_of_detached_cycles_and_entries(spark):
    functions, calls, candidates = load(spark, {"a": [("b()", "b")], "b": [], "x": [("y()", "y")], "y": [("x()", "x")], "self": [("self()", "self")]})
    found = edges(calls, candidates, functions)
    assert {r.sym for r in reach.inferred_roots(functions, found).collect()} == {"a", "x", "self"}
    assert {r.sym for r in reach.roots_in_file(functions, found, "a.rs").collect()} == {"a", "x", "self"}
    named = functions.withColumns({"name": F.col("sym"), "module": F.array(F.lit("m")), "container": F.lit(None).cast("string")})
    assert [r.sym for r in reach.resolve_entry(named, "m.a").collect()] == ["a"]
    with pytest.raises(ValueError, match="ambiguous"):
        reach.resolve_entry(named.withColumn("name", F.lit("same")), "same")
