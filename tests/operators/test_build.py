import random

from treewright.operators import build

CALLS = "side string, caller string, ord int, syntax_tag string, syntax_parts array<string>, receiver string, method string, confirmed boolean, target_tag string"
FUNCTIONS = "side string, sym string, language string, module array<string>, container string, name string"


def fits(call, own, f):
    """The rule of G5 for one call of the function own, and one function."""
    tag, parts, receiver, method = call[3:7]
    if f[2] != own[2] or (parts[-1] if tag == "path" else method) not in (f[5], f[5].split("::")[-1]):
        return False
    if tag == "self_method" or (tag == "path" and parts[0] == "Self"):
        return f[3] == own[3] is not None and f[4] == own[4] is not None
    if tag == "path" and len(parts) == 1:
        return f[3] == own[3] is not None and f[4] is None
    if tag == "path":
        asked = [p for p in parts if p not in ("crate", "self", "super")]
        full = None if f[3] is None else [*f[3], *([f[4]] if f[4] else []), f[5]]
        return full is not None and full[max(0, len(full) - len(asked)) :] == asked
    return tag == "method" and receiver[:1].isupper() and f[4] is not None and f[4].split(" as ")[0].split("<")[0].split("::")[-1] == receiver


def test_fallback_equals_brute_force(spark):
    r = random.Random(8)
    some = lambda *x: r.choice(x)
    functions = [("after", f"s{k:03}", some("rust", "rust", "c"), some(["a"], ["a", "b"], ["b"], [], None), some(None, None, "T", "m::T<u8>", "T as m::Show", "U"), some("new", "new", "T::new", "run", "go", "crate", "only")) for k in range(40)]
    functions += [("before", "s000", "rust", ["a"], None, "run")]
    paths = [["new"], ["run"], ["Self", "new"], ["crate", "a", "new"], ["a", "b", "run"], ["T", "new"], ["a", "T", "new"], ["super", "go"], ["self", "crate"], ["b", "only"], ["crate", "super", "only"], ["x", "a", "run"]]
    ways = [("path", p, None, None) for p in paths] + [("self_method", None, None, m) for m in ("new", "run", "go")] + [("method", None, t, m) for t in ("T", "U", "t", "") for m in ("new", "go", "only")]
    calls = [(f[0], f[1], k, *way, r.random() < 0.1, "direct" if r.random() < 0.1 else "unresolved") for f in functions for k, way in enumerate(ways)]
    want = set()
    for c in calls:
        own = next(f for f in functions if f[:2] == c[:2])
        found = {f[1] for f in functions if f[0] == c[0] and fits(c, own, f)} if c[8] == "unresolved" and not c[7] else set()
        want |= {(*c[:3], *found)} if len(found) == 1 else set()
    got = build.resolve_fallback(spark.createDataFrame(calls, CALLS), spark.createDataFrame(functions, FUNCTIONS)).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {ways[x[2]][0] for x in want} == {"path", "self_method", "method"}


def test_a_shared_name_makes_no_pairs(spark, tmp_path):
    """2000 calls of one name that 2000 functions have: 4,000,000 pairs by name, 2000 by what is asked."""
    functions = spark.createDataFrame([("after", f"s{k}", "rust", [f"m{k}"], None, "new") for k in range(2000)], FUNCTIONS)
    calls = spark.createDataFrame([("after", f"s{k}", 0, "path", ["new"], None, None, False, "unresolved") for k in range(2000)], CALLS)
    got = build.resolve_fallback(calls, functions)
    assert {(x.caller, x.resolved) for x in got.collect()} == {(f"s{k}", f"s{k}") for k in range(2000)}
    nodes, made = [got._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(k) for k in range(node.children().size())]
            if "Join" in node.getClass().getSimpleName():
                made.append(node.metrics().apply("numOutputRows").value())
    assert made and max(made) == 2000
