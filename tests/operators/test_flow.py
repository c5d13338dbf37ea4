from treewright.operators import build, flow


def test_aliases_go_once_each_in_chains_of_any_length(spark):
    chain = [(f"a{k}", f"a{k + 1}") for k in range(70)]
    aliases = spark.createDataFrame([*chain, ("s", "s.b"), ("x", "y"), ("y", "x")], "alias string, target string")
    paths = spark.createDataFrame([("a0.f",), ("s.f",), ("x.f",), ("none",)], "path string")
    got = {tuple(x) for x in flow.expand_aliases(paths, aliases).collect()}
    assert got == {("a0.f", "a70.f"), ("s.f", "s.b.f"), ("x.f", "x.f"), ("none", "none")}


def test_large_contexts_stay_apart(spark):
    values = [[f"v{k:03}" for k in range(n)] for n in (70, 71)]
    edges = spark.createDataFrame([("r", "a"), ("q", "a")], "src string, dst string")
    contexts = spark.createDataFrame([("r", "a", values[0]), ("q", "a", values[1])], "src string, dst string, adds array<string>")
    got = flow.specialize(edges, contexts, spark.createDataFrame([("r",), ("q",)], "sym string")).collect()
    assert sorted(x.ctx for x in got if x.fn == "a") == values


def test_merged_functions_and_file_members(spark):
    rows = spark.createDataFrame([("f", "b.rs", 9), ("f", "a.rs", 4), ("g", "a.rs", 1), ("f", "a.rs", 4)], "sym string, file string, sl int")
    one = build.deduplicate_functions(rows, ["sym"])
    assert sorted(map(tuple, one.select("sym", "file", "sl").collect())) == [("f", "a.rs", 4), ("g", "a.rs", 1)]
    assert [x.sym for x in build.in_file(one, "a.rs").orderBy("sym").collect()] == ["f", "g"]
    assert build.in_file(one, "c.rs").count() == 0
