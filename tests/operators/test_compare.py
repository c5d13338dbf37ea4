import pytest
from graphs import load
from test_goldens import CASES, merged

from treewright.__main__ import main
from treewright.plans import compare


def graph(spark, side):
    made = merged(side)
    functions, calls, candidates = load(spark, made, {f: f"{f.split('/')[1]}()" for f in made})
    return compare.Graph(functions, calls.drop("expand"), candidates)


def test_report_of_all_cases(spark):
    text = compare.report("rust", ("a", "b"), graph(spark, 0), graph(spark, 1))
    head, _, body = text.partition("\n\n")
    assert head == "rustdiff a → b"
    assert sorted(body.rstrip("\n").split("\n\n")) == sorted(t for _, _, trees in CASES.values() for t in trees.values())
    assert body.index("+ arrive()") > body.index("- leave()")


def test_equal_graphs_and_entries(spark):
    one = graph(spark, 0)
    assert compare.report("rust", ("a", "b"), one, one) == "rustdiff a → b\n\nNo rust call changes between a and b.\n"
    got = compare.report("rust", ("a", "b"), one, graph(spark, 1), entries=["label/paint"])
    assert got == "rustdiff a → b\n\n" + CASES["label"][2]["paint"] + "\n"


def test_command_line_and_registry(spark, tmp_path, capsys):
    for name, side in (("x", 0), ("y", 1)):
        g = graph(spark, side)
        g.functions.where("sym like 'label/%'").write.json(f"{tmp_path}/{name}/functions.json")
        g.calls.where("caller like 'label/%'").write.parquet(f"{tmp_path}/{name}/calls.parquet")
    assert main(["compare", f"{tmp_path}/x", f"{tmp_path}/y", "--color", "always"]) == 0
    assert "\x1b[32m+ ├─ coat(blue)\x1b[0m" in capsys.readouterr().out
    assert main(["tree", f"{tmp_path}/x"]) == 0
    assert capsys.readouterr().out.endswith("  paint()\n  ├─ coat(red)\n  └─ dry()\n")
    compare.register_backend("toy", [".toy"], lambda files: graph(spark, 0))
    assert compare.backend_for("a/B.TOY")[0] == "toy"
    with pytest.raises(ValueError, match="no language"):
        compare.backend_for("a.unknown")
