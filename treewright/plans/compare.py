"""The whole comparison of two call graphs: what changed, whom it affects, the changed trees, the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, diff, reach, render
from ..operators.expand import expand, local_shapes
from ..schema import MAX_DEPTH
from .scratch import cut

#: What turns a table of files (path, content) into a Graph, by file extension.
BACKENDS: dict[str, tuple[str, Callable[[DataFrame], Graph]]] = {}


@dataclass(frozen=True)
class Graph:
    """One side: functions (sym, label, file, sl, sc), calls (caller, ord, target_tag, target, label, callsite, resolution), candidates (caller, ord, cand_ord, target, label), declared roots (sym)."""

    functions: DataFrame
    calls: DataFrame
    candidates: DataFrame | None = None
    roots: DataFrame | None = None

    def append(self, other: Graph) -> Graph:
        """G1: both graphs' fragments as one."""
        both = lambda a, b: b if a is None else a if b is None else build.append([a, b])
        return Graph(both(self.functions, other.functions), both(self.calls, other.calls), both(self.candidates, other.candidates), both(self.roots, other.roots))

    def edges(self) -> DataFrame:
        return build.edges(self.calls, self.candidates, self.functions)

    def flagged(self) -> DataFrame:
        """Calls with G7's flag; dynamic calls are equivalent if target, candidates and resolution agree."""
        key = F.when(F.col("target_tag") == "direct", F.col("target")).when(F.col("target_tag") == "dynamic", F.concat_ws("|", "target", "_options", "resolution"))
        calls = self.calls
        if self.candidates is None:
            return build.expansion_flags(calls.withColumn("_options", F.lit(None).cast("string")), key=key).drop("_options")
        options = self.candidates.groupBy("caller", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cand_ord", "target"))), lambda x: x["target"]), ",").alias("_options"))
        return build.expansion_flags(calls.join(options, ["caller", "ord"], "left"), key=key).drop("_options")


def register_backend(language: str, extensions: list[str], analyze: Callable[[DataFrame], Graph]) -> None:
    """S19."""
    for e in extensions:
        BACKENDS[e.lower().lstrip(".")] = language, analyze


def backend_for(path: str) -> tuple[str, Callable[[DataFrame], Graph]]:
    """By the path's extension, whatever its case."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension not in BACKENDS:
        raise ValueError(f"no language is known for {path}")
    return BACKENDS[extension]


def load_graph(spark: SparkSession, folder: str) -> Graph:
    """A side's tables, as JSON lines or Parquet, under folder; missing candidates and roots are none."""

    def read(name: str, schema: str) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for kind in ("parquet", "json"):
            if fs.exists(path.suffix(f".{kind}")):
                reader = spark.read.schema(schema)
                return getattr(reader, kind)(f"{folder}/{name}.{kind}")
        return None

    functions = read("functions", "sym string, label string, file string, sl int, sc int")
    if functions is None:
        raise FileNotFoundError(f"no functions under {folder}")
    calls = read("calls", "caller string, ord int, target_tag string, target string, label string, callsite string, resolution string")
    none = spark.createDataFrame([], "caller string, ord int, target_tag string, target string, label string, callsite string, resolution string")
    return Graph(build.checked(functions, ["sym"]), none if calls is None else calls, read("candidates", "caller string, ord int, cand_ord int, target string, label string"), read("roots", "sym string"))


def entries_of(graph: Graph, names: list[str] | None) -> DataFrame:
    """The roots asked for, or those inferred."""
    if not names:
        return reach.inferred_roots(graph.functions, graph.edges(), graph.roots)
    own = graph.functions.withColumns({"name": F.element_at(F.split("sym", "::"), -1), "module": F.split("sym", "::"), "container": F.lit(None).cast("string")})
    found = None
    for name in names:
        one = reach.resolve_entries(own, name).select("sym")
        found = one if found is None else found.union(one)
    return found.distinct()


def changed_trees(before: Graph, after: Graph, entries: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The diffs of all entries that a change affects; unchanged subtrees are one line, and nothing is deeper than max_depth but a mark.

    Only what reaches a change, or a dynamic call, is expanded at all.
    """
    sides = []
    shapes = [local_shapes(g.calls, g.functions, g.candidates) for g in (before, after)]
    changed = cut(diff.locally_changed(*shapes), "changed")
    for graph, mark in ((before, "before-limit"), (after, "after-limit")):
        edges = graph.edges()
        relevant = cut(reach.affected(edges, changed), "relevant")
        sides.append((graph, relevant, cut(reach.dispatch_context(edges, graph.calls), "context"), mark))
    roots = diff.root_union(*[entries_of(g, entries).join(g.functions.select("sym"), "sym", "left_semi") for g in (before, after)])
    tops = before.functions.select("sym", F.col("label").alias("b")).join(after.functions.select("sym", F.col("label").alias("a")), "sym", "full_outer")
    moved = tops.where("not (a <=> b)").select("sym")
    touched = sides[0][1].union(sides[1][1]).union(moved).distinct()
    roots = cut(roots.select("sym").join(touched, "sym", "left_semi"), "entries")
    trees = [expand(g.functions, g.flagged(), roots, max_depth + 1, g.candidates, relevant, context, marker=mark) for g, relevant, context, mark in sides]
    found = cut(diff.diff_trees(*trees), "diffs")
    found = found.join(diff.changed_roots(found), "root", "left_semi")
    return diff.truncate(diff.collapse_unchanged(found), max_depth)


def root_order(before: Graph, after: Graph) -> DataFrame:
    """(root, rank, file, sl, sc): common and removed roots in before's source order, then added ones in after's."""
    b, a = (g.functions.select("sym", F.struct("file", "sl", "sc").alias("at")) for g in (before, after))
    both = b.withColumnRenamed("at", "b").join(a.withColumnRenamed("at", "a"), "sym", "full_outer")
    rank = F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), 0).when(F.col("b").isNotNull(), 1).otherwise(2)
    return both.select(F.col("sym").alias("root"), rank.alias("rank"), F.coalesce("b", "a").alias("at"))


def report_lines(before: Graph, after: Graph, entries: list[str] | None = None, max_depth: int = MAX_DEPTH, ansi: bool = False) -> DataFrame:
    """(rank, at, root, line_no, line): the lines of the report's trees, to be read in the order of these columns."""
    lines = render.render(changed_trees(before, after, entries, max_depth), ansi)
    return lines.join(root_order(before, after), "root").select("rank", "at", "root", "line_no", "line")


def report(language: str, names: tuple[str, str], before: Graph, after: Graph, **more) -> str:
    """The report as text; a reader's page, so it comes to the driver."""
    trees: dict[str, list[str]] = {}
    for row in report_lines(before, after, **more).orderBy("rank", "at", "root", "line_no").toLocalIterator():
        trees.setdefault(row["root"], []).append(row["line"])
    return render.report(language, *names, [*trees.values()])


def tree_report(language: str, name: str, graph: Graph, entries: list[str] | None = None, max_depth: int = MAX_DEPTH, ansi: bool = False) -> str:
    """One graph's forests."""
    forest = expand(graph.functions, graph.flagged(), entries_of(graph, entries), max_depth, graph.candidates)
    at = graph.functions.select(F.col("sym").alias("root"), "file", "sl", "sc")
    trees: dict[str, list[str]] = {}
    for row in render.render(render.as_diff(forest), ansi).join(at, "root").orderBy("file", "sl", "sc", "root", "line_no").toLocalIterator():
        trees.setdefault(row["root"], []).append(row["line"])
    body = "\n\n".join("\n".join(t) for t in trees.values()) or f"No {language} call trees in {name}."
    return f"{language}tree {name}\n\n{body}\n"
