"""Inter-procedural flows as fix-points over (function, context) and (function, parameter) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut


def merge_flows(flows: DataFrame, keys: list[str]) -> DataFrame:
    """the union of candidates, formal parameters and unresolved reasons of each key."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return flows.groupBy(*keys).agg(*[union(c).alias(c) for c in ("candidates", "parameters", "reasons")])


def called_parameters(direct: DataFrame, passed: DataFrame) -> DataFrame:
    """(fn, param) that are called: directly, or handed on as an argument of a called parameter.

    direct: fn, param. passed: fn, param, callee, callee_param.
    """
    seen = frontier = cut(direct.select("fn", "param").distinct(), "called")
    links = cut(passed.select("fn", "param", "callee", "callee_param").distinct(), "called-links")
    while True:
        found = links.join(frontier.select(F.col("fn").alias("callee"), F.col("param").alias("callee_param")), ["callee", "callee_param"]).select("fn", "param").distinct()
        frontier = cut(found.join(seen, ["fn", "param"], "left_anti"), "called")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def expand_aliases(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, expanded): the longest alias that starts a path is rewritten until none does or it was used for that path before.

    Paths and targets are `a.b.c` strings; aliases: alias, target.
    """
    state = cut(paths.select("path").distinct().select("path", F.col("path").alias("expanded"), F.array().cast("array<string>").alias("used"), F.lit(True).alias("live")), "alias")
    while not state.where("live").isEmpty():
        parts = F.split("expanded", "\\.")
        heads = state.where("live").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("alias"))
        best = heads.join(aliases.select("alias", "target"), "alias").groupBy("path").agg(F.max_by(F.struct("alias", "target"), F.struct(F.length("alias"), "target")).alias("b"))
        new = F.concat("b.target", F.substring("expanded", F.length("b.alias") + 1, F.length("expanded")))
        step = state.join(best, "path", "left")
        goes = F.col("live") & F.col("b").isNotNull() & ~F.coalesce(F.array_contains("used", F.col("b.alias")), F.lit(False))
        state = cut(step.select("path", F.when(goes, new).otherwise(F.col("expanded")).alias("expanded"), F.when(goes, F.concat("used", F.array("b.alias"))).otherwise(F.col("used")).alias("used"), goes.alias("live")), "alias")
    return state.select("path", "expanded")


def inline_forwarders(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of non-source functions whose only call is dynamic, or direct to such a function, take that call's target.

    calls: caller, ord, target_tag, target. functions: sym, from_source.
    """
    calls = cut(calls.select("caller", "ord", "target_tag", "target"), "forward")
    single = calls.join(functions.where("not from_source").select(F.col("sym").alias("caller")), "caller", "left_semi")
    only = single.groupBy("caller").agg(F.count("*").alias("n"), F.first("target_tag").alias("tag"), F.first("target").alias("to")).where("n = 1").drop("n")
    known = cut(only.where("tag = 'dynamic'").select(F.col("caller").alias("sym"), F.col("to").alias("final")), "forward")
    while True:
        more = only.where("tag = 'direct'").join(known.select(F.col("sym").alias("to"), "final"), "to").select(F.col("caller").alias("sym"), "final").join(known.select("sym"), "sym", "left_anti")
        more = cut(more, "forward")
        if more.isEmpty():
            break
        known = known.union(more)
    swapped = calls.join(known.withColumnRenamed("sym", "target"), "target", "left")
    inlined = (F.col("target_tag") == "direct") & F.col("final").isNotNull()
    return swapped.select("caller", "ord", F.when(inlined, "dynamic").otherwise(F.col("target_tag")).alias("target_tag"), F.when(inlined, F.col("final")).otherwise(F.col("target")).alias("target"))


def specialize(edges: DataFrame, contexts: DataFrame, roots: DataFrame) -> DataFrame:
    """(fn, ctx, key): every function under every context that reaches it from a root.

    contexts (src, dst, adds): a call adds the values in adds to the callee's context; calls without a row
    pass their own context on. Contexts are sets of the values in adds, so the states are finite.
    """
    calls = cut(edges.select("src", "dst").distinct().join(contexts.select("src", "dst", "adds"), ["src", "dst"], "left"), "contexts")
    empty = F.array().cast("array<string>")
    seen = frontier = cut(roots.select(F.col("sym").alias("fn"), empty.alias("ctx")).distinct(), "special")
    while True:
        joined = frontier.join(calls, frontier["fn"] == calls["src"])
        merged = F.array_sort(F.array_union("ctx", F.coalesce("adds", empty)))
        found = joined.select(F.col("dst").alias("fn"), merged.alias("ctx")).distinct()
        frontier = cut(found.join(seen, ["fn", "ctx"], "left_anti"), "special")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    key = F.concat("fn", F.when(F.size("ctx") > 0, F.concat(F.lit("#ctx["), F.array_join("ctx", "|"), F.lit("]"))).otherwise(""))
    return seen.withColumn("key", key)


def missing_instances(calls: DataFrame, functions: DataFrame, templates: DataFrame) -> DataFrame:
    """(instance, base, arguments, caller calls' template): direct targets `base<args>` without a body, with the open template of their base, to a fix-point of the templates' own calls.

    templates: base, parameter, callee: each call of the open function, in which `parameter` stands for the argument.
    """
    have = functions.select(F.col("sym").alias("target"))
    wanted = calls.where("target_tag = 'direct'").select("target").distinct().join(have, "target", "left_anti")
    seen = frontier = cut(_split(wanted), "instances")
    while True:
        made = frontier.join(templates, "base").select(F.replace(F.col("callee"), F.col("parameter"), F.col("arguments")).alias("target")).distinct()
        fresh = _split(made.join(have, "target", "left_anti")).join(seen.select("target"), "target", "left_anti")
        frontier = cut(fresh, "instances")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def _split(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("target").rlike("^[^<]+<.+>$")).select("target", F.regexp_extract("target", "^([^<]+)<", 1).alias("base"), F.regexp_extract("target", "^[^<]+<(.+)>$", 1).alias("arguments"))


def shadowed_names(definitions: DataFrame) -> DataFrame:
    """Definitions with `bound`: all but the last of one (file, module, name) get #bindingK in source order."""
    same = Window.partitionBy("file", "module", "name")
    order = same.orderBy("sl", "sc")
    n, k = F.count("*").over(same), F.row_number().over(order)
    return definitions.withColumn("bound", F.when(k < n, F.concat("name", F.lit("#binding"), (k - 1).cast("string"))).otherwise(F.col("name")))


def occurrence_ordinals(closures: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Closures of one identity numbered by position."""
    return closures.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def longest_base(targets: DataFrame, bases: DataFrame) -> DataFrame:
    """(target, base): the longest known base that starts a target, ending at it or before a `<` or `#`.

    Every prefix that ends there is looked up, so the join is an equi-join.
    """
    ends = F.filter(F.sequence(F.lit(1), F.length("target")), lambda n: F.substring("target", n + 1, F.lit(1)).isin("", "<", "#"))
    prefixes = targets.select("target").distinct().select("target", F.explode(F.transform(ends, lambda n: F.substring("target", F.lit(1), n))).alias("base"))
    return prefixes.join(bases.select("base").distinct(), "base").groupBy("target").agg(F.max_by("base", F.length("base")).alias("base"))


def rewrite_open_generics(calls: DataFrame, parameters: DataFrame, bounds: DataFrame) -> DataFrame:
    """(caller, ord, target): method calls on a parameter of generic type, as `T as Bound`::method with exactly one bound, else T::method.

    calls: caller, ord, receiver, method. parameters: caller, receiver, type. bounds: caller, type, bound.
    """
    known = bounds.groupBy("caller", "type").agg(F.array_sort(F.collect_set("bound")).alias("bounds"))
    rows = calls.join(parameters, ["caller", "receiver"]).join(known, ["caller", "type"])
    owner = F.when(F.size("bounds") == 1, F.concat("type", F.lit(" as "), F.col("bounds")[0])).otherwise(F.col("type"))
    return rows.select("caller", "ord", F.concat(owner, F.lit("::"), "method").alias("target"))


def resolve_in_groups(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(caller, ord, sym): calls by a name that exactly one member of the caller's group has.

    calls: caller, ord, name, group. members: group, name, sym.
    """
    found = calls.join(members, ["group", "name"]).groupBy("caller", "ord").agg(F.collect_set("sym").alias("s"))
    return found.where(F.size("s") == 1).select("caller", "ord", F.col("s")[0].alias("sym"))


def without_constructors(calls: DataFrame, constructors: DataFrame) -> DataFrame:
    """Unresolved calls whose target is a constructor's name go."""
    return calls.join(constructors.select(F.col("name").alias("target"), F.lit("unresolved").alias("target_tag")), ["target", "target_tag"], "left_anti")


def instantiate_functors(functions: DataFrame, instances: DataFrame, parameters: DataFrame) -> DataFrame:
    """the functions of functor modules once more for each instance, parameters replaced by its arguments.

    functions: sym, module, name, target (a call's path). instances: instance, functor, arguments (an array).
    parameters: functor, index, parameter. An instance whose number of arguments differs from the parameters' is left out,
    and so is a symbol that exists.
    """
    names = parameters.groupBy("functor").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "parameter"))), lambda x: x["parameter"]).alias("names"))
    made = instances.join(names, "functor").where(F.size("names") == F.size("arguments"))
    rows = made.join(functions, F.col("functor") == F.col("module"))
    head = F.substring_index("target", ".", 1)
    at = F.array_position("names", head)
    target = F.when(at > 0, F.concat(F.element_at("arguments", F.greatest(at, F.lit(1)).cast("int")), F.substring("target", F.length(head) + 1, F.length("target")))).otherwise(F.col("target"))
    new = rows.select(F.concat_ws(".", "instance", "name").alias("sym"), F.col("instance").alias("module"), "name", target.alias("target"))
    return new.join(functions.select("sym"), "sym", "left_anti")
