"""Graph construction: union, dedupe, indexes, fallback resolution, edges, expansion flags, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(parts: list[DataFrame]) -> DataFrame:
    """G1: fragments one after the other."""
    return reduce(DataFrame.unionByName, parts)


def deduplicate_functions(functions: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each function, the first by position and then by all columns."""
    others = [c for c in functions.columns if c not in keys]
    return functions.groupBy(*keys).agg(F.min(F.struct(*others)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def deduplicate_calls(calls: DataFrame, caller: str, identity: list[str], position: list[str]) -> DataFrame:
    """The distinct calls of merged fragments, renumbered by position."""
    rows = calls.select(caller, *identity, *position).distinct()
    order = Window.partitionBy(caller).orderBy(*position, *identity)
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def duplicate_symbols(functions: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols with more than one definition; a graph must have none."""
    return functions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked(functions: DataFrame, keys: list[str]) -> DataFrame:
    """Functions; raises where a symbol is defined twice."""
    found = duplicate_symbols(functions, keys).orderBy(*keys).first()
    if found:
        raise ValueError("duplicate symbol " + ", ".join(str(found[k]) for k in keys))
    return functions


def name_index(functions: DataFrame) -> DataFrame:
    """(lookup, *functions): by name and by the name's last `::` part."""
    names = F.array_distinct(F.array(F.col("name"), F.element_at(F.split("name", "::"), -1)))
    return functions.withColumn("lookup", F.explode(names))


def base_container(container: Column) -> Column:
    """The self type of a container: what stands before " as ", without generics and path."""
    own = F.regexp_replace(F.substring_index(container, " as ", 1), "<.*$", "")
    return F.element_at(F.split(own, "::"), -1)


def _asks(kind: str, names: Column, word: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), names.alias("names"), word.alias("word"))


def resolve_fallback(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(side, caller, ord, resolved): unresolved calls that exactly one function fits by syntax.

    calls need side, caller, ord, syntax_tag, syntax_parts, receiver, method,
    confirmed and target_tag; functions side, sym, language, module, container, name.

    A call asks for one thing: a container in its module, its module, an end of a qualified name or a type.
    Functions are filed under all they answer to, with only the least and greatest symbol of each entry,
    so a name that many functions and calls share makes no pairs. Both sides are sorted.
    """
    none, no_word = F.array().cast("array<string>"), F.lit("")
    own = functions.select("side", F.col("sym").alias("caller"), "language", F.col("module").alias("c_module"), F.col("container").alias("c_container"))
    open_calls = calls.where((F.col("target_tag") == "unresolved") & ~F.col("confirmed")).join(own.hint("merge"), ["side", "caller"])
    parts = F.filter("syntax_parts", lambda p: ~p.isin("crate", "self", "super"))
    path = F.col("syntax_tag") == "path"
    asks = (
        F.when((F.col("syntax_tag") == "self_method") | (path & (F.element_at("syntax_parts", 1) == "Self")), _asks("container", F.col("c_module"), F.col("c_container")))
        .when(path & (F.size("syntax_parts") == 1), _asks("module", F.col("c_module"), no_word))
        .when(path, _asks("end", parts, no_word))
        .when((F.col("syntax_tag") == "method") & F.col("receiver").rlike("^\\p{Lu}"), _asks("type", none, F.col("receiver")))
    )
    lookup = F.when(path, F.element_at("syntax_parts", -1)).otherwise(F.col("method"))
    open_calls = open_calls.select("side", "caller", "ord", "language", lookup.alias("lookup"), asks.alias("asks")).select("side", "caller", "ord", "language", "lookup", "asks.*")

    module, container = F.col("module"), F.col("container")
    qualified = F.concat("module", F.when(container.isNull(), none).otherwise(F.array("container")), F.array("name"))
    ends = F.transform(F.sequence(F.lit(0), F.size("qualified")), lambda n: _asks("end", F.slice("qualified", F.size("qualified") - n + 1, n), no_word))
    answers = F.concat(
        F.when(container.isNull(), F.array(_asks("module", module, no_word))).otherwise(F.array(_asks("container", module, container), _asks("type", none, base_container(container)))),
        F.when(F.col("qualified").isNotNull(), ends).otherwise(F.array().cast("array<struct<kind:string,names:array<string>,word:string>>")),
    )
    index = name_index(functions).withColumn("qualified", qualified).select("side", "lookup", "language", "sym", F.explode(answers).alias("answer"))
    keys = ["side", "lookup", "language", "kind", "names", "word"]
    index = index.select("side", "lookup", "language", "sym", "answer.*").groupBy(*keys).agg(F.min("sym").alias("least"), F.max("sym").alias("most"))
    found = open_calls.join(index.hint("merge"), keys).groupBy("side", "caller", "ord").agg(F.min("least").alias("resolved"), F.max("most").alias("most"))
    return found.where("resolved = most").select("side", "caller", "ord", "resolved")


def edges(calls: DataFrame, candidates: DataFrame | None, functions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (src, dst) of direct targets and dynamic candidates that are defined."""
    k = list(keys)
    found = calls.where("target_tag = 'direct'").select(*k, F.col("caller").alias("src"), F.col("target").alias("dst"))
    if candidates is not None:
        found = found.unionByName(candidates.select(*k, F.col("caller").alias("src"), F.col("target").alias("dst")))
    return found.join(functions.select(*k, F.col("sym").alias("dst")), [*k, "dst"], "left_semi").distinct()


def expansion_flags(calls: DataFrame, keys: tuple[str, ...] = (), key: Column | None = None) -> DataFrame:
    """Calls with `expand`: only the last of a caller's equivalent calls expands; calls without a key always do."""
    key = F.when(F.col("target_tag") == "direct", F.col("target")) if key is None else key
    rows = calls.withColumn("_key", key)
    last = Window.partitionBy(*keys, "caller", "_key").orderBy(F.desc("ord"))
    return rows.withColumn("expand", F.col("_key").isNull() | (F.row_number().over(last) == 1)).drop("_key")


def diagnostics(calls: DataFrame, prefix: str = "") -> DataFrame:
    """(line): one distinct line per dynamic or indirect call."""
    head = F.concat(F.concat_ws(":", "file", "sl", "sc"), F.lit(": "), F.col("label"), F.lit(": "))
    unresolved = F.when(F.size("reasons") > 0, F.concat(F.lit(", unresolved="), F.array_join("reasons", ", "))).otherwise("")
    dynamic = F.concat(head, F.initcap("resolution"), F.lit(", evidence="), F.col("evidence"), unresolved)
    indirect = F.concat(head, F.lit("indirect"), F.coalesce(F.concat(F.lit(" ("), F.col("signature"), F.lit(")")), F.lit("")), unresolved)
    line = F.when(F.col("target_tag") == "dynamic", dynamic).when(F.col("target_tag") == "indirect", indirect)
    return calls.select(F.concat(F.lit(prefix), line).alias("line")).where("line is not null").distinct()


def in_file(functions: DataFrame, file: str) -> DataFrame:
    """A file's functions."""
    return functions.where(F.col("file") == file)


def public_symbols(functions: DataFrame) -> DataFrame:
    """G10."""
    return functions.where("public").select("sym")


def in_scope(functions: DataFrame, files: DataFrame | None) -> DataFrame:
    """Functions of the files in scope; no scope is every file."""
    return functions if files is None else functions.join(files.select("file"), "file", "left_semi")


def resolution(candidates: Column, reasons: Column) -> Column:
    """Complete, partial or unresolved, from the numbers of candidates and of unresolved reasons."""
    return F.when(candidates == 0, "unresolved").when(reasons > 0, "partial").otherwise("complete")
