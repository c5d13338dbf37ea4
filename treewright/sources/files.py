"""Snapshots as tables of files: scans, policies, changed paths, restriction, fingerprints, wire formats.

A snapshot is (path, content); trees on disk, parquet tables and archives all become that first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders whose contents are generated.
GENERATED = (".git", "target", "_build", "node_modules", ".zig-cache", "zig-out")
EVENT = "kind string, target string, file string, sl int, sc int, el int, ec int, type string"
CALL = "target string, definition_name string, span struct<file: string, sl: int, sc: int, el: int, ec: int>, argument_types array<string>"
PROGRAM = (
    "crate_name string, functions array<struct<base_key: string, key: string, display: string, definition_name: string, body_span: struct<file: string, sl: int, sc: int, el: int, ec: int>,"
    " calls: array<struct<target: string, definition_name: string, span: struct<file: string, sl: int, sc: int, el: int, ec: int>, argument_types: array<string>>>>>"
)


def is_generated(path: Column) -> Column:
    """A component of the path is a generated folder."""
    names = "|".join(g.replace(".", "\\.") for g in GENERATED)
    return path.rlike(f"(^|/)({names})(/|$)")


def scan_tree(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, content) of a folder's source files; extensions are case-sensitive, generated folders are left out."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    wanted = F.element_at(F.split("path", "\\."), -1).isin(extensions)
    return rows.where(wanted & ~is_generated(F.regexp_replace("path", "^file:", "")))


def triggers(path: Column, language: str) -> Column:
    """Paths whose change makes a project's analysis stale."""
    name = F.element_at(F.split(path, "/"), -1)
    if language == "rust":
        return name.endswith(".rs") | name.isin("Cargo.toml", "Cargo.lock", "rust-toolchain", "rust-toolchain.toml") | path.rlike("(^|/)\\.cargo(/|$)")
    return name.rlike("\\.(ml|mli|opam)$") | name.isin("dune", "dune-project", "dune-workspace")


def module_path(path: Column) -> Column:
    """Module parts of a source path: a leading src and a trailing lib, main or mod go."""
    parts = F.split(F.regexp_replace(path, "\\.[^./]*$", ""), "/")
    parts = F.when(parts[0] == "src", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    last = F.element_at(F.when(F.size(parts) > 0, parts), -1)
    return F.when(last.isin("lib", "main", "mod"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) whose content differs or that one snapshot lacks."""
    b, a = before.select("path", F.sha2("content", 256).alias("b")), after.select("path", F.sha2("content", 256).alias("a"))
    return b.join(a, "path", "full_outer").where("not (a <=> b)").select("path")


def restrict(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """Before with the selected paths as after has them; a selected path that after lacks is deleted."""
    return before.join(selected, "path", "left_anti").unionByName(after.join(selected, "path", "left_semi"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint) of a snapshot: per-bucket digests of sorted path digests, then one over the 256 buckets.

    A bucket holds a 256th of the paths' digests, so no task has to hold all.
    """
    line = F.sha2(F.concat_ws("\x00", "path", F.length("content").cast("string"), F.sha2("content", 256)), 256)
    rows = files.select(line.alias("d")).groupBy(F.substring("d", 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "|"), 256).alias("d"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "d"))), "|"), 256).alias("fingerprint"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed-call events; a line without exactly eight fields is an error."""
    lines = spark.read.text(path)
    fields = F.split("value", "\t", -1)
    right = F.assert_true(F.size(fields) == 8, F.concat(F.lit("not an event: "), F.col("value")))
    cells = lines.select(fields.alias("f"), right.alias("ok")).where("ok is null")
    names = [x.split() for x in EVENT.split(", ")]
    return cells.select(*[F.col("f")[k].cast(kind).alias(name) for k, (name, kind) in enumerate(names)])


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """Captured functions of all program files, one row of each (key, file, line, column); an empty capture is an error."""
    rows = spark.read.schema(PROGRAM).json(path, multiLine=True).select("crate_name", F.inline("functions"))
    if rows.isEmpty():
        raise ValueError(f"nothing was captured under {path}")
    place = ["key", "body_span.file", "body_span.sl", "body_span.sc"]
    from pyspark.sql import Window

    order = Window.partitionBy(*place).orderBy("crate_name", "display")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def nearest_marker(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, project): of the folders above a path that hold a marker, the deepest. markers: folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pairs = paths.select("path", F.explode(above).alias("folder")).join(markers.select("folder"), "folder")
    return pairs.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("project"))


def save_ir(tables: dict[str, DataFrame], folder: str, key: str) -> None:
    """A snapshot's IR under its fingerprint."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/fingerprint={key}")


def load_ir(spark: SparkSession, folder: str, names: list[str], key: str) -> dict[str, DataFrame]:
    """The tables that save_ir wrote."""
    return {name: spark.read.parquet(f"{folder}/{name}/fingerprint={key}") for name in names}
