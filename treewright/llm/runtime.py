"""Shared plumbing: the shared scratch folder, lineage cuts, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only in local mode, where one machine is the whole cluster, an unset folder
    is replaced by a temporary one; elsewhere an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="treewright-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that survive lost executors.

    The files go when the driver's JVM ends; drop() removes them earlier.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a cut() that no later plan reads."""
    p, fs = _hadoop_path(df.sparkSession, df._scratch_path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch on its way to Python in the registered queries and the pipeline, where the session says nothing else.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """spark, whose batches on their way to Python hold about BATCH_BYTES. For programs that own their session; operators leave it alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def byte_list(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return column.to_pylist()


def fold_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo: a Column for a Column, an int for an id."""
    if doc_id is None or isinstance(doc_id, (int, str)):
        return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def masked(df: DataFrame):
    """df with columns c0, c1, ..., the new name of each column, and what puts the old names back.

    For operators that add columns: df's own names, whatever they are, can't clash.
    """
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, names, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])
