"""Operators as stages of a corpus pipeline: documents in, documents out.

Every stage takes and returns the columns of its input, whatever they are called,
and reads doc_id, text and, where it learns, lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import decontam, langid, linededup, nearcopies
from .runtime import cut, masked


def known_languages(docs: DataFrame) -> DataFrame:
    """docs without those that language identification, learned from docs, rejects."""
    inner, names, restore = masked(docs)
    model = langid.fit_documents(docs)
    return restore(langid.identify(inner, model, names["text"]).where(~F.col("rejected")))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks of lines gone from text; n_chars, if docs have it, counts what is left."""
    inner, names, restore = masked(docs)
    out = linededup.dedup_lines(inner, names["doc_id"], names["text"])
    if "n_chars" in names:
        count = F.length(names["text"]).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, count).otherwise(F.col(names["n_chars"])))
    return restore(out)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without near copies (nearcopies.py) of documents with a smaller doc_id, one row of each id; rows without an id stay."""
    inner, names, restore = masked(docs)
    key, text = names["doc_id"], names["text"]
    found = cut(nearcopies.kept_rows(inner, key, text), "copies-kept")
    kept = inner.join(found, (inner[key] == found["kept_id"]) & (F.xxhash64(inner[text]) == found["raw"]), "left_semi")
    # Equal rows of one id.
    kept = kept.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text)))).where("row = 1").drop("row")
    return restore(kept.unionByName(inner.where(F.col(key).isNull())))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window."""
    inner, names, restore = masked(docs)
    return restore(decontam.decontaminate(inner, benchmark, names["text"]))
