"""An extension: file events as a stream. Each batch's net changes go to a handler, as a snapshot comparison takes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_versions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """events (path, content, at) without versions of a path that repeat within delay; late ones go with the watermark."""
    return events.withColumn("sha256", F.sha2("content", 256)).withWatermark("at", delay).dropDuplicatesWithinWatermark(["path", "sha256"])


def latest(batch: DataFrame) -> DataFrame:
    """(path, content): the last version of each path; a null content is a deletion."""
    return batch.groupBy("path").agg(F.max_by(F.struct("content"), F.struct("at", "sha256")).alias("v")).select("path", "v.content")


def on_changes(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "10 minutes"):
    """Start a query that hands each batch's latest versions to handle(files, batch number)."""
    return distinct_versions(events, delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(latest(batch), n)).start()
