import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from treewright.llm import warc

SCHEMA = "page_id long, url string, html string, size int"


def pages():
    r = random.Random(2)
    big = ["é" * 700, "x" * 1000, "y" * 999, "z\r\n\r\nWARC/1.1\r\n" * 400, "", None, "w" * 300000]
    rows = [(i, r.choice(["http://a/b", None, "http://c/\r\nWARC-Type: x", "http://ü/"]), r.choice(big), 1) for i in range(60)]
    return rows + [(70, "http://a", "x" * 1000, 1), (70, "http://a", "x" * 1000, 1), (None, "http://a", "x" * 1000, 1), (None, "u", "only one without an id " * 100, 1)]


def plain(rows):
    best = {}
    for p, _, h, _ in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and p is not None:
            best[data] = max(best.get(data, p), p)
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        revisit = data in best and best[data] != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 16, 97])
def test_round_trip(spark, chunk):
    rows = pages() if chunk > 100 else [x for x in pages() if len(x[2] or "") < 9000]
    chunks = warc.to_chunks(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    got = warc.read_records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= max(chunk + 4, 700)


def test_rows_in_order_are_a_warc_file(spark):
    chunks = warc.to_chunks(spark.createDataFrame(pages(), SCHEMA).coalesce(1), chunk=500)
    for archive in {x.archive for x in chunks.select("archive").distinct().collect()}:
        rows = chunks.where(F.col("archive") == archive).orderBy("record_id", "chunk").collect()
        data, n = b"".join(x.data for x in rows), 0
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
        assert n == len({x.record_id for x in rows})


def test_damage_is_found(spark):
    chunks = warc.to_chunks(spark.createDataFrame([(1, "u", "abc" * 500, 1)], SCHEMA))
    broken = chunks.withColumn("data", F.when(F.col("chunk") == 1, F.concat(F.lit(b"x"), F.expr("substring(data, 2)"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(broken).collect()


def test_empty(spark):
    assert warc.read_records(warc.to_chunks(spark.createDataFrame([], SCHEMA))).count() == 0


def test_payloads_cross_no_exchange(spark):
    rows = spark.createDataFrame(pages(), SCHEMA)
    assert "Exchange" not in warc._store(rows, "page_id", "url", "html", 500)._jdf.queryExecution().toString()
    archives = warc.write_archives(rows)
    found = warc.read_records(archives.headers.unionByName(archives.payloads))
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    crossing = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert crossing and not any("data#" in x for x in crossing)


def test_copies_in_a_task_are_stored_once_and_split_records_are_read(spark):
    big = "".join(map(str, range(500000)))  # over HOLD
    rows = [(i, "u", "x" * 5000, 0) for i in range(50)] + [(60, "u", big, 0), (61, "u", big, 0), (49, "u", "x" * 5000, 0)]
    archives = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert archives.payloads.where("length(data) = 5000").count() == 2  # the repeated largest id has a record of its own
    everything = archives.headers.unionByName(archives.payloads)
    shuffled = everything.repartition(7)  # chunks of a record in many tasks, in any order
    for chunks in (everything, shuffled, warc.compact(archives)):
        got = warc.read_records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)
    lost = everything.where("chunk <> 3")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(lost).collect()
