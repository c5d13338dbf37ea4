"""WARC archives as a table of record chunks.

An archive's bytes lie in rows (archive, record_id, chunk, data, sha1, crc): chunk
0 holds a record's WARC and HTTP headers, the next ones at most CHUNK bytes of
payload each, the last one the record's end. The data of an archive's rows in
order of record_id and chunk are a plain WARC 1.1 file. Every row carries the
SHA-1 of the payload up to its end and the CRC-32 of its own data, so a reader
checks a record piece by piece, wherever its rows were split between tasks.

Payloads never cross an exchange. Chunks are cut out of a payload by the scan's
own stage, row by row, and reach Python one by one, where hashes advance chunk by
chunk; so Python never holds a record. The rows are written at once, with a row
of facts for each record (its place, page_id, size and digests). Which records are
responses is decided on these facts alone, and headers are written beside the
payloads. A task stores equal payloads once while it can (up to HOLD bytes each);
copies in other tasks are stored before anybody knows of them, and such chunks,
without a header, belong to no record: readers pass over them, compact() drops them.

Payloads of MIN_REVISIT bytes or more that are equal (by SHA-1, length and a
further 64-bit hash) have one response, with the largest page_id; the others are
revisit records that refer to it.

Defined results: a null payload is empty; records are rows, so repeated rows make
records of their own, and of rows equal in id and payload all are responses or
all revisits; a null page_id is written as empty, and is a response unless an
equal payload has an id; null urls are written as about:blank, control characters
of urls percent-encoded; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import byte_list, cut

CHUNK = 1 << 16
MIN_REVISIT = 1000
#: Bytes of a payload that a task holds until it knows whether it has stored them already.
HOLD = 1 << 20
#: Bytes of chunk rows sent on at once.
AT_ONCE = 4 << 20
#: Rows of unused chunks' records that may be broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
DATE = "2000-01-01T00:00:00Z"
NAME = "urn:treewright:page"
END = b"\r\n\r\n"
CHUNKS = "archive long, record_id long, chunk long, data binary, sha1 string, crc long"
FACTS = "page_id long, url string, size long, more long, holder long"
PARSED = "archive long, record_id long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, stored long"
PARTS = "archive long, record_id long, first long, last long, bytes long, sha1 string"
RECORDS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks"]


class Archives(NamedTuple):
    """Chunk rows of an archive: headers, all stored payloads, and (archive, record_id) of those no header names."""

    headers: DataFrame
    payloads: DataFrame
    unused: DataFrame


def headers(page_id: int | None, record_id: int, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The WARC and HTTP headers of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "about:blank" if url is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{NAME}:{'' if page_id is None else page_id}:{record_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{NAME}:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "", ""]).encode() + http


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Out:
    """Rows on their way out, in batches of about AT_ONCE bytes."""

    def __init__(self, schema: str):
        self.schema, self.rows, self.size = _arrow(schema), [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size + 100

    def batches(self, least: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield _batch(self.rows, self.schema)
            self.rows, self.size = [], 0


class _Stored:
    """What a task has stored of payloads that may be revisited: by digest, the largest page_id and its holder."""

    def __init__(self):
        self.largest: dict[tuple, list[int]] = {}

    def holder(self, page_id: int | None, digest: tuple, own: int) -> int | None:
        """The record whose chunks hold this payload: `own` if it must be stored, None if a larger page_id has it."""
        if page_id is None or digest[0] < MIN_REVISIT:
            return own
        known = self.largest.get(digest)
        if known is None:
            self.largest[digest] = [page_id, own]
            return own
        if page_id > known[0]:
            known[0] = page_id
            return known[1]
        return own if page_id == known[0] else None


class _Payload:
    """A payload passing by in chunks; its rows are held up to HOLD bytes."""

    def __init__(self, archive: int, number: int):
        self.archive, self.number = archive, number
        self.sha, self.more, self.size, self.chunks = hashlib.sha1(), xxhash.xxh64(), 0, 0
        self.held: list[tuple] = []

    def _row(self, data: bytes) -> tuple:
        self.chunks += 1
        return self.archive, 2 * self.number, self.chunks, data, self.sha.hexdigest(), zlib.crc32(data), None, None, None, None, None

    def add(self, data: bytes) -> None:
        if data:
            self.sha.update(data)
            self.more.update(data)
            self.size += len(data)
            self.held.append(self._row(data))

    def finish(self) -> tuple:
        if self.size:
            self.held.append(self._row(END))
        return self.size, self.sha.hexdigest(), self.more.intdigest() - (1 << 63)


def _store(pages: DataFrame, id_col: str, url_col: str, payload_col: str, chunk: int) -> DataFrame:
    """Payload rows and, with chunk 0 and without data, the facts of each record; one scan without an exchange."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.explode(F.expr(f"sequence(1, greatest(1, cast(ceil(octet_length(payload) / {chunk}) as int)))")).alias("k"))
    rows = rows.select("page_id", F.expr("case when k = 1 then url end").alias("url"), "k", F.expr(f"substring(payload, (k - 1) * {chunk} + 1, {chunk})").alias("data"))

    def run(batches):
        archive, out, stored = TaskContext.get().partitionId(), _Out(f"{CHUNKS}, {FACTS}"), _Stored()
        payload, page, url, count = None, None, None, 0

        def finish():
            digest = payload.finish()
            streamed = payload.held[:1] and payload.held[0][2] > 1
            holder = payload.number if streamed else stored.holder(page, digest, payload.number)
            if holder == payload.number:
                for row in payload.held:
                    out.add(row, len(row[3]))
            out.add((archive, 2 * payload.number, 0, None, digest[1], None, page, url, digest[0], digest[2], holder if digest[0] else None), 0)

        for b in batches:
            pages_, urls, numbers = (b.column(k).to_pylist() for k in range(3))
            for i, k in enumerate(numbers):
                if k == 1:
                    if payload:
                        finish()
                    payload, page, url = _Payload(archive, count), pages_[i], urls[i]
                    count += 1
                payload.add(byte_list(b.column(3).slice(i, 1))[0])
                if payload.size > HOLD:
                    for row in payload.held:
                        out.add(row, len(row[3]))
                    payload.held = []
                yield from out.batches()
        if payload:
            finish()
        yield from out.batches(0)

    return rows.mapInArrow(run, f"{CHUNKS}, {FACTS}")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> Archives:
    """One record per row of pages, written to the shared folder."""
    stored = cut(_store(pages, id_col, url_col, payload_col, chunk), "warc-payloads", "zstd")
    facts = stored.where("chunk = 0").select("archive", "record_id", F.col("sha1").alias("digest"), *[x.split()[0] for x in FACTS.split(", ")])
    same = ["size", "digest", "more"]
    first = facts.where(F.col("size") >= MIN_REVISIT).groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # Written, so that both sides of the join have an exchange of their own and a frequent payload's rows can be split.
    joined = facts.join(cut(first, "warc-first"), same, "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))
    joined = joined.withColumn("revisit", revisit)
    # A response takes the number of the record that holds its payload; those of payloads are even.
    place = F.when(F.col("revisit") | F.col("holder").isNull(), F.col("record_id") + 1).otherwise(2 * F.col("holder"))
    joined = joined.select("archive", place.alias("record_id"), "page_id", "url", "size", "digest", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit", F.when(F.col("holder") * 2 == F.col("record_id"), F.col("record_id")).alias("own"))

    def run(batches):
        out = _Out(f"{CHUNKS}, own long")
        empty = hashlib.sha1().hexdigest()
        for b in batches:
            for archive, record, *fields, own in zip(*(c.to_pylist() for c in b.columns)):
                revisit, size = fields[-1], fields[2]
                data = headers(fields[0], record, *fields[1:]) + (END if revisit or not size else b"")
                out.add((archive, record, 0, data, empty, zlib.crc32(data), own), len(data))
            yield from out.batches()
        yield from out.batches(0)

    written = cut(joined.mapInArrow(run, f"{CHUNKS}, own long"), "warc-headers")
    used = written.select("archive", F.col("record_id").alias("own"))
    unused = written.where("own is not null").select("archive", "own").join(used, ["archive", "own"], "left_anti")
    columns = [x.split()[0] for x in CHUNKS.split(", ")]
    return Archives(written.select(*columns), stored.where("chunk > 0").select(*columns), unused.select("archive", F.col("own").alias("record_id")))


def to_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of one record per row of pages, and no others."""
    return compact(write_archives(pages, id_col, url_col, payload_col, chunk))


def compact(archives: Archives) -> DataFrame:
    """All rows that belong to records."""
    unused = cut(archives.unused, "warc-unused")
    if unused.count() <= BROADCAST_ROWS:
        unused = F.broadcast(unused)
    return archives.headers.unionByName(archives.payloads.join(unused, ["archive", "record_id"], "left_anti"))


def parse(head: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload bytes that follow in further rows."""
    top, _, rest = head.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, body = rest.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    follow = int(fields["Content-Length"]) - len(http) - 4
    revisit = fields["WARC-Type"] == "revisit"
    if body != (b"" if follow else END) or follow != (0 if revisit else size):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    page = fields["WARC-Record-ID"].strip("<>").removeprefix(NAME + ":").split(":")[0]
    refers = fields.get("WARC-Refers-To", "").strip("<>").removeprefix(NAME + ":")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return int(page) if page else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(refers) if refers else None, follow


class _Part:
    """Neighbouring chunks of a record; the payload's own SHA-1 is followed if its first chunk is here."""

    def __init__(self, key: tuple[int, int], chunk: int):
        self.key, self.first, self.last, self.size = key, chunk, chunk - 1, 0
        self.sha = hashlib.sha1() if chunk == 1 else None
        self.digest = ""

    def add(self, chunk: int, data: bytes, sha1: str, crc: int) -> None:
        if self.sha:
            before = self.sha.hexdigest()
            if sha1 != before or data != END:
                self.sha.update(data)
                before = self.sha.hexdigest()
        else:
            before = sha1
        if zlib.crc32(data) != crc or sha1 != before:
            raise ValueError(f"chunk {chunk} of record {self.key} is damaged")
        self.last, self.size, self.digest = chunk, self.size + len(data), sha1


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table; chunks are checked as they lie, and only what is known of records is joined."""

    def heads(batches):
        out = _Out(PARSED)
        for b in batches:
            for archive, record, data, crc in zip(*(c.to_pylist() for c in b.columns)):
                if zlib.crc32(data) != crc:
                    raise ValueError(f"the header of record {archive, record} is damaged")
                out.add((archive, record, *parse(data)), 0)
            yield from out.batches()
        yield from out.batches(0)

    def parts(batches):
        out, part = _Out(PARTS), None
        for b in batches:
            archives, records, numbers, shas, crcs = (b.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
            for i, key in enumerate(zip(archives, records)):
                if part is None or part.key != key or numbers[i] != part.last + 1:
                    if part:
                        out.add((*part.key, part.first, part.last, part.size, part.digest), 0)
                    part = _Part(key, numbers[i])
                part.add(numbers[i], byte_list(b.column(3).slice(i, 1))[0], shas[i], crcs[i])
            yield from out.batches()
        if part:
            out.add((*part.key, part.first, part.last, part.size, part.digest), 0)
        yield from out.batches(0)

    found = chunks.where("chunk = 0").select("archive", "record_id", "data", "crc").mapInArrow(heads, PARSED)
    held = chunks.where("chunk > 0").select("archive", "record_id", "chunk", "data", "sha1", "crc").mapInArrow(parts, PARTS).groupBy("archive", "record_id")
    held = held.agg(F.sum("bytes").alias("bytes"), F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.max("last").alias("last"), F.max_by("sha1", "last").alias("sha1"))
    whole = F.expr("(stored = 0 and n is null) or (bytes = stored + 4 and n = last and sha1 = payload_digest)")
    damaged = F.raise_error(F.format_string("record %d of archive %d is damaged", "record_id", "archive"))
    joined = found.join(held, ["archive", "record_id"], "left").withColumn("n_chunks", F.when(F.coalesce(whole, F.lit(False)), 1 + F.coalesce("n", F.lit(0))).otherwise(damaged.cast("long")))
    return joined.where("n_chunks > 0").select(*RECORDS)
