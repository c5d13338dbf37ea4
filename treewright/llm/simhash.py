"""SimHash near-duplicate groups by bit-sliced comparison.

A fingerprint sets each of 64 bits that is set in over half the XXH64 hashes of
a text's word shingles. Equal fingerprints form one class first, so exact copies
cost one row. Two classes link at `radius` differing bits or fewer.

Candidates: 64 bits in `radius + 2` blocks; two fingerprints within the radius
agree on at least two whole blocks, so each class is filed under every pair of
blocks. A bucket over BUCKET rows is filed again by pairs of blocks of its other
bits, and a bucket that is still larger is dealt into chunks that meet pairwise:
every candidate pair is compared, no bucket is capped, and no task holds more
than two chunks.

Comparison: a task keeps a run of sorted buckets as 64 vertical bit planes. One
query against 64 stored fingerprints is one word operation; three planes at a
time go through a carry-save adder into bitwise counters, and a word is
abandoned once all its lanes exceed the radius.

Links of a task leave it as a spanning forest. Components come from alternating
large-star and small-star rounds on class representatives (smallest doc_id),
each round written to the shared folder.

Defined results: a null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle make one hash; repeated rows come back once
per row; rows with a null id never bridge two classes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import byte_list, cut, drop

SEED = 42
SHINGLE = 4
RADIUS = 4
BUCKET = 4096
#: Shingles hashed at once, so that a very long text needs bounded memory.
HASHED_AT_ONCE = 1 << 17
#: Query-word pairs compared at once.
ITEMS = 1 << 16
#: Rows of sorted buckets compared at once, and what is left of the last bucket.
FLUSH = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text; A-Z are lower-cased first."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(start), HASHED_AT_ONCE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(start[at : at + HASHED_AT_ONCE], end[at : at + HASHED_AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(start)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in byte_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of the given bit numbers, sizes differing by one at most."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def masks(radius: int, within: int = 0) -> list[int]:
    """Masks of every pair of blocks of the bits that `within` lacks; two values within the radius agree on one at least."""
    bits = [b for b in range(64) if not within >> b & 1]
    return [within | a | b for a, b in combinations(_blocks(bits, radius + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(fp: np.ndarray, end: np.ndarray, radius: int):
    """Yield arrays (i, j): i < j < end[i] whose fp differ in at most radius bits.

    fp is an uint64 array, end[i] the first row after i's bucket.
    """
    n = len(fp)
    words = (n + 63) // 64
    planes = np.zeros((64, words), np.uint64)
    for p in range(64):
        bits = np.zeros(words * 64, np.uint8)
        bits[:n] = (fp >> np.uint64(p)) & np.uint64(1)
        planes[p] = np.packbits(bits, bitorder="little").view(np.uint64)
    rows = np.arange(n)
    first, last = (rows + 1) >> 6, (end - 1) >> 6
    per_row = np.where(end > rows + 1, last - first + 1, 0)
    upto = np.concatenate([[0], np.cumsum(per_row)])
    at = 0
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + ITEMS, "right")) - 1)
        query = np.repeat(rows[at:to], per_row[at:to])
        if len(query):
            word = first[query] + np.arange(len(query)) - (upto[query] - upto[at])
            live = np.full(len(query), full)
            low = np.clip(query + 1 - word * 64, 0, 63).astype(np.uint64)
            live &= full << low
            high = np.clip(word * 64 + 64 - end[query], 0, 63).astype(np.uint64)
            live &= full >> high
            yield from _compare(planes, fp, query, word, live, radius)
        at = to


def _compare(planes, fp, query, word, live, radius):
    zero, full = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.zeros(len(query), np.uint64) for _ in range((radius + 3).bit_length())]
    mine = fp[query]
    for p in range(0, 64, 3):
        x = [planes[q][word] ^ (zero - ((mine >> np.uint64(q)) & np.uint64(1))) for q in range(p, min(p + 3, 64))]
        if len(x) == 3:  # carry-save adder: three bits of weight 1 become a sum and a carry
            half = x[0] ^ x[1]
            add = [half ^ x[2], (x[0] & x[1]) | (half & x[2])]
        else:
            add = [x[0]]
        for weight, bits in enumerate(add):
            for k in range(weight, len(counters)):
                counters[k], bits = counters[k] ^ bits, counters[k] & bits
        over, equal = np.zeros_like(live), np.full_like(live, full)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                over |= equal & counters[k]
                equal &= ~counters[k]
        live &= ~over
        left = np.flatnonzero(live)
        if len(left) * 4 < len(live) * 3:  # abandoned words leave the work list
            query, word, live, mine = query[left], word[left], live[left], mine[left]
            counters = [c[left] for c in counters]
        if not len(left):
            return
    for lane in range(64):
        hit = np.flatnonzero(live >> np.uint64(lane) & np.uint64(1))
        if len(hit):
            yield query[hit], word[hit] * 64 + lane


def components(n: int, pairs) -> np.ndarray:
    """The smallest node of each of n nodes' components, from an iterable of (u, v) arrays."""
    label = np.arange(n)
    for u, v in pairs:
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jump := label[label], label):
                label = jump
    return label


def _links(radius: int):
    """mapInArrow over rows sorted by bucket: (fp, rep, bucket columns) to forest edges (u, v) of representatives."""

    def forest(columns, edge):
        fp, rep = columns[0].view(np.uint64), columns[1]
        starts = np.concatenate([[0], edge])
        end = np.repeat(np.append(edge, len(fp)), np.diff(np.append(starts, len(fp))))
        label = components(len(fp), within_radius(fp, end, radius))
        tied = np.flatnonzero(label != np.arange(len(fp)))
        u, v = rep[tied], rep[label[tied]]
        apart = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], ["u", "v"])

    def run(batches):
        held, waiting, rows = None, [], 0
        for b in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows < FLUSH:
                continue
            held = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)]
            waiting, rows = [], 0
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[2:]], axis=0)) + 1
            if len(edge):  # the last bucket may go on in the next batch
                to = edge[-1]
                yield forest([k[:to] for k in held], edge[:-1])
                held = [k[to:] for k in held]
        held = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)]
        if held and len(held[0]):
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[2:]], axis=0)) + 1
            yield forest(held, edge)

    return run


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between representatives whose components are those of all links. classes: (fp, rep), fp distinct."""
    spark = classes.sparkSession
    first = masks(radius)
    rows = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(first)])).alias("b"))
    rows = rows.select("fp", "rep", "b.mask", "b.key")

    def large(rows: DataFrame) -> DataFrame | None:
        sizes = cut(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "simhash-large")
        return None if sizes.isEmpty() else sizes

    parts = []
    sizes = large(rows)
    if sizes is None:
        parts.append(rows.withColumn("pair", F.lit(0)))
    else:
        marked = rows.join(sizes, ["mask", "key"], "left")
        parts.append(marked.where("n is null").select("fp", "rep", "mask", "key", F.lit(0).alias("pair")))
        finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks(radius, within)]) for within in first])
        again = marked.where("n is not null").select("fp", "rep", "mask", F.posexplode(F.element_at(finer, F.col("mask") + 1)).alias("k", "finer"))
        again = again.select("fp", "rep", (F.col("mask") * 1000 + 1000 + F.col("k")).alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        sizes = large(again)
        if sizes is None:
            parts.append(again.withColumn("pair", F.lit(0)))
        else:
            marked = again.join(sizes, ["mask", "key"], "left")
            parts.append(marked.where("n is null").select("fp", "rep", "mask", "key", F.lit(0).alias("pair")))
            chunks = F.ceil(F.col("n") / bucket).cast("int")
            dealt = marked.where("n is not null").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            parts.append(dealt.select("fp", "rep", "mask", "key", (F.least("c", "d") * F.col("chunks") + F.greatest("c", "d")).cast("int").alias("pair")))
    out = None
    for part in parts:
        run = part.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair", "fp").mapInArrow(_links(radius), "u long, v long")
        out = run if out is None else out.unionByName(run)
    return out.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (u, v) but the roots, with its component's smallest node."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "simhash-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "simhash-edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs; see the module."""
    own = cut(fingerprints(docs, id_col, text_col, shingle), "simhash-own")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    star = stars(links(classes.where("rep is not null"), radius, bucket))
    named = classes.join(star, classes["rep"] == star["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
