"""Benchmark decontamination with suffix arrays over the training documents.

Words are runs of digits, lower-cased a-z and non-ASCII characters. A task takes
its documents in shards of SHARD_WORDS words and numbers the words by the
benchmark's vocabulary; a suffix can hold a benchmark window only if its first
words are in that vocabulary and their first three are neighbours somewhere in
the benchmark, so the shard's suffix array holds these suffixes alone, sorted by
their first WINDOW words. Every distinct window that starts a test suffix is
binary-searched there; the range found gives all its verbatim places. A place is
then extended word by word through the benchmark's own suffix array, which gives
the longest verbatim match that starts there.

The benchmark goes to the tasks in blocks of BLOCK_BYTES of text, so that what is
broadcast is bounded; documents pass the blocks one after the other without a
shuffle, and no window or match is left out. Most benchmarks are one block and one
pass. With more, each pass is written to the shared folder and its block is dropped
before the next is made, so driver and executors hold one block at a time whatever
the benchmark's size; the price is a pass over the documents for each block.

Defined results: a null or wordless text has no words and no hits; an item
without words matches nothing; an item of fewer words than a window is one
window; repeated items count once by id, null item ids match but aren't listed;
repeated documents are judged row by row; empty tables give no hits or no rows; a
kept column named like hits_col, whatever the case, is replaced by it.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import byte_list, cut, drop, free_name

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(ids, ">u4").view(f"S{4 * ids.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first `depth` numbers (prefix doubling)."""
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while k < depth and rank.max() < len(ids):
        later = np.concatenate([rank[k:], np.zeros(min(k, len(ids)), np.int64)])[: len(ids)]
        key = rank * (len(ids) + 1) + later
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        k *= 2
    return order


class Block:
    """The search side of some benchmark items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if words := tuple(words_of(text)):
                owners.setdefault(words, set()).update([] if item is None else [item])
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for words in owners for w in words}))}
        self.names = sorted(set().union(*owners.values())) if owners else []
        number = {x: k for k, x in enumerate(self.names)}
        self.width = window
        rows: dict[int, list[tuple[int, ...]]] = {}
        holders: dict[int, list[list[int]]] = {}
        seen: dict[tuple[int, ...], int] = {}
        flat, threes = [0], set()
        for words, ids in owners.items():
            numbers = [self.vocabulary[w] for w in words]
            flat += [*numbers, 0]
            m = min(window, len(numbers))
            lead = min(3, m)
            who = [number[x] for x in ids]
            for at in range(len(numbers) - m + 1):
                w = tuple(numbers[at : at + m])
                if w not in seen:
                    seen[w] = len(rows.setdefault(m, []))
                    rows[m].append(w)
                    holders.setdefault(m, []).append([])
                holders[m][seen[w]].extend(who)
                threes.add(w[:lead] + (0,) * (3 - lead))
        self.flat = np.array(flat, np.int64)
        self.order = suffix_array(self.flat, max([0, *map(len, owners)]) + 1)
        self.shortest = min(rows, default=0)
        size = len(self.vocabulary) + 1
        lead = min(3, self.shortest)
        self.lead = lead
        self.starts = np.unique(np.array([self._lead_key(np.array(t[:lead]), size) for t in threes], np.int64))
        self.windows = {}
        for m, found in rows.items():
            ids = np.zeros((len(found), window), np.int64)
            ids[:, :m] = found
            holder = [sorted(set(h)) for h in holders[m]]
            upto = np.concatenate([[0], np.cumsum([len(h) for h in holder])])
            self.windows[m] = ids, upto, np.array([x for h in holder for x in h], np.int64)

    @staticmethod
    def _lead_key(columns, size):
        key = columns[0]
        for c in columns[1:]:
            key = key * size + c
        return key

    def search(self, ids: np.ndarray):
        """Yield (places, number of the window, its length) of every verbatim window in a shard's word numbers."""
        if not self.shortest or len(ids) < self.shortest:
            return
        n, size = len(ids), len(self.vocabulary) + 1
        zeros = np.flatnonzero(ids == 0)
        nxt = np.append(zeros, n)[np.searchsorted(zeros, np.arange(n))]
        run = nxt - np.arange(n)
        places = np.flatnonzero(run >= self.shortest)
        key = self._lead_key([ids[places + k] for k in range(self.lead)], size)
        at = np.searchsorted(self.starts, key)
        at[at == len(self.starts)] = 0
        places = places[self.starts[at] == key]
        if not len(places):
            return
        padded = np.concatenate([ids, np.zeros(self.width, ids.dtype)])
        grid = padded[places[:, None] + np.arange(self.width)]
        grid[np.arange(self.width) >= run[places][:, None]] = 0
        keys = _keys(grid)
        order = np.argsort(keys, kind="stable")
        suffixes, places = keys[order], places[order]
        for m, (rows, _, _) in self.windows.items():
            upper = rows.copy()
            upper[:, m:] = 0xFFFFFFFF
            low, high = np.searchsorted(suffixes, _keys(rows), "left"), np.searchsorted(suffixes, _keys(upper), "right")
            count = high - low
            which = np.repeat(np.arange(len(rows)), count)
            if len(which):
                yield places[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)], which, m

    def longest(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The words that agree with some test suffix from each place on."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.order))
        out, live, k = np.zeros(len(places), np.int64), np.arange(len(places)), 0
        flat = np.append(self.flat, 0)
        while len(live):
            inside = places[live] + k < len(ids)
            want = np.where(inside, ids[np.minimum(places[live] + k, len(ids) - 1)], 0)
            bounds = []
            for side in (want, want + 1):  # the first suffix of the range whose word k is not below it
                a, b = low[live].copy(), high[live].copy()
                while (go := a < b).any():
                    mid = (a + b) // 2
                    word = flat[np.minimum(self.order[np.minimum(mid, len(self.order) - 1)] + k, len(flat) - 1)]
                    below = go & (word < side)
                    a, b = np.where(below, mid + 1, a), np.where(go & ~below, mid, b)
                bounds.append(a)
            on = (want > 0) & (bounds[0] < bounds[1])
            low[live], high[live] = bounds
            live, k = live[on], k + 1
            out[live] = k
        return out


def _merge(old: dict | None, n_words: int, spans: list[tuple[int, int]], longest: int, items: list[str]) -> dict:
    if old:
        spans = sorted([(s["start"], s["stop"]) for s in old["spans"]] + spans)
        longest, items = max(longest, old["longest"]), sorted({*items, *old["items"]})
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return {"n_words": n_words, "n_hit": sum(b - a for a, b in merged), "longest": longest, "spans": [{"start": a, "stop": b} for a, b in merged], "items": items}


def judge(texts: list[bytes | None], block: Block, olds: list[dict | None] | None = None) -> list[dict]:
    """The hits of a shard of texts against one block, merged with those of earlier blocks."""
    get, parts, sizes = block.vocabulary.get, [], []
    for t in texts:
        words = words_of(t)
        sizes.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    spans: dict[int, list[tuple[int, int]]] = {}
    longest: dict[int, int] = {}
    items: dict[int, set[int]] = {}
    for places, which, m in block.search(ids):
        doc = np.searchsorted(begin, places, "right") - 1
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + m, -1)
        cover = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(cover == 1).tolist(), np.flatnonzero(cover == -1).tolist()):
            d = int(np.searchsorted(begin, a, "right")) - 1
            spans.setdefault(d, []).append((a - int(begin[d]), b - int(begin[d])))
        for d, k in zip(doc.tolist(), block.longest(ids, places).tolist()):
            longest[d] = max(longest.get(d, 0), k)
        _, upto, holder = block.windows[m]
        pair = np.unique(doc * len(upto) + which)
        for d, w in zip((pair // len(upto)).tolist(), (pair % len(upto)).tolist()):
            items.setdefault(d, set()).update(holder[upto[w] : upto[w + 1]].tolist())
    return [_merge(olds[d] if olds else None, n, sorted(spans.get(d, [])), longest.get(d, 0), [block.names[x] for x in sorted(items.get(d, ()))]) for d, n in enumerate(sizes)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    items, held = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        data = None if text is None else text.encode()
        items.append((item, data))
        held += len(data or b"") + 32
        if held >= block_bytes:
            yield items
            items, held = [], 0
    yield items


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", hits_col: str = "hits", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns (or those in keep) and hits_col: n_words, n_hit, the longest verbatim match, hit word spans, item ids."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != hits_col.lower()]
    inner = [f"k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = (items for items in _blocks(benchmark, item_col, item_text_col, block_bytes) if any(words_of(t) for _, t in items))
    items, written = next(blocks, []), []
    while items is not None:
        shared, later = spark.sparkContext.broadcast(Block(items, window)), next(blocks, None)
        rows = _pass(rows, shared, len(keep))
        if later is not None:
            rows = cut(rows, "decontam-pass")
            shared.destroy()
            for old in written:
                drop(old)
            written = [rows]
        items = later
    return rows.select(*[F.col(k).alias(c) for k, c in zip(inner, keep)], F.col("hits").alias(hits_col))


def _pass(rows: DataFrame, block, n_keep: int) -> DataFrame:
    """rows, the last of whose columns are text and perhaps hits, with hits that count this block too."""
    fields = rows.schema.fields[: n_keep + 1]
    schema = T.StructType([*fields, T.StructField("hits", HITS)])
    arrow_hits = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])
    names = [*schema.names]

    def run(batches):
        index = block.value
        for b in batches:
            at = 0
            while at < b.num_rows:  # shards of bounded size; a single text may be larger
                to, held = at, 0
                sizes = b.column(n_keep)
                texts = []
                while to < b.num_rows and held < SHARD_WORDS * 6:
                    texts += byte_list(sizes.slice(to, 1))
                    held += len(texts[-1] or b"")
                    to += 1
                part = b.slice(at, to - at)
                olds = part.column(n_keep + 1).to_pylist() if part.num_columns > n_keep + 1 else None
                hits = pa.array(judge(texts, index, olds), arrow_hits)
                yield pa.RecordBatch.from_arrays([*part.columns[: n_keep + 1], hits], names)
                at = to

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """docs without the rows that hold a benchmark window."""
    hits = free_name(docs, "_found")
    return find_hits(docs, benchmark, text_col, hits_col=hits, **more).where(F.col(hits)["n_hit"] == 0).drop(hits)


_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

HITS_SQL = f"""
item_words as (select item_id, {_FOLDED} as w from benchmark
), item_windows as (
  select distinct item_id, m, w[i:i + m - 1] as g
  from (select item_id, w, least({WINDOW}, len(w)) as m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as i from item_words where len(w) > 0)
), doc_words as (select doc_id, {_FOLDED} as w from {{docs}}
), doc_windows as (
  select doc_id, m, i, w[i:i + m - 1] as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from doc_words, (select distinct m from item_windows) where len(w) >= m)
), found as (select doc_id, i, m, item_id from doc_windows join item_windows using (m, g)
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)"""

ORACLE = f"""with {HITS_SQL.format(docs="documents")}
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit using (doc_id) left join items using (doc_id)"""
