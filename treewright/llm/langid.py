"""Language identification by interpolated Kneser-Ney character models.

Letters and the marks on them are taken as lower-cased code points; any run of other
characters is one space, as are both ends of a text. Texts are read as 4-grams of
these symbols.

fit() counts the 4-grams of every training text by language in one pass (counted in
the tasks, then one aggregation) and writes the counts, which grow with the corpus.
Lower orders use continuation counts of distinct n-grams, as Kneser-Ney does. A
model is sorted arrays of 64-bit hashes, one for each order and for the contexts,
with a log probability (or back-off weight) of every language beside each hash.
All that an n-gram's probability needs shares its two middle symbols but for the
small tables of orders 1 and 2, so a model over SHARD_BYTES is dealt by these symbols
into shards of that size. They are made, broadcast and dropped one after the other;
documents pass all of them, each adding the log probabilities of its own n-grams.

A text gets the language of least cross-entropy per n-gram. Rejection is calibrated
on one training text in CALIBRATION, by a hash, which isn't counted: their mean
cross-entropy under their own language, their spread, and the excess over SIGMAS
standard errors that all but TRIM of them stay within. A text is rejected if its
cross-entropy is over the mean by that excess, MARGIN nats and SIGMAS standard errors
at its length. score is the winner's share after a softmax over the cross-entropies,
weighted by at most FIRM n-grams.

Defined results: null texts and texts without a letter are `und`, score 0,
rejected; ties go to the language first in order; null languages and `und`
aren't learned; without a learned language everything is `und`; a language without
calibration texts is calibrated by all others', and nothing is rejected for its
cross-entropy where there are none; repeated rows are treated alone; no rows give no
rows.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import byte_list, cut, drop, fold_of

SHARD_BYTES = 96 << 20
CALIBRATION = 8
TRIM = 0.005
MARGIN = 0.3
SIGMAS = 4.0
FIRM = 60
#: Characters taken at once; a longer text goes in several parts.
AT_ONCE = 1 << 18
UNKNOWN = "und"
#: Bits of a code point.
BITS = 21
_LOW = np.uint64((1 << BITS) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


@lru_cache(1)
def _symbols() -> np.ndarray:
    """The symbol of every code point: lower-cased letters and marks, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            out[c] = ord(ch.lower()[0])
    return out


def grams(texts: list[bytes | None]):
    """Yield (context of three symbols, symbol, document) of all 4-grams of some texts, as arrays, AT_ONCE characters at a time.

    A text has n-grams only if it has a letter.
    """
    table = _symbols()
    held, docs, size = [], [], 0
    for d, t in enumerate(texts):
        points = np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32)
        tail = np.zeros(3, np.uint32)
        for at in range(0, len(points), AT_ONCE):
            part = table[points[at : at + AT_ONCE]]
            if at + AT_ONCE >= len(points):
                part = np.append(part, np.uint32(0))
            part = part[(part > 0) | (np.concatenate([tail[-1:], part[:-1]]) > 0)]
            if not len(part):
                continue
            held.append(np.concatenate([tail, part]))
            docs.append((d, len(part)))
            size += len(part)
            tail = held[-1][-3:]
            if size >= AT_ONCE:
                yield _grams(held, docs)
                held, docs, size = [], [], 0
    if held:
        yield _grams(held, docs)


def _grams(held: list[np.ndarray], docs: list[tuple[int, int]]):
    flat = np.concatenate(held).astype(np.uint64)
    sizes = np.array([n for _, n in docs])
    starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
    keep = np.ones(len(flat), bool)
    keep[(starts[:, None] + sizes[:, None] + np.arange(3)).ravel()] = False  # windows over two texts
    keep = keep[: len(flat) - 3]
    context = flat[:-3] << np.uint64(2 * BITS) | flat[1:-2] << np.uint64(BITS) | flat[2:-1]
    return context[keep], flat[3:][keep], np.repeat([d for d, _ in docs], sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose upper bits depend on all bits."""
    x = (x ^ x >> np.uint64(32)) * _A
    return (x ^ x >> np.uint64(29)) * _C


def hash4(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _mixed(context * _B + symbol * _C)


def _pair(context: np.ndarray) -> np.ndarray:
    """The two middle symbols of a 4-gram."""
    return context & np.uint64((1 << 2 * BITS) - 1)


class Table:
    """A sorted array of hashes with a row of floats, one for each language, beside each."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)
        self.bits = max(1, len(hashes).bit_length())
        self.starts = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(hashes)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't there."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.hashes):
            return out
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        place, stop = self.starts[bucket], self.starts[bucket + 1]
        live = np.flatnonzero(place < stop)
        place, stop, wanted = place[live], stop[live], hashes[live]
        while len(live):
            hit = self.hashes[place] == wanted
            out[live[hit]] = place[hit]
            on = ~hit & (place + 1 < stop)
            live, place, stop, wanted = live[on], place[on] + 1, stop[on], wanted[on]
        return out


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _order(language: np.ndarray, context: np.ndarray, gram: np.ndarray, n: np.ndarray, discounts: np.ndarray, lower):
    """Interpolated probabilities of all grams and back-off weights of all contexts, by language.

    lower gives the rows of the next lower order for the places (first rows) of distinct grams.
    """
    languages = len(discounts)
    contexts, at = np.unique(context, return_inverse=True)
    total, kinds = np.zeros((len(contexts), languages)), np.zeros((len(contexts), languages))
    np.add.at(total, (at, language), n)
    np.add.at(kinds, (at, language), 1)
    weight = np.where(total > 0, discounts * kinds / np.maximum(total, 1), 1.0)
    keys, first, place = np.unique(gram, return_index=True, return_inverse=True)
    p = weight[at[first]] * lower(first)
    np.add.at(p, (place, language), np.maximum(n - discounts[language], 0) / total[at, language])
    return keys, first, p, contexts, weight


def _distinct(gram: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of both, and how often each occurs."""
    order = np.lexsort((language, gram))
    gram, language = gram[order], language[order]
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (language[1:] != language[:-1])])[: len(gram)])
    return gram[first], language[first].astype(np.int64), np.diff(np.append(first, len(gram))).astype(float)


class Shard:
    """The sorted arrays of some pairs of middle symbols."""

    def __init__(self, low: Low, language: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        self.low = low
        pair = _pair(context)
        three = pair << np.uint64(BITS) | symbol
        # Continuation counts: the distinct 4-grams that end in a 3-gram.
        three3, language3, n3 = _distinct(three, language)
        keys3, _, p3, contexts2, weight2 = _order(language3, three3 >> np.uint64(BITS), three3, n3, low.discounts[3], lambda first: low.p2(three3[first] >> np.uint64(BITS) & _LOW, three3[first] & _LOW))
        place3 = np.searchsorted(keys3, three)
        keys4, _, p4, contexts3, weight3 = _order(language, context, hash4(context, symbol), n.astype(float), low.discounts[4], lambda first: p3[place3[first]])
        self.four, self.three = Table(keys4, np.log(p4)), Table(_mixed(keys3), np.log(p3))
        self.weight3, self.weight2 = Table(_mixed(contexts3), np.log(weight3)), Table(_mixed(contexts2), np.log(weight2))

    def logs(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The log probability of each 4-gram under each language."""
        place = self.four.find(hash4(context, symbol))
        out = self.four.rows[place] if len(self.four.hashes) else np.zeros((len(place), self.low.size), np.float32)
        new = np.flatnonzero(place < 0)
        if len(new):
            context, symbol = context[new], symbol[new]
            pair = _pair(context)
            place = self.three.find(_mixed(pair << np.uint64(BITS) | symbol))
            rows = self.three.rows[place] if len(self.three.hashes) else np.zeros((len(place), self.low.size), np.float32)
            less = np.flatnonzero(place < 0)
            if len(less):
                rows[less] = np.log(self.low.p2(pair[less] & _LOW, symbol[less])) + self._weights(self.weight2, pair[less])
            out[new] = rows + self._weights(self.weight3, context)
        return out

    def _weights(self, table: Table, context: np.ndarray) -> np.ndarray:
        place = table.find(_mixed(context))
        return np.where(place[:, None] < 0, np.float32(0), table.rows[place]) if len(table.hashes) else np.zeros((len(place), self.low.size), np.float32)


class Low:
    """Orders 1 and 2, small as alphabets are, and the discounts of all orders by language."""

    def __init__(self, languages: list[str], rows: list[tuple[str, int, int, int]], discounts: dict[int, dict[str, tuple[int, int]]], symbols: int):
        self.size = len(languages)
        number = {x: k for k, x in enumerate(languages)}
        language = np.array([number[r[0]] for r in rows], np.int64)
        before, symbol, n = (np.array([r[k] for r in rows], np.uint64) for k in (1, 2, 3))
        n = n.astype(float)
        self.discounts = {order: np.array([_discount(*by.get(x, (0, 0))) for x in languages]) for order, by in discounts.items()}
        self.discounts[2] = np.array([_discount((n[language == k] == 1).sum(), (n[language == k] == 2).sum()) for k in range(self.size)])
        symbol1, language1, n1 = _distinct(symbol, language)
        self.discounts[1] = np.array([_discount((n1[language1 == k] == 1).sum(), (n1[language1 == k] == 2).sum()) for k in range(self.size)])
        uniform = 1 / (symbols + 1)  # one more for all symbols that no training text has
        self.symbols, _, self.p1, _, weight = _order(language1, np.zeros(len(symbol1), np.uint64), symbol1, n1, self.discounts[1], lambda first: np.full((len(first), self.size), uniform))
        self.unseen = (weight[0] if len(weight) else np.ones(self.size)) * uniform
        gram = before << np.uint64(BITS) | symbol
        self.grams, _, self.rows, self.contexts, self.weights = _order(language, before, gram, n, self.discounts[2], lambda first: self._p1(symbol[first]))

    def _p1(self, symbol: np.ndarray) -> np.ndarray:
        return self._take(self.symbols, self.p1, symbol, self.unseen)

    @staticmethod
    def _take(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, otherwise) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(otherwise, (len(wanted), len(otherwise))).copy()
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], rows[at], otherwise)

    def p2(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        seen = self._take(self.grams, self.rows, before << np.uint64(BITS) | symbol, np.full(self.size, -1.0))
        weight = self._take(self.contexts, self.weights, before, np.ones(self.size))
        return np.where(seen < 0, weight * self._p1(symbol), seen)


class Verdicts:
    """Languages and the calibration (mean, spread, excess) of each."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.calibration = np.full((len(languages), 3), np.inf)

    def of(self, sums: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        """Language, score, rejected and cross-entropy of texts with these sums of log probabilities over n n-grams."""
        size = len(n)
        if not self.languages:
            return [pa.array([UNKNOWN] * size, pa.string()), pa.array([0.0] * size, pa.float64()), pa.array([True] * size, pa.bool_()), pa.array([None] * size, pa.float64())]
        h = -sums / np.maximum(n, 1)[:, None]
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, FIRM)[:, None]).sum(axis=1)
        mean, spread, excess = self.calibration[best].T
        known = n > 0
        rejected = ~known | (low > mean + excess + MARGIN + SIGMAS * spread / np.sqrt(np.maximum(n, 1)))
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return [pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(rejected), pa.array([x if k else None for x, k in zip(low.tolist(), known.tolist())], pa.float64())]


class Model:
    """The counts (a written table), the low orders, and what verdicts need."""

    def __init__(self, counts: DataFrame, low: Low, languages: list[str], shards: int):
        self.counts, self.low, self.shards = counts, low, shards
        self.verdicts = Verdicts(languages)

    def shard(self, k: int) -> Shard:
        """The k-th shard; at most about SHARD_BYTES of its rows come to the driver."""
        rows = self.counts.where(_shard_of(F.col("context"), self.shards) == k) if self.shards > 1 else self.counts
        found = rows.select("language", "context", "symbol", "n").toArrow()
        language, context, symbol, n = (found.column(c).to_numpy() for c in ("language", "context", "symbol", "n"))
        return Shard(self.low, language.astype(np.int64), context.view(np.uint64), symbol.astype(np.uint64), n)


def _shard_of(context: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(context.bitwiseAND(F.lit((1 << 2 * BITS) - 1))), F.lit(shards))


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, context, symbol, n) of the texts of rows (lang, text)."""

    def count(batches):
        numbers: dict[str, int] = {}
        parts: list[tuple] = []
        held = 0

        def merged():
            hashes, language, context, symbol, n = (np.concatenate(x) for x in zip(*parts))
            _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            return hashes[first], language[first], context[first], symbol[first], np.bincount(at, n).astype(np.int64)

        for b in batches:
            number = np.array([numbers.setdefault(x, len(numbers)) for x in b.column(0).to_pylist()], np.int64)
            for context, symbol, docs in grams(byte_list(b.column(1))):
                language = number[docs]
                hashes = hash4(context, symbol) ^ _mixed(language.astype(np.uint64))
                some, first, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((some, language[first], context[first], symbol[first], n))
                held += len(some)
                if held >= 1 << 20:
                    parts = [merged()]
                    held = 0
        if parts:
            _, language, context, symbol, n = merged()
            names = np.array([*numbers], object)
            for at in range(0, len(n), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(names[language[s]], pa.string()), pa.array(context[s].view(np.int64)), pa.array(symbol[s].astype(np.int32)), pa.array(n[s])], ["lang", "context", "symbol", "n"])

    return rows.mapInArrow(count, "lang string, context long, symbol int, n long").groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> Model:
    """A model of all rows with a language."""
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(f"lang is not null and text is not null and lang <> '{UNKNOWN}'")
    aside = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0
    counts = cut(_counts(rows.where(~aside)), "langid-counts")
    four = counts.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect()  # a row for each language
    languages = sorted(x.lang for x in four)
    mask = F.lit((1 << BITS) - 1)
    three = counts.groupBy("lang", F.col("context").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("pair"), "symbol").agg(F.count("*").alias("n"))
    three = cut(three, "langid-threes")
    three_ones = three.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect()
    two = three.groupBy("lang", F.col("pair").bitwiseAND(mask).alias("before"), "symbol").agg(F.count("*").alias("n")).collect()  # as many as pairs of letters
    low = Low(languages, [tuple(x) for x in two], {4: {x.lang: (x.ones, x.twos) for x in four}, 3: {x.lang: (x.ones, x.twos) for x in three_ones}}, len({x.symbol for x in two}))
    drop(three)
    number = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))]) if languages else None
    numbered = counts.withColumn("language", number[F.col("lang")] if languages else F.lit(0))
    size = sum(x.n for x in four) * (32 + 8 * len(languages))
    model = Model(numbered, low, languages, max(1, math.ceil(size / shard_bytes)))
    if languages:
        _calibrate(model, rows.where(aside))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    own = F.create_map(*[x for k, lang in enumerate(model.verdicts.languages) for x in (F.lit(lang), F.lit(k))])[F.col("lang")]
    scored = _sums(rows.withColumn("own", own).where("own is not null").select("own", F.col("text").alias("_text")), model, 1, False).where("n > 0")
    scored = cut(scored.select("own", "n", (-F.get("sums", F.col("own")) / F.col("n")).alias("h")), "langid-calibration")
    # A row of numbers for each language, and one (null) for all.
    means = {x.own: x.m for x in scored.rollup("own").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    if not means.get(None):
        return
    mean = F.create_map(*[x for k, m in means.items() if k is not None for x in (F.lit(k), F.lit(m))])[F.col("own")]
    excess = F.col("h") - mean
    spreads = {x.own: x.s for x in scored.rollup("own").agg(F.sqrt(F.avg(F.col("n") * excess * excess)).alias("s")).collect()}
    spread = F.create_map(*[x for k, s in spreads.items() if k is not None for x in (F.lit(k), F.lit(s))])[F.col("own")]
    beyond = F.greatest(excess - SIGMAS * spread / F.sqrt("n"), F.lit(0.0))
    limits = {x.own: x.q for x in scored.rollup("own").agg(F.percentile_approx(beyond, 1 - TRIM).alias("q")).collect()}
    for k in range(len(model.verdicts.languages)):
        k_ = k if k in means else None
        model.verdicts.calibration[k] = means[k_], spreads[k_], limits[k_]
    drop(scored)


SUMS = [T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
VERDICT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType())]


def _sums(rows: DataFrame, model: Model, n_keep: int, verdicts: bool) -> DataFrame:
    """rows (n_keep columns, then the text) with verdicts, or with sums (of log probabilities, by language) and n, in place of the text."""
    fields, size = rows.schema.fields, len(model.verdicts.languages)
    spark, written = rows.sparkSession, []
    for k in range(model.shards):
        shared, last = spark.sparkContext.broadcast(model.shard(k)), k + 1 == model.shards
        schema = T.StructType([*fields[:n_keep], *(SUMS if not verdicts else VERDICT)] if last else [*fields[: n_keep + 1], *SUMS])
        rows = rows.mapInArrow(_adder(shared, k, model.shards, size, n_keep, last, model.verdicts if verdicts else None, schema.names), schema)
        if not last:
            rows = cut(rows, "langid-sums")
            shared.destroy()
            for old in written:
                drop(old)
            written = [rows]
    return rows


def _adder(shared, k: int, shards: int, size: int, n_keep: int, last: bool, verdicts: Verdicts | None, names: list[str]):
    def run(batches):
        shard = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = byte_list(part.column(n_keep))
                sums = np.array(part.column(n_keep + 1).to_pylist()).reshape(len(texts), size) if k else np.zeros((len(texts), size))
                n = np.zeros(len(texts), np.int64)
                for context, symbol, docs in grams(texts):
                    n += np.bincount(docs, minlength=len(texts))
                    if shards > 1:
                        mine = np.flatnonzero(_in_shard(_pair(context), shards) == k)
                        context, symbol, docs = context[mine], symbol[mine], docs[mine]
                    if len(docs) and size:
                        starts = np.flatnonzero(np.diff(docs, prepend=-1))
                        sums[docs[starts]] += np.add.reduceat(shard.logs(context, symbol), starts, axis=0, dtype=float)
                if last and verdicts:
                    added = verdicts.of(sums, n)
                else:
                    added = [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * size, sums.ravel()), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*part.columns[: n_keep + (not last)], *added], names)

    return run


def _in_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    """What _shard_of gives for 4-grams with these middle symbols."""
    some, at = np.unique(pair, return_inverse=True)
    return np.array([_signed(xxhash.xxh64_intdigest(int(x).to_bytes(8, "little"), 42)) % shards for x in some.tolist()], np.int64)[at]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep), lang_pred, score, rejected, cross_entropy; a kept column of such a name is replaced."""
    added = [f.name for f in VERDICT]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    inner = [f"k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    return _sums(rows, model, len(keep), True).select(*[F.col(k).alias(c) for k, c in zip(inner, keep)], *added)


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, 5) == 0


def fit_documents(docs: DataFrame) -> Model:
    """A model of the documents with a language that aren't held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))))
