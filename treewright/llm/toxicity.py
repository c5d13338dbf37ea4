"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

fold() lower-cases a text, maps homoglyphs of other scripts to Latin letters,
reads digits and signs inside words as the letters they stand for (l, 1, ! and |
all become i, in texts and lexicon alike), drops invisible characters and leaves
words separated by single spaces. Lexicon terms are word beginnings (" term") or
whole words (" term "); one automaton finds all of them and the exception
phrases, whose span hides the terms inside. The evidence of a text is the sum of
its hits' weights over its number of words, and a logistic curve turns evidence
and hits into a score.

fit() learns from at most FIT_ROWS labelled rows, chosen by a hash of their ids and
written once; that bounds all that comes to the driver, and nothing else is cut.
Terms whose document frequency in toxic rows is far above that in clean rows are
candidates; they are taken greedily, each toxic row counting half as much for
every term that already covers it, so that chance words of copied rows add
nothing. Phrases of a term and a neighbour that occur in clean rows alone become
exceptions. SEED words are in the lexicon unless the rows speak against them.

Defined results: null, empty and wordless texts have no hits and get the score
of none; rows without a label or with a null id teach nothing, several labels of
one id count as toxic if one is, and of several documents of one id the first by a
hash of the text teaches; without labels the curve is a fixed prior;
repeated rows are scored alike; no rows give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut, drop, fold_of, free_name

FIT_ROWS = 20_000
MIN_LOG_ODDS = 2.5
THRESHOLD = 0.7
#: What a word's beginning is worth beside the whole word with the same rows.
BEGINNING = 0.9

#: Insults that need no labelled rows.
SEED = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "imbecile")
#: Cyrillic and Greek letters that look like Latin ones, and the latter.
HOMOGLYPHS = ("авеікмнорстухѕјԁһԛԝɡαβεικνορτυχ", "abeikmhopctyxsjdhqwgabeikvoptux")
#: Digits and signs that stand for letters inside words, and these.
STAND_INS = ("013457@$!|", "oieastasii")
INVISIBLE = "­​‌‍⁠﻿"

_LETTERS = str.maketrans(dict(zip(*HOMOGLYPHS)) | {"l": "i"} | dict.fromkeys(INVISIBLE))
_SIGNS = str.maketrans(*STAND_INS)
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]*+(?:\d|[@$!|](?=[^\W\d_]))[\w@$!|]*")
_GAP = re.compile(r"[\W\d_]+")


def _unmask(m: re.Match) -> str:
    word = m[0]
    core = word.rstrip("@$!|")
    return core.translate(_SIGNS) + " " if any(c.isalpha() for c in core) else word


def fold(text: str | None) -> str:
    """Folded words, each between single spaces; a space alone if there is none."""
    if not text:
        return " "
    text = text.lower().translate(_LETTERS)
    if _MIXED.search(text):
        text = _MIXED.sub(_unmask, text).translate(_LETTERS)
    text = _GAP.sub(" ", text).strip()
    return f" {text} " if text else " "


class Lexicon:
    """Terms with weights, exception phrases and the curve (constant, evidence, hits)."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), curve: tuple[float, float, float] = (-3.0, 1.5, 2.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        if len(out):
            out.make_automaton()
        return out

    def hits(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, stop, weight) of each term outside all exceptions."""
        if not len(automaton):
            return []
        found, hidden = [], []
        for last, (n, weight) in automaton.iter(folded):
            (hidden if weight is None else found).append((last + 1 - n, last + 1, weight))
        if hidden and found:
            found.sort()
            hidden.sort()
            out, reach, k = [], -1, 0  # reach: where the hidden spans that have begun end at the latest
            for hit in found:
                while k < len(hidden) and hidden[k][0] <= hit[0]:
                    reach = max(reach, hidden[k][1])
                    k += 1
                if hit[1] > reach:
                    out.append(hit)
            return out
        return found

    def features(self, folded: str, automaton) -> tuple[float, float]:
        hits = self.hits(folded, automaton)
        if not hits:
            return 0.0, 0.0
        return math.log1p(100 * sum(h[2] for h in hits) / (folded.count(" ") - 1)), math.log1p(len(hits))

    def scores(self, texts: list[str | None], automaton) -> list[float]:
        out = []
        for t in texts:
            evidence, hits = self.features(fold(t), automaton)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * evidence + self.curve[2] * hits)))))
        return out


def lengths(size: int) -> list[int]:
    """Those of a word's beginnings: all from 3 to 16 letters, then powers of two, so that they take linear space."""
    return [*range(3, min(size, 16) + 1), *(1 << k for k in range(5, size.bit_length()))]


def terms_of(folded: str) -> set[str]:
    """The beginnings of every word, and the words."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(" " + word[:n] for n in lengths(len(word)))
    return out


def _candidates(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(term, toxic rows, clean rows) of terms far more frequent in toxic rows."""

    def count(batches):
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if label else clean).update(terms_of(fold(text)))
            names = list(toxic | clean)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], ["term", "pos", "neg"])

    total = {x.toxic: x.n for x in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    counted = rows.select("text", "toxic").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(pos + 1)) - F.log((F.col("neg") + 0.5) / F.lit(neg + 1))
    least = max(3, pos // 200)
    found = counted.where((F.col("pos") >= least) & (odds >= MIN_LOG_ODDS))
    return sorted(((x.term, x.pos, x.neg) for x in found.collect()), key=lambda x: (-x[1], len(x[0]), x[0]))


def _phrases(folded: str, hits) -> set[str]:
    """The words around each hit: it and the word before, it and the word after."""
    around = set()
    for a, z, _ in hits:
        end = folded.index(" ", max(z - 1, a + 1))
        before, after = folded.rfind(" ", 0, a), folded.find(" ", end + 1)
        if before >= 0:
            around.add(folded[before : end + 1])
        if after > 0:
            around.add(folded[a : after + 1])
    return around


def _clean_phrases(rows: DataFrame, terms: list[str]) -> set[str]:
    """Phrases around the terms that are in three clean rows or more and in no toxic one."""
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            bad, good = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(text)
                (bad if label else good).update(_phrases(folded, lexicon.hits(folded, automaton)))
            names = list(bad | good)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([bad[x] for x in part], pa.int64()), pa.array([good[x] for x in part], pa.int64())], ["phrase", "bad", "good"])

    counted = rows.select("text", "toxic").mapInArrow(run, "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return {x.phrase for x in counted.where("good >= 3 and bad = 0").select("phrase").collect()}


class Seen:
    """A labelled row: label, words, and how often each term occurs."""

    def __init__(self, toxic: int, words: int, terms: dict[int, int]):
        self.toxic, self.words, self.terms = toxic, words, terms


def _occurrences(rows: DataFrame, terms: list[str], exceptions: set[str] = frozenset()) -> list[Seen]:
    """Every labelled row, its terms by number; at most one count for each term and row."""
    lexicon = Lexicon(dict.fromkeys(terms, 1.0), exceptions)
    number = {t: k for k, t in enumerate(terms)}

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            out = []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(text)
                counts = Counter(number[folded[a:z]] for a, z, _ in lexicon.hits(folded, automaton))
                out.append({"toxic": label, "words": folded.count(" ") - 1, "terms": list(counts), "counts": list(counts.values())})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("toxic", pa.int32()), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]))

    found = rows.select("text", "toxic").mapInArrow(run, "toxic int, words long, terms array<int>, counts array<long>").toArrow()
    return [Seen(x["toxic"], x["words"], dict(zip(x["terms"], x["counts"]))) for x in found.to_pylist()]


def _greedy(candidates: list[tuple[str, int, int]], rows) -> list[int]:
    """Numbers of the terms taken."""
    holders: dict[int, list[int]] = {}
    toxic = [r for r in rows if r.toxic]
    for d, r in enumerate(toxic):
        for k in r.terms:
            holders.setdefault(k, []).append(d)
    clean = Counter(k for r in rows if not r.toxic for k in r.terms)
    weight = np.ones(len(toxic))
    held = {k: np.array(v) for k, v in holders.items()}
    least = max(1.2, len(toxic) / 400)
    taken: list[int] = []

    def worth(k: int) -> float:  # a beginning must be clearly better than a whole word
        return (weight[held[k]].sum() - 3 * clean[k]) * (1 if candidates[k][0].endswith(" ") else BEGINNING)

    heap = [(-worth(k), -len(candidates[k][0]), candidates[k][0], k) for k in held]
    heapq.heapify(heap)
    names: set[str] = set()
    begun: set[str] = set()  # all beginnings of names
    while heap:
        gain, length, term, k = heapq.heappop(heap)
        if term in begun or any(term[:n] in names for n in range(1, len(term))):
            continue
        fresh = worth(k)
        if fresh < -gain - 1e-9:
            heapq.heappush(heap, (-fresh, length, term, k))
            continue
        if fresh < least:
            break
        taken.append(k)
        names.add(term)
        begun.update(term[:n] for n in range(1, len(term) + 1))
        weight[held[k]] /= 2
    return taken


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        penalty = np.diag([0.01, 0.05, 0.05])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, seed: tuple[str, ...] = SEED) -> Lexicon:
    """A lexicon learned from at most fit_rows labelled rows."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    one = one.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(one), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = cut(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxicity-sample")
    seeds = [f" {fold(w).strip()} " for w in seed]
    candidates = _candidates(rows)
    known = {t for t, _, _ in candidates}
    candidates += [(t, 0, 0) for t in seeds if t not in known]
    terms = [t for t, _, _ in candidates]
    found = _occurrences(rows, terms)
    n_toxic = sum(r.toxic for r in found)
    taken = _greedy(candidates, found)
    chosen = {terms[k] for k in taken} | set(seeds)
    exceptions = {p for p in _clean_phrases(rows, terms) if any(t.strip() in p for t in chosen)}
    if exceptions:  # counted anew, without what they hide
        found = _occurrences(rows, terms, exceptions)
    drop(rows)
    toxic, clean = Counter(k for r in found if r.toxic for k in r.terms), Counter(k for r in found if not r.toxic for k in r.terms)
    odds = lambda k: math.log((toxic[k] + 0.5) / (n_toxic + 1)) - math.log((clean[k] + 0.5) / (len(found) - n_toxic + 1))
    weights = {terms[k]: odds(k) for k in taken}
    for k, term in enumerate(terms):
        if term in seeds and not any(term.startswith(t) for t in weights) and (not clean[k] or odds(k) >= MIN_LOG_ODDS):
            weights[term] = max(MIN_LOG_ODDS, odds(k)) if toxic[k] else MIN_LOG_ODDS
    lexicon = Lexicon(weights, exceptions)
    if 0 < n_toxic < len(found):
        x = np.zeros((len(found), 2))
        for d, r in enumerate(found):
            hits = [(k, n) for k, n in r.terms.items() if terms[k] in weights]
            if hits:
                x[d] = math.log1p(100 * sum(n * weights[terms[k]] for k, n in hits) / r.words), math.log1p(sum(n for _, n in hits))
        lexicon.curve = _curve(x, np.array([r.toxic for r in found], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep), score and predicted; a kept column of such a name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    own = free_name(docs, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(own))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        automaton = lexicon.automaton()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                scores = lexicon.scores(part.column(len(keep)).to_pylist(), automaton)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, 3) == 1


def fit_documents(docs: DataFrame, labels: DataFrame, **more) -> Lexicon:
    """A lexicon of the labelled documents that aren't held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))), **more)
