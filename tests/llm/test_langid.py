import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treewright.llm import langid

STEMS = {"aa": ["the", "of", "tion", "ing", "wh"], "bb": ["sch", "ung", "der", "keit", "über"], "cc": ["los", "ción", "que", "ñar", "mente"]}


def text(r, lang, k=40):
    return ". ".join("".join(r.choices(STEMS[lang], k=r.randrange(1, 4))).capitalize() for _ in range(k))


def rows(n=240):
    r = random.Random(6)
    langs = [r.choice(list(STEMS)) for _ in range(n)]
    return [(i, text(r, x), x) for i, x in enumerate(langs)]


def plain_grams(t):
    marks = [ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" else 0 for c in t]
    flat = []
    for m in [*marks, 0]:
        if m or (flat and flat[-1]):
            flat.append(m)
    flat = [0, 0, 0, *flat]
    return [tuple(flat[i : i + 4]) for i in range(len(flat) - 3)] if any(marks) else []


class Plain:
    """Interpolated Kneser-Ney by its definition, in dictionaries."""

    def __init__(self, texts, symbols):
        self.symbols = symbols
        self.counts = {4: Counter(g for t in texts for g in plain_grams(t))}
        for order in (3, 2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discounts, self.contexts = {}, {}
        for order, counts in self.counts.items():
            ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
            self.discounts[order] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.contexts[order] = {}
            for g, n in counts.items():
                total, kinds = self.contexts[order].get(g[:-1], (0, 0))
                self.contexts[order][g[:-1]] = total + n, kinds + 1

    def p(self, gram):
        if not gram:
            return 1 / (self.symbols + 1)
        total, kinds = self.contexts[len(gram)].get(gram[:-1], (0, 0))
        lower = self.p(gram[1:])
        if not total:
            return lower
        d, n = self.discounts[len(gram)], self.counts[len(gram)][gram]
        return max(n - d, 0) / total + d * kinds / total * lower


def test_grams_equal_the_definition(monkeypatch):
    r = random.Random(2)
    texts = ["", "12 !", "a", " Ab  c'd é\n", "日本語 text", "x" * 50, "кий ії", "e\u0301a"] + ["".join(r.choices("ab É1 я", k=r.randrange(30))) for _ in range(60)]
    expected = [(g, d) for d, t in enumerate(texts) for g in plain_grams(t)]
    for size in (1 << 20, 7):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        got = []
        for context, symbol, docs in langid.grams([t.encode() for t in texts]):
            for c, s, d in zip(context.tolist(), symbol.tolist(), docs.tolist()):
                got.append(((c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF, s), d))
        assert got == expected


def test_tables_find_what_they_hold():
    r = np.random.default_rng(4)
    for size in (0, 1, 2, 1000):
        hashes = np.unique(r.integers(0, 1 << 64, size, np.uint64))
        table = langid.Table(hashes, np.arange(len(hashes))[:, None])
        assert table.find(hashes).tolist() == list(range(len(hashes)))
        assert set(table.find(r.integers(0, 1 << 64, 50, np.uint64)).tolist()) <= {-1}


@pytest.mark.parametrize("shard_bytes", [langid.SHARD_BYTES, 8000])
def test_entropies_equal_brute_force(spark, shard_bytes):
    data = [x for x in rows(60)] + [(500, "привіт світе її єдиний", "dd"), (501, "привет мир ещё один этот", "ee")] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    aside = {x.text for x in docs.where(F.pmod(F.xxhash64("text"), F.lit(langid.CALIBRATION)) == 0).collect()}
    learned = [x for x in data if x[1] not in aside]
    names = sorted({x[2] for x in learned})
    symbols = len({g[3] for _, t, _ in learned for g in plain_grams(t)})
    models = [Plain([t for _, t, k in learned if k == name], symbols) for name in names]
    model = langid.fit(docs, shard_bytes=shard_bytes)
    assert (model.shards > 1) == (shard_bytes < langid.SHARD_BYTES)
    asked = [*data[:25], (900, "ўвага ієрогліф 漢字 the of", None), (901, "zzz qqq xk", None), (902, None, None), (903, "the " * 2000, None)]
    got = langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    for x in got:
        found = plain_grams(x.text or "")
        if not found:
            assert (x.lang_pred, x.score, x.rejected, x.cross_entropy) == ("und", 0.0, True, None)
            continue
        h = [-sum(math.log(m.p(g)) for g in found) / len(found) for m in models]
        assert abs(x.cross_entropy - min(h)) < 1e-4 and x.lang_pred == names[h.index(min(h))]
        assert abs(x.score - 1 / sum(math.exp(-(y - min(h)) * min(len(found), langid.FIRM)) for y in h)) < 1e-3
    for m in models:  # probabilities of all symbols and of one unseen sum to one
        for context in list(m.contexts[4])[:5] + [(1, 2, 3)]:
            known = {g[3] for x in models for g in x.counts[4]}
            assert abs(sum(m.p((*context, s)) for s in known) + m.p((*context, -1)) - 1) < 1e-9


def test_letters_of_other_scripts_tell_languages_apart(spark):
    r = random.Random(13)
    alphabets = {"ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "zh": "".join(map(chr, range(0x4E00, 0x4E40))), "ja": "".join(map(chr, range(0x3041, 0x3090)))}
    say = lambda k: " ".join("".join(r.choices(alphabets[k], k=r.randrange(2, 8))) for _ in range(30))
    data = [(i, say(k), k) for i, k in enumerate(r.choices(list(alphabets), k=160))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs.where("doc_id % 4 > 0")))
    assert got.where("lang_pred = lang and not rejected").count() == 160


def test_held_out_accuracy_rejection_and_odd_texts(spark):
    data = rows()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 -- !", None), (903, "zxqj vkxz qqjx zzkq " * 20, None), (904, "the of", None), (0, data[0][1], data[0][2])]
    docs = spark.createDataFrame([(*x, 0.5) for x in data + odd], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs.where(F.col("doc_id") % 3 > 0))
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected", "cross_entropy"]
    by = {x.doc_id: x for x in got.collect()}
    assert len(by) == len(data) + 5 and got.count() == len(data) + 6
    assert all(by[i].lang_pred == lang and not by[i].rejected and 0.9 < by[i].score <= 1 for i, _, lang in data)
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert [by[k].score for k in (900, 901, 902)] == [0.0] * 3
    assert all(by[k].rejected for k in (900, 901, 902, 903))
    assert by[903].lang_pred in STEMS and by[904].lang_pred == "aa"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert [(x.lang_pred, x.score, x.rejected) for x in got] == [("und", 0.0, True)]
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0
