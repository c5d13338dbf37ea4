import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from treewright.llm import toxicity


def rows(n=700):
    r = random.Random(9)
    words = ["".join(r.choices(["ba", "do", "ki", "ru", "mé", "sil"], k=3)) for _ in range(400)]
    bad = ["grobnik", "vlastul", "idiot", "zmerkó"]
    out, labels = [], []
    for i in range(n):
        text = r.choices(words, k=r.randrange(5, 120))
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(bad))
        elif r.random() < 0.02:
            text += ["vlastul", "kapital"]
        out.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return out, labels


def test_fold():
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" 12 -") == " "
    same = toxicity.fold("loser, IDIOT")
    assert same == " ioser idiot "
    for text in ("l0s3r 1d1ot", "LOSER... іԁіоt", "lo$er id!ot", "los​er\n1D10T"):
        assert toxicity.fold(text) == same
    assert toxicity.fold("over 9000!") == " over "


def test_held_out_accuracy_and_exceptions(spark):
    data, labels = rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (99999, 1), (0, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks.where("doc_id % 3 > 0"))
    assert " grobnik " in lexicon.weights and any("kapitai" in p for p in lexicon.exceptions)
    scored = toxicity.score(docs, lexicon)
    assert scored.columns == ["doc_id", "text", "score", "predicted"]
    got = {x.doc_id: x for x in scored.collect()}
    wrong = [d for d, y in labels if got[d].predicted != y]
    assert len(wrong) <= 5
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "badoki mémé gr0bnik"), (4, "dobaki " * 30000), (2, "")], "doc_id long, text string")
    odd = {x.doc_id: x for x in toxicity.score(extra, lexicon).collect()}
    assert [odd[k].predicted for k in (1, 2, 3, 4)] == [0, 0, 1, 0]
    assert odd[1].score == odd[2].score and all(0 <= x.score <= 1 for x in odd.values())
    assert toxicity.score(extra, lexicon).count() == 5


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you stupid moron"), (2, "fine words")], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.doc_id: x.predicted for x in toxicity.score(docs, lexicon).collect()} == {1: 1, 2: 0}
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_hits_equal_plain_search():
    r = random.Random(3)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc ": 2.0, " b ": 3.0}, {" b ab ", " c b "})
    automaton = lexicon.automaton()
    for _ in range(300):
        folded = toxicity.fold(" ".join("".join(r.choices("abc", k=r.randrange(1, 4))) for _ in range(r.randrange(9))))
        find = lambda t: [(a, a + len(t)) for a in range(len(folded)) if folded.startswith(t, a)]
        hidden = [s for p in lexicon.exceptions for s in find(p)]
        plain = sorted((a, b, w) for t, w in lexicon.weights.items() for a, b in find(t) if not any(x <= a and b <= y for x, y in hidden))
        assert sorted(lexicon.hits(folded, automaton)) == plain


def test_many_hits_in_one_text_take_linear_time():
    lexicon = toxicity.Lexicon({" ab": 1.0}, {" c ab "})
    automaton = lexicon.automaton()
    start = time.time()
    folded = toxicity.fold("c ab ab " * 200000)
    assert len(lexicon.hits(folded, automaton)) == 200000
    assert time.time() - start < 20


def test_beginnings_of_any_length():
    assert toxicity.lengths(2) == [] and toxicity.lengths(5) == [3, 4, 5]
    assert toxicity.lengths(70) == [*range(3, 17), 32, 64]
    assert sum(map(len, toxicity.terms_of(toxicity.fold("x" * 1_000_000)))) < 4_000_000


def test_weights_curve_and_scores_equal_brute_force(spark):
    data, labels = rows(400)
    docs = spark.createDataFrame([*data, (3, "another text of the same id"), (5, data[5][1])], "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), seed=())
    first = {d: t for d, t in data}
    same = docs.where("doc_id = 3").select("text", F.xxhash64("text").alias("h")).orderBy("h").first()
    first[3] = same.text
    folded = [(toxicity.fold(first[d]), y) for d, y in labels]

    def hits(t):  # every place of every term that no exception covers
        hidden = [(a, a + len(p)) for p in lexicon.exceptions for a in range(len(t)) if t.startswith(p, a)]
        return [w for w in lexicon.weights for a in range(len(t)) if t.startswith(w, a) and not any(x <= a and a + len(w) <= y for x, y in hidden)]

    found = [(hits(t), y, len(t.split())) for t, y in folded]
    pos, neg = sum(y for _, y in labels), sum(not y for _, y in labels)
    assert {" grobnik ", " zmerko "} <= {w if w.endswith(" ") else w + " " for w in lexicon.weights} or len(lexicon.weights) >= 3
    for term, weight in lexicon.weights.items():
        a, b = (sum(term in h for h, y, _ in found if y == side) for side in (1, 0))
        assert abs(weight - (math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1)))) < 1e-9
    for phrase in lexicon.exceptions:
        assert sum(phrase in t for t, y in folded if not y) >= 3 and not any(phrase in t for t, y in folded if y)
    x = np.array([[1, math.log1p(100 * sum(lexicon.weights[k] for k in h) / n) if h else 0, math.log1p(len(h))] for h, _, n in found])
    y = np.array([y for _, y, _ in found])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ np.array(lexicon.curve)))) - np.array([0.01, 0.05, 0.05]) * np.array(lexicon.curve)
    assert np.abs(slope).max() < 1e-4  # the penalised likelihood is at its top
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id not in (3, 5)"), lexicon).collect()}
    for (d, _), row in zip(labels, x):
        assert d in (3, 5) or abs(got[d] - 1 / (1 + math.exp(-row @ np.array(lexicon.curve)))) < 1e-9
