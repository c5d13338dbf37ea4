import random
import re

import duckdb
import regex
from pyspark.sql import functions as F

from treewright.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def corpus():
    r = random.Random(4)
    words = ["alpha", "béta", "a", "gamma.", "x|y", "**", "Delta", "\n", "\t", "\n\n", "👍", " ", "\x1c", "fine"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(60)))) for i in range(80)]
    rows += [(100 + i, " ".join(f"w{r.randrange(500)}" for _ in range(80)) + ".") for i in range(60)]
    rows += [(200 + i, "BUY NOW!! $$$ " * 30) for i in range(15)]
    rows += [(300, None), (301, ""), (302, "a b c d e a b c d e"), (303, "z " * 20000), (304, " ".join(map(str, range(9)))), (302, "a b c d e a b c d e"), (None, "one two")]
    return rows


def test_metrics_equal_brute_force(spark):
    rows = [x for x in corpus() if len(x[1] or "") < 5000]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, kept int, _t string")
    got = quality.assess(docs, keep=["doc_id", "_t", "kept"])
    assert got.columns == ["doc_id", "_t", *quality.METRICS, "base_failed", "probability", "kept"]
    for x in got.collect():
        t = next(t for d, t in rows if d == x.doc_id)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == plain(t)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
    assert got.count() == len(rows)


def test_verdicts(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert all(got[100 + i].kept for i in range(60))
    assert not any(got[200 + i].kept for i in range(15))
    assert not any(got[k].kept for k in (300, 301, 302, 303, 304))
    assert got[303].n_repeat_words == 20000
    assert quality.assess(docs.limit(0)).count() == 0


def planted(n, bad_share=0.1):
    """Votes of planted documents: one rule is often wrong on good ones, three find the bad ones, the others see no difference."""
    r = random.Random(7)
    names = [name for name, _, _ in quality.RULES]
    wrong, finders = {"dup_lines": 0.3}, {"symbols": 0.85, "letters": 0.8, "shapes": 0.85}
    out = []
    for _ in range(n):
        bad = r.random() < bad_share
        rates = [finders.get(x, 0.02) if bad else wrong.get(x, 0.02) for x in names]
        out.append((bad, tuple(0 if r.random() < 0.1 else -1 if r.random() < p else 1 for p in rates)))
    return out


def test_em_moves_the_rates_and_beats_all_must_pass():
    rows = planted(30000)
    counts = {}
    for _, vote in rows:
        counts[vote] = counts.get(vote, 0) + 1
    patterns = sorted(counts.items())
    share, good, bad = quality.estimate(patterns)
    rate = dict(zip([name for name, _, _ in quality.RULES], zip(good, bad)))
    assert abs(share - 0.9) < 0.01
    assert abs(rate["dup_lines"][0] - 0.3) < 0.03 and abs(rate["symbols"][1] - 0.85) < 0.04 and abs(rate["upper"][1] - 0.02) < 0.02
    errors = lambda verdict: sum(verdict(vote) == bad for bad, vote in rows)
    learned, started = quality.estimate(patterns), quality.estimate(patterns, 0)
    em = errors(lambda v: quality.posterior(v, learned) >= quality.KEEP)
    truth = 0.9, [{"dup_lines": 0.3}.get(x, 0.02) for x in rate], [{"symbols": 0.85, "letters": 0.8, "shapes": 0.85}.get(x, 0.02) for x in rate]
    assert em <= 1.05 * errors(lambda v: quality.posterior(v, truth) >= quality.KEEP)  # nothing does better than the planted rates
    assert em * 20 < errors(lambda v: -1 not in v)
    assert em * 2 < errors(lambda v: quality.posterior(v, started) >= quality.KEEP)


def test_em_without_bad_documents_keeps_what_no_rule_is_against():
    rows = planted(5000, 0.0)
    model = quality.estimate(sorted((v, 1) for _, v in rows))
    assert all(quality.posterior(v, model) >= quality.KEEP for _, v in rows if -1 not in v)


def test_verdicts_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"wörd{k}" for k in range(900)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(8, 90))) + ".") for i in range(300)]
    rows += [(1000 + i, " ".join(w + r.choice(["&&&", "%%%", "$$"]) for w in r.choices(words, k=r.randrange(20, 90)))) for i in range(40)]
    rows += [(2000 + i, "\n".join(["same line here."] * 3 + [" ".join(r.choices(words, k=30)) + "."])) for i in range(40)]
    rows += [(3000, None), (3001, "")]
    measured = []
    for d, t in rows:
        n_words, chars, symbols, dups, repeats = plain(t)
        found = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip()]
        shaped = sum(bool(regex.fullmatch(r"[\p{L}\p{N}]+\.?", w)) for w in found)  # these texts' words have no other good shape
        parts = max(1, -(-n_words // quality.PART))
        assert parts == 1
        measured.append((d, n_words, chars, symbols, dups, repeats, len(lines), sum(x.endswith((".", "!", "?")) for x in lines), sum(c.isupper() for c in t or ""), sum(c.isalpha() for c in t or ""), shaped, len(set(found)), n_words))
    names = ["doc_id", *quality.METRICS, "n_lines", "n_ended", "n_upper", "n_letters", "n_shaped", "n_kinds", "n_kind_words"]
    db = duckdb.connect()
    db.execute("create table m (" + ", ".join(f"{x} bigint" for x in names) + ")")
    db.executemany("insert into m values (" + ", ".join("?" * len(names)) + ")", measured)
    cases = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end" for _, bad, good in quality.RULES)
    votes = {d: (failed, v) for d, failed, *v in db.execute(f"select doc_id, {quality.BASE_FAILED}, {cases} from m").fetchall()}
    # EM over single documents.
    share, rates = quality.SHARE, [[quality.ON_GOOD] * len(quality.RULES), [quality.ON_BAD] * len(quality.RULES)]

    def good(v):
        a, b = share, 1 - share
        for x, g, h in zip(v, *rates):
            a, b = a * (1 if x == 0 else g if x < 0 else 1 - g), b * (1 if x == 0 else h if x < 0 else 1 - h)
        return a / (a + b)

    live = [v for failed, v in votes.values() if not failed]
    for _ in range(150):
        q = [good(v) for v in live]
        kinds = [q, [1 - x for x in q]]
        new = [[(s + sum(w for w, v in zip(k, live) if v[j] < 0)) / (1 + sum(w for w, v in zip(k, live) if v[j])) for j in range(len(quality.RULES))] for k, s in zip(kinds, (quality.ON_GOOD, quality.ON_BAD))]
        share, rates = (quality.SHARE + sum(q)) / (1 + len(q)), new
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x in got:
        failed, v = votes[x.doc_id]
        assert x.base_failed == failed and x.kept == (not failed and good(v) >= quality.KEEP)
        assert abs(x.probability - good(v)) < 1e-3
    kept = {x.doc_id: x.kept for x in got}
    assert not any(kept[1000 + i] for i in range(40)) and not kept[3000] and not kept[3001]
    assert sum(kept[i] for i in range(300)) > 290


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    plan = quality.metrics(docs, F.col("text"), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_few_distinct_words_count_at_every_length(spark):
    r = random.Random(9)
    few, many = [f"few{k}" for k in range(300)], [f"many{k}" for k in range(3000)]
    sizes = [1999, 2000, 2400, 5999, 20000]
    rows = [(n, " ".join(r.choices(few, k=n))) for n in sizes] + [(-n, " ".join(r.choices(many, k=n))) for n in sizes]
    docs = spark.createDataFrame([*rows, (0, None), (1, "one word")], "doc_id long, text string")
    got = quality.metrics(docs, F.col("text"), ["doc_id"]).select("doc_id", "n_kinds", "n_kind_words", *quality.votes()).collect()
    vote = {x.doc_id: x.v_kinds for x in got}
    assert [vote[n] for n in sizes] == [-1] * 5
    assert [vote[-n] for n in sizes] == [1] * 5
    assert {x.doc_id: (x.n_kinds, x.n_kind_words) for x in got if x.doc_id in (0, 1)} == {0: (0, 0), 1: (2, 2)}
