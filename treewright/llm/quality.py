"""Quality by weak supervision: rules vote or abstain, EM weighs them.

All of it is DataFrame functions. Each rule reads a text's metrics and votes 1
(good), -1 (bad) or 0 (abstains, which says nothing). Documents are good or bad, and
a rule votes -1 with a rate of its own on either kind. EM estimates these rates and
the share of good documents from the counts of vote patterns alone, at most 3 to the
number of rules: it alternates the posteriors of each pattern and the rates. All
rules start alike, as one document's worth of evidence, and nothing bounds them; so
a rule that is alone in voting against documents comes to count for little, and
rules that agree come to decide, whatever their number. A document's quality is its
posterior of being good. Documents that fail the base rules are decided already, so
EM learns from the others.

Repeated word windows are found by sorting 64-bit hashes of five word hashes
inside each text, so nothing is exploded or shuffled.

Defined results: a null text has no words; wordless and very short texts fail
the base rules and aren't kept; repeated rows and null ids are judged alone; an
empty table gives no rows; kept columns that clash with a result's name go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Rounds of EM at most, and the change of a rate that ends it.
ROUNDS = 200
SETTLED = 1e-6
#: Where EM starts: the share of good documents, and the part of any rule's votes that is -1 on good and on bad ones.
SHARE = 0.8
ON_GOOD = 0.05
ON_BAD = 0.5
KEEP = 0.5
WINDOW = 5
#: Words in which distinct ones are counted: a longer text has several such parts, the last of them up to its end.
PART = 2000
SYMBOLS = "#*$%&|<>"
SPACE = "[\\x20\\x09-\\x0D]"
#: A word of letters and digits, joined by at most single signs, in quotes, brackets and with a sentence's signs at its end.
SHAPED = "(?<![^\\x20\\x09-\\x0D])[\"'(\\[«„“”‘¿¡]*+[\\p{L}\\p{N}]++(?:['’.,:/@-][\\p{L}\\p{N}]++)*+[.,;:!?…]?+[\"')\\]»”’]*+[.,;:!?]?+(?![^\\x20\\x09-\\x0D])"
UPPER = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def metrics(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns in keep, METRICS, and those that only the rules read: n_lines, n_ended, n_upper, n_letters, n_shaped, n_kinds, n_kind_words.

    n_kinds adds up the distinct words of each part of PART words, n_kind_words the words of the parts.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(text, F.lit("")).alias("_t"))
    without = lambda signs: F.length(F.translate("_t", signs, ""))
    rows = rows.withColumn("_w", F.transform(F.filter(F.split("_t", SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("_g", F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_w") / PART).cast("int") - 1, F.lit(0)))
    kinds = F.transform(parts, lambda k: F.size(F.array_distinct(F.slice("_w", F.greatest(F.least(k * PART, F.size("_w") - PART), F.lit(0)) + 1, F.lit(PART)))))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_w").cast("long").alias("n_words"),
        without("\x20\x09\x0a\x0b\x0c\x0d").cast("long").alias("word_chars"),
        (F.length("_t") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").alias("n_lines"),
        F.size(F.filter("_l", lambda x: x.rlike("[.!?…][\"'”»)\\]]*[\\x20\\x09-\\x0D]*$"))).alias("n_ended"),
        (F.length("_t") - without(UPPER)).alias("n_upper"),
        F.length(F.regexp_replace("_t", "\\P{L}+", "")).alias("n_letters"),
        F.regexp_count("_t", F.lit(SHAPED)).alias("n_shaped"),
        F.aggregate(kinds, F.lit(0), lambda a, x: a + x).alias("n_kinds"),
        (F.size(parts) * F.least(F.size("_w"), F.lit(PART))).alias("n_kind_words"),
    )


#: Name, condition for a vote of -1, condition for a vote of 1, in SQL over the metrics.
RULES = [
    ("length", "n_words < 10", "n_words >= 50"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    ("repeats", "10 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words"),
    ("kinds", "5 * n_kinds < n_kind_words", "3 * n_kinds > n_kind_words"),
    ("upper", "10 * n_upper > 5 * word_chars", "10 * n_upper < 2 * word_chars"),
    ("ended", "10 * n_ended < n_lines", "2 * n_ended >= n_lines"),
    ("letters", "100 * n_letters < 85 * word_chars", "100 * n_letters >= 94 * word_chars"),
    ("shapes", "100 * n_shaped < 70 * n_words", "100 * n_shaped >= 92 * n_words"),
]
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"v_{name}") for name, bad, good in RULES]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """The share of good documents, and the part of each rule's votes that is -1 on good and on bad ones, by EM over pattern counts."""
    n = len(RULES)
    model = SHARE, [ON_GOOD] * n, [ON_BAD] * n
    for _ in range(rounds):
        held = [SHARE, 1 - SHARE]
        against, voted = [[ON_GOOD] * n, [ON_BAD] * n], [[1.0] * n, [1.0] * n]
        for vote, count in patterns:
            good = posterior(vote, model)
            for kind, part in enumerate((good * count, (1 - good) * count)):
                held[kind] += part
                for j, v in enumerate(vote):
                    if v:
                        voted[kind][j] += part
                        against[kind][j] += part * (v < 0)
        rates = [[a / v for a, v in zip(*kind)] for kind in zip(against, voted)]
        change = max(abs(x - y) for old, new in zip(model[1:], rates) for x, y in zip(old, new))
        model = held[0] / sum(held), *rates
        if change < SETTLED:
            break
    return model


def _weights(model) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of being good: without votes, and what each rule's -1 and 1 add."""
    share, good, bad = model
    return math.log(share / (1 - share)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(good, bad)]


def posterior(vote: tuple[int, ...], model) -> float:
    first, weights = _weights(model)
    odds = first + sum(against if v < 0 else agreed for v, (against, agreed) in zip(vote, weights) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def assess(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep), METRICS, base_failed, probability and kept."""
    added = {*METRICS, "base_failed", "probability", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    inner = {f"_k{k}": c for k, c in enumerate(keep)}
    named = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in inner.items()], F.col(f"`{text_col}`").cast("string").alias("_text"))
    measured = metrics(named, F.col("_text"), [*inner]).select(*inner, *METRICS, F.expr(BASE_FAILED).alias("base_failed"), *votes())
    measured = cut(measured, "quality-votes")
    names = [f"v_{name}" for name, _, _ in RULES]
    counted = measured.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(RULES) rows
    first, weights = _weights(estimate(sorted((tuple(r[v] for v in names), r["n"]) for r in counted)))
    odds = F.lit(first)
    for name, (against, agreed) in zip(names, weights):
        odds = odds + F.when(F.col(name) > 0, agreed).when(F.col(name) < 0, against).otherwise(0.0)
    out = measured.withColumn("probability", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP))
    return out.select(*[F.col(k).alias(c) for k, c in inner.items()], *METRICS, "base_failed", "probability", "kept")
