import random

from pyspark.sql import functions as F

from treewright.llm import nearcopies, simhash, stages


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = grams(a), grams(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    r = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(40):
        base = r.choices(words, k=r.choice([3, 30, 150, 600]))
        texts.append(" ".join(base))
        for _ in range(4):
            copy = [*base]
            for _ in range(r.choice([0, 1, len(base) // 60, len(base) // 25])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy).upper())
    r.shuffle(texts)
    return list(enumerate([*texts, "", "  "]))


def test_edited_copies_go_and_others_stay(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, rows[3], (None, rows[0][1])], "doc_id long, text string")
    out = stages.one_of_each_group(docs).collect()
    kept = {x.doc_id: x.text for x in out if x.doc_id is not None}
    assert len(out) == len(kept) + 1
    assert not [(a, b) for a in kept for b in kept if a < b and similar(kept[a], kept[b])]
    assert all(any(similar(text, other) for k, other in rows if k < d) for d, text in rows if d not in kept)


def test_buckets_of_unlike_documents_are_compared_in_full(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(nearcopies, "bands", lambda hashes: [1] * (len(hashes) > 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.kept_id: rows[x.kept_id][1] for x in nearcopies.kept_rows(docs).collect()}
    assert not [(a, b) for a in kept for b in kept if a < b and similar(kept[a], kept[b])]


def test_groups_of_simhash_decide(spark, monkeypatch):
    """Texts that repeat one passage and end in different words: 4 bits apart at most, far below 0.8."""
    texts = ["one two three four five six seven " * 300 + " ".join(f"{tail}{k}" for k in range(12)) for tail in "abc"] + ["a text of its own with other words"]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 4 for p in prints[:3]) and not any(similar(texts[0], t) for t in texts[1:])
    docs = spark.createDataFrame(list(enumerate(texts, 5)), "doc_id long, text string")
    left = lambda: sorted(x.doc_id for x in stages.one_of_each_group(docs).collect())
    assert left() == [5, 8]
    monkeypatch.setattr(simhash, "near_duplicates", lambda rows, *a, **b: rows.select("doc_id", F.col("doc_id").alias("component_id")))
    assert left() == [5, 6, 7, 8]
