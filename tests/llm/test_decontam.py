import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from treewright.llm import decontam


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, found, longest = plain_words(text), set(), set(), 0
        for item, item_text in items:
            w = plain_words(item_text)
            m = min(10, len(w))
            for a in range(len(w) - m + 1) if w else []:
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == w[a : a + m]:
                        hit |= {*range(p, p + m)}
                        found |= {str(item)} - {"None"}
                        k = m
                        while p + k < len(words) and a + k < len(w) and words[p + k] == w[a + k]:
                            k += 1
                        longest = max(longest, k)
        out.append((doc_id, len(words), len(hit), longest, sorted(found)))
    return sorted(out, key=str)


def tables():
    r = random.Random(11)
    vocabulary = ["the", "of", "Été", "a1", "and", "to", "ß", "x"]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [(k, text(r.choice([4, 5, 9, 10, 11, 25, 60]))) for k in range(12)] + [(77, ""), (78, None), (79, "!!"), (None, text(30))]
    items += [(3, items[3][1]), (80, items[5][1])]
    docs = [(0, None), (1, ""), (2, "...")]
    for d in range(3, 40):
        chosen = r.choice(items)[1] or ""
        cut = chosen.split()[r.randrange(3) :]
        docs.append((d, text(r.randrange(40)) + r.choice([" ", " ", ", "]) + ",".join(cut).upper() + " " + text(r.randrange(12))))
    return docs + docs[5:8], items


def test_equals_brute_force_in_any_blocks(spark):
    docs, items = tables()
    left = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, _text string")
    right = spark.createDataFrame(items, "item_id int, text string")
    for block_bytes in (1 << 20, 300):
        got = decontam.find_hits(left, right, block_bytes=block_bytes).select("doc_id", "hits.n_words", "hits.n_hit", "hits.longest", "hits.items", "_text", "text").collect()
        assert sorted((tuple(x[:5]) for x in got), key=str) == plain(docs, items)
        assert all(x[5] == "z" for x in got)
    kept = decontam.decontaminate(left, right)
    assert kept.columns == left.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x[0] for x in plain(docs, items) if not x[2])


def test_suffix_array_is_sorted():
    r = np.random.default_rng(2)
    ids = r.integers(0, 3, 200)
    assert decontam.suffix_array(ids, 200).tolist() == sorted(range(200), key=lambda i: ids[i:].tolist())


def test_empty_tables(spark):
    docs, items = tables()
    none = spark.createDataFrame([], "item_id int, text string")
    left = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontam.find_hits(left, none).agg(F.sum("hits.n_hit")).first()[0] == 0
    assert decontam.find_hits(left.limit(0), none).count() == 0


def test_query_digest(spark, tmp_path):
    from treewright.llm.queries import op3_decontam

    docs, items = tables()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(x) for x in op3_decontam(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, _, i in plain(docs, items)), key=str)


def test_clashing_names(spark):
    docs, items = tables()
    right = spark.createDataFrame(items, "item_id int, text string")
    left = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, hits int, _hits_ int, _found int")
    found = decontam.find_hits(left, right)
    assert found.columns == ["doc_id", "text", "_hits_", "_found", "hits"]
    assert found.select("hits.n_hit", "_hits_").where("_hits_ = 2").count() == len(docs)
    other = decontam.find_hits(left, right, hits_col="_hits_")
    assert other.columns == ["doc_id", "text", "hits", "_found", "_hits_"] and other.select("_hits_.n_hit").count() == len(docs)
    kept = decontam.decontaminate(left, right)
    assert kept.columns == left.columns and {(x.hits, x._hits_, x._found) for x in kept.collect()} == {(1, 2, 3)}


def test_very_long_text(spark):
    words = [f"w{k % 9973}" for k in range(400000)]
    left = spark.createDataFrame([(1, " ".join(words)), (2, "w1 " * 300000)], "doc_id long, text string")
    right = spark.createDataFrame([(5, " ".join(words[20000:20030])), (6, "w1 " * 12)], "item_id int, text string")
    got = {x.doc_id: x for x in decontam.find_hits(left, right).select("doc_id", "hits.n_words", "hits.n_hit", "hits.items").collect()}
    places = sum(words[p] == words[20000] for p in range(len(words)))
    assert got[1].n_words == 400000 and got[1]["items"] == ["5"] and got[1].n_hit in (30 * places, 30 * places - 29)
    assert got[2].n_hit == 300000 and got[2]["items"] == ["6"]
