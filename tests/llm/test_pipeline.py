import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from test_decontam import plain as plain_hits
from test_simhash import plain as plain_groups
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from treewright.llm import linededup

LANGS = {"aa": ["the", "of", "tion", "ing", "wh"], "bb": ["sch", "ung", "der", "keit", "über"]}


def tables():
    r = random.Random(12)
    say = lambda lang, k: " ".join("".join(r.choices(LANGS[lang], k=r.randrange(1, 4))) for _ in range(k))
    items = [(k, say("aa", 25)) for k in range(4)]
    shared = "\n".join(say("aa", 14) + "." for _ in range(8))
    docs = []
    for i in range(90):
        lang = r.choice([*LANGS])
        text = "\n".join(say(lang, r.randrange(4, 30)) + "." for _ in range(r.randrange(1, 9)))
        text += r.choice(["", "", "\n" + shared, "\n" + r.choice(items)[1]])
        docs.append((i, text, lang))
    docs += [(200, None, "aa"), (201, "", None), (202, "123 !!", "bb"), (203, "qqxz zxqj vvkx " * 30, None), (204, docs[3][1], "aa"), (205, docs[3][1] + " the", "aa"), (206, docs[5][1] + " " * 1_200_000 + docs[6][1], docs[5][2]), (0, docs[0][1], docs[0][2])]
    return docs, items


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = tables()
    wide = spark.createDataFrame([(*d, 0.5, True) for d in docs], "doc_id long, text string, lang string, score double, _hits_ boolean")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    out = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, folder)
        if k < 4:
            assert out.columns == wide.columns
        seen.append(out.collect())

    known = [(x.doc_id, x.text) for x in seen[0]]
    gone = {d for d, _, _ in docs} - {d for d, _ in known}
    assert gone == {200, 201, 202, 203} and len(known) == len(docs) - 4

    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", sorted(set(known)))
    cleaned = {d: t for d, t, _, _ in db.execute(linededup.ORACLE).fetchall()}
    assert sorted((x.doc_id, x.text) for x in seen[1]) == sorted((d, cleaned[d]) for d, _ in known)

    groups = plain_groups(sorted(cleaned.items()))
    left = sorted(d for d, _, least in groups if d == least)
    assert sorted(x.doc_id for x in seen[2]) == left

    clean = [d for d, _, hit, _, _ in plain_hits([(d, cleaned[d]) for d in left], items) if not hit]
    assert sorted(x.doc_id for x in seen[3]) == sorted(clean)

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, folder).collect())
    assert {g[0] for g in got} == set(clean)
    for d in clean:
        ids = np.array(coder.encode(cleaned[d], add_special_tokens=False).ids + [1], "<u4")
        mine = [g for g in got if g[0] == d]
        assert [g[1] for g in mine] == np.cumsum([0, *[g[2] for g in mine]])[:-1].tolist() and sum(g[2] for g in mine) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for _, a, n, c in mine)


def test_empty_tables(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items[:0], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in __spark_entry__.queries())] == []
