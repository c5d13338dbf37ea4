import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(PATH, encoding="utf-8").read()
SLOW = Tokenizer.from_str(CONTENT)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdl.,!a1é \x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.encoder(CONTENT)(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_special_string_and_probe():
    assert packing.encoder(CONTENT).fast is not None
    for text in ("a<|endoftext|>b", "<|endoftext|>", packing.PROBE):
        assert packing.encoder(CONTENT)(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sign", [" ", "\n", "\t", "x"])
def test_very_long_runs(sign):
    text = "a" + sign * 5_000_000 + "b" + (sign + "c") * 10
    assert packing.encoder(CONTENT)(text).tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_cuts_cost_the_least():
    r = random.Random(4)
    for _ in range(300):
        window = r.randrange(3, 12)
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + r.randrange(1, window + 1))
        places = places[1:]
        penalty = [r.choice([0, 3, 9]) for _ in places]
        cost, _ = packing.best_cuts(places, penalty, window)
        plain = {0: 0}
        for p, q in zip(places, penalty):
            plain[p] = min(plain[i] + window - (p - i) + q for i in plain if p - i <= window)
        assert cost == [plain[p] for p in places]


def texts():
    r = random.Random(8)
    words = ["alpha", "béta", "gamma.", "delta", "x!", "\n", "12"]
    out = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 50, 400])))) for i in range(60)]
    return out + [(60, None), (61, ""), (None, "one two"), (62, "long" * 3000), (5, out[5][1]), (63, "no sentence end here " * 900), (64, "a" + " " * 1_500_000 + "b")]


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_round_trip(spark, block):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = packing.pack(docs, PATH, block=block).collect()
    by_doc, by_sequence = {}, {}
    for x in got:
        assert x.length == len(x.ids) // 4 > 0
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
    expected = {}
    for d, t in rows:
        expected.setdefault(d, []).append(SLOW.encode(t or "", add_special_tokens=False).ids + [1])
    assert by_doc.keys() == expected.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda x: (x.sequence_id, x.offset))
        joined = np.frombuffer(b"".join(x.ids for x in pieces), "<u4").tolist()
        assert joined == sum(expected[d], [])
        assert {x.doc_tokens for x in pieces} == {len(e) for e in expected[d]}
        if len(expected[d]) == 1:
            assert [x.start for x in pieces] == np.cumsum([0, *[x.length for x in pieces]])[:-1].tolist()
    total = padded = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda x: x.offset)
        assert [x.offset for x in pieces] == np.cumsum([0, *[x.length for x in pieces]])[:-1].tolist()
        n = sum(x.length for x in pieces)
        assert n <= 2048
        total, padded = total + n, padded + (n if n & (n - 1) == 0 else 2048)
    assert padded <= total * 1.03


def test_query(spark, tmp_path):
    from treewright.llm.queries import op7_packing

    spark.createDataFrame(texts(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_packing(spark, str(tmp_path)).collect()
    pieces = sorted((x for x in got if x.doc_id == 62), key=lambda x: x.start)
    ids = np.array(SLOW.encode("long" * 3000, add_special_tokens=False).ids + [1], "<u4")
    assert [x.ids_crc32 for x in pieces] == [zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
