import random

import duckdb
import pytest
from pyspark.sql import functions as F

from treewright.llm import linededup

SCHEMA = "doc_id long, text string, n_lines string"


def corpus():
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]
    line = lambda k: " ".join(r.choices(words, k=k)) + str(r.random())
    shared = "\n".join(line(12) for _ in range(12))
    paragraph = line(60)
    rows = [(1, None, "x"), (2, "", "x"), (3, "\n\n", "x"), (4, "one", "x")]
    for i in range(5, 45):
        parts = [line(r.randrange(1, 9)) for _ in range(r.randrange(6))] + r.choice([[], [shared], [paragraph], [shared, paragraph, shared]]) + [line(3) for _ in range(r.randrange(4))]
        rows.append((i, "\n".join(parts), "x"))
    rows.append((99, max((t for _, t, _ in rows if t), key=len), "x"))
    return rows, shared, paragraph


def run(spark, rows, **more):
    out = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), **more)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    return sorted((tuple(x) for x in out.collect()), key=str)


def test_equals_sql_and_repeats_go(spark):
    rows, shared, paragraph = corpus()
    got = run(spark, rows)
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert got == sorted(db.execute(linededup.ORACLE).fetchall(), key=str)
    assert sum(paragraph in (x[1] or "") for x in got) == 1
    assert sum(shared in (x[1] or "") for x in got) == 1
    assert 4 * len({x[0]: x for x in got}[99][1]) < len(rows[-1][1])
    assert {x[0]: x[1] for x in got}[1] is None


def test_unequal_bytes_under_one_hash_are_told_apart(spark):
    rows, _, _ = corpus()
    assert run(spark, rows) == run(spark, rows, chunk_hash=lambda t: F.length(t).cast("long") % 3)


@pytest.mark.parametrize("rows", [[], [(None, "a", "x"), (None, None, "x")]])
def test_empty_and_null(spark, rows):
    assert len(run(spark, rows)) == len(rows)


def test_repeated_rows_are_one_document(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for k in range(50)) for i in range(5))
    got = run(spark, [(7, text, "x"), (7, text, "x"), (8, text, "x")])
    assert [x[1] for x in got] == [text, text, ""]


def test_lines_joined_are_the_text(spark):
    r = random.Random(1)
    texts = ["".join(r.choices(["a", "bc ", ". ", "!", "\n", " ", "\t", "\r\n", "é? ", "\x0b", "3.14 ", "w " * 13], k=r.randrange(40))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", linededup._lines(F.col("text")).alias("lines")).collect()
    db = duckdb.connect()
    for x in got:
        assert "".join(x.lines) == x.text
        assert db.execute("select regexp_extract_all(?, ?)", [x.text, linededup.LINE]).fetchone()[0] == x.lines
        for line in x.lines:
            assert len(line.split()) <= linededup.WORDS + line.count("\x0b") and "\n" not in line.strip()


def test_passages_go_and_lone_stock_lines_stay(spark):
    r = random.Random(8)
    own = lambda k: [" ".join(r.choices(["alpha", "beta", "gamma"], k=9)) + f" {r.random()}" for _ in range(k)]
    passage, stock = own(9), "This work may be copied by anyone who keeps this line as it is here."
    rows = [(i, "\n".join([stock, *own(3), *passage, *own(3)]), "x") for i in range(12)]
    got = {x[0]: x[1] for x in run(spark, rows)}
    assert got[0] == rows[0][1]
    for i in range(1, 12):  # at most NEAR - 1 lines at either end of a repeated passage stay
        lines, before = got[i].split("\n"), rows[i][1].split("\n")
        gone = [line for line in before if line not in lines]
        assert set(gone) <= set(passage) and len(gone) >= len(passage) - 2 * (linededup.NEAR - 1)
        assert gone == passage[passage.index(gone[0]) :][: len(gone)]


def test_shifted_copies_and_the_shortest_passages(spark):
    """Any run of LINES + NEAR - 1 lines is found wherever it stands, and chunks are of several lines."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("bcdfgaeiou", k=6))
    sentence = lambda k: " ".join(word() for _ in range(k)) + ". "
    least = linededup.LINES + linededup.NEAR - 1
    passages = ["".join(sentence(r.randrange(2, 12)) for _ in range(least)) for _ in range(40)] + [" ".join(word() for _ in range(51)) + "\n" for _ in range(40)]
    own = lambda k: "".join(sentence(5) for _ in range(k))
    rows = [(i, own(r.randrange(9)) + p + own(r.randrange(9)), "x") for i, p in enumerate(passages)]
    copies = [(1000 + i, own(r.randrange(9)) + p + own(r.randrange(9)), "x") for i, p in enumerate(passages)]
    got = {x[0]: x for x in run(spark, rows + copies)}
    for i, text, _ in rows:
        assert got[i][1] == text and got[i][3] == 0
    for i, p in enumerate(passages):
        _, text, _, n_removed = got[1000 + i]
        assert p not in text and n_removed >= linededup.LINES
        assert all(x in text for x in copies[i][1].replace(p, "\0").split("\0"))
