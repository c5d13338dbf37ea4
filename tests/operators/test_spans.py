import random

from pyspark.sql import functions as F

from treewright.operators import spans


def test_tightest_enclosing_equals_brute_force(spark):
    r = random.Random(6)
    span = lambda: (a := r.randrange(90), r.randrange(4), a + r.choice([0, 0, 1, 3, 20, 64]), r.randrange(4, 9))
    outer = [(k, r.choice("ab"), *span()) for k in range(150)] + [(900, "a", 0, 0, 5000, 9)]
    inner = [(k, r.choice("abc"), *span()) for k in range(150)]
    got = spans.tightest_enclosing(
        spark.createDataFrame(inner, "inner long, file string, sl int, sc int, el int, ec int"), spark.createDataFrame(outer, "outer long, file string, sl int, sc int, el int, ec int"), "inner", "outer"
    )
    expected = {}
    for k, file, *i in inner:
        holding = [((o[2] - o[0], o[3] - o[1]), n) for n, f, *o in outer if f == file and (o[0], o[1]) <= (i[0], i[1]) and (i[2], i[3]) <= (o[2], o[3])]
        if holding:
            expected[k] = min(holding)[1]
    assert {x.inner: x.outer for x in got.collect()} == expected and len(expected) > 50


def test_enclosing_spans_are_not_sent_to_the_driver(spark, tmp_path):
    rows = spark.range(3000).select("id", F.lit("a").alias("file"), F.col("id").cast("int").alias("sl"), F.lit(0).alias("sc"), (F.col("id") + F.col("id") % 5).cast("int").alias("el"), F.lit(9).alias("ec"))
    rows.write.parquet(f"{tmp_path}/spans")
    rows = spark.read.parquet(f"{tmp_path}/spans")
    got = spans.tightest_enclosing(rows.withColumnRenamed("id", "inner"), rows.withColumnRenamed("id", "outer"), "inner", "outer")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(x.inner, x.outer) for x in got.collect()} == {(k, k) for k in range(3000)}


def test_nearest_unique_equals_brute_force(spark):
    r = random.Random(7)
    points = [(r.choice("ab"), r.randrange(40)) for _ in range(60)] + [("c", 1)]
    places = [(r.choice("ab"), r.randrange(40), k) for k in range(25)]
    expected = set()
    for key, p in set(points):
        near = sorted((abs(p - q), v) for k, q, v in places if k == key)
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            expected.add((key, p, near[0][1]))
    got = spans.nearest_unique(spark.createDataFrame(points, "key string, p int"), spark.createDataFrame(places, "key string, q int, v int"), ["key"], "p", "q", "v")
    assert {(x.key, x.p, x.v) for x in got.collect()} == expected and got.count() == len(expected)


def test_claims_take_each_event_once_in_source_order(spark):
    calls = [("f", 0, "go", 3, 0, 3, 9), ("f", 1, "go", 3, 2, 3, 7), ("f", 2, "stop", 8, 0, 9, 1), ("g", 0, "go", 3, 0, 3, 9)]
    events = [("f", 10, "go", 3, 0, 3, 9), ("f", 11, "go", 3, 3, 3, 6), ("f", 12, "other", 8, 0, 8, 4), ("f", 13, "go", 70, 0, 70, 4)]
    got = spans.claim_events(spark.createDataFrame(calls, "caller string, ord int, name string, sl int, sc int, el int, ec int"), spark.createDataFrame(events, "caller string, event long, name string, sl int, sc int, el int, ec int"))
    assert {(x.caller, x.ord, x.event) for x in got.collect()} == {("f", 0, 10), ("f", 1, 11), ("f", 2, 12)}
    assert got.where(F.col("event") == 13).count() == 0
