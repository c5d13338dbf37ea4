import pytest
from pyspark.sql import functions as F

from treewright.sources import files as S
from treewright.streaming.files import on_changes


def test_scan_leaves_generated_folders_out(spark, tmp_path):
    for path in ("src/a.rs", "src/deep/b.rs", "src/c.RS", "target/x.rs", "src/_build/y.rs", "src/n.ml"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(path)
    got = S.scan_tree(spark, str(tmp_path), ["rs"]).collect()
    assert sorted(x.content for x in got) == ["src/a.rs", "src/deep/b.rs"]


def test_events_have_eight_fields(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text("direct\tA.f\ta.ml\t1\t2\t3\t4\tint -> int\n")
    assert tuple(S.read_events(spark, str(good)).first()) == ("direct", "A.f", "a.ml", 1, 2, 3, 4, "int -> int")
    (tmp_path / "bad.tsv").write_text("direct\tA.f\n")
    with pytest.raises(Exception, match="not an event"):
        S.read_events(spark, str(tmp_path / "bad.tsv")).collect()


def test_captured_programs_merge(spark, tmp_path):
    span = '{"file": "a.rs", "sl": 1, "sc": 0, "el": 2, "ec": 1}'
    for k in "xy":
        (tmp_path / f"{k}.json").write_text(f'{{"crate_name": "{k}", "functions": [{{"base_key": "f", "key": "f", "display": "f()", "definition_name": "f", "body_span": {span}, "calls": []}}]}}')
    assert [x.crate_name for x in S.read_programs(spark, str(tmp_path)).collect()] == ["x"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "z.json").write_text('{"crate_name": "z", "functions": []}')
    with pytest.raises(ValueError, match="nothing was captured"):
        S.read_programs(spark, str(tmp_path / "none"))


def test_fingerprint_tells_contents_and_paths(spark):
    make = lambda rows: S.fingerprint(spark.createDataFrame(rows, "path string, content string")).first()[0]
    one = make([("a", "x"), ("b", "y")])
    assert one == make([("b", "y"), ("a", "x")])
    assert len({one, make([("a", "y"), ("b", "x")]), make([("a", "x")]), make([])}) == 4


def test_ir_round_trip(spark, tmp_path):
    df = spark.range(3)
    S.save_ir({"functions": df}, str(tmp_path), "k1")
    assert S.load_ir(spark, str(tmp_path), ["functions"], "k1")["functions"].count() == 3


def test_stream_of_versions(spark, tmp_path):
    rows = [("a", "1", "2024-01-01 00:00:00"), ("a", "1", "2024-01-01 00:00:05"), ("a", "2", "2024-01-01 00:01:00"), ("b", "3", "2024-01-01 00:00:30")]
    spark.createDataFrame(rows, "path string, content string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(f"{tmp_path}/in")
    seen = {}
    query = on_changes(spark.readStream.schema("path string, content string, at timestamp").parquet(f"{tmp_path}/in"), lambda files, n: seen.update({x.path: x.content for x in files.collect()}), f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert seen == {"a": "2", "b": "3"}
