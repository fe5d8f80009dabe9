import json

import pytest

from gneiss.sources import readers, writers
from gneiss.streaming import events


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id, word,n,flag,when\r\n1,"a, ""b""\nc",007,true,2024-01-15\r\n2,null,9007199254740993,False,x\r\n3,NaN\r\n')
    df = readers.read(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("word", "string"), ("n", "string"), ("flag", "boolean"), ("when", "string")]
    got = rows(df)
    assert got[0][0] == 1 and got[0][1].replace("\r", "") == 'a, "b"\nc' and got[0][3] is True
    assert got[2] == (3, None, None, None, None)


def test_tsv_keeps_commas_and_floats(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\n1.50\tx,y\n-5\tz\n")
    assert rows(readers.read(spark, str(path))) == [(1.5, "x,y"), (-5.0, "z")]


@pytest.mark.parametrize("body", [[{"a": 1}, {"a": 2}], {"data": [{"a": 1}, {"a": 2}]}, {"records": [{"a": 1}, {"a": 2}]}])
def test_json_shapes(spark, tmp_path, body):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(body))
    assert rows(readers.read(spark, str(path))) == [(1,), (2,)]


def test_sql_parameters_and_estimate(spark):
    df = readers.sql_table(spark, "SELECT id FROM range(10) WHERE id > :least", least=7)
    assert rows(df) == [(8,), (9,)]
    assert readers.estimate_bytes(df) >= 0


def test_registered_source(spark):
    readers.register_source("range", lambda spark, target: spark.range(int(target)))
    assert readers.read(spark, "3", "range").count() == 3


def test_audit_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"')], "id long, note string")
    writers.write_audit_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.csv(str(tmp_path / "out"), header=True, escape='"')) == [("1", 'say "hi"')]


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "event_type", "value").where("event_id < 300")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    live = events.windowed_metrics(events.read_stream(spark, str(tmp_path / "in"), batch.schema), "ts", "value", ["event_type"], "1 day", "60 days")
    events.run_once(live, "live_metrics", str(tmp_path / "cp"), "complete")
    want = {(r.start, r.event_type): r.n for r in events.windowed_metrics(batch, "ts", "value", ["event_type"], "1 day").collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("live_metrics").collect()} == want


def test_messages(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",)], "value string")
    got = events.decode_messages(df, "a int").collect()
    assert (got[0].a, got[0].undecoded) == (1, None) and got[1].a is None and got[1].undecoded == "bm90IGpzb24="


def test_metric_filter(spark):
    df = spark.sql("SELECT 'm' AS name, 1.0D AS value, TIMESTAMP '2024-01-01' AS ts, map('host', 'a') AS tags UNION ALL SELECT 'm', 2.0D, TIMESTAMP '2024-01-02', map('host', 'b')")
    assert [r.value for r in events.filter_metrics(df, "m", {"host": "b"}).collect()] == [2.0]
    assert events.filter_metrics(df, "m", {"zone": "b"}).count() == 0


def test_json_rows(spark):
    texts = ['{"a": {"b": [{"x": 1}, {"x": 2}]}}', '{"a": {"b": {"x": 3}}}', '{"a": 4}', "not json", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r.x for r in readers.json_rows(df, "text", "a.b", "x int").collect()) == [1, 2, 3]
    top = spark.createDataFrame([('[{"x": 5}]',), ('{"x": 6}',)], "text string")
    assert sorted(r.x for r in readers.json_rows(top, "text", "", "x int").collect()) == [5, 6]
